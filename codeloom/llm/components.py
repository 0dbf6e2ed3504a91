"""Connected components of a written table of links, by stars that tasks contract. No group is gathered and nothing comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

#: Links that a task contracts at once, and that tasks are made for.
LINKS = 20_000
STAR = "u long, v long"


def _contracted(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Links as stars that connect the same ids: a row (id, smallest id) for each id but the smallest of its component."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    ids = list(up)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], names=["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v), LINKS at a time, to stars. Links of one u that stand together are contracted together."""
    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(batch)
        if size >= LINKS:
            u, v = map(np.concatenate, zip(*held))
            other = np.flatnonzero(u != u[-1])
            if len(other):
                cut = int(other[-1]) + 1
                yield _contracted(u[:cut], v[:cut])
                held, size = [(u[cut:], v[cut:])], len(u) - cut
    if held:
        yield _contracted(*map(np.concatenate, zip(*held)))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) to a written table (id, component): a row for each id in a link; component is the smallest id reachable.

    Tasks contract the links they hold to stars, so an id comes from each task at most a few times, however many links it has.
    Then, until every id has one target and no target has one of its own: links are dealt by their larger id and contracted, and
    each link's target is replaced by the smallest id that the target is known with. Null ids and links to oneself are no links.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tasks = max(1, -(-now.count() // LINKS))
    now, k = now.coalesce(tasks).mapInArrow(_contract, STAR), 0
    while True:
        stars = scratch.save(now.repartition(tasks, "u").sortWithinPartitions("u").mapInArrow(_contract, STAR), f"{name}-stars-{k}")
        ends = stars.select(F.col("u").alias("id"), "v").unionByName(stars.select(F.col("v").alias("id"), "v"))
        low = scratch.save(ends.groupBy("id").agg(F.min("v").alias("component"), F.max("v").alias("high")), f"{name}-{k}")
        if k:
            scratch.drop(f"{name}-stars-{k - 1}", f"{name}-{k - 1}")
        if low.where("component <> high").isEmpty():
            scratch.drop(f"{name}-stars-{k}")
            return low.select("id", "component")
        jumped = stars.join(low, F.col("v") == F.col("id")).select("u", F.col("component").alias("v"))
        now = jumped.unionByName(low.where("component < id").select(F.col("id").alias("u"), F.col("component").alias("v"))).mapInArrow(_contract, STAR)
        k += 1
