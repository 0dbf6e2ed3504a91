"""Exact k-means on whole numbers by kd-tree filtering.

Each task packs its vectors, in the order they come, into blocks, and each block into a kd-tree: vectors in the tree's order, and for every node its
box, and the count and sum of its vectors. The trees are written once. A round walks each tree with all centroids: a
centroid that another one beats all over a node's box is dropped below it; a node with one centroid left goes to it whole, by its sums; in
leaves the rest is settled vector by vector. Tasks give sums by cluster, which Spark adds up; the driver has the centroids only. All is
in integers, so neither the trees' shapes nor the order of sums can change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

DIM = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Vectors of a block, 1 MB in its table.
ROWS = 4_096
LEAF = 16
#: Components beyond make distances that 64 bits can't hold.
LARGEST = 1 << 27
TREE = "ids binary, known binary, vectors binary, nodes binary, boxes binary, sums binary"
SUMS = "cluster int, n long, d int, s long"


@dataclass
class Tree:
    """nodes: start, end and the two children (0: a leaf) by row, parents first; boxes: low, high; sums: of each node's vectors."""

    vectors: np.ndarray
    nodes: np.ndarray
    boxes: np.ndarray
    sums: np.ndarray


def grown(vectors: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """A kd-tree over vectors, and the order it holds them in. Nodes are halved at the widest side's median; equal vectors aren't divided."""
    order, nodes, boxes = np.arange(len(vectors)), [[0, len(vectors), 0, 0]], []
    k = 0
    while k < len(nodes):
        start, end = nodes[k][:2]
        some = vectors[order[start:end]]
        low, high = some.min(axis=0), some.max(axis=0)
        boxes.append((low, high))
        side = int((high - low).argmax())
        if end - start > leaf and low[side] < high[side]:
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(some[:, side], half, kind="introselect")]
            nodes[k][2:] = len(nodes), len(nodes) + 1
            nodes += [[start, start + half, 0, 0], [start + half, end, 0, 0]]
        k += 1
    held, at = vectors[order], np.array(nodes, np.int64)
    upto = np.zeros((len(held) + 1, held.shape[1]), np.int64)
    np.cumsum(held, axis=0, out=upto[1:])
    return Tree(held, at, np.array(boxes, np.int64), upto[at[:, 1]] - upto[at[:, 0]]), order


def dominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, left: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Which centroids can win nowhere in each box, as best does better all over it: it is nearer, or as near with a smaller number.

    |p - c|^2 - |p - b|^2 is linear in p, so its least value in a box is at the corner where each component of p is high if c's is over b's, else low.
    """
    b = centroids[best]
    size = (centroids * centroids).sum(axis=1)
    apart = centroids[None] - b[:, None]
    corner = np.where(apart > 0, high[:, None], low[:, None])
    least = size[None] - size[best][:, None] - 2 * (corner * apart).sum(axis=2)
    later = np.arange(len(centroids))[None] > best[:, None]
    return left & ((least > 0) | (later & (least == 0)))


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances; by products in double precision where those are exact."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if vectors.shape[1] * most * most < 1 << 53:
        product = (vectors.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
        return (vectors * vectors).sum(axis=1)[:, None] - 2 * product + (centroids * centroids).sum(axis=1)[None]
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def walked(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """What filtering settles: (node, centroid) of whole nodes; places of the other vectors, and their nearest centroids."""
    whole, open_, at = [], [], np.array([0])
    left = np.ones((1, len(centroids)), bool)
    while len(at):
        low, high = tree.boxes[at, 0], tree.boxes[at, 1]
        # The best for the middle of a box is the one to hold the others against; any choice gives right results.
        far = distances(low + high, 2 * centroids)
        best = np.where(left, far, np.iinfo(np.int64).max).argmin(axis=1)
        left &= ~dominated(low, high, centroids, left, best)
        one = left.sum(axis=1) == 1
        whole += zip(at[one].tolist(), best[one].tolist())
        leaf = tree.nodes[at, 2] == 0
        open_ += zip(at[~one & leaf].tolist(), left[~one & leaf])
        below = ~one & ~leaf
        at, left = tree.nodes[at[below], 2:].ravel(), np.repeat(left[below], 2, axis=0)
    if not open_:
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = tree.nodes[[k for k, _ in open_], :2]
    sizes = spans[:, 1] - spans[:, 0]
    places = np.concatenate([np.arange(s, e) for s, e in spans])
    may = np.repeat(np.array([m for _, m in open_]), sizes, axis=0)
    far = np.where(may, distances(tree.vectors[places], centroids), np.iinfo(np.int64).max)
    return whole, places, far.argmin(axis=1)


def _kept(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the whole numbers, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST / SCALE))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == DIM) & finite)
    return some.select("vec_id", F.transform("x", lambda e: F.floor(F.lit(float(SCALE)) * e).cast("long")).alias("v"))


def _grow(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, v) to TREE, a row for each `rows` vectors of the partition."""
    held: list[pa.RecordBatch] = []

    def tree():
        ids = pa.concat_arrays([b.column(0) for b in held])
        grown_, order = grown(np.concatenate([b.column(1).flatten().to_numpy() for b in held]).reshape(len(ids), DIM))
        known = np.asarray(ids.is_valid())[order]
        own = (ids.fill_null(0).to_numpy()[order], known, grown_.vectors.astype(np.int32), grown_.nodes, grown_.boxes.astype(np.int32), grown_.sums)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in own], names=["ids", "known", "vectors", "nodes", "boxes", "sums"])

    n = 0
    for batch in batches:
        while len(batch):
            some = batch.slice(0, rows - n)
            held.append(some)
            batch, n = batch.slice(len(some)), n + len(some)
            if n == rows:
                yield tree()
                n = 0
    if n:
        yield tree()


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Tree]]:
    for batch in batches:
        for r in range(len(batch)):
            raw = [c[r].as_py() for c in batch.columns]
            ids, nodes, sums = (np.frombuffer(raw[k], np.int64) for k in (0, 3, 5))
            vectors, boxes = (np.frombuffer(raw[k], np.int32).astype(np.int64) for k in (2, 4))
            yield ids, np.frombuffer(raw[1], bool), Tree(vectors.reshape(-1, DIM), nodes.reshape(-1, 4), boxes.reshape(-1, 2, DIM), sums.reshape(-1, DIM))


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """TREE to SUMS: of each cluster's vectors in this task, by component."""
    total, n = np.zeros((len(centroids), DIM), np.int64), np.zeros(len(centroids), np.int64)
    for _, _, tree in _trees(batches):
        whole, places, nearest = walked(tree, centroids)
        for node, c in whole:
            total[c] += tree.sums[node]
            n[c] += tree.nodes[node, 1] - tree.nodes[node, 0]
        for c in range(len(centroids)):
            total[c] += tree.vectors[places[nearest == c]].sum(axis=0)
        n += np.bincount(nearest, minlength=len(centroids))
    c, d = np.divmod(np.arange(total.size), DIM)
    some = n[c] > 0
    columns = [pa.array(x[some]) for x in (c.astype(np.int32), n[c], d.astype(np.int32), total.ravel())]
    yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "d", "s"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """TREE to (vec_id, cluster, distance)."""
    for ids, known, tree in _trees(batches):
        whole, places, nearest = walked(tree, centroids)
        own = np.zeros(len(ids), np.int32)
        own[places] = nearest
        for node, c in whole:
            own[slice(*tree.nodes[node, :2])] = c
        away = ((tree.vectors - centroids[own]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(own), pa.array(away)], names=["vec_id", "cluster", "distance"])


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose `1:<vec_id>` have the smallest SHA-256, ascending; of one vec_id's rows the smallest vector first."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in kept.orderBy(name, "v").limit(clusters).select("v").collect()], np.int64).reshape(-1, DIM)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; an empty one stays."""
    some = trees.mapInArrow(lambda b: _sums(b, centroids), SUMS)
    found = some.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = centroids.copy()
    for r in found:
        out[r.cluster, r.d] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, rows: int = ROWS, scratch: Scratch | None = None) -> DataFrame:
    """A row for each vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors has vec_id and embedding; those of exactly DIM components, none null or not finite, take part, as floor(SCALE * x), and so do
    rows that repeat a vec_id or have none (as a first centroid, such counts as having an empty one). Components from 2**21 up in size are beyond
    what distances in 64 bits can hold; their vectors take no part. With fewer vectors than clusters there are as many clusters as vectors. Equal
    distances go to the smaller number. cluster_inertia and inertia are null where 64 bits can't hold them. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "clusters")
    kept = _kept(vectors)
    centroids = first_centroids(kept, clusters)
    trees = scratch.save(kept.mapInArrow(lambda b: _grow(b, rows), TREE), "trees")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(trees, centroids)
    found = scratch.save(trees.mapInArrow(lambda b: _assigned(b, centroids), "vec_id long, cluster int, distance long"), "assigned")
    scratch.keep("assigned")
    totals = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda s: s if s < 1 << 63 else None
    told = [(c, fits(totals[c]), fits(sum(totals.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(totals)]
    known = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, by the distances of all vectors from all centroids."""
    steps = "".join(f"""
a{r} AS (SELECT v.row, v.vec_id, v.v, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{r} AS c
  QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY distance, c.c) = 1),""" + (f"""
m{r} AS (SELECT c, d, sum(v[d])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, {DIM + 1}) AS r(d) GROUP BY c, d),
n{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS v FROM m{r} GROUP BY c),
c{r + 1} AS (SELECT c{r}.c, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (c)),""" if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h, v LIMIT {clusters})),{steps}
t AS (SELECT c, sum(distance) AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance, cluster_inertia::BIGINT AS cluster_inertia, (SELECT sum(distance) FROM a{rounds})::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN t USING (c) JOIN c{rounds} USING (c)
"""
