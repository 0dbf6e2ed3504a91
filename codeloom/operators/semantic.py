"""Vectors of nodes and the nearest of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.plans.graph import CodeGraph

BATCH = 128


def normalise(v: Column) -> Column:
    """A vector at length one; a zero vector as it is."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(size == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def dot(a: Column, b: Column) -> Column:
    """The inner product over the shorter length, summed in double precision."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def hashed(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A provider without a model: signed sums of hashed words, the same in every run."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            row[h % dim] += 1 if h >> 63 else -1
    return out.tolist()


def embed_text() -> Column:
    """What of a node is embedded: its name, signature and docstring, white space squeezed."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", C.shown_name(), "signature", "docstring"), r"\s+", " "))


def embed(nodes: DataFrame, provider: Callable[[list[str]], list[list[float]]] = hashed) -> DataFrame:
    """node_id, dim, vec of nodes, normalised. The provider gets up to BATCH texts at once, on the executors."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), BATCH):
                some = part.iloc[k : k + BATCH]
                vectors = provider(list(some["text"]))
                yield pd.DataFrame({"node_id": some["id"].to_numpy(), "dim": [len(v) for v in vectors], "vec": vectors})

    found = nodes.where("kind <> 'file'").select("id", embed_text().alias("text")).mapInPandas(run, "node_id string, dim int, vec array<double>")
    return found.select("node_id", "dim", F.transform(normalise(F.col("vec")), lambda x: x.cast("float")).alias("vec"))


def prune(g: CodeGraph) -> DataFrame:
    """Embeddings of nodes that are still there."""
    return g.embeddings.join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def put(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    return embeddings.join(new.select("node_id"), "node_id", "left_anti").unionByName(new)


def top_k(embeddings: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    """node_id, score: the nearest by inner product with a query vector, ties by id."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    return embeddings.select("node_id", dot(F.col("vec"), asked).alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def semantic(g: CodeGraph, text: str, k: int = 20, provider: Callable[[list[str]], list[list[float]]] = hashed) -> DataFrame:
    """The nodes nearest to a text, with their score."""
    v = np.array(provider([text])[0])
    v = v / np.linalg.norm(v) if v.any() else v
    return g.nodes.join(top_k(g.embeddings, v.tolist(), k).withColumnRenamed("node_id", "id"), "id").orderBy(F.desc("score"), "id")
