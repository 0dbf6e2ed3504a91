"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are packed into blocks of int8 codes; every tile of a query block and a candidate block is one product of
int8 matrices, which gives each pair's inner product up to a bound from the two vectors' quantisation errors. Blocks hold codes, bounds and ids
only. A pair survives in its tile if its upper bound reaches the k-th largest lower bound of its query there; each query's tiles are
merged by a heap of the k largest lower bounds of all, and what still reaches it is recomputed from the original vectors in double
precision. So the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

QUERY_ROWS = 1_024
ROWS = 4_096
BLOCK = "block long, ids binary, rows binary, codes binary, scales binary, slips binary, sizes binary, dim int"


def quantise(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 codes, scale, norm of the error and norm of the coded vector, by row of x."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, 1e-300)
    codes = np.rint(x / scale[:, None])
    coded = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(x - coded, axis=1), np.linalg.norm(coded, axis=1)


def _valid(vectors: pa.Array) -> list[np.ndarray | None]:
    out = []
    for v in vectors:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all() or not x.any():
                x = None
        out.append(x)
    return out


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, vec_id, embedding) to those that take part, the vector as little-endian doubles."""
    for batch in batches:
        found = _valid(batch.column(2))
        keep = pa.array([x is not None and i is not None for x, i in zip(found, batch.column(1).to_pylist())], pa.bool_())
        raw = pa.array([None if x is None else (x + 0.0).astype("<f8").tobytes() for x in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], names=["row", "vec_id", "raw"]).filter(keep)


def _pack(batches: Iterator[pa.RecordBatch], rows: int, most_equal: int | None) -> Iterator[pa.RecordBatch]:
    """(block, row, vec_id, raw), sorted by block, to one row a block and dimension. Of equal vectors those most_equal with the smallest ids stay."""
    at, held = None, {}

    def done():
        for dim, found in sorted(held.items()):
            found.sort(key=lambda p: p[:2])
            if most_equal is not None:
                seen: dict[bytes, int] = {}
                some = []
                for p in found:
                    seen[p[2]] = seen.get(p[2], 0) + 1
                    if seen[p[2]] <= most_equal:
                        some.append(p)
                found = some
            for k in range(0, len(found), rows):
                some = found[k : k + rows]
                ids, row = np.array([p[0] for p in some], "<i8"), np.array([p[1] for p in some], "<i8")
                codes, scale, slip, size = quantise(np.stack([np.frombuffer(p[2], "<f8") for p in some]))
                got = [pa.array([at], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, row, codes, scale, slip, size)), pa.array([dim], pa.int32())]
                yield pa.RecordBatch.from_arrays(got, names=["block", "ids", "rows", "codes", "scales", "slips", "sizes", "dim"])

    for batch in batches:
        for block, row, i, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if block != at:
                yield from done()
                at, held = block, {}
            held.setdefault(len(raw) // 8, []).append((i, row, raw))
    yield from done()


def blocks(vectors: DataFrame, rows: int, most_equal: int | None) -> DataFrame:
    """vectors (row, vec_id, raw) in blocks of about rows, dealt by a hash of the row."""
    n = max(1, -(-vectors.count() // rows))
    dealt = vectors.select(F.pmod(F.xxhash64("row"), F.lit(n)).alias("block"), "row", "vec_id", "raw")
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _pack(b, 2 * rows, most_equal), BLOCK)


def _load(row: dict, side: str) -> tuple[np.ndarray, ...]:
    kinds = {"ids": "<i8", "rows": "<i8", "codes": np.int8, "scales": np.float64, "slips": np.float64, "sizes": np.float64}
    a = {k: np.frombuffer(row[f"{side}{k}"], t) for k, t in kinds.items()}
    return a["ids"], a["rows"], a["codes"].reshape(len(a["ids"]), -1), a["scales"], a["slips"], a["sizes"]


def tile(query: tuple, other: tuple, k: int, best: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The row of each query of a tile, with the rows of the others that may be among its k nearest and their lower and upper bounds.

    best holds each query's k largest lower bounds of the tiles before, and those of this one after.
    """
    q_ids, q_rows, q_codes, q_scale, q_slip, q_size = query
    ids, rows, codes, scale, slip, size = other
    # Sums of up to 2**24 are exact in single precision, so for over a thousand dimensions the product runs in double.
    kind = np.float32 if q_codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = codes.astype(kind).T
    for s in range(0, len(q_ids), 128):
        e = s + 128
        near = (q_codes[s:e].astype(kind) @ right).astype(np.float64) * (q_scale[s:e, None] * scale[None])
        # <x, y> = <x', y'> + <x - x', y> + <x', y - y'>, and |y| is at most |y'| + |y - y'|; the last term is for rounding.
        bound = q_slip[s:e, None] * (size + slip)[None] + q_size[s:e, None] * slip[None]
        bound += 1e-9 * (q_size[s:e, None] * size[None] + 1e-300)
        own = q_ids[s:e, None] == ids[None]
        low = np.where(own, -np.inf, near - bound)
        best[s:e] = np.partition(np.concatenate([low, best[s:e]], axis=1), -k, axis=1)[:, -k:]
        least = best[s:e].min(axis=1)
        high = near + bound
        # Written so that a bound that isn't a number keeps its pair.
        for r, keep in enumerate(~(high < least[:, None]) & ~own):
            j = np.flatnonzero(keep)
            if len(j):
                yield int(q_rows[s + r]), rows[j], low[r, j], high[r, j]


def _tiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The tiles of one query block mostly follow each other, so what an earlier one has found bounds what a later one gives."""
    at, best = None, np.empty((0, k))
    for batch in batches:
        for row in batch.to_pylist():
            if row["q_rows"] != at:
                at, best = row["q_rows"], np.full((len(row["q_rows"]) // 8, k), -np.inf)
            found = list(tile(_load(row, "q_"), _load(row, ""), k, best))
            if found:
                q, others, low, high = zip(*found)
                q = np.repeat(np.array(q, np.int64), [len(o) for o in others])
                yield pa.RecordBatch.from_arrays([pa.array(q), *(pa.array(np.concatenate(x)) for x in (others, low, high))], names=["q", "row", "low", "high"])


def _survivors(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (q, row, low, high) in order of q, high from large to small, to the pairs (q, row) whose upper bound reaches the k-th largest lower bound of q.

    While a query's rows come in, a heap holds its k largest lower bounds; what lies below the least of them can't be needed.
    """
    now, heap, held, out = None, [], [], []

    def done():
        least = heap[0] if len(heap) == k else -np.inf
        out.extend((now, row) for row, high in held if not high < least)

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["q", "row"])

    for batch in batches:
        for q, row, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            if q != now:
                done()
                now, heap, held = q, [], []
            if len(heap) == k and high < heap[0]:
                continue
            held.append((row, high))
            if low == low:
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, low)
        if len(out) > 10_000:
            yield batch_of(out)
            out.clear()
    done()
    if out:
        yield batch_of(out)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products by row in double precision, summed from the first component to the last."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total = total + x[:, d] * y[:, d]
    return total


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, x, y) to (query_id, vec_id, score)."""
    for batch in batches:
        score = np.zeros(len(batch))
        x, y = (batch.column(k).to_pylist() for k in (2, 3))
        by: dict[int, list[int]] = {}
        for k, v in enumerate(x):
            by.setdefault(len(v), []).append(k)
        for n, at in by.items():
            rows = lambda c: np.frombuffer(b"".join([c[k] for k in at]), "<f8").reshape(len(at), n // 8)  # noqa: B023, E731
            score[at] = products(rows(x), rows(y))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, rows: int = ROWS, query_rows: int = QUERY_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors but itself by inner product, ties to the smaller vec_id.

    vectors and queries have vec_id and embedding. Null, empty and zero vectors, such with null or non-finite components, and
    rows without a vec_id take no part; vectors of other lengths than a query's are no candidates of it. Rows that repeat a
    vec_id are candidates each; queries that do count once, with the smallest vector. Blocks are bounded. An empty table gives no
    rows. Other columns, whatever their names, are not read. Inner products are summed in order of the components.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "nearest")
    rows_of = lambda df: df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_exact, "row long, vec_id long, raw binary")
    every = scratch.save(rows_of(vectors), "vectors")
    asked = scratch.save(rows_of(queries.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))), "queries")
    n = max(1, -(-asked.count() // query_rows))
    questions = blocks(asked, query_rows, None)
    questions = questions.select(*(F.col(c).alias(f"q_{c}") for c in questions.columns))
    # A tile for each pair of blocks: candidate blocks are dealt to the query blocks, whose number is stated by the query set.
    dealt = blocks(every, rows, k + 1).withColumn("q_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    tiles = dealt.join(questions, (F.col("q_at") == F.col("q_block")) & (F.col("dim") == F.col("q_dim"))).drop("q_at", "q_block", "block", "dim", "q_dim")
    found = tiles.mapInArrow(lambda b: _tiles(b, k), "q long, row long, low double, high double")
    pairs = found.repartition("q").sortWithinPartitions("q", F.desc("high")).mapInArrow(lambda b: _survivors(b, k), "q long, row long")
    pairs = scratch.save(pairs, "pairs")
    right = every.select("row", "vec_id", F.col("raw").alias("y"))
    left = asked.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("raw").alias("x"))
    scored = pairs.join(right, "row").join(left, "q").select("query_id", "vec_id", "x", "y").mapInArrow(_scores, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = 20, every: int = 20) -> str:
    """The same in DuckDB's SQL, by all pairs of a query and a candidate."""
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % {every} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}
"""
