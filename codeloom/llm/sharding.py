"""Shards of near equal bytes by sampled splitters, in DataFrame functions only.

Rows have a total order: a hash of the text, then doc_id, then the row. Copies of a text are neighbours in it, and a text's hash says nothing
of its size or source. A sample of keys, each drawn with a chance by its row's size (and an equal part by count), is sorted, and its
quantiles are the splitters of FAN ranges; ranges of over MOST rows are sampled and subdivided again until none is overfull. A text with very
many copies is cut by doc_id and row, any other only at its edges. Ranges are small, so each is sorted in a task; the ranges' totals,
summed up by a tree of ranges, give each row its place among all rows and all bytes. A row goes to the shard in which its middle byte
falls, so no shard is off by more than one row at each end. Copies that such an end cuts stay together if they weigh SLACK of a shard or less.

Rows are facts of some forty bytes here; texts are read once, in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

SHARDS = 16
FAN = 64
#: Sampled keys for each range to be made, in expectation.
DRAWN = 32
MOST = 10_000
#: Copies stay together where they weigh at most this part of a shard.
SLACK = 0.01
#: Splitters of at most so many ranges (of FAN keys of 24 bytes, 1.5 MB in all) are sent to all executors; more are joined by range.
SENT = 1_024

_FIRST = -(1 << 63)


def _key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _order(docs: DataFrame) -> tuple[Column, Column]:
    """The text's hash and the doc_id as they order rows; no doc_id comes first."""
    return _key(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))


def facts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, doc = _order(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"), doc.alias("doc"), F.monotonically_increasing_id().alias("row"),
    )


def splitters(rows: DataFrame, over: DataFrame, level: int, fan: int) -> DataFrame:
    """A row for each of the overfull ranges (range, n, bytes): its quantiles of a sample as an array of fan - 1 keys."""
    # Half of the chance by size, half by count: a range of one huge row and many small ones is divided as well.
    chance = fan * DRAWN / 2 * (F.col("size") / F.col("bytes") + 1 / F.col("n"))
    draw = F.shiftrightunsigned(F.xxhash64("key", "doc", "row", F.lit(level)), 11) / float(1 << 53)
    drawn = _beside(rows, over).where(draw < chance).groupBy("range").agg(F.array_sort(F.collect_list(F.struct("key", "doc", "row"))).alias("drawn"))
    at = lambda i: F.get("drawn", F.floor(i * F.size("drawn") / fan).cast("int"))
    quantiles = drawn.select("range", F.transform(F.sequence(F.lit(1), F.lit(fan - 1)), at).alias("q"))
    edge = lambda x: F.struct(x["key"].alias("key"), F.lit(_FIRST).alias("doc"), F.lit(_FIRST).alias("row"))
    inside = lambda x, i: F.when((i > 0) & (F.get("q", i - 1)["key"] == x["key"]), x).otherwise(edge(x))
    return quantiles.select("range", F.transform("q", inside).alias("q"))


def _beside(rows: DataFrame, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """rows with what is known of their range. ranges is a written table."""
    return rows.join(F.broadcast(ranges) if ranges.count() <= SENT else ranges, "range", how)


def ranged(rows: DataFrame, scratch: Scratch, most: int = MOST, fan: int = FAN) -> tuple[DataFrame, int]:
    """rows with range, which orders as the rows do and holds at most `most` of them, and how often all ranges were divided."""
    level, now = 0, scratch.save(rows.withColumn("range", F.lit(0).cast("long")), "ranged-0")
    while True:
        totals = now.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        over = scratch.save(totals.where(F.col("n") > most), f"over-{level}")
        if over.isEmpty():
            return now, level
        quantiles = scratch.save(splitters(now, over, level, fan), f"splitters-{level}")
        own = F.struct("key", "doc", "row")
        below = F.coalesce(F.size(F.filter("q", lambda s: s <= own)), F.lit(0))
        below = F.when(F.col("q").isNull(), 0).otherwise(below)
        divided = _beside(now, quantiles, "left").withColumn("range", F.col("range") * fan + below).drop("q")
        now, level = scratch.save(divided, f"ranged-{level + 1}"), level + 1
        scratch.drop(f"ranged-{level - 1}", f"over-{level - 1}", f"splitters-{level - 1}")


def _before(totals: DataFrame, level: int, fan: int) -> DataFrame:
    """totals (range, n, bytes) with n_before and bytes_before, summed within the ranges that one was divided into, level by level."""
    if not level:
        return totals.withColumn("n_before", F.lit(0).cast("long")).withColumn("bytes_before", F.lit(0).cast("long"))
    own = totals.withColumn("up", F.expr(f"range div {fan}"))
    above = own.groupBy(F.col("up").alias("range")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    above = _before(above, level - 1, fan).select(F.col("range").alias("up"), F.col("n_before").alias("n_up"), F.col("bytes_before").alias("bytes_up"))
    earlier = Window.partitionBy("up").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    more = lambda c: (F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.col(f"{c}_up")).alias(f"{c}_before")
    return own.join(above, "up").select("range", "n", "bytes", more("n"), more("bytes"))


def placed(docs: DataFrame, scratch: Scratch, most: int = MOST, fan: int = FAN) -> DataFrame:
    """A written table: facts of each row with at, its place among all rows, and bytes_at, the bytes of the rows before it."""
    rows, level = ranged(facts(docs), scratch, most, fan)
    totals = scratch.save(rows.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "totals")
    before = scratch.save(_before(totals, level, fan).select("range", "n_before", "bytes_before"), "before")
    order = Window.partitionBy("range").orderBy("key", "doc", "row")
    sums = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = rows.join(before, "range").withColumns({"at": F.col("n_before") + F.row_number().over(order) - 1, "bytes_at": F.col("bytes_before") + sums})
    found = scratch.save(found.select("doc_id", "size", "text_crc32", "key", "doc", "row", "at", "bytes_at"), "placed")
    scratch.keep("placed")
    return found


@dataclass(frozen=True)
class Cut:
    """Where shards begin: places among all rows, and the keys (key, doc, row) found there."""

    starts: list[int]
    keys: list[tuple[int, int, int] | None]


def cut(rows: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> Cut:
    """The beginnings of so many shards of near equal bytes over placed rows. The driver gets a few figures for each shard."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return Cut([0] * shards, [None] * shards)
    middle = F.expr(f"cast(least({shards - 1}, ((2 * bytes_at + size) * {shards}) div (2 * {total})) as int)")
    found = rows.groupBy(middle.alias("shard")).agg(F.min("at").alias("at"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("shard").collect()
    starts, to = [n] * shards, -1
    for r in found:
        starts[to + 1 : r.shard + 1] = [r.at] * (r.shard - to)
        to = r.shard
    met = {b.low: (a.shard, b.shard) for a, b in zip(found, found[1:]) if a.high == b.low}
    copies = rows.where(F.col("key").isin(*met)).groupBy("key").agg(F.sum("size").alias("size"), F.min("bytes_at").alias("bytes_at"), F.min("at").alias("at"), F.max("at").alias("last")).collect() if met else []
    for c in copies:
        if c.size * shards <= slack * total:
            a, b = met[c.key]
            home = (2 * c.bytes_at + c.size) * shards // (2 * total)
            for j in range(a + 1, b + 1):
                starts[j] = c.last + 1 if j > home else c["at"]
    known = {r["at"]: (r.key, r.doc, r.row) for r in rows.where(F.col("at").isin(*starts)).select("at", "key", "doc", "row").collect()}
    return Cut(starts, [known.get(s) for s in starts])


def shard(docs: DataFrame, shards: int = SHARDS, scratch: Scratch | None = None, most: int = MOST, fan: int = FAN, slack: float = SLACK) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is bytes: shards are near equal in size, the UTF-8 bytes of the text plus 1. slot counts from 0 within the shard. Null
    texts are as empty ones, and size 1. Rows without a doc_id, and repeated rows, are placed like others; those equal in text and
    doc_id may be cut anywhere, and which of them gets which slot says nothing. A row larger than a shard fills one, and others may stay
    empty. Empty tables give no rows. Other columns, whatever their names, are not read. The sample decides only how the work is
    divided: the result is the same whatever was drawn.
    """
    rows = placed(docs, scratch or Scratch(docs.sparkSession, "shards"), most, fan)
    starts = cut(rows, shards, slack).starts
    own = F.lit(0)
    for s in starts[1:]:
        own = own + (F.col("at") >= s).cast("int")
    out = rows.withColumn("shard", own.cast("int"))
    begin = F.get(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("shard"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, files: int = 1, scratch: Scratch | None = None) -> None:
    """docs as Parquet in folder, a subfolder _shard=k for each shard, in about so many files each.

    Each row finds its shard by the keys at the shards' beginnings, so texts move once, to the task that writes them. Only rows equal in text
    and doc_id to one at a beginning are told apart by their places in docs. A column _shard of docs, in any case, is an error.
    """
    if "_shard" in {c.lower() for c in docs.columns}:
        raise ValueError("docs has a column _shard already")
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    begins = cut(placed(docs, scratch), shards)
    key, doc = _order(docs)
    own, row = F.struct(key.alias("key"), doc.alias("doc"), F.monotonically_increasing_id().alias("row")), F.lit(0)
    for found in begins.keys[1:]:
        if found is not None:
            row = row + (own >= F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(("key", "doc", "row"), found)))).cast("int")
    routed = docs.withColumn("_shard", row.cast("int"))
    routed.repartition(shards * files, "_shard", F.pmod(F.xxhash64(key, doc), F.lit(files))).write.partitionBy("_shard").parquet(folder)
    scratch.keep()


def oracle_sql(shards: int = SHARDS, slack: float = SLACK) -> str:
    """The same in DuckDB's SQL, with windows over all rows; CRC-32 byte by byte from a table made by its rule."""
    return rf"""
WITH polynomial AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, octet_length(encode(text))::BIGINT + 1 AS size, ('0x' || substr(md5(text), 1, 15))::BIGINT AS key,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, polynomial),
p AS (SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total, row_number() OVER o AS place FROM c WINDOW o AS (ORDER BY key, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, least({shards - 1}, ((2 * before + size) * {shards}) // (2 * total)) AS own FROM p),
g AS (SELECT *, min(own) OVER k < max(own) OVER k AND sum(size) OVER k * {shards} <= {slack} * total AS whole,
  least({shards - 1}, ((2 * min(before) OVER k + sum(size) OVER k) * {shards}) // (2 * total)) AS home FROM s WINDOW k AS (PARTITION BY key)),
f AS (SELECT doc_id, size, text_crc32, place, (CASE WHEN whole THEN home ELSE own END)::INTEGER AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard FROM f
"""
