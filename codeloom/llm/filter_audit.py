"""What each of five filters takes out, in every order they could be applied, by a packed bitmap index.

Each partition packs its rows to bits, by part: one bitset a filter (set where a row fails it) and one for each label. For each set of
filters that may come first, and each filter that may come next, the rows that the next takes out are the ones of its bitset that are not
in the union of the first: an AND-NOT and a popcount, once more ANDed with a label's bitset. Partitions' counts are summed. Eighty counts a
part give all 120 orders.

Copies are found beforehand over the whole table, by SHA-256 of the text. Groups of copies are salted, so that no task gets a large one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

LETTERS = "ABCDE"
WORDS_LEAST = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 2
SYMBOLS = "#$%&*|"
#: Bits of a row's flags after those of the filters.
GOOD, TOXIC = 5, 6
#: Rows packed at once: seven bitsets of 128 KB.
ROWS = 1 << 20
#: Parts of which a task holds counts at once, of 2.5 KB each.
PARTS = 4_096
#: Tasks among which the copies of one text are dealt out, at least; beyond that Spark splits them as skewed.
SALTS = 16
COUNTS = ("removed", "redundant", "good_lost", "toxic_lost", "kept")
#: What is counted: (the filters that came first, the next one), as bits and a place in LETTERS.
STEPS = [(first, k) for first in range(32) for k in range(5) if not first >> k & 1]


def flags(text: Column) -> Column:
    """The bits of filters A to D, those of one text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    fails = (
        F.size(words) < WORDS_LEAST,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITALS_PERCENT * F.length(text),
        text.rlike("[" + SYMBOLS.replace("&", r"\&") + "]"),
    )
    bits = F.lit(0)
    for k, f in enumerate(fails):
        bits = bits + F.when(f, 1 << k).otherwise(0)
    return bits


def marked(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part and flags of each row of docs: bits of the five filters, then of the labels quality and toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), flags(text).alias("bits"))
    own = scratch.save(own.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "facts")
    copies = own.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    copies = copies.where("least < most").select("key", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = scratch.save(copies, "copies")
    found = own.join(copies, ["key", "salt"], "left").withColumn("bits", F.col("bits") + F.when(F.col("doc_id") > F.col("least"), 1 << 4).otherwise(0))
    told = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("labelled"))
    told = told.agg((F.max(F.when(F.col("quality") == 1, 1 << GOOD).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 1 << TOXIC).otherwise(0))).alias("told"))
    # Written, so that Spark can split the rows of a doc_id that very many share.
    told = scratch.save(told, "told")
    found = found.join(told, found.doc_id == told.labelled, "left")
    return found.select("part", (F.col("bits") + F.coalesce("told", F.lit(0))).cast("int").alias("flags"))


def bitsets(flags: np.ndarray) -> np.ndarray:
    """One packed bitset for each of the seven bits of flags."""
    return np.packbits((flags[None, :] >> np.arange(TOXIC + 1)[:, None]) & 1, axis=1)


def counted(flags: np.ndarray) -> np.ndarray:
    """COUNTS for each of STEPS over rows of one part."""
    held, n = bitsets(flags), len(flags)
    ones = lambda bits: int(np.bitwise_count(bits).sum())
    union = [np.zeros_like(held[0])]
    for first in range(1, 32):
        low = first & -first
        union.append(union[first ^ low] | held[low.bit_length() - 1])
    gone = [ones(u) for u in union]
    out = np.zeros((len(STEPS), len(COUNTS)), np.int64)
    for row, (first, k) in enumerate(STEPS):
        removed = held[k] & ~union[first]
        out[row] = ones(removed), ones(held[k] & union[first]), ones(removed & held[GOOD]), ones(removed & held[TOXIC]), n - gone[first | 1 << k]
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, flags) to a row for each part and step: what a partition's bitsets count."""
    totals: dict[str, np.ndarray] = {}
    held: list[tuple[list[str], np.ndarray, np.ndarray]] = []

    def pack():
        parts = sorted({p for names, _, _ in held for p in names})
        place = {p: k for k, p in enumerate(parts)}
        of = np.concatenate([np.array([place[p] for p in names])[codes] for names, codes, _ in held])
        bits = np.concatenate([b for _, _, b in held])
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(parts) + 1))
        for p, s, e in zip(parts, ends, ends[1:]):
            totals[p] = totals.get(p, 0) + counted(bits[order[s:e]])
        held.clear()

    def told():
        for p, c in totals.items():
            first, k = np.array(STEPS, np.int32).T
            columns = [pa.array([p] * len(STEPS)), pa.array(first), pa.array(k), *(pa.array(c[:, j]) for j in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "nth", *COUNTS])
        totals.clear()

    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        part = batch.column(0).dictionary_encode()
        held.append((part.dictionary.to_pylist(), part.indices.to_numpy(), batch.column(1).to_numpy().astype(np.uint8)))
        rows += len(batch)
        if rows >= ROWS:
            pack()
            rows = 0
            if len(totals) >= PARTS:
                yield from told()
    if held:
        pack()
    yield from told()


def counts(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """part, first (bits of the filters applied before), nth (the next one's place in LETTERS) and COUNTS: a row for each part and step."""
    rows = marked(docs, labels, scratch or Scratch(docs.sparkSession, "audit"))
    some = rows.mapInArrow(_index, "part string, first int, nth int, " + ", ".join(f"{c} long" for c in COUNTS))
    return some.groupBy("part", "first", "nth").agg(*(F.sum(c).alias(c) for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Parts are the sources of docs, null as ''; null texts are as empty ones. A row fails E if a smaller doc_id has its very text, whatever
    other filters say of that; rows without a doc_id, and repeated rows of the smallest, don't. A doc_id is labelled
    good or toxic if one of its rows in labels says so; rows without a doc_id have no labels. Tables without rows give none. Texts are read
    whole. Other columns, whatever their names, are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "audit")
    found = scratch.save(counts(docs, labels, scratch), "counts")
    scratch.keep("counts")
    spark = docs.sparkSession
    # In how many orders a set of filters comes first, before the next one.
    ways = F.element_at(F.array(*(F.lit(n) for n in (24, 6, 4, 6, 24))), F.bit_count("first") + 1)
    alone = F.max(F.when(F.col("first") == F.expr("31 - shiftleft(1, nth)"), F.col("removed")))
    whole = found.groupBy("part", "nth").agg(alone.alias("unique_fails"), F.sum(F.col("removed") * ways).alias("shapley"))
    steps = []
    for order in permutations(range(5)):
        first = 0
        for s, k in enumerate(order):
            steps.append(("".join(LETTERS[x] for x in order), s + 1, first, k))
            first |= 1 << k
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, first int, nth int"))
    # A part's eighty counts and five sums meet in the task that has the part and filter; 600 rows come of them.
    out = found.join(whole, ["part", "nth"]).join(orders, ["first", "nth"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def oracle_sql() -> str:
    """The same in DuckDB's SQL, counted over all rows for each part and step."""
    words = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, len({words}) AS n, len(list_distinct({words})) AS m FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (CASE WHEN n < {WORDS_LEAST} THEN 1 ELSE 0 END) + (CASE WHEN 100 * m < {DISTINCT_PERCENT} * n THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[{SYMBOLS}]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS bits
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, bits),
o(filter_order, first, k, step) AS (SELECT '', 0, NULL::INTEGER, 0 UNION ALL
  SELECT filter_order || substr('{LETTERS}', x::INTEGER + 1, 1), CASE WHEN step = 0 THEN 0 ELSE first | (1 << k) END, x::INTEGER, step + 1
  FROM o, range(5) AS r(x) WHERE step < 5 AND NOT contains(filter_order, substr('{LETTERS}', x::INTEGER + 1, 1))),
full_ AS (SELECT filter_order FROM o WHERE step = 5),
steps AS (SELECT full_.filter_order, o.step, o.first, o.k FROM full_ JOIN o ON o.step > 0 AND full_.filter_order[1:o.step] = o.filter_order),
kinds AS (SELECT DISTINCT first, k FROM steps),
s AS (SELECT part, first, k, sum(CASE WHEN bits & (first | (1 << k)) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN bits & (1 << k) > 0 AND bits & first = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN bits & (1 << k) > 0 AND bits & first > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN bits = (1 << k) THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN bits & (1 << k) > 0 AND bits & first = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bits & (1 << k) > 0 AND bits & first = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, kinds GROUP BY part, first, k),
j AS (SELECT s.*, filter_order, step FROM s JOIN steps USING (first, k)),
h AS (SELECT part, k, sum(removed) AS shapley FROM j GROUP BY part, k)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley FROM j JOIN h USING (part, k)
"""
