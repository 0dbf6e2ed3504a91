"""Exact dedup by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and get integer names; then
neighbouring names of each document are paired, the distinct pairs are sorted and named in turn, and so on, until each
document has one name. Two documents with equally many blocks have the same last name if and only if their texts are equal.

Only the first naming moves texts, once, after copies have met within each task. Documents learn their blocks' names by a
64-bit hash; a hash that two different blocks share is found out (its blocks have two names), and the documents that hold it
learn the names by the blocks themselves. No result depends on a hash being free of collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.rows import normalised, without
from codeloom.llm.scratch import Scratch

BLOCK_BYTES = 4_096


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names of distinct rows, sorted within each partition of the shuffle that made them distinct."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _blocks(n: Column, raw: Column, block_bytes: int, of) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: of(F.substring(raw, k * block_bytes + 1, F.lit(block_bytes))))


def name_documents(docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """A written table with a row for each row of docs: row_id, doc_id, text_key, n_blocks, name.

    doc_id is read as long and text as string; null texts count as empty and have one empty block. Repeated rows each have a
    row. (n_blocks, name) is the identity of the normalised text. hash_bits is for tests of the path for colliding hashes.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).cast("binary").alias("raw"))
    raw = raw.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block_bytes)).cast("int"))
    low = lambda b: F.shiftright(F.xxhash64(b), 64 - hash_bits)

    facts = raw.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.sha2("raw", 256).alias("text_key"), "n_blocks", _blocks(F.col("n_blocks"), F.col("raw"), block_bytes, low).alias("hashes"))
    facts = scratch.save(facts, "facts")

    block = raw.select(F.explode(_blocks(F.col("n_blocks"), F.col("raw"), block_bytes, lambda b: b)).alias("block"))
    distinct = block.select(low(F.col("block")).alias("h"), "block").groupBy("h", "block").agg(F.lit(1).alias("one"))
    names = scratch.save(_named(distinct, ["h", "block"]).select("h", "name"), "names-0")

    # Written, so that the join with the documents' blocks holds no aggregate and Spark can split a block that very many have.
    met = scratch.save(names.groupBy("h").agg(F.count("*").alias("k"), F.min("name").alias("name")), "met")
    held = facts.select("row_id", "n_blocks", F.posexplode("hashes").alias("pos", "h"))
    collided = scratch.save(met.where("k > 1").select("h"), "collided")
    if collided.isEmpty():
        now = held.join(met.select("h", "name"), "h").select("row_id", "n_blocks", "pos", "name")
    else:
        plain = held.join(met.where("k = 1").select("h", "name"), "h").select("row_id", "n_blocks", "pos", "name")
        # Blocks of colliding hashes once more, with their texts; their names are below zero.
        odd = raw.select("doc_id", F.sha2("raw", 256).alias("text_key"), F.posexplode(_blocks(F.col("n_blocks"), F.col("raw"), block_bytes, lambda b: b)).alias("pos", "block"))
        odd = odd.withColumn("h", low(F.col("block"))).join(collided, "h", "left_semi").distinct()
        odd = scratch.save(odd, "odd")
        own = scratch.save(_named(odd.groupBy("h", "block").agg(F.lit(1).alias("one")), ["h", "block"]).select("h", "block", (-1 - F.col("name")).alias("name")), "own")
        told = odd.join(own, ["h", "block"]).select(F.col("doc_id").alias("i"), F.col("text_key").alias("t"), F.col("pos").alias("p"), "name")
        rest = held.join(collided, "h", "left_semi").join(facts.select("row_id", "doc_id", "text_key"), "row_id")
        rest = rest.join(told, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("t")) & (F.col("pos") == F.col("p")))
        now = plain.unionByName(rest.select("row_id", "n_blocks", "pos", "name"))
    now = scratch.save(now, "level-0")
    scratch.drop("names-0")

    left = facts.agg(F.max("n_blocks")).first()[0] or 1
    level, done = 0, [now.where("n_blocks = 1")]
    width = 1
    while width < left:
        level, width = level + 1, width * 2
        # A document is named here while it has had more than one name on the level below.
        going = now.where(F.col("n_blocks") > width // 2)
        even = F.col("pos") % 2 == 0
        pairs = going.groupBy("row_id", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("l"), F.max(F.when(~even, F.col("name"))).alias("r")
        ).withColumn("r", F.coalesce("r", F.lit(-(1 << 63)).cast("long")))
        pairs = scratch.save(pairs, f"pairs-{level}")
        named = scratch.save(_named(pairs.groupBy("l", "r").agg(F.lit(1).alias("one")), ["l", "r"]).select("l", "r", "name"), f"names-{level}")
        now = scratch.save(pairs.join(named, ["l", "r"]).select("row_id", "n_blocks", "pos", "name"), f"level-{level}")
        scratch.drop(f"pairs-{level}", f"names-{level}")
        done.append(now.where(F.col("n_blocks") <= width))
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    found = facts.select("row_id", "doc_id", "text_key").join(last.select("row_id", "n_blocks", "name"), "row_id")
    found = scratch.save(found, "identities")
    scratch.drop("facts", "met", "collided", *(f"level-{k}" for k in range(level + 1)))
    return found


def dedup(docs: DataFrame, scratch: Scratch | None = None, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (and text_key, its other name).

    Of equal normalised texts one row stays: that with the smallest doc_id; rows without a doc_id come last; of rows that
    share the smallest doc_id, one. keep_id is null only where all rows of a group have no doc_id. Empty tables give no rows. Texts are
    compared whole, however long. Other columns of docs, whatever their names, are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    found = name_documents(docs, scratch, block_bytes, hash_bits)
    # Only groups of several rows are looked up; they are written, so that Spark can split the rows of a large one.
    group = found.groupBy("n_blocks", "name").agg(
        F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id"))["row_id"].alias("keep_row"),
    )
    group = scratch.save(group.where("group_size > 1"), "groups")
    met = found.join(group, ["n_blocks", "name"], "left")
    alone = F.col("group_size").isNull()
    return met.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row_id") == F.col("keep_row"))).alias("kept"), F.col("text_key").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    scratch = Scratch(docs.sparkSession, "exact")
    decided = scratch.save(dedup(docs, scratch).select("doc_id", F.col("text_sha256").alias("text_key"), "kept"), "decided")
    scratch.drop("identities", "groups")
    return without(docs, decided, scratch)
