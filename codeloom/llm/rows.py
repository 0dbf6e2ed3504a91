"""Taking rows out of a table of documents by what an operator decided about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def without(docs: DataFrame, decided: DataFrame, scratch: Scratch, text_key: Column | None = None) -> DataFrame:
    """The rows of docs that decided keeps, with the columns of docs.

    decided has a row (doc_id, text_key, kept) for each row of docs; text_key is equal for equal texts; its
    argument is the same of a row of docs, by default the SHA-256 of the normalised text. Only the dropped ids
    meet the table, so texts are not shuffled where Spark finds those few enough to broadcast. Rows that share their doc_id
    with others, or have none, are told apart by text_key, and among those that are equal in both as many stay as are kept.
    decided must be a written table.
    """
    shared = decided.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    shared = scratch.save(shared, "shared-ids")
    odd = not shared.isEmpty() or not decided.where("doc_id is null").isEmpty()
    key = F.col("doc_id").cast("long")
    if not odd:
        dropped = scratch.save(decided.where(~F.col("kept")).select(F.col("doc_id").alias("_cl_id")), "dropped-ids")
        return docs.join(dropped, key == F.col("_cl_id"), "left_anti")
    once = decided.join(shared, "doc_id", "left_anti").where("doc_id is not null")
    dropped = scratch.save(once.where(~F.col("kept")).select(F.col("doc_id").alias("_cl_id")), "dropped-ids")
    several = scratch.save(shared.select(F.col("doc_id").alias("_cl_id")), "several-ids")
    plain = docs.where(key.isNotNull()).join(several, key == F.col("_cl_id"), "left_anti").join(dropped, key == F.col("_cl_id"), "left_anti")
    rest = docs.where(key.isNotNull()).join(several, key == F.col("_cl_id"), "left_semi").unionByName(docs.where(key.isNull()))
    stay = (
        decided.join(shared.withColumn("_cl_s", F.lit(True)), "doc_id", "left").where("_cl_s or doc_id is null")
        .groupBy("doc_id", "text_key").agg(F.sum(F.col("kept").cast("long")).alias("_cl_n"))
        .where("_cl_n > 0").select(F.col("doc_id").alias("_cl_id"), F.col("text_key").alias("_cl_key"), "_cl_n")
    )
    own = rest.withColumn("_cl_key0", F.sha2(normalised(F.col("text")), 256) if text_key is None else text_key)
    met = own.join(scratch.save(stay, "stay"), key.eqNullSafe(F.col("_cl_id")) & F.col("_cl_key0").eqNullSafe(F.col("_cl_key")))
    order = Window.partitionBy(key, "_cl_key").orderBy("_cl_key0")
    some = met.withColumn("_cl_k", F.row_number().over(order)).where("_cl_k <= _cl_n")
    return plain.unionByName(some.select(*docs.columns))
