"""Inverted indexes of texts: where each token stands, for phrases, and which pieces names hold, for substrings.

Both are tables dealt to folders by a hash of the token or piece, and sorted within; a question reads the folders of its own tokens or pieces, and
of these the rows whose token it is, by the files' own statistics. A token that very many texts hold is dealt over several files. Postings carry what
a question needs to be answered; pieces only tell which names may hold a text, so that a row is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.plans import schema as S

BUCKETS = 64
#: The characters of a piece of a name. One begins at each character: the last ones are filled up with END, so that a short question asks for beginnings.
PIECE = 3
END = "\0"
FIELDS = ("name", "qualified_name", "docstring")


def bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, fields: tuple[str, ...] = FIELDS, id: str = "id") -> DataFrame:
    """bucket, token, id, field, at: each token of each field of rows, and its place there. Null and empty texts have none."""
    parts = [rows.select(F.col(id).cast("string").alias("id"), F.lit(f).alias("field"), F.posexplode(C.tokens(F.col(f))).alias("at", "token")) for f in fields]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.select(bucket(F.col("token")).alias("bucket"), "token", "id", "field", "at")


def pieces(nodes: DataFrame) -> DataFrame:
    """bucket, piece, id: the PIECE characters from each character of a node's names on, in lower case, once a node."""
    def of(c: str) -> Column:
        text = F.lower(F.coalesce(F.col(c), F.lit("")))
        whole = F.concat(text, F.lit(END * (PIECE - 1)))
        return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.substring(whole, k, F.lit(PIECE)))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(of("name"), of("qualified_name")))
    found = nodes.where("kind <> 'file'").select("id", F.explode(every).alias("piece"))
    return found.select(bucket(F.col("piece")).alias("bucket"), "piece", "id")


def node_postings(nodes: DataFrame) -> DataFrame:
    return postings(nodes.where("kind <> 'file'"))


def write(index: DataFrame, path: str) -> None:
    """An index into a folder, a subfolder a bucket; a bucket of very many rows is dealt to several tasks by its size, without a look at the rows beforehand."""
    key = index.columns[1]
    index.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", key, "id").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    kind = S.PIECES if path.rstrip("/").endswith("pieces") else S.POSTINGS
    return spark.read.schema(kind).parquet(path)


def kept_up(index: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """An index without the rows of gone (id) and with those of fresh, an index of what is new."""
    return index.join(gone.select("id"), "id", "left_anti").select(*index.columns).unionByName(fresh.select(*index.columns))


def _asked(spark: SparkSession, keys: Column) -> list[tuple[str, int, int]]:
    """(key, its place, its bucket) of a few literal keys."""
    one = spark.range(1).select(F.posexplode(keys).alias("k", "key"))
    return [(r.key, r.k, r.b) for r in one.select("k", "key", bucket(F.col("key")).alias("b")).collect()]


def having_phrase(index: DataFrame, phrase: str) -> DataFrame:
    """id of what holds the tokens of a phrase one after another in one field: places less the token's own in the phrase that all agree."""
    spark = index.sparkSession
    asked = _asked(spark, C.tokens(F.lit(phrase)))
    if not asked:
        return index.select("id").limit(0)
    rows = index.where(F.col("bucket").isin(*{b for _, _, b in asked}) & F.col("token").isin(*{t for t, _, _ in asked}))
    places = F.broadcast(spark.createDataFrame([(t, k) for t, k, _ in asked], "token string, k int"))  # the phrase's tokens
    met = rows.join(places, "token").groupBy("id", "field", (F.col("at") - F.col("k")).alias("start")).agg(F.count("*").alias("n"))
    return met.where(F.col("n") == len(asked)).select("id").distinct()


def holding(index: DataFrame, text: str) -> DataFrame:
    """id of what may hold a text in a name, whatever its case: what has all its pieces. The names must be looked at once more."""
    low = text.lower()
    keys = sorted({low[k : k + PIECE] for k in range(max(1, len(low) - PIECE + 1))})
    if len(low) < PIECE:  # in all folders, of which the files' statistics leave a range each
        return index.where(F.startswith("piece", F.lit(low))).select("id").distinct()
    asked = _asked(index.sparkSession, F.array(*(F.lit(k) for k in keys)))
    rows = index.where(F.col("bucket").isin(*{b for _, _, b in asked}))
    # A node has a piece once.
    return rows.where(F.col("piece").isin(*keys)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(keys)).select("id")
