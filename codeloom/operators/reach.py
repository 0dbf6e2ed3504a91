"""How much leads to each vertex, for all vertices at once, by sketches that are merged along the links.

A vertex gets the union of what lies on all that lead to it. Vertices that lead to each other have one sketch between them, so it is the graph
of components, which has no cycle, along which sketches go: a component comes up once, in the round after the last that leads to it. The
sketches keep the smallest hashes of what they have seen (theta sketches): below 2**lg values they are exact, beyond that the standard error
is 2**(-lg/2).

A sketch of at most 8 * 2**lg bytes is kept only where a set is large and new. Other sets are the sketch of one component before them, by its
name, and a small one of what is more; so what many are told costs a name each, and what nothing follows keeps its number only. There is no
row for each pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.components import components, ends_of
from codeloom.plans.graph import side
from codeloom.plans.scratch import Scratch

LG = 12
#: Rows with a base, of which each takes as long as thousands without, that a task unites.
ROWS = 1_000


def reach_sizes(links: DataFrame, values: DataFrame | None = None, lg: int = LG) -> DataFrame:
    """id, size, exact for each vertex of links (source, target): how many distinct values lie on the vertices that lead to it by one link or more.

    values (id, value) may give a vertex several or none; without them a vertex's value is its id. A vertex on a cycle leads to itself. size
    is the number where exact says so, else an estimate. Links with a null end, and null values, count for nothing.
    """
    scratch = Scratch(links.sparkSession, "reach")
    # Repeated links count once in what is counted, so that they need not be dealt to be dropped here.
    plain = scratch.save(links.select("source", "target").where("source is not null and target is not null"), "links")
    ends = scratch.save(ends_of(plain), "ends")
    parts = components(plain, ends)
    n, v = parts.count(), ends.count()
    ids = scratch.save(ends.join(side(parts, n), "id", "left").select("id", F.coalesce("component", "id").alias("c"), (F.col("component").isNotNull() | F.col("loop")).alias("whole")), "ids")
    at = lambda end: side(parts.withColumnRenamed("id", end), n)
    up = plain.join(at("source"), "source", "left").select(F.coalesce("component", "source").alias("a"), "target")
    up = scratch.save(up.join(at("target"), "target", "left").select("a", F.coalesce("component", "target").alias("b")).where("a <> b").distinct(), "up")
    values = ids.select("c", F.col("id").alias("value")) if values is None else values.where("value is not null").join(side(ids, v), "id").select("c", "value")
    facts = ids.select("c", "whole")
    for more in (values, up.select(F.col("b").alias("c"), F.lit(1).alias("need")), up.select(F.col("a").alias("c"), F.lit(True).alias("inner"))):
        facts = facts.unionByName(more, allowMissingColumns=True)
    facts = facts.groupBy("c").agg(
        F.coalesce(F.sum("need"), F.lit(0)).alias("need"), F.coalesce(F.max("inner"), F.lit(False)).alias("inner"), F.coalesce(F.max("whole"), F.lit(False)).alias("whole"), F.theta_sketch_agg("value", lg).alias("own"),
    )
    # Once through a union, so that a sketch has its 2**lg smallest hashes, in whatever order they came.
    sizes = _sizes(up, facts.withColumn("own", F.theta_union("own", "own", lg)), lg, scratch)
    return ids.join(side(sizes, v), "c").select("id", "size").withColumn("exact", F.col("size") < (1 << lg))


def _sizes(up: DataFrame, facts: DataFrame, lg: int, scratch: Scratch) -> DataFrame:
    """c and size for each component of facts: c, need (how many lead to it in up), inner (it leads on), whole (its own values count), own (their sketch).

    A set is told as base and d: the sketch that the component base keeps, if there is one, and with it the sketch d of less than a sixteenth of
    2**lg values. What comes to a component by any number of links from one base is that base again, and more.
    """
    few = 24 + (8 << lg >> 4)
    text = F.lit(None).cast("string")
    none = F.lit(None).cast("binary")
    union = lambda a, b: F.coalesce(F.theta_union(a, b, lg), a, b)
    state, told, kept, k = facts.select("c", "need", F.lit(0).cast("long").alias("got"), F.array().cast("array<string>").alias("bases"), none.alias("d"), "inner", "whole", "own"), None, 0, 0
    while True:
        if told is not None:
            # What is waiting and what was told are united and grouped, not joined; what waits counts once, however many bases it has.
            first = lambda col: F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(col)).alias(col)
            waits = state.where("got < need").select("*", F.posexplode_outer("bases").alias("pos", "base")).select("c", "base", *map(first, ("need", "got", "d", "inner", "whole", "own")))
            state = waits.unionByName(told, allowMissingColumns=True).groupBy("c").agg(
                F.max("need").alias("need"), F.sum("got").alias("got"), F.array_sort(F.collect_set("base")).alias("bases"), F.theta_union_agg("d", lg).alias("d"), F.max("inner").alias("inner"), F.max("whole").alias("whole"), F.max("own").alias("own"),
            )
        state = scratch.save(state.withColumn("key", F.when(F.size("bases") > 0, F.sha2(F.to_json("bases"), 256))), f"state-{k}")
        if k:
            scratch.drop(f"state-{k - 1}")
        ready = state.where("got = need")
        sets = _sets(ready.where("key is not null"), lg, scratch, k) if kept else None
        met = ready.withColumns({"u": none, "base": text, "s": none, "rest": none}) if sets is None else _dealt(ready, sets)
        met = met.withColumn("small", union(F.col("d"), F.col("own"))).withColumn("set", union(F.col("u"), F.when(F.col("whole"), F.col("small")).otherwise(F.col("d"))))
        # What is more than the base is found from the small ones.
        more = union(F.col("rest"), F.coalesce(F.theta_difference("small", "s"), "small"))
        met = met.withColumn("size", F.coalesce(F.theta_sketch_estimate("set"), F.lit(0)).cast("long")).withColumn("more", F.when(F.col("inner"), more)).withColumn("new", F.length("more") > few)
        met = met.select("c", "inner", "size", F.when(F.col("new"), F.col("c")).otherwise(F.col("base")).alias("base"), F.when(~F.col("new"), F.col("more")).alias("d"), F.when(F.col("new"), union(F.col("s"), F.col("more"))).alias("sketch"))
        met = scratch.save(met, f"met/round={k}")
        n, new = met.where("inner").agg(F.count("*"), F.count("sketch")).first()
        kept += new
        if not n:
            break
        front = met.where("inner").select(F.col("c").alias("a"), "base", "d")
        told = up.join(side(front, n << max(lg - 8, 0), False), "a").select(F.col("b").alias("c"), "base", F.lit(1).cast("long").alias("got"), "d")
        k += 1
    return _met(scratch).select("c", "size")


def _met(scratch: Scratch) -> DataFrame:
    """What all rounds so far have found."""
    return scratch.spark.read.schema("c string, inner boolean, size long, base string, d binary, sketch binary, round int").parquet(f"{scratch.root}/met")


def _sets(wanted: DataFrame, lg: int, scratch: Scratch, k: int) -> DataFrame | None:
    """key, u, base, s and rest for each set of bases: the union of their sketches, the largest of them, and what it lacks; made once, however many have the same bases."""
    wanted = scratch.save(wanted.select("key", "bases").distinct().select("key", F.explode("bases").alias("c")), f"wanted-{k}")
    n = wanted.count()
    if not n:
        return None
    kept = _met(scratch).where("sketch is not null").select("c", "sketch")
    found = kept.join(side(wanted, n, False), "c").groupBy("key").agg(F.theta_union_agg("sketch", lg).alias("u"), F.max_by(F.struct("c", "sketch"), F.struct(F.theta_sketch_estimate("sketch"), "c")).alias("m"))
    found = found.select("key", "u", F.col("m.c").alias("base"), F.col("m.sketch").alias("s"))
    return scratch.save(found.withColumn("rest", F.theta_difference("u", "s")), f"sets-{k}")


def _dealt(ready: DataFrame, sets: DataFrame) -> DataFrame:
    """ready with its sets, in tasks of about ROWS rows, however many of them have one set."""
    tasks = ready.count() // ROWS + 1
    ways = tasks // sets.count() + 1
    ready = ready.withColumn("way", F.pmod(F.xxhash64("c"), F.when(F.col("key").isNull(), tasks).otherwise(ways).cast("long"))).repartition(tasks, "key", "way")
    sets = sets.withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long")))).repartition(tasks, "key", "way")
    return ready.join(sets.hint("merge"), ["key", "way"], "left")
