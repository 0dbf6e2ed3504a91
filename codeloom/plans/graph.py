"""The graph and its one traversal kernel."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans import schema as S
from codeloom.plans.scratch import Scratch

CALLS = ("calls", "references")
_EMPTY = {"refs": S.REFS, "files": S.FILES, "embeddings": S.EMBEDDINGS, "resolutions": S.RESOLUTIONS}


Table = DataFrame | Callable[[], DataFrame]


class CodeGraph:
    """Tables of one snapshot; see codeloom.plans.schema. Missing tables are empty; a table may be given as what makes it.

    postings and pieces are indexes of the nodes (see codeloom.operators.textindex), None where there are none; with other nodes they go.

    stored says that the tables are read from files as they are, so that a traversal may read them at each level.
    """

    def __init__(self, nodes: Table, edges: Table, refs: Table | None = None, files: Table | None = None, embeddings: Table | None = None, resolutions: Table | None = None, spark: SparkSession | None = None, stored: bool = False, postings: DataFrame | None = None, pieces: DataFrame | None = None):
        self._tables = {"nodes": nodes, "edges": edges, "refs": refs, "files": files, "embeddings": embeddings, "resolutions": resolutions}
        self.postings, self.pieces = postings, pieces
        self._spark, self.stored = spark, stored
        self._walks: dict[str | tuple[str, ...], DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        found = self._tables[name]
        if found is None:
            found = self._tables[name] = self.spark.createDataFrame([], _EMPTY[name])
        elif not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    nodes = property(lambda self: self._table("nodes"))
    edges = property(lambda self: self._table("edges"))
    refs = property(lambda self: self._table("refs"))
    files = property(lambda self: self._table("files"))
    embeddings = property(lambda self: self._table("embeddings"))
    resolutions = property(lambda self: self._table("resolutions"))

    @property
    def spark(self) -> SparkSession:
        return self._spark or self.nodes.sparkSession

    def with_(self, **tables: Table) -> CodeGraph:
        indexes = {} if "nodes" in tables else {"postings": self.postings, "pieces": self.pieces}
        return CodeGraph(**{**self._tables, **indexes, **tables}, spark=self._spark)

    def links(self, *kinds: str) -> DataFrame:
        """Edges of these kinds that have both ends."""
        return self.edges.where(F.col("kind").isin(*kinds) & F.col("source").isNotNull() & F.col("target").isNotNull())

    def walks(self, *kinds: str) -> DataFrame:
        """links() for traversals. Where the edges are computed, not stored, they are written once for all traversals of this graph."""
        if self.stored:
            return self.links(*kinds)
        return self.written(kinds, lambda: self.links(*kinds).select("source", "target", "kind", "edge_ord"))

    def written(self, name, make: Callable[[], DataFrame]) -> DataFrame:
        """What make gives, written once for this graph."""
        if name not in self._walks:
            self._walks[name] = Scratch(self.spark, "walks").save(make(), "links")
        return self._walks[name]


#: Levels after which what was seen becomes one table again.
MERGED = 8
#: Rows up to which a join sends a side to all tasks by way of the driver.
FEW = 50_000


def side(df: DataFrame, n: int, unique: bool = True) -> DataFrame:
    """A right side of about n rows: sent to all tasks where these are few, else dealt by key, however small its files. So what the driver holds of a round doesn't grow.

    unique says that a key has one row or few, so that a task may hold its share in memory.
    """
    return F.broadcast(df) if n <= FEW else df.hint("shuffle_hash" if unique else "merge")


def expand(links: DataFrame, seeds: DataFrame, max_depth: int | None, direction: str = "out", seeds_seen: bool = True, keys: tuple[str, ...] = (), via: bool = False, until: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Breadth-first levels from seeds (id, and keys such as root): rows (keys, id, depth), seeds at depth 0. Without a max_depth, all there are.

    A step joins the frontier with the links (a stored table, see CodeGraph.walks; a frontier of few rows is broadcast), keeps one row
    per new (keys, id) and drops what earlier levels hold; each level is a written table, so that a plan never grows with the depth
    and a lost executor costs one level; every MERGED levels, what was seen becomes one table. With seeds_seen False a
    seed may be found again, at its distance along a cycle, and then has that row too. With via, rows also carry the row that
    found them: parent and the link's kind; of several, the least edge_ord and then the least parent counts. direction is out, in or both.
    until is asked of each level after the seeds', and ends the walk with the first level that it holds for.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "expand")
    hop = links.select(F.col("source").alias("_a"), F.col("target").alias("_b"), F.col("kind").alias("_k"), F.coalesce(F.col("edge_ord"), F.lit(0)).alias("_o"))
    back = hop.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_k", "_o")
    hop = {"out": hop, "in": back, "both": hop.unionByName(back)}[direction]
    hop = hop if via else hop.select("_a", "_b")
    by = [*keys, "id"]
    extra = [F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("via")] if via else []
    front = scratch.save(seeds.select(*by).distinct().select(*by, F.lit(0).alias("depth"), *extra), "level-0")
    levels, seen, recent, depth = [front], None, [front.select(*by)] if seeds_seen else [], 0
    n = front.count()
    known = n if seeds_seen else 0
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        met = hop.join(side(front, n, not keys), F.col("_a") == F.col("id")).drop("id")
        if via:
            found = met.groupBy(*keys, F.col("_b").alias("id")).agg(F.min(F.struct("_o", F.col("_a").alias("p"), "_k")).alias("m"))
            found = found.select(*by, F.lit(depth).alias("depth"), F.col("m.p").alias("parent"), F.col("m._k").alias("via"))
        else:
            found = met.select(*keys, F.col("_b").alias("id")).distinct().select(*by, F.lit(depth).alias("depth"))
        earlier = reduce(DataFrame.unionByName, [*([seen] if seen is not None else []), *recent]) if recent or seen is not None else None
        front = scratch.save(found if earlier is None else found.join(side(earlier, known), by, "left_anti"), f"level-{depth}")
        n = front.count()
        if not n:
            break
        known += n
        levels.append(front)
        if until is not None and until(front):
            break
        recent.append(front.select(*by))
        if len(recent) == MERGED:
            seen = scratch.save(reduce(DataFrame.unionByName, [*([seen] if seen is not None else []), *recent]), f"seen-{depth}")
            if depth > MERGED:
                scratch.drop(f"seen-{depth - MERGED}")
            recent = []
    return reduce(DataFrame.unionByName, levels)


def expand_packed(links: DataFrame, seeds: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """What expand(keys=("root",)) finds for many roots along the links, 64 roots to a row: (id, depth, word, fresh) and the places of the roots, (root, word, bit).

    fresh has the bits of the roots that first meet id at that depth. A level is one table, of a row for each word and node met: who hears
    of new roots is united with what is known and grouped, so that a node that 25 roots meet is walked from as often as new ones come, not 25 times.
    """
    scratch = Scratch(links.sparkSession, "packed")
    at = scratch.save(seeds.select("root").distinct().coalesce(1).select("root", F.monotonically_increasing_id().alias("at")), "roots").selectExpr("root", "at div 64 as word", "cast(at % 64 as int) as bit")
    none = F.lit(0).cast("long")
    known = seeds.select("root", "id").join(at, "root").groupBy("word", "id").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    known = scratch.save(known.select("word", "id", "mask", F.col("mask").alias("fresh")), "level-0")
    levels, depth, n = [known], 0, known.count()
    while n and depth < max_depth:
        depth += 1
        front = known.where("fresh <> 0").select(F.col("id").alias("source"), "word", "fresh")
        told = links.select("source", "target").join(side(front, n, False), "source").select("word", F.col("target").alias("id"), F.col("fresh").alias("got"), none.alias("had"))
        met = told.unionByName(known.select("word", "id", none.alias("got"), F.col("mask").alias("had"))).groupBy("word", "id").agg(F.expr("bit_or(got)").alias("got"), F.expr("bit_or(had)").alias("had"))
        known = scratch.save(met.selectExpr("word", "id", "got | had as mask", "got & ~had as fresh"), f"level-{depth}")
        levels.append(known)
        n = known.where("fresh <> 0").count()
    rows = [level.where("fresh <> 0").select("id", F.lit(k).alias("depth"), "word", "fresh") for k, level in enumerate(levels)]
    return reduce(DataFrame.unionByName, rows), at


def unpacked(found: DataFrame, at: DataFrame) -> DataFrame:
    """Rows of expand_packed, with whatever was joined to them, a row for each root."""
    bits = found.withColumn("bit", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftright(fresh, b) & 1) = 1)")))
    return bits.join(at, ["word", "bit"]).drop("word", "bit", "fresh")
