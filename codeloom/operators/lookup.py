"""Point and set lookups, position queries, search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import textindex
from codeloom.plans.graph import CALLS, CodeGraph
from codeloom.plans.scratch import Scratch

ORDER = ("file_path", "start_line", "id")


def named(name: str) -> Column:
    """The nodes a symbol stands for: a qualified name where it has '::', else a bare name."""
    return F.col("qualified_name") == name if "::" in name else F.col("name") == name


def defs(g: CodeGraph, symbol: str) -> DataFrame:
    return g.nodes.where(named(symbol))


def nodes_by_name(g: CodeGraph, name: str) -> DataFrame:
    return g.nodes.where(F.col("name") == name).orderBy(*ORDER)


def nodes_by_qualified_name(g: CodeGraph, name: str) -> DataFrame:
    return g.nodes.where(F.col("qualified_name") == name).orderBy(*ORDER)


def node(g: CodeGraph, id: str) -> DataFrame:
    return g.nodes.where(F.col("id") == id)


def nodes_in_file(g: CodeGraph, path: str) -> DataFrame:
    return g.nodes.where(F.col("file_path") == path)


def all_nodes(g: CodeGraph, *kinds: str) -> DataFrame:
    found = g.nodes.where(F.col("kind").isin(*kinds)) if kinds else g.nodes
    return found.orderBy(*ORDER)


def outgoing(g: CodeGraph, ids: DataFrame, *kinds: str) -> DataFrame:
    """Edges out of ids (a DataFrame with id); in bulk instead of a query a node."""
    found = g.edges.where(F.col("kind").isin(*kinds)) if kinds else g.edges
    return found.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")


def incoming(g: CodeGraph, ids: DataFrame, *kinds: str) -> DataFrame:
    found = g.edges.where(F.col("kind").isin(*kinds)) if kinds else g.edges
    return found.join(ids.select(F.col("id").alias("target")).distinct(), "target", "left_semi")


def edges_of_kind(g: CodeGraph, *kinds: str) -> DataFrame:
    return g.edges.where(F.col("kind").isin(*kinds))


def null_target_edges(g: CodeGraph, *kinds: str) -> DataFrame:
    return edges_of_kind(g, *kinds).where("target is null")


def node_names(g: CodeGraph, ids: DataFrame) -> DataFrame:
    """id to qualified name."""
    return g.nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id", "qualified_name")


def callables_by_name(g: CodeGraph, names: DataFrame) -> DataFrame:
    """Functions and methods of given bare names."""
    return g.nodes.where("kind in ('function', 'method')").join(names.select("name").distinct(), "name", "left_semi")


def unique_callables(g: CodeGraph) -> DataFrame:
    """name and id of callables whose bare name only one function, method or constant has."""
    one = g.nodes.where("kind in ('function', 'method', 'constant')").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return one.where("n = 1").select("name", "id")


def file_paths(g: CodeGraph) -> DataFrame:
    return g.files.select("path").distinct()


def node_file_paths(g: CodeGraph) -> DataFrame:
    return g.nodes.where("file_path is not null").select("file_path").distinct()


def module_files(g: CodeGraph) -> DataFrame:
    return node_file_paths(g).where(F.col("file_path").endswith(".pm"))


def unresolved_names(g: CodeGraph) -> DataFrame:
    return g.refs.select("reference_name").distinct()


def qualified_names(g: CodeGraph, *kinds: str) -> DataFrame:
    return g.nodes.where(F.col("kind").isin(*kinds) & F.col("qualified_name").isNotNull()).select("qualified_name").distinct()


def stale_files(g: CodeGraph, current: DataFrame) -> DataFrame:
    """Rows of current (path, hash, extraction_version) that the snapshot doesn't hold as they are."""
    return current.join(g.files.select("path", "hash", "extraction_version"), ["path", "hash", "extraction_version"], "left_anti")


def edges_at(g: CodeGraph, file: str, line: int) -> DataFrame:
    """Resolved calls and references made at a line, by column."""
    source = g.nodes.where(F.col("file_path") == file).select(F.col("id").alias("source"))
    return g.links(*CALLS).where(F.col("line") == line).join(source, "source", "left_semi").orderBy("col", "edge_ord")


def _covering(g: CodeGraph) -> DataFrame:
    return g.nodes.where("start_line is not null and kind <> 'file'")


def node_at_start(g: CodeGraph, file: str, line: int) -> DataFrame:
    """The definition that starts on a line; of several, the longest qualified name."""
    return _covering(g).where((F.col("file_path") == file) & (F.col("start_line") == line)).orderBy(F.desc(F.length(C.shown_name())), "id").limit(1)


#: Lines of a stretch of a file that one sweep goes through.
STRETCH = 4_096
_LEVELS = 20


def nodes_covering(g: CodeGraph, sites: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The innermost definition around each site (file, line), that of the latest start; an open end covers all.

    Files are cut in stretches of lines, and each is swept once, with the definitions that begin or end in it and a stack of those that are open:
    what has ended before a site can't cover a later one. Of the definitions that go right through a stretch only the innermost can matter;
    it is found by halving: a definition stands for the few aligned runs of stretches that make up its inside, each run keeps its innermost
    one, and a stretch asks the runs that it lies in. So a file's rows grow with its definitions and sites, never with their product.
    """
    wide = F.lit(stretch).cast("long")
    at = sites.select("file", F.col("line").cast("long").alias("line")).where("file is not null and line is not null").distinct().withColumn("piece", F.floor(F.col("line") / wide))
    at = Scratch(g.spark, "covering").save(at, "sites")
    last = (1 << _LEVELS) - 1
    own = _covering(g).where("file_path is not null and coalesce(end_line, start_line) >= start_line").select(
        F.col("file_path").alias("file"), F.col("start_line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end"), F.col("qualified_name").alias("q"), "id",
        F.least(F.lit(last), F.greatest(F.lit(0), F.floor(F.col("start_line") / wide))).alias("first"), F.least(F.lit(last), F.coalesce(F.floor(F.col("end_line") / wide), F.lit(last))).alias("last"),
    )
    edges = own.select("*", F.explode(F.array_distinct(F.array("first", "last"))).alias("piece")).select("file", "piece", "line", "end", "q", "id")
    # Runs (level, k) stand for the stretches from k << level on, 1 << level of them.
    def halved(x, level):
        low, high, runs = x["low"], x["high"], x["runs"]
        here = lambda k, when: F.when(when, F.array(F.struct(level.alias("level"), k.alias("k")))).otherwise(F.array().cast("array<struct<level:int,k:bigint>>"))
        some = F.concat(runs, here(low, (low <= high) & (low % 2 == 1)), here(high, (low <= high) & (high % 2 == 0) & ~((low == high) & (low % 2 == 1))))
        return F.struct(F.floor((low + 1) / 2).cast("long").alias("low"), F.floor((high - 1) / 2).cast("long").alias("high"), some.alias("runs"))

    start = F.struct((F.col("first") + 1).cast("long").alias("low"), (F.col("last") - 1).cast("long").alias("high"), F.array().cast("array<struct<level:int,k:bigint>>").alias("runs"))
    runs = F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS)), start, halved)["runs"]
    through = own.where("last - first > 1").select("file", "line", "q", "id", F.explode(runs).alias("run"))
    best = through.groupBy("file", "run").agg(F.max(F.struct("line", "q", "id")).alias("m"))
    asked = at.select("file", "piece").distinct().select("file", "piece", F.explode(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), lambda l: F.struct(l.alias("level"), F.call_function("shiftright", F.col("piece").cast("long"), l).alias("k")))).alias("run"))
    carried = asked.join(best, ["file", "run"]).groupBy("file", "piece").agg(F.max("m").alias("m")).select("file", "piece", "m.line", F.lit(None).cast("long").alias("end"), "m.q", "m.id")
    nothing = F.lit(None).cast("string")
    rows = edges.unionByName(carried).withColumn("site", F.lit(False)).unionByName(at.select("file", "piece", "line", F.lit(None).cast("long").alias("end"), nothing.alias("q"), nothing.alias("id"), F.lit(True).alias("site")))
    swept = rows.repartition("file", "piece").sortWithinPartitions("file", "piece", "line", "site", "q", "id")
    out = swept.select("file", "piece", "line", "site", "end", "q", "id").mapInArrow(_sweep, "file string, line long, id string, qualified_name string, start_line long")
    return out.select("file", F.col("line").cast("int").alias("line"), "id", "qualified_name", F.col("start_line").cast("int").alias("start_line"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, piece, line, site, end, q, id) in order to the innermost definition that is open at each site; a stretch's stack is all that is held."""
    now, stack = None, []
    for batch in batches:
        out = []
        for file, piece, line, site, end, q, name in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, piece) != now:
                now, stack = (file, piece), []
            if not site:
                stack.append((end, line, q, name))
                continue
            while stack and stack[-1][0] is not None and stack[-1][0] < line:
                stack.pop()
            if stack:
                out.append((file, line, stack[-1][3], stack[-1][2], stack[-1][1]))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["file", "line", "id", "qualified_name", "start_line"])


def node_covering(g: CodeGraph, file: str, line: int) -> DataFrame:
    """The innermost definition around one site."""
    met = _covering(g).where((F.col("file_path") == file) & (F.col("start_line") <= line) & (F.coalesce(F.col("end_line"), F.lit(line)) >= line))
    best = met.orderBy(F.desc("start_line"), F.desc("qualified_name"), F.desc("id")).limit(1)
    return best.select(F.lit(file).alias("file"), F.lit(line).alias("line"), "id", "qualified_name", "start_line")


def definition_at(g: CodeGraph, file: str, line: int) -> DataFrame:
    """What the calls and references at a line resolve to."""
    return g.nodes.join(edges_at(g, file, line).select(F.col("target").alias("id")).distinct(), "id", "left_semi").orderBy(*ORDER)


def symbol_at(g: CodeGraph, file: str, line: int) -> DataFrame:
    """The definition starting at a line, else what is called there, else the one around it."""
    start = node_at_start(g, file, line).select("id", F.lit(0).alias("rank"), F.lit(0).alias("k"))
    called = edges_at(g, file, line).select(F.col("target").alias("id"), F.lit(1).alias("rank"), F.coalesce("col", F.lit(0)).alias("k"))
    around = node_covering(g, file, line).select("id", F.lit(2).alias("rank"), F.lit(0).alias("k"))
    best = start.unionByName(called).unionByName(around).orderBy("rank", "k", "id").limit(1)
    return g.nodes.join(best.select("id"), "id", "left_semi")


def references_at(g: CodeGraph, file: str, line: int) -> DataFrame:
    """Sites that call or reference the symbol at a line: file, line, col, caller."""
    target = symbol_at(g, file, line).select(F.col("id").alias("target"))
    sites = g.links(*CALLS).join(target, "target", "left_semi")
    who = g.nodes.select(F.col("id").alias("source"), F.col("file_path").alias("file"), C.shown_name().alias("caller"))
    return sites.join(who, "source").select("file", "line", "col", "caller").orderBy("file", "line", "col", "caller")


def symbols_like(g: CodeGraph, text: str, limit: int = 100) -> DataFrame:
    """Symbols whose name or qualified name holds a text, whatever its case; nothing in it is a wildcard. Shortest first.

    Where the graph has an index of pieces, the folders of the text's own pieces are read, and the names of what has all of them; only an
    empty text takes a scan.
    """
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    nodes = g.nodes.join(textindex.holding(g.pieces, text), "id", "left_semi") if g.pieces is not None and text else g.nodes
    found = nodes.where((F.col("kind") != "file") & (has("name") | has("qualified_name")))
    return found.orderBy(F.length(C.shown_name()), C.shown_name(), "id").limit(limit)


def search(g: CodeGraph, phrase: str, limit: int = 50) -> DataFrame:
    """Nodes with the phrase's tokens one after another in their name, qualified name or docstring; by the positional index where the graph has one."""
    if g.postings is not None:
        return _of_ids(g, textindex.having_phrase(g.postings, phrase).orderBy("id").limit(limit)).orderBy("id")
    hit = C.has_phrase(F.col("name"), phrase) | C.has_phrase(F.col("qualified_name"), phrase) | C.has_phrase(F.col("docstring"), phrase)
    return g.nodes.where((F.col("kind") != "file") & hit).orderBy("id").limit(limit)


def _of_ids(g: CodeGraph, found: DataFrame) -> DataFrame:
    """The nodes of a limited number of ids, which the scan gets as a filter."""
    return g.nodes.where(F.col("id").isin(*(r.id for r in found.select("id").collect())))


def node_source(sources: DataFrame, nodes: DataFrame, most: int = 150) -> DataFrame:
    """id and source: a node's own lines, cut after so many with '...'. sources has path and text."""
    met = nodes.where("start_line is not null").join(sources, nodes["file_path"] == sources["path"])
    n = F.coalesce(F.col("end_line"), F.col("start_line")) - F.col("start_line") + 1
    lines = F.slice(F.split("text", "\n"), F.col("start_line"), F.least(n, F.lit(most)))
    return met.select("id", F.concat(F.array_join(lines, "\n"), F.when(n > most, "\n...").otherwise("")).alias("source"))


def files_linked(g: CodeGraph) -> DataFrame:
    """Unordered pairs of files with a call, reference or inheritance between their nodes: a < b."""
    place = g.nodes.where("file_path is not null").select("id", "file_path")
    e = g.links("calls", "references", "imports", "extends", "implements").select("source", "target")
    met = e.join(place.withColumnsRenamed({"id": "source", "file_path": "x"}), "source").join(place.withColumnsRenamed({"id": "target", "file_path": "y"}), "target")
    return met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key, the first in an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
