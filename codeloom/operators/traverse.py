"""Traversals: callers, blast radius, paths, affected tests, sinks and taint."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.functions import vocabulary as V
from codeloom.operators.lookup import defs
from codeloom.plans.graph import CALLS, CodeGraph, expand, expand_packed, unpacked
from codeloom.plans.scratch import Scratch


def callees(g: CodeGraph, symbol: str) -> DataFrame:
    """What every definition of a symbol calls: a row an edge, with its provenance."""
    e = g.links("calls").join(defs(g, symbol).select(F.col("id").alias("source")), "source", "left_semi")
    return g.nodes.join(e.select(F.col("target").alias("id"), "provenance"), "id")


def callers(g: CodeGraph, symbol: str) -> DataFrame:
    e = g.links("calls").join(defs(g, symbol).select(F.col("id").alias("target")), "target", "left_semi")
    return g.nodes.join(e.select(F.col("source").alias("id"), "provenance"), "id")


def impact(g: CodeGraph, symbol: str, depth: int = 5) -> DataFrame:
    """All that calls or references a symbol within depth hops, with the hop. A symbol on a cycle is in its own impact.

    A dangling source is met but neither returned nor followed.
    """
    found = expand(known_walks(g), defs(g, symbol), depth, "in", seeds_seen=False).where("depth > 0")
    return g.nodes.join(found, "id")


def known_walks(g: CodeGraph) -> DataFrame:
    """Calls and references from nodes that are there, written once for all traversals of this graph."""
    return g.written("known", lambda: g.walks(*CALLS).join(g.nodes.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target", "kind", "edge_ord"))


def path(g: CodeGraph, start: str, end: str) -> DataFrame:
    """One shortest call path: hop, id, qualified_name, via (the kind of the edge into it). Empty where there is none.

    Parents are those of the least edge order, then id; of several ends the one with the smallest id is reached.
    """
    at = between(g.walks(*CALLS), defs(g, start), defs(g, end))
    spark = g.spark
    if at is None:
        return spark.createDataFrame([], "hop int, id string, qualified_name string, via string")
    rows = spark.createDataFrame(at, "hop int, id string, via string")
    return rows.join(g.nodes.select("id", C.shown_name().alias("qualified_name")), "id").select("hop", "id", "qualified_name", "via").orderBy("hop")


def between(links: DataFrame, seeds: DataFrame, targets: DataFrame, most: int = 1_000) -> list[tuple[int, str, str | None]] | None:
    """The rows of one shortest path, at most as many as it has hops: the only thing collected. Raises where the search isn't over after most hops.

    Frontiers grow from both ends, the smaller one first, until they meet; each has half the hops. From where they meet, the path's
    second half is walked within the levels that the other side found: a vertex there has all its shortest paths there.
    """
    scratch = Scratch(links.sparkSession, "path")
    hop = links.select("source", "target", "kind", F.coalesce("edge_ord", F.lit(0)).alias("o"))
    none = F.lit(None).cast("string")
    ahead = [scratch.save(seeds.select("id").distinct().select("id", none.alias("parent"), none.alias("via")), "ahead-0")]
    back = [scratch.save(targets.select("id").distinct(), "back-0")]
    size = [ahead[0].count(), back[0].count()]

    def step(front: DataFrame, within: DataFrame | None = None) -> DataFrame:
        """What front leads to, each with the link that counts."""
        met = front.select("id").join(hop, F.col("id") == hop["source"])
        met = met if within is None else met.join(within.select(F.col("id").alias("target")), "target", "left_semi")
        return met.groupBy(F.col("target").alias("id")).agg(F.min(F.struct("o", F.col("source").alias("s"), "kind")).alias("m")).select("id", F.col("m.s").alias("parent"), F.col("m.kind").alias("via"))

    def fresh(found: DataFrame, levels: list[DataFrame]) -> DataFrame:
        return found.join(reduce(DataFrame.unionByName, [x.select("id") for x in levels]), "id", "left_anti")

    while ahead[-1].select("id").join(back[-1], "id", "left_semi").isEmpty():
        if not min(size):
            return None
        if len(ahead) + len(back) - 2 >= most:
            raise ValueError(f"no path of up to {most} hops, and more to search")
        if size[0] <= size[1]:
            ahead.append(scratch.save(fresh(step(ahead[-1]), ahead), f"ahead-{len(ahead)}"))
            size[0] = ahead[-1].count()
        else:
            less = back[-1].join(hop, F.col("id") == hop["target"]).select(F.col("source").alias("id")).distinct()
            back.append(scratch.save(fresh(less, back), f"back-{len(back)}"))
            size[1] = back[-1].count()
    ahead[-1] = ahead[-1].join(back[-1], "id", "left_semi")
    for level in back[-2::-1]:
        ahead.append(scratch.save(step(ahead[-1], level), f"ahead-{len(ahead)}"))
    found, out = ahead[-1].orderBy("id").first(), []
    for k in range(len(ahead) - 1, 0, -1):
        out.append((k, found.id, found.via))
        found = ahead[k - 1].where(F.col("id") == found.parent).first()
    return [(0, found.id, None), *out[::-1]]


def subgraph(g: CodeGraph, around: str | None = None, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (from, to, kind, provenance) of the call, reference and inheritance graph, of all or around a symbol."""
    kinds = ("calls", "references", "extends")
    if around is None:
        nodes = g.nodes.where("kind in ('function', 'method', 'package', 'class', 'route', 'constant')")
    else:
        nodes = g.nodes.join(expand(g.walks(*kinds), defs(g, around), depth, "both").select("id").distinct(), "id", "left_semi")
    name = lambda side, col: nodes.select(F.col("id").alias(side), C.shown_name().alias(col))
    edges = g.links(*kinds).join(name("source", "from"), "source").join(name("target", "to"), "target")
    return nodes, edges.select("source", "target", "from", "to", "kind", "provenance").orderBy("from", "to", "kind", "source", "target")


def _of_files(g: CodeGraph, files: list[str] | DataFrame) -> DataFrame:
    """The nodes of files, given by their paths or by the last parts of these: a join with all the last parts of each path."""
    asked = files if isinstance(files, DataFrame) else g.spark.createDataFrame([(f,) for f in files], "path string")
    asked = asked.select(F.regexp_replace("path", r"^\./", "").alias("asked")).unionByName(asked.select(F.col("path").alias("asked"))).distinct()
    parts = F.split("file_path", "/")
    lasts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    paths = g.nodes.where("file_path is not null").select("file_path").distinct().select("file_path", F.explode(lasts).alias("asked"))
    return g.nodes.join(paths.join(asked, "asked", "left_semi").select("file_path").distinct(), "file_path", "left_semi")


def affected(g: CodeGraph, files: list[str] | DataFrame, tests_only: bool = False, depth: int = 25) -> DataFrame:
    """Files that calls and references lead back to from changed ones (paths, or a table with path), those included. A changed path may be a path's last part."""
    own = _of_files(g, files)
    found = expand(g.walks(*CALLS), own, depth, "in").where("depth > 0")
    out = g.nodes.join(found.select("id").distinct(), "id", "left_semi").select("file_path").unionByName(own.select("file_path"))
    out = out.where("file_path is not null").distinct()
    return (out.where(F.col("file_path").endswith(".t")) if tests_only else out).orderBy("file_path")


def covers(g: CodeGraph, symbol: str, depth: int = 25) -> DataFrame:
    """Test files that reach a symbol."""
    found = expand(g.walks(*CALLS), defs(g, symbol), depth, "in").where("depth > 0")
    return g.nodes.join(found.select("id").distinct(), "id", "left_semi").where(F.col("file_path").endswith(".t")).select("file_path").distinct().orderBy("file_path")


def reached_by_tests(g: CodeGraph, depth: int = 50) -> DataFrame:
    """Ids that test files' nodes reach, theirs included."""
    return expand(g.walks(*CALLS), g.nodes.where(F.col("file_path").endswith(".t")), depth, "out").select("id").distinct()


def route_handlers(g: CodeGraph) -> DataFrame:
    """route, name and the handler of its first edge made by a route."""
    e = g.links("references").where("metadata.via = 'route'").join(g.nodes.where("kind = 'route'").select(F.col("id").alias("source"), F.col("name").alias("route_name")), "source")
    first = e.groupBy(F.col("source").alias("route"), "route_name").agg(F.min(F.struct(F.coalesce("edge_ord", F.lit(0)).alias("o"), F.col("target").alias("t"))).alias("m"))
    return first.select("route", "route_name", F.col("m.t").alias("handler"))


def sink_sites(g: CodeGraph) -> DataFrame:
    """source, sink, name, dynamic of what each sub calls that is dangerous; dynamic if any such call is."""
    e = g.edges.where("kind = 'sink' and source is not null")
    return e.groupBy("source", F.coalesce("metadata.sink", F.lit("?")).alias("sink"), F.coalesce("metadata.name", F.lit("?")).alias("name")).agg(F.bool_or(F.coalesce("metadata.dynamic", F.lit(False))).alias("dynamic"))


def leading(links: DataFrame, ends: DataFrame, depth: int, scratch: Scratch, name: str = "leading", until: Callable[[DataFrame], bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """The ids from which a walk of up to depth links leads to one of ends (id), with that depth, and the links between them, both written.

    Walks from many roots to few ends need no others: whatever lies on a path to an end leads there itself. until is expand's.
    """
    live = scratch.save(expand(links, ends.select("id"), depth, "in", until=until).select("id", "depth"), name)
    side = lambda name: live.select(F.col("id").alias(name))
    return live, scratch.save(links.join(side("target"), "target", "left_semi").join(side("source"), "source", "left_semi"), f"{name}-links")


def sinks(g: CodeGraph, depth: int = 40) -> DataFrame:
    """Sinks that each route's handler reaches, all routes in one traversal: route, sub, sink, name, dynamic, depth.

    Routes that meet a node share its row, see expand_packed; only what is met at sinks becomes a row for each route.
    """
    scratch = Scratch(g.spark, "sinks")
    sites = scratch.save(sink_sites(g).join(g.nodes.select(F.col("id").alias("source"), C.shown_name().alias("sub")), "source").withColumnRenamed("source", "id"), "sites")
    routes = route_handlers(g).select(F.col("route").alias("root"), F.col("handler").alias("id"))
    # Depth counts levels looked at: the handler's is the first.
    found, at = expand_packed(g.walks(*CALLS), routes, depth - 1)
    return unpacked(found.join(sites, "id"), at).select(F.col("root").alias("route"), "sub", "sink", "name", "dynamic", "depth")


def taint_sources(g: CodeGraph) -> DataFrame:
    """id, source_kind, detail: route handlers, then readers of request values, then readers of process input; the first that holds counts."""
    routes = route_handlers(g).select(F.col("handler").alias("id"), F.lit(0).alias("rank"), F.lit("endpoint").alias("source_kind"), F.coalesce("route_name", F.lit("route")).alias("detail"))
    request = g.refs.where(F.col("reference_name").isin(*V.REQUEST_ACCESSORS) & F.col("from_node_id").isNotNull()).select(F.col("from_node_id").alias("id"), F.lit(1).alias("rank"), F.lit("request").alias("source_kind"), F.col("reference_name").alias("detail"))
    outer = g.nodes.where("kind in ('function', 'method') and metadata.taint_source is not null").select("id", F.lit(2).alias("rank"), F.lit("external").alias("source_kind"), F.col("metadata.taint_source").alias("detail"))
    best = routes.unionByName(request).unionByName(outer).groupBy("id").agg(F.min(F.struct("rank", "detail", "source_kind")).alias("m"))
    return best.select("id", "m.source_kind", "m.detail")


def _flows(hops):
    """Whether taint goes along a path: the tainted parameter positions after each hop, and what the last sub's sinks take."""
    carried = lambda h: F.filter(h["out"], lambda t: t["callee"] == h["short"])
    place = lambda h: lambda t: F.coalesce(t["arg"], F.lit(0)) + F.when(F.coalesce(t["method"], F.lit(0)) != 0, F.when(h["native"], 0).otherwise(1)).otherwise(0)
    goes = lambda at, h: F.filter(carried(h), lambda t: F.when(F.coalesce(t["src"], F.lit(0)) != 0, h["first"]).otherwise(F.array_contains(at, F.coalesce(t["param"], F.lit(-1)))))
    return F.aggregate(hops, F.array().cast("array<int>"), lambda at, h: F.transform(goes(at, h), place(h)).cast("array<int>"))


def _paths(tree: DataFrame, sites: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """root, sink_id, sinks, ids: the path from its root to each sink in a written tree (root, id, depth, parent)."""
    ends = scratch.save(tree.join(sites, "id").select("root", F.col("id").alias("sink_id"), "sinks", "id", "parent", F.array("id").alias("ids"), "depth"), f"{name}-ends")
    longest = ends.agg(F.max("depth")).first()[0] or 0
    ends = ends.drop("depth")
    # Paths back to their roots, all at once, as many steps as the longest has hops.
    for k in range(longest):
        step = tree.select(F.col("root").alias("_r"), F.col("id").alias("_i"), F.col("parent").alias("_p"))
        ends = ends.join(step, (F.col("root") == F.col("_r")) & (F.col("parent") == F.col("_i")), "left")
        ends = ends.select("root", "sink_id", "sinks", "id", F.when(F.col("parent").isNotNull(), F.col("_p")).alias("parent"), F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), "ids")).otherwise(F.col("ids")).alias("ids"))
        if k % 8 == 7:
            ends = scratch.save(ends, f"{name}-ends-{k}")
    return scratch.save(ends.select("root", "sink_id", "sinks", "ids"), f"{name}-paths")


def taint(g: CodeGraph, limit: int = 50, depth: int = 40) -> DataFrame:
    """Paths from sources of outside values to dynamic sinks.

    source_kind, detail, src_sub, sink_sub, path, sinks, local, value_flow (inside one sub), param_flow (hop by hop through
    arguments), best first. Each (source, node) has one shortest path; sources go in one traversal, of nodes that lead to sinks only.

    Without a flow of values shorter paths are better, so what the limit leaves is found without a row for each source and sink: a walk
    back from the sinks ends with the level at which it has met limit sources, those that are sinks included, and no path with more hops than
    that can be among the best.
    Paths with param_flow come first at any length, and can only lead from subs that pass an outside value on to sinks that take a
    parameter: these are walked whole.
    """
    scratch = Scratch(g.spark, "taint")
    source = scratch.save(taint_sources(g), "sources")
    sites = scratch.save(sink_sites(g).where("dynamic").groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set(F.concat_ws(":", "sink", "name"))).alias("sinks")), "sites")
    local = source.join(sites, "id", "left_semi").join(g.nodes.select("id"), "id", "left_semi")
    hops, met = 0, local.count()

    def enough(level: DataFrame) -> bool:
        nonlocal hops, met
        hops, met = hops + 1, met + level.join(source.select("id"), "id", "left_semi").count()
        return met >= limit

    def walked(roots: DataFrame, sites: DataFrame, name: str, until: Callable[[DataFrame], bool] | None = None) -> DataFrame:
        live, links = leading(g.walks(*CALLS), sites, 0 if until and met >= limit else depth - 1, scratch, f"{name}-leading", until)
        most = hops if until and met >= limit else depth - 1
        tree = expand(links, roots.join(live, "id", "left_semi").select(F.col("id").alias("root"), "id"), most, "out", keys=("root",), via=True)
        return _paths(scratch.save(tree, f"{name}-tree"), sites, scratch, name)

    ends = walked(source, sites, "near", enough)
    passes = source.join(g.nodes.where(F.exists("metadata.taint_out", lambda t: F.coalesce(t["src"], F.lit(0)) != 0)).select("id"), "id", "left_semi")
    takes = sites.join(g.nodes.where(F.size("metadata.sink_params") > 0).select("id"), "id", "left_semi")
    if not passes.isEmpty() and not takes.isEmpty():
        far = walked(scratch.save(passes, "passes"), scratch.save(takes, "takes"), "far")
        ends = scratch.save(ends.unionByName(far.join(ends, ["root", "sink_id"], "left_anti")), "ends")
    facts = g.nodes.select("id", C.shown_name().alias("q"), (F.col("kind") == "method").alias("native"), F.coalesce("metadata.taint_out", F.array().cast("array<struct<callee:string,method:int,arg:int,param:int,src:int>>")).alias("out"), F.coalesce("metadata.sink_params", F.array().cast("array<int>")).alias("sink_params"), F.coalesce("metadata.taint_flow", F.lit(False)).alias("flow"))
    place = ends.select("root", "sink_id", F.posexplode("ids").alias("k", "id")).join(facts, "id", "left")
    order = Window.partitionBy("root", "sink_id").orderBy("k")
    ahead = place.withColumn("next", F.lead("q").over(order)).withColumn("next_native", F.lead("native").over(order))
    hop = F.struct("k", F.coalesce("q", F.lit("?")).alias("q"), F.coalesce("out", F.array().cast("array<struct<callee:string,method:int,arg:int,param:int,src:int>>")).alias("out"), F.element_at(F.split(F.coalesce("next", F.lit("")), "::"), -1).alias("short"), F.coalesce("next_native", F.lit(False)).alias("native"), (F.col("k") == 0).alias("first"))
    whole = ahead.groupBy("root", "sink_id").agg(F.sort_array(F.collect_list(hop)).alias("hops"), F.max(F.when(F.col("id") == F.col("sink_id"), F.col("sink_params"))).alias("sink_params"), F.bool_or(F.when(F.col("id") == F.col("sink_id"), F.col("flow"))).alias("flow"))
    whole = whole.join(ends.select("root", "sink_id", "sinks"), ["root", "sink_id"]).join(source.withColumnRenamed("id", "root"), "root")
    n = F.size("hops")
    local = F.col("root") == F.col("sink_id")
    reached = _flows(F.slice(F.col("hops"), F.lit(1), n - 1))
    out = whole.select(
        "source_kind", "detail", F.element_at(F.transform("hops", lambda h: h["q"]), 1).alias("src_sub"), F.element_at(F.transform("hops", lambda h: h["q"]), -1).alias("sink_sub"), F.transform("hops", lambda h: h["q"]).alias("path"), "sinks",
        local.alias("local"), (local & F.col("flow")).alias("value_flow"), (~local & F.arrays_overlap(reached, F.coalesce("sink_params", F.array().cast("array<int>")))).alias("param_flow"),
    )
    return out.orderBy(F.desc("value_flow"), F.desc("param_flow"), F.desc("local"), F.size("path"), "src_sub", "sink_sub").limit(limit)
