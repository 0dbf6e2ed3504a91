"""Rankings, dead code, API surface, clones, smells and lint checks."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.functions import vocabulary as V
from codeloom.operators import components, reach, resolve, traverse
from codeloom.plans.graph import CALLS, CodeGraph, expand
from codeloom.plans.scratch import Scratch
from codeloom.sources.perl import pod

CALLABLE = ("function", "method", "constant")


def _own(g: CodeGraph) -> DataFrame:
    """Nodes that aren't an indexed dependency's."""
    return g.nodes.where(~F.coalesce("metadata.cpan", F.lit(False)))


def top_fan_in(g: CodeGraph, limit: int = 15) -> DataFrame:
    """id, n: edge rows into each target, calls and references."""
    return g.edges.where("kind in ('calls', 'references') and target is not null").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(limit)


def top_fan_out(g: CodeGraph, limit: int = 15) -> DataFrame:
    """id, n: edge rows out of each source; edges without a target count."""
    return g.edges.where("kind in ('calls', 'references')").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(limit)


def most_complex(g: CodeGraph, limit: int = 15) -> DataFrame:
    subs = g.nodes.where("kind in ('function', 'method') and metadata.complexity is not null")
    return subs.select("id", C.shown_name().alias("qualified_name"), F.col("metadata.complexity").alias("complexity")).orderBy(F.desc("complexity"), "qualified_name", "id").limit(limit)


def kind_counts(g: CodeGraph) -> DataFrame:
    return g.nodes.groupBy("kind").agg(F.count("*").alias("n"))


def provenance_counts(g: CodeGraph) -> DataFrame:
    return g.edges.groupBy("provenance").agg(F.count("*").alias("n"))


def most_subclassed(g: CodeGraph, limit: int = 12) -> DataFrame:
    return g.edges.where("kind = 'extends' and target is not null").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(limit)


def namespaces(g: CodeGraph, limit: int = 12) -> DataFrame:
    """ns, subs: subs by the first two parts of their packages' names."""
    parts = F.split("qualified_name", "::")
    subs = g.nodes.where("kind in ('function', 'method') and qualified_name is not null").where(F.size(parts) >= 2)
    ns = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "::")
    return subs.groupBy(ns.alias("ns")).agg(F.count("*").alias("subs")).orderBy(F.desc("subs"), "ns").limit(limit)


def _ranked(g: CodeGraph, top: DataFrame, limit: int) -> DataFrame:
    """The callables among a few ids with a number n, those with the largest."""
    name = g.nodes.where(F.col("kind").isin(*CALLABLE)).select("id", C.shown_name().alias("qualified_name"))
    return top.join(name, "id").orderBy(F.desc("n"), "id").limit(limit)


def hot_fan_in(g: CodeGraph, limit: int = 15, depth: int = 50, sketched: bool = False) -> DataFrame:
    """id, qualified_name, n, impact: the most depended-upon symbols with their blast radii.

    These are counted, all symbols in one traversal with a row for each symbol and what it meets, of links that lead to any of them; or,
    sketched, estimated at any depth with a row a node.
    """
    scratch = Scratch(g.spark, "hotspots")
    used = g.walks(*CALLS).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(3 * limit)
    top = scratch.save(_ranked(g, used, limit), "top")
    if sketched:
        radius = reach.reach_sizes(traverse.known_walks(g)).select("id", F.col("size").alias("impact"))
    else:
        # What leads there at all, dangling sources too; then only links from nodes that are there count.
        near = expand(g.walks(*CALLS), top.select("id"), depth - 1, "in").select(F.col("id").alias("target"))
        near = scratch.save(g.walks(*CALLS).join(near, "target", "left_semi"), "near")
        known = scratch.save(near.join(g.nodes.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target", "kind", "edge_ord"), "known")
        met = expand(known, top.select(F.col("id").alias("root"), "id"), depth, "in", seeds_seen=False, keys=("root",)).where("depth > 0")
        radius = met.groupBy(F.col("root").alias("id")).agg(F.count("*").alias("impact"))
    return top.join(radius, "id", "left").select("id", "qualified_name", "n", F.coalesce("impact", F.lit(0)).alias("impact")).orderBy(F.desc("n"), "id")


def hot_fan_out(g: CodeGraph, limit: int = 15) -> DataFrame:
    return _ranked(g, top_fan_out(g, 3 * limit), limit)


def hot_packages(g: CodeGraph, limit: int = 15) -> DataFrame:
    """module, deps: the packages that depend on most."""
    return resolve.deps(g).groupBy("module").agg(F.count("*").alias("deps")).orderBy(F.desc("deps"), "module").limit(limit)


def hotspots(g: CodeGraph, limit: int = 15, depth: int = 50, sketched: bool = False) -> dict[str, DataFrame]:
    """fan_in (with each symbol's blast radius), fan_out, packages (by their dependencies), complex; who asks for one of them calls its own function."""
    return {"fan_in": hot_fan_in(g, limit, depth, sketched), "fan_out": hot_fan_out(g, limit), "packages": hot_packages(g, limit), "complex": most_complex(g, limit)}


def unused(g: CodeGraph, everything: bool = False) -> DataFrame:
    """Functions that nothing calls, references or overrides, and whose name no unresolved reference holds.

    Lifecycle and builder names, exported functions and dependencies are spared; the first three not with everything. A call
    to itself counts as use. Methods are never judged.
    """
    used = g.edges.where("kind in ('calls', 'references', 'overrides') and target is not null").select(F.col("target").alias("id"))
    found = _own(g).where("kind = 'function'").where(~F.coalesce("name", F.lit("")).startswith("__"))
    if not everything:
        found = found.where(~F.coalesce("is_exported", F.lit(False))).where(~F.coalesce("name", F.lit("")).isin(*V.LIFECYCLE) & ~F.coalesce("name", F.lit("")).startswith("_build_"))
    return found.join(used, "id", "left_anti").join(g.refs.select(F.col("reference_name").alias("name")), "name", "left_anti").select(*g.nodes.columns)


def api(g: CodeGraph, module: str | None = None) -> DataFrame:
    """module and the public functions, methods and constants in it; of one module, or of all but dependencies'."""
    packages = g.nodes.where("kind in ('package', 'class')")
    packages = packages.where(C.shown_name() == module) if module else packages.where(~F.coalesce("metadata.cpan", F.lit(False)))
    inside = g.links("contains").join(packages.select(F.col("id").alias("source"), C.shown_name().alias("module")), "source").select("module", F.col("target").alias("id"))
    return g.nodes.where(F.col("kind").isin(*CALLABLE) & C.is_public()).join(inside, "id")


def _distinct_api(g: CodeGraph, module: str | None) -> DataFrame:
    return api(g, module).where(~F.coalesce("metadata.accessor", F.lit(False))).drop("module").dropDuplicates(["id"])


def undocumented(g: CodeGraph, module: str | None = None) -> DataFrame:
    return _distinct_api(g, module).where(~F.coalesce("docstring", F.lit("")).rlike(r"\S"))


def untested(g: CodeGraph, module: str | None = None, depth: int = 50) -> DataFrame:
    """Public API that no test file's code reaches."""
    return _distinct_api(g, module).join(traverse.reached_by_tests(g, depth), "id", "left_anti")


def dead_exports(g: CodeGraph) -> DataFrame:
    """Exported functions and methods that no other package calls or references."""
    package = g.nodes.select("id", C.package_of(C.shown_name()).alias("p"))
    out = g.nodes.where("kind in ('function', 'method') and is_exported and not coalesce(metadata.cpan, false)")
    e = g.links(*CALLS).join(package.withColumnsRenamed({"id": "source", "p": "a"}), "source").join(package.withColumnsRenamed({"id": "target", "p": "b"}), "target")
    return out.join(e.where("a <> b").select(F.col("target").alias("id")), "id", "left_anti").orderBy(C.shown_name(), "id")


def duplication(g: CodeGraph, min_nodes: int = 30, limit: int | None = 20) -> DataFrame:
    """dup, nodes, n, members: subs of one body shape; the largest by nodes times copies first. A clone group's members are listed whole."""
    size = F.split("metadata.dup", ":")[0].cast("int")
    subs = _own(g).where("kind in ('function', 'method') and metadata.dup is not null").where(size >= min_nodes)
    found = subs.groupBy(F.col("metadata.dup").alias("dup"), size.alias("nodes")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(C.shown_name())).alias("members")).where("n >= 2")
    found = found.orderBy(F.desc(F.col("nodes") * F.col("n")), F.desc("nodes"), F.element_at("members", 1), "dup")
    return found.limit(limit) if limit else found


def _subs(g: CodeGraph) -> DataFrame:
    """Subs outside of main and of dependencies, with their package."""
    return _own(g).where("kind in ('function', 'method')").withColumn("package", C.package_of(C.shown_name())).where("package <> 'main'")


def _cross(g: CodeGraph) -> DataFrame:
    """Calls between subs, with both packages: source, target, a, b."""
    at = _subs(g).select("id", "package")
    return g.links("calls").select("source", "target").join(at.withColumnsRenamed({"id": "source", "package": "a"}), "source").join(at.withColumnsRenamed({"id": "target", "package": "b"}), "target")


def feature_envy(g: CodeGraph, least: int = 4, limit: int = 20) -> DataFrame:
    """Subs that call one foreign class often and their own never: id, qualified_name, class, envied, foreign_calls."""
    e = _cross(g)
    per = e.groupBy(F.col("source").alias("id"), "a", "b").agg(F.count("*").alias("n"))
    own = per.where("a = b").select("id")
    best = per.where("a <> b").join(own, "id", "left_anti").groupBy("id", "a").agg(F.min(F.struct((-F.col("n")).alias("k"), "b")).alias("m"))
    found = best.select("id", F.col("a").alias("class"), F.col("m.b").alias("envied"), (-F.col("m.k")).alias("foreign_calls")).where(F.col("foreign_calls") >= least)
    return found.join(g.nodes.select("id", C.shown_name().alias("qualified_name")), "id").orderBy(F.desc("foreign_calls"), "qualified_name", "id").limit(limit)


def god_classes(g: CodeGraph, methods: int = 20, fan_in: int = 15, limit: int = 20) -> DataFrame:
    """Classes of many subs that many others call: class, methods, fan_in (distinct callers from elsewhere)."""
    n = _subs(g).groupBy(F.col("package").alias("class")).agg(F.count("*").alias("methods"))
    callers = _cross(g).where("a <> b").groupBy(F.col("b").alias("class")).agg(F.countDistinct("source").alias("fan_in"))
    found = n.join(callers, "class").where((F.col("methods") >= methods) & (F.col("fan_in") >= fan_in))
    return found.orderBy(F.desc("methods"), F.desc("fan_in"), "class").limit(limit)


def long_parameters(g: CodeGraph, least: int = 5, limit: int = 20) -> DataFrame:
    """Subs of many parameters, $self and $class aside: id, qualified_name, n, params."""
    params = C.signature_params(F.col("signature"))
    params = F.when(F.get(params, F.lit(0)).isin("$self", "$class"), F.slice(params, F.lit(2), F.greatest(F.size(params) - 1, F.lit(0)))).otherwise(params)
    found = _subs(g).where("signature is not null").select("id", C.shown_name().alias("qualified_name"), params.alias("params")).withColumn("n", F.size("params"))
    return found.where(F.col("n") >= least).orderBy(F.desc("n"), "qualified_name", "id").limit(limit)


def smells(g: CodeGraph, limit: int = 20) -> dict[str, DataFrame]:
    return {"feature_envy": feature_envy(g, limit=limit), "god_class": god_classes(g, limit=limit), "long_params": long_parameters(g, limit=limit)}


def check_calls(g: CodeGraph) -> DataFrame:
    """Method calls that no class can answer: the receiver's class is known, no role, its whole ancestry is indexed and has neither the method nor AUTOLOAD."""
    packages = g.nodes.where("kind in ('package', 'class')")
    inside = packages.where("not coalesce(metadata.cpan, false)").select(F.col("qualified_name").alias("ancestor")).distinct()
    roles = packages.where("metadata.role").select(F.col("qualified_name").alias("class")).distinct()
    name = F.col("reference_name")
    refs = resolve.with_package(g, g.refs.where("reference_kind = 'method_call'").where(~F.contains(name, F.lit("::")) & ~C.is_universal(name) & ~name.isin(*V.CHECKCALLS_SKIP)))
    refs = refs.withColumn("class", resolve.receiver_class()).where("`class` is not null").join(roles, "class", "left_anti")
    refs = Scratch(g.spark, "calls").save(refs.select("class", "reference_name", "from_node_id", "file_path", "line"), "refs")
    line = resolve.linearized(g, refs.select("class").distinct())
    closed = line.join(inside.withColumn("known", F.lit(True)), "ancestor", "left").groupBy("class").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("closed")).where("closed")
    has = line.join(resolve.methods(g), F.col("ancestor") == F.col("package")).select("class", "method")
    refs = refs.join(closed.select("class"), "class", "left_semi").join(has.where("method = 'AUTOLOAD'").select("class"), "class", "left_anti")
    refs = refs.join(has.select("class", F.col("method").alias("reference_name")), ["class", "reference_name"], "left_anti")
    who = g.nodes.select(F.col("id").alias("from_node_id"), C.shown_name().alias("caller"))
    out = refs.join(who, "from_node_id", "left").select("class", name.alias("method"), F.coalesce("caller", F.lit("?")).alias("caller"), F.col("file_path").alias("file"), "line")
    return out.groupBy("class", "method", "caller", F.coalesce("line", F.lit(0)).alias("line")).agg(F.min("file").alias("file")).orderBy("class", "method", "file", "line", "caller")


def check_args(g: CodeGraph, call_sites: DataFrame) -> DataFrame:
    """Calls whose number of arguments a callee's signature doesn't take: callee, signature, low, high, got, caller, file, line.

    call_sites (see codeloom.plans.schema) have argc null where it can't be told. A site counts inside its caller's lines, for
    callees that an edge of the caller proves; sites that two such callees share, and callees defined twice, are passed over.
    """
    subs = g.nodes.where("kind in ('function', 'method')").withColumn("q", C.shown_name())
    once = subs.groupBy("q").agg(F.count("*").alias("k")).where("k = 1").select("q")
    arity = subs.where("length(signature) > 0").join(once, "q", "left_semi").withColumn("fit", C.signature_arity(F.col("signature"))).where("fit.high is not null")
    callee = arity.select(F.col("id").alias("target"), F.col("q").alias("callee"), "signature", "fit", C.short_name(F.col("q")).alias("short"), C.package_of(F.col("q")).alias("package"))
    caller = g.nodes.where("file_path is not null").select(F.col("id").alias("source"), C.shown_name().alias("caller"), F.col("file_path").alias("file"), F.coalesce("start_line", F.lit(0)).alias("lo"), F.coalesce("end_line", F.lit(2_147_483_647)).alias("hi"))
    calls = g.links("calls").select("source", "target").distinct().join(callee, "target").join(caller, "source")
    site = call_sites.where("argc is not null").withColumn("site", F.monotonically_increasing_id()).select("site", F.col("file").alias("f"), F.col("line").alias("l"), F.col("name").alias("n"), "full", "is_method", "is_self", "argc")
    fits = F.when(F.col("is_method"), F.col("is_self") & (F.col("package") == C.package_of(F.col("caller")))).otherwise(~F.contains(F.coalesce("full", F.lit("")), F.lit("::")) | (F.col("full") == F.col("callee")))
    met = calls.join(site, (F.col("file") == F.col("f")) & (F.col("short") == F.col("n")) & F.col("l").between(F.col("lo"), F.col("hi"))).where(fits)
    alone = met.withColumn("k", F.count("*").over(Window.partitionBy("site", "source"))).where("k = 1")
    got = alone.withColumn("got", F.col("argc") + F.when(F.col("is_method"), 1).otherwise(0)).where("got < fit.low or got > fit.high")
    return got.groupBy("file", F.col("l").alias("line"), "callee").agg(F.min(F.struct("caller", "signature", "fit", "got")).alias("m")).select("callee", "m.signature", F.col("m.fit.low").alias("low"), F.col("m.fit.high").alias("high"), "m.got", "m.caller", "file", "line").orderBy("file", "line", "callee")


def pod_names(sources: DataFrame) -> DataFrame:
    """file, line, name of documented calls: headings and items that show name(...) or $object->name. A narrow stage."""
    def found(parts):
        for part in parts:
            rows = [(path, line, name) for path, text in zip(part["path"], part["text"]) for name, line in pod.documented_calls(text or "")]
            yield pd.DataFrame(rows, columns=["file", "line", "name"])

    return sources.select("path", "text").mapInPandas(found, "file string, line int, name string")


def check_docs(g: CodeGraph, sources: DataFrame) -> DataFrame:
    """Documented calls that no package of their file, nor its ancestors, defines: file, line, name."""
    at = g.nodes.where("kind in ('package', 'class') and file_path is not null").select(F.col("file_path").alias("file"), F.col("qualified_name").alias("class")).distinct()
    subs = g.nodes.where(F.col("kind").isin(*CALLABLE)).select(C.package_of(C.shown_name()).alias("ancestor"), C.short_name(C.shown_name()).alias("name")).distinct()
    known = at.join(resolve.linearized(g, at.select("class").distinct()), "class").join(subs, "ancestor").select("file", "name").distinct()
    found = pod_names(sources).where(~F.col("name").isin(*V.DOCCHECK_SKIP)).join(at.select("file").distinct(), "file", "left_semi")
    return found.join(known, ["file", "name"], "left_anti").select("name", "file", "line").orderBy("file", "line", "name")


def prereqs(g: CodeGraph, declared: DataFrame) -> DataFrame:
    """bucket (missing or unused) and module: what is used and not declared, declared and not used; core modules and own packages aside."""
    own = g.nodes.where("kind in ('package', 'class') and not coalesce(metadata.cpan, false)").select(F.col("qualified_name").alias("module")).distinct()
    e = g.edges.where("kind in ('imports', 'extends', 'implements')")
    used = e.select(F.coalesce("metadata.module", "metadata.name").alias("module")).where("module is not null").distinct().join(own, "module", "left_anti")
    core = F.col("module").isin(*V.CORE_MODULES, "perl")
    said = declared.select("module").distinct()
    missing = used.where(~core).join(said, "module", "left_anti").select(F.lit("missing").alias("bucket"), "module")
    spare = said.where(~core).join(used, "module", "left_anti").join(own, "module", "left_anti").select(F.lit("unused").alias("bucket"), "module")
    return missing.unionByName(spare).orderBy("bucket", "module")


def metrics(g: CodeGraph) -> DataFrame:
    """One row of headline numbers; denominators are at least 1. cycles counts the groups of modules that lead to each other."""
    if not g.stored:
        # Written once: nearly each number reads the edges.
        g = g.with_(edges=Scratch(g.spark, "metrics").save(g.edges, "edges"))
        g.stored = True
    rings = components.components(resolve.module_edges(g, "imports", "extends", "implements").select(F.col("module").alias("source"), F.col("dep").alias("target"))).select("component").distinct()
    one = F.lit(1)
    kinds = F.col("kind")
    n = g.nodes.agg(
        F.count("*").alias("nodes"), F.count(F.when(kinds.isin("package", "class"), one)).alias("packages"), F.count(F.when(kinds.isin("function", "method"), one)).alias("subs"),
        F.count(F.when(kinds.isin(*CALLABLE) & C.is_public(), one)).alias("public_api"), F.count(F.when(kinds.isin("function", "method") & (F.coalesce("metadata.complexity", F.lit(0)) >= 10), one)).alias("complex"),
        F.coalesce(F.max(F.when(kinds.isin("function", "method"), F.col("metadata.complexity"))), F.lit(0)).alias("max_complexity"),
    )
    e = g.edges.agg(F.count("*").alias("edges"), F.count(F.when(kinds.isin("calls", "references"), one)).alias("_rels"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n, e, count(g.files, "files"), count(g.refs, "unresolved"), count(unused(g), "unused"), count(untested(g), "untested"), count(undocumented(g), "undocumented"), count(duplication(g, limit=None), "clone_groups"), count(rings, "cycles")]
    row = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    share = lambda a, b: 100.0 * a / F.greatest(b, one)
    return row.select(
        "files", "packages", "subs", "public_api", "nodes", "edges", "unresolved", share(F.col("_rels"), F.col("_rels") + F.col("unresolved")).alias("resolved_pct"), "complex", "max_complexity", "cycles", "unused", "clone_groups",
        "untested", share(F.greatest("public_api", one) - F.col("untested"), F.col("public_api")).alias("tested_pct"), "undocumented", share(F.greatest("public_api", one) - F.col("undocumented"), F.col("public_api")).alias("documented_pct"),
    )


def overview(g: CodeGraph, limit: int = 12) -> dict[str, DataFrame]:
    """Tables to find one's way by: totals (one row), kinds, provenance, scripts, routes with their handlers, central, namespaces, inherited."""
    count = lambda df, n: df.agg(F.count("*").alias(n))
    totals = reduce(lambda a, b: a.crossJoin(b), [count(g.files, "files"), count(g.nodes, "nodes"), count(g.edges, "edges"), count(g.refs, "unresolved")])  # one row each
    handler = g.nodes.select(F.col("id").alias("handler"), C.shown_name().alias("handler_name"))
    routes = traverse.route_handlers(g).join(handler, "handler", "left").select("route", "route_name", "handler", "handler_name").orderBy("route_name", "route")
    name = g.nodes.select("id", C.shown_name().alias("qualified_name"), "kind")
    central = top_fan_in(g, 3 * limit).join(name.where(F.col("kind").isin(*CALLABLE)), "id").select("id", "qualified_name", F.col("n").alias("callers")).orderBy(F.desc("callers"), "id").limit(limit)
    scripts = g.nodes.where("kind = 'file'").where(F.col("file_path").rlike(r"\.(pl|psgi)$")).select("file_path").distinct().orderBy("file_path")
    inherited = most_subclassed(g, limit).join(name, "id").select("id", "qualified_name", F.col("n").alias("subclasses")).orderBy(F.desc("subclasses"), "id")
    return {"totals": totals, "kinds": kind_counts(g), "provenance": provenance_counts(g), "scripts": scripts, "routes": routes, "central": central, "namespaces": namespaces(g, limit), "inherited": inherited}


def tidy(g: CodeGraph) -> DataFrame:
    """What could go: bucket (unused, dead_export, clone), symbol, n."""
    row = lambda df, bucket, symbol, n: df.select(F.lit(bucket).alias("bucket"), symbol.alias("symbol"), n.cast("long").alias("n"))
    plain = unused(g).where("not coalesce(is_exported, false)")
    return row(plain, "unused", C.shown_name(), F.lit(1)).unionByName(row(dead_exports(g), "dead_export", C.shown_name(), F.lit(1))).unionByName(row(duplication(g, limit=None), "clone", F.array_join("members", ","), F.col("n")))


def scaffold(g: CodeGraph, symbol: str) -> dict:
    """What a test and documentation skeleton of one sub needs, or why there is none."""
    found = traverse.defs(g, symbol).where("kind in ('function', 'method')").select("id", "kind", C.shown_name().alias("q"), C.signature_params(F.col("signature")).alias("params"), F.coalesce("docstring", F.lit("")).alias("doc")).limit(2).collect()
    if len(found) != 1:
        return {"error": f"no function or method named '{symbol}'" if not found else f"'{symbol}' is ambiguous: qualify it"}
    r = found[0]
    return {"id": r.id, "name": r.q, "params": list(r.params), "is_method": r.kind == "method" or bool(r.params) and r.params[0] in ("$self", "$class"), "has_pod": bool(r.doc)}
