"""One object with every question, for code, the command line and the servers."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import components, diff, history, lookup, quality, refactor, resolve, semantic, traverse
from codeloom.plans import export
from codeloom.plans.graph import CodeGraph
from codeloom.sources import files, git
from codeloom.streaming.sync import Snapshots, sync

NODE = ("kind", "qualified_name", "file_path", "start_line", "end_line", "signature")


class Workbench:
    """A source tree and the graph of it, kept in a folder of snapshots."""

    def __init__(self, spark: SparkSession, store: str, root: str | None = None):
        self.spark, self.root = spark, root
        self.snapshots = Snapshots(spark, store)

    # Writing.

    def index(self, max_bytes: int | None = None, embed: bool = False, library: DataFrame | None = None) -> CodeGraph:
        g, sites = files.index(self.spark, self.root, max_bytes, resolved=library is None)
        if library is not None:
            from codeloom.plans.scratch import Scratch

            g = resolve.resolve_all(files.dependencies(g, library, Scratch(self.spark, "library")))
        if embed:
            g = g.with_(embeddings=semantic.embed(g.nodes))
        self.snapshots.write(g, sites)
        return self.graph

    def sync(self):
        g, sites = self.snapshots.read()
        new, sites, change = sync(g, files.read_sources(self.spark, self.root), sites)
        if change.added or change.changed or change.deleted:
            self.snapshots.write(new, sites)
        return change

    def learn(self, given: DataFrame) -> tuple[DataFrame, DataFrame]:
        g, sites = self.snapshots.read()
        good, bad = resolve.resolve_given(g, given)
        self.snapshots.write(resolve.resolve_all(g.with_(resolutions=resolve.learn(g.resolutions, good))), sites)
        return good, bad

    # Reading.

    @property
    def graph(self) -> CodeGraph:
        return self.snapshots.read()[0]

    @property
    def sites(self) -> DataFrame:
        return self.snapshots.read()[1]

    @property
    def sources(self) -> DataFrame:
        return files.texts(files.read_sources(self.spark, self.root))

    def commits(self, since: str | None = None) -> DataFrame:
        """Written once: questions read it several times over."""
        from codeloom.plans.scratch import Scratch

        return Scratch(self.spark, "commits").save(git.commits(self.spark, self.root, since), "commits")

    def changes(self, ref: str) -> DataFrame:
        """Differences of the tree from a ref: changed files as they were are parsed once more."""
        from codeloom.plans.scratch import Scratch

        names = self.spark.createDataFrame([(n,) for n in git.changed(self.root, ref)], "file string")
        was = files.extracted(git.versions(names, self.root, ref), Scratch(self.spark, "diff"))["nodes"]
        return diff.diff(was, self.graph.nodes, names)

    def view(self, symbol: str) -> dict[str, DataFrame]:
        """What there is to know of a symbol at a glance."""
        g = self.graph
        return {"definitions": lookup.defs(g, symbol).select(*NODE), "callers": traverse.callers(g, symbol).select(*NODE), "callees": traverse.callees(g, symbol).select(*NODE), "source": lookup.node_source(self.sources, lookup.defs(g, symbol))}

    def explain(self, symbol: str) -> dict[str, DataFrame]:
        g = self.graph
        return {**self.view(symbol), "impact": traverse.impact(g, symbol, 50).select("depth", *NODE), "tests": traverse.covers(g, symbol)}

    def explore(self, text: str, most: int = 8) -> DataFrame:
        """Source of the best matches of a text, whole files aside."""
        found = lookup.symbols_like(self.graph, text, most).where("kind <> 'file'")
        return found.select("id", *NODE).join(lookup.node_source(self.sources, found), "id", "left").drop("id")

    def context(self, question: str, focus: int = 2, budget: int = 16_000) -> DataFrame:
        """Source for a question: symbols it names, else the nearest by vectors, else by words, and what they call, within a budget of characters."""
        from pyspark.sql import Window

        g = self.graph
        words = [w for w in question.replace("?", " ").split() if "::" in w or "_" in w]
        seeds = g.nodes.where(F.col("qualified_name").isin(words) | F.col("name").isin(words)).where("kind <> 'file'").select("id").limit(focus)
        if seeds.isEmpty():
            seeds = semantic.semantic(g, question, 5).select("id").limit(focus)
        if seeds.isEmpty():
            seeds = lookup.search(g, question, 5).select("id").limit(focus)
        called = lookup.outgoing(g, seeds, "calls").where("target is not null").select(F.col("target").alias("id")).distinct()
        order = seeds.select("id", F.lit(0).alias("k")).unionByName(called.select("id", F.lit(1).alias("k"))).groupBy("id").agg(F.min("k").alias("k"))
        found = g.nodes.join(order, "id").join(lookup.node_source(self.sources, g.nodes.join(order.select("id"), "id", "left_semi")), "id")
        # At most the focus and its callees, so one window.
        spent = Window.orderBy("k", "qualified_name", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return found.withColumn("spent", F.sum(F.length("source")).over(spent)).where((F.col("spent") <= budget) | (F.col("spent") == F.length("source"))).orderBy("k", "qualified_name").select(*NODE, "source")


def _subgraph(w: Workbench, around: str | None = None, depth: int = 2, form: str = "mermaid") -> str:
    nodes, edges = traverse.subgraph(w.graph, around or None, int(depth))
    return {"mermaid": lambda: export.mermaid(edges), "dot": lambda: export.dot(edges), "json": lambda: export.to_json(nodes, edges), "html": lambda: export.page(edges)}[form]()


def _nodes(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in ("depth", "score", "provenance", *NODE) if c in df.columns))


def _lists(paths: str) -> list[str]:
    return [p for p in paths.split(",") if p]


#: Name to (arguments, question). Values are DataFrames, dicts of them, or text.
TOOLS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "search": (("text",), lambda w, text: _nodes(lookup.search(w.graph, text))),
    "symbols": (("text",), lambda w, text: _nodes(lookup.symbols_like(w.graph, text))),
    "node": (("symbol",), lambda w, symbol: w.view(symbol)),
    "explain": (("symbol",), lambda w, symbol: w.explain(symbol)),
    "context": (("question",), lambda w, question: w.context(question)),
    "explore": (("text",), lambda w, text: w.explore(text)),
    "callers": (("symbol",), lambda w, symbol: _nodes(traverse.callers(w.graph, symbol))),
    "callees": (("symbol",), lambda w, symbol: _nodes(traverse.callees(w.graph, symbol))),
    "impact": (("symbol",), lambda w, symbol, depth=5: _nodes(traverse.impact(w.graph, symbol, int(depth)))),
    "path": (("start", "end"), lambda w, start, end: traverse.path(w.graph, start, end)),
    "affected": (("paths",), lambda w, paths, tests=False: traverse.affected(w.graph, _lists(paths), bool(tests))),
    "covers": (("symbol",), lambda w, symbol: traverse.covers(w.graph, symbol)),
    "unused": ((), lambda w, everything=False: _nodes(quality.unused(w.graph, bool(everything)))),
    "untested": ((), lambda w, module=None: _nodes(quality.untested(w.graph, module))),
    "undocumented": ((), lambda w, module=None: _nodes(quality.undocumented(w.graph, module))),
    "api": (("module",), lambda w, module: _nodes(quality.api(w.graph, module))),
    "deps": ((), lambda w, module=None: resolve.deps(w.graph, module)),
    "cycles": ((), lambda w: _cycles(w)),
    "layers": ((), lambda w: _layers(w)),
    "checkcalls": ((), lambda w: quality.check_calls(w.graph)),
    "checkargs": ((), lambda w: quality.check_args(w.graph, w.sites)),
    "doccheck": ((), lambda w: quality.check_docs(w.graph, w.sources)),
    "prereqs": ((), lambda w: _prereqs(w)),
    "dead_exports": ((), lambda w: _nodes(quality.dead_exports(w.graph))),
    "duplication": ((), lambda w, min_nodes=30: quality.duplication(w.graph, int(min_nodes))),
    "smells": ((), lambda w: quality.smells(w.graph)),
    "hotspots": ((), lambda w, limit=15: quality.hotspots(w.graph, int(limit))),
    "metrics": ((), lambda w: quality.metrics(w.graph)),
    "overview": ((), lambda w: quality.overview(w.graph)),
    "tidy": ((), lambda w: quality.tidy(w.graph)),
    "scaffold": (("symbol",), lambda w, symbol: _scaffold(w, symbol)),
    "sinks": ((), lambda w: traverse.sinks(w.graph)),
    "taint": ((), lambda w: traverse.taint(w.graph)),
    "unresolved": ((), lambda w, name=None: resolve.unresolved(w.graph, name)),
    "resolve_targets": ((), lambda w, name=None: resolve.resolve_targets(w.graph, name)),
    "mro": (("module",), lambda w, module: resolve.linearized(w.graph, w.spark.createDataFrame([(module,)], "class string")).orderBy("pos")),
    "definition": (("file", "line"), lambda w, file, line: _nodes(lookup.definition_at(w.graph, file, int(line)))),
    "references": (("file", "line"), lambda w, file, line: lookup.references_at(w.graph, file, int(line))),
    "symbol_at": (("file", "line"), lambda w, file, line: _nodes(lookup.symbol_at(w.graph, file, int(line)))),
    "semantic": (("text",), lambda w, text: _nodes(semantic.semantic(w.graph, text))),
    "risk": ((), lambda w: history.risk(w.graph, history.churn(w.commits()))),
    "cochange": ((), lambda w: history.cochange(history.transactions(w.commits()), w.graph)),
    "owners": ((), lambda w: history.owners(w.graph, history.authorship(w.commits()))),
    "suggest_reviewers": (("ref",), lambda w, ref: history.suggest_reviewers(history.authorship(w.commits()), w.spark.createDataFrame([(p,) for p in git.changed(w.root, ref)], "file string"))),
    "diff": (("ref",), lambda w, ref: w.changes(ref)),
    "semver": (("ref",), lambda w, ref: diff.semver(w.changes(ref))),
    "changelog": (("ref",), lambda w, ref: diff.changelog(w.changes(ref))),
    "review": (("ref",), lambda w, ref: diff.review(w.graph, w.changes(ref))),
    "pr": (("ref",), lambda w, ref: diff.gate(w.graph, w.changes(ref), w.sites)),
    "graph": ((), _subgraph),
    "status": ((), lambda w: quality.kind_counts(w.graph)),
    "sync": ((), lambda w: w.sync().event([])),
    "index": ((), lambda w, embed=False: _counted(w.index(embed=bool(embed)))),
    "export": (("path",), lambda w, path, form="json": _exported(w, path, form)),
    "resolve": (("resolutions",), lambda w, resolutions: _learned(w, resolutions)),
    "rename": (("symbol", "name"), lambda w, symbol, name, apply=False: _edited(w, refactor.rename(w.graph, w.sources, symbol, name), apply)),
    "move": (("symbol", "package"), lambda w, symbol, package, apply=False: _edited(w, refactor.move(w.graph, w.sources, symbol, package), apply)),
    "inline": (("symbol",), lambda w, symbol, apply=False: _edited(w, refactor.inline(w.graph, w.sources, symbol), apply)),
    "dedupe": (("symbol",), lambda w, symbol, apply=False: _edited(w, refactor.dedupe(w.graph, w.sources, symbol), apply)),
    "rm": (("symbol",), lambda w, symbol, apply=False: _edited(w, refactor.remove(w.graph, w.sources, symbol), apply)),
    "change_signature": (("symbol", "order"), lambda w, symbol, order, apply=False: _edited(w, refactor.change_signature(w.graph, w.sources, symbol, _lists(order)), apply)),
    "extract": (("file", "lines", "name"), lambda w, file, lines, name, apply=False: _extracted(w, file, lines, name, apply)),
}


def _counted(g: CodeGraph) -> str:
    return f"{g.nodes.count()} nodes, {g.edges.count()} edges, {g.refs.count()} open references"


def _exported(w: Workbench, path: str, form: str) -> str:
    """All edges of the graph, by executors."""
    export.write(traverse.subgraph(w.graph)[1], path, form)
    return f"written to {path}"


def _learned(w: Workbench, resolutions: str) -> dict[str, DataFrame]:
    """resolutions: JSON list of objects with caller, receiver, and method and target, or receiver_type."""
    names = ("caller", "receiver", "method", "target", "receiver_type")
    rows = [tuple(r.get(n) for n in names) for r in json.loads(resolutions)]
    good, bad = w.learn(w.spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))
    return {"accepted": good, "rejected": bad}


def _written(w: Workbench, changed) -> list[str]:
    """Writes changed (path, text) into the tree, which must be a local one; returns the paths."""
    out = []
    for path, text in changed:
        place = os.path.normpath(os.path.join(w.root.removeprefix("file://"), path))
        if not place.startswith(os.path.normpath(w.root.removeprefix("file://")) + os.sep):
            raise ValueError(f"{path} is outside of the tree")
        with open(place, "w", encoding="utf-8", newline="") as file:
            file.write(text)
        out.append(path)
    return out


def _edited(w: Workbench, plan: refactor.Plan, apply) -> str | dict[str, DataFrame]:
    """A plan's tables; with apply its edits are made and the graph refreshed."""
    if plan.error:
        return f"refused: {plan.error}"
    if not apply:
        return {"edits": plan.edits, "frontier": plan.frontier}
    paths = _written(w, ((r.path, r.text) for r in refactor.apply(w.sources, plan.edits).toLocalIterator()))
    return f"changed {', '.join(sorted(paths)) or 'nothing'}; " + w.sync().event([])


def _extracted(w: Workbench, file: str, lines: str, name: str, apply) -> str:
    first, _, last = lines.partition("-")
    row = w.sources.where(F.col("path") == file).first()
    if row is None:
        return f"refused: no file {file}"
    new, why = refactor.extract_sub(row.text, int(first), int(last or first), name)
    if why:
        return f"refused: {why}"
    if not apply:
        return new
    _written(w, [(file, new)])
    return f"changed {file}; " + w.sync().event([])


def _prereqs(w: Workbench) -> str:
    """What the code uses and what its distribution says it needs."""
    names = "{META.json,MYMETA.json,cpanfile,Makefile.PL}"
    found = w.spark.read.option("wholetext", True).option("pathGlobFilter", names).text(w.root).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    declared, source = files.declared_prereqs({r.name: r.value for r in found.collect()})
    rows = quality.prereqs(w.graph, w.spark.createDataFrame([(m,) for m in declared], "module string"))
    return f"declared in {source or 'no file'}: {len(declared)}\n\n" + export.table(rows, "prereqs")


def _layers(w: Workbench) -> str:
    """A line a layer and one a violation, as the tables hold them; a page has room for the first thousand modules of a layer."""
    found, broken = components.layers(w.graph)
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("layer").orderBy("module"))).where("k <= 1000")
    rows = first.groupBy("layer").agg(F.array_sort(F.collect_list("module")).alias("m")).join(found.groupBy("layer").agg(F.count("*").alias("n")), "layer").orderBy("layer").collect()
    lines = [f"{r.layer}: {', '.join(r.m)}" + (f" and {r.n - len(r.m)} more" if r.n > len(r.m) else "") for r in rows]
    return "\n".join([*lines, *(f"violation: {r.module} -> {r.dep}" for r in broken.orderBy("module", "dep").limit(1_000).collect())]) or "No modules."


def _cycles(w: Workbench) -> str:
    """The ring of each cyclic component, the largest components first; a page has room for a hundred."""
    found = components.cycles(w.graph)
    rings = found.where("hop is not null").groupBy("component", "size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop", "module"))), lambda x: x["module"]), " -> ").alias("ring"))
    rows = rings.orderBy(F.desc("size"), "component").limit(101).collect()
    ring = lambda r: f"{r.ring} -> {r.component}" + (f" (of {r['size']} modules that lead to each other)" if r["size"] > r.ring.count(" -> ") + 1 else "")
    return "\n".join([*(ring(r) for r in rows[:100]), *(["and more"] if len(rows) > 100 else [])]) or "No cycles."


def _scaffold(w: Workbench, symbol: str) -> str:
    got = quality.scaffold(w.graph, symbol)
    if "error" in got:
        return got["error"]
    params = got["params"][1:] if got["is_method"] and got["params"] and got["params"][0] in ("$self", "$class") else got["params"]
    short = got["name"].split("::")[-1]
    call = f"$obj->{short}({', '.join(params)})" if got["is_method"] else f"{short}({', '.join(params)})"
    pod = [] if got["has_pod"] else [f"=head2 {call}", "", "TODO: what it does.", "", *([f"=over 4", "", *(line for p in params for line in (f"=item {p}", "", "TODO", "")), "=back", ""] if params else []), "=cut", ""]
    return "\n".join([*pod, "use Test2::V0;", "", f"subtest '{short}' => sub {{", f"    my $got = {call};", "    is $got, 'TODO', 'TODO';", "};", "", "done_testing;"]) + "\n"


def render(found, title: str) -> str:
    """Markdown of whatever a question gives."""
    if isinstance(found, DataFrame):
        return export.table(found, title)
    if isinstance(found, dict):
        return "\n".join(export.table(df, f"{title}: {name}") for name, df in found.items())
    return str(found)


def ask(w: Workbench, name: str, /, **arguments) -> str:
    needed, f = TOOLS[name]
    missing = [a for a in needed if a not in arguments]
    if missing:
        raise TypeError(f"{name} needs {', '.join(missing)}")
    return render(f(w, **arguments), name)


__all__ = ["C", "TOOLS", "Workbench", "ask", "render"]
