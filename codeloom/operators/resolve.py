"""References to definitions: joins of ranked candidates; ancestries; module dependencies, cycles and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.functions import vocabulary as V
from codeloom.operators.lookup import first_by
from codeloom.plans import schema as S
from codeloom.plans.graph import CodeGraph
from codeloom.plans.scratch import Scratch


def first_by_name(g: CodeGraph, *kinds: str) -> DataFrame:
    """q, id, kind, returns of the first node of each qualified name: by file, line, id."""
    nodes = g.nodes.where("qualified_name is not null")
    nodes = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    best = nodes.groupBy(F.col("qualified_name").alias("q")).agg(F.min(F.struct(F.coalesce("file_path", F.lit("")).alias("f"), F.coalesce("start_line", F.lit(0)).alias("l"), "id", "kind", F.col("metadata.returns").alias("returns"))).alias("m"))
    return best.select("q", "m.id", "m.kind", "m.returns")


def methods(g: CodeGraph) -> DataFrame:
    """package, method, id, returns of the first function or method of each name."""
    return first_by_name(g, "function", "method").select(C.package_of(F.col("q")).alias("package"), C.short_name(F.col("q")).alias("method"), "id", "returns")


def with_package(g: CodeGraph, refs: DataFrame) -> DataFrame:
    """refs with package: that of the node they stand in; main without one."""
    at = g.nodes.select(F.col("id").alias("from_node_id"), F.when(F.col("kind").isin("package", "class"), F.coalesce("qualified_name", F.lit("main"))).otherwise(C.package_of(F.coalesce("qualified_name", "name", F.lit("main")))).alias("package"))
    return refs.join(at, "from_node_id", "left").withColumn("package", F.coalesce("package", F.lit("main")))


def receiver_class() -> Column:
    """The class a method call is made on, as far as it shows; a named invocant doesn't count."""
    recv = F.coalesce("candidates.receiver", F.lit(""))
    typed = F.when(F.length("candidates.receiver_type") > 0, F.col("candidates.receiver_type"))
    return F.coalesce(typed, F.when(recv.isin("$self", "$class"), F.col("package")), F.when(recv.rlike(r"^[\w:]+$"), recv))


def parents(g: CodeGraph) -> DataFrame:
    """class, pos, parent: what the first node of each class's name extends or implements, by the names given, in order."""
    first = first_by_name(g).select(F.col("q").alias("class"), F.col("id").alias("source"))
    named = g.edges.where("kind in ('extends', 'implements')").join(g.nodes.select(F.col("id").alias("target"), F.col("qualified_name").alias("t")), "target", "left")
    e = named.withColumn("parent", F.coalesce("metadata.name", "t")).where("parent is not null").join(first, "source")
    order = Window.partitionBy("class").orderBy(F.coalesce("edge_ord", F.lit(0)), "parent")
    return e.select("class", "parent", F.row_number().over(order).alias("pos"))


def linearized(g: CodeGraph, classes: DataFrame | None = None) -> DataFrame:
    """class, pos (from 0), ancestor: each class's ancestry, depth first, left to right, each ancestor once.

    An ancestor stands where its least path of places leads, which is where a depth-first walk meets it; each step keeps only
    that path, so cycles end. A class without a node is its own ancestry.
    """
    scratch = Scratch(g.spark, "ancestry")
    up = scratch.save(parents(g), "parents")
    if classes is None:
        classes = g.nodes.where("kind in ('package', 'class')").select(F.col("qualified_name").alias("class")).where("`class` is not null").distinct()
    best = scratch.save(classes.select("class", F.col("class").alias("ancestor"), F.array().cast("array<int>").alias("path")), "best-0")
    front, k = best, 0
    while True:
        met = front.join(up.withColumnRenamed("class", "of"), F.col("ancestor") == F.col("of")).select("class", F.col("parent").alias("ancestor"), F.concat("path", F.array("pos")).alias("path"))
        met = met.where("`class` <> ancestor").groupBy("class", "ancestor").agg(F.min("path").alias("path"))
        old = best.select("class", "ancestor", F.col("path").alias("had"))
        front = scratch.save(met.join(old, ["class", "ancestor"], "left").where("had is null or path < had").select("class", "ancestor", "path"), f"front-{k}")
        if front.isEmpty():
            break
        k += 1
        best = scratch.save(best.unionByName(front).groupBy("class", "ancestor").agg(F.min("path").alias("path")), f"best-{k}")
    order = Window.partitionBy("class").orderBy("path")
    return best.select("class", "ancestor", (F.row_number().over(order) - 1).alias("pos"))


def _method_in(refs: DataFrame, line: DataFrame, subs: DataFrame, start: str, method: str, keep: list[str]) -> DataFrame:
    """refs with the first sub named in column method along the ancestry of the class in column start: id, returns."""
    met = refs.join(line, F.col(start) == F.col("class")).join(subs, (F.col("ancestor") == F.col("package_")) & (F.col(method) == F.col("method_")))
    best = met.groupBy(*keep).agg(F.min(F.struct("pos", F.col("id").alias("i"), F.col("returns").alias("r"))).alias("m"))
    return best.select(*keep, F.col("m.i").alias("target"), F.col("m.r").alias("returns"))


def resolve_named_edges(g: CodeGraph) -> DataFrame:
    """edges whose inheritance and import targets are filled in by the names they give."""
    first = first_by_name(g).select(F.col("q").alias("_q"), F.col("id").alias("_t"))
    open_ = F.col("target").isNull() & F.col("kind").isin("extends", "imports", "overrides", "implements")
    name = F.when(open_, F.coalesce("metadata.name", "metadata.module"))
    return g.edges.withColumn("_n", name).join(first, F.col("_n") == F.col("_q"), "left").withColumn("target", F.coalesce("target", "_t")).select(*g.edges.columns)


def imports_index(g: CodeGraph) -> DataFrame:
    """package, name, module: which module a package imports a name from; the first edge counts."""
    at = g.nodes.select(F.col("id").alias("source"), F.when(F.col("kind") == "file", "main").otherwise(F.col("qualified_name")).alias("package"))
    e = g.edges.where("kind = 'imports' and metadata.module is not null").select("source", "edge_ord", "metadata.module", F.explode("metadata.symbols").alias("name")).join(at, "source").where("package is not null")
    return first_by(e, ["package", "name"], F.coalesce("edge_ord", F.lit(0)), "module").select("package", "name", "module")


def _calls(g: CodeGraph, refs: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """refs (with package) whose column name is a sub's: qualified, own package's, imported, or the only one of its name."""
    subs = first_by_name(g, "function", "method", "constant").select(F.col("q").alias("_q"), F.col("id").alias("_i"), F.col("returns").alias("_r"))
    imported = imports_index(g).select(F.col("package").alias("_p"), F.col("name").alias("_n"), F.col("module").alias("_m"))
    only = g.nodes.where("kind in ('function', 'method', 'constant')").groupBy(F.col("name").alias("_u")).agg(F.count("*").alias("k"), F.min(F.struct("id", F.col("metadata.returns").alias("returns"))).alias("_b")).where("k = 1")
    full = F.contains(F.col(name), F.lit("::"))
    met = refs.join(imported, (F.col("package") == F.col("_p")) & (F.col(name) == F.col("_n")), "left")
    ways = F.when(full, F.array(F.col(name))).otherwise(F.array(F.concat_ws("::", "package", name), F.when(F.col("_m").isNotNull(), F.concat_ws("::", "_m", name))))
    tried = met.select(*keep, F.posexplode(ways).alias("w", "way")).where("way is not null").join(subs, F.col("way") == F.col("_q"))
    found = tried.groupBy(*keep).agg(F.min(F.struct("w", "_i", "_r")).alias("m")).select(*keep, F.col("m._i").alias("target"), F.col("m._r").alias("returns"))
    rest = refs.where(~full).join(found.select(*keep), keep, "left_anti").join(only, F.col(name) == F.col("_u"))
    return found.unionByName(rest.select(*keep, F.col("_b.id").alias("target"), F.col("_b.returns").alias("returns")))


def resolve_refs(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """(resolved, left): refs with target and provenance, and those that stay open. Builtins, UNIVERSAL methods and known
    outside names that the project doesn't define are in neither. No ref's result bears on another's, so all resolve at once.
    """
    scratch = Scratch(g.spark, "resolve")
    refs = scratch.save(with_package(g, g.refs).withColumn("m", F.col("reference_kind") == "method_call"), "refs")
    keep = ["ref_ord"]
    call = refs.where("not m").where(~C.is_builtin(F.col("reference_name")))
    called = _calls(g, call, "reference_name", keep).select("ref_ord", "target", F.lit("static").alias("provenance"))

    subs = scratch.save(methods(g).select(F.col("package").alias("package_"), F.col("method").alias("method_"), "id", "returns"), "methods")
    meth = refs.where("m").select("ref_ord", "package", F.col("reference_name").alias("name"), "candidates")
    # What a value's class is found through: a chain's base, or the call that made it.
    is_super = F.col("name").rlike("^SUPER::.")
    chain = F.col("candidates.chain").isNotNull()
    recv = F.coalesce("candidates.receiver", F.lit(""))
    typed = F.length(F.coalesce("candidates.receiver_type", F.lit(""))) > 0
    made = F.length(F.coalesce("candidates.receiver_call", F.lit(""))) > 0
    way = (
        F.when(is_super, "super").when(chain & F.col("candidates.chain.base_func").isNotNull(), "chain_call").when(chain, "chain_method").when(typed, "typed").when(made, "made")
        .when(recv.isin("$self", "$class") | F.coalesce("candidates.invocant", F.lit(False)), "self").when(recv.rlike(r"^[\w:]+$"), "class")
    )
    meth = scratch.save(meth.withColumn("way", way), "ways")
    base = F.coalesce("candidates.chain.base_type", F.when(F.coalesce("candidates.chain.base_self", F.lit(False)), F.col("package")))
    via = meth.where("way in ('chain_call', 'made')").withColumn("f", F.when(F.col("way") == "made", F.col("candidates.receiver_call")).otherwise(F.col("candidates.chain.base_func")))
    by_call = _calls(g, via, "f", keep).select("ref_ord", F.col("returns").alias("start"))
    link = meth.where("way = 'chain_method'").select("ref_ord", base.alias("start"), F.col("candidates.chain.method").alias("step"))
    start = meth.where("way in ('typed', 'self', 'class', 'super')").select("ref_ord", F.when(F.col("way") == "typed", F.col("candidates.receiver_type")).when(F.col("way") == "class", recv).otherwise(F.col("package")).alias("start"))
    classes = start.select(F.col("start").alias("class")).unionByName(link.select(F.col("start").alias("class"))).unionByName(by_call.select(F.col("start").alias("class")))
    classes = classes.unionByName(g.nodes.select(F.col("metadata.returns").alias("class"))).where("`class` is not null").distinct()
    line = scratch.save(linearized(g, classes), "ancestry")
    by_link = _method_in(link, line, subs, "start", "step", keep).select("ref_ord", F.col("returns").alias("start"))
    every = start.unionByName(by_call).unionByName(by_link).where("start is not null").join(meth.select("ref_ord", "name", "way"), "ref_ord")
    every = every.withColumn("name", F.when(F.col("way") == "super", F.substring("name", 8, 10_000)).otherwise(F.col("name")))
    plain = _method_in(every.where("way <> 'super'"), line, subs, "start", "name", ["ref_ord", "way"])
    above = _method_in(every.where("way = 'super'"), line.where("pos > 0"), subs, "start", "name", ["ref_ord", "way"])
    provenance = F.when(F.col("way").isin("super", "self"), "heuristic").when(F.col("way") == "class", "static").otherwise("inferred")
    found = plain.unionByName(above).select("ref_ord", "target", provenance.alias("provenance"))
    helper = g.nodes.where("kind = 'method' and metadata.helper").groupBy("name").agg(F.min(F.struct(F.coalesce("file_path", F.lit("")), F.coalesce("start_line", F.lit(0)), "id"))["id"].alias("target"))
    helped = meth.join(found, "ref_ord", "left_anti").join(helper, "name").select("ref_ord", "target", F.lit("framework").alias("provenance"))
    done = scratch.save(called.unionByName(found).unionByName(helped), "done")

    known = g.nodes.select(F.col("name").alias("reference_name")).distinct().withColumn("own", F.lit(True))
    rest = refs.join(done.select("ref_ord"), "ref_ord", "left_anti").join(known, "reference_name", "left")
    name = F.col("reference_name")
    gone = F.when(F.col("m"), C.is_universal(name)).otherwise(C.is_builtin(name) | C.is_external(name) & (F.contains(name, F.lit("::")) | F.col("own").isNull()))
    return g.refs.join(done, "ref_ord"), g.refs.join(rest.where(~F.coalesce(gone, F.lit(False))).select("ref_ord"), "ref_ord", "left_semi")


def anchors(g: CodeGraph, refs: DataFrame) -> DataFrame:
    """Method calls among refs with caller (qualified name of where they stand) and receiver."""
    who = g.nodes.select(F.col("id").alias("from_node_id"), F.col("qualified_name").alias("caller"))
    return refs.where("reference_kind = 'method_call'").join(who, "from_node_id").where("caller is not null").withColumn("receiver", F.coalesce("candidates.receiver", F.lit("")))


def apply_learned(g: CodeGraph, refs: DataFrame) -> DataFrame:
    """Open refs that a learned resolution (caller, method, receiver) names the target of; provenance llm."""
    subs = first_by_name(g, "function", "method").select(F.col("q").alias("target_qname"), F.col("id").alias("target"))
    learned = g.resolutions.select(F.col("caller_qname").alias("caller"), F.col("method").alias("reference_name"), F.coalesce("receiver", F.lit("")).alias("receiver"), "target_qname").join(subs, "target_qname")
    met = anchors(g, refs).join(learned, ["caller", "reference_name", "receiver"]).dropDuplicates(["ref_ord"])
    return met.select(*refs.columns, "target", F.lit("llm").alias("provenance"))


def upsert_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind), as if edges and then more were put in one after another.

    An edge counts if its provenance outranks all that came before it; of those, the last gives provenance, and each gives the
    line, column and metadata fields that no later one has. Edges without a target stand each for themselves.
    """
    both = edges.withColumn("_new", F.lit(0)).unionByName(more.withColumn("_new", F.lit(1)))
    keyed, open_ = both.where("target is not null"), both.where("target is null").drop("_new")
    rank = C.provenance_rank(F.coalesce("provenance", F.lit("static")))
    came = Window.partitionBy("source", "target", "kind").orderBy("_new", F.coalesce("edge_ord", F.lit(0)), F.desc("_r"))
    counted = keyed.withColumn("_r", rank).withColumn("_b", F.max("_r").over(came.rowsBetween(Window.unboundedPreceding, -1))).where("_b is null or _r > _b")
    best = Window.partitionBy("source", "target", "kind").orderBy(F.desc("_r"))
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fields = edges.schema["metadata"].dataType.names
    filled = F.struct(*(F.first(F.col(f"metadata.{f}"), ignorenulls=True).over(whole).alias(f) for f in fields))
    out = counted.withColumn("_m", F.when(F.max(F.col("metadata").isNotNull()).over(whole), filled)).withColumn("_l", F.first("line", ignorenulls=True).over(whole)).withColumn("_c", F.first("col", ignorenulls=True).over(whole)).withColumn("_k", F.row_number().over(best)).where("_k = 1")
    out = out.select(*(F.col({"metadata": "_m", "line": "_l", "col": "_c"}.get(c, c)).alias(c) for c in edges.columns))
    return out.unionByName(open_.select(*edges.columns))


def resolve_all(g: CodeGraph) -> CodeGraph:
    """The graph with named edges filled in, refs resolved into edges, and learned resolutions applied to what is left."""
    scratch = Scratch(g.spark, "resolved")
    g = g.with_(edges=scratch.save(resolve_named_edges(g), "edges"))
    new, left = _as_edges(g, *resolve_refs(g))
    return g.with_(edges=scratch.save(upsert_edges(g.edges, new), "all"), refs=scratch.save(left, "left"))


def _as_edges(g: CodeGraph, done: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of resolved refs and of those in left that learned resolutions name the target of; the rest of left."""
    learned = apply_learned(g, left)
    left = left.join(learned.select("ref_ord"), "ref_ord", "left_anti")
    new = done.select(*g.refs.columns, "target", "provenance").unionByName(learned)
    null = F.lit(None).cast(g.edges.schema["metadata"].dataType)
    new = new.select(F.col("ref_ord").alias("edge_ord"), F.col("from_node_id").alias("source"), "target", F.when(F.col("reference_kind") == "references", "references").otherwise("calls").alias("kind"), "line", "col", "provenance", null.alias("metadata"))
    return new.select(*g.edges.columns), left


def _structure(g: CodeGraph, names: DataFrame) -> DataFrame:
    """What methods are found through: parents of the classes among names (a column q), and what the subs among them return."""
    up = parents(g).withColumnRenamed("class", "q").join(names, "q", "left_semi").select("q", "pos", F.col("parent").alias("leads"))
    own = g.with_(nodes=g.nodes.join(names.withColumnRenamed("q", "qualified_name"), "qualified_name", "left_semi").select(*g.nodes.columns))
    return up.unionByName(first_by_name(own, "function", "method", "constant").where("returns is not null").select("q", F.lit(0).alias("pos"), F.col("returns").alias("leads")))


def resolve_changed(old: CodeGraph, g: CodeGraph, lost: DataFrame, fresh: DataFrame, start: int) -> tuple[CodeGraph, DataFrame]:
    """What resolve_all gives, where g is old, all resolved, but for some files: the graph, and the ref_ord of each ref joined again.

    lost are old's nodes of these files, fresh their nodes now; refs and edges of the files have ordinals from start on. Of the other
    open refs, those are joined again that call by a name which a lost or fresh node has, that stand in a package whose
    imports such a node gives, and, where a class's parents or what a sub returns differ, method calls. Edges are merged by the keys that new ones have.
    """
    scratch = Scratch(g.spark, "resolved")
    open_ = F.coalesce(F.col("target").isNull() & F.col("kind").isin("extends", "imports", "overrides", "implements"), F.lit(False))
    named = scratch.save(resolve_named_edges(g.with_(edges=g.edges.where(open_))), "named")
    g = g.with_(edges=scratch.save(g.edges.where(~open_).unionByName(named), "edges"))

    both = lost.select("kind", "name", "qualified_name").unionByName(fresh.select("kind", "name", "qualified_name"))
    both = scratch.save(both.distinct(), "both")
    names = both.select(F.explode(F.array("name", C.short_name(F.col("qualified_name")))).alias("n")).where("n is not null").distinct()
    importing = lambda x, nodes: nodes.join(x.edges.where("kind = 'imports'").select(F.col("source").alias("id")), "id", "left_semi").select(F.when(F.col("kind") == "file", "main").otherwise(F.col("qualified_name")).alias("package"))
    packages = importing(old, lost).unionByName(importing(g, fresh)).where("package is not null").distinct()
    refs = with_package(g, g.refs)
    asked = F.array(*(F.col(c) for c in ("reference_name", "candidates.receiver_call", "candidates.chain.base_func", "candidates.chain.method")))
    asked = F.concat(asked, F.transform(asked, C.short_name))
    again = refs.select("ref_ord", F.explode(F.array_distinct(asked)).alias("n")).join(names, "n", "left_semi").select("ref_ord")
    again = again.unionByName(refs.join(packages, "package", "left_semi").select("ref_ord")).unionByName(g.refs.where(F.col("ref_ord") >= start).select("ref_ord"))
    of = both.select(F.col("qualified_name").alias("q")).where("q is not null").distinct()
    was, now = scratch.save(_structure(old, of), "was"), scratch.save(_structure(g, of), "now")
    if not (was.exceptAll(now).isEmpty() and now.exceptAll(was).isEmpty()):
        again = again.unionByName(g.refs.where("reference_kind = 'method_call'").select("ref_ord"))
    again = scratch.save(again.distinct(), "again")

    done, left = resolve_refs(g.with_(refs=scratch.save(g.refs.join(again, "ref_ord", "left_semi").select(*g.refs.columns), "refs")))
    left = left.select(*g.refs.columns).unionByName(g.refs.join(again, "ref_ord", "left_anti").select(*g.refs.columns))
    new, left = _as_edges(g, done, left)
    new = scratch.save(new, "new")
    key = ["source", "target", "kind"]
    keys = new.select(*key).unionByName(named.select(*key)).unionByName(g.edges.where(F.col("edge_ord") >= start).select(*key)).where("target is not null").distinct()
    keys = scratch.save(keys, "keys")
    met = upsert_edges(g.edges.join(keys, key, "left_semi").select(*g.edges.columns), new)
    edges = met.unionByName(g.edges.join(keys, key, "left_anti").select(*g.edges.columns))
    return g.with_(edges=scratch.save(edges, "all"), refs=scratch.save(left, "left")), again


def unresolved(g: CodeGraph, name: str | None = None, limit: int = 50) -> DataFrame:
    """Open calls by (caller, method, receiver) on variables, with the subs they may mean: n, first line, candidates."""
    refs = anchors(g, g.refs).where(F.col("receiver").startswith("$"))
    refs = refs.where(F.col("reference_name") == name) if name is not None else refs
    group = refs.groupBy("caller", F.col("reference_name").alias("method"), "receiver").agg(F.count("*").alias("n"), F.min(F.struct("ref_ord", "file_path", "line")).alias("m"))
    subs = g.nodes.where("kind in ('function', 'method') and qualified_name is not null").groupBy(F.col("name").alias("method")).agg(F.sort_array(F.collect_set("qualified_name")).alias("candidates"))
    met = group.join(subs, "method")
    return met.select("caller", "method", "receiver", "n", "m.file_path", "m.line", "candidates").orderBy(F.desc("n"), "caller", "method", "receiver").limit(limit)


def resolve_targets(g: CodeGraph, name: str | None = None, limit: int = 50) -> DataFrame:
    """Open receivers by (caller, receiver) with the classes that define every method called on them, by relational division."""
    refs = anchors(g, g.refs).where(F.col("receiver").startswith("$") & ~F.col("receiver").isin("$self", "$class"))
    each = refs.groupBy("caller", "receiver", F.col("reference_name").alias("method")).agg(F.count("*").alias("n"))
    whole = each.groupBy("caller", "receiver").agg(F.sum("n").alias("calls"), F.count("*").alias("k"), F.sort_array(F.collect_set("method")).alias("methods"))
    if name is not None:
        whole = whole.where(F.array_contains("methods", name))
    subs = g.nodes.where("kind in ('function', 'method')").select(F.col("name").alias("method"), C.package_of(C.shown_name()).alias("cls")).distinct()
    fit = each.join(subs, "method").groupBy("caller", "receiver", "cls").agg(F.count("*").alias("have"))
    met = whole.join(fit, ["caller", "receiver"]).where("have = k").groupBy("caller", "receiver", "calls", "methods").agg(F.sort_array(F.collect_set("cls")).alias("classes"))
    return met.orderBy(F.when(F.size("classes") == 1, 0).otherwise(1), F.desc("calls"), "caller", "receiver").limit(limit)


def resolve_given(g: CodeGraph, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of given resolutions.

    given: caller, receiver, and either method and target (a qualified name) or receiver_type (a class, for all methods called
    on the receiver). accepted has the schema of resolutions; rejected has what was asked and a reason.
    """
    refs = anchors(g, g.refs).select("caller", F.col("reference_name").alias("called"), F.col("receiver").alias("on")).distinct()
    asked = given.withColumn("receiver", F.coalesce("receiver", F.lit("")))
    met = asked.join(refs.withColumnRenamed("caller", "c"), (F.col("caller") == F.col("c")) & (F.col("receiver") == F.col("on")) & (F.col("method").isNull() | (F.col("method") == F.col("called"))), "left")
    line = linearized(g, asked.where("receiver_type is not null").select(F.col("receiver_type").alias("class")).distinct())
    subs = methods(g).select(F.col("package").alias("package_"), F.col("method").alias("method_"), "id", "returns")
    typed = _method_in(met.where("receiver_type is not null and called is not null"), line, subs, "receiver_type", "called", ["caller", "called", "receiver", "receiver_type"])
    names = g.nodes.select(F.col("id").alias("target"), F.col("qualified_name").alias("target_qname"))
    by_type = typed.join(names, "target").select("caller", "called", "receiver", "target_qname")
    plain = met.where("receiver_type is null and called is not null").join(first_by_name(g, "function", "method").select(F.col("q").alias("target_qname")), F.col("target") == F.col("target_qname")).select("caller", "called", "receiver", "target_qname")
    good = by_type.unionByName(plain).distinct()
    accepted = good.select(F.col("caller").alias("caller_qname"), F.col("called").alias("method"), "receiver", "target_qname", F.lit("llm").alias("provenance"))
    bad = met.join(good.select("caller", "called", "receiver").withColumn("ok", F.lit(True)), ["caller", "called", "receiver"], "left").where("ok is null")
    reason = F.when(F.col("called").isNull(), "no such unresolved call").when(F.col("receiver_type").isNotNull(), "no such method in the class").otherwise("no such target")
    return accepted, bad.select("caller", F.coalesce("called", "method").alias("method"), "receiver", "receiver_type", "target", reason.alias("reason")).distinct()


def learn(resolutions: DataFrame, accepted: DataFrame) -> DataFrame:
    """resolutions with accepted ones in the place of those of the same key."""
    key = ["caller_qname", "method", "receiver"]
    return resolutions.join(accepted.select(*key), key, "left_anti").unionByName(accepted.select(*resolutions.columns))


def merge_runtime(g: CodeGraph, found_nodes: DataFrame, found_edges: DataFrame) -> CodeGraph:
    """The graph with what introspection saw: nodes (kind, name, qualified_name, package, provenance) that no node of their name is
    there for, contained in their package, and edges by qualified names, merged by rank. A field clashes with fields only.
    """
    is_field = F.col("kind") == "field"
    have = g.nodes.where("qualified_name is not null").select("qualified_name", is_field.alias("f")).distinct()
    new = found_nodes.withColumn("f", is_field).join(have, ["qualified_name", "f"], "left_anti").drop("f").dropDuplicates(["kind", "qualified_name"])
    kinds = {f.name: f.dataType for f in g.nodes.schema.fields}
    meta = kinds["metadata"]
    metadata = F.struct(*((F.col("provenance") if n == "provenance" else F.lit(None)).cast(meta[n].dataType).alias(n) for n in meta.names))
    has = {"kind": F.col("kind"), "name": F.col("name"), "qualified_name": F.col("qualified_name"), "id": C.node_id(F.col("kind"), F.col("qualified_name"), F.col("name"), F.lit(None).cast("string")), "language": F.lit("perl"), "visibility": F.when(F.col("name").startswith("_"), "private").otherwise("public"), "metadata": metadata}
    nodes = g.nodes.unionByName(new.select(*(has.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items())))
    first = first_by_name(g.with_(nodes=nodes)).select("q", "id")
    inside = new.select(F.col("package").alias("a"), F.col("qualified_name").alias("b"), F.lit("contains").alias("kind"), "provenance", F.lit(None).cast("int").alias("line"))
    seen = found_edges.select(F.col("source_qname").alias("a"), F.col("target_qname").alias("b"), "kind", "provenance", F.col("line").cast("int").alias("line")).unionByName(inside)
    met = seen.join(first.withColumnsRenamed({"q": "a", "id": "source"}), "a").join(first.withColumnsRenamed({"q": "b", "id": "target"}), "b")
    kinds = {f.name: f.dataType for f in g.edges.schema.fields}
    more = met.select(*((F.col(n) if n in ("source", "target", "kind", "provenance", "line") else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))
    return g.with_(nodes=nodes, edges=upsert_edges(g.edges, more))


def deps(g: CodeGraph, module: str | None = None) -> DataFrame:
    """module, dep, kind: what each package or class imports, extends or implements; the first kind for each name, itself aside."""
    packages = g.nodes.where("kind in ('package', 'class')").select(F.col("id").alias("source"), C.shown_name().alias("module"))
    packages = packages.where(F.col("module") == module) if module else packages
    name = g.nodes.select(F.col("id").alias("target"), C.shown_name().alias("t"))
    e = g.edges.where("kind in ('imports', 'extends', 'implements')").join(packages, "source").join(name, "target", "left")
    e = e.withColumn("dep", F.coalesce("t", "metadata.name", "metadata.module")).where("dep is not null and dep <> module")
    best = e.groupBy("module", "dep").agg(F.min(F.struct(F.coalesce("edge_ord", F.lit(0)).alias("o"), "kind")).alias("m"))
    return best.select("module", "dep", F.col("m.kind").alias("kind")).orderBy("module", "dep")


def module_edges(g: CodeGraph, *kinds: str) -> DataFrame:
    """module, dep between packages of the project."""
    own = g.nodes.where("kind in ('package', 'class') and not coalesce(metadata.cpan, false)").select(C.shown_name().alias("dep")).distinct()
    name = g.nodes.select(F.col("id").alias("target"), C.shown_name().alias("t"))
    packages = g.nodes.where("kind in ('package', 'class') and not coalesce(metadata.cpan, false)").select(F.col("id").alias("source"), C.shown_name().alias("module"))
    e = g.edges.where(F.col("kind").isin(*kinds)).join(packages, "source").join(name, "target", "left").withColumn("dep", F.coalesce("t", "metadata.name", "metadata.module"))
    return e.where("dep <> module").join(own, "dep", "left_semi").select("module", "dep").distinct()
