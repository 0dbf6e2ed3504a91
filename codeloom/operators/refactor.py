"""Edit plans: what a change of code would touch, worked out from the graph, and applied file by file.

A site is edited where the graph proves that it means the symbol; where it may, it is frontier: told of, never touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators.lookup import defs
from codeloom.plans.graph import CALLS, CodeGraph
from codeloom.plans.scratch import Scratch
from codeloom.sources.perl.extract import Extractor
from codeloom.sources.perl.lexer import lex

EDITS = "file string, `start` int, `end` int, new string, why string"
FRONTIER = "file string, line int, owner string, reason string"
PLACES = """file string, role string, owner string, name string, kind string, `start` int, `end` int, line int, receiver string, parens boolean, whole_start int, whole_end int,
    args array<array<int>>, texts array<string>, argc int, inner int, package string, `from` int, `to` int, sig array<int>, body array<int>, plain boolean, text string"""
_NAMES = [f.strip().split(" ")[0].strip("`") for f in re.split(r",(?![^<]*>)", PLACES)]


@dataclass
class Plan:
    """edits (file, start, end, new, why: code points of the text as it is), frontier (file, line, owner, reason), or an error."""

    edits: DataFrame
    frontier: DataFrame
    error: str | None = None


def _refused(g: CodeGraph, reason: str) -> Plan:
    return Plan(g.spark.createDataFrame([], EDITS), g.spark.createDataFrame([], FRONTIER), reason)


def _places(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for path, text in zip(part["path"], part["text"]):
            e = Extractor(path, text or "").run()
            cut = lambda a, b, text=text: text[a:b]
            out += [{"file": path, "role": "site", **w, "texts": [cut(a, b) for a, b in w["args"]], "text": cut(w["whole_start"], w["whole_end"])} for w in e.where]
            out += [{"file": path, "role": "def", "owner": d["id"], "line": 0, "parens": False, **{k: v for k, v in d.items() if k != "id"}, "text": cut(d["from"], d["to"])} for d in e.defs]
        yield pd.DataFrame([{n: r.get(n) for n in _NAMES} for r in out], columns=_NAMES).astype(object).where(lambda x: x.notna(), None)


def places(sources: DataFrame) -> DataFrame:
    """Where names stand in sources (path, text): a row for each site and each definition."""
    return sources.select("path", "text").mapInPandas(_places, PLACES)


def _one(g: CodeGraph, symbol: str):
    """(row, None) of the only sub of a name, or (None, why not)."""
    found = defs(g, symbol).where("kind in ('function', 'method')").select("id", "kind", "name", "qualified_name", "file_path", "signature", "is_exported", "metadata.dup").limit(2).collect()
    if len(found) != 1:
        return None, f"no sub named {symbol}" if not found else f"{symbol} is ambiguous: qualify it"
    return found[0], None


def _candidates(g: CodeGraph, sources: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """Sources that define, call or may call the symbols."""
    callers = g.links(*CALLS).where(F.col("target").isin(ids)).select(F.col("source").alias("id"))
    own = g.nodes.join(callers.unionByName(g.nodes.where(F.col("id").isin(ids)).select("id")).distinct(), "id", "left_semi").select(F.col("file_path").alias("path"))
    open_ = g.refs.where(F.element_at(F.split("reference_name", "::"), -1).isin(names)).select(F.col("file_path").alias("path"))
    return sources.join(own.unionByName(open_).distinct(), "path", "left_semi")


def _judged(g: CodeGraph, found: DataFrame, target: str, short: str) -> DataFrame:
    """Sites of a name with verdict: edit, frontier, or null for those that mean something else."""
    sites = found.where((F.col("role") == "site") & (F.element_at(F.split("name", "::"), -1) == short))
    to = g.links(*CALLS).join(g.nodes.where(F.col("name") == short).select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("owner"), F.when(F.col("target") == target, 1).otherwise(0).alias("own"))
    known = to.groupBy("owner").agg(F.sum("own").alias("mine"), F.sum(1 - F.col("own")).alias("others"))
    open_ = g.refs.where(F.element_at(F.split("reference_name", "::"), -1) == short).select(F.col("from_node_id").alias("owner"), F.lit(True).alias("open")).distinct()
    met = sites.join(known, "owner", "left").join(open_, "owner", "left")
    mine, others, may = F.coalesce("mine", F.lit(0)) > 0, F.coalesce("others", F.lit(0)) > 0, F.coalesce("open", F.lit(False))
    return met.withColumn("verdict", F.when(mine & ~others & ~may, "edit").when(mine | may, "frontier"))


def _plan(g: CodeGraph, edits: DataFrame, judged: DataFrame | None = None, reason: str = "not proven to mean it") -> Plan:
    frontier = g.spark.createDataFrame([], FRONTIER) if judged is None else judged.where("verdict = 'frontier'").select("file", "line", "owner", F.lit(reason).alias("reason")).distinct()
    return Plan(edits.select("file", "start", "end", "new", "why").distinct(), frontier)


def _found(g: CodeGraph, sources: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    return Scratch(g.spark, "refactor").save(places(_candidates(g, sources, ids, names)), "places")


def rename(g: CodeGraph, sources: DataFrame, symbol: str, new: str) -> Plan:
    """A sub's definition and proven sites under a new name in the same package."""
    if not re.fullmatch(r"[A-Za-z_]\w*", new):
        return _refused(g, f"{new} is no name")
    d, why = _one(g, symbol)
    if why:
        return _refused(g, why)
    package = d.qualified_name.rpartition("::")[0]
    if not g.nodes.where((F.col("qualified_name") == f"{package}::{new}") & (F.col("id") != d.id)).isEmpty():
        return _refused(g, f"{package}::{new} is there already")
    found = _found(g, sources, [d.id], [d.name])
    judged = _judged(g, found, d.id, d.name)
    at = F.struct((F.col("end") - F.lit(len(d.name))).cast("int").alias("start"), "end")
    sites = judged.where("verdict = 'edit'").select("file", at["start"].alias("start"), "end", F.lit(new).alias("new"), F.lit("site").alias("why"))
    own = found.where((F.col("role") == "def") & (F.col("owner") == d.id)).select("file", "start", "end", F.lit(new).alias("new"), F.lit("definition").alias("why"))
    return _plan(g, own.unionByName(sites), judged)


def _requalified(judged: DataFrame, full: str, why: str = "site") -> DataFrame:
    return judged.where("verdict = 'edit' and kind in ('call', 'references')").select("file", "start", "end", F.lit(full).alias("new"), F.lit(why).alias("why"))


def _deleted(found: DataFrame, ids: list[str], why: str = "definition") -> DataFrame:
    return found.where((F.col("role") == "def") & F.col("owner").isin(ids)).select("file", F.col("from").alias("start"), F.col("to").alias("end"), F.lit("").alias("new"), F.lit(why).alias("why"))


def move(g: CodeGraph, sources: DataFrame, symbol: str, package: str) -> Plan:
    """A function's text at the end of another package's subs, and its proven sites under the full new name. Method calls are frontier."""
    d, why = _one(g, symbol)
    if why:
        return _refused(g, why)
    home = g.nodes.where((F.col("qualified_name") == package) & F.col("kind").isin("package", "class")).orderBy("file_path", "id").first()
    if home is None or not home.file_path:
        return _refused(g, f"no package {package}")
    full = f"{package}::{d.name}"
    if not g.nodes.where(F.col("qualified_name") == full).isEmpty():
        return _refused(g, f"{full} is there already")
    found = _found(g, sources, [d.id], [d.name])
    there = Scratch(g.spark, "refactor").save(places(sources.where(F.col("path") == home.file_path)), "home")
    own = found.where((F.col("role") == "def") & (F.col("owner") == d.id)).first()
    last = there.where((F.col("role") == "def") & (F.col("package") == package) & (F.col("owner") != d.id)).agg(F.max("to")).first()[0]
    if own is None or last is None:
        return _refused(g, f"{package} has no sub to stand behind")
    judged = _judged(g, found, d.id, d.name)
    judged = judged.withColumn("verdict", F.when((F.col("verdict") == "edit") & (F.col("kind") == "method_call"), "frontier").otherwise(F.col("verdict")))
    put = g.spark.createDataFrame([(home.file_path, last, last, "\n\n" + own.text, "relocated")], EDITS)
    sites = _requalified(judged, full)
    inside = sites.join(found.where((F.col("role") == "def") & (F.col("owner") == d.id)).select("file", "from", "to"), "file", "left").where("`from` is null or start < `from` or start >= `to`").select("file", "start", "end", "new", "why")
    return _plan(g, _deleted(found, [d.id]).unionByName(put).unionByName(inside), judged)


_NOT_INLINE = re.compile(r"\b(?:return|wantarray|shift|pop|caller|goto|local)\b|@_|\$_\[")


def inline(g: CodeGraph, sources: DataFrame, symbol: str) -> Plan:
    """A function's proven calls as do blocks. The definition goes unless something may still need it."""
    d, why = _one(g, symbol)
    if why:
        return _refused(g, why)
    found = _found(g, sources, [d.id], [d.name])
    own = found.where((F.col("role") == "def") & (F.col("owner") == d.id)).first()
    if own is None or own.body is None:
        return _refused(g, "its source isn't there")
    text = own.text[own.body[0] - own["from"] : own.body[1] - own["from"]].strip()
    if _NOT_INLINE.search(text):
        return _refused(g, "its body depends on being a sub's")
    if not text:
        return _refused(g, "its body is empty")
    params = d.signature.strip()[1:-1].strip() if d.signature else ""
    if "=" in params:
        return _refused(g, "its parameters have defaults")
    judged = _judged(g, found, d.id, d.name)
    inside = (F.col("file") == own.file) & (F.col("start") >= own["from"]) & (F.col("start") < own["to"])
    stays = inside | (F.col("kind") != "call") | ~F.col("parens") | F.col("argc").isNull()
    judged = judged.withColumn("verdict", F.when((F.col("verdict") == "edit") & stays, "frontier").otherwise(F.col("verdict")))
    given = F.array_join("texts", ", ")
    new = F.concat(F.lit("do { "), F.lit(f"my ({params}) = (") if params else F.lit(""), given if params else F.lit(""), F.lit("); " if params else ""), F.lit(text), F.lit(" }"))
    sites = judged.where("verdict = 'edit'").select("file", F.col("whole_start").alias("start"), F.col("whole_end").alias("end"), new.alias("new"), F.lit("site").alias("why"))
    keep = d.is_exported or not judged.where("verdict = 'frontier'").isEmpty()
    return _plan(g, sites if keep else sites.unionByName(_deleted(found, [d.id])), judged, "can't be written in place")


def dedupe(g: CodeGraph, sources: DataFrame, symbol: str) -> Plan:
    """Copies of a function, byte for byte, gone, and their proven calls to the one that stays. Exported copies stay."""
    d, why = _one(g, symbol)
    if why:
        return _refused(g, why)
    if not d.dup or d.kind != "function":
        return _refused(g, "it has no shape to compare")
    same = g.nodes.where((F.col("kind") == "function") & (F.col("metadata.dup") == d.dup) & (F.col("id") != d.id)).select("id", "name", "is_exported").collect()
    found = _found(g, sources, [d.id, *(r.id for r in same)], [r.name for r in same])
    texts = {r.owner: (r.text[r.body[0] - r["from"] :], r.plain, r.sig) for r in found.where((F.col("role") == "def") & F.col("owner").isin([d.id, *(r.id for r in same)])).collect()}
    copies = [r for r in same if r.id in texts and d.id in texts and texts[r.id][0] == texts[d.id][0] and texts[r.id][1] and texts[d.id][1] and not r.is_exported]
    if not copies:
        return _refused(g, "it has no copies that can go")
    edits, judged_all, gone = None, None, []
    for r in copies:
        judged = _judged(g, found, r.id, r.name)
        if not judged.where("verdict = 'frontier' or verdict = 'edit' and kind = 'method_call'").isEmpty():
            judged_all = judged if judged_all is None else judged_all.unionByName(judged)
            continue
        gone.append(r.id)
        part = _requalified(judged, d.qualified_name)
        edits = part if edits is None else edits.unionByName(part)
    if edits is None:
        return _plan(g, g.spark.createDataFrame([], EDITS), judged_all)
    return _plan(g, edits.unionByName(_deleted(found, gone)), judged_all)


def removable(g: CodeGraph, symbol: str) -> tuple[list[str], str | None]:
    """(ids that can go with a symbol, why none can): private helpers that only they call go too, to a fixed point."""
    d, why = _one(g, symbol)
    if why:
        return [], why
    if d.is_exported:
        return [], f"{d.qualified_name} is exported"
    links = Scratch(g.spark, "remove").save(g.links("calls", "references", "overrides").select("source", "target").distinct(), "links")
    outer = links.where((F.col("target") == d.id) & (F.col("source") != d.id)).limit(1).collect()
    if outer or not g.refs.where(F.col("reference_name") == d.name).isEmpty():
        return [], f"{d.qualified_name} is called, or may be"
    gone = [d.id]
    private = g.nodes.where("kind = 'function' and visibility = 'private' and not coalesce(is_exported, false)").select(F.col("id").alias("target"), "name").join(g.refs.select(F.col("reference_name").alias("name")).distinct(), "name", "left_anti")
    while True:
        called = links.where(F.col("source").isin(gone) & ~F.col("target").isin(gone)).select("target").distinct().join(private, "target", "left_semi")
        needed = links.join(called, "target", "left_semi").where(~F.col("source").isin(gone) & (F.col("source") != F.col("target"))).select("target")
        more = [r.target for r in called.join(needed, "target", "left_anti").collect()]
        if not more:
            return gone, None
        gone += more


def remove(g: CodeGraph, sources: DataFrame, symbol: str) -> Plan:
    """A sub that nothing calls, and the private helpers that go with it."""
    gone, why = removable(g, symbol)
    if why:
        return _refused(g, why)
    own = g.nodes.where(F.col("id").isin(gone)).select(F.col("file_path").alias("path")).distinct()
    return _plan(g, _deleted(places(sources.join(own, "path", "left_semi")), gone, "removed"))


def change_signature(g: CodeGraph, sources: DataFrame, symbol: str, order: list[str]) -> Plan:
    """A sub's parameters as order names them, and its proven calls' arguments likewise.

    What order leaves out goes, if the body doesn't use it; "$new=TEXT" is new, and calls pass TEXT. A method's invocant stays
    first. Calls without brackets, or whose arguments may be lists or fall short, are frontier.
    """
    d, why = _one(g, symbol)
    if why:
        return _refused(g, why)
    if not d.signature:
        return _refused(g, "it has no signature")
    inner = d.signature.strip()[1:-1]
    old = [p.strip() for p in inner.split(",") if p.strip()]
    names = [re.split(r"\s*=", p)[0].strip() for p in old]
    if any(not re.fullmatch(r"\$\w+", n) for n in names):
        return _refused(g, "a parameter isn't a plain variable")
    first = 1 if names and names[0] in ("$self", "$class") else 0
    asked, want = [o.strip() for o in order], []
    for o in asked:
        name, _, text = o.partition("=")
        if not re.fullmatch(r"\$\w+", name.strip()):
            return _refused(g, f"{o} is no parameter")
        known = name.strip() in names
        if known == bool(text.strip()):
            return _refused(g, f"{name.strip()} is there already" if known else f"{name.strip()} is new and needs =TEXT")
        want.append((name.strip(), names.index(name.strip()) if known else None, text.strip()))
    if len({w[0] for w in want}) < len(want) or any(w[1] is not None and w[1] < first for w in want):
        return _refused(g, "a parameter comes twice")
    found = _found(g, sources, [d.id], [d.name])
    own = found.where((F.col("role") == "def") & (F.col("owner") == d.id)).first()
    if own is None or own.sig is None:
        return _refused(g, "its source isn't there")
    body = own.text[own.body[0] - own["from"] :]
    for n in names[first:]:
        if n not in {w[0] for w in want} and re.search(re.escape(n) + r"\b", body):
            return _refused(g, f"{n} is still used")
    listed = [*old[:first], *(old[k] if k is not None else n for n, k, _ in want)]
    optional = ["=" in p for p in listed]
    if any(a and not b for a, b in zip(optional, optional[1:])):
        return _refused(g, "a parameter with a default would stand before one without")
    judged = _judged(g, found, d.id, d.name)
    # Where a call names the invocant among its arguments, those shift by one.
    shift = F.when(F.col("kind") == "method_call", F.lit(first)).otherwise(F.lit(0))
    need = max([k for _, k, _ in want if k is not None] + [-1]) + 1
    fits = F.col("parens") & F.col("argc").isNotNull() & (F.col("argc") == F.size("texts")) & (F.size("texts") + shift >= need) & (F.size("texts") + shift <= len(names)) & F.col("kind").isin("call", "method_call")
    judged = judged.withColumn("verdict", F.when((F.col("verdict") == "edit") & ~fits, "frontier").otherwise(F.col("verdict")))
    arg = lambda k: F.get("texts", F.lit(k) - shift)
    parts = [*(F.when(F.lit(k) >= shift, arg(k)) for k in range(first)), *(arg(k) if k is not None else F.lit(text) for _, k, text in want)]
    new = F.array_join(F.filter(F.array(*parts) if parts else F.array().cast("array<string>"), lambda x: x.isNotNull()), ", ")
    sites = judged.where("verdict = 'edit'").select("file", F.col("inner").alias("start"), (F.col("whole_end") - 1).alias("end"), new.alias("new"), F.lit("site").alias("why"))
    head = g.spark.createDataFrame([(own.file, own.sig[0], own.sig[1], f"({', '.join(listed)})", "signature")], EDITS)
    return _plan(g, head.unionByName(sites), judged, "its arguments can't be told apart")


_FLOW = frozenset("return last next redo goto wantarray local state our sub package use no require".split())


def extract_sub(text: str, first: int, last: int, name: str) -> tuple[str | None, str | None]:
    """(new text, why not): lines first to last as a sub of their own, called in their place.

    They must be whole statements without control flow. Variables from before are passed in; one that is made in them and used
    behind is given back. A variable from before that is set in them, or an array or hash that crosses, is refused.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        return None, f"{name} is no name"
    src = lex(text)
    lines = src.lines
    start, end = lines[first - 1], lines[last] if last < len(lines) else len(text)
    inside = [t for t in src.tokens if start <= t.start < end]
    if not inside:
        return None, "nothing is there"
    before = [t for t in src.tokens if t.end <= start]
    if before and before[-1].text not in (";", "{", "}"):
        return None, "it begins inside a statement"
    depth = 0
    for t in inside:
        depth += (t.kind == "open") - (t.kind == "close")
        if depth < 0:
            return None, "its brackets don't match"
    if depth or inside[-1].text not in (";", "}"):
        return None, "it ends inside a statement"
    if any(t.kind == "word" and t.text in _FLOW or t.text in ("@_", "$_") or t.text.startswith("$_[") for t in inside):
        return None, "it has control flow, or what only its own sub has"
    # The sub around it: from its brace to the end of it.
    around = [k for k, t in enumerate(src.tokens) if t.text == "{" and t.start < start and t.match >= 0 and (t.match >= len(src.tokens) or src.tokens[t.match].start >= end)]
    subs = [k for k in around if any(src.tokens[j].text in ("sub", "method") for j in range(max(0, k - 12), k) if not any(src.tokens[i].text in (";", "}") for i in range(j, k)))]
    if not subs:
        return None, "it isn't in a sub"
    outer = src.tokens[subs[-1]]
    stop = src.tokens[outer.match].end if outer.match < len(src.tokens) else len(text)
    behind = [t for t in src.tokens if end <= t.start < stop]

    def mentioned(tokens) -> list[str]:
        out = []
        for k, t in enumerate(tokens):
            if t.kind == "var" and re.fullmatch(r"[$@%][A-Za-z_]\w*", t.text):
                nxt = tokens[k + 1].text if k + 1 < len(tokens) else ""
                out.append("@" + t.text[1:] if t.text[0] == "$" and nxt == "[" else "%" + t.text[1:] if t.text[0] == "$" and nxt == "{" else t.text)
            elif t.kind == "str" and t.interp:
                out += re.findall(r"(?<!\\)[$@][A-Za-z_]\w*", t.value)
        return list(dict.fromkeys(out))

    made = set()
    for k, t in enumerate(inside):
        if t.text in ("my",) and k + 1 < len(inside):
            n = inside[k + 1]
            group = inside[k + 2 : inside.index(src.tokens[n.match])] if n.text == "(" and 0 <= n.match < len(src.tokens) and src.tokens[n.match] in inside else [n]
            made |= {x.text for x in group if x.kind == "var"}
    used = mentioned(inside)
    given = [v for v in used if v not in made and v in mentioned([t for t in src.tokens if src.tokens[max(subs[-1] - 12, 0)].start <= t.start < start])]
    out = [v for v in sorted(made) if v in mentioned(behind)]
    for k, t in enumerate(inside):
        if t.kind == "var" and t.text in given and k + 1 < len(inside) and inside[k + 1].text in ("=", "+=", "-=", ".=", "*=", "/=", "||=", "&&=", "//=", "++", "--", "=~"):
            return None, f"{t.text} is set in it and comes from before"
    crossing = [v for v in [*given, *out] if v[0] != "$"]
    if crossing:
        return None, f"{crossing[0]} would cross"
    if len(out) > 1:
        return None, "more than one value would come back"
    line = text[text.rfind("\n", 0, inside[0].start) + 1 : inside[0].start]
    call = f"{name}({', '.join(given)});"
    lines_in = text[start:end].rstrip("\n")
    sub = f"\n\nsub {name} ({', '.join(given)}) {{\n{lines_in}\n" + (f"    return {out[0]};\n" if out else "") + "}"
    return text[:start] + line + (f"my {out[0]} = {call}" if out else call) + "\n" + text[end:stop] + sub + text[stop:], None


def apply(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """path and text of the files that edits change, edited from the end on. Edits that overlap one before them are left out."""
    each = edits.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_set(F.struct("start", "end", "new"))).alias("edits"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, text, todo in zip(part["path"], part["text"], part["edits"]):
                kept, at = [], -1
                for e in sorted(todo, key=lambda e: (e["start"], e["end"])):
                    if e["start"] >= at:
                        kept.append(e)
                        at = max(at, e["end"])
                for e in reversed(kept):
                    text = text[: e["start"]] + (e["new"] or "") + text[e["end"] :]
                out.append((path, text))
            yield pd.DataFrame(out, columns=["path", "text"])

    return sources.select("path", "text").join(each, "path").mapInPandas(run, "path string, text string")


def overlay(sources: DataFrame, changed: DataFrame) -> DataFrame:
    """sources with changed texts in the place of theirs."""
    return sources.select("path", "text").join(changed.select("path"), "path", "left_anti").unionByName(changed.select("path", "text"))


def tidy(sources: DataFrame, rounds: int = 12) -> tuple[DataFrame, list[str]]:
    """(sources, what was done): copies merged, then unused functions removed, the graph made anew after each step, until nothing is left or for so many rounds."""
    from codeloom.operators import quality, resolve
    from codeloom.sources.files import extracted

    spark = sources.sparkSession
    done: list[str] = []

    def graph(s: DataFrame, k: int) -> CodeGraph:
        raw = s.select("path", F.encode("text", "UTF-8").alias("content"), F.lit(0).cast("long").alias("mtime"))
        got = extracted(raw, Scratch(spark, f"tidy-{k}"))
        return resolve.resolve_all(CodeGraph(got["nodes"], got["edges"], got["refs"], got["files"]))

    g = graph(sources, 0)
    for group in quality.duplication(g, limit=None).collect():
        plan = dedupe(g, sources, group.members[0])
        if plan.error is None and not plan.edits.isEmpty():
            sources = Scratch(spark, "tidy").save(overlay(sources, apply(sources, plan.edits)), "sources")
            done.append(f"merged {group.members[0]}")
            g = graph(sources, len(done))
    for k in range(rounds):
        names = [r.qualified_name for r in quality.unused(g).where(C.shown_name() != "").select("qualified_name").orderBy("qualified_name").collect()]
        edits = None
        for name in names:
            plan = remove(g, sources, name)
            if plan.error is None:
                edits = plan.edits if edits is None else edits.unionByName(plan.edits)
                done.append(f"removed {name}")
        if edits is None:
            break
        sources = Scratch(spark, "tidy").save(overlay(sources, apply(sources, edits)), "sources")
        g = graph(sources, 100 + k)
    return sources, done
