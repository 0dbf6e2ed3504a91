"""Source files: found by Spark's readers, parsed on the executors, as the graph's tables."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans import schema as S
from codeloom.plans.graph import CodeGraph
from codeloom.plans.scratch import Scratch
from codeloom.sources.perl.extract import extract
from codeloom.sources.perl.lexer import lex

#: Raised when the extractor's output changes, so that unchanged sources are read again.
EXTRACTION_VERSION = 1
CODE = r"\.(pl|pm|t|psgi|pod|xs)$"
# Folders that hold no own code.
SKIPPED = r"(^|/)(\.git|blib|local|node_modules|\.build|_build|\.svn|\.hg|cover_db)(/|$)"


def read_sources(spark: SparkSession, root: str, max_bytes: int | None = None, nested: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """path (from the root), content, mtime of a tree's source files.

    A file that goes while the tree is read is passed over. Files over max_bytes are too. nested names folders of other
    repositories below the root, whose files don't belong to it. only names a few files (paths from the root) that alone are opened.
    """
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    # A path's own signs would be read as patterns.
    opened = base if only is None else [f"{base}/" + re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in only]
    found = reader.load(opened) if opened else reader.load(base).limit(0)
    plain = re.sub(r"^file:/*", "/", base) if base.startswith("file:") else base
    # The reader gives whole URIs; what follows the root is a file's name.
    path = F.regexp_replace(F.col("path"), "^.*?" + re.escape(re.sub(r"^[a-z0-9+]+://[^/]*", "", plain)) + "/", "")
    found = found.select(path.alias("path"), "content", F.unix_timestamp("modificationTime").alias("mtime"), "length").where(F.col("path").rlike(CODE) & ~F.col("path").rlike(SKIPPED))
    for folder in nested or []:
        found = found.where(~F.col("path").startswith(folder.strip("/") + "/"))
    return (found.where(F.col("length") <= max_bytes) if max_bytes else found).drop("length")


def texts(sources: DataFrame) -> DataFrame:
    """path and text of sources."""
    return sources.select("path", F.decode("content", "UTF-8").alias("text"))


def _rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for path, content, mtime in zip(part["path"], part["content"], part["mtime"]):
            raw = bytes(content or b"")
            got = extract(path, raw.decode("utf-8", "replace"))
            for place, rows in (("node", got["nodes"]), ("edge", got["edges"]), ("ref", got["refs"]), ("site", got["sites"])):
                out += [(path, place, k, json.dumps(r)) for k, r in enumerate(rows)]
            out.append((path, "file", 0, json.dumps({"path": path, "hash": hashlib.sha1(raw).hexdigest(), "mtime": int(mtime or 0), "language": "xs" if path.endswith(".xs") else "perl", "node_count": len(got["nodes"]), "parse_errors": got["error"], "extraction_version": EXTRACTION_VERSION})))
        yield pd.DataFrame(out, columns=["path", "place", "k", "row"])


def extracted(sources: DataFrame, scratch: Scratch, name: str = "extracted", start: int = 0) -> dict[str, DataFrame]:
    """files, nodes, edges, refs and call_sites of sources: each file is parsed once, in a narrow stage, and its rows are written.

    Ordinals follow the order of paths and the order inside a file, and begin at start.
    """
    raw = scratch.save(sources.select("path", "content", "mtime").mapInPandas(_rows, "path string, place string, k int, row string"), f"{name}-raw")
    rows = scratch.save(raw.repartitionByRange("path", "k").sortWithinPartitions("path", "k", "place").withColumn("o", F.monotonically_increasing_id() + start), name)

    def table(place: str, ddl: str, ordinal: str | None = None) -> DataFrame:
        df = rows.where(F.col("place") == place).select("o", F.from_json("row", ddl).alias("r"))
        return df.select(*((F.col("o") if f.name == ordinal else F.col(f"r.{f.name}")).alias(f.name) for f in df.schema["r"].dataType.fields))

    # Of definitions that share their identity the last in its file counts.
    nodes = rows.where("place = 'node'").select("o", F.from_json("row", S.NODES).alias("r")).groupBy(F.col("r.id").alias("_id")).agg(F.max_by("r", "o").alias("r")).select("r.*")
    return {"files": table("file", S.FILES).withColumn("indexed_at", F.current_timestamp()), "nodes": nodes, "edges": table("edge", S.EDGES, "edge_ord"), "refs": table("ref", S.REFS, "ref_ord"), "call_sites": table("site", S.CALL_SITES)}


def index(spark: SparkSession, root: str, max_bytes: int | None = None, resolved: bool = True) -> tuple[CodeGraph, DataFrame]:
    """(graph, call sites) of a source tree, with references resolved."""
    from codeloom.operators.resolve import resolve_all

    got = extracted(read_sources(spark, root, max_bytes), Scratch(spark, "index"))
    g = CodeGraph(got["nodes"], got["edges"], got["refs"], got["files"])
    return (resolve_all(g) if resolved else g), got["call_sites"]


def dependencies(g: CodeGraph, library: DataFrame, scratch: Scratch, most_modules: int = 1_000, most_bytes: int = 2_000_000) -> CodeGraph:
    """The graph with the public subs and the inheritance of used modules, found in a library of sources (path, content, mtime).

    Modules are followed through their own inheritance and imports, up to most_modules, nearest first; their nodes are marked cpan.
    """
    def module(path):
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.pm$", ""), r"^.*?(?:lib|site_perl|vendor_perl)/", ""), "/", "::")

    have = g.nodes.where("kind in ('package', 'class')").select(F.col("qualified_name").alias("module")).distinct()
    shelf = library.where(F.col("path").endswith(".pm") & (F.length("content") <= most_bytes)).withColumn("module", module(F.col("path")))
    wanted = g.edges.where("kind in ('imports', 'extends', 'implements')").select(F.coalesce("metadata.module", "metadata.name").alias("module")).where("module is not null").distinct()
    nodes, edges, seen, left, k = g.nodes, g.edges, have, most_modules, 0
    while left > 0:
        batch = scratch.save(shelf.join(wanted.join(seen, "module", "left_anti"), "module", "left_semi").orderBy("module", "path").limit(left), f"batch-{k}")
        n = batch.count()
        if not n:
            break
        got = extracted(batch, scratch, f"dependencies-{k}")
        public = got["nodes"].where("kind in ('package', 'class') or kind in ('function', 'method', 'constant') and (is_exported or coalesce(visibility, '') <> 'private')")
        nodes = nodes.unionByName(public.withColumn("metadata", F.col("metadata").withField("cpan", F.lit(True))))
        kept = got["edges"].where("kind in ('contains', 'extends', 'implements')").join(public.select(F.col("id").alias("source")), "source", "left_semi")
        edges = edges.unionByName(kept.select(*g.edges.columns))
        seen = seen.unionByName(batch.select("module")).distinct()
        wanted = got["edges"].where("kind in ('imports', 'extends', 'implements')").select(F.coalesce("metadata.module", "metadata.name").alias("module")).where("module is not null").distinct()
        left, k = left - n, k + 1
    return g.with_(nodes=nodes, edges=edges)


#: The keys of a Makefile.PL that name what a distribution requires.
_REQUIRING = ("PREREQ_PM", "TEST_REQUIRES", "CONFIGURE_REQUIRES", "BUILD_REQUIRES")


def _name(token) -> str | None:
    name = token.value if token.kind == "str" else token.text if token.kind == "word" else ""
    return name if name and name.replace("::", "").replace("_", "").isalnum() else None


def _required_calls(text: str) -> set[str]:
    """The modules of a cpanfile: the first argument of each statement that calls requires."""
    t = lex(text).tokens
    begins = (k for k, x in enumerate(t) if x.kind == "word" and x.text == "requires" and (not k or t[k - 1].text in (";", "{", "}")))
    first = (t[k + 2] if t[k + 1].text == "(" else t[k + 1] for k in begins if k + 2 < len(t))
    return {name for x in first if x.kind == "str" and (name := _name(x))}


def _required_keys(text: str) -> set[str]:
    """The modules of a Makefile.PL: the keys of the hashes that stand under its requiring keys."""
    t = lex(text).tokens
    found = set()
    for k, x in enumerate(t[:-2]):
        if (x.value or x.text) in _REQUIRING and t[k + 1].text == "=>" and t[k + 2].text == "{":
            inside = t[k + 3 : t[k + 2].match if t[k + 2].match > 0 else len(t)]
            found |= {name for key, arrow in zip(inside, inside[1:]) if arrow.text == "=>" and (name := _name(key))}
    return found


def declared_prereqs(root_files: dict[str, str]) -> tuple[list[str], str | None]:
    """(modules, file) that a distribution requires, by the first of META.json, MYMETA.json, cpanfile and Makefile.PL that says so."""
    for name in ("META.json", "MYMETA.json"):
        try:
            phases = json.loads(root_files.get(name, "")).get("prereqs") or {}
        except (ValueError, AttributeError):
            continue
        return sorted({m for p in phases.values() for m in (p or {}).get("requires") or {}}), name
    for name, read in (("cpanfile", _required_calls), ("Makefile.PL", _required_keys)):
        if found := read(root_files.get(name, "")):
            return sorted(found), name
    return [], None
