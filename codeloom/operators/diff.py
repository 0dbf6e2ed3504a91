"""Two snapshots: what changed, how a release should be numbered, and whether a change should pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import quality, reach, traverse
from codeloom.operators.lookup import first_by
from codeloom.plans.graph import CALLS, CodeGraph, expand
from codeloom.plans.scratch import Scratch

SUBS = ("function", "method", "constant")


def diff(old: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """change (added, removed, signature), file, qualified_name, old_signature, new_signature, breaking, public.

    Nodes are matched by file and qualified name. Removing what was public breaks, and so does a new signature of what is.
    files (a column file) narrows to changed files.
    """
    def side(nodes: DataFrame, s: str) -> DataFrame:
        own = nodes.where(F.col("kind").isin(*SUBS) & F.col("qualified_name").isNotNull())
        if files is not None:
            own = own.join(files.select(F.col("file").alias("file_path")).distinct(), "file_path", "left_semi")
        own = first_by(own, ["file_path", "qualified_name"], F.desc_nulls_last("start_line"), "id")
        return own.select(F.coalesce("file_path", F.lit("")).alias("file"), "qualified_name", F.coalesce("signature", F.lit("")).alias(f"{s}_signature"), C.is_public().alias(f"{s}_public"), F.lit(True).alias(f"{s}_there"))

    met = side(old, "old").join(side(new, "new"), ["file", "qualified_name"], "full_outer")
    change = F.when(F.col("old_there").isNull(), "added").when(F.col("new_there").isNull(), "removed").when(F.col("old_signature") != F.col("new_signature"), "signature")
    out = met.withColumn("change", change).where("change is not null")
    breaking = F.when(F.col("change") == "removed", F.col("old_public")).when(F.col("change") == "signature", F.col("new_public")).otherwise(F.lit(False))
    return out.select("change", "file", "qualified_name", "old_signature", "new_signature", breaking.alias("breaking"), F.coalesce("new_public", "old_public").alias("public")).orderBy("file", "qualified_name")


def semver(changes: DataFrame) -> DataFrame:
    """bump, breaking, added, changes: one row."""
    row = changes.agg(F.count(F.when(F.col("breaking"), 1)).alias("breaking"), F.count(F.when((F.col("change") == "added") & F.col("public"), 1)).alias("added"), F.count("*").alias("changes"))
    return row.select(F.when(F.col("breaking") > 0, "MAJOR").when(F.col("added") > 0, "MINOR").otherwise("PATCH").alias("bump"), "breaking", "added", "changes")


def changelog(changes: DataFrame) -> str:
    """Markdown of public changes, grouped, with the bump; rows are the release's own and come to the driver."""
    bump = semver(changes).first().bump
    out = [f"## {bump}"]
    titles = {"removed": "Removed", "signature": "Changed", "added": "Added"}
    rows = changes.where("public").orderBy("qualified_name").collect()
    for change, title in titles.items():
        some = [r for r in rows if r.change == change]
        if some:
            out += ["", f"### {title}", *(f"- `{r.qualified_name}`" + (f": `{r.old_signature}` to `{r.new_signature}`" if change == "signature" else "") + (" (breaking)" if r.breaking else "") for r in some)]
    return "\n".join(out) + "\n"


def review(g: CodeGraph, changes: DataFrame, depth: int = 25, wide: int = 5, sketched: bool = False) -> dict[str, DataFrame]:
    """changes, symbols (callers, tests, untested, wide of each changed sub still there), affected (files).

    Test files are counted, all subs in one traversal with a row for each sub and what leads to it; or, sketched, at any depth with a row a
    node. They are few, so that the sketches are exact up to 4,095 of them.
    """
    subs = g.nodes.where(F.col("kind").isin(*SUBS)).join(changes.where("change <> 'removed'").select("file", "qualified_name").withColumnRenamed("file", "file_path"), ["file_path", "qualified_name"], "left_semi")
    callers = g.links("calls").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers"))
    of_test = g.nodes.where(F.col("file_path").endswith(".t")).select("id", "file_path")
    if sketched:
        tests = reach.reach_sizes(g.walks(*CALLS), of_test.withColumnRenamed("file_path", "value")).select("id", F.col("size").alias("tests"))
        met = expand(g.walks(*CALLS), subs.select("id"), depth, "in").where("depth > 0")
    else:
        met = expand(g.walks(*CALLS), subs.select(F.col("id").alias("root"), "id"), depth, "in", keys=("root",)).where("depth > 0")
        tests = met.join(of_test, "id").groupBy(F.col("root").alias("id")).agg(F.countDistinct("file_path").alias("tests"))
    out = subs.join(callers, "id", "left").join(tests, "id", "left").fillna(0, ["callers", "tests"])
    judged = C.is_public() & ~F.coalesce("metadata.accessor", F.lit(False))
    symbols = out.select("id", "qualified_name", "callers", "tests", (judged & (F.col("tests") == 0)).alias("untested"), (C.is_public() & (F.col("callers") >= wide)).alias("wide"))
    files = g.nodes.join(met.select("id").distinct(), "id", "left_semi").select("file_path").unionByName(changes.select(F.col("file").alias("file_path"))).where("file_path is not null").distinct()
    return {"changes": changes, "symbols": symbols, "affected": files}


def gate(g: CodeGraph, changes: DataFrame, call_sites: DataFrame | None = None) -> DataFrame:
    """score and verdict of a change: 100 less 15 for each breaking change, 12 for each broken call, 10 for each wrong number of arguments, 6 for each untested and 4 for each widely used symbol, in changed files."""
    # Written once: what was changed compares all nodes, and is asked for again and again below.
    changes = Scratch(g.spark, "gate").save(changes, "changes")
    files = changes.select("file").distinct()
    symbols = review(g, changes)["symbols"]
    broken = quality.check_calls(g).join(files, "file", "left_semi").agg(F.count("*").alias("broken"))
    args = quality.check_args(g, call_sites).join(files, "file", "left_semi") if call_sites is not None else files.limit(0)
    row = changes.agg(F.count(F.when(F.col("breaking"), 1)).alias("breaking")).crossJoin(broken).crossJoin(args.agg(F.count("*").alias("arity")))  # one row each
    row = row.crossJoin(symbols.agg(F.count(F.when(F.col("untested"), 1)).alias("untested"), F.count(F.when(F.col("wide"), 1)).alias("wide")))
    score = F.greatest(F.lit(0), F.lit(100) - 15 * F.col("breaking") - 12 * F.col("broken") - 10 * F.col("arity") - 6 * F.col("untested") - 4 * F.col("wide"))
    return row.withColumn("score", score).withColumn("verdict", F.when(F.col("score") >= 85, "PASS").when(F.col("score") >= 60, "REVIEW").otherwise("BLOCK"))


def callers_of_changes(g: CodeGraph, changes: DataFrame) -> DataFrame:
    """qualified_name, caller of each changed symbol that is still there."""
    subs = g.nodes.join(changes.select("qualified_name").distinct(), "qualified_name", "left_semi").select(F.col("id").alias("target"), "qualified_name")
    return g.links("calls").join(subs, "target").join(g.nodes.select(F.col("id").alias("source"), C.shown_name().alias("caller")), "source").select("qualified_name", "caller").distinct()


__all__ = ["callers_of_changes", "changelog", "diff", "gate", "review", "semver", "traverse"]
