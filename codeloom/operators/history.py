"""What commits tell: churn, risk, co-change, ownership, reviewers. commits has a row for each commit and file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators.lookup import files_linked
from codeloom.plans.graph import CALLS, CodeGraph

CODE = r"\.(pm|pl|t|psgi|xs)$"


def churn(commits: DataFrame) -> DataFrame:
    """file, churn: commits that touch each file."""
    return commits.groupBy("file").agg(F.countDistinct("commit_id").alias("churn"))


def transactions(commits: DataFrame, most: int = 3_000) -> DataFrame:
    """Rows of the latest so many commits."""
    latest = commits.select("commit_id", "commit_ord").distinct().orderBy(F.desc("commit_ord"), "commit_id").limit(most)
    return commits.join(latest.select("commit_id"), "commit_id", "left_semi")


def authorship(commits: DataFrame) -> DataFrame:
    """file, author, commits; merges don't count."""
    return commits.where("not coalesce(is_merge, false)").groupBy("file", "author").agg(F.countDistinct("commit_id").alias("commits"))


def risk(g: CodeGraph, churned: DataFrame, limit: int = 15) -> DataFrame:
    """Subs by how often their file changes times how many calls and references they get."""
    used = g.edges.where("kind in ('calls', 'references') and target is not null").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    subs = g.nodes.where("kind in ('function', 'method')").select("id", C.shown_name().alias("qualified_name"), F.col("file_path").alias("file"))
    met = subs.join(used, "id").join(churned, "file").withColumn("score", F.col("churn") * F.col("fan_in"))
    return met.select("id", "qualified_name", "churn", "fan_in", "score").orderBy(F.desc("score"), "qualified_name", "id").limit(limit)


def cochange(commits: DataFrame, g: CodeGraph | None = None, min_support: int = 3, max_files: int = 25, limit: int = 15) -> DataFrame:
    """Pairs of code files that change together: a, b, support, coupling (Jaccard), linked (whether the graph links them).

    Commits of over max_files files are passed over, so that no commit gives more than max_files squared pairs.
    """
    own = commits.where(F.col("file").rlike(CODE)).select("commit_id", "file").distinct()
    size = own.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n") <= max_files)
    own = own.join(size.select("commit_id"), "commit_id", "left_semi")
    n = own.groupBy("file").agg(F.count("*").alias("n"))
    pairs = own.withColumnRenamed("file", "a").join(own.withColumnRenamed("file", "b"), "commit_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    met = pairs.join(n.withColumnsRenamed({"file": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"file": "b", "n": "nb"}), "b")
    top = met.select("a", "b", "support", (F.col("support") / (F.col("na") + F.col("nb") - F.col("support"))).alias("coupling")).orderBy(F.desc("coupling"), F.desc("support"), "a", "b").limit(limit)
    linked = files_linked(g).withColumn("linked", F.lit(True)) if g is not None else top.select("a", "b").limit(0).withColumn("linked", F.lit(True))
    return top.join(linked, ["a", "b"], "left").select("a", "b", "support", "coupling", F.coalesce("linked", F.lit(False)).alias("linked")).orderBy(F.desc("coupling"), F.desc("support"), "a", "b")


def file_fan_in(g: CodeGraph) -> DataFrame:
    """file, fan_in: calls and references into a file from others."""
    place = g.nodes.where("file_path is not null").select("id", "file_path")
    e = g.links(*CALLS).select("source", "target").join(place.withColumnsRenamed({"id": "source", "file_path": "x"}), "source").join(place.withColumnsRenamed({"id": "target", "file_path": "file"}), "target")
    return e.where("x <> file").groupBy("file").agg(F.count("*").alias("fan_in"))


def owners(g: CodeGraph, authors: DataFrame, limit: int = 20) -> DataFrame:
    """Files with their main author: share, authors, commits, fan_in, and alone where the share is 0.8 or more and others depend on it."""
    indexed = g.nodes.where("file_path is not null").select(F.col("file_path").alias("file")).distinct()
    known = authors.join(indexed, "file", "left_semi")
    best = Window.partitionBy("file").orderBy(F.desc("commits"), "author")
    whole = Window.partitionBy("file")
    top = known.withColumn("k", F.row_number().over(best)).withColumn("total", F.sum("commits").over(whole)).withColumn("authors", F.count("*").over(whole)).where("k = 1")
    met = top.join(file_fan_in(g), "file", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0))).withColumn("share", F.col("commits") / F.col("total"))
    out = met.select("file", "author", "share", "authors", F.col("total").alias("commits"), "fan_in", ((F.col("share") >= 0.8) & (F.col("fan_in") > 0)).alias("alone"))
    return out.orderBy(F.desc("fan_in"), F.desc("share"), "file").limit(limit)


def suggest_reviewers(authors: DataFrame, changed: DataFrame) -> DataFrame:
    """author, commits, files: who has worked most on changed files (a column file)."""
    met = authors.join(changed.select("file").distinct(), "file", "left_semi")
    return met.groupBy("author").agg(F.sum("commits").alias("commits"), F.sort_array(F.collect_set("file")).alias("files")).orderBy(F.desc("commits"), "author")
