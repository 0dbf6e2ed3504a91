"""Incremental refresh of a graph, by batches of changed sources, and as a stream of them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import resolve, textindex, traverse
from codeloom.plans.graph import CodeGraph
from codeloom.plans.scratch import Scratch
from codeloom.sources import files
from codeloom.streaming.snapshots import Snapshots


@dataclass
class Change:
    """Paths of one refresh, each list sorted."""

    added: list[str]
    changed: list[str]
    deleted: list[str]
    dependents: list[str]
    #: A table of all new and changed paths, however many.
    touched: DataFrame | None = None
    #: References that were joined again.
    refs_again: int = 0

    def event(self, affected_tests: list[str]) -> str:
        return json.dumps({"added": self.added, "changed": self.changed, "deleted": self.deleted, "affected_tests": affected_tests})


def dependents(g: CodeGraph, paths: DataFrame) -> DataFrame:
    """path of files whose nodes have edges into files of paths, those aside."""
    place = g.nodes.where("file_path is not null").select("id", "file_path")
    e = g.edges.where("source is not null and target is not null").select("source", "target")
    met = e.join(place.withColumnsRenamed({"id": "target", "file_path": "path"}), "target").join(paths.select("path"), "path", "left_semi").join(place.withColumnsRenamed({"id": "source", "file_path": "from"}), "source")
    return met.select(F.col("from").alias("path")).distinct().join(paths.select("path"), "path", "left_anti")


def forget(g: CodeGraph, paths: DataFrame, both: bool = True) -> CodeGraph:
    """The graph without what files hold. Edges out of them go; edges into them only with both, since identities survive edits."""
    gone = g.nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    edges = g.edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti")
    if both:
        edges = edges.join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    own = paths.select(F.col("path").alias("file_path"))
    return g.with_(nodes=g.nodes.join(own, "file_path", "left_anti").select(*g.nodes.columns), edges=edges.select(*g.edges.columns), refs=g.refs.join(own, "file_path", "left_anti").select(*g.refs.columns), files=g.files.join(paths.select("path"), "path", "left_anti").select(*g.files.columns))


def sync(g: CodeGraph, sources: DataFrame | Callable[[DataFrame], DataFrame], call_sites: DataFrame | None = None, partial: bool = False, limit_paths: int = 100_000, listed: DataFrame | None = None) -> tuple[CodeGraph, DataFrame | None, Change]:
    """The graph brought up to date with sources (path, content, mtime), the call sites likewise, and what was done.

    sources is the whole tree; with partial only some files of it, none of which is deleted. Files whose digest or extraction
    version differs are read again, and so are the files that point into changed or deleted ones, so that references to what
    is gone come open again. Of the open references of other files only those are resolved again that what changed can bear on. listed (path, mtime) is the whole tree's listing: with it, files count as changed by their times, no other file's
    content is read, and sources may be what gives (path, content, mtime) for a table of paths. Without a change nothing is resolved. Paths are reported, up to limit_paths of a kind; Change.touched holds all that are new or changed.
    """
    scratch = Scratch(g.spark, "sync")
    version = F.lit(files.EXTRACTION_VERSION).alias("extraction_version")
    if listed is not None:
        now = scratch.save(listed.select("path", F.col("mtime").cast("string").alias("hash"), version), "now")
        known = g.files.select("path", F.col("mtime").cast("string").alias("old"), F.col("extraction_version").alias("old_version"))
    else:
        now = scratch.save(sources.select("path", F.sha1("content").alias("hash"), version), "now")
        known = g.files.select("path", F.col("hash").alias("old"), F.col("extraction_version").alias("old_version"))
    met = now.join(known, "path", "left")
    state = F.when(F.col("old").isNull(), "added").when((F.col("old") != F.col("hash")) | (F.col("old_version") != F.col("extraction_version")), "changed")
    touched = met.select("path", state.alias("state")).where("state is not null")
    if not partial:
        touched = touched.unionByName(known.join(now, "path", "left_anti").select("path", F.lit("deleted").alias("state")))
    touched = scratch.save(touched, "touched")
    if touched.isEmpty():
        return g, call_sites, Change([], [], [], [])
    # Before anything changes: who points into what will.
    near = scratch.save(dependents(g, touched.where("state <> 'added'")), "dependents")
    again = touched.where("state <> 'deleted'").select("path").unionByName(near).distinct()
    deleted = touched.where("state = 'deleted'").select("path")
    kept = forget(forget(g, deleted, both=True), again, both=False)
    if not partial:
        fresh = (sources(again) if callable(sources) else sources).join(again, "path", "left_semi")
    else:
        fresh = sources.join(touched.where("state <> 'deleted'").select("path"), "path", "left_semi")
        kept = forget(forget(g, deleted, both=True), touched.where("state <> 'deleted'").select("path"), both=False)
    top = kept.edges.agg(F.max("edge_ord").alias("o")).unionByName(kept.refs.agg(F.max("ref_ord").alias("o"))).agg(F.max("o")).first()[0]
    got = files.extracted(fresh, scratch, start=(top or 0) + 1)
    edges = kept.edges.unionByName(got["edges"].select(*g.edges.columns))
    nodes = kept.nodes.unionByName(got["nodes"].select(*g.nodes.columns))
    # An edge into a changed file whose target is gone falls away; its file has been read again and has the open reference.
    edges = edges.join(nodes.select(F.col("id").alias("target")).withColumn("_t", F.lit(True)), "target", "left").where("target is null or _t").select(*g.edges.columns)
    new = CodeGraph(scratch.save(nodes, "nodes"), scratch.save(edges, "edges"), scratch.save(kept.refs.unionByName(got["refs"].select(*g.refs.columns)), "refs"), scratch.save(kept.files.unionByName(got["files"].select(*g.files.columns)), "files"), g.embeddings, g.resolutions)
    if g.postings is not None and g.pieces is not None:
        # Files read again give all their nodes anew; the others' index rows stay as they are.
        fresh_nodes = scratch.save(got["nodes"].select(*g.nodes.columns), "fresh-nodes")
        lost = scratch.save(g.nodes.join(kept.nodes.select("id"), "id", "left_anti").select("id").unionByName(fresh_nodes.select("id")).distinct(), "lost-ids")
        new.postings = textindex.kept_up(g.postings, lost, textindex.node_postings(fresh_nodes))
        new.pieces = textindex.kept_up(g.pieces, lost, textindex.pieces(fresh_nodes))
    if call_sites is not None:
        gone = touched.select(F.col("path").alias("file")).unionByName(again.select(F.col("path").alias("file"))).distinct()
        call_sites = scratch.save(call_sites.join(gone, "file", "left_anti").unionByName(got["call_sites"].select(*call_sites.columns)), "sites")
    told = {s: [r.path for r in touched.where(F.col("state") == s).orderBy("path").limit(limit_paths).collect()] for s in ("added", "changed", "deleted")}
    read = touched.select("path") if partial else touched.select("path").unionByName(again)
    lost = g.nodes.join(read.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    new, refs = resolve.resolve_changed(g, new, lost, got["nodes"], (top or 0) + 1)
    return new, call_sites, Change(**told, refs_again=refs.count(), dependents=[r.path for r in near.orderBy("path").limit(limit_paths).collect()], touched=touched.where("state <> 'deleted'").select("path"))


def watch(spark: SparkSession, root: str, snapshots: Snapshots, on_event: Callable[[str], None], interval: str = "2 seconds", available_now: bool = False):
    """A stream over a source tree: each micro-batch of new or changed files refreshes the graph and tells what it did as JSON.

    A burst of changes is one batch. A batch that is run again after a failure finds its files up to date and changes nothing.
    Deletions don't show in a file stream; a sync() over the whole tree finds them.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    plain = root.rstrip("/")

    def apply(batch: DataFrame, batch_id: int) -> None:
        own = F.regexp_replace(F.col("path"), "^.*?" + plain.replace(".", r"\.") + "/", "")
        sources = batch.select(own.alias("path"), "content", F.unix_timestamp("modificationTime").alias("mtime")).where(F.col("path").rlike(files.CODE) & ~F.col("path").rlike(files.SKIPPED))
        sources = Scratch(spark, "watch").save(sources, "batch")
        g, sites = snapshots.read()
        new, sites, change = sync(g, sources, sites, partial=True)
        if change.added or change.changed:
            snapshots.write(new, sites, f"batch {batch_id}")
            tests = [r.file_path for r in traverse.affected(snapshots.read()[0], change.touched, tests_only=True).collect()]
            on_event(change.event(tests))

    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pl,pm,t,psgi,pod,xs}").load(root)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{snapshots.root}/_stream")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


#: So many files at most are opened by their paths; for more the tree is read.
OPENED = 1_000


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path and mtime of a tree's source files; no content is read."""
    return files.read_sources(spark, root).select("path", "mtime")


def watch_tree(spark: SparkSession, root: str, snapshots: Snapshots, on_event: Callable[[str], None], interval: str = "2 seconds", quiet: int = 0):
    """A stream of listings: each tick compares the tree with the files that the graph knows, and what was added, changed or deleted refreshes it.

    The graph's own files are the stream's state, so a restarted stream goes on where the last version ended, and a tick that is run
    again finds nothing to do. While a file is younger than quiet seconds, a tick waits for the burst to end; what a tick misses, the next one sees, so
    none can overflow. Contents are read only of files that were touched and those that point into them. Files are told apart by their
    times, in whole seconds.
    """
    def contents(paths: DataFrame) -> DataFrame:
        few = [r.path for r in paths.select("path").limit(OPENED + 1).collect()]
        if len(few) > OPENED:
            return files.read_sources(spark, root)
        return files.read_sources(spark, root, only=few)

    def apply(batch: DataFrame, batch_id: int) -> None:
        now = Scratch(spark, "tick").save(listing(spark, root), "listing")
        g, sites = snapshots.read()
        if quiet and not now.join(g.files.select("path", F.col("mtime").alias("old")), "path", "left").where((F.col("old").isNull() | (F.col("mtime") != F.col("old"))) & (F.col("mtime") > F.unix_timestamp() - quiet)).isEmpty():
            return
        new, sites, change = sync(g, contents, sites, listed=now)
        if change.touched is None:
            return
        snapshots.write(new, sites, f"tick {batch_id}")
        tests = [r.file_path for r in traverse.affected(snapshots.read()[0], change.touched, tests_only=True).collect()]
        on_event(change.event(tests))

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(apply).option("checkpointLocation", f"{snapshots.root}/_ticks").trigger(processingTime=interval).start()


def signature(spark: SparkSession, root: str) -> str:
    """A digest of a tree's paths and times, for polling."""
    rows = files.read_sources(spark, root).select("path", "mtime")
    return str(rows.agg(F.sum(F.xxhash64("path", "mtime").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first().asDict())


__all__ = ["Change", "Snapshots", "dependents", "forget", "listing", "signature", "sync", "watch", "watch_tree"]
