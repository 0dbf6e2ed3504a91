"""A graph in a folder, kept as versions that share what they have in common.

Each table is dealt to buckets by what a refresh replaces together: the rows of a file, the edges out of a node, the index rows of a token. A
version writes only the buckets whose rows differ from those of the version before it, by a digest of each, and a manifest that says which
version's folder holds every bucket. So a small change writes a few small folders, and a version is read whole or not at all: the pointer
to its manifest is swapped last, by one rename. A table whose buckets lie in over SPREAD versions is written whole again, so that readers open few folders.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import textindex
from codeloom.plans import schema as S
from codeloom.plans.graph import CodeGraph
from codeloom.plans.scratch import Scratch

BUCKETS = textindex.BUCKETS
SPREAD = 8
#: Each table's schema, and the columns that deal its rows to buckets.
TABLES = {
    "nodes": (S.NODES, "file_path"), "edges": (S.EDGES, "source"), "refs": (S.REFS, "file_path"), "files": (S.FILES, "path"), "embeddings": (S.EMBEDDINGS, "node_id"),
    "resolutions": (S.RESOLUTIONS, "caller_qname"), "call_sites": (S.CALL_SITES, "file"), "postings": (S.POSTINGS, "token"), "pieces": (S.PIECES, "piece"),
}


class Snapshots:
    """The versions of one graph. The pointer and the manifests are files that Spark's file system reads and renames, so the folder can be on any store Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        jvm, fs = self._fs()
        return fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"))

    def _put(self, name: str, text: str) -> None:
        """A small file, whole or not at all."""
        jvm, fs = self._fs()
        new, now = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}-{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(now.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, now, options)

    def version(self) -> str | None:
        if not self._there("CURRENT"):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first().value

    def manifest(self, version: str | None = None) -> dict:
        """{"before": version, "note": text, "tables": {table: {bucket: [digest, version that holds it]}}}."""
        version = version or self.version()
        if version is None:
            return {"before": None, "note": "", "tables": {}}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/manifest-{version}").first().value)

    def write(self, g: CodeGraph, call_sites: DataFrame | None = None, note: str = "") -> str:
        """A new version; of each table the buckets that differ from the version before. Indexes of the nodes are made where the graph has none."""
        before, version = self.version(), f"v-{uuid.uuid4().hex}"
        known = self.manifest(before)["tables"]
        tables, scratch = {}, Scratch(self.spark, "version")
        for name, (ddl, key) in TABLES.items():
            df = call_sites if name == "call_sites" else getattr(g, name)
            if df is None and name in ("postings", "pieces"):
                nodes = self.table("nodes", tables["nodes"])
                df = textindex.node_postings(nodes) if name == "postings" else textindex.pieces(nodes)
            if df is not None:
                tables[name] = self._changed(name, df, ddl, key, known.get(name, {}), version, scratch)
        self._put(f"manifest-{version}", json.dumps({"before": before, "note": note, "tables": tables}))
        self._put("CURRENT", version)
        return version

    def _changed(self, name: str, df: DataFrame, ddl: str, key: str, known: dict, version: str, scratch: Scratch) -> dict:
        """What the manifest says of a table, after its changed buckets are written; the driver gets a digest a bucket."""
        # An index's own bucket is that of its folder.
        columns = [c for c in self.spark.createDataFrame([], ddl).columns if c != "bucket"]
        rows = scratch.save(df.select(*columns).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), name)
        told = rows.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("s"), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")).cast("string").alias("t"))
        digests = {str(r["_bucket"]): f"{r.n}:{r.s}:{r.t}" for r in told.collect()}
        out = {b: [d, known[b][1] if b in known and known[b][0] == d else version] for b, d in digests.items()}
        if len({v for _, v in out.values()}) > SPREAD:
            out = {b: [d, version] for b, d in digests.items()}
        fresh = [int(b) for b, (_, v) in out.items() if v == version]
        if fresh:
            # Ranges of keys, so that a bucket with very many rows is written by several tasks.
            order = [c for c in (key, "id") if c in columns]
            some = rows.where(F.col("_bucket").isin(*fresh)).repartitionByRange("_bucket", *order, F.xxhash64(*columns))
            some.sortWithinPartitions("_bucket", *order).write.partitionBy("_bucket").parquet(f"{self.root}/{version}/{name}")
        scratch.drop(name)
        return out

    def table(self, name: str, held: dict) -> DataFrame:
        """A table as a manifest's entries for it say."""
        ddl = TABLES[name][0]
        by: dict[str, list[str]] = {}
        for bucket, (_, version) in held.items():
            by.setdefault(version, []).append(f"{self.root}/{version}/{name}/_bucket={bucket}")
        found = self.spark.createDataFrame([], ddl)
        columns = [F.col("_bucket").alias("bucket") if c == "bucket" else F.col(c) for c in found.columns]
        stored = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name != "bucket"), "_bucket int"])
        for k, (version, paths) in enumerate(sorted(by.items())):
            part = self.spark.read.schema(stored).option("basePath", f"{self.root}/{version}/{name}").parquet(*paths).select(*columns)
            found = part if not k else found.unionByName(part)
        return found

    def read(self, version: str | None = None) -> tuple[CodeGraph, DataFrame | None]:
        """The graph of a version, the last one unless another is named, and its call sites."""
        version = version or self.version()
        if version is None:
            raise FileNotFoundError(f"no graph in {self.root}")
        held = self.manifest(version)["tables"]
        tables = {n: self.table(n, entries) for n, entries in held.items()}
        sites = tables.pop("call_sites", None)
        return CodeGraph(**tables, spark=self.spark, stored=True), sites

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes what none of the last so many versions refers to; the versions deleted from. Readers of older ones must be done."""
        jvm, fs = self._fs()
        versions, at = [], self.version()
        while at is not None and len(versions) < keep:
            versions.append(at)
            at = self.manifest(at)["before"]
        used = {f"{v}/{name}/_bucket={b}" for m in versions for name, entries in self.manifest(m)["tables"].items() for b, (_, v) in entries.items()}
        gone = []
        while at is not None:
            gone.append(at)
            m = self.manifest(at)
            for name, entries in m["tables"].items():
                for b, (_, v) in entries.items():
                    if v == at and f"{v}/{name}/_bucket={b}" not in used:
                        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{v}/{name}/_bucket={b}"), True)
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest-{at}"), False)
            at = m["before"] if m["before"] and self._there(f"manifest-{m['before']}") else None
        return gone
