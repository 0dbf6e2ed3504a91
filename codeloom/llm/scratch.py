"""Tables that cut lineage, kept in the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, one machine (tests) gets a temporary folder until Python ends; a cluster, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings as given, and afterwards as they were."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: A table's shuffle files go as soon as it is written: nothing is computed again from the plan that made it.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class Scratch:
    """Written tables of one operator run. save() cuts lineage; drop() frees what no later plan reads, keep() all but what one does."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/codeloom-{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # Short-lived and mostly numbers: a compressor for each column of many small files costs more memory than it saves disk.
        with held(self.spark, _WRITING):
            df.write.mode("overwrite").option("compression", "none").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            if name not in self.names:
                continue
            self.names.remove(name)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def keep(self, *names: str) -> None:
        self.drop(*[n for n in self.names if n not in names])
