"""Commits of a git repository as rows, read in slices by tasks, and files as a ref has them."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from codeloom.plans import schema as S

CODE = re.compile(r"\.(pm|pl|t|xs)$")
HEAD = re.compile(rb"\x01([0-9a-f]{40,64})\x02([^\x02]*)\x02([0-9a-f ]*)\x02")
#: Commits that a task reads. Git walks past those before a slice without comparing their files.
SLICE = 2_000
ROWS = 5_000


def safe_ref(ref: str) -> bool:
    """Whether a ref can't be taken for an option."""
    return bool(ref) and not ref.startswith("-") and not re.search(r"[\x00-\x20]", ref)


def _run(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.decode("utf-8", "replace")


def available(root: str) -> bool:
    return (_run(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


class Slice(InputPartition):
    """Commits number first to first + n of a log of total, newest first."""

    def __init__(self, first: int, n: int, total: int, span: str):
        self.first, self.n, self.total, self.span = first, n, total, span


class GitLog(DataSource):
    """A row for each commit and file. A task reads one slice of the log, of commits as they were when the query was planned.

    Options: root, a folder that all executors see; since, a ref whose ancestors are left out; slice, commits a task.
    """

    @classmethod
    def name(cls) -> str:
        return "codeloom_git_log"

    def schema(self) -> str:
        return S.COMMITS

    def reader(self, schema: StructType) -> GitLogReader:
        return GitLogReader(self.options)


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.since, self.slice = options["root"], options.get("since"), int(options.get("slice", SLICE))

    def partitions(self) -> list[Slice]:
        """The only thing known in one place is how many commits there are."""
        ends = [_commit(self.root, r) for r in (["HEAD"] if self.since is None else ["HEAD", self.since])]
        if None in ends:
            return [Slice(0, 0, 0, "")]
        span = ends[0] if len(ends) == 1 else f"{ends[1]}..{ends[0]}"
        total = int(_run(self.root, "rev-list", "--count", span) or 0)
        return [Slice(k, min(self.slice, total - k), total, span) for k in range(0, total, self.slice)] or [Slice(0, 0, 0, "")]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        # Names as they are, without quotes; a NUL ends each, and each commit.
        args = ["git", "-C", self.root, "log", "-z", "--name-only", "--format=%x01%H%x02%ae%x02%P%x02", f"--skip={partition.first}", f"--max-count={partition.n}", partition.span, "--"]
        with subprocess.Popen(args, stdout=subprocess.PIPE) as git:
            rows, at, head = [], partition.total - partition.first + 1, None
            for part in _parts(git.stdout):
                m = HEAD.match(part)
                if m:
                    at, head = at - 1, (m[1].decode(), m[2].decode("utf-8", "replace"), len(m[3].split()) > 1)
                    part = part[m.end() :]
                # The first name of a commit stands behind a line end.
                name = part.removeprefix(b"\n").decode("utf-8", "replace")
                if head and name:
                    rows.append((head[0], at, *head[1:], name))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        # Part of a history would pass for all of it.
        if git.returncode:
            raise RuntimeError(f"git log ended with {git.returncode} in {self.root}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["commit_id", "commit_ord", "author", "is_merge", "file"])


def _parts(stream: IO[bytes], size: int = 1 << 16) -> Iterator[bytes]:
    """What NULs end, with no more than a piece of the stream held."""
    rest = b""
    while piece := stream.read(size):
        *whole, rest = (rest + piece).split(b"\0")
        yield from whole
    if rest:
        yield rest


def _commit(root: str, ref: str) -> str | None:
    return ((_run(root, "rev-parse", "--verify", "--quiet", ref + "^{commit}") or "").strip() or None) if safe_ref(ref) else None


def commits(spark: SparkSession, root: str, since: str | None = None, slice: int = SLICE) -> DataFrame:
    """A row for each commit and file (see codeloom.plans.schema), the newest with the largest ordinal; since narrows to what follows a ref.

    Where there is no repository, or no such ref, there are no rows; a log that breaks off is an error.
    """
    spark.dataSource.register(GitLog)
    reader = spark.read.format(GitLog.name()).option("root", root).option("slice", slice)
    return (reader if since is None else reader.option("since", since)).load()


def changed(root: str, ref: str) -> list[str]:
    """Code files that differ from a ref."""
    if not safe_ref(ref):
        return []
    return [f for f in (_run(root, "diff", "-z", "--name-only", ref, "--") or "").split("\0") if CODE.search(f)]


def show(root: str, ref: str, path: str) -> str | None:
    """A file as a ref has it."""
    return _run(root, "show", f"{ref}:{path}") if safe_ref(ref) else None


def versions(names: DataFrame, root: str, ref: str) -> DataFrame:
    """path, content, mtime (0) of files as a ref has them, empty where it has none; names has a column file. Tasks read the contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content = (show(root, ref, path) or "").encode()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([0], pa.int64())], names=["path", "content", "mtime"])

    return names.select("file").mapInArrow(run, "path string, content binary, mtime long")
