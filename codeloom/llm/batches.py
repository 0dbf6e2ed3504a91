"""Bounds on what Python workers hold at once."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

ROWS = 1_000


def bounded(spark: SparkSession) -> None:
    """Arrow batches of ROWS rows at most from now on: a row may hold a long text, and Spark's own bound is 10,000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def given_back() -> None:
    """What this process no longer needs goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Iterator[pa.RecordBatch], *forget: Callable[[], None]) -> Iterator[pa.RecordBatch]:
    """What batches gives; at its end forget empties caches (which a worker has under their module's names), and what the worker no longer needs goes back to the machine.

    A worker process outlives its task and sits beside the executor's own memory while other stages run.
    """
    yield from batches
    for f in forget:
        f()
    given_back()


def dealt(batches: Iterator[pa.RecordBatch], column: int, chars: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about so many characters in a column, or one row of more."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
        start = 0
        for k, n in enumerate(lengths):
            size += n
            if size >= chars:
                held.append(batch.slice(start, k + 1 - start))
                yield pa.concat_batches(held)
                held, size, start = [], 0, k + 1
        if start < len(lengths):
            held.append(batch.slice(start))
    if held:
        yield pa.concat_batches(held)


def joined_cuts(cuts: pa.ListArray, of: Callable[[list[str]], list[bytes]]) -> pa.Array:
    """Each list of cuts as the joined bytes that of gives for them; of is asked for the distinct cuts only."""
    found = cuts.flatten().dictionary_encode()
    each = pa.array(of(found.dictionary.to_pylist()), pa.binary())
    return pc.binary_join(pa.ListArray.from_arrays(cuts.offsets, each.take(found.indices)), b"")
