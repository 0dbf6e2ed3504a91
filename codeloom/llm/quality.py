"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.batches import bounded, trimmed
from codeloom.llm.scratch import Scratch

SCHEMA = "doc_id long, score double"
BITS = 18
#: Labelled rows that a model is fitted on at most; they are those with the smallest md5 of their doc_id.
SAMPLE_ROWS = 6_000

_TAIL = re.compile(r"[^\w]+$")
_known: dict[str, int] = {}


def _forget() -> None:
    _known.clear()


def _shape(word: str) -> str:
    tail = _TAIL.search(word)
    end = tail[0][:3] if tail else ""
    body = word[: len(word) - len(tail[0])] if tail else word
    case = "A" if body.isupper() and len(body) > 1 else "T" if body.istitle() else "a" if body.islower() else "0" if body.isdigit() else "-" if not body else "m"
    return f"{case}{min(len(body), 12) // 3}{end}"


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each word and of its shape."""
    known = _known
    if len(known) > 200_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) | zlib.crc32(_shape(w).encode()) << 32
    got = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return got & np.uint64(0xFFFFFFFF), got >> np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: hashed 1- and 2-grams of words, 1- to 3-grams of word shapes, repeated n-grams. Unit length."""
    words = text.split()
    if not words:
        return np.zeros(1, np.int64), np.ones(1)
    word, shape = _codes(words)
    one = np.uint64(1)
    grams = [word, word[:-1] * np.uint64(3) + word[1:] + one, shape ^ np.uint64(5), shape[:-1] * np.uint64(7) + shape[1:] + one, shape[:-2] * np.uint64(49) + shape[1:-1] * np.uint64(7) + shape[2:] + one]
    # How often a word, and a pair of words, has come before: repetition as n-grams of a small vocabulary.
    rates = []
    for k, g in enumerate(grams[:2]):
        if len(g):
            rates.append(1_000 * (k + 1) + int(20 * len(np.unique(g)) / len(g)))
    rates.append(5_000 + min(9, int(math.log2(len(words) + 1))))
    slots = (_mix(np.concatenate(grams)) >> np.uint64(64 - bits)).astype(np.int64)
    slots, n = np.unique(slots, return_counts=True)
    value = 1 + np.log(n)
    value *= 0.8 / math.sqrt(float(value @ value))
    extra = (_mix(np.array(rates, np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.concatenate([slots, extra]), np.concatenate([value, np.full(len(extra), 0.6 / math.sqrt(len(extra)))])


@dataclass
class Ftrl:
    """Follow-the-regularised-leader by coordinate; the last is the bias. Two arrays of 2**bits numbers are all its state."""

    bits: int = BITS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    z: np.ndarray = field(init=False)
    g2: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.g2 = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def _weights(self, i) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.g2[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, y: int, share: float) -> None:
        """One row, that counts share."""
        slots, values = np.concatenate([slots, [len(self.z) - 1]]), np.concatenate([values, [0.3]])
        w = self._weights(slots)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ values)))))
        g = (p - y) * share * values
        # np.add.at: two features of a row may share a slot.
        sigma = (np.sqrt(self.g2[slots] + g * g) - np.sqrt(self.g2[slots])) / self.alpha
        np.add.at(self.z, slots, g - sigma * w)
        np.add.at(self.g2, slots, g * g)

    def weights(self) -> np.ndarray:
        return self._weights(slice(None)).astype(np.float32)


def shares(ones: int, rows: int) -> dict[int, float]:
    """What a row of each label counts, so that both labels count alike."""
    return {1: rows / (2 * max(1, ones)), 0: rows / (2 * max(1, rows - ones))}


def held_out(doc_id):
    """Rows never learned from: crc32 of the doc_id as text, modulo 3, is 1. A null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, y, text) to (doc_id, h, y, slots, row_values), a row a batch, as one may be long."""
    for batch in batches:
        for i, h, y, text in zip(*batch.columns):
            slots, values = features(text.as_py() or "")
            made = slots.astype(np.int32).tobytes(), values.astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array([h.as_py()], pa.int64()), pa.array([y.as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in made)], names=["doc_id", "h", "y", "slots", "row_values"])


def _learned(batches: Iterator[pa.RecordBatch], share: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """Rows (epoch, y, slots, row_values) in the order to learn them to one row with the weights: a task holds the model and a batch."""
    model = Ftrl()
    for batch in batches:
        for y, slots, values in zip(*(batch.column(k) for k in (1, 2, 3))):
            y = y.as_py()
            model.learn(np.frombuffer(slots.as_buffer(), np.int32), np.frombuffer(values.as_buffer(), np.float32), y, share[y])
    yield pa.RecordBatch.from_arrays([pa.array([model.weights().tobytes()], pa.binary())], names=["weights"])


def sampled(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A written table of the rows to learn from: doc_id, h (a hash of the text), y, slots, row_values.

    The keys are chosen first; their number is bounded, so they are broadcast, and only the chosen texts are made into features, where they are read.
    """
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(order, "doc_id").limit(sample_rows)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"))
    keys = scratch.save(keyed.join(F.broadcast(chosen), "doc_id").distinct().orderBy(order, "doc_id", "h").limit(sample_rows), "keys")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = texts.join(F.broadcast(keys), ["doc_id", "h"]).select("doc_id", "h", "y", "text").mapInArrow(lambda b: trimmed(_featured(b), _forget), "doc_id long, h long, y int, slots binary, row_values binary")
    return scratch.save(found.dropDuplicates(["doc_id", "h"]), "features")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 3) -> np.ndarray:
    """Fit on at most sample_rows labelled rows that are not held out; labels with a null doc_id or quality are passed over.

    The sample's features are written; one task learns them as a stream, in an order seeded for each epoch, and holds the model and a
    batch, however long the rows; the driver gets the weights. Several labels of one
    doc_id count as their largest. Rows of docs that share a labelled doc_id are learned from each (equal ones once), but of all of them no more than
    sample_rows: those with the smallest md5 of their doc_id, then the smallest hash of their text. Null texts are learned as empty.
    Without labelled rows, as with empty tables, all weights are 0. Other columns, whatever their names, are not read.
    """
    bounded(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    found = sampled(docs, labels, scratch, sample_rows)
    rows, ones = found.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = shares(ones, rows)
    seeded = found.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).repartition(1).sortWithinPartitions("epoch", F.md5(F.concat_ws(":", "epoch", "doc_id", "h").cast("binary")))
    model = seeded.select("epoch", "y", "slots", "row_values").mapInArrow(lambda b: trimmed(_learned(b, share)), "weights binary").first()
    scratch.drop("keys", "features")
    return np.frombuffer(model.weights, np.float32) if model else Ftrl().weights()


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """A row (doc_id, score) for each row of docs: the probability of label 1 by a sparse dot product.

    A null text scores as empty. Very long texts count whole; repeated rows each have a row; an empty table has none. Other columns of docs,
    whatever their names, are not read.
    """
    bounded(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(sent.value, np.float32)
        for batch in batches:
            got = []
            for text in batch.column(1):
                slots, values = features(text.as_py() or "", bits)
                got.append(1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[slots] @ values + 0.3 * w[-1]))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: trimmed(run(b), _forget), SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, by a model fitted on rows of labels that are not held out.

    predicted is 1 from a score of 0.5 on, so also where it is exactly that. See train and score for nulls, repeated rows and the like.
    """
    scored = score(docs, train(docs, labels, sample_rows))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns, whatever their names, in one pass over the texts.

    Repeated rows stay or go alike; a null text is judged as an empty one, a long one whole. An empty table gives no rows.
    """
    bounded(docs.sparkSession)
    model = train(docs, labels, sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model.tobytes())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(sent.value, np.float32)
        for batch in batches:
            good = []
            for text in batch.column(at):
                slots, values = features(text.as_py() or "")
                good.append(float(w[slots] @ values + 0.3 * w[-1]) >= 0)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lambda b: trimmed(run(b), _forget), docs.schema)
