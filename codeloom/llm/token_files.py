"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first chunk of every id, level k the chunk k of those
that have one. Each level but the last has a bitmap that tells which ids go on, with a rank directory: the number of set bits
before each block of 512. The chunk of an id on the next level stands at the rank of its bit, so any token, and any run of
tokens, is read by as many look-ups as it has chunks, without decoding what lies before it.

A file also holds the doc_ids in it and where each document starts. Documents are in ascending order of doc_id over all files.
Files are objects of their own in a folder that the caller names; a reader opens one and reads the ranges it needs.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.batches import ROWS, bounded, dealt, given_back, joined_cuts, trimmed
from codeloom.llm.bpe import byte_symbols

MAGIC = b"DAC1"
BLOCK = 512
#: A file ends at the first document's end after so many tokens.
FILE_TOKENS = 1 << 20
END_ID = 0
CACHE_PIECES = 800_000
#: Characters that go through the library at once, or one longer text.
LIBRARY_CHARS = 200_000
#: Letters before this one are letters in every table of characters.
LATIN = "\u0250"

#: Fixed by the vocabulary's pre-tokenizer: its white space. Pieces begin at a space or a line end between two other characters,
#: whatever stands before or behind.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\x1c-\\x1f]")
_SPACES = re.compile(_SPACE.pattern + "{2}")
_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_OTHERS = _ASCII + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class DacWriter:
    @staticmethod
    def levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """(chunks, bitmap of those that go on) by level; the last level has no bitmap."""
        rest, out = np.asarray(ids, np.uint32), []
        while True:
            more = rest > 255
            if not more.any():
                return [*out, (rest.astype(np.uint8), None)]
            out.append(((rest & 255).astype(np.uint8), more))
            rest = rest[more] >> 8

    @classmethod
    def dump(cls, doc_ids: list[int | None], starts: list[int], ids: np.ndarray) -> bytes:
        found = cls.levels(ids)
        out = [MAGIC, struct.pack("<IQI", len(doc_ids), len(ids), len(found))]
        out.append(np.array([i is None for i in doc_ids], np.uint8).tobytes())
        out.append(np.array([i or 0 for i in doc_ids], "<i8").tobytes())
        out.append(np.array(starts, "<u8").tobytes())
        for chunks, more in found:
            out += [struct.pack("<QB", len(chunks), more is not None), chunks.tobytes()]
            if more is not None:
                bits = np.packbits(more, bitorder="little")
                pad = -len(more) % BLOCK
                rank = np.concatenate([[0], np.cumsum(np.pad(more, (0, pad)).reshape(-1, BLOCK).sum(axis=1))])
                out += [bits.tobytes(), rank.astype("<u8").tobytes()]
        return b"".join(out)


class DacReader:
    """A file's documents and tokens, by position. Of a file that is opened, only the ranges that a call needs are read."""

    def __init__(self, source: bytes | pa.NativeFile):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        head = self._at(0, 20)
        if head[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.docs, self.size, levels = struct.unpack_from("<IQI", head, 4)
        at = 20 + 17 * self.docs
        #: By level: where its chunks, bitmap and ranks begin, the last two only where ids go on.
        self.levels: list[tuple[int, int | None, int]] = []
        for _ in range(levels):
            n, more = struct.unpack("<QB", self._at(at, 9))
            chunks, bits = at + 9, at + 9 + n
            ranks = bits + (n + 7) // 8
            self.levels.append((chunks, bits if more else None, ranks))
            at = ranks + 8 * ((n + BLOCK - 1) // BLOCK + 1) if more else bits

    def _at(self, start: int, n: int) -> bytes:
        return self.source.read_at(n, start)

    def _numbers(self, start: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._at(start, n * np.dtype(kind).itemsize), kind)

    @property
    def doc_ids(self) -> list[int | None]:
        none, ids = self._numbers(20, self.docs, "u1"), self._numbers(20 + self.docs, self.docs, "<i8")
        return [None if n else i for n, i in zip(none.tolist(), ids.tolist())]

    @property
    def starts(self) -> np.ndarray:
        return self._numbers(20 + 9 * self.docs, self.docs, "<u8").astype(np.int64)

    def _rank(self, bits: int, ranks: int, i: int) -> int:
        """Set bits before i."""
        block = i // BLOCK
        start = block * BLOCK // 8
        part = np.unpackbits(self._numbers(bits + start, (i + 7) // 8 - start, "u1"), bitorder="little")[: i - block * BLOCK]
        return int(self._numbers(ranks + 8 * block, 1, "<u8")[0]) + int(part.sum())

    def token(self, i: int) -> int:
        """Token i, by one look-up a level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= self._at(chunks + i, 1)[0] << shift
            if bits is None or not self._at(bits + (i >> 3), 1)[0] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end: each level's run begins at the rank of its first."""
        out, at = np.zeros(end - start, np.uint32), None
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            got = self._numbers(chunks + start, end - start, "u1").astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out |= got
            else:
                out[at] |= got
            if bits is None or start == end:
                break
            low = start // 8
            more = np.unpackbits(self._numbers(bits + low, (end + 7) // 8 - low, "u1"), bitorder="little")[start - low * 8 : end - low * 8].astype(bool)
            start = self._rank(bits, ranks, start)
            end = start + int(more.sum())
            at = np.flatnonzero(more) if at is None else at[more]
        return out

    def document(self, k: int) -> np.ndarray:
        at = 20 + 9 * self.docs + 8 * k
        start, end = struct.unpack("<QQ", self._at(at, 16)) if k + 1 < self.docs else (*struct.unpack("<Q", self._at(at, 8)), self.size)
        return self.tokens(start, end)


def open_file(uri: str) -> DacReader:
    """The file of a manifest row, wherever pyarrow can read ranges: a shared folder, an object store, HDFS."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return DacReader(fs.open_input_file(path))


class PieceEncoder:
    """The tokenizers library's ids of whole texts, as unsigned integers of width bytes.

    A text is cut before its spaces and line ends, where the library's pre-tokenizer cuts too, and each distinct cut goes through
    the library once. Texts with special tokens, or with two white-space characters in a row, go through it whole.
    """

    def __init__(self, spec: str):
        # A task has one core; the library's own threads would take those of others.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.marks = [t["content"] for t in json.loads(spec).get("added_tokens") or []]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.line_id = self._ids(["\n"])[0]
        self.tails = {e: self._ids(["a" + e])[0][len(self._ids(["a"])[0]) :] for e in (",", ".")}
        self.known: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.id_bytes = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.symbols = str.maketrans(dict(enumerate(byte_symbols())))
        self.space = byte_symbols()[32]

    def _encodings(self, texts: list[str]) -> Iterator:
        """The library's results, for some texts at a time: it keeps over a hundred bytes a token in each."""
        k = 0
        while k < len(texts):
            start, size = k, 0
            while k < len(texts) and (size < LIBRARY_CHARS or k == start):
                size += len(texts[k])
                k += 1
            yield from self.tokenizer.encode_batch_fast(texts[start:k], add_special_tokens=False)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self._encodings(texts)]

    def _lines(self, words: list[str], most: int = 200) -> list[bytes]:
        """Ids of words without white space but for one space before them, as lines of some texts: a line end is one id of its own.

        One long text costs the library more a word than several of most lines.
        """
        groups = [words[k : k + most] for k in range(0, len(words), most)]
        line, w, out = int.from_bytes(self.line_id, "little"), self.width, []
        for group, e in zip(groups, self._encodings(["\n".join(g) for g in groups])):
            ids = np.array(e.ids, f"<u{w}")
            ends = np.flatnonzero(ids == line)
            if len(ends) != len(group) - 1:
                out += self._ids(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(w * (ends + 1)).tolist()], [*(w * ends).tolist(), len(raw)])]
        return out

    def _simple(self, text: str) -> bool:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return False
        for m in self.marks:
            if m in text:
                return False
        for c in _ASCII if text.isascii() else _OTHERS:
            if c in text:
                return not _SPACES.search(text)
        return True

    def _word(self, word: str) -> bytes:
        """Ids of a space and Latin letters, which the pre-tokenizer leaves whole."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.symbols)
        of = self.id_bytes
        return b"".join([of[t.id] for t in self.model.tokenize(self.space + word)])

    def _learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > CACHE_PIECES:
            # Cuts met early are the frequent ones.
            self.known = dict(islice(self.known.items(), CACHE_PIECES // 2))
        known, ends, word = self.known, self.tails, self._word
        plain, first, odd = [], [], []
        of, tokenize, space = self.id_bytes, self.model.tokenize, self.space
        for w in new:
            if w.isalpha() and w.isascii():
                known[w] = b"".join([of[t.id] for t in tokenize(space + w)])
                continue
            body, end = w[:-1], ends.get(w[-1:])
            if end is None:
                if w.isalpha() and max(w) < LATIN:
                    known[w] = word(w)
                    continue
            # A word's closing comma or full stop is a piece of its own, so words that differ by it alone are one.
            elif body.isalpha() and (body.isascii() or max(body) < LATIN):
                got = known.get(body)
                if got is None:
                    got = known[body] = word(body)
                known[w] = got + end
                continue
            if not w or _SPACE.search(w, 1) or w[0] != "\n" and _SPACE.match(w):
                odd.append(w)
            elif w[0] == "\n":
                (first if len(w) > 1 else odd).append(w)
            else:
                plain.append(w)
        known.update(zip(odd, self._ids([w if w[:1] == "\n" else " " + w for w in odd])))
        known.update(zip(plain, self._lines([" " + w for w in plain])))
        known.update(zip(first, [self.line_id + x for x in self._lines([w[1:] for w in first])]))

    def encoded(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (none null) as little-endian unsigned integers of width bytes."""
        rows = texts.to_pylist()
        odd = [k for k, t in enumerate(rows) if not self._simple(t)]
        # Simple texts hold no two line ends in a row, so these mark a text's first cut.
        lines = pc.binary_join_element_wise("\n\n", pc.replace_substring(texts, "\n", " \n"), "")
        joined = joined_cuts(pc.split_pattern(lines, " "), self._of)
        if not odd:
            return joined
        whole = pa.array(self._ids([rows[k] for k in odd]), pa.binary())
        at = np.arange(len(rows))
        at[odd] = len(rows) + np.arange(len(odd))
        return pa.concat_arrays([joined, whole]).take(pa.array(at))

    def _of(self, cuts: list[str]) -> list[bytes]:
        """Ids of distinct cuts. A text's first cut is like that of any other line; the line end's id is taken off again."""
        first = [k for k, c in enumerate(cuts) if c[:2] == "\n\n"]
        for k in first:
            cuts[k] = cuts[k][1:]
        got = list(map(self.known.get, cuts))
        gaps = [k for k, g in enumerate(got) if g is None]
        if gaps:
            self._learn({cuts[k] for k in gaps})
            for k in gaps:
                got[k] = self.known[cuts[k]]
        for k in first:
            got[k] = got[k][len(self.line_id) :]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encoded(pa.array(texts, pa.string())).to_pylist()


_LOADED: dict[int, PieceEncoder] = {}


def _encoder(spec: str) -> PieceEncoder:
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceEncoder(spec)
    return _LOADED[key]


def places(ids: np.ndarray, none: np.ndarray, spread: np.ndarray, bounds: np.ndarray, first: int) -> np.ndarray:
    """Places in order of id: the first for rows without one. What shares its id with several bounds, or has none, is split by spread (53 bits)."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    within = lambda n: (spread.astype(np.float64) / (1 << 53) * n).astype(np.int64)
    several = high - low > 1
    place = first + np.where(several, low + 1 + within(high - low), high)
    return np.where(none, within(np.full(len(ids), first)), place).astype(np.int32)


def _encoded(batches: Iterator[pa.RecordBatch], spec: str, bounds: np.ndarray, first: int, batch_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(spec)
    end_id = END_ID.to_bytes(encoder.width, "little")
    for batch in dealt(batches, 1, batch_chars):
        ids, spread = batch.column(0), pc.fill_null(batch.column(2), 0).to_numpy()
        place = places(pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), spread, bounds, first)
        found = encoder.encoded(pc.fill_null(batch.column(1).cast(pa.string()), ""))
        packed = pc.binary_join_element_wise(bytes([encoder.width]), found, end_id, b"")
        for k in range(0, len(batch), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(place[k : k + ROWS]), *(x.slice(k, ROWS) for x in (ids, batch.column(2), packed))], names=["place", "doc_id", "spread", "packed"])


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint32)


def _files(batches: Iterator[pa.RecordBatch], folder: str, file_tokens: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (place, doc_id) to files in a folder; a row (place, part, n_tokens, uri) for each."""
    # All texts are encoded by now; a worker that did so has no more use for the vocabulary and its cache.
    if _LOADED:
        _LOADED.clear()
        given_back()
    fs, top = pafs.FileSystem.from_uri(folder)
    place, part, docs, starts, held, size = None, 0, [], [], [], 0

    def done():
        name = f"{place:06d}-{part:06d}.dac"
        # Under its name a file is always whole, and another attempt of the task writes the same bytes.
        passing = f"{top}/_{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(passing) as out:
            out.write(DacWriter.dump(docs, starts, np.concatenate(held)))
        fs.move(passing, f"{top}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([f"{folder}/{name}"])], names=["place", "part", "n_tokens", "uri"])

    for batch in batches:
        for at, doc_id, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if docs and (at != place or size >= file_tokens):
                yield done()
                part = part + 1 if at == place else 0
                docs, starts, held, size = [], [], [], 0
            elif at != place:
                part = 0
            place = at
            ids = _unpack(packed)
            docs.append(doc_id)
            starts.append(size)
            held.append(ids)
            size += len(ids)
    if docs:
        yield done()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Manifest rows (uri, base) to (doc_id, start, n_tokens, ids_crc32); base is the number of ids in all files before."""
    for batch in batches:
        for uri, base in zip(*(c.to_pylist() for c in batch.columns)):
            file = open_file(uri)
            docs, starts = file.doc_ids, file.starts
            whole = memoryview(file.tokens(0, file.size).astype("<u4").tobytes())
            ends = [*starts[1:].tolist(), file.size]
            ids = [whole[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + base), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_files(docs: DataFrame, vocabulary: str, folder: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every whole text, end it with id 0 and write the files into a folder, an object each; gives their manifest.

    The manifest is a table (place, part, n_tokens, uri) in the folder's manifest; files stand in order of (place, part). folder is
    a URI that pyarrow can write (file://, s3://, gs://, hdfs://) and that all executors share. A null or empty text has the end
    id only; rows without a doc_id come first; rows that share a doc_id, or have none, stand in order of a hash of their texts, then of their ids' bytes, and
    where they are many they are split over several places. Columns of docs but doc_id and text, whatever their names, are not
    read. An empty table has no files. Memory is bounded by a file and the longest text.
    """
    spark = docs.sparkSession
    bounded(spark)
    with open(vocabulary, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    fs, top = pafs.FileSystem.from_uri(folder)
    fs.create_dir(top)
    # One bound a partition, as a range exchange has; it is drawn from the ids alone, so that no text is encoded twice.
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts, rows, named = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)], 10 * n), F.count("*"), F.count("doc_id")).first()
    bounds = np.array(cuts or [], np.int64)
    first = max(1, -(-n * (rows - named) // max(1, rows)))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read.withColumn("spread", F.shiftrightunsigned(F.xxhash64("text"), 11))
    encoded = read.mapInArrow(lambda b: trimmed(_encoded(b, spec.value, bounds, first)), "place int, doc_id long, spread long, packed binary")
    # Each place is a partition of its own.
    ordered = encoded.repartitionById(first + len(bounds) + 1, F.col("place")).sortWithinPartitions("place", "doc_id", "spread", "packed").select("place", "doc_id", "packed")
    files = ordered.mapInArrow(lambda b: trimmed(_files(b, folder, file_tokens)), "place int, part int, n_tokens long, uri string")
    files.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(files.schema).parquet(f"{folder}/manifest")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""
    wide = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # Sums before each place, of which there are as many as bounds; then before each file of a place.
    places = files.groupBy("place").agg(F.sum("n_tokens").alias("s")).select("place", F.coalesce(F.sum("s").over(wide), F.lit(0)).alias("before"))
    inner = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("place", "part", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("within")).join(places, "place")
    base = base.select("place", "part", (F.col("before") + F.col("within")).alias("base"))
    # A manifest is small however much its files hold, so its rows are dealt out: a task for a few files each.
    spread = max(1, min(files.count(), 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    read = files.join(base, ["place", "part"]).select("uri", "base").repartition(spread)
    return read.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
