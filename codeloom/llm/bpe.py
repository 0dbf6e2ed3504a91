"""BPE encoding and decoding by a prefix-sharing trie.

Texts are cut at spaces, and the words of the distinct cuts of a batch are inserted into a trie in sorted order, so that its nodes arrive depth first. A node's state
is the last token of the encoding of its prefix: the one token t that ends there and is compatible with the state at the node
len(t) symbols above. A prefix that many words share is therefore encoded once, and a word's ids are read off by walking
states back to the root.

Two tokens are compatible when merging their symbols by the merge list gives exactly those two tokens again; a token sequence
is the encoding of its symbols if and only if each neighbouring pair is compatible.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.batches import ROWS, bounded, dealt, given_back, joined_cuts, trimmed

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
#: Distinct cuts (what stands between spaces), and distinct words, whose encodings a worker keeps between batches.
CACHE_CUTS = 200_000
CACHE_WORDS = 100_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in kept}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(kept)))
    return [names[b] for b in range(256)]


def _unassigned() -> str:
    """A character class of what the regex module takes for letters or digits and the library, with other tables, doesn't."""
    from tokenizers import Regex, pre_tokenizers

    letter, out = regex.compile(r"[\p{L}\p{N}]"), []
    new = [chr(c) for c in range(0x80, 0x40000) if unicodedata.category(chr(c)) == "Cn" and letter.match(chr(c))]
    pieces = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "isolated").pre_tokenize_str("!".join(new))
    known = {p for p, _ in pieces if len(p) == 1}
    for c in (ord(x) for x in new if x not in known):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) or "\\U0010fffe"


class TrieBpe:
    """One vocabulary with an end-of-word suffix, lower case, white space dropped."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.text_of = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.rank = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), (n, vocab[a + b]))
        names = byte_symbols()
        code = {c: b for b, c in enumerate(names)}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.symbols: dict[int, list[int]] = {}
        self.length: dict[int, int] = {}
        for s, i in vocab.items():
            last = bool(self.suffix) and s.endswith(self.suffix)
            body = s[: -len(self.suffix)] if last else s
            raw = bytes(code[c] for c in body)
            atoms = [vocab[names[b]] for b in raw]
            if last:
                atoms[-1] = vocab[names[raw[-1]] + self.suffix]
            if self._merge(atoms) == [i]:
                (self.final if last else self.inner)[raw] = i
                self.symbols[i], self.length[i] = atoms, len(raw)
        self.longest, self.longest_final = max(map(len, self.inner)), max(map(len, self.final))
        # All inner tokens that end at a place, found in one pass over a word; bytes stand as the characters of those numbers.
        self.find = ahocorasick.Automaton()
        for raw, i in self.inner.items():
            self.find.add_word(raw.decode("latin-1"), (len(raw), i))
        self.find.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.cuts: dict[str, bytes] = {}
        self.tokens = pa.array([self.text_of.get(i, "") for i in range(max(self.text_of) + 1)], pa.string())
        rules = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        self.pieces = regex.compile(rules[0])
        odd = _unassigned()
        self.odd = re.compile(f"[{odd}]")
        self.odd_pieces = regex.compile("(?V1)" + rules[0].replace("[^\\s\\p{L}\\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{odd}]]").replace("[\\p{L}]", f"[\\p{{L}}--[{odd}]]").replace("[\\p{N}]", f"[\\p{{N}}--[{odd}]]"))
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def _merge(self, ids: list[int]) -> list[int]:
        """Plain merging: the lowest rank first, the leftmost of equals."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def _fit(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 400_000:
                self.fits.clear()
            got = self.fits[key] = self._merge(self.symbols[a] + self.symbols[b]) == [a, b]
        return got

    def _final(self, raw: bytes, states: list[int]) -> int:
        """The last token of the encoding of a word whose shorter prefixes have their states."""
        n = len(raw)
        for start in range(max(0, n - self.longest_final), n):
            t = self.final.get(raw[start:])
            if t is not None and (start == 0 or self._fit(states[start], t)):
                return t
        raise ValueError("the vocabulary lacks a symbol")

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of distinct non-empty words, by one depth-first walk over their trie."""
        states: list[int] = [0]
        above = b""
        length, find, fits = self.length, self.find.iter, self.fits
        for word in sorted(words):  # the order of code points is that of their bytes
            raw = word.encode()
            body = raw[:-1]
            shared = 0
            for x, y in zip(above, body):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :]
            if len(body) > shared:
                states += [-1] * (len(body) - shared)
                base = max(0, shared + 1 - self.longest)
                for end, (size, t) in find(body[base:].decode("latin-1")):
                    depth = base + end + 1
                    if depth > shared and states[depth] < 0:
                        start = depth - size
                        if start:
                            fit = fits.get(states[start] << 20 | t)
                            if fit is None:
                                fit = self._fit(states[start], t)
                            if not fit:
                                continue
                        states[depth] = t
            above = body
            t = self._final(raw, states)
            ids, at = [t], len(raw) - length[t]
            while at:
                t = states[at]
                ids.append(t)
                at -= length[t]
            ids.reverse()
            yield word, ids

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            # Words met early are the frequent ones.
            self.known = dict(islice(self.known.items(), CACHE_WORDS // 2)) | {w: self.known[w] for w in words if w in self.known}
        for word, ids in self.encode_words(new):
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token's string stays one word, with a zero byte before it."""
        if self.marks is None or "<|" not in text and not self.marks.search(text):
            return self._words(text)
        found = []
        for part in self.marks.split(text):
            if part in self.special:
                found.append("\0" + part)
            elif part:
                found += self._words(part)
        return found

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.odd.search(text):
                return self.odd_pieces.findall(text.lower())
        # \x1c-\x1f are no white space to the vocabulary's rules, and so belong to words.
        return self.pieces.findall(text.lower())

    def _of(self, cuts: list[str]) -> list[bytes]:
        """Ids of distinct cuts. No word and no special token holds a space, so each cut is encoded for itself."""
        got = list(map(self.cuts.get, cuts))
        gaps = [k for k, g in enumerate(got) if g is None]
        if not gaps:
            return got
        # Plain letters are one word.
        words = [[c.lower()] if (c := cuts[k]).isascii() and c.isalpha() else self.split(c) for k in gaps]
        distinct: set[str] = set()
        for w in words:
            distinct.update(w)
        marks = {w for w in distinct if w[0] == "\0" and w[1:] in self.special}
        self.learn(distinct - marks)
        known = self.known
        for w in marks:
            known[w] = self.special[w[1:]].to_bytes(4, "little")
        for k, w in zip(gaps, words):
            got[k] = known[w[0]] if len(w) == 1 else b"".join([known[x] for x in w])
        if len(self.cuts) + len(gaps) > CACHE_CUTS:
            self.cuts = dict(islice(self.cuts.items(), CACHE_CUTS // 2))
        self.cuts.update(zip([cuts[k] for k in gaps[: CACHE_CUTS // 2]], [got[k] for k in gaps]))
        return got

    def encoded(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (none null) as little-endian unsigned 32-bit integers."""
        return joined_cuts(pc.split_pattern(texts, " "), self._of)

    def decoded(self, ids: pa.Array) -> pa.Array:
        """The text of each row of ids; without a decoder in the vocabulary file, tokens stand apart by one space."""
        width = np.diff(np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)) // 4 if len(ids) else np.zeros(0, np.int32)
        raw = np.frombuffer(ids.buffers()[2], np.uint32, int(width.sum()), int(np.frombuffer(ids.buffers()[1], np.int32, 1, 4 * ids.offset)[0])) if width.sum() else np.zeros(0, np.uint32)
        each = self.tokens.take(pa.array(raw))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), each), " ")

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """Per text: number of ids, ids as little-endian unsigned 32-bit integers, decoded text."""
        ids = self.encoded(pa.array(texts, pa.string()))
        return [(len(i) // 4, i, t) for i, t in zip(ids.to_pylist(), self.decoded(ids).to_pylist())]

    def decode(self, ids: bytes) -> str:
        return " ".join([self.text_of[int.from_bytes(ids[k : k + 4], "little")] for k in range(0, len(ids), 4)])


_LOADED: dict[int, TrieBpe] = {}


def loaded(spec: str) -> TrieBpe:
    """A worker's one copy of a vocabulary."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TrieBpe(json.loads(spec))
        given_back()  # what the parsed file took
    return _LOADED[key]


def encode_decode(docs: DataFrame, vocabulary: str, batch_chars: int = 4_000_000) -> DataFrame:
    """Encode and decode every whole text.

    docs has doc_id and text; other columns are ignored. Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit) and
    decoded, a row for each row of docs, repeated rows included. A null or empty text has no ids and decodes to the empty
    text; a null doc_id stays null. Memory is bounded by batch_chars and the longest text.

    vocabulary is a path the driver can read; its content (a few MB, whatever the corpus) is broadcast.
    """
    bounded(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in dealt(batches, 1, batch_chars):
            ids = bpe.encoded(pc.fill_null(batch.column(1).cast(pa.string()), ""))
            n = pc.divide(pc.binary_length(ids), 4).cast(pa.int64())
            decoded = bpe.decoded(ids)
            for k in range(0, len(batch), ROWS):
                yield pa.RecordBatch.from_arrays([x.slice(k, ROWS) for x in (batch.column(0), n, ids, decoded)], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: trimmed(run(b)), SCHEMA)
