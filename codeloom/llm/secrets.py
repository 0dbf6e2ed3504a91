"""Secret scans: three fixed patterns, and a linear-chain conditional random field over tokens decoded by Viterbi.

A token is a run of [A-Za-z0-9+/_.=~-]. The chain tags it as begin, inside or outside of a secret from its shape, the words and
punctuation beside it and features of the whole text. Structural zeros hold begin and inside to tokens of LEAST characters or more
that have a digit or follow a word that names secrets, and to all of LONG characters or more; every other token is outside, so that
the chain falls into independent runs of such tokens and is decoded exactly without walking through all the prose between them.

The field is fitted by gradient ascent on the log-likelihood of a fixed, seeded set of made-up lines, so it needs no labelled
secrets and is the same in every run.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.batches import bounded

SCHEMA = "doc_id long, kinds array<string>, starts array<int>, ends array<int>"

# The base patterns, in this order of kinds.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")

RUN = "A-Za-z0-9+/_.=~-"
_DIGIT = re.compile(rf"[0-9][{RUN}]*", re.A)
_BEFORE = re.compile(rf"[{RUN}]*\Z", re.A)
_WORDS = re.compile(r"[A-Za-z_]+", re.A)
LEAST, LONG = 6, 16
_LONG_RUN = re.compile(rf"[{RUN}]{{{LONG},}}", re.A)
NAMES = ("passw", "passphrase", "pwd", "secret", "token", "key", "authorization", "bearer", "credential")
_NAMED = re.compile(rf"(?:{'|'.join(NAMES)})[A-Za-z]{{0,6}}[\"']?[ \t]*(?:[:=][ \t]*)?[\"']?(?=[{RUN}]{{{LEAST}}})", re.I | re.A)
_RUN = re.compile(rf"[{RUN}]*", re.A)
TAGS = ("O", "B", "I")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost non-overlapping matches per kind, those too short dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in BASE[0][1].finditer(text) if len(m[2]) >= 6]
    # A run either is long enough or fails whole, so asking for the length at once finds the same.
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _LONG_ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens of LEAST characters or more that have a digit or follow one of NAMES, and all of LONG characters or more."""
    found, at = {(m.start(), m.end()) for m in _LONG_RUN.finditer(text)}, 0
    inside = lambda c: c.isascii() and (c.isalnum() or c in "+/_.=~-")
    while m := _DIGIT.search(text, at):
        start = m.start()
        while start > at and inside(text[start - 1]):
            start -= 1
        if m.end() - start >= LEAST:
            found.add((start, m.end()))
        at = m.end()
    low = text.lower()
    if any(k in low for k in NAMES):
        for m in _NAMED.finditer(text):
            start, end = m.end(), _RUN.match(text, m.end()).end()
            while start and inside(text[start - 1]):
                start -= 1
            if start != m.start() or "=" in text[start:end]:  # not the name alone
                found.add((start, end))
    return sorted(found)


def _shape(token: str) -> str:
    out = []
    for c in token:
        s = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:6]) if len(out) <= 6 else f"mix{min(len(out) // 4, 6)}"


def token_features(text: str, start: int, end: int, file: tuple[str, ...]) -> list[str]:
    """Shape, neighbours and file features of the token at a place."""
    token = text[start:end]
    n = len(token)
    counts = Counter(token)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digits = sum(c.isdigit() for c in token)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    before, after = text[max(0, start - 40) : start], text[end : end + 24]
    words = _WORDS.findall(before)[-2:]
    mark = before.rstrip(" \"'")[-1:]
    return [
        "bias", f"shape={_shape(token)}", f"len={min(n // 4, 10)}", f"ent={int(entropy * 2)}", f"dig={int(10 * digits / n)}", f"chg={min(changes, 12) // 2}",
        f"hex={all(c in '0123456789abcdefABCDEF' for c in token)}", f"cap={token.isupper()}", f"alnum={token.isalnum()}", f"num={digits + sum(c in '+-./' for c in token) == n}",
        f"pre={token[:3].lower()}", f"mark={mark if mark in '=:' else 'w'}", f"quote={before[-1:] in tuple('\"' + chr(39))}", f"slash={token.count('/') > 1}", f"dots={min(token.count('.'), 3)}", f"at={'@' in before[-24:] + after[:1]}",
        f"own={'=' in token[:-1] and any(k in token.partition('=')[0].lower() for k in NAMES)}",
        f"next={after[:1] if after[:1] in tuple(' @:/,.;)' + chr(34) + chr(39)) else 'o'}",
        *(f"w-{k}={w.lower()[:12]}" for k, w in enumerate(reversed(words))), *file,
    ]


def file_features(text: str, n: int) -> tuple[str, ...]:
    low = text[:0] if not n else text.lower()
    return (f"keys={any(k in low for k in ('password', 'secret', 'token', 'api', 'credential'))}", f"many={min(n, 8) // 2}", f"code={'{' in low or ';' in low}")


class Field:
    """Weights of features by tag, and of neighbouring tags. Inside can follow begin and inside only."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.emit = np.zeros((0, 3))
        self.step = np.zeros((3, 3))
        self.bar = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])

    def scores(self, row: list[list[str]]) -> np.ndarray:
        get = self.names.get
        out = np.zeros((len(row), 3))
        for k, names in enumerate(row):
            ids = [i for i in map(get, names) if i is not None]
            out[k] = self.emit[ids].sum(axis=0)
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of a run; the token before it, like the one after, is outside."""
        step = self.step + self.bar
        best, back = scores[0] + step[0], []
        for s in scores[1:]:
            all_ = best[:, None] + step
            back.append(all_.argmax(axis=0))
            best = all_.max(axis=0) + s
        tags = [int((best + step[:, 0]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def fit(self, rows: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.3, ridge: float = 1e-3) -> Field:
        for names, _ in rows:
            for token in names:
                for f in token:
                    self.names.setdefault(f, len(self.names))
        self.emit = np.zeros((len(self.names), 3))
        g_emit, g_step = np.full(self.emit.shape, 1e-6), np.full((3, 3), 1e-6)
        ids = [[[self.names[f] for f in token] for token in names] for names, _ in rows]
        for epoch in range(epochs):
            for r in np.random.default_rng(epoch).permutation(len(rows)):
                feats, tags = ids[r], rows[r][1]
                _, d_emit, d_step = self.likelihood(np.stack([self.emit[f].sum(axis=0) for f in feats]), tags)
                for f, d in zip(feats, d_emit):
                    d = d - ridge * self.emit[f]
                    g_emit[f] += d * d
                    self.emit[f] += rate * d / np.sqrt(g_emit[f])
                g_step += d_step * d_step
                self.step += rate * d_step / np.sqrt(g_step)
        return self

    def likelihood(self, scores: np.ndarray, tags: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of a run's tags, and its gradients by the scores and by the weights of neighbouring tags (forward-backward)."""
        log_sum = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        n, step = len(tags), self.step + self.bar
        fwd, bwd = np.zeros((n, 3)), np.zeros((n, 3))
        fwd[0] = scores[0] + step[0]
        for k in range(1, n):
            fwd[k] = scores[k] + log_sum(fwd[k - 1][:, None] + step, 0)
        bwd[-1] = step[:, 0]
        for k in range(n - 2, -1, -1):
            bwd[k] = log_sum(step + scores[k + 1] + bwd[k + 1], 1)
        total = log_sum(fwd[-1] + bwd[-1], 0)
        d_scores, d_step, before, value = -np.exp(fwd + bwd - total), np.zeros((3, 3)), 0, -total
        d_step[0] += d_scores[0]
        d_step[:, 0] += d_scores[-1]
        for k, t in enumerate(tags):
            d_scores[k, t] += 1
            d_step[before, t] += 1
            value += scores[k, t] + step[before, t]
            if k:
                d_step -= np.exp(fwd[k - 1][:, None] + step + scores[k] + bwd[k] - total)
            before = t
        d_step[before, 0] += 1
        return float(value + step[before, 0]), d_scores, d_step


def _made_up(seed: int, lines: int) -> list[tuple[str, list[tuple[int, int, bool]]]]:
    """Lines with (start, end, whether it begins) of their secrets' tokens."""
    rng = random.Random(seed)
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, 2, 9)
    sure = lambda f: next(t for t in iter(f, None) if any(c.isdigit() for c in t))
    secrets = (
        lambda: sure(lambda: pick("0123456789abcdef", 16, 64)), lambda: "AKIA" + sure(lambda: pick(up + dig, 16, 16)), lambda: "ghp_" + sure(lambda: pick(low + up + dig, 36, 36)),
        lambda: sure(lambda: pick(low + up + dig + "+/", 20, 60)) + rng.choice(("", "=", "==")), lambda: "sk-" + sure(lambda: pick(low + up + dig, 20, 48)), lambda: sure(lambda: pick(low + up + dig, 16, 40)),
        lambda: "eyJ" + sure(lambda: pick(low + up + dig + "_-", 20, 60)) + "." + pick(low + up + dig + "_-", 20, 60), lambda: "xoxb-" + pick(dig, 10, 12) + "-" + pick(low + up + dig, 20, 24),
    )
    names = ("password", "token", "api_key", "secret", "key", "Authorization", "bearer", "credential", "pwd", "passphrase", "private key", "auth_token", "client_secret")
    # These only where a name and a mark stand before them.
    weak = (lambda: pick(low, 6, 15), lambda: pick(low + up, 6, 15), lambda: pick(low + up + dig, 6, 9), lambda: "-".join(word() for _ in range(4)))
    said = (lambda: sure(lambda: pick(low + dig, 8, 14)), lambda: sure(lambda: pick(low + up + dig, 7, 12)))
    secrets += (lambda: pick(low + up, 20, 48), lambda: pick(low + up + "+/", 24, 60) + rng.choice(("", "=", "==")))
    plain = (
        lambda: f"{rng.randint(1980, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"+{rng.randint(1, 99)}-{pick(dig, 3, 3)}-{pick(dig, 3, 3)}-{pick(dig, 4, 4)}", lambda: pick(dig, 6, 16), lambda: pick(low, 16, 20), lambda: pick(low, 14, 24).title(), lambda: "-".join(word() for _ in range(4)), lambda: f"https://{word()}.com/{word()}/{word()}", lambda: f"{rng.choice(names)} {word()} {word()}", lambda: f"{rng.choice(names)} {pick(low, 6, 12)}", lambda: f"{rng.choice(names)} {pick(low, 6, 9)} {pick(low, 6, 9)}", lambda: f"{rng.choice(names)}s {word()} {pick(low, 6, 9)}", lambda: f"{word()} {rng.choice(('is', 'was', 'for', 'and'))} {pick(low, 16, 26)}.", lambda: f"{word()}. {word().title()} {rng.choice(('is', 'was'))} {pick(low, 16, 24)}",
        lambda: f"{word()}({word()}_{rng.randint(1, 99)}, {word()}[{rng.randint(0, 9)}]);", lambda: f"{word().title()}{word().title()}{word().title()}({word()})", lambda: f"{pick(low, 2, 5)}.{word()}.{word()}_{word()}.{word()}()", lambda: f"{word()}_{word()}_{word()}_{word()}", lambda: "=" * rng.randint(6, 40), lambda: "-" * rng.randint(6, 40), lambda: f"{rng.choice(names)} {rng.choice(('is', 'was', 'of', 'for'))} {rng.choice(('lost', 'the', 'a', 'missing', 'rotated', 'required', 'invalid', 'expired'))} {word()}",
        lambda: f"{word()}.{word()}{rng.randint(1, 999)}", lambda: f"{word()}{rng.randint(1, 99)}{word()}", lambda: f"/{word()}/{word()}/{rng.randint(1, 9999)}.html", lambda: f"v{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 200)}-rc{rng.randint(1, 9)}",
        lambda: f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}", lambda: f"{word().title()}-{rng.randint(1000, 99999)}", lambda: f"{pick(dig, 1, 3)}.{pick(dig, 3, 3)}.{pick(dig, 3, 3)}", lambda: f"{word()}_{word()}_{rng.randint(1, 999)}", lambda: f"ISBN-{pick(dig, 13, 13)}",
    )
    out = []
    for _ in range(lines):
        text, spans = "", []
        for _ in range(rng.randint(2, 5)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice((" ", ", ", ". "))
            if rng.random() < 0.45:
                named = rng.random() < 0.6
                left = rng.choice(names) + rng.choice(("=", "=", ": ", " = \"", "='", ": '", " ", " is ", " was ", " => ", ":")) if named else ""
                many = 2 if rng.random() < 0.1 else 1
                text += left
                for k in range(many):
                    short = weak if left.strip() != left.rstrip("=: '\"") else said if left.endswith(("is ", "was ")) else ()
                    t = rng.choice(short if short and rng.random() < 0.5 else secrets)()
                    spans.append((len(text), len(text) + len(t), k == 0))
                    text += t + (" " if k + 1 < many else "")
                text += left[-1:] if left[-1:] in "\"'" else ""
                text += " "
            else:
                text += rng.choice(("", "", "tel ", "id: ", "see ", "order=", "on ")) + rng.choice(plain)() + rng.choice((" ", ", ", "@example.com "))
        out.append((text, spans))
    return out


def _runs(text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Tokens that stand beside each other but for white space, quotes and commas; any other token between them is outside."""
    runs: list[list[tuple[int, int]]] = []
    for t in tokens:
        if runs and not text[runs[-1][-1][1] : t[0]].strip(" \t\r\n\"',"):
            runs[-1].append(t)
        else:
            runs.append([t])
    return runs


@lru_cache(maxsize=1)
def fitted(seed: int = 11, lines: int = 1_500) -> Field:
    """The field; fitted once a process."""
    rows = []
    for text, spans in _made_up(seed, lines):
        tokens = candidates(text)
        file = file_features(text, len(tokens))
        tag = {t: 0 for t in tokens}
        for start, end, begins in spans:
            for t in tokens:
                if t[0] < end and start < t[1]:
                    tag[t] = 1 if begins else 2
        for run in _runs(text, tokens):
            tags = [tag[t] for t in run]
            tags = [1 if t == 2 and (k == 0 or tags[k - 1] == 0) else t for k, t in enumerate(tags)]
            rows.append(([token_features(text, *t, file) for t in run], tags))
    return Field().fit(rows)


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Secrets that the field finds: from each begin to the last inside after it."""
    tokens = candidates(text)
    if not tokens:
        return []
    file = file_features(text, len(tokens))
    found: list[tuple[int, int]] = []
    for run in _runs(text, tokens):
        for t, tag in zip(run, field.viterbi(field.scores([token_features(text, *t, file) for t in run]))):
            if tag == 1:
                found.append(t)
            elif tag == 2:
                found[-1] = (found[-1][0], t[1])
    return found


def spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """All spans in order of start, then kind. The field's own are those that no base span touches."""
    base = base_spans(text)
    more = [(s, e, "crf") for s, e in field_spans(text, field) if all(e <= a or b <= s for a, b, _ in base)]
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans' kinds, starts and ends (code points, end exclusive) of each row of docs.

    Null and empty texts have none. Very long texts count whole; repeated rows each have a row; an empty table has none. Of spans
    that start together the kind as listed in KINDS comes first. Other columns of docs, whatever their names, are not read.
    """
    bounded(docs.sparkSession)
    field = fitted()
    sent = docs.sparkSession.sparkContext.broadcast((field.names, field.emit, field.step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field()
        own.names, own.emit, own.step = sent.value
        for batch in batches:
            found = [spans(t.as_py() or "", own) for t in batch.column(1)]
            lists = ([[s[2] for s in f] for f in found], [[s[0] for s in f] for f in found], [[s[1] for s in f] for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(k)) for x, k in zip(lists, (pa.string(), pa.int32(), pa.int32())))], names=["doc_id", "kinds", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of scanned rows."""
    kind = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    each = F.zip_with("kinds", F.arrays_zip("starts", "ends"), lambda k, p: F.concat_ws(":", k, p["starts"].cast("string"), p["ends"].cast("string")))
    base = F.concat_ws(",", F.filter(each, lambda x: ~x.startswith("crf:")))
    return found.select("doc_id", kind("assign"), kind("access"), kind("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", each).alias("spans"))
