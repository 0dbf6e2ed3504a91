"""Chat formatting by a grammar round trip.

A conversation is <s>, its turns, then nothing; a turn is

    user       [INST] text [/INST]
    assistant  [OUT] text </s>
    system     [SYS] text [/SYS]
    other      [ROLE] role [TEXT] text [/ROLE]

Each turn is rendered and reparsed by the deterministic parser that readers use. Where the parse differs from the source, because
the text holds a control string or something that reads as an escape, the text is escaped and the turn rendered again, until the
recovered role and text are identical. An escape is a backslash before the first character of a control string, or before
backslashes that stand there already, so text without conflicts stays as it is. The marks after a text begin with a space, which no
escaped control string follows, so the parser finds them by plain search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.batches import bounded

START, STOP = "<s>", "</s>"
FRAMES = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " " + STOP), "system": ("[SYS] ", " [/SYS]")}
OTHER, TEXT, END_OTHER = "[ROLE] ", " [TEXT] ", " [/ROLE]"

_CONTROL = [START, STOP, *(x.strip() for f in FRAMES.values() for x in f), OTHER.strip(), TEXT.strip(), END_OTHER.strip()]
_ANY = "|".join(re.escape(c) for c in sorted(set(_CONTROL), key=len, reverse=True))
#: What an escape can stand before; with its backslashes.
_ESCAPED = re.compile(rf"(\\*)({_ANY})")


def escape(text: str) -> str:
    """A backslash more before each control string, and those there doubled."""
    return _ESCAPED.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: (len(m[1]) - 1) // 2] + m[2] if len(m[1]) % 2 else m[0], text)


def parse_turn(text: str, at: int) -> tuple[str, str, int, int, int] | None:
    """The turn that begins at a place: role and text as they were, where the text stands, where the turn ends."""
    for role, (left, right) in FRAMES.items():
        if text.startswith(left, at):
            start = at + len(left)
            end = text.find(right, start)
            return None if end < 0 else (role, unescape(text[start:end]), start, end, end + len(right))
    if not text.startswith(OTHER, at):
        return None
    start = text.find(TEXT, at + len(OTHER))
    end = -1 if start < 0 else text.find(END_OTHER, start + len(TEXT))
    if end < 0:
        return None
    return unescape(text[at + len(OTHER) : start]), unescape(text[start + len(TEXT) : end]), start + len(TEXT), end, end + len(END_OTHER)


def render_turn(role: str, text: str) -> str:
    """A turn that parses to exactly this role and text."""
    for r, t in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        left, right = FRAMES.get(role) or (OTHER + r + TEXT, END_OTHER)
        made = left + t + right
        got = parse_turn(made, 0)
        if got and (got[0], got[1], got[4]) == (role, text, len(made)) and not _strays(t):
            return made
    raise ValueError("the template can't carry this turn")


def _strays(body: str) -> bool:
    """Whether a control string stands unescaped in a body, which a parser of whole conversations might take for its own."""
    return any(len(m[1]) % 2 == 0 for m in _ESCAPED.finditer(body))


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """All turns of a formatted conversation: role, text, and the place of the formatted text."""
    if not text.startswith(START):
        raise ValueError("a conversation starts with " + START)
    at, found = len(START), []
    while at < len(text):
        got = parse_turn(text, at)
        if got is None:
            raise ValueError(f"no turn at {at}")
        found.append(got[:4])
        at = got[4]
    return found


def _format(batches: Iterator[pa.RecordBatch], piece_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, none, turn, role, text) in order to pieces (conv_id, none, part, formatted), cut between turns."""
    now, part, held, size, first = None, 0, [], 0, True

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([part], pa.int64()), pa.array(["".join(held)], pa.string())], names=["conv_id", "part", "formatted"])

    rows: list[pa.RecordBatch] = []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if now is None or now[0] != conv:
                if held:
                    rows.append(piece())
                now, part, held, size = (conv,), 0, [START], len(START)
            elif size >= piece_chars:
                rows.append(piece())
                part, held, size = part + 1, [], 0
            made = render_turn(role or "", text or "")
            held.append(made)
            size += len(made)
            if len(rows) >= 500 or rows and size > 1_000_000:
                yield from rows
                rows = []
    if held:
        rows.append(piece())
    yield from rows


def format_conversations(conversations: DataFrame, piece_chars: int = 1_000_000) -> DataFrame:
    """conv_id, part, formatted: each conversation's turns in order, in pieces of about piece_chars cut between turns.

    Turns are ordered by turn (null first), role, text; null roles and texts count as empty; repeated rows are turns of their
    own; rows without a conv_id are one conversation. Conversations stream through: memory is bounded by a piece and the
    longest text. A conversation's turns are in order and its digests are sums over all of them, so it is one task's, however long.
    An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    bounded(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda b: _format(b, piece_chars), "conv_id long, part long, formatted string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []

    def done():
        out.append((now["conv"], now["n"], now["turns"].hexdigest(), now["loss"], now["mask"].hexdigest(), now["chars"]))

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv, formatted in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if now is None or now["conv"] != conv:
                if now:
                    done()
                now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "mask": hashlib.sha256(), "chars": 0}
                turns = parse(formatted)
            else:
                turns = parse(START + formatted)
            now["chars"] += len(formatted)
            for role, text, _, _ in turns:
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == "assistant":
                    # The loss mask covers the assistant's texts and nothing of the template.
                    now["loss"] += len(text)
                    now["mask"].update(text.encode("utf-8", "surrogatepass"))
        if len(out) >= 2_000:
            yield batch_of(out)
            out.clear()
    if now:
        done()
    if out:
        yield batch_of(out)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations, by parsing them."""
    ordered = formatted.select("conv_id", "part", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
