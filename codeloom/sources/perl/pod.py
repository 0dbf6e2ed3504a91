"""POD: a text as its commands, each with what stands below it, and from these the first text of each documented name."""

from __future__ import annotations

import re
from dataclasses import dataclass

_COMMAND = re.compile(r"^(?==[a-z])", re.M)
_CODE = re.compile(r"[A-Z]<([^<>]*)>")
_WIDE_CODE = re.compile(r"[A-Z]<<+\s+(.*?)\s+>>+")
_NAME = re.compile(r"[A-Za-z_]\w*(?:::\w+)*")
_PARTS = re.compile(r"->|[$@%&]?\w+(?:::\w+)*|\S")
NAMING = frozenset("head1 head2 head3 head4 item".split())


@dataclass(frozen=True)
class Command:
    word: str
    title: str
    body: str
    line: int = 0


def commands(text: str) -> list[Command]:
    """All commands of a text, in order; a command's body ends where the next one begins."""
    found, line = [], 1
    for part in _COMMAND.split(text):
        if part.startswith("="):
            first, _, body = part.partition("\n")
            word, *title = first[1:].split(None, 1)
            found.append(Command(word, title[0].strip() if title else "", body.strip(), line))
        line += part.count("\n")
    return found


def plain(title: str) -> str:
    """A title without its formatting codes, the inner ones first."""
    title = _WIDE_CODE.sub(r"\1", title)
    while (less := _CODE.sub(r"\1", title)) != title:
        title = less
    return title


def docstrings(text: str) -> dict[str, str]:
    """Name to text: a heading or item names what its first word-like part says; the first text of a name counts."""
    found: dict[str, str] = {}
    for c in commands(text):
        if c.word in NAMING and c.body and (name := _NAME.search(plain(c.title))):
            found.setdefault(name[0], c.body)
    return found


def called(title: str) -> str | None:
    """The sub that a title shows a call of: method for `$object->method` or `Class->method`, name for `name(...)` at its start."""
    parts = _PARTS.findall(title)
    words, k = [], 0
    while k < len(parts):
        if len(parts[k]) == 1 and parts[k].isupper() and parts[k + 1 : k + 2] == ["<"]:
            k += 1  # a formatting code begins
            while parts[k : k + 1] == ["<"]:
                k += 1
            continue
        if parts[k] != ">":
            words.append(parts[k])
        k += 1
    named = lambda w: w[-1].isalnum() or w[-1] == "_"
    for before, arrow, name in zip(words, words[1:], words[2:]):
        if arrow == "->" and named(before) and before[0] not in "@%&" and named(name) and name[0] not in "$@%&":
            return name.partition("::")[0]
    return words[0] if words[1:2] == ["("] and re.fullmatch(r"\w+", words[0]) else None


def documented_calls(text: str) -> list[tuple[str, int]]:
    """Name and line of every sub that a heading below the first level, or an item, documents by a call of it."""
    titled = ((called(c.title), c.line) for c in commands(text) if c.word in NAMING and c.word != "head1")
    return [(name, line) for name, line in titled if name]
