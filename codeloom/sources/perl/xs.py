"""XS: packages, and the functions that C code gives them.

A file is cut into sections at its MODULE and PACKAGE headers, a section into paragraphs at blank lines. A paragraph defines at
most one function: a name with an argument list at a line's start, under a line that can be a return type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# Section words that look like functions.
_SECTIONS = frozenset("CODE PPCODE OUTPUT INPUT INIT PREINIT POSTCALL CLEANUP BOOT ALIAS PROTOTYPE OVERLOAD INTERFACE INTERFACE_MACRO SCOPE C_ARGS REQUIRE VERSIONCHECK".split())
_HEADER = re.compile(r"^[ \t]*(?:MODULE|PACKAGE)[ \t]*=.*$", re.M)
_SETTING = re.compile(r"\b(MODULE|PACKAGE|PREFIX)\s*=\s*(\S+)")
_PARAGRAPH = re.compile(r"(?:^.*\S.*$\n?)+", re.M)
_SIGNATURE = re.compile(r"^(?P<type>[A-Za-z_][\w:*& \t]*)\n(?P<name>[A-Za-z_]\w*)[ \t]*\(", re.M)


def _sections(text: str) -> Iterator[tuple[str, str, int, int, int]]:
    """Package, prefix, and where the header and the section's text begin and end. What stands before the first MODULE is C."""
    headers = [(m, dict(_SETTING.findall(m[0]))) for m in _HEADER.finditer(text)]
    while headers and "MODULE" not in headers[0][1]:
        headers.pop(0)
    ends = [m.start() for m, _ in headers[1:]] + [len(text)]
    for (m, said), end in zip(headers, ends):
        package = said.get("PACKAGE") or said.get("MODULE")
        if package:
            yield package, said.get("PREFIX", ""), m.start(), m.end(), end


def functions(text: str) -> tuple[dict[str, int], list[tuple[str, str, int]]]:
    """(package to its line, [(package, name, line)])."""
    line = lambda at: text.count("\n", 0, at) + 1
    packages: dict[str, int] = {}
    found = []
    for package, prefix, header, start, end in _sections(text):
        packages.setdefault(package, line(header))
        for paragraph in _PARAGRAPH.finditer(text, start, end):
            defined = (m for m in _SIGNATURE.finditer(text, paragraph.start(), paragraph.end()) if m["name"] not in _SECTIONS and not m["type"].rstrip().endswith(":"))
            if m := next(defined, None):
                found.append((package, m["name"].removeprefix(prefix), line(m.start("name"))))
    return packages, found
