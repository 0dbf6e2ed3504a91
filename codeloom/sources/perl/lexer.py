"""A tolerant lexer: source text to a flat list of tokens with matched brackets. It never fails; what it can't read is an operator."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

OPEN = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: Words after which a slash begins a pattern, and that are no calls themselves.
KEYWORDS = frozenset("if unless while until for foreach when given else elsif return my our local state and or not xor eq ne lt gt le ge cmp x do eval last next redo goto package use no sub method class role field try catch finally defer default continue isa BEGIN END".split())
_TERM_AFTER = KEYWORDS | frozenset("print say push unshift split grep map join die warn".split())
_QUOTES = frozenset("q qq qw qr qx m s tr y".split())
_WORD = re.compile(r"(?:::)?[A-Za-z_]\w*(?:(?:::|')(?=[A-Za-z_])[A-Za-z_]\w*)*(?:::)?")
_VAR = re.compile(r"[$@%&](?:\^\w|::)?(?:[A-Za-z_]\w*(?:::\w+)*|\d+)|\$(?:[!&`'+@/\\,;.0_\"$<>\[\]:?|~^-](?!\w)|#\{|#\$|#\w+(?:::\w+)*)|[@%]_")
_NUM = re.compile(r"0[xXbB][0-9a-fA-F_]+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d+)?|\.\d+|v\d+(?:\.\d+)*")
_OP = re.compile(r"<=>|\*\*=|\|\|=|&&=|//=|\.\.\.|->|\+\+|--|=>|=~|!~|==|!=|<=|>=|&&|\|\||//|\.\.|::|\*\*|<<|>>|[-+*/%x.&|^]=|[-+*/%=<>!~\\?:.,;&|^@$#`'\"(){}\[\]]")
_HEREDOC = re.compile(r"<<(~?)(?:\"([^\"\n]*)\"|'([^'\n]*)'|([A-Za-z_]\w*))")
_INTERP = re.compile(r"(?<!\\)(?:\\\\)*[$@][A-Za-z_{$]")


@dataclass(slots=True)
class Token:
    kind: str  # word var num str qw re op open close
    text: str
    start: int
    end: int
    value: str = ""  # contents of a string, pattern or word list
    interp: bool = False
    match: int = -1  # the place of the other bracket


@dataclass
class Source:
    text: str
    tokens: list[Token] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def column(self, at: int) -> int:
        return at - self.lines[self.line(at) - 1]

    def span(self, first: int, last: int) -> str:
        """The text of tokens first to last, both included."""
        return self.text[self.tokens[first].start : self.tokens[last].end] if first <= last else ""

    def code(self, start: int, end: int) -> str:
        """Text without its comments."""
        out, at = [], start
        for a, b in self.comments:
            if start <= a < end:
                out.append(self.text[at:a])
                at = b
        return "".join([*out, self.text[at:end]])


def _delimited(text: str, at: int) -> tuple[int, int, int]:
    """Start and end of what stands between delimiters at a place, and the place behind; brackets nest."""
    left = text[at]
    right = OPEN.get(left, left)
    depth, k, n = 1, at + 1, len(text)
    while k < n:
        c = text[k]
        if c == "\\":
            k += 2
            continue
        if c == right and (right == left or depth == 1):
            return at + 1, k, k + 1
        if right != left:
            depth += (c == left) - (c == right)
        k += 1
    return at + 1, n, n


def lex(text: str) -> Source:
    src = Source(text, lines=[0, *(m.end() for m in re.finditer("\n", text))])
    out, at, n = src.tokens, 0, len(text)
    stack: list[int] = []
    waiting: list[tuple[str, bool, Token]] = []

    def term_next() -> bool:
        """Whether a term, not an operator, stands next."""
        if not out:
            return True
        t = out[-1]
        if t.kind in ("var", "num", "str", "qw", "re", "close"):
            if t.text != "}":
                return False
            # A subscript's brace ends a term; a block's begins a statement.
            left = out[t.match - 1] if t.match > 0 else None
            return not (left is not None and (left.kind in ("var", "close") and left.text != "}" or left.text == "->"))
        if t.kind == "word":
            return t.text in _TERM_AFTER and not (len(out) > 1 and out[-2].text in ("->", "sub"))
        return True

    while at < n:
        c = text[at]
        if c == "\n":
            at += 1
            for label, dented, token in waiting:
                end = re.compile(rf"^{'[ \\t]*' if dented else ''}{re.escape(label)}[ \t]*$", re.M).search(text, at)
                token.value = text[at : end.start() if end else n]
                token.interp = token.interp and bool(_INTERP.search(token.value))
                at = min(end.end() + 1 if end else n, n)
            waiting.clear()
            if text.startswith("=", at) and re.match(r"=[a-zA-Z]", text[at : at + 2]):
                end = re.compile(r"^=cut\b.*$", re.M).search(text, at)
                at = end.end() if end else n
            continue
        if c.isspace():
            at += 1
            continue
        if at == 0 and re.match(r"=[a-zA-Z]", text[:2]):
            end = re.compile(r"^=cut\b.*$", re.M).search(text)
            at = end.end() if end else n
            continue
        if c == "#":
            end = text.find("\n", at)
            end = n if end < 0 else end
            src.comments.append((at, end))
            at = end
            continue
        before = out[-1] if out else None
        if c.isalpha() or c == "_" or c == ":" and text.startswith("::", at) and at + 2 < n and (text[at + 2].isalpha() or text[at + 2] == "_"):
            m = _WORD.match(text, at)
            if not m:
                at += 1
                continue
            word, end = m[0], m.end()
            if word in ("__END__", "__DATA__"):
                break
            arrow = before is not None and before.text == "->"
            rest = re.compile(r"\s*").match(text, end).end()
            fat = text.startswith("=>", rest)
            key = before is not None and before.text == "{" and text.startswith("}", rest)
            if word in _QUOTES and not arrow and not fat and not key and rest < n and not (before is not None and before.text in ("sub", "method", "&")):
                d = text[rest] if rest == end or text[rest] != "#" else ""
                if d and not d.isspace() and not (d.isalnum() or d == "_") and d not in ",;)" and not (d == "=" and word in ("s", "y", "m", "q")):
                    a, b, behind = _delimited(text, rest)
                    value = text[a:b]
                    if word in ("s", "tr", "y"):
                        if d in OPEN:
                            second = re.compile(r"\s*").match(text, behind).end()
                            behind = _delimited(text, second)[2] if second < n else n
                        else:
                            behind = _delimited(text, behind - 1)[2]
                    if word in ("m", "qr", "s", "tr", "y"):
                        behind = re.compile(r"[a-z]*").match(text, behind).end()
                    kind = "qw" if word == "qw" else "str" if word in ("q", "qq", "qx") else "re"
                    out.append(Token(kind, text[at:behind], at, behind, value, word in ("qq", "qx") and bool(_INTERP.search(value))))
                    at = behind
                    continue
            out.append(Token("word", word, at, end))
            at = end
            continue
        if c in "$@%&":
            m = _VAR.match(text, at)
            operand = before is not None and (before.kind in ("var", "num", "str", "close") or before.kind == "word" and before.text not in _TERM_AFTER and before.text[0].isupper())
            if m and not (c in "%&" and operand):
                out.append(Token("var", m[0], at, m.end()))
                at = m.end()
                if m[0].endswith("{"):
                    out[-1] = Token("var", "$#", at - 3, at - 1)
                    at -= 1
                continue
            if c in "$@%" and at + 1 < n and text[at + 1] in "{$" and not (c == "%" and operand):
                out.append(Token("op", c, at, at + 1, "deref"))
                at += 1
                continue
        if c.isdigit() or c == "." and at + 1 < n and text[at + 1].isdigit() and term_next():
            m = _NUM.match(text, at)
            out.append(Token("num", m[0], at, m.end()))
            at = m.end()
            continue
        if c in "\"'`":
            a, b, behind = _delimited(text, at)
            value = text[a:b]
            out.append(Token("str", text[at:behind], at, behind, value, c != "'" and bool(_INTERP.search(value))))
            at = behind
            continue
        if c == "<" and term_next():
            m = _HEREDOC.match(text, at)
            if m:
                token = Token("str", m[0], at, m.end(), "", m[3] is None)
                out.append(token)
                waiting.append((next(g for g in (m[2], m[3], m[4]) if g is not None), bool(m[1]), token))
                at = m.end()
                continue
            m = re.compile(r"<\$?\w*>").match(text, at)
            if m:
                out.append(Token("op", m[0], at, m.end(), "read"))
                at = m.end()
                continue
        if c == "/" and term_next():
            a, b, behind = _delimited(text, at)
            if "\n" not in text[a:b] or b - a < 200:
                behind = re.compile(r"[a-z]*").match(text, behind).end()
                out.append(Token("re", text[at:behind], at, behind, text[a:b]))
                at = behind
                continue
        if c in "([{":
            stack.append(len(out))
            out.append(Token("open", c, at, at + 1))
            at += 1
            continue
        if c in ")]}":
            token = Token("close", c, at, at + 1)
            # An unmatched bracket closes the nearest of its kind, or nothing.
            for k in range(len(stack) - 1, -1, -1):
                if OPEN[out[stack[k]].text] == c:
                    token.match = stack[k]
                    out[stack[k]].match = len(out)
                    del stack[k:]
                    break
            out.append(token)
            at += 1
            continue
        m = _OP.match(text, at)
        out.append(Token("op", m[0] if m else c, at, m.end() if m else at + 1))
        at = out[-1].end
    for k in stack:
        out[k].match = len(out)
    return src
