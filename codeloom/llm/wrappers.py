"""HTML extraction by union-free regular-expression inference.

The pages of a host are token streams of one template. Each page's stream is first turned into an expression of its own:
nested elements, text slots, and repeated groups where neighbouring squares of one to three items match. The host's expression
(its wrapper) is then aligned with one page's after another: what matches is kept, text that differs becomes an open slot, and a
mismatch is resolved by making the items that one side lacks optional, or by folding items that match their neighbour into a
repeat. What comes back at a third place of a list is an irregular repeat: one group, of which each round may have any of its
items. There are no alternatives, so any two wrappers align in one pass, and partial wrappers of the tasks merge likewise.

A wrapper's items count the pages, characters and link characters they have seen, and know whether their text was the same on
all pages. What is constant on half of a host's pages, PAGES or more, is its template, be it a text slot, an element or a repeat,
and not main text; open slots are the pages' own. Of these, what elements say of themselves (nav, aside, class names and the like) tells
comments, related links and other changing parts from the article. A page is read by walking it along its host's wrapper. Where next to nothing
is open, the pages are copies of each other and tell nothing of a template.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.batches import bounded
from codeloom.llm.scratch import Scratch

SCHEMA = "page_id long, url string, text string"

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)"
    r"|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title xmp iframe noembed noframes")
_ENDS = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
INLINE = _words("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr")
CLOSE_P = _words("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul")
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = _words("table ul ol dl div article section aside main body html td th form blockquote nav header footer select")
NEVER = _words("script style noscript template head title nav footer aside form button select input textarea iframe svg object canvas audio video menu dialog option datalist math")
#: Fixed word lists: what a class, id or role names that isn't main text.
NOT_MAIN = _words(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup comment comments disqus respond replies reply share sharing social related recommended recommendations widget toolbar pagination pager login search form skip hidden complementary contentinfo"
)
MAIN = _words("article content main post entry story body text")
PAGE_ONLY = _words("header banner")
#: Pages of a host from which on what none of them changes is its template.
PAGES = 5
#: Pages with this many times more constant text than open text are copies of each other.
COPIES = 10


class Element:
    __slots__ = ("tag", "key", "marks", "items")

    def __init__(self, tag: str, key: str = "", marks: frozenset = frozenset()):
        self.tag, self.key, self.marks, self.items = tag, key, marks, []


_attrs: dict[str, tuple[str, frozenset]] = {}


def _marks(attrs: str) -> tuple[str, frozenset]:
    """What tells an element from others of its tag, and the words of its class, id and role."""
    got = _attrs.get(attrs)
    if got is None:
        if len(_attrs) > 20_000:
            _attrs.clear()
        found, words = [], set()
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if name in ("class", "id", "role"):
                own = {w for w in _SPLIT.split(_CAMEL.sub("-", value).lower()) if w and not w.isdigit()}
                words |= own
                # Ids are often numbered, so only words count.
                found.append(name[0] + ":" + ".".join(sorted(own)))
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                words.add("hidden")
                found.append("hidden")
        got = _attrs[attrs] = ("|".join(sorted(found)), frozenset(words))
    return got


def parse(page: str) -> Element:
    """The tree of a page. Unclosed and misplaced tags are mended as browsers do; what a page's end cuts off is dropped."""
    root = Element("#page")
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None or not m["end"]:
            continue
        tag = tag.lower()
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in CLOSE_P or tag in SAME:
            ends = ("p",) if tag in CLOSE_P else ()
            ends += SAME.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                elif stack[k].tag in SCOPE:
                    break
        attrs = m["attrs"]
        e = Element(tag, *_marks(attrs)) if attrs.strip(" /\n") else Element(tag)
        stack[-1].items.append(e)
        if tag in RAW:
            last = _ENDS[tag].search(page, at)
            end = last.start() if last else size
            if tag in ("textarea", "title"):
                e.items.append(page[at:end])
            at = end
            stack.append(e)
        elif tag not in VOID:
            stack.append(e)
    return root


# Expressions are lists: ["t", low, many, digest, pages, chars, link chars], ["e", low, many, tag, key, marks, items, pages, chars,
# link chars, digest], ["g", low, many, items], ["b", low, many, items]. low is 0 for what is optional, many 1 for what repeats. A
# "g" repeats its items in order, a "b" any of them. A digest is that of the text if all pages have the same, or else None.
Item = list


def label(x: Item):
    return x[0] if x[0] in "tb" else (x[3], x[4]) if x[0] == "e" else ("g", *(label(y) for y in x[3]))


def _digest(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def from_page(e: Element, link: bool = False) -> Item:
    items, chars, links, own = [], 0, 0, []
    link = link or e.tag == "a"
    if e.tag not in ("script", "style"):
        for x in e.items:
            if isinstance(x, str):
                text = " ".join(x.split())
                if text:
                    n = len(text)
                    own.append(_digest(text))
                    items.append(["t", 1, 0, own[-1], 1, n, n * link])
                    chars += n
                    links += n * link
            else:
                y = from_page(x, link)
                items.append(y)
                own.append(y[10])
                chars += y[8]
                links += y[9]
    return ["e", 1, 0, e.tag, e.key, sorted(e.marks), folded(items), 1, chars, links, _digest(str(own))]


def merged(a: Item, b: Item, within: bool = False) -> Item:
    """What both of two items with one label are. Within a page, or pages, the pages of both are at least those of either, and an element's
    text is that of both, one after the other."""
    pages = max if within else int.__add__
    low, many = min(a[1], b[1]), max(a[2], b[2])
    if a[0] == "t":
        return ["t", low, many, a[3] if a[3] == b[3] else None, pages(a[4], b[4]), a[5] + b[5], a[6] + b[6]]
    if a[0] == "e":
        one = None if a[10] is None or b[10] is None else _digest(f"{a[10]},{b[10]}") if within else a[10] if a[10] == b[10] else None
        return ["e", low, many, a[3], a[4], a[5], aligned(a[6], b[6], within), pages(a[7], b[7]), a[8] + b[8], a[9] + b[9], one]
    if a[0] == "b":
        return _bag([a, b], within)
    return ["g", low, many, [merged(x, y, within) for x, y in zip(a[3], b[3])]]


def _bag(items: list[Item], within: bool) -> Item:
    """An irregular repeat of items and of the items of groups among them."""
    by: dict = {}
    for x in flat(items):
        key = label(x)
        by[key] = merged(by[key], x, within) if key in by else [*x]
    for x in by.values():
        x[1], x[2] = 0, 1
    return ["b", 1 if any(x[1] for x in items) else 0, 1, [by[k] for k in sorted(by, key=str)]]


def folded(items: list[Item], most: int = 3) -> list[Item]:
    """Neighbouring equal labels as one repeat, squares of two or three items as repeated groups, irregular repeats as bags."""
    if len(items) < 2:
        return items
    out: list[Item] = []
    labels: list = []
    for x in items:
        key = label(x)
        if out and labels[-1] == key and key != "t":
            x = merged(out[-1], x, True)
            x[1], x[2] = 1 if out[-1][1] or x[1] else 0, 1
            out[-1] = x
        else:
            out.append(x)
            labels.append(key)
    for width in range(2, most + 1):
        k = 0
        while k + 2 * width <= len(out):
            if labels[k : k + width] == labels[k + width : k + 2 * width]:
                group = [merged(x, y, True) for x, y in zip(out[k : k + width], out[k + width : k + 2 * width])]
                end = k + 2 * width
                while labels[end : end + width] == labels[k : k + width]:
                    group = [merged(x, y, True) for x, y in zip(group, out[end : end + width])]
                    end += width
                out[k:end] = [["g", 1, 1, group]]
                labels[k:end] = [label(out[k])]
            else:
                k += 1
    while len(out) > 2:
        # From the first place to the last of a label with three, or with one in a bag and one beside it.
        places: dict = {}
        for k, x in enumerate(out):
            for key in {label(y) for y in flat([x])} | ({"b"} if x[0] == "b" else set()):
                places.setdefault(key, []).append(k)
        wide = [(p[-1] - p[0], p) for p in places.values() if len(p) > 2 or len(p) == 2 and any(out[k][0] == "b" for k in p)]
        if not wide:
            break
        first, last = max(wide)[1][0], max(wide)[1][-1]
        out[first : last + 1] = [_bag(out[first : last + 1], True)]
    return out


def flat(items: list[Item]) -> Iterator[Item]:
    for x in items:
        if x[0] in "gb":
            yield from flat(x[3])
        else:
            yield x


def aligned(a: list[Item], b: list[Item], within: bool = False) -> list[Item]:
    """The union-free expression of all that either matches: a longest common subsequence by label, the rest optional."""
    x, y = [label(i) for i in a], [label(i) for i in b]
    if x == y:
        return [merged(p, q, within) for p, q in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(merged(a[i], b[j], within))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([*a[i][:1], 0, *a[i][2:]])
            i += 1
        else:
            out.append([*b[j][:1], 0, *b[j][2:]])
            j += 1
    return folded(out)


def fold_pages(batches: Iterator[pa.RecordBatch], most_hosts: int = 500) -> Iterator[pa.RecordBatch]:
    """(host, html) to partial wrappers (host, wrapper)."""
    held: dict[str, Item] = {}
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = from_page(parse(page.as_py() or ""))
            held[host] = merged(held[host], own) if host in held else own
        if len(held) >= most_hosts:
            yield _partials(held)
            held = {}
    if held:
        yield _partials(held)


def _partials(held: dict[str, Item]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([json.dumps(w, separators=(",", ":")) for w in held.values()], pa.string())], names=["host", "wrapper"])


def fold_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers in order of host to one a host."""
    now, own = None, None
    for batch in batches:
        for host, w in zip(*(c.to_pylist() for c in batch.columns)):
            if host == now and own is not None:
                own = merged(own, json.loads(w))
            else:
                if own is not None:
                    yield _partials({now: own})
                now, own = host, json.loads(w)
    if own is not None:
        yield _partials({now: own})


class Reader:
    """A wrapper whose items are marked: main text or not."""

    def __init__(self, wrapper: Item):
        self.wrapper = wrapper
        self.pages = max(1, wrapper[7])
        self.out: dict[int, bool] = {}
        self.regions: set[int] = set()
        self._mark(wrapper, True)
        mains = self._find(wrapper, lambda x: x[3] == "article") or self._find(wrapper, lambda x: x[3] == "main" or "main" in x[5] and "r:main" in x[4])
        if not mains:
            named = self._find(wrapper, lambda x: MAIN & set(x[5]) and x[3] not in ("html", "body") and not NOT_MAIN & set(x[5]))
            if named:
                mains = [max(named, key=lambda x: x[8] - x[9])]
        self.regions = {id(x) for x in mains}
        self.has_region = bool(mains)
        #: By element, the digests of its text slots that the pages hold constant; the elements that they hold constant.
        self.constant: dict[int, set[int]] = {}
        self.template: set[int] = set()
        if self.pages >= PAGES:
            held, free = self._slots(wrapper)
            if held > COPIES * free:
                self.constant, self.template = {}, set()

    def _slots(self, x: Item) -> tuple[int, int]:
        """Notes the slots and elements that half of the pages and PAGES of them have and hold constant; characters of these and of all others."""
        held = free = 0
        if x[0] == "e" and self.out.get(id(x), True):
            return 0, 0
        for y in x[6] if x[0] == "e" else x[3]:
            same = y[3] if y[0] == "t" else y[10] if y[0] == "e" else None
            seen, chars = (y[4], y[5]) if y[0] == "t" else (y[7], y[8]) if y[0] == "e" else (0, 0)
            if same is not None and chars and seen >= max(PAGES, self.pages / 2) and not (y[0] == "e" and self.out.get(id(y), True)):
                if y[0] == "t":
                    self.constant.setdefault(id(x), set()).add(same)
                else:
                    self.template.add(id(y))
                more = chars, 0
            else:
                more = (0, chars) if y[0] == "t" else self._slots(y)
            held, free = held + more[0], free + more[1]
        return held, free

    def _constants(self, x: Item) -> set[int]:
        """The constant slots of an element, those of its repeated groups among them."""
        found = set(self.constant.get(id(x), ()))
        groups = [y for y in x[6] if y[0] in "gb"]
        while groups:
            g = groups.pop()
            found |= self.constant.get(id(g), set())
            groups += [y for y in g[3] if y[0] in "gb"]
        return found

    def _mark(self, x: Item, top: bool) -> None:
        words = set(x[5])
        bad = x[3] in NEVER or bool(words & NOT_MAIN) and x[3] not in ("html", "body", "#page", "article", "main")
        # A page's header, not an article's.
        bad = bad or top and (x[3] == "header" or bool(words & PAGE_ONLY)) and x[3] not in ("html", "body")
        self.out[id(x)] = bad
        if not bad:
            for y in flat(x[6]):
                if y[0] == "e":
                    self._mark(y, top and x[3] not in ("article", "main"))

    def _find(self, x: Item, test) -> list[Item]:
        """The outermost items that pass, outside of what isn't main text."""
        if self.out[id(x)]:
            return []
        if x[3] != "#page" and test(x):
            return [x]
        return [z for y in flat(x[6]) if y[0] == "e" for z in self._find(y, test)]

    def _sparse(self, x: Item) -> bool:
        """Without a region: blocks that are mostly links."""
        return x[3] in ("ul", "ol", "dl", "div", "section", "table", "p") and x[8] > 0 and x[9] > 0.5 * x[8]

    def text(self, page: Element) -> str:
        blocks: list[str] = []
        held: list[str] = []
        # Where the wrapper has a region that this page lacks, the whole body counts.
        whole = not self.has_region or not self._has(page, self.wrapper)

        def flush():
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append(text)

        def walk(e: Element, x: Item | None, on: bool):
            if x is None:
                bad = e.tag in NEVER or bool(e.marks & NOT_MAIN)
            else:
                bad = self.out.get(id(x), True) or id(x) in self.template or whole and self._sparse(x)
                on = on or id(x) in self.regions
            if bad:
                if e.tag not in INLINE:
                    flush()
                return
            block = e.tag not in INLINE
            if block:
                flush()
            elif e.tag == "br":
                held.append(" ")
            places = list(flat(x[6])) if x is not None else []
            known = self._constants(x) if x is not None and self.constant else ()
            at = 0
            for y in e.items:
                if isinstance(y, str):
                    if known and _digest(" ".join(y.split())) in known:
                        held.append(" ")
                    elif on:
                        held.append(y)
                    continue
                # The next place of this label, else the first.
                z = None
                for k in range(len(places)):
                    p = places[(at + k) % len(places)]
                    if p[0] == "e" and p[3] == y.tag and p[4] == y.key:
                        z, at = p, (at + k) % len(places)
                        break
                walk(y, z, on)
            if block:
                flush()

        walk(page, self.wrapper, whole)
        flush()
        return "\n".join(blocks)

    def _has(self, e: Element, x: Item) -> bool:
        if id(x) in self.regions:
            return True
        if self.out.get(id(x), True):
            return False
        places = {(p[3], p[4]): p for p in flat(x[6]) if p[0] == "e"}
        return any(self._has(y, places[y.tag, y.key]) for y in e.items if not isinstance(y, str) and (y.tag, y.key) in places)


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host, from all its pages. Tasks fold their pages; partial wrappers merge in two steps, dealt by a hash first."""
    partial = pages.mapInArrow(fold_pages, "host string, wrapper string")
    deal = F.pmod(F.xxhash64("wrapper"), F.lit(16))
    half = partial.withColumn("deal", deal).repartition("host", "deal").sortWithinPartitions("host", "deal", "wrapper").select("host", "wrapper").mapInArrow(fold_wrappers, "host string, wrapper string")
    return half.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(fold_wrappers, "host string, wrapper string")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Reader] = {}
    for batch in batches:
        out = []
        for page, wrapper in zip(batch.column(2), batch.column(3).to_pylist()):
            if wrapper not in known:
                if len(known) > 500:
                    known.clear()
                known[wrapper] = Reader(json.loads(wrapper) if wrapper else from_page(parse("")))
            out.append(known[wrapper].text(parse(page.as_py() or "")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url and main text of every row of pages, from its whole html.

    Blocks are joined by line ends in page order, white space in a block is one space, character references are decoded.
    A null or empty html has the empty text. Pages without a url or host share one wrapper. Repeated rows each have a row, and an
    empty table none. Very long pages count whole. Columns of pages but page_id, url and html, whatever their names, are not read.
    """
    scratch = scratch or Scratch(pages.sparkSession, "wrappers")
    bounded(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), _HOST.pattern, 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    found = scratch.save(infer(rows.select("host", "html")), "wrappers")
    # Spark broadcasts the wrappers where their written size allows, and deals both sides by host where it doesn't.
    met = rows.join(found, "host", "left").select("page_id", "url", "html", "wrapper")
    return met.mapInArrow(_read, SCHEMA)
