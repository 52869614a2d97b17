"""Main text of web pages through wrappers inferred for each host.

A wrapper is a union-free regular expression over a host's pages: a tree of
elements, text slots, optional parts (``?``) and repeated parts (``+``).  It is
inferred by alignment: a page is an expression without variables; two
expressions are aligned element by element, a mismatch of texts becomes a slot,
an element that one side lacks becomes optional, and neighbours of equal
structure become one repeated group.  Inline markup is part of the text around
it.  As a wrapper and a page are the same kind of expression, every task folds
its own pages of a host into one partial wrapper, and those are folded in turn,
in two rounds, so a host with very many pages is no single task's work.

From a host's wrapper follows which paths may hold main text: those under
``article`` or ``main``, and outside of them all slots but those whose text is
the same on several different pages; of these, too, headings and paragraphs
stay if texts vary beside them.  Never those in menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles.  Each page then
decides: its text is that of its ``article`` or ``main``, if it has one that
holds the bulk of it, else that of all its paths.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .url_filter import host_of

# Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: A start tag that ends an open element of the second set, if none of the third stands between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
#: Elements whose text is never main text, and the words in a class or id that say the same.
BARRED = frozenset("head nav footer aside form script style title noscript template iframe button select option textarea svg math canvas object audio video dialog menu xmp noembed noframes".split())
BARRED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social related recommended comment comments reply replies respond disqus discussion toolbar pagination pager skip login search".split()
)
#: What may stand before or after these words in a name of several: ``site-footer``, ``comment-list``.
BARRED_BEFORE = frozenset("site main top bottom left right primary secondary global mobile wp js the".split())
BARRED_AFTER = frozenset("list lists section box wrapper wrap container area form bar block buttons button links link items item title thread posts articles message text".split())
#: Words in the class or id of an ``article`` that is a reader's comment.
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus discussion".split())
#: Words of elements whose articles are comments or teasers, not the page's.
LISTING_WORDS = COMMENT_WORDS | frozenset("related recommended sponsor sponsored promo".split())
#: Elements that hold running text, and those that only group them.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre td th figcaption caption".split())
GROUPS = frozenset("ul ol dl table thead tbody tfoot tr figure hgroup".split())
#: Deeper elements count as part of the one at this depth, but those that are barred by name stay so.
DEEPEST = 120
#: From this depth on plain elements within their like count as one.
NESTED = 60

#: Attributes up to the end of a tag. A quote counts right after the ``=`` behind a name; elsewhere it is a plain character.
_ATTRS = r"""(?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?)?)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})(>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
_WORD_BREAK = re.compile(r"[-_:]+")

#: An event: (1, key) opens an element, (-1, key) closes it, (0, text) is text.
Event = tuple[int, str]


def _key(tag: str, attributes: str) -> str:
    """An element's name in wrappers: its tag, and the words of its classes and id."""
    words = []
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            words += [w for w in (m[1] or m[2] or m[3] or "").lower().split() if not any(c.isdigit() for c in w)]
    return ".".join([tag, *sorted(set(words))])


def events(page: str) -> Iterator[Event]:
    """Elements and texts of a page, however it is nested or cut off.

    Every element that opens also closes; a tag or comment that the page's end
    cuts off is dropped, as are comments and what scripts and styles hold.
    """
    stack: list[tuple[str, str]] = []
    at, n = 0, len(page)

    def close_to(k: int) -> Iterator[Event]:
        while len(stack) > k:
            yield -1, stack.pop()[1]

    def last_open(tags: frozenset[str], stop: frozenset[str]) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stop:
                break
        return -1

    scope = frozenset("table td th button object article section main".split())
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield 0, page[at:]
            break
        if m.start() > at:
            yield 0, page[at : m.start()]
        at = m.end()
        if m[2] is None or m[4] == "":
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                yield 0, "\n"
            elif tag not in INLINE and (k := last_open(frozenset([tag]), frozenset())) >= 0:
                yield from close_to(k)
            continue
        if tag == "br":
            yield 0, "\n"
            continue
        if tag in INLINE:
            continue
        if tag in CLOSES_P and (k := last_open(frozenset(["p"]), scope)) >= 0:
            yield from close_to(k)
        if tag in IMPLIED and (k := last_open(*IMPLIED[tag])) >= 0:
            yield from close_to(k)
        key = _key(tag, m[3])
        yield 1, key
        if tag in VOID:
            yield -1, key
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            yield -1, key
            at = end.end() if end else n
        elif m[3].endswith("/") and tag not in CLOSES_P and tag not in IMPLIED and "." not in key and tag not in ("html", "body"):
            yield -1, key
        else:
            stack.append((tag, key))
    yield from close_to(0)


# --- expressions ------------------------------------------------------------
#
# An element is [key, optional, repeated, parts]; a text is [text or None, optional, least, greatest],
# the last two of the checksums of the pages that have it: they differ if it was seen on different pages.


def _is_text(x: list) -> bool:
    return not isinstance(x[-1], list)


def _name(x: list) -> str:
    return "#" if _is_text(x) else x[0]


def _unnested(page: str) -> Iterator[Event]:
    """The events of a page; from :data:`NESTED` levels on, elements without class or id that stand in one of the same name open nothing: (2, key) marks their borders.

    So a page that is wrapped in any number of plain elements is read like one with few.
    """
    stack: list[tuple[str, bool]] = []
    depth = 0
    for kind, what in events(page):
        if kind == 1:
            opens = depth < NESTED or "." in what or what != stack[-1][0]
            stack.append((what, opens))
            depth += opens
            yield (1, what) if opens else (2, what)
        elif kind == -1:
            key, opens = stack.pop()
            depth -= opens
            yield (-1, what) if opens else (2, key)
        else:
            yield (kind, what)


class _Below:
    """Elements below :data:`DEEPEST`: how many are open, and since which of them all is barred."""

    def __init__(self):
        self.open, self.barred = 0, 0

    def enter(self, key: str) -> None:
        self.open += 1
        if not self.barred and _barred_by_name(key, True):
            self.barred = self.open

    def leave(self) -> None:
        if self.open == self.barred:
            self.barred = 0
        self.open -= 1


def expression(page: str) -> list:
    """A page as an element named ``""``."""
    root: list = ["", False, False, []]
    path, deep = [root], _Below()
    own = zlib.crc32(page.encode("utf-8", "surrogatepass"))
    for kind, what in _unnested(page):
        parts = path[-1][3]
        if kind == 2:
            continue
        if kind == 0:
            text = " ".join(what.split())
            if not text or deep.barred:
                continue
            if parts and _is_text(parts[-1]):
                parts[-1][0] = f"{parts[-1][0]} {text}"
            else:
                parts.append([text, False, own, own])
        elif kind == 1:
            if len(path) >= DEEPEST:
                deep.enter(what)
                continue
            element: list = [what, False, False, []]
            parts.append(element)
            path.append(element)
        elif deep.open:
            deep.leave()
        else:
            done = path.pop()
            done[3] = fold_repeats(done[3])
    root[3] = fold_repeats(root[3])
    return root


def fold_repeats(parts: list[list], longest: int = 3) -> list[list]:
    """Neighbouring groups of up to ``longest`` parts with equal names as one repeated group each."""
    for period in range(1, longest + 1):
        out: list[list] = []
        k = 0
        while k < len(parts):
            names = [_name(x) for x in parts[k : k + period]]
            group = parts[k : k + period]
            n = k + period
            if len(group) == period and "#" not in names[:1]:
                while [_name(x) for x in parts[n : n + period]] == names:
                    group = [align(a, b) for a, b in zip(group, parts[n : n + period])]
                    n += period
            if n > k + period:
                for x in group:
                    if not _is_text(x):
                        x[2] = True
                out += group
                k = n
            else:
                out.append(parts[k])
                k += 1
        parts = out
    return parts


def align(a: list, b: list) -> list:
    """The least expression here that both ``a`` and ``b`` (of equal name) fit."""
    if _is_text(a):
        return [a[0] if a[0] == b[0] else None, a[1] or b[1], min(a[2], b[2]), max(a[3], b[3])]
    return [a[0], a[1] or b[1], a[2] or b[2], align_parts(a[3], b[3])]


def _last_row(x: list[int], y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` and each prefix of ``y``."""
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for name in x:
        row[1:] = np.maximum(np.where(y == name, row[:-1] + 1, 0), row[1:])
        np.maximum.accumulate(row, out=row)
    return row


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in linear space: halves of ``x`` are matched with the best cut of ``y``."""
    number: dict[str, int] = {}
    x_of = [number.setdefault(n, len(number)) for n in x]
    y_of = np.array([number.setdefault(n, len(number)) for n in y], dtype=np.int64)
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x_of[a] == y_of[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x_of[b - 1] == y_of[d - 1]:
            out.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a == b or c == d:
            continue
        if b - a == 1:
            found = np.flatnonzero(y_of[c:d] == x_of[a])
            if len(found):
                out.append((a, c + int(found[0])))
            continue
        half = (a + b) // 2
        cut = c + int(np.argmax(_last_row(x_of[a:half], y_of[c:d]) + _last_row(x_of[half:b][::-1], y_of[c:d][::-1])[::-1]))
        todo += [(a, half, c, cut), (half, b, cut, d)]
    return sorted(out)


def align_parts(a: list[list], b: list[list]) -> list[list]:
    """Align two sequences by their longest common subsequence of names; the rest is optional."""
    x, y = [_name(p) for p in a], [_name(p) for p in b]
    if x == y:
        return [align(p, q) for p, q in zip(a, b)]
    out: list[list] = []
    i = j = 0
    for p, q in [*_common(x, y), (len(x), len(y))]:
        out += [_optional(e) for e in a[i:p]] + [_optional(e) for e in b[j:q]]
        if p < len(x):
            out.append(align(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold_repeats(out)


def _optional(x: list) -> list:
    return [x[0], True, *x[2:]]


def to_pattern(x: list) -> str:
    """The wrapper in the usual notation, for people."""
    if _is_text(x):
        body = "#PCDATA" if x[0] is None else json.dumps(x[0], ensure_ascii=False)
        return f"({body})?" if x[1] else body
    inner = " ".join(to_pattern(p) for p in x[3])
    body = f"<{x[0]}> {inner} </{x[0]}>" if x[0] else inner
    return f"({body})" + {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[x[1], x[2]] if x[1] or x[2] else body


# --- what is main text ------------------------------------------------------


def _bars(name: str) -> bool:
    """Whether a class or id says that an element holds no main text: by all its parts, not by one (``has-sidebar``)."""
    if name in BARRED_WORDS:
        return True
    parts = [p for p in _WORD_BREAK.split(name) if p]
    while parts and parts[0] in BARRED_BEFORE:
        del parts[0]
    while parts and parts[-1] in BARRED_AFTER and parts[-1] not in BARRED_WORDS:
        del parts[-1]
    return bool(parts) and all(p in BARRED_WORDS for p in parts)


def _barred_by_name(key: str, inside: bool) -> bool:
    tag, *words = key.split(".")
    if tag in ("html", "body", "article", "main"):
        return False
    return tag in BARRED or (tag == "header" and not inside) or any(map(_bars, words))


def _barred(x: list, inside: bool) -> bool:
    """Whether an element and all in it are no main text; never one around the page's ``main`` or ``article``."""
    if not _barred_by_name(x[0], inside):
        return False
    tag, *words = x[0].split(".")
    names = [w for w in words if _bars(w)]
    lists_articles = tag in ("aside", "nav", "footer") or any(not LISTING_WORDS.isdisjoint(_WORD_BREAK.split(w)) for w in names)
    return not _holds_container(x, lists_articles)


def _holds_container(x: list, only_main: bool) -> bool:
    """Whether ``x`` holds a ``main`` or (unless ``only_main``) an ``article`` that isn't one of a list."""
    todo = [x]
    while todo:
        for p in todo.pop()[3]:
            if not _is_text(p):
                if p[0].split(".")[0] == "main" or (not only_main and _is_container(p[0]) and not p[2]):
                    return True
                todo.append(p)
    return False


def _is_container(key: str) -> bool:
    tag, *words = key.split(".")
    return tag == "main" or (tag == "article" and COMMENT_WORDS.isdisjoint(words))


def _region(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path of the element that holds the block at ``path`` and the blocks beside it."""
    k = len(path)
    while k and path[k - 1].split(".")[0] in BLOCKS | GROUPS:
        k -= 1
    return path[:k]


def main_paths(wrapper: list) -> list[tuple[str, ...]]:
    """Paths (names from the root) whose own text may be main text; :func:`extract` decides for each page."""
    kept: set[tuple[str, ...]] = set()
    varying: set[tuple[str, ...]] = set()
    constant: set[tuple[str, ...]] = set()
    todo = [(wrapper, (), False)]
    while todo:
        x, path, inside = todo.pop()
        for p in x[3]:
            if not _is_text(p):
                if not _barred(p, inside):
                    todo.append((p, (*path, p[0]), inside or _is_container(p[0])))
            elif inside:
                kept.add(path)
            elif p[0] is None:
                varying.add(path)
            elif p[2] == p[3]:  # seen on one page, so nothing says that it is the template's
                kept.add(path)
            else:
                constant.add(path)
    regions = {_region(path) for path in varying}
    beside = {path for path in constant if path and path[-1].split(".")[0] in BLOCKS and any(path[:k] in regions for k in range(len(path) + 1))}
    outside = varying | beside
    if not outside and not any(not any(map(_is_container, path)) for path in kept):
        outside = constant
    return sorted(kept | outside)


def extract(page: str | None, paths: frozenset[tuple[str, ...]]) -> str:
    """The text at a page's main paths, block by block.

    If the page has a ``main``, or an ``article`` that isn't one of a list of
    them, and its containers hold no less text than the blocks outside, only
    the text in containers counts.
    """
    blocks: list[tuple[str, int | None, bool]] = []  # text, number of its outermost container, whether a heading, paragraph or the like
    now: list[str] = []
    path: list[str] = []
    boxes: list[tuple[str, ...]] = []
    box_depth, deep = 0, _Below()  # the depth of the open container
    wanted = () in paths

    def end_block():
        if now:
            text = " ".join(html_lib.unescape("".join(now)).split())
            if text:
                blocks.append((text, len(boxes) if box_depth else None, bool(path) and path[-1].split(".")[0] in BLOCKS))
            now.clear()

    for kind, what in _unnested(page or ""):
        if kind == 0:
            if wanted and not deep.barred:
                now.append(what)
            continue
        end_block()
        if kind == 2:
            continue
        if kind == 1:
            if len(path) >= DEEPEST - 1:
                deep.enter(what)
                continue
            path.append(what)
            if not box_depth and _is_container(what):
                boxes.append(tuple(path))
                box_depth = len(path)
        elif deep.open:
            deep.leave()
            continue
        else:
            if len(path) == box_depth:
                box_depth = 0
            path.pop()
        wanted = tuple(path) in paths
    end_block()
    inside = [b for b in blocks if b[1] is not None]
    filled = Counter(boxes[k - 1] for k in {b[1] for b in inside})
    if any(n == 1 or where[-1].split(".")[0] == "main" for where, n in filled.items()):
        if sum(len(b[0]) for b in inside) >= sum(len(b[0]) for b in blocks if b[1] is None and b[2]):
            blocks = inside
    return " ".join(b[0] for b in blocks)


# --- on Spark ---------------------------------------------------------------


def _merged(rows: Iterator[str]) -> str:
    wrapper = None
    for row in sorted(rows):
        x = json.loads(row)
        wrapper = x if wrapper is None else align(wrapper, x)
    return json.dumps(wrapper, ensure_ascii=False)


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` of every host of ``pages`` (``url, html``), the wrapper as JSON.

    A null url's host is empty.  Folds are made in the order of the expressions'
    texts within a group, so a rerun of a task gives the same wrapper.
    """

    def partial(batches):
        found: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = expression(page.as_py() or "")
                found[host] = align(found[host], x) if host in found else x
        part = TaskContext.get().partitionId()
        rows = sorted((h, json.dumps(x, ensure_ascii=False)) for h, x in found.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in rows], pa.string()), pa.array([part % 64] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.string())], names=["host", "share", "wrapper"]
        )

    def merge(group: pa.Table) -> pa.Table:
        return pa.table({"host": group.column("host").slice(0, 1), "wrapper": pa.array([_merged(group.column("wrapper").to_pylist())], pa.string())})

    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(partial, "host string, share int, wrapper string")
    first = parts.groupBy("host", "share").applyInArrow(merge, "host string, wrapper string")
    return first.groupBy("host").applyInArrow(merge, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    Null and empty pages have an empty text; repeated rows each get a row;
    other columns are ignored.
    """

    def to_paths(batches):
        for batch in batches:
            paths = [json.dumps(main_paths(json.loads(x)), ensure_ascii=False) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "paths"])

    paths = stage_table(wrappers(pages).mapInArrow(to_paths, "host string, paths string"), "main-paths")

    def run(batches):
        known: dict[str, frozenset] = {}
        for batch in batches:
            texts = []
            for page, where in zip(batch.column(2), batch.column(3).to_pylist()):
                if where not in known:
                    known[where] = frozenset(map(tuple, json.loads(where)))
                texts.append(extract(page.as_py(), known[where]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(paths, "host").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
