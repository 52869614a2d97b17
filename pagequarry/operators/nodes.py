"""HTML documents as arrays of nodes, a row a document.

Parsing is the one step that Spark's functions can't express; it is a small
helper in Arrow batches.  All else works on its arrays with Spark's own functions,
within the row, so no step after it shuffles.

A node's id is its place in the array, and its subtree are the nodes up to ``last``.
Next to the nodes stand *runs*: the inline content between two block borders, as
codes ``2 * id`` for an element's opening or a text and ``2 * id + 1`` for its closing.
"""

from __future__ import annotations

import html as html_lib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from pagequarry.functions import text as T

#: A node. ``path``: the names of the tags around it, each once, between spaces (of :data:`NAMED` tags only). ``item``, ``cell``: ids
#: of the innermost list item and table cell at or around it; ``table``, ``row``, ``link``: those around it; ``quotes``, ``lists``,
#: ``bullets``: how many quotes, lists and unordered lists are at or around it; ``next``, ``previous``: the siblings beside it, white space and
#: comments left out; ``opens``, ``closes``: the runs in which it does; ``source``: an element's own HTML, if asked for; of a title's text with
#: references, its HTML (see :func:`title_source`).
NODE = (
    "struct<id:int,parent:int,last:int,depth:int,nth:int,kind:string,tag:string,attrs:map<string,string>,text:string,path:string,"
    "item:int,cell:int,table:int,row:int,link:int,quotes:int,lists:int,bullets:int,next:int,previous:int,opens:int,closes:int,source:string>"
)
#: A run: the innermost block element that holds it (null: the document), its codes, and the elements of :data:`MARKED`
#: that are open where it begins and where it ends, outermost first, one of each name.
RUN = "struct<owner:int,codes:array<int>,around:array<int>,left:array<int>>"

# Fixed values of HTML: elements by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr graphic".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: Elements besides that end a run where they open and close.
CUTS = BLOCK | frozenset("html body tr row td th cell caption thead tbody tfoot option optgroup legend label button textarea select datalist iframe audio video progress meter output".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Elements that no end tag of another element reaches through.
SPECIAL = BLOCK | frozenset("applet area base body br button caption col colgroup embed frameset head html iframe img input link marquee meta noembed noframes noscript object param script select source style tbody td template textarea tfoot th thead title tr track wbr xmp".split())
#: Elements whose end tag looks for them within a scope; all others stop at special elements.
SCOPED = (BLOCK - {"li", "dt", "dd", "p"}) | frozenset("applet button marquee object select listing".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
#: Elements that open formatting elements don't reach into, and whose end forgets those opened inside.
MARKING = frozenset("applet caption marquee object td template th".split())
#: A start tag, what it closes, and what it looks no further than.
IMPLIED = {
    "tr": ("tr td th caption", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th caption", "table"),
    "thead": ("thead tbody tfoot tr td th caption", "table"),
    "tfoot": ("thead tbody tfoot tr td th caption", "table"),
    "caption": ("caption tr td th thead tbody tfoot", "table"),
    "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"),
    "rt": ("rt rp rb", "ruby rtc"),
    "rp": ("rt rp rb", "ruby rtc"),
    "rb": ("rt rp rb rtc", "ruby"),
    "rtc": ("rt rp rb rtc", "ruby"),
    "button": ("button", "table td th caption"),
}
_IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: Start tags before which formatting elements that are still to apply don't open again.
_BEFORE_NONE = BLOCK | RAW | frozenset(_IMPLIED) - {"option", "optgroup", "button"} | frozenset("html head body meta link base param source track template noscript frameset colgroup col".split())
#: Cells of tables.
CELLS = frozenset("td th cell".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose markup stands on both sides of what they hold, and so begins and ends anew in each run.
MARKED = frozenset("a strong b em i var dfn del s strike ins mark code kbd samp sub sup".split())
#: Tags that a path names: those of :data:`MARKED` and any other that rules look for around a node.
NAMED = MARKED | HEADINGS | frozenset("p abbr bdi bdo big q cite data font label rp rt ruby small time tt u pre textarea svg math iframe head nav form header footer aside blockquote ul ol menu li dl dt dd table caption button select details summary figure figcaption audio video input title".split())
_P = frozenset(["p"])
_LISTS, _BULLETS = frozenset("ul ol menu".split()), frozenset("ul menu".split())
_BUTTON_SCOPE, _ITEM_SCOPE, _TABLE_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul", "menu"}, frozenset("html table template".split())
_TABLE_PARTS = frozenset("table caption colgroup tbody td tfoot th thead tr".split())

#: Attributes up to the end of a tag. A quote counts right after the ``=`` behind a name; elsewhere it is a plain character.
ATTRS = r"""(?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?)?)*+"""
_TOKEN = re.compile(
    r"<!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{ATTRS})(?P<close>>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def decode(text: str) -> str:
    """References that end in a semicolon; others are text."""
    return _REFERENCE.sub(lambda m: html_lib.unescape(m[0]), text) if "&" in text else text


def _basic(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def title_source(text: str) -> str:
    """A title's HTML: references decoded but those of ``&``, ``<`` and ``>``; what is no reference stays as written."""
    return _REFERENCE.sub(lambda m: m[0] if (said := html_lib.unescape(m[0])) == m[0] else _basic(said), text)


def _attributes(source: str) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for m in _ATTR.finditer(source):
        value = next((g for g in m.groups()[1:] if g is not None), None)
        out.setdefault(m[1].lower(), None if value is None else decode(value))
    return out


class Tree:
    """A document's nodes by columns, and its runs.

    Numbers stand in arrays, -1 for none; ``kind``, ``tag`` and ``path`` as places in ``names``.
    Read by name, any column is a list with None for none.
    """

    #: What is known of a node when it begins stands side by side in one array.
    FIXED = ("parent", "depth", "nth", "kind", "tag", "path", "item", "cell", "table", "row", "link", "quotes", "lists", "bullets", "opens")
    LATER = ("last", "next", "previous", "closes")
    NAMES = ("kind", "tag", "path")
    COLUMNS = ("parent", "last", "depth", "nth", "kind", "tag", "attrs", "text", "path", "item", "cell", "table", "row", "link", "quotes", "lists", "bullets", "next", "previous", "opens", "closes", "source")
    RUNS = ("owners", "codes", "arounds", "lefts")
    __slots__ = ("fixed", "later", "names", "attrs", "text", "source", "said", *RUNS)

    def __init__(self):
        self.fixed, self.later = array("i"), {name: array("i") for name in self.LATER}
        self.names: dict[str, int] = {}
        self.attrs, self.text, self.source = [], [], []
        self.owners, self.codes, self.arounds, self.lefts = [None], [[]], [()], [()]
        #: Where the page's texts stand among the nodes, in the order of the page.
        self.said: list[int] = []

    def numbers(self, name: str) -> np.ndarray:
        found = self.fixed if name in self.FIXED else self.later[name]
        whole = np.frombuffer(found, dtype=np.int32) if len(found) else np.empty(0, dtype=np.int32)
        return whole[self.FIXED.index(name) :: len(self.FIXED)] if name in self.FIXED else whole

    def __getattr__(self, name: str) -> list:
        column = self.numbers(name).tolist()
        names = list(self.names) if name in self.NAMES else None
        return [None if x < 0 else x if names is None else names[x] for x in column]


class _Elements:
    """The elements of a document while it is read; they may move, so their order is that of :attr:`kids`."""

    __slots__ = ("tags", "attrs", "texts", "kids", "up", "roots", "sources", "whole")

    def __init__(self):
        self.tags, self.attrs, self.texts, self.kids, self.up, self.roots, self.sources = [], [], [], [], [], [], {}
        self.whole: set[int] = set()  # void elements, which don't close


_TEXT, _COMMENT = "#text", "#comment"


def _built(html: str, keep_source: frozenset[str]) -> _Elements:
    """Reads a document as browsers do: scopes of end tags, elements ended by context, void and raw text elements,

    the list of active formatting elements with its markers, and the adoption of
    blocks that a formatting element ends in.  Text in tables stays where it stands.
    ``keep_source`` names the elements whose own HTML is kept, ``-`` all custom ones.
    """
    made = _Elements()
    tags, attributes, texts, kids, up = made.tags, made.attrs, made.texts, made.kids, made.up
    stack: list[int] = []
    opened: dict[str, int] = {}
    on_stack: set[int] = set()
    #: Formatting elements that still apply; None is a marker.
    active: list[int | None] = []
    begin: dict[int, int] = {}
    custom = "-" in keep_source  # all custom elements

    def new(tag: str, attrs: dict | None, text: str | None = None) -> int:
        tags.append(tag)
        attributes.append(attrs)
        texts.append(text)
        kids.append(None)
        up.append(-1)
        return len(tags) - 1

    def put(node: int, parent: int | None) -> None:
        if parent is None:
            made.roots.append(node)
        else:
            if kids[parent] is None:
                kids[parent] = []
            kids[parent].append(node)
            up[node] = parent

    def detach(node: int) -> None:
        siblings = kids[up[node]] if up[node] >= 0 else made.roots
        for k in range(len(siblings) - 1, -1, -1):
            if siblings[k] == node:
                del siblings[k]
                break
        up[node] = -1

    def hold(node: int, place: int | None = None) -> None:
        stack.insert(len(stack) if place is None else place, node)
        on_stack.add(node)
        opened[tags[node]] = opened.get(tags[node], 0) + 1

    def drop(node: int) -> None:
        on_stack.discard(node)
        opened[tags[node]] -= 1

    def push(tag: str, attrs: dict, start: int = -1) -> int:
        node = new(tag, attrs)
        put(node, stack[-1] if stack else None)
        hold(node)
        if start >= 0 and (tag in keep_source or (custom and "-" in tag)):
            begin[node] = start
        return node

    def pop_to(k: int, end: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            drop(node)
            if node in begin:
                made.sources[node] = html[begin.pop(node) : end]
            if tags[node] in MARKING:
                while active and active.pop() is not None:
                    pass

    def find(wanted: frozenset[str], stop: frozenset[str], outermost: bool = False) -> int:
        """Where in the stack the innermost (or outermost) of some elements is, before any of others; -1: nowhere."""
        found = -1
        if any(opened.get(t) for t in wanted):
            for k in range(len(stack) - 1, -1, -1):
                tag = tags[stack[k]]
                if tag in wanted:
                    found = k
                    if not outermost:
                        break
                elif tag in stop:
                    break
        return found

    def close(wanted: frozenset[str], stop: frozenset[str], end: int, outermost: bool = False) -> None:
        if (k := find(wanted, stop, outermost)) >= 0:
            pop_to(k, end)

    def reopen() -> None:
        """Opens the formatting elements again that still apply and aren't open."""
        k = len(active)
        while k and active[k - 1] is not None and active[k - 1] not in on_stack:
            k -= 1
        for j in range(k, len(active)):
            active[j] = push(tags[active[j]], attributes[active[j]])

    def last_active(tag: str) -> int:
        for k in range(len(active) - 1, -1, -1):
            if active[k] is None:
                break
            if tags[active[k]] == tag:
                return k
        return -1

    def apply(tag: str, attrs: dict, start: int) -> None:
        """Opens a formatting element; of more than three that are alike the first no longer applies."""
        alike = []
        for k in range(len(active) - 1, -1, -1):
            if active[k] is None:
                break
            if tags[active[k]] == tag and attributes[active[k]] == attrs:
                alike.append(k)
        if len(alike) >= 3:
            del active[alike[2]]
        active.append(push(tag, attrs, start))

    def any_other_end(tag: str, end: int) -> None:
        if opened.get(tag):
            for k in range(len(stack) - 1, -1, -1):
                if tags[stack[k]] == tag:
                    pop_to(k, end)
                    return
                if tags[stack[k]] in SPECIAL:
                    return

    def adopt(tag: str, end: int) -> None:
        """The end of a formatting element: a block that began inside it and is still open moves out, with what it held in a copy of the element."""
        if stack and tags[stack[-1]] == tag and stack[-1] not in active:
            pop_to(len(stack) - 1, end)
            return
        for _ in range(8):
            place = last_active(tag)
            if place < 0:
                any_other_end(tag, end)
                return
            element = active[place]
            if element not in on_stack:
                del active[place]
                return
            at = len(stack) - 1
            while stack[at] != element:
                if tags[stack[at]] in SCOPE:
                    return
                at -= 1
            block_at = next((k for k in range(at + 1, len(stack)) if tags[stack[k]] in SPECIAL), -1)
            if block_at < 0:
                pop_to(at, end)
                active.remove(element)
                return
            block, above = stack[block_at], stack[at - 1] if at else None
            bookmark = place
            last, k = block, block_at
            for inner in range(1, block_at - at + 1):
                k -= 1
                node = stack[k]
                if node == element:
                    break
                where = active.index(node) if node in active else -1
                if inner > 3 and where >= 0:
                    del active[where]
                    bookmark -= where < bookmark
                    where = -1
                if where < 0:
                    del stack[k]
                    drop(node)
                    continue
                copy = new(tags[node], attributes[node])
                active[where] = stack[k] = copy
                drop(node)
                on_stack.add(copy)
                opened[tags[copy]] = opened.get(tags[copy], 0) + 1
                if last == block:
                    bookmark = where + 1
                    detach(last)
                put(last, copy)
                last = copy
            if last == block:
                detach(last)
            put(last, above)
            copy = new(tag, attributes[element])
            kids[copy], kids[block] = kids[block], None
            for child in kids[copy] or ():
                up[child] = copy
            put(copy, block)
            old = active.index(element)
            active.insert(bookmark, copy)
            del active[old + (bookmark <= old)]
            stack.remove(element)
            drop(element)
            hold(copy, stack.index(block) + 1)

    def text(said: str) -> None:
        if active:
            reopen()
        put(new(_TEXT, None, said), stack[-1] if stack else None)

    def void(tag: str, attrs: dict, start: int) -> None:
        node = new(tag, attrs)
        put(node, stack[-1] if stack else None)
        made.whole.add(node)
        if tag in keep_source or (custom and "-" in tag):
            made.sources[node] = html[start:at]

    def item(wanted: frozenset[str], end: int) -> None:
        """A list item or description ends the one before it."""
        if any(opened.get(t) for t in wanted):
            for k in range(len(stack) - 1, -1, -1):
                tag = tags[stack[k]]
                if tag in wanted:
                    pop_to(k, end)
                    return
                if tag in SPECIAL and tag not in ("address", "div", "p"):
                    return

    def end_tag(tag: str, end: int) -> None:
        if tag in FORMATTING:
            adopt(tag, end)
        elif tag == "p":
            close(_P, _BUTTON_SCOPE, end)
        elif tag == "li":
            close(frozenset(["li"]), _ITEM_SCOPE, end)
        elif tag in HEADINGS:
            close(HEADINGS, SCOPE, end)
        elif tag in _TABLE_PARTS:
            close(frozenset([tag]), _TABLE_SCOPE, end)
        elif tag in SCOPED or tag in ("dt", "dd"):
            close(frozenset([tag]), SCOPE, end)
        elif tag == "br":
            put(new("br", {}), stack[-1] if stack else None)
            made.whole.add(len(tags) - 1)
        elif tag not in ("html", "body"):
            any_other_end(tag, end)

    def start_tag(tag: str, attrs: dict, start: int, closed: bool) -> None:
        """An element begins; ``closed``: its tag ends in a slash."""
        if stack and tags[stack[-1]] == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1, start)
        if tag in BLOCK:
            if tag == "li":
                item(frozenset(["li"]), start)
            elif tag in ("dt", "dd"):
                item(frozenset(["dt", "dd"]), start)
            close(_P, _BUTTON_SCOPE, start)
            if tag in HEADINGS and stack and tags[stack[-1]] in HEADINGS:
                pop_to(len(stack) - 1, start)
        if tag in _IMPLIED:
            close(*_IMPLIED[tag], start, outermost=True)
        if tag == "a" and (k := last_active("a")) >= 0:
            before = active[k]
            adopt("a", start)
            if before in active:
                active.remove(before)
            if before in on_stack:
                stack.remove(before)
                drop(before)
        if tag == "nobr" and find(frozenset(["nobr"]), SCOPE) >= 0:
            adopt("nobr", start)
        if tag in ("td", "th") and stack and tags[stack[-1]] in ("table", "thead", "tbody", "tfoot"):
            push("tr", {})  # implied
        if active and tag not in _BEFORE_NONE:
            reopen()
        if tag in VOID or (closed and (opened.get("svg") or opened.get("math") or tag == "svg" or "-" in tag)):
            void(tag, attrs, start)
        elif tag in FORMATTING:
            apply(tag, attrs, start)
        else:
            push(tag, attrs, start)
            if tag in MARKING:
                active.append(None)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at:
            text(decode(html[at:end]))
        if m is None:
            break
        at = m.end()
        if m["comment"] is not None:
            put(new(_COMMENT, None, m["comment"]), stack[-1] if stack else None)
            continue
        if m["cdata"] is not None:
            text(m["cdata"])
            continue
        if m["tag"] is None or m["close"] == "":
            continue
        tag = m["tag"].lower()
        if m["end"]:
            end_tag(tag, at)
            continue
        attrs = _attributes(m["attrs"]) if "=" in m["attrs"] or m["attrs"].strip(" \n\t/") else {}
        start_tag(tag, attrs, end, m["attrs"].rstrip().endswith("/"))
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            inner = html[at : stop.start() if stop else n]
            if inner:
                put(new(_TEXT, None, decode(inner) if tag in ("title", "textarea") else inner), stack[-1])
                if tag == "title" and "&" in inner:
                    made.sources[len(tags) - 1] = title_source(inner)
            at = stop.end() if stop else n
            pop_to(len(stack) - 1, at)
    pop_to(0, n)
    return made


def _order_ruby(ruby: int, names: list, parents: list, codes: list[int]) -> None:
    """Puts a ruby's annotations behind all its bases, and its containers behind these, unless bases and annotations take turns."""
    start = codes.index(2 * ruby) + 1
    parts: list[list[int]] = []
    for code in codes[start:]:
        if code % 2 == 0 and parents[code // 2] == ruby:
            parts.append([])
        parts[-1].append(code)
    heads = [names[part[0] // 2] for part in parts]
    turns = [h for h in heads if h in ("rb", "rt", "rtc")]
    if "rtc" in turns or ("rb", "rt") not in zip(turns, turns[1:]):
        order = {"rt": 1, "rtc": 2}
        codes[start:] = [code for _, part in sorted(zip(heads, parts), key=lambda x: order.get(x[0], 0)) for code in part]


def parse(html: str, keep_source: frozenset[str] = frozenset()) -> Tree:
    """Nodes and runs of a document, read as browsers do.  Elements nest to any depth."""
    made = _built(html, keep_source)
    tags, attributes, texts, kids, sources, whole = made.tags, made.attrs, made.texts, made.kids, made.sources, made.whole
    tree = Tree()
    last, following, previous, closes = (tree.later[name] for name in Tree.LATER)
    fixed, parents, opens = tree.fixed, [], []
    place_of = tree.names
    owners, codes, arounds, lefts = tree.owners, tree.codes, tree.arounds, tree.lefts
    named = NAMED | keep_source
    tag_of: list[str | None] = []
    said: dict[int, int] = {}
    marks: list[int] = []
    seen_marks: set[str] = set()
    a_tag, a_text, a_comment = (place_of.setdefault(kind, len(place_of)) for kind in ("tag", "text", "comment"))

    def cut(owner: int | None) -> None:
        if codes[-1]:
            lefts[-1] = tuple(marks)
            owners.append(owner)
            codes.append([])
            arounds.append(tuple(marks))
            lefts.append(())
        else:
            owners[-1], arounds[-1] = owner, tuple(marks)

    #: For each open element: its node, its children left, counts by tag, the last sibling that counts and those after it, what a
    #: child inherits, the innermost block, and whether its markup is carried from run to run.
    frames = [(-1, iter(made.roots), {}, [-1], (" ", -1, -1, -1, -1, -1, 0, 0, 0), None, False)]
    while frames:
        node, rest, counts, before, inherited, block, marked = frames[-1]
        path, item, cell, table, row, link, n_quotes, n_lists, n_bullets = inherited
        path_at, depth = place_of.setdefault(path, len(place_of)), len(frames) - 1
        for e in rest:
            k, tag = len(parents), tags[e]
            is_tag = tag is not _TEXT and tag is not _COMMENT
            name = tag if is_tag else None
            counts[name] = nth = counts.get(name, 0) + 1
            is_cut = is_tag and name in CUTS
            if is_cut:
                cut(k)
            tag_of.append(name)
            parents.append(node)
            last.append(k)
            tree.attrs.append(attributes[e])
            tree.text.append(texts[e])
            tree.source.append(sources.get(e))
            now = len(codes) - 1
            opens.append(now)
            closes.append(now)
            # White space and comments have siblings, but are none.
            previous.append(before[0])
            following.append(-1)
            if is_tag or (tag is _TEXT and not texts[e].isspace()):
                for j in before:
                    if j >= 0:
                        following[j] = k
                before[:] = [k]
            else:
                before.append(k)
            codes[-1].append(2 * k)
            if not is_tag:
                if tag is _TEXT:
                    said[e] = k
                fixed.extend((node, depth, nth, a_text if tag is _TEXT else a_comment, -1, path_at, item, cell, table, row, link, n_quotes, n_lists, n_bullets, now))
                continue
            own_item, own_cell = k if name == "li" else item, k if name in CELLS else cell
            own_quotes, own_lists, own_bullets = n_quotes + (name == "blockquote"), n_lists + (name in _LISTS), n_bullets + (name in _BULLETS)
            fixed.extend((node, depth, nth, a_tag, place_of.setdefault(name, len(place_of)), path_at, own_item, own_cell, table, row, link, own_quotes, own_lists, own_bullets, now))
            if e in whole:
                if is_cut:
                    cut(block)
                continue
            is_mark = name in MARKED and name not in seen_marks
            if is_mark:
                marks.append(k)
                seen_marks.add(name)
            child = (
                path if name not in named or f" {name} " in path else f"{path}{name} ", own_item, own_cell, k if name == "table" else table, k if name in ("tr", "row") else -1 if name == "table" else row,
                k if name == "a" and "href" in attributes[e] else link, own_quotes, own_lists, own_bullets,
            )
            frames.append((k, iter(kids[e] or ()), {}, [-1], child, k if is_cut else block, is_mark))
            break
        else:
            frames.pop()
            if node < 0:
                break
            name = tag_of[node]
            if name == "ruby" and opens[node] == len(codes) - 1:
                _order_ruby(node, tag_of, parents, codes[-1])
            last[node] = len(parents) - 1
            codes[-1].append(2 * node + 1)
            closes[node] = len(codes) - 1
            if marked:
                marks.pop()
                seen_marks.discard(name)
            if name in CUTS:
                cut(frames[-1][5])
    tree.said = [said[e] for e in sorted(said)]
    return tree


class Packed:
    """What a tree is but for its texts and sources, ready to be put beside others; pages of one make share it."""

    __slots__ = ("size", "names", "numbers", "attrs", "keys", "values", "owners", "runs", "said")

    def __init__(self, t: Tree):
        self.size, self.names, self.said = len(t.attrs), list(t.names), t.said
        number = np.int16 if self.size < 1 << 14 else np.int32  # codes are up to twice as large
        fixed = np.array(t.fixed, dtype=number).reshape(-1, len(Tree.FIXED)).T.copy()
        self.numbers = dict(zip(Tree.FIXED, fixed)) | {name: np.array(t.later[name], dtype=number) for name in Tree.LATER}
        self.attrs = np.array([len(a) if a else 0 for a in t.attrs], dtype=number)
        self.keys = [k for a in t.attrs if a for k in a]
        self.values = [v for a in t.attrs if a for v in a.values()]
        kept = [k for k, run in enumerate(t.codes) if run]
        self.owners = np.array([-1 if t.owners[k] is None else t.owners[k] for k in kept], dtype=number)
        #: Of codes, arounds and lefts the size in each run, and all one after the other.
        self.runs = []
        for name in ("codes", "arounds", "lefts"):
            parts = [getattr(t, name)[k] for k in kept]
            self.runs.append((np.array([len(part) for part in parts], dtype=np.int32), np.array([x for part in parts for x in part], dtype=number)))


_MARKUP = re.compile(r"(<[^<>]*>)")
#: Nodes that a process keeps of makes met before (of some 60 bytes each; a make itself counts as 64), and those of one make at most.
MOST_KEPT, MOST_OF_ONE = 1 << 20, 1 << 13


class Makes:
    """Pages met before, by their *make*: their tags as written, and which texts stand between them, blank or not.

    What these decide of a tree is worked out once; pages of one template differ in their texts alone.
    """

    def __init__(self):
        self.known: dict[tuple[str, bytes], Packed] = {}
        self.plain: dict[str, bool] = {}
        self.kept = 0

    def _is_plain(self, tag: str) -> bool:
        """Whether a tag ends where it seems to, wherever it stands, and begins no raw text."""
        found = self.plain.get(tag)
        if found is None:
            m = _TOKEN.fullmatch(tag)
            found = m is not None and m["tag"] is not None and m["close"] == ">" and m["tag"].lower() not in RAW
            if len(self.plain) < 1 << 14:
                self.plain[tag] = found
        return found

    def parse(self, html: str) -> tuple[Packed, list, list]:
        """A page's tree, its nodes' texts and their sources."""
        parts = _MARKUP.split(html)
        tags = parts[1::2]
        if html.count("<") != len(tags) or len(html) > MOST_OF_ONE << 4 or not all(map(self._is_plain, set(tags))):
            return _with_texts(parse(html))
        texts = [decode(x) if x else None for x in parts[::2]]
        make = "".join(tags), bytes([0 if x is None else 1 if x.isspace() else 2 for x in texts])
        packed = self.known.pop(make, None)
        if packed is None:
            whole = _with_texts(parse(html))
            packed = whole[0]
            if packed.size <= MOST_OF_ONE:
                self.known[make] = packed
                self.kept += packed.size + 64
                while self.kept > MOST_KEPT:  # what wasn't met for longest goes
                    self.kept -= self.known.pop(next(iter(self.known))).size + 64
            return whole
        self.known[make] = packed
        said: list[str | None] = [None] * packed.size
        for k, x in zip(packed.said, (x for x in texts if x is not None)):
            said[k] = x
        return packed, said, [None] * packed.size


def _with_texts(tree: Tree) -> tuple[Packed, list, list]:
    return Packed(tree), tree.text, tree.source


_MAKES = Makes()


def _parsed(html: str, keep_source: frozenset[str]) -> tuple[Packed, list, list]:
    return _with_texts(parse(html, keep_source)) if keep_source else _MAKES.parse(html)


# --- on Spark ---------------------------------------------------------------

def _numbers(values: list[np.ndarray]) -> pa.Array:
    """Numbers one after the other; -1 is null."""
    found = np.concatenate(values) if values else np.empty(0, dtype=np.int32)
    return pa.array(found, pa.int32(), mask=found < 0)


def _ends(sizes: list[np.ndarray]) -> pa.Array:
    """Where lists of some sizes begin, and the last one's end."""
    return pa.array(np.concatenate([[0], *sizes]).cumsum(), pa.int32())


def _arrays(trees: list[tuple[Packed, list, list] | None]) -> list[pa.Array]:
    """Columns ``nodes`` and ``runs`` of some documents; both null for None."""
    empty = Packed(Tree()), [], []
    all_ = [t or empty for t in trees]
    found = [t[0] for t in all_]
    sizes = np.array([t.size for t in found], dtype=np.int32)
    none = pa.array([t is None for t in trees])
    columns: dict[str, pa.Array] = {"id": pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if found else np.empty(0, dtype=np.int32))}
    for name in (*Tree.FIXED, *Tree.LATER):
        if name not in Tree.NAMES:
            columns[name] = _numbers([t.numbers[name] for t in found])
    # Names by their places in one list of all documents' names.
    known: dict[str, int] = {}
    places = [np.array([known.setdefault(name, len(known)) for name in t.names] + [-1], dtype=np.int32) for t in found]
    dictionary = pa.array(list(known), pa.string())
    for name in Tree.NAMES:
        at = np.concatenate([p[t.numbers[name]] for p, t in zip(places, found)] or [np.empty(0, dtype=np.int32)])
        columns[name] = dictionary.take(pa.array(at, mask=at < 0))
    keys, values = (pa.array([x for t in found for x in getattr(t, name)], pa.string()) for name in ("keys", "values"))
    columns["attrs"] = pa.MapArray.from_arrays(_ends([t.attrs for t in found]), keys, values)
    for k, name in enumerate(("text", "source"), 1):
        columns[name] = pa.array([x for t in all_ for x in t[k]], pa.string())
    names = ["id", *Tree.COLUMNS]
    nodes = pa.ListArray.from_arrays(_ends([sizes]), pa.StructArray.from_arrays([columns[name] for name in names], names), mask=none)
    lists = []
    for k in range(3):
        flat = np.concatenate([t.runs[k][1] for t in found] or [np.empty(0, dtype=np.int32)])
        lists.append(pa.ListArray.from_arrays(_ends([t.runs[k][0] for t in found]), pa.array(flat, pa.int32())))
    owners = _numbers([t.owners for t in found])
    runs = pa.ListArray.from_arrays(_ends([np.array([len(t.owners) for t in found], dtype=np.int32)]), pa.StructArray.from_arrays([owners, *lists], ["owner", "codes", "around", "left"]), mask=none)
    return [nodes, runs]


def parse_documents(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("doc_id",), keep_source: frozenset[str] = frozenset(), checked: bool = False, decoded: str | None = None, batch_chars: int = 1 << 21) -> DataFrame:
    """Columns ``keep`` of ``pages``, with ``nodes`` and ``runs`` (see :data:`NODE`, :data:`RUN`) of every row.

    Both are null for null pages and those that
    :func:`pagequarry.functions.text.invalid_reason` rejects.  Rows stay where they
    are, whatever their ids; documents are parsed in groups of ``batch_chars``.
    ``checked`` pages are not looked at again for what isn't text.  ``decoded`` names one of
    ``keep`` whose references are decoded on the way.
    """
    source = T.normalize_input(F.col(html))
    source = source if checked else F.when(T.invalid_reason(F.col(html)).isNull(), source)
    kept = pages.select(*keep, source.alias("_html"))
    schema = StructType(kept.schema.fields[:-1])
    whole = f"{schema.simpleString()[7:-1]}{',' if keep else ''}nodes:array<{NODE}>,runs:array<{RUN}>"
    names = [*keep, "nodes", "runs"]
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, trees = 0, 0, []
            for k, page in enumerate(batch.column(len(keep))):
                page = page.as_py()
                trees.append(None if page is None else _parsed(page, keep_source))
                size += len(page or "")
                if size >= batch_chars or k == batch.num_rows - 1:
                    part = batch.slice(first, k + 1 - first)
                    columns = [part.column(j).cast(t) for j, t in enumerate(types)]
                    if decoded is not None:
                        j = keep.index(decoded)
                        columns[j] = pa.array([None if t is None else decode(t) for t in columns[j].to_pylist()], types[j])
                    yield pa.RecordBatch.from_arrays([*columns, *_arrays(trees)], names=names)
                    first, size, trees = k + 1, 0, []

    return kept.mapInArrow(run, f"struct<{whole}>")


def parse_nodes(pages: DataFrame, doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """One row a node of every document of ``pages``: ``doc_id`` and the fields of :data:`NODE`."""
    documents = parse_documents(pages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(html).alias("html")))
    return documents.select("doc_id", F.inline("nodes"))


def built_once(build: Callable):
    """``build`` for expressions that depend on its (hashable) arguments alone: built once for each, then used again."""

    @lru_cache(maxsize=64)
    def kept(jvm: int, *args):
        return build(*args)

    return wraps(build)(lambda *args: kept(id(SparkContext._jvm), *args))


def held(c: Column) -> Column:
    """``c`` worked out where it stands: the optimizer neither copies it into later steps nor pushes filters through it.

    Steps that loop over arrays name the step before in their loops; put together
    to one expression they would work it out again for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array the join (associative, such as a sum or a maximum) of the values up to it.

    Each round joins what lies twice as far apart, so n values take about log2(n) passes.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def once(a: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(a, lambda x, i: F.when(i >= reach, join(F.get(a, i - reach), x)).otherwise(x))

    return F.when(F.size(values) > 0, F.aggregate(rounds, values, once)).otherwise(values)


def spread_out(starts: Column, values: Column, size: Column, first: Column) -> Column:
    """An array of ``size`` places: ``values[k]`` from ``starts[k]`` (ascending) up to the next start, ``first`` before all of them."""

    def spread(starts: Column, values: Column) -> Column:
        spans = F.transform(starts, lambda a, k: F.array_repeat(F.get(values, k), F.coalesce(F.get(starts, k + 1), size) - a))
        return F.when(F.size(starts) > 0, F.concat(F.array_repeat(first, F.get(starts, F.lit(0))), F.flatten(spans))).otherwise(F.array_repeat(first, size))

    return let(starts, lambda s: let(values, lambda v: spread(s, v)))


def marked_places(places: Column, size: Column) -> Column:
    """An array of ``size`` booleans, true at some places (ascending, different)."""

    def spread(places: Column) -> Column:
        runs = F.transform(places, lambda a, k: F.concat(F.array_repeat(F.lit(False), a - F.coalesce(F.get(places, k - 1) + 1, F.lit(0))), F.array(F.lit(True))))
        rest = F.array_repeat(F.lit(False), size - F.coalesce(F.try_element_at(places, F.lit(-1)) + 1, F.lit(0)))
        return F.concat(F.flatten(runs), rest)

    return let(places, spread)


def stretch(items: Column, first: Column, size: Column) -> Column:
    """``size`` items from place ``first`` (counted from 0) on.  (``slice`` would copy the whole array each time.)"""
    return F.filter(F.transform(F.sequence(first, first + F.greatest(size, F.lit(1)) - 1), lambda i: F.get(items, i)), lambda x: size > 0)


def below(node: Column) -> Column:
    """The nodes in an element, without itself."""
    return stretch(F.col("nodes"), node["id"] + 1, node["last"] - node["id"])


def text_in(node: Column) -> Column:
    """All text in an element."""
    return F.array_join(F.transform(F.filter(below(node), lambda x: x["kind"] == "text"), lambda x: x["text"]), "")


def within(node: Column, *tags: str) -> Column:
    """Whether any element with one of some tags lies around a node."""
    found = F.lit(False)
    for t in tags:
        found = found | F.contains(node["path"], F.lit(f" {t} "))
    return found
