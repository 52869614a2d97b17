"""Which nodes count: preprocessing, selectors, hidden elements and depth."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.nodes import built_once, let, scan
from pagequarry.plans.options import CALLBACKS, Options

# What marks navigation and noise.
NAV_ROLES = ("navigation", "menubar", "tablist", "toolbar")
NAV_LABELS = ("navigation", "menu", "contents", "table of contents", "toc")
NAV_WORDS = tuple(
    """nav navigation navbar breadcrumbs breadcrumb toc sidebar sidenav menu menubar mainmenu subnav tabs tablist toolbar pager pagination
    skipnav skip-link skiplinks site-nav site-menu site-header site-footer topbar bottombar masthead vector-nav vector-header vector-footer""".split()
)
NOISE_WORDS = tuple("cookie consent gdpr banner advertisement ad-container advert social-share share-buttons popup modal-overlay newsletter-signup".split())
#: Elements whose inside is never shown.
UNSEEN = tuple("head script style title template noscript".split())

_SELECTOR = re.compile(r"^([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\]\s]+))?\])*)$")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\]\s]+))?\]")


def _value(node: Column, name: str) -> Column:
    return F.coalesce(node["attrs"][name], F.lit(""))


def _has_word(node: Column, name: str, words: tuple[str, ...]) -> Column:
    """Whether a word of an attribute, with ``_ : . /`` as hyphens, is one of some."""
    value = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.translate(_value(node, name), "_:./", "----")), r"\s+", " "), F.lit(" "))
    return (_value(node, name) != "") & value.rlike(f" ({'|'.join(words)}) ")


def navigation_hint(node: Column) -> Column:
    label = _value(node, "aria-label")
    said = (label != "") & F.lower(label).rlike("|".join(NAV_LABELS))
    return _has_word(node, "role", NAV_ROLES) | said | _has_word(node, "class", NAV_WORDS) | _has_word(node, "id", NAV_WORDS)


def noise_hint(node: Column) -> Column:
    return _has_word(node, "class", NOISE_WORDS) | _has_word(node, "id", NOISE_WORDS)


def is_dropped(node: Column, options: Options) -> Column:
    """Elements that preprocessing removes with all they hold; the first rule that fits decides.

    Nothing is removed while a visitor is declared, but from plain text.
    """
    p = options.preprocessing
    tag = node["tag"]
    if not p.enabled or p.preset == "minimal" or (options.visitor and options.output_format != "plain"):
        return F.lit(False)
    hint = navigation_hint(node)
    strong = p.preset == "aggressive"
    out = F.when(tag == "form", F.lit(True)) if p.remove_forms else F.when(F.lit(False), F.lit(True))
    if strong:
        out = out.when(tag == "noscript", F.lit(True))
    if not p.remove_navigation:
        return out.otherwise(F.lit(False))
    out = out.when(tag == "nav", F.lit(True)).when(tag == "header", hint)
    out = out.when(tag.isin("footer", "aside"), F.lit(True) if strong else hint)
    if strong:
        out = out.when(hint | noise_hint(node), F.lit(True))
    return out.otherwise(F.lit(False))


def matches(node: Column, selector: str) -> Column | None:
    """A tag, ``.class``, ``#id``, ``[name]`` or ``[name='value']``, or these joined; None for anything else."""
    m = _SELECTOR.match(selector.strip())
    if not m or not selector.strip():
        return None
    out = F.lit(True) if m[1] in (None, "*") else node["tag"] == m[1].lower()
    for sign, name, attr, value in _PART.findall(m[2]):
        if sign == ".":
            out = out & F.array_contains(F.split(_value(node, "class"), r"\s+"), name)
        elif sign == "#":
            out = out & (node["attrs"]["id"] == name)
        elif value:
            out = out & (node["attrs"][attr.lower()] == value.strip("\"'"))
        else:
            out = out & F.map_contains_key(node["attrs"], F.lit(attr.lower()))
    return F.coalesce(out, F.lit(False))


def selected(node: Column, selectors: tuple[str, ...]) -> Column:
    """Elements that any of the selectors (comma lists allowed) fits; those that can't be read are skipped."""
    out = F.lit(False)
    for part in (p for s in selectors for p in s.split(",")):
        one = matches(node, part)
        out = out if one is None else out | one
    return out


def asked(node: Column, callback: str, options: Options) -> Column:
    """Whether a visitor's callback is asked about a node."""
    tag = node["tag"]
    if callback == "text":
        return node["kind"] == "text"
    if callback == "custom_element":
        return F.coalesce(F.contains(tag, F.lit("-")), F.lit(False))
    if callback in ("element_start", "element_end"):
        tags = options.visitor[callback].get("tags")
        return F.coalesce(tag.isin(*tags), F.lit(False)) if tags else tag.isNotNull()
    return F.coalesce(tag.isin(*CALLBACKS[callback]), F.lit(False))


def _acts(options: Options, *actions: str) -> list[tuple[str, dict]]:
    return [(c, v) for c, v in options.visitor.items() if v.get("action") in actions and c != "text"]


def _replaced(node: Column, options: Options) -> Column:
    """Elements whose inside gives way to what stands for them."""
    out = node["tag"].isin("svg", "iframe", *options.preserve_tags)
    for c, v in _acts(options, "custom", "preserve_html", "custom_template"):
        no_text = v["action"] == "custom_template" and ((c in ("image", "audio", "video", "iframe", "input") and "{text}" not in v.get("template", "")) or c == "element_start")
        if v["action"] == "preserve_html" and c in ("element_start", "element_end"):
            continue  # goes on as usual
        if (v["action"] != "custom_template" or no_text) and (c == "element_end" or c == "element_start" or not c.endswith(("_start", "_end"))):
            out = out | asked(node, c, options)
    return out


@built_once
def gone(options: Options) -> Column:
    """For every node, whether it goes: comments, nodes that are too deep, and what stands in an element that goes with all it holds or only shows what replaces it.

    The former are what preprocessing, selectors and a visitor's ``skip`` remove, hidden
    elements, and those whose inside is never shown.  A running maximum of where they
    end leaves those that lie in no other, and these are spread out over the nodes, so
    that a page takes time in proportion to its size however many there are.
    """
    unseen = [t for t in (*UNSEEN, *(("svg", "math") if options.output_format == "plain" else ("rp",))) if t not in options.preserve_tags]

    def goes(n: Column) -> Column:
        out = n["tag"].isin(*unseen) | F.map_contains_key(n["attrs"], F.lit("hidden")) | is_dropped(n, options) | selected(n, options.exclude_selectors)
        for c, _ in _acts(options, "skip"):
            if c not in ("table_row",):  # a row is left out of its table
                out = out | (asked(n, c, options) & ~n["tag"].isin(*options.preserve_tags))
        return (n["kind"] == "tag") & F.coalesce(out, F.lit(False))

    def empties(n: Column) -> Column:
        return (n["kind"] == "tag") & F.coalesce(_replaced(n, options), F.lit(False)) & (n["last"] > n["id"])

    def outermost(all_: Column) -> Column:
        ends = scan(F.transform(all_, lambda g: g["last"]), F.greatest)
        return let(ends, lambda e: F.filter(all_, lambda g, k: (k == 0) | (g["first"] > F.get(e, k - 1))))

    def spread(found: Column) -> Column:
        spans = F.transform(
            found,
            lambda g, k: F.concat(
                F.array_repeat(F.lit(False), g["first"] - F.coalesce(F.get(found, k - 1)["last"] + 1, F.lit(0))),
                F.array_repeat(F.lit(True), g["last"] - g["first"] + 1),
            ),
        )
        return F.concat(F.flatten(spans), F.array_repeat(F.lit(False), F.size("nodes") - F.coalesce(F.try_element_at(found, F.lit(-1))["last"] + 1, F.lit(0))))

    def with_own(inside: Column) -> Column:
        def one(n: Column) -> Column:
            out = F.get(inside, n["id"]) | (n["kind"] == "comment")
            return out if options.max_depth is None else out | (n["depth"] >= options.max_depth)

        return F.transform("nodes", one)

    found = F.transform("nodes", lambda n: F.struct((n["id"] + F.when(goes(n), 0).when(empties(n), 1)).alias("first"), n["last"].alias("last")))
    going = F.filter(found, lambda g: g["first"].isNotNull())
    whole = let(let(let(going, outermost), spread), with_own)
    if options.visitor or options.exclude_selectors or options.max_depth is not None or options.preprocessing.preset == "aggressive":
        return whole

    def may_go(n: Column) -> Column:
        named = n["tag"].isin(*unseen, "svg", "iframe", *options.preserve_tags, "form", "nav", "header", "footer", "aside")
        return F.coalesce(named | F.map_contains_key(n["attrs"], F.lit("hidden")), n["kind"] == "comment")

    return F.when(F.exists("nodes", may_go), whole).otherwise(F.transform("nodes", lambda n: F.lit(False)))


def stays(node: Column, gone: Column) -> Column:
    """Whether a node is none of the ``gone``."""
    return ~F.get(gone, node["id"])


def shown(documents: DataFrame, options: Options) -> DataFrame:
    """The nodes of ``documents`` that show, a row each with its ``doc_id``."""
    left = let(gone(options), lambda g: F.filter("nodes", lambda n: stays(n, g)))
    return documents.select("doc_id", F.inline(left))
