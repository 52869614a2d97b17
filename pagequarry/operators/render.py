"""Nodes to Markdown, Djot or plain text, by expressions over a document's arrays.

Each node gives a piece of text where it opens and one where it closes; a run's
pieces are joined to a *line*, in which marks from the private-use area stand for
markup until their surroundings are known.  Lines in cells become tables; the other
lines get their prefixes (lists, quotes) and are joined to the document.  All of it
is one expression over the row that a document is, so nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators import filters
from pagequarry.operators.nodes import CELLS, below, built_once, held, let, marked_places, scan, stretch, text_in, within
from pagequarry.plans.options import CALLBACKS, Options

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS = ("ul", "ol", "menu")
#: Text right in these, and not in a cell, shows nothing.
TABLE_PARTS = ("table", "tr", "row", "thead", "tbody", "tfoot", "caption", "colgroup")
#: Where a line break in a text stands for a space.
INLINE = tuple("p a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small strong sub sup time tt u var".split())

# Marks: one private-use character each.
_NAMES = "strong em del ins mark code sub sup link q".split()
OPEN = {n: chr(0xE000 + 2 * k) for k, n in enumerate(_NAMES)}
CLOSE = {n: chr(0xE001 + 2 * k) for k, n in enumerate(_NAMES)}
#: A link's target follows; a hard line break; a paragraph's end; a quote's source follows; a space and a line end to keep.
HREF, BREAK, BLANK, CITE, SPACE, LINE = (chr(c) for c in range(0xE020, 0xE026))
#: With link references: the target of an image or of media begins, and ends.
IMAGE, IMAGE_END = chr(0xE026), chr(0xE027)
#: What a text has that may have to change, besides two spaces in a row: tabs, line ends and the like, marks, and spaces of other kinds.
ODD = r"[\x00-\x1f\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\ue000-\ue0ff]"
#: Any opening or closing mark.
PAIR_MARK = r"[\uE000-\uE013]"
ANY_MARK = r"[-]"
_PAIRED = ("strong", "em", "del", "ins", "mark", "sub", "sup")

_TAG_MARK = {
    "strong": "strong",
    "b": "strong",
    "em": "em",
    "i": "em",
    "var": "em",
    "dfn": "em",
    "del": "del",
    "s": "del",
    "strike": "del",
    "ins": "ins",
    "mark": "mark",
    "code": "code",
    "kbd": "code",
    "samp": "code",
    "sub": "sub",
    "sup": "sup",
    "q": "q",
}


def _tags_of(name: str, options: Options) -> list[str]:
    return [t for t, m in _TAG_MARK.items() if m == name and t not in options.strip_tags and t not in _visited(options)]


def _marks(n: Column, options: Options) -> list[tuple[str, Column]]:
    """For each mark, which elements it stands for: within code there are none, and within the same mark no second."""
    code = within(n, "code", "pre", "kbd", "samp")
    return [(name, n["tag"].isin(*tags) & ~within(n, *tags) & ~code) for name in _NAMES if (tags := _tags_of(name, options))]


def _visited(options: Options) -> set[str]:
    """Tags whose markup a visitor gives."""
    return {t for c, v in options.visitor.items() if v.get("action") in ("custom", "custom_template", "preserve_html") for t in CALLBACKS[c] if not c.endswith(("_start", "_end"))}


def _attr(n: Column, name: str) -> Column:
    return F.coalesce(n["attrs"][name], F.lit(""))


def _has(n: Column, name: str) -> Column:
    return F.map_contains_key(n["attrs"], F.lit(name))


def _hard(c: Column) -> Column:
    """Text whose blanks stay as they are."""
    return F.translate(c, " \n", SPACE + LINE)


def _first(nodes: Column, test) -> Column:
    return F.get(F.filter(nodes, test), F.lit(0))


def _language(n: Column) -> Column:
    return F.nullif(F.regexp_extract(_attr(n, "class"), r"(?:^|\s)(?:language|lang)-(\S+)", 1), F.lit(""))


def target(href: Column, options: Options) -> Column:
    """A link's target as it is written."""
    if options.url_escape_style == "percent":
        return F.when(href == "", F.lit("<>")).otherwise(T.percent_encode(href))
    n_open = F.length(href) - F.length(F.replace(href, F.lit("("), F.lit("")))
    n_close = F.length(href) - F.length(F.replace(href, F.lit(")"), F.lit("")))
    escaped = F.when(n_open != n_close, F.regexp_replace(href, r"([()])", r"\\$1")).otherwise(href)
    return F.when((href == "") | href.rlike(r"[ \n]"), F.concat(F.lit("<"), href, F.lit(">"))).otherwise(escaped)


def _quoted(title: Column, escape: bool) -> Column:
    inner = F.replace(title, F.lit('"'), F.lit('\\"')) if escape else title
    return F.when(title != "", F.concat(F.lit(' "'), inner, F.lit('"'))).otherwise(F.lit(""))


def _link_end(n: Column, options: Options) -> Column:
    return F.concat(F.lit(HREF), target(_attr(n, "href"), options), _quoted(_attr(n, "title"), True), F.lit(CLOSE["link"]))


def _image(n: Column, options: Options) -> Column:
    attrs = n["attrs"]
    src = F.when(n["tag"] == "graphic", F.coalesce(attrs["url"], attrs["href"], attrs["xlink:href"], attrs["src"], F.lit(""))).otherwise(_attr(n, "src"))
    alt = F.when(n["tag"] == "graphic", F.coalesce(attrs["alt"], attrs["filename"], F.lit(""))).otherwise(_attr(n, "alt"))
    if options.output_format == "plain":
        return alt
    if options.skip_images:
        return F.lit("")
    where = T.markdown_target(src)
    if options.url_escape_style == "percent":
        where = T.percent_encode(where)
    if options.link_style == "reference":
        whole = F.concat(F.lit("!["), alt, F.lit(IMAGE), where, _quoted(_attr(n, "title"), True), F.lit(IMAGE_END))
    else:
        whole = F.concat(F.lit("!["), alt, F.lit("]("), where, _quoted(_attr(n, "title"), False), F.lit(")"))
    bare = [h for h in HEADINGS if h not in options.keep_inline_images_in]
    if options.convert_as_inline:
        return alt
    return F.when(within(n, *bare), alt).otherwise(whole) if bare else whole


#: Attributes of SVG and MathML whose names have capitals.
_MIXED = """attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform
    gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits
    maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits
    refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles
    surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan definitionURL""".split()


def markup(n: Column) -> Column:
    """An element as HTML again: attributes sorted, their names in the spelling of SVG, elements without content closed at once.

    Openings and texts stand at their nodes' places, closings behind the last node
    inside, inner ones first; sorted by these, they are the source.
    """
    entity = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    spelled = F.create_map(*(F.lit(x) for name in _MIXED for x in (name.lower(), name)))

    def attribute(e: Column) -> Column:
        value = F.when(F.coalesce(e["value"], F.lit("")) != "", F.concat(F.lit('="'), F.replace(F.replace(e["value"], F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))).otherwise("")
        return F.concat(F.lit(" "), F.coalesce(spelled[e["key"]], e["key"]), value)

    def opening(x: Column) -> Column:
        attrs = F.array_join(F.transform(F.array_sort(F.map_entries(x["attrs"])), attribute), "")
        tag = F.concat(F.lit("<"), x["tag"], attrs, F.when(x["last"] > x["id"], F.lit(">")).otherwise(F.lit(" />")))
        return F.struct(x["id"].alias("place"), F.lit(0).alias("kind"), F.lit(0).alias("inner"), F.when(x["kind"] == "text", entity(x["text"])).otherwise(tag).alias("text"))

    def closing(x: Column) -> Column:
        return F.struct(x["last"].alias("place"), F.lit(1).alias("kind"), (-x["id"]).alias("inner"), F.concat(F.lit("</"), x["tag"], F.lit(">")).alias("text"))

    all_ = F.filter(F.concat(F.array(n), below(n)), lambda x: x["kind"] != "comment")
    events = let(all_, lambda a: F.array_sort(F.concat(F.transform(a, opening), F.transform(F.filter(a, lambda x: (x["kind"] == "tag") & (x["last"] > x["id"])), closing))))
    return F.array_join(F.transform(events, lambda e: e["text"]), "")


def _svg(n: Column, options: Options) -> Column:
    title = _first(below(n), lambda x: x["tag"] == "title")
    name = F.coalesce(F.nullif(F.when(title.isNotNull(), T.one_line(text_in(title))), F.lit("")), F.lit("SVG Image"))
    if options.skip_images:
        return F.lit("")
    if options.convert_as_inline:
        return name
    return F.concat(F.lit("!["), name, F.lit("](data:image/svg+xml;base64,"), T.base64(F.encode(markup(n), "UTF-8")), F.lit(")"))


def _ruby_mark(n: Column, mark: str, first: bool) -> Column:
    """A parenthesis around an annotation, two at either end of several ones that a container follows."""
    ruby = F.get("nodes", n["parent"])
    own = lambda tag: F.filter(below(ruby), lambda x: (x["tag"] == tag) & (x["parent"] == ruby["id"]))
    said = F.exists(own("rtc"), lambda x: F.trim(text_in(x)) != "")
    twice = let(own("rt"), lambda all_: (F.size(all_) > 1) & (F.element_at(all_, 1 if first else -1)["id"] == n["id"]))
    return F.when((ruby["tag"] == "ruby") & F.coalesce(said & twice, F.lit(False)), F.lit(mark * 2)).otherwise(F.lit(mark))


def _in_ruby(n: Column, text: Column) -> Column:
    """A text in ruby without the blanks at the borders of bases and annotations."""
    owner = F.get("nodes", n["parent"])
    sides = ("rt", "rtc", "rb", "rp")
    beside = lambda x: x["tag"].isNull() | x["tag"].isin(*sides)
    # Siblings that count leave blanks out, so a text is beside the border where no other stands there.
    left = beside(F.get("nodes", n["previous"])) & (n["previous"].isNull() | (F.get("nodes", n["previous"])["kind"] == "tag"))
    right = beside(F.get("nodes", n["next"])) & (n["next"].isNull() | (F.get("nodes", n["next"])["kind"] == "tag"))
    trimmed = F.when(F.coalesce(left, F.lit(True)), F.ltrim(text)).otherwise(text)
    trimmed = F.when(F.coalesce(right, F.lit(True)), F.rtrim(trimmed)).otherwise(trimmed)
    return F.when(within(n, "ruby") & owner["tag"].isin("ruby", "rt", "rb", "rtc"), trimmed).otherwise(text)


def _media(n: Column, options: Options) -> Column:
    source = _first(below(n), lambda x: (x["tag"] == "source") & (_attr(x, "src") != ""))
    src = F.when(n["tag"] == "iframe", _attr(n, "src")).otherwise(F.coalesce(F.nullif(_attr(n, "src"), F.lit("")), source["attrs"]["src"], F.lit("")))
    begin, end = (IMAGE, IMAGE_END) if options.link_style == "reference" else ("](", ")")
    return let(src, lambda s: F.when(s == "", "").otherwise(F.concat(F.lit("["), s, F.lit(begin), s, F.lit(end + BLANK))))


# --- pieces -------------------------------------------------------------------


def _filled(template: str, n: Column) -> Column:
    """A visitor's template with an element's values in its holes."""
    c = F.lit(template)
    for hole, name in (("href", "href"), ("src", "src"), ("alt", "alt"), ("title", "title"), ("id", "id"), ("action", "action"), ("method", "method"), ("input_type", "type"), ("name", "name"), ("value", "value")):
        if "{" + hole + "}" in template:
            c = F.replace(c, F.lit("{" + hole + "}"), _attr(n, name))
    if "{tag}" in template:
        c = F.replace(c, F.lit("{tag}"), F.coalesce(n["tag"], F.lit("")))
    if "{level}" in template:
        c = F.replace(c, F.lit("{level}"), F.regexp_extract(n["tag"], "^h([1-6])$", 1))
    return _hard(c)


def _halves(v: dict) -> tuple[str, str]:
    """What a visitor's answer puts before and behind an element's own output."""
    if v["action"] == "custom":
        return v.get("output", ""), ""
    template = v.get("template", "{text}")
    hole = next((h for h in ("{text}", "{content}", "{output}") if h in template), None)
    before, _, after = template.partition(hole) if hole else (template, "", "")
    return before, after


def _visitor_rules(n: Column, options: Options) -> list[tuple[Column, Column | None, Column | None]]:
    out = []
    for callback, v in options.visitor.items():
        action = v.get("action")
        if callback in ("text", "element_end", "table_row", "table_start", "table_end") or action not in ("custom", "custom_template", "preserve_html"):
            continue
        if callback == "element_start" and action == "preserve_html":
            continue
        use = filters.asked(n, callback, options)
        if action == "preserve_html":
            out.append((use, _hard(n["source"]), F.lit("")))
            continue
        before, after = _halves(v)
        if callback.endswith("_end"):
            out.append((use, None, _filled(before + after, n)))
        elif callback == "element_start":
            out.insert(0, (use, _filled(before + after, n), F.lit("")))
        elif callback.endswith("_start"):
            out.append((use, _filled(before, n), None))
        else:
            out.append((use, _filled(before, n), _filled(after, n)))
    return out


def _ended(n: Column, opening: Column, closing: Column, options: Options) -> tuple[Column, Column]:
    """An element's texts with what ``element_end`` makes of its output, which then is part of its parent's."""
    v = options.visitor.get("element_end", {})
    if v.get("action") not in ("custom", "custom_template"):
        return opening, closing
    before, after = _halves(v)
    use = filters.asked(n, "element_end", options)
    if v["action"] == "custom":
        return F.when(use, _filled(before, n)).otherwise(opening), F.when(use, F.lit("")).otherwise(closing)
    hashes = F.when(n["tag"].isin(*HEADINGS), F.concat(F.repeat(F.lit("#"), F.substring(n["tag"], 2, 1).cast("int")), F.lit(" "))).otherwise("") if options.output_format != "plain" else F.lit("")
    return F.when(use, F.concat(_filled(before, n), hashes, opening)).otherwise(opening), F.when(use, F.concat(closing, _filled(after, n))).otherwise(closing)


def keep_source(options: Options) -> frozenset[str]:
    """Tags whose own HTML rendering asks for."""
    preserved = [t for c, v in options.visitor.items() if v.get("action") == "preserve_html" for t in (("-",) if c == "custom_element" else CALLBACKS[c])]
    return frozenset([*options.preserve_tags, *preserved])


def _ruled(options: Options) -> list[str]:
    """Tags that some of the rules are about."""
    visited = [t for c in options.visitor for t in CALLBACKS[c]]
    return sorted({*_TAG_MARK, *visited, *options.preserve_tags, *"img graphic br hr input option a abbr iframe audio video rt optgroup blockquote span svg math".split()})


def _rules(n: Column, options: Options) -> list[tuple[Column, Column | None, Column | None]]:
    """(which elements, text where they open, text where they close); the first that fits counts."""
    tag, plain = n["tag"], options.output_format == "plain"
    rules = _visitor_rules(n, options)
    none = F.lit("")
    if options.preserve_tags:
        rules.append((tag.isin(*options.preserve_tags), _hard(n["source"]), none))
    if options.strip_tags:
        rules.append((tag.isin(*options.strip_tags), none, none))
    checkbox = (tag == "input") & (F.lower(_attr(n, "type")) == "checkbox") & n["item"].isNotNull()
    rules += [
        (tag.isin("img", "graphic"), _image(n, options), none),
        (tag == "br", F.lit(BREAK), none),
        (tag == "hr", F.lit("" if plain else "---"), none),
        (checkbox, F.when(_has(n, "checked"), F.lit("[x] ")).otherwise(F.lit("[ ] ")), none),
        (tag == "option", F.when(_has(n, "selected"), F.lit("* ")).otherwise(none), none),
    ]
    if plain:
        return rules
    caret = tag.isin("em", "i") & F.contains(_attr(n, "class"), F.lit("caret"))
    rules += [
        (caret & (F.trim(text_in(n)) == "") if not options.convert_as_inline else F.lit(False), F.lit(" > "), none),
        ((tag == "a") & _has(n, "href") & n["link"].isNull(), F.lit(OPEN["link"]), _link_end(n, options)),
        (tag == "abbr", none, F.when(_attr(n, "title") != "", F.concat(F.lit(" ("), _attr(n, "title"), F.lit(")"))).otherwise(none)),
        (tag.isin("iframe", "audio", "video"), _media(n, options), none),
        (tag == "rt", _ruby_mark(n, "(", first=True), _ruby_mark(n, ")", first=False)),
        (tag == "optgroup", F.concat(F.lit(OPEN["strong"]), _attr(n, "label"), F.lit(CLOSE["strong"])), none),
        ((tag == "blockquote") & (_attr(n, "cite") != ""), none, F.concat(F.lit(CITE + "— <"), _attr(n, "cite"), F.lit(">"))),
        ((tag == "span") & F.contains(_attr(n, "class"), F.lit("ocrx_word")), F.lit(" "), none),
        (tag == "svg", _svg(n, options), none),
        (tag == "math", let(F.when(_attr(n, "display") == "block", F.lit(BLANK)).otherwise(none), lambda b: F.concat(b, F.lit("<!-- MathML: "), _hard(markup(n)), F.lit(" --> "))), F.when(_attr(n, "display") == "block", F.lit(BLANK)).otherwise(none)),
    ]
    rules += [(use, F.lit(OPEN[name]), F.lit(CLOSE[name])) for name, use in _marks(n, options)]
    return rules


def _soft(n: Column, options: Options) -> Column:
    """A text with its blanks as they count."""
    text = F.regexp_replace(n["text"], ANY_MARK, "")
    plain = ~F.contains(n["text"], F.lit("  ")) & ~n["text"].rlike(ODD)
    if options.strip_newlines:
        text = F.when(within(n, "pre", "textarea"), text).otherwise(F.regexp_replace(text, "\n+", " "))
    if options.whitespace_mode == "strict":
        return F.when(plain, n["text"]).otherwise(text)
    soft = F.regexp_replace(T.normalize_whitespace(text), r"^\s*\n\s*", " ")
    soft = F.when(within(n, *INLINE), F.regexp_replace(soft, r"\s*\n\s*\z", " ")).otherwise(F.regexp_replace(soft, r"\s*\n\s*\z", "\n"))
    soft = let(F.regexp_replace(soft, " *\n *", "\n"), lambda s: F.when(F.trim(F.translate(s, "\n", " ")) == "", F.lit(" ")).otherwise(s))
    soft = F.when(plain, n["text"]).when(within(n, "pre", "textarea"), text).otherwise(soft)
    return soft if options.output_format == "plain" else F.when(within(n, "ruby"), _in_ruby(n, soft)).otherwise(soft)


def _escaped(n: Column, soft: Column, options: Options) -> Column:
    escaped = T.escape(soft, options.escape_asterisks, options.escape_underscores, options.escape_misc, options.escape_ascii)
    if options.output_format != "plain":
        cell = T.escape_underscores(T.escape_asterisks(soft)) if not (options.escape_ascii or options.escape_asterisks) else escaped
        cell = F.replace(cell, F.lit("|"), F.lit("\\|")) if not (options.escape_misc or options.escape_ascii) else cell
        escaped = F.when(within(n, "code", "kbd", "samp", "pre"), soft).when(n["cell"].isNotNull(), cell).otherwise(escaped)
    return F.when(within(n, "pre", "textarea"), soft).otherwise(escaped)


def pieces(gone: Column, options: Options) -> Column:
    """``open, close`` of every node, both empty for those that don't show."""
    def piece(n: Column) -> Column:
        shows = filters.stays(n, gone)
        text = let(_soft(n, options), lambda soft: _escaped(n, soft, options))
        said = options.visitor.get("text", {})
        if said.get("action") in ("custom", "skip"):
            text = F.lit(said.get("output", "") if said["action"] == "custom" else "")
        if said.get("action") == "custom_template":
            before, _, after = said.get("template", "{text}").partition("{text}")
            text = F.concat(F.lit(before), text, F.lit(after))
        ruled = n["tag"].isin(*_ruled(options))
        for callback in ("custom_element", "element_start"):
            if callback in options.visitor:
                ruled = ruled | filters.asked(n, callback, options)
        rules = _rules(n, options)
        two = lambda a, b: F.struct(a.alias("open"), b.alias("close"))
        empty = two(F.lit(""), F.lit(""))
        if "element_end" in options.visitor or any(a is None or b is None for _, a, b in rules):
            opening = closing = F.lit("")
            for use, a, b in reversed(rules):
                opening = opening if a is None else F.when(use, a).otherwise(opening)
                closing = closing if b is None else F.when(use, b).otherwise(closing)
            if "element_end" in options.visitor:
                own = F.when(ruled, opening).otherwise(""), F.when(ruled, closing).otherwise("")
                opening, closing = _ended(n, *own, options)
                ruled = F.lit(True)
            said_of = F.when(ruled, two(F.when(n["kind"] == "text", text).otherwise(opening), closing)).when(n["kind"] == "text", two(text, F.lit(""))).otherwise(empty)
        else:
            of_rule = empty
            for use, a, b in reversed(rules):
                of_rule = F.when(use, two(a, b)).otherwise(of_rule)
            said_of = F.when(n["kind"] == "text", two(text, F.lit(""))).when(ruled, of_rule).otherwise(empty)
        return F.when(~shows, empty).otherwise(said_of)

    return F.transform("nodes", piece)


# --- lines --------------------------------------------------------------------


def _label_escaped(c: Column) -> Column:
    """``]`` that no ``[`` in the label stands before, escaped."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("deep"))

    def add(a: Column, x: Column) -> Column:
        lone = (x == "]") & (a["deep"] == 0)
        deep = a["deep"] + F.when(x == "[", 1).when((x == "]") & ~lone, -1).otherwise(0)
        return F.struct(F.concat(a["done"], F.when(lone, F.lit("\\]")).otherwise(x)).alias("done"), deep.alias("deep"))

    return F.aggregate(F.regexp_extract_all(c, F.lit(r"(?s)(\\.|[^\\\[\]]+|.)"), 1), start, add)["done"]


def _links_escaped(c: Column) -> Column:
    pattern = f"(?s){OPEN['link']}([^{HREF}]*){HREF}"
    labels = F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(pattern), 1), lambda x: F.contains(x, F.lit("]"))))
    return F.aggregate(labels, c, lambda a, x: F.replace(a, F.concat(F.lit(OPEN["link"]), x, F.lit(HREF)), F.concat(F.lit(OPEN["link"]), _label_escaped(x), F.lit(HREF))))


def _code(c: Column) -> Column:
    """Code between fences one longer than its longest run of backticks, with a space where it begins or ends with one."""
    pattern = f"(?s){OPEN['code']}([^{CLOSE['code']}]*){CLOSE['code']}"
    found = F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(pattern), 1), lambda x: F.contains(x, F.lit("`"))))

    def fenced(x: Column) -> Column:
        longest = F.aggregate(F.regexp_extract_all(x, F.lit("(`+)"), 1), F.lit(0), lambda a, y: F.greatest(a, F.length(y)))
        pad = F.when(x.startswith("`") | x.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
        return let(F.repeat(F.lit("`"), longest + 1), lambda fence: F.concat(fence, pad, x, pad, fence))

    return F.aggregate(found, c, lambda a, x: F.replace(a, F.concat(F.lit(OPEN["code"]), x, F.lit(CLOSE["code"])), fenced(x)))


def _tidied(c: Column, options: Options) -> Column:
    """Marks moved to where markup may stand, as often as marks nest."""
    opened, closed = ("".join(x[n] for n in _PAIRED) for x in (OPEN, CLOSE))

    def once(c: Column) -> Column:
        # Blanks inside a pair go outside; pairs around nothing go.
        c = F.regexp_replace(c, f"([{opened}]+)([ \n]+)", "$2$1")
        c = F.regexp_replace(c, f"([ \n{BREAK}]+)([{closed}]+)", "$2$1")
        return F.regexp_replace(c, f"[{opened}{OPEN['code']}]( *)[{closed}{CLOSE['code']}]", "$1")

    rounds = F.when(c.rlike(f"[{opened}{OPEN['code']}][ \n]*[{closed}{CLOSE['code']}]"), len(_NAMES)).otherwise(2)
    return F.aggregate(F.sequence(F.lit(1), rounds), c, lambda a, _: once(a))


def _links(c: Column, options: Options) -> Column:
    """Labels and targets of a line's links as they are written."""
    link, end = OPEN["link"], CLOSE["link"]
    if options.autolinks and not options.default_title:
        c = F.regexp_replace(c, f"{link}([A-Za-z][A-Za-z0-9+.-]*:[^{HREF}]*){HREF}\\1{end}", "<$1>")
        c = F.regexp_replace(c, f"{link}([^{HREF} ]+@[^{HREF} ]+){HREF}mailto:\\1{end}", "<$1>")
    if options.default_title:
        c = F.regexp_replace(c, f"{link}([^{HREF}]*){HREF}\\1{end}", f'{link}$1{HREF}$1 "$1"{end}')
    c = F.regexp_replace(c, f"{link}\\^{HREF}#", f"{link}↑{HREF}#")
    c = F.regexp_replace(c, f"{link}\\s*{HREF}([^{end} ]*)", f"{link}$1{HREF}$1")
    c = F.regexp_replace(c, f"{link}\\s*([^{HREF}]*?)\\s*{HREF}", f"{link}$1{HREF}")
    return c


def _markup(c: Column, options: Options) -> Column:
    """Marks as markup."""
    spaced, m, end = options.strong_em_symbol, options.output_format, CLOSE["link"]
    sub, sup = options.sub_symbol, options.sup_symbol
    mark = {"doubleequal": ("==", "=="), "html": ("<mark>", "</mark>"), "bold": (spaced * 2, spaced * 2), "none": ("", "")}[options.highlight_style]

    def closing(symbol: str) -> str:
        return symbol.replace("<", "</", 1) if symbol.startswith("<") else symbol

    if m == "djot":
        pairs = {"strong": ("*", "*"), "em": ("_", "_"), "del": ("{-", "-}"), "ins": ("{+", "+}"), "mark": ("{=", "=}"), "sub": ("~", "~"), "sup": ("^", "^")}
    else:
        pairs = {"strong": (spaced * 2, spaced * 2), "em": (spaced, spaced), "del": ("~~", "~~"), "ins": ("==", "=="), "mark": mark, "sub": (sub, closing(sub)), "sup": (sup, closing(sup))}
    pairs |= {"code": ("`", "`"), "link": ("[", ")"), "q": ('"', '"')}
    if options.link_style == "reference":
        pairs["link"] = ("[", end)  # numbered when the whole document stands
    for name, (a, b) in pairs.items():
        c = F.replace(F.replace(c, F.lit(OPEN[name]), F.lit(a)), F.lit(CLOSE[name]), F.lit(b))
    if options.link_style == "inline":
        c = F.replace(c, F.lit(HREF), F.lit("]("))
    return c


def _finished(c: Column, options: Options) -> Column:
    """Blanks and breaks of a line."""
    if options.whitespace_mode == "normalized":
        c = F.regexp_replace(F.regexp_replace(c, " {2,}", " "), " *\n[ \n]*", "\n")
    hard = "\n" if options.output_format == "plain" else ("\\\n" if options.newline_style == "backslash" else "  \n")
    c = F.regexp_replace(c, f"[ \n]*{BREAK}[ \n]*", BREAK)
    c = F.replace(F.regexp_replace(c, f"^{BREAK}+|{BREAK}+\\z", ""), F.lit(BREAK), F.lit(hard))
    c = F.regexp_replace(c, f"^[ \n{BLANK}]+|[ \n{BLANK}]+\\z", "")
    return F.regexp_replace(c, f"[ \n]*{BLANK}[ \n{BLANK}]*", "\n\n")


def lines(pieces: Column, options: Options) -> Column:
    """``owner, tag, path, item, cell, table, first, content, ...`` of every run, in order; ``first`` is where it begins.

    ``content`` still has its marks; :func:`written` makes them markup.
    """

    def of_code(code: Column) -> Column:
        piece = F.get(pieces, F.shiftright(code, 1))
        return F.when(code % 2 == 1, piece["close"]).otherwise(piece["open"])

    # A run opens the marks again that the runs before it left open, and ends those that it leaves open itself, so its marks are balanced.
    bare = [*options.strip_tags, *options.preserve_tags, *_visited(options)]
    again = [t for t in (*_TAG_MARK, "a") if t not in bare]

    def carried(ids: Column, side: str) -> Column:
        marks = F.filter(ids, lambda i: F.get("nodes", i)["tag"].isin(*again))
        text = F.array_join(F.transform(marks, lambda i: F.get(pieces, i)[side]), "")
        return F.when(F.size(ids) > 0, text).otherwise("") if again and options.output_format != "plain" else F.lit("")

    def unlinked(r: Column, content: Column) -> Column:
        """Without a link that holds nothing in this run, but something in others."""
        of_link = lambda ids: F.exists(ids, lambda i: F.get("nodes", i)["tag"] == "a")
        blank = f"{OPEN['link']}[\\s{BREAK}\uE000-\uE013]*{HREF}[^{CLOSE['link']}]*{CLOSE['link']}"
        first = lambda c: F.when(of_link(r["around"]), F.regexp_replace(c, f"^([\uE000-\uE013]*?){blank}", "$1")).otherwise(c)
        last = lambda c: F.when(of_link(r["left"]), F.regexp_replace(c, f"{blank}([\uE000-\uE013]*)\\z", "$1")).otherwise(c)
        return let(content, lambda c: F.when(F.contains(c, F.lit(HREF)), let(first(c), last)).otherwise(c))

    def line(r: Column) -> Column:
        owner = F.get("nodes", r["owner"])
        tag = F.coalesce(owner["tag"], F.lit(""))
        own = F.array_join(F.transform(r["codes"], of_code), "")
        whole = F.concat(carried(r["around"], "open"), own, carried(F.reverse(r["left"]), "close"))
        content = F.when((F.size(r["around"]) == 0) & (F.size(r["left"]) == 0), own).otherwise(unlinked(r, whole))
        return F.struct(
            r["owner"].alias("owner"),
            tag.alias("tag"),
            *(owner[x].alias(x) for x in ("item", "cell", "table")),
            F.shiftright(F.get(r["codes"], F.lit(0)), 1).alias("first"),
            F.coalesce(F.get(r["codes"], F.lit(0)) == r["owner"] * 2, F.lit(False)).alias("opens"),
            content.alias("content"),
            F.coalesce((tag == "pre") | within(owner, "pre"), F.lit(False)).alias("pre"),
        )

    return F.transform("runs", line)


def written(options: Options) -> list[tuple[str, Column]]:
    """The steps from a document's ``lines`` to ``texts``, their contents as text."""
    has = lambda pattern: lambda c: c.rlike(pattern)

    def begun(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(x["content"], f"{HREF}[^{CLOSE['link']}]*{CLOSE['link']}", ""), ANY_MARK, "")
        return F.when(x["pre"], bare).otherwise(x["content"])

    changes = []
    if options.output_format != "plain":
        # Marks around nothing; a link's end has its target.
        changes.append((lambda c: F.lit(""), lambda c: c.rlike(PAIR_MARK) & ~c.rlike(rf"[^\uE000-\uE013\s]") & ~F.contains(c, F.lit(HREF))))
        blanks = r"[\uE000-\uE013](?=[ \n\uE000-\uE013])|[ \n\uE021](?=[\uE000-\uE013])"
        changes.append((lambda c: _tidied(c, options), has(blanks)))
        changes.append((lambda c: _links(c, options), lambda c: F.contains(c, F.lit(HREF))))
        changes.append((_links_escaped, lambda c: F.contains(c, F.lit(HREF)) & F.contains(c, F.lit("]"))))
        changes.append((_code, lambda c: F.contains(c, F.lit("`")) & F.contains(c, F.lit(OPEN["code"]))))
        changes.append((lambda c: _markup(c, options), has(PAIR_MARK)))

    def changed(c: Column) -> Column:
        for change, only in changes:
            c = let(c, lambda c: F.when(only(c), change(c)).otherwise(c))  # noqa: B023
        return c

    # All changes are about marks, which most lines don't have.
    marked = has(f"[\uE000-\uE013{HREF}]")
    out = F.transform("lines", lambda x: let(begun(x), lambda c: F.when(marked(c), changed(c)).otherwise(c)))

    def ends(c: Column) -> Column:
        found = c.startswith(" ") | c.endswith(" ")
        for x in ("  ", "\n", BREAK, BLANK):
            found = found | F.contains(c, F.lit(x))
        return found

    def done(x: Column, i: Column) -> Column:
        c = F.get("texts", i)
        lead = F.when(x["content"].startswith(BREAK) & x["tag"].isin("", "html", "body"), F.lit(LINE)).otherwise(F.lit(""))
        return F.when(~x["pre"] & ends(c), F.concat(lead, _finished(c, options))).otherwise(c)

    return [("texts", held(out)), ("texts", held(F.transform("lines", done)))]


# --- tables -------------------------------------------------------------------


def _widened(cells: Column) -> Column:
    """Cells with their column: the sum of the spans before them in the row."""
    ends = scan(F.transform(cells, lambda c: c["col_span"]), lambda a, b: a + b)
    return let(ends, lambda e: F.transform(cells, lambda c, i: c.withField("col", F.get(e, i) - c["col_span"])))


_SLOT = "struct<col:int,content:string,col_span:int>"


def _carried(rows: Column, n_cols: Column) -> Column:
    """Rows as slots, with an empty slot in each column that a cell of an earlier row spans."""

    def free(tracker: Column, col: Column) -> Column:
        """The first column from ``col`` on that no row span holds."""
        return F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), n_cols), lambda c: (c >= col) & (F.coalesce(F.get(tracker, c), F.lit(0)) == 0))), col)

    def blanks(a: Column, b: Column) -> Column:
        made = F.transform(F.sequence(a, b - 1), lambda c: F.struct(c.alias("col"), F.lit("").alias("content"), F.lit(1).alias("col_span")))
        return F.when(b > a, made).otherwise(F.array().cast(f"array<{_SLOT}>"))

    start = F.struct(F.array_repeat(F.lit(0), n_cols + 1).alias("held"), F.array().cast(f"array<array<{_SLOT}>>").alias("rows"))

    def add_row(a: Column, cells: Column) -> Column:
        begin = F.struct(F.lit(0).alias("col"), F.array().cast(f"array<{_SLOT}>").alias("slots"), F.array().cast("array<struct<col:int,rows:int>>").alias("spans"))

        def add_cell(s: Column, c: Column) -> Column:
            return let(
                free(a["held"], s["col"]),
                lambda k: F.struct(
                    (k + c["col_span"]).alias("col"),
                    F.concat(s["slots"], blanks(s["col"], k), F.array(F.struct(k.alias("col"), c["content"].alias("content"), c["col_span"].alias("col_span")))).alias("slots"),
                    F.when(c["row_span"] > 1, F.array_append(s["spans"], F.struct(k.alias("col"), (c["row_span"] - 1).alias("rows")))).otherwise(s["spans"]).alias("spans"),
                ),
            )

        def done(s: Column) -> Column:
            slots = F.concat(s["slots"], blanks(s["col"], F.least(free(a["held"], s["col"]), n_cols)))
            held = F.transform(
                a["held"],
                lambda h, i: F.coalesce(_first(s["spans"], lambda x: x["col"] == i)["rows"], F.greatest(h - 1, F.lit(0))),
            )
            return F.struct(held.alias("held"), F.array_append(a["rows"], slots).alias("rows"))

        return let(F.aggregate(cells, begin, add_cell), done)

    return F.aggregate(rows, start, add_row)["rows"]


def tables(texts: Column, gone: Column, options: Options) -> Column:
    """For every node that is a table in no other ``id, markdown, n_rows, n_cols, is_layout, cells``, null for the rest; all null without tables.

    A table in a cell is part of the cell's text.  The first row is the header; a
    column is as wide as its widest cell (200 at most).  A table that only lays
    out a page becomes a list of its rows.
    """
    plain = options.output_format == "plain"
    joiner = "<br>" if options.br_in_tables and not plain else " "

    def text_of(n: Column) -> Column:
        broken = lambda c: F.contains(c, F.lit("\n")) | F.contains(c, F.lit(LINE))
        own = F.transform(stretch(texts, n["opens"], n["closes"] - n["opens"] + 1), lambda c: F.when(broken(c), F.regexp_replace(c, f" *\\\\?[\n{LINE}]+", joiner)).otherwise(c))
        return F.trim(F.array_join(F.filter(own, lambda x: x != ""), joiner))

    def cell(n: Column) -> Column:
        return F.struct(
            F.lit(0).alias("col"),
            text_of(n).alias("content"),
            T.span(n["attrs"]["colspan"]).alias("col_span"),
            T.span(n["attrs"]["rowspan"]).alias("row_span"),
            (n["tag"] == "th").alias("is_header"),
        )

    def is_cell(n: Column) -> Column:
        return n["tag"].isin(*CELLS)

    def shows(n: Column) -> Column:
        return filters.stays(n, gone)

    def rows_of(t: Column) -> Column:
        rows = F.filter(below(t), lambda n: n["tag"].isin("tr", "row") & (n["table"] == t["id"]) & shows(n))
        if options.visitor.get("table_row", {}).get("action") == "skip":
            rows = F.slice(rows, F.lit(1), F.lit(0))
        return F.transform(rows, lambda r: let(F.transform(F.filter(below(r), lambda n: is_cell(n) & (n["row"] == r["id"]) & shows(n)), cell), _widened))

    def width_of(r: Column) -> Column:
        return F.aggregate(r, F.lit(0), lambda a, c: a + c["col_span"])

    def is_layout(t: Column, rows: Column) -> Column:
        inside = F.filter(below(t), lambda n: n["kind"] != "comment")
        is_tag = lambda n, test: (n["kind"] == "tag") & test
        nested = F.size(F.filter(inside, lambda n: n["tag"] == "table"))
        headed = F.exists(inside, lambda n: is_tag(n, n["tag"].isin("th", "caption") | ((n["tag"] == "cell") & (_attr(n, "role") == "head"))))
        widths = F.array_distinct(F.filter(F.transform(rows, width_of), lambda w: w > 0))
        spans = F.exists(inside, lambda n: is_tag(n, is_cell(n) & (_has(n, "colspan") | _has(n, "rowspan"))))
        links = F.size(F.filter(inside, lambda n: n["tag"] == "a"))
        blank = ~_has_text(inside)
        looks = (nested > 1) | (F.size(widths) > 1) | (spans & (_attr(t, "border") == "0"))
        return ~headed & (looks | blank | ((F.size(rows) <= 2) & (links >= 3)))

    def _has_text(inside: Column) -> Column:
        return F.exists(inside, lambda n: ((n["kind"] == "text") & (F.trim(F.translate(n["text"], "\n\t", "  ")) != "")) | ((n["kind"] == "tag") & n["tag"].isin("img", "graphic") & (_has(n, "src") | _has(n, "alt"))))

    def caption(t: Column) -> Column:
        own = F.transform(F.filter(below(t), lambda n: (n["tag"] == "caption") & (n["table"] == t["id"]) & shows(n)), lambda n: T.one_line(text_of(n)))
        said = F.array_join(F.filter(own, lambda x: x != ""), " ")
        em = "" if plain else options.strong_em_symbol
        shown = said if plain else F.replace(said, F.lit("-"), F.lit("\\-"))
        return F.when(said == "", F.lit("")).otherwise(F.concat(F.lit(em), shown, F.lit(em + "\n\n")))

    def _row_filled(template: str, r: Column, i: Column) -> Column:
        """A visitor's template for a row: ``{cells}``, ``{cell_1}`` and so on, ``{is_header}``."""
        c = F.lit(template)
        for hole in sorted(set(re.findall(r"\{cell_\d+\}", template))):
            c = F.replace(c, F.lit(hole), F.coalesce(F.get(r, F.lit(int(hole[6:-1]) - 1))["content"], F.lit("")))
        c = F.replace(c, F.lit("{cells}"), F.array_join(F.transform(r, lambda x: x["content"]), " | "))
        return F.replace(c, F.lit("{is_header}"), F.when(i == 0, F.lit("true")).otherwise(F.lit("false")))

    def visited(t: Column, whole: Column) -> Column:
        """A table's text after ``table_start``, which may replace it, and ``table_end``, which sees it whole."""
        for callback in ("table_start", "table_end"):
            v = options.visitor.get(callback, {})
            if v.get("action") == "custom" or (callback == "table_start" and v.get("action") == "custom_template"):
                return _filled("".join(_halves(v)), t)
            if v.get("action") == "custom_template":
                before, after = _halves(v)
                whole = F.concat(_filled(before, t), whole, _filled(after, t))
        return whole

    def listed(rows: Column) -> Column:
        each = F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r, lambda c: c["content"]), lambda x: x != ""), " "))
        return F.array_join(F.transform(F.filter(each, lambda x: x != ""), lambda x: F.concat(F.lit("- "), F.ltrim(F.regexp_replace(x, "^- ", "")))), "\n")

    def grid(slots: Column, n_cols: Column) -> Column:
        def sizes(row: Column) -> Column:
            """Of each column the size of its cell, 0 where cells span."""
            each = F.transform(row, lambda x: F.concat(F.array(F.when(x["col_span"] == 1, F.least(F.char_length(x["content"]), F.lit(200))).otherwise(0)), F.array_repeat(F.lit(0), x["col_span"] - 1)))
            return F.flatten(each)

        def drawn(widths: Column) -> Column:
            def one(x: Column) -> Column:
                missing = F.greatest(F.coalesce(F.get(widths, x["col"]), F.lit(0)) - F.char_length(x["content"]), F.lit(0))
                padded = x["content"] if options.compact_tables else F.concat(x["content"], F.repeat(F.lit(" "), missing))
                return F.concat(F.lit(" "), padded, F.repeat(F.lit(" |"), x["col_span"]))

            def row(r: Column, i: Column) -> Column:
                said = options.visitor.get("table_row", {})
                if said.get("action") in ("custom", "custom_template"):
                    return _row_filled(said.get("output", "") if said["action"] == "custom" else said.get("template", ""), r, i)
                dashes = F.transform(F.sequence(F.lit(0), F.greatest(width_of(r), F.lit(1)) - 1), lambda c: F.concat(F.lit(" "), F.repeat(F.lit("-"), F.lit(3) if options.compact_tables else F.coalesce(F.get(widths, c), F.lit(3))), F.lit(" |")))
                rule = F.when(i == 0, F.concat(F.lit("\n|"), F.array_join(dashes, ""))).otherwise(F.lit(""))
                return F.concat(F.lit("|"), F.array_join(F.transform(r, one), ""), rule)

            return F.array_join(F.transform(slots, row), "\n")

        least = F.array_repeat(F.lit(3), F.greatest(n_cols, F.lit(1)))
        widths = F.aggregate(slots, least, lambda a, row: F.zip_with(a, sizes(row), lambda w, x: F.greatest(F.coalesce(w, F.lit(3)), F.coalesce(x, F.lit(0)))))
        return let(widths, drawn)

    def table(t: Column) -> Column:
        def of_rows(rows: Column) -> Column:
            n_cols = F.least(F.coalesce(F.array_max(F.transform(rows, width_of)), F.lit(0)), F.lit(1000))
            uncarried = F.transform(rows, lambda r: F.transform(r, lambda c: F.struct(c["col"].alias("col"), c["content"].alias("content"), c["col_span"].alias("col_span"))))
            cells = F.flatten(
                F.transform(
                    rows,
                    lambda r, i: F.transform(r, lambda c: F.struct(c["content"].alias("content"), i.alias("row"), c["col"].alias("col"), c["row_span"].alias("row_span"), c["col_span"].alias("col_span"), c["is_header"].alias("is_header"))),
                )
            )
            if plain:
                is_list = F.lit(False)
                body = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: c["content"]), "\t")), "\n")
            else:
                is_list = is_layout(t, rows)
                carried = F.exists(rows, lambda r: F.exists(r, lambda c: c["row_span"] > 1))
                slots = let(n_cols, lambda n: F.when(carried, _carried(rows, n)).otherwise(uncarried))
                body = let(n_cols, lambda n: let(slots, lambda s: grid(s, n)))
            whole = F.when(F.size(rows) == 0, F.lit("")).when(is_list, listed(rows)).otherwise(body)
            return F.struct(t["id"].alias("id"), visited(t, F.concat(caption(t), whole)).alias("markdown"), F.size(rows).alias("n_rows"), n_cols.alias("n_cols"), is_list.alias("is_layout"), cells.alias("cells"))

        return let(rows_of(t), of_rows)

    is_outer = lambda n: F.coalesce((n["tag"] == "table") & n["table"].isNull() & shows(n), F.lit(False))
    return F.when(F.exists("nodes", is_outer), F.transform("nodes", lambda n: F.when(is_outer(n), table(n))))


# --- documents ----------------------------------------------------------------


def _indent(text: Column, prefix: Column) -> Column:
    """A prefix before every line but the first."""
    return F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), prefix))


def _body(x: Column, options: Options) -> Column:
    """A line as the block that it is."""
    plain, c, kind = options.output_format == "plain", x["content"], x["kind"]
    level = F.substring(kind, 2, 1).cast("int")
    head = T.one_line(F.replace(c, F.lit("\n"), F.lit(" ")))
    if plain:
        heading = head
    else:
        hashes = F.repeat(F.lit("#"), level)
        heading = F.concat(hashes, F.lit(" "), head)
        if options.heading_style == "atxclosed":
            heading = F.concat(heading, F.lit(" "), hashes)
        if options.heading_style == "underlined":
            line = F.when(level == 1, F.lit("=")).otherwise(F.lit("-"))
            heading = F.when(level <= 2, F.concat(head, F.lit("\n"), F.repeat(line, F.octet_length(head)))).otherwise(heading)
    code = F.regexp_replace(c, "^\n|\n+\\z", "")
    if options.whitespace_mode != "strict":
        code = let(code, T.dedent)
    if plain:
        fenced = code
    elif options.code_block_style == "indented":
        fenced = F.concat(F.lit("    "), _indent(code, F.lit("    ")))
    else:
        ticks = "`" if options.code_block_style == "backticks" else "~"

        def fence(text: Column) -> Column:
            longest = F.aggregate(F.regexp_extract_all(text, F.lit(f"({ticks}+)"), 1), F.lit(2), lambda a, y: F.greatest(a, F.length(y)))
            return let(F.repeat(F.lit(ticks), longest + 1), lambda f: F.concat(f, x["language"], F.lit("\n"), text, F.lit("\n"), f))

        fenced = let(code, fence)
    strong = "" if plain else ("*" if options.output_format == "djot" else options.strong_em_symbol * 2)
    em = "" if plain else ("_" if options.output_format == "djot" else options.strong_em_symbol)
    return (
        F.when(kind == "pre", fenced)
        .when(kind.isin(*HEADINGS), heading)
        .when(kind.isin("summary", "legend"), F.concat(F.lit(strong), c, F.lit(strong)))
        .when(kind == "figcaption", F.concat(F.lit(em), c, F.lit(em)))
        .otherwise(c)
    )


def _placed(x: Column, opens_item: Column, body: Column, options: Options) -> Column:
    """A block with the marks of the lists and quotes around it."""
    plain = options.output_format == "plain"
    start = F.coalesce(F.regexp_extract(F.coalesce(x["start"], F.lit("1")), r"^\s*(\d{1,9})", 1).try_cast("int"), F.lit(1))
    number = F.concat((start + x["nth"] - 1).cast("string"), F.lit(". "))
    bullets = F.array(*(F.lit("-" if plain else b) for b in options.bullets))
    bullet = F.when(x["list_tag"] == "menu", F.lit("-")).otherwise(F.element_at(bullets, (F.pmod(x["bullet_depth"] - 1, F.lit(len(options.bullets))) + 1).cast("int")))
    marker = F.when(x["list_tag"] == "ol", number).otherwise(F.concat(F.coalesce(bullet, F.lit("-")), F.lit(" ")))
    step = "\t" if options.list_indent_type == "tabs" else " " * options.list_indent_width
    outer = F.repeat(F.lit(step), F.greatest(x["lists"] - 1, F.lit(0)))
    inner = F.repeat(F.lit("    "), x["lists"])
    placed = F.when(x["item"].isNull(), body).when(opens_item, F.concat(outer, marker, _indent(body, inner))).otherwise(F.concat(inner, _indent(body, inner)))
    if plain:
        return placed

    def quoted(text: Column, depth: Column) -> Column:
        quote = F.repeat(F.lit("> "), depth)
        return F.when(depth > 0, F.concat(quote, F.replace(F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), quote)), F.concat(F.lit("\n"), quote, F.lit("\n")), F.concat(F.lit("\n"), F.rtrim(quote), F.lit("\n"))))).otherwise(text)

    def cited(text: Column) -> Column:
        parts = F.split(text, CITE)
        main = F.rtrim(F.get(parts, F.lit(0)))
        before = F.when(main == "", F.lit("")).otherwise(F.concat(quoted(main, x["quotes"]), F.lit("\n\n")))
        return F.when(F.contains(text, F.lit(CITE)), F.concat(before, quoted(F.get(parts, F.lit(1)), x["quotes"] - 1))).otherwise(quoted(text, x["quotes"]))

    return let(placed, cited)


def loose_lists() -> Column:
    """For every node, whether it is a list with an item that holds a paragraph."""
    p_in_items = F.filter("nodes", lambda n: (n["tag"] == "p") & (F.get("nodes", n["parent"])["tag"] == "li"))
    lists = F.array_sort(F.array_compact(F.array_distinct(F.transform(p_in_items, lambda n: F.get("nodes", n["parent"])["parent"]))))
    return F.when(F.size(p_in_items) > 0, marked_places(lists, F.size("nodes")))


def described(lines: Column, texts: Column, tables: Column, options: Options) -> Column:
    """``first, kind, content, quotes, item, list, ...`` of what shows outside of tables, and of tables."""
    bare = [*options.strip_tags, *_visited(options)]
    ended = options.visitor.get("element_end", {})
    if ended.get("action") in ("custom", "custom_template"):
        bare += [h for h in HEADINGS if not ended.get("tags") or h in ended["tags"]]  # these bring their own marks
    if options.visitor.get("element_start", {}).get("action") in ("custom", "custom_template"):
        bare += options.visitor["element_start"].get("tags") or HEADINGS

    def is_table(x: Column) -> Column:
        return x["opens"] & (x["tag"] == "table") & x["table"].isNull()

    def shows(x: Column, c: Column) -> Column:
        flow = x["cell"].isNull() & ~x["tag"].isin(*TABLE_PARTS) & (c != "")
        return flow | (is_table(x) & x["cell"].isNull())

    def one(x: Column, content: Column) -> Column:
        item = F.get("nodes", x["item"])
        parent = F.get("nodes", item["parent"])
        table = F.get(tables, x["owner"])["markdown"]
        own = F.get("nodes", x["owner"])
        kind = F.when(is_table(x), F.lit("table")).when(x["tag"].isin("", *bare), F.lit("div")).otherwise(x["tag"])
        language = F.coalesce(_language(own), _language(_first(below(own), lambda n: n["tag"] == "code")), F.lit(options.code_language))
        return F.struct(
            x["first"].alias("first"),
            kind.alias("kind"),
            F.when(is_table(x), F.coalesce(table, F.lit(""))).otherwise(content).alias("content"),
            F.coalesce(own["quotes"], F.lit(0)).alias("quotes"),
            x["item"].alias("item"),
            F.coalesce(own["lists"], F.lit(0)).alias("lists"),
            F.coalesce(own["bullets"], F.lit(0)).alias("bullet_depth"),
            item["nth"].alias("nth"),
            F.when(parent["tag"].isin(*LISTS), parent["id"]).otherwise(x["item"]).alias("list"),
            parent["tag"].alias("list_tag"),
            parent["attrs"]["start"].alias("start"),
            parent["item"].alias("outer_item"),
            F.when(x["tag"] == "pre", language).alias("language"),
        )

    found = F.filter(F.arrays_zip(lines.alias("x"), texts.alias("c")), lambda z: F.coalesce(shows(z["x"], z["c"]), F.lit(False)))
    return F.filter(F.transform(found, lambda z: one(z["x"], z["c"])), lambda x: x["content"] != "")


def dressed(found: Column, loose: Column, options: Options) -> Column:
    """The blocks as text, each with what sets it apart from the one before."""

    def one(x: Column, i: Column) -> Column:
        before = F.get(found, i - 1)
        opens = x["item"].isNotNull() & (before["first"].isNull() | (before["first"] < x["item"]))
        tight = opens & ~F.coalesce(F.get(loose, x["list"]), F.lit(False))
        same_list = before["item"].isNotNull() & ((x["list"] <= before["first"]) | x["outer_item"].isNotNull())
        pair = ((before["kind"] == "dt") & x["kind"].isin("dd", "dt")) | (before["kind"].isin("option", "optgroup") & x["kind"].isin("option", "optgroup"))
        quoted = F.least(before["quotes"], x["quotes"] - x["content"].startswith(CITE).cast("int"))
        blank = F.lit("\n\n") if options.output_format == "plain" else F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), F.greatest(quoted, F.lit(0)))), F.lit("\n"))
        gap = F.when(before["first"].isNull(), F.lit("")).when(F.coalesce((same_list & tight) | pair, F.lit(False)), F.lit("\n")).otherwise(blank)
        return F.concat(gap, let(_body(x, options), lambda b: _placed(x, F.coalesce(opens, F.lit(False)), b, options)))

    return F.transform(found, one)


def with_references(content: Column) -> Column:
    """Targets of links, images and media as numbers, first seen first over all kinds, and a list of them at the end."""
    begin, end = f"[{HREF}{IMAGE}]", f"[{CLOSE['link']}{IMAGE_END}]"
    targets = F.array_distinct(F.regexp_extract_all(content, F.lit(f"{begin}([^{CLOSE['link']}{IMAGE_END}]*){end}"), 1))

    def put(all_: Column) -> Column:
        def numbered(part: Column) -> Column:
            pieces = F.split(part, end, 2)
            return F.concat(F.lit("]["), F.array_position(all_, F.get(pieces, F.lit(0))).cast("string"), F.lit("]"), F.get(pieces, F.lit(1)))

        parts = F.split(content, begin)
        body = F.array_join(F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(numbered(part))), "")
        foot = F.array_join(F.transform(all_, lambda t, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("]: "), t)), "\n")
        return F.when(F.size(all_) > 0, F.concat(body, F.lit("\n\n"), foot)).otherwise(content)

    return let(targets, put)


def wrapped(content: Column, width: int) -> Column:
    """Lines broken at spaces so that they have at most ``width`` bytes.

    Headings, code, tables and lines that are one link stay; in lists and quotes
    the lines after the first are indented to the item's text or quoted alike.
    """

    def paragraph(lead: Column, rest: Column, text: Column) -> Column:
        words = F.filter(F.split(text, " "), lambda w: w != "")
        start = F.struct(lead.alias("done"), F.lit(0).alias("used"), F.lit(True).alias("fresh"))

        def add(a: Column, w: Column) -> Column:
            used = F.when(a["fresh"], F.octet_length(w) + F.octet_length(a["done"])).otherwise(a["used"] + 1 + F.octet_length(w))
            fits = a["fresh"] | (used <= width)
            glue = F.when(a["fresh"], F.lit("")).when(fits, F.lit(" ")).otherwise(F.concat(F.lit("\n"), rest))
            return F.struct(F.concat(a["done"], glue, w).alias("done"), F.when(fits, used).otherwise(F.octet_length(rest) + F.octet_length(w)).cast("int").alias("used"), F.lit(False).alias("fresh"))

        return F.aggregate(words, start, add)["done"]

    item = r"^((?:> ?)*)(\s*)((?:[-*+]|\d+\.) )?"

    def line(text: Column) -> Column:
        quote, indent, marker = (F.regexp_extract(text, item, k) for k in (1, 2, 3))
        lead = F.concat(quote, indent, marker)
        rest = F.concat(quote, indent, F.repeat(F.lit(" "), F.length(marker)))
        fixed = text.rlike(r"^(#|\||(?:> ?)*\s*$|\[[^\]]*\]\([^)]*\)$|    )|  $") | (F.octet_length(text) <= width)
        return F.when(fixed, text).otherwise(paragraph(lead, rest, F.substr(text, F.length(lead) + 1)))

    def joined(p: Column) -> Column:
        """A paragraph's own lines as one, where nothing sets them apart."""
        free = ~p.rlike(r"(?m)^(#|```|~~~|\||>|\s*[-*+] |\s*\d+\. |    )|  $")
        return F.when(free, F.replace(p, F.lit("\n"), F.lit(" "))).otherwise(p)

    parts = F.split(content, "\n\n")
    # Code between fences stays, with its blank lines: a part is in code if an odd number of fences stands before it.
    fences = lambda p: F.size(F.regexp_extract_all(p, F.lit(r"(?m)^[ >]*(```|~~~)"), 1))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("n"))

    def part(a: Column, p: Column) -> Column:
        inside = (a["n"] % 2 == 1) | (fences(p) > 0)
        shown = F.array_join(F.transform(F.split(joined(p), "\n"), line), "\n")
        return F.struct(F.array_append(a["done"], F.when(inside, p).otherwise(shown)).alias("done"), (a["n"] + fences(p)).alias("n"))

    return F.array_join(F.aggregate(parts, start, part)["done"], "\n\n")


@built_once
def steps(options: Options) -> list[tuple[str, Column]]:
    """Columns that lead from ``nodes`` and ``runs`` to ``content`` and ``tables``, in order.

    Those that later steps loop over are held.
    """
    gone, texts, content = F.col("gone"), F.col("texts"), F.col("content")
    out = [("gone", held(filters.gone(options))), ("pieces", held(pieces(gone, options))), ("lines", held(lines(F.col("pieces"), options))), *written(options)]
    out.append(("tables", held(tables(texts, gone, options))))
    if options.convert_as_inline:
        body = F.array_join(F.filter(texts, lambda c: c != ""), " ")
    else:
        out += [("loose", held(loose_lists())), ("shown", held(described(F.col("lines"), texts, F.col("tables"), options)))]
        body = F.array_join(dressed(F.col("shown"), F.col("loose"), options), "")
    body = T.collapse_blank_lines(F.regexp_replace(body, "^\n+|\\s+\\z", ""))
    if options.link_style == "reference" and options.output_format != "plain":
        out.append(("content", held(body)))
        body = with_references(content)
    if options.wrap:
        out.append(("content", held(body)))
        body = wrapped(content, options.wrap_width)
    body = F.concat(F.translate(body, SPACE + LINE + CITE, " \n"), F.lit("\n"))
    return [*out, ("content", held(F.regexp_replace(body, "^\n\\z", "")))]


def readable(text: Column) -> Column:
    """A text of ``texts`` as it is written."""
    inline = F.replace(F.replace(text, F.lit(HREF), F.lit("](")), F.lit(CLOSE["link"]), F.lit(")"))
    inline = F.replace(F.replace(inline, F.lit(IMAGE), F.lit("](")), F.lit(IMAGE_END), F.lit(")"))
    return F.translate(inline, SPACE + LINE + CITE, " \n")


def rendered(documents: DataFrame, options: Options, keep: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` with ``content`` and ``tables``, worked out from their ``nodes`` and ``runs`` (null without).

    ``keep``: steps whose columns stay.
    """
    for name, step in steps(options):
        documents = documents.withColumn(name, step)
    documents = documents.withColumn("tables", F.coalesce(F.array_compact("tables"), F.array()))
    return documents.drop(*(c for c in ("gone", "pieces", "lines", "texts", "loose", "shown") if c not in keep))
