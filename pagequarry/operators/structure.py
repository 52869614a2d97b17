"""A document's structure: sections, headings, paragraphs, lists, tables, images and code, and the inline spans in their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators.extract import above, label
from pagequarry.operators.nodes import HEADINGS, below, built_once, let, scan, spread_out, stretch, text_in, within

_TYPES = {"p": "paragraph", "ul": "list", "ol": "list", "li": "list_item", "table": "table", "img": "image", "pre": "code", "blockquote": "quote", "dl": "definition_list"} | {h: "heading" for h in sorted(HEADINGS)}
#: What an inline element says of its text.
KINDS = {
    "strong": "bold",
    "b": "bold",
    "em": "italic",
    "i": "italic",
    "u": "underline",
    "ins": "underline",
    "s": "strikethrough",
    "del": "strikethrough",
    "strike": "strikethrough",
    "code": "code",
    "kbd": "code",
    "samp": "code",
    "sub": "subscript",
    "sup": "superscript",
    "mark": "highlight",
    "a": "link",
}
_UNREAD = ("script", "style", "head")
_BLANK = r"[\s\u0085   -     　]"


def _name(kind: str | Column, node: Column) -> Column:
    """An id: a type and a hash of the document's id, the node's and the type."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(node.isNotNull(), F.concat(kind, F.lit("-"), F.lower(F.lpad(F.hex(F.xxhash64("doc_id", node, kind)), 16, "0"))))


def _kind(n: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in _TYPES.items() for x in pair))[n["tag"]]


def _level(n: Column) -> Column:
    return F.substring(n["tag"], 2, 1).cast("int")


def _found() -> Column:
    """The nodes that have a place in the structure."""
    inside = lambda n: n["cell"].isNotNull() | n["item"].isNotNull()
    return F.filter("nodes", lambda n: n["tag"].isin(*_TYPES) & ~((n["tag"] == "p") & inside(n)) & ~within(n, "pre"))


def _code(n: Column) -> Column:
    return F.regexp_replace(text_in(n), "^\n|\n+\\z", "")


def _rendered(n: Column) -> Column:
    """An element's text as it stands in the document, from the ``lines`` and ``texts`` of its runs; of a list item, only its own."""
    own = lambda name: stretch(F.col(name), n["opens"], n["closes"] - n["opens"] + 1)
    said = F.zip_with(own("lines"), own("texts"), lambda x, c: F.when(F.coalesce((n["tag"] != "li") | (x["item"] == n["id"]), F.lit(False)) & (c != ""), c))
    return F.array_join(F.array_compact(said), "\n")


def tree_of(tables: Column | None = None, readable=None) -> Column:
    """``id, node_type, parent, position, text, level, ordered, language, src, grid`` of the structure's nodes.

    ``tables`` (as :func:`pagequarry.operators.render.tables` gives them, those in no other) fill
    ``grid``.  With ``readable``, which makes of a rendered text what is written, the texts
    of headings, paragraphs and list items are those of the rendered document (its ``lines`` and ``texts``); without, plain ones.
    """

    def text_of(n: Column) -> Column:
        if readable is not None:
            return F.when(n["tag"] == "pre", _code(n)).when(n["tag"].isin("p", "li", *sorted(HEADINGS)), readable(_rendered(n))).otherwise(label(n))
        # An item's text leaves out that of lists in it.
        own = F.filter(below(n), lambda x: (x["kind"] == "text") & (x["item"] == n["id"]))
        return F.when(n["tag"] == "pre", _code(n)).when(n["tag"] == "li", T.one_line(F.array_join(F.transform(own, lambda x: x["text"]), ""))).otherwise(label(n))

    grid_type = "struct<rows:int,cols:int,cells:array<struct<content:string,row:int,col:int,row_span:int,col_span:int,is_header:boolean>>>"

    def rows(heads: Column, section_at: Column, up: Column, table_at: Column | None) -> Column:
        def of_node(n: Column) -> Column:
            kind = _kind(n)
            id_of = lambda place: F.get(heads, place)["id"]
            section = id_of(F.nullif(F.get(section_at, n["id"]), F.lit(-1)))
            owner = F.get("nodes", n["parent"])
            parent = (
                F.when(kind == "heading", _name("group", n["id"]))
                .when((kind == "list_item") & owner["tag"].isin("ul", "ol"), _name("list", owner["id"]))
                .otherwise(_name("group", section))
            )

            def row(kind: Column, parent: Column) -> Column:
                grid = F.lit(None).cast(grid_type)
                if table_at is not None:
                    table = F.get(tables, F.get(table_at, n["id"]))
                    grid = F.when((kind == "table") & (table["id"] == n["id"]), F.struct(table["n_rows"].alias("rows"), table["n_cols"].alias("cols"), table["cells"].alias("cells")))
                return F.struct(
                    _name(kind, n["id"]).alias("id"),
                    kind.alias("node_type"),
                    parent.alias("parent"),
                    n["id"].alias("position"),
                    F.when(~kind.isin("list", "table", "image", "definition_list"), text_of(n)).alias("text"),
                    F.when(n["tag"].isin(*sorted(HEADINGS)), _level(n)).alias("level"),
                    F.when(kind == "list", n["tag"] == "ol").alias("ordered"),
                    F.when(kind == "code", F.nullif(F.regexp_extract(F.coalesce(n["attrs"]["class"], F.lit("")), r"(?:language|lang)-(\S+)", 1), F.lit(""))).alias("language"),
                    F.when(kind == "image", T.markdown_target(F.coalesce(n["attrs"]["src"], F.lit("")))).alias("src"),
                    grid.alias("grid"),
                )

            one = F.array(row(kind, parent))
            # The section behind a heading's own place is its own.
            outer = id_of(F.get(up, F.get(section_at, n["id"] + 1)))
            return F.when(kind == "heading", F.concat(F.array(row(F.lit("group"), _name("group", outer))), one)).otherwise(one)

        # A paragraph without text has no place.
        return F.filter(F.flatten(F.transform(_found(), of_node)), lambda r: (r["node_type"] != "paragraph") | (r["text"] != ""))

    def with_heads(heads: Column) -> Column:
        starts = F.transform(heads, lambda h: h["id"] + 1)
        places = F.transform(heads, lambda h, k: k)
        section_at = spread_out(starts, places, F.size("nodes") + 1, F.lit(-1))
        table_at = None if tables is None else spread_out(F.transform(tables, lambda t: t["id"]), F.transform(tables, lambda t, k: k), F.size("nodes"), F.lit(-1))
        with_up = lambda s, t: let(above(F.transform(heads, _level)), lambda up: rows(heads, s, up, t))
        return let(section_at, lambda s: with_up(s, None) if table_at is None else let(table_at, lambda t: with_up(s, t)))

    return let(F.filter("nodes", lambda n: n["tag"].isin(*sorted(HEADINGS))), with_heads)


def document_tree(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the fields of :func:`tree_of`, a row a node.

    A heading opens a section: a ``group`` and the ``heading`` in it.  Sections
    nest by level; other nodes belong to the section that is open where they
    stand, list items to their list.  Text in cells and list items makes no
    paragraphs.
    """
    return documents.select("doc_id", F.inline(tree_of()))


# --- inline spans -------------------------------------------------------------------


@built_once
def annotations_of() -> Column:
    """``position, node_type, text, spans`` of headings, paragraphs and list items that have text.

    ``text`` is all text in the element, trimmed; each span says which bytes of it (UTF-8, from
    ``start`` up to ``end``) an inline element holds, its ``kind``, and of a link ``url`` and
    ``title``.  Offsets are running sums of the pieces' sizes.
    """

    def of_block(n: Column) -> Column:
        inside = below(n)

        def with_texts(said: Column) -> Column:
            whole = F.array_join(said, "")
            lead = F.octet_length(whole) - F.octet_length(F.regexp_replace(whole, f"^{_BLANK}+", ""))
            text = F.regexp_replace(whole, f"^{_BLANK}+|{_BLANK}+\\z", "")
            ends = scan(F.transform(said, lambda x: F.octet_length(x)), lambda a, b: a + b)

            def spans(ends: Column, lead: Column, text: Column) -> Column:
                size = F.octet_length(text)
                # The pieces stand in the order of the nodes, the first of them behind the block's own.
                at = lambda node: F.least(F.greatest(F.coalesce(F.get(ends, node - n["id"] - 1), F.lit(0)) - lead, F.lit(0)), size)

                def span(x: Column) -> Column:
                    link = x["tag"] == "a"
                    return F.struct(
                        at(x["id"]).alias("start"), at(x["last"]).alias("end"), F.create_map(*(F.lit(v) for pair in KINDS.items() for v in pair))[x["tag"]].alias("kind"),
                        F.when(link, F.coalesce(x["attrs"]["href"], F.lit(""))).alias("url"), F.when(link, x["attrs"]["title"]).alias("title"),
                    )

                return F.filter(F.transform(F.filter(inside, lambda x: x["tag"].isin(*KINDS) & ~_unread(x)), span), lambda s: s["start"] < s["end"])

            made = let(ends, lambda e: let(lead, lambda b: let(text, lambda t: F.struct(n["id"].alias("position"), _kind(n).alias("node_type"), t.alias("text"), spans(e, b, t).alias("spans")))))
            return made

        def _unread(x: Column) -> Column:
            return within(x, "script", "style", "head")

        return let(F.transform(inside, lambda x: F.when((x["kind"] == "text") & ~_unread(x), x["text"]).otherwise("")), with_texts)

    blocks = F.filter(_found(), lambda n: n["tag"].isin("p", "li", *sorted(HEADINGS)))
    return F.filter(F.transform(blocks, of_block), lambda b: b["text"] != "")


def annotations(documents: DataFrame) -> DataFrame:
    """``doc_id, position, node_type, start, end, kind, url, title, text`` of every inline span, ``text`` being that between its offsets."""
    each = documents.select("doc_id", F.inline(annotations_of())).select("doc_id", "position", "node_type", "text", F.inline("spans"))
    part = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8")
    return each.select("doc_id", "position", "node_type", "start", "end", "kind", "url", "title", part.alias("text"))


@built_once
def definitions_of() -> Column:
    """``list, term, definition`` of every description: its list, and the text of the term that stands nearest before it in the same list."""
    owner = lambda x: F.get("nodes", x["parent"])
    parts = F.filter("nodes", lambda x: x["tag"].isin("dt", "dd"))
    # A term or description may stand in a div of the list.
    listed = F.transform(parts, lambda x: F.struct(x.alias("x"), F.when(owner(x)["tag"] == "div", owner(x)["parent"]).otherwise(x["parent"]).alias("list")))

    def pairs(all_: Column) -> Column:
        terms = scan(F.transform(all_, lambda p, k: F.when(p["x"]["tag"] == "dt", k).otherwise(-1)), F.greatest)

        def paired(last: Column) -> Column:
            def one(p: Column, k: Column) -> Column:
                term = F.get(all_, F.nullif(F.get(last, k), F.lit(-1)))
                return F.struct(p["list"].alias("list"), F.when(term["list"] == p["list"], label(term["x"])).alias("term"), F.when(p["x"]["tag"] == "dd", label(p["x"])).alias("definition"))

            return F.filter(F.transform(all_, one), lambda d: d["definition"].isNotNull())

        return let(terms, paired)

    return let(listed, pairs)


def definitions(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the fields of :func:`definitions_of`, a row a description."""
    return documents.select("doc_id", F.inline(definitions_of()))
