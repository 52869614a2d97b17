"""Headers, links, images and metadata of documents.

Each is an expression over a document's ``nodes``; the functions that take
documents (see :func:`pagequarry.operators.nodes.parse_documents`) give a row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators.nodes import below, built_once, let, scan, text_in, within

_HEADINGS = tuple(f"h{k}" for k in range(1, 7))


def _attr(n: Column, name: str) -> Column:
    return F.coalesce(n["attrs"][name], F.lit(""))


def _attributes(n: Column) -> Column:
    return F.transform_values(n["attrs"], lambda k, v: F.coalesce(v, F.lit("")))


def label(n: Column) -> Column:
    """An element's text on one line."""
    return T.one_line(text_in(n))


def _rows(documents: DataFrame, found: Column) -> DataFrame:
    return documents.select("doc_id", F.inline(found))


def elements(*tags: str) -> Column:
    return F.filter("nodes", lambda n: n["tag"].isin(*tags))


# --- expressions ----------------------------------------------------------------


@built_once
def headers_of() -> Column:
    def header(n: Column) -> Column:
        return F.struct(n["id"].alias("node_id"), F.substring(n["tag"], 2, 1).cast("int").alias("level"), label(n).alias("text"), n["attrs"]["id"].alias("id"), n["depth"].alias("depth"))

    return F.transform(elements(*_HEADINGS), header)


@built_once
def links_of(autolinks: bool = False) -> Column:
    """Links with a target; those written ``<url>`` and those around a heading only with ``autolinks``."""

    def link(n: Column) -> Column:
        href = _attr(n, "href")
        return F.struct(
            n["id"].alias("node_id"), href.alias("href"), label(n).alias("text"), n["attrs"]["title"].alias("title"), T.link_type(href).alias("link_type"),
            T.word_list(_attr(n, "rel")).alias("rel"), _attributes(n).alias("attributes"), F.exists(below(n), lambda x: (x["kind"] == "tag") & x["tag"].isin(*_HEADINGS)).alias("_heads"),
        )

    found = F.transform(F.filter("nodes", lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], F.lit("href"))), link)
    if not autolinks:
        found = F.filter(found, lambda x: ~x["_heads"] & ~((x["text"] == x["href"]) & T.has_scheme(x["href"])) & ~(F.concat(F.lit("mailto:"), x["text"]) == x["href"]))
    return F.transform(found, lambda x: x.dropFields("_heads"))


@built_once
def images_of() -> Column:
    def image(n: Column) -> Column:
        src = _attr(n, "src")
        size = {k: F.try_to_number(F.regexp_extract(_attr(n, k), r"^\s*(\d{1,9})\s*$", 1), F.lit("999999999")).cast("int") for k in ("width", "height")}
        both = size["width"].isNotNull() & size["height"].isNotNull()
        return F.struct(
            n["id"].alias("node_id"), src.alias("src"), n["attrs"]["alt"].alias("alt"), n["attrs"]["title"].alias("title"), F.when(both, size["width"]).alias("width"),
            F.when(both, size["height"]).alias("height"), T.image_type(src).alias("image_type"), _attributes(n).alias("attributes"),
        )

    return F.transform(F.filter("nodes", lambda n: (n["tag"] == "img") & (_attr(n, "src") != "")), image)


@built_once
def inline_images_of() -> Column:
    def picture(x: Column) -> Column:
        return let(T.data_uri(x["src"]), lambda d: F.struct(x["node_id"].alias("node_id"), d["format"].alias("format"), d["data"].alias("data"), x["alt"].alias("description"), d["skipped"].alias("skipped")))

    return F.transform(F.filter(images_of(), lambda x: x["image_type"] == "data_uri"), picture)


@built_once
def json_ld_of(most_bytes: int = 1_000_000) -> Column:
    scripts = F.filter("nodes", lambda n: (n["tag"] == "script") & (F.lower(F.trim(_attr(n, "type"))) == "application/ld+json"))
    listed = F.filter(F.transform(scripts, lambda n: F.struct(n["id"].alias("node_id"), F.trim(text_in(n)).alias("raw_json"))), lambda x: x["raw_json"] != "")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<node_id:int,raw_json:string>>").alias("kept"))

    def take(a: Column, x: Column) -> Column:
        size = a["used"] + F.octet_length(x["raw_json"])
        return F.struct(F.when(size > most_bytes, a["used"]).otherwise(size).alias("used"), F.when(size > most_bytes, a["kept"]).otherwise(F.array_append(a["kept"], x)).alias("kept"))

    return F.transform(F.aggregate(listed, start, take)["kept"], lambda x: x.withField("schema_type", T.json_ld_type(x["raw_json"])))


def head_entries_of(title: Callable[[Column], Column] = label) -> Column:
    """``node_id, key, value``: title, metas, canonical link and base; ``title`` says what is written of a title."""

    def entry(n: Column) -> Column:
        tag = n["tag"]
        name = F.lower(F.coalesce(n["attrs"]["name"], n["attrs"]["property"], n["attrs"]["http-equiv"]))
        key = (
            F.when((tag == "meta") & F.map_contains_key(n["attrs"], F.lit("content")), F.concat(F.lit("meta-"), F.nullif(name, F.lit(""))))
            .when((tag == "link") & F.array_contains(T.word_list(F.lower(_attr(n, "rel"))), "canonical"), F.lit("canonical"))
            .when(tag == "base", F.lit("base-href"))
            .when((tag == "title") & ~within(n, "svg"), F.lit("title"))
        )
        value = F.when(tag == "meta", n["attrs"]["content"]).when(tag == "title", title(n)).otherwise(n["attrs"]["href"])
        return F.struct(n["id"].alias("node_id"), key.alias("key"), value.alias("value"))

    said = F.transform(elements("meta", "link", "base", "title"), entry)
    return F.filter(said, lambda e: e["key"].isNotNull() & e["value"].isNotNull() & (e["value"] != ""))


def _as_map(entries: Column) -> Column:
    """Entries (``node_id, key, value``) as a map; of a key that comes twice the later counts."""
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"], e["node_id"], e["value"])))
    last = lambda all_: F.filter(all_, lambda e, k: ~F.coalesce(F.get(all_, k + 1)["key"] == e["key"], F.lit(False)))
    return let(ordered, lambda all_: F.map_from_entries(F.transform(last(all_), lambda e: F.struct(e["key"], e["value"]))))


def above(levels: Column) -> Column:
    """For each heading's level the place of the nearest one before it with a lower level, null without.

    For each level a running maximum finds the last place of a lower one.
    """

    def below_level(top: int) -> Column:
        return scan(F.transform(levels, lambda x, k: F.when(x < top, k).otherwise(-1)), F.greatest)


    def place(found: Column) -> Column:
        return F.transform(levels, lambda x, k: F.nullif(F.get(F.get(found, x - 2), k - 1), F.lit(-1)))

    return let(F.array(*(below_level(top) for top in range(2, 7))), place)


@built_once
def head_map_of() -> Column:
    return _as_map(head_entries_of())


@built_once
def front_map_of() -> Column:
    """The head's map for front matter, in which a title stays HTML source."""
    written = lambda x: F.coalesce(x["source"], x["text"])
    return _as_map(head_entries_of(lambda n: T.one_line(F.array_join(F.transform(F.filter(below(n), lambda x: x["kind"] == "text"), written), ""))))


@built_once
def document_of() -> Column:
    """Title, description, keywords, author, canonical URL, base, language, direction, and maps of the rest."""
    k = lambda e: F.lower(F.replace(F.regexp_replace(e["key"], "^meta-", ""), F.lit(":"), F.lit("-")))

    def routed(e: Column) -> Column:
        key = k(e)
        route = (
            F.when(key.isin("title", "dc.title", "dcterms.title"), "title")
            .when(key.isin("description", "dc.description", "dcterms.description"), "description")
            .when(key.isin("keywords", "keyword", "dc.subject"), "keywords")
            .when(key.isin("author", "creator", "publisher", "dc.creator", "dc.publisher"), "author")
            .when(key == "canonical", "canonical_url")
            .when(key.isin("base-href", "base"), "base_href")
            .when(key.startswith("og-"), "open_graph")
            .when(key.startswith("twitter-"), "twitter_card")
            .otherwise("meta_tags")
        )
        return F.struct(e["node_id"].alias("node_id"), F.regexp_replace(key, "^(og|twitter)-", "").alias("key"), key.alias("k"), e["value"].alias("value"), route.alias("route"))

    def built(all_: Column) -> Column:
        of = lambda name: F.filter(all_, lambda e: e["route"] == name)
        last = lambda name: F.try_element_at(of(name), F.lit(-1))["value"]
        first_author = F.get(F.array_sort(F.transform(of("author"), lambda e: F.struct(e["k"], e["node_id"], e["value"]))), F.lit(0))["value"]
        roots = elements("html", "head", "body")
        language = F.get(F.filter(roots, lambda n: n["attrs"]["lang"].isNotNull()), F.lit(0))["attrs"]["lang"]
        direction = F.get(F.filter(F.transform(roots, lambda n: F.lower(n["attrs"]["dir"])), lambda d: d.isin("ltr", "rtl", "auto")), F.lit(0))
        return F.struct(
            last("title").alias("title"),
            last("description").alias("description"),
            F.coalesce(T.comma_list(last("keywords")), F.array().cast("array<string>")).alias("keywords"),
            first_author.alias("author"),
            last("canonical_url").alias("canonical_url"),
            last("base_href").alias("base_href"),
            language.alias("language"),
            direction.alias("text_direction"),
            *(_as_map(of(name)).alias(name) for name in ("open_graph", "twitter_card", "meta_tags")),
        )

    return let(F.transform(head_entries_of(), routed), built)


# --- rows -----------------------------------------------------------------------


def headers(documents: DataFrame) -> DataFrame:
    """``doc_id, node_id, level, text, id, depth`` of every heading, ``depth`` counted from the root."""
    return _rows(documents, headers_of())


def links(documents: DataFrame, autolinks: bool = False) -> DataFrame:
    """``doc_id, node_id, href, text, title, link_type, rel, attributes`` of every link with a target."""
    return _rows(documents, links_of(autolinks))


def images(documents: DataFrame) -> DataFrame:
    """``doc_id, node_id, src, alt, title, width, height, image_type, attributes`` of every image with a source."""
    return _rows(documents, images_of())


def inline_images(documents: DataFrame) -> DataFrame:
    """``doc_id, node_id, format, data, description, skipped`` of every image in a ``data:`` URI."""
    return _rows(documents, inline_images_of())


def json_ld(documents: DataFrame, most_bytes: int = 1_000_000) -> DataFrame:
    """``doc_id, node_id, raw_json, schema_type`` of the JSON-LD blocks that fit the document's budget.

    A block goes if it, or the sum of the blocks accepted before it and itself,
    is over ``most_bytes``; smaller ones after it may still be accepted.
    """
    return _rows(documents, json_ld_of(most_bytes))


def head_map(documents: DataFrame) -> DataFrame:
    """``doc_id, meta``: the head as a map; of a key that comes twice the later counts."""
    return documents.select("doc_id", head_map_of().alias("meta"))


def document_metadata(documents: DataFrame) -> DataFrame:
    """One row a document: ``doc_id`` and the fields of :func:`document_of`."""
    return documents.select("doc_id", document_of().alias("m")).select("doc_id", "m.*")


#: Elements that stand within a line, and two that show nothing and so count as such.
_INLINE = frozenset("a abbr acronym b bdo big br button cite code del dfn em i img input ins kbd label map mark object output q s samp select small span strong sub sup textarea time tt u var script style".split())


def siblings(documents: DataFrame) -> DataFrame:
    """``doc_id, node_id, tag, next_tag, previous_inline, next_inline, blank_behind`` of every element.

    ``next_tag`` is the element behind it, with blank text at most between; the others say whether
    the neighbours on either side are such and inline, and whether the text right behind it is blank.
    """

    inline = lambda x: F.coalesce(x["tag"].isin(*sorted(_INLINE)), F.lit(False))

    def one(n: Column) -> Column:
        behind, before = F.get("nodes", n["next"]), F.get("nodes", n["previous"])
        right = F.get("nodes", n["last"] + 1)  # what follows in the document; a comment is passed over
        right = F.when(right["kind"] == "comment", F.get("nodes", n["last"] + 2)).otherwise(right)
        blank = let(right, lambda x: x["parent"].eqNullSafe(n["parent"]) & (x["kind"] == "text") & ~x["text"].rlike(r"\S"))
        return F.struct(
            n["id"].alias("node_id"), n["tag"].alias("tag"), behind["tag"].alias("next_tag"), inline(before).alias("previous_inline"), inline(behind).alias("next_inline"), F.coalesce(blank, F.lit(False)).alias("blank_behind"),
        )

    return _rows(documents, F.transform(F.filter("nodes", lambda n: n["kind"] == "tag"), one))


def header_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "level").agg(F.count("*").alias("n"))


def sections(documents: DataFrame) -> DataFrame:
    """``doc_id, node_id, level, text, parent_id``: each heading with the nearest one before it of a lower level.

    The open sections are a stack: a heading closes those of its level or deeper.
    """

    def placed(all_: Column) -> Column:
        def with_parents(up: Column) -> Column:
            return F.transform(all_, lambda x, k: F.struct(x["node_id"], x["level"], x["text"], F.get(all_, F.get(up, k))["node_id"].alias("parent_id")))

        return let(above(F.transform(all_, lambda x: x["level"])), with_parents)

    return _rows(documents, let(headers_of(), placed))


def reference_numbers(found: DataFrame) -> DataFrame:
    """``doc_id, href, title, number``: link targets numbered as first seen."""
    first = found.groupBy("doc_id", "href", F.coalesce("title", F.lit("")).alias("title")).agg(F.min("node_id").alias("first"))
    return first.select("doc_id", "href", "title", F.row_number().over(W.partitionBy("doc_id").orderBy("first")).alias("number"))
