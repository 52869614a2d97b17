"""HTML documents to Markdown, Djot or plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators import extract, filters, render, structure
from pagequarry.operators.nodes import built_once, let, parse_documents
from pagequarry.plans.options import Options


@built_once
def _input_steps(options: Options) -> list[list[Column]]:
    """What leads from ``html`` to ``error_kind``, ``flat`` (text without markup, to be decoded) and the ``html`` to parse."""
    html, reason = F.col("html"), F.col("error_kind")
    is_text = F.lit(False) if options.wrap else ~F.contains(html, F.lit("<"))
    return [
        [T.decode_utf16(html).alias("html")],
        [html, T.invalid_reason(html).alias("error_kind")],
        [reason, F.when(html.isNull(), F.lit("")).when(is_text, T.normalize_input(html)).alias("flat"), F.when(reason.isNull() & ~is_text, html).alias("html")],
    ]


@built_once
def _flat(options: Options) -> Column:
    """What decoded text without markup becomes: blanks as the mode says, escapes but in plain output, no blanks at the end."""
    flat = F.col("flat")
    if options.strip_newlines:
        flat = F.translate(flat, "\r\n", "  ")
    flat = F.regexp_replace(flat, "\n+\\z", "")

    def written(text: Column) -> Column:
        said = T.normalize_whitespace(text) if options.whitespace_mode == "normalized" else text
        if options.output_format != "plain":
            said = T.escape(said, options.escape_asterisks, options.escape_underscores, options.escape_misc, options.escape_ascii)
        return F.when(text == "", text).otherwise(F.concat(F.regexp_replace(said, "[ \t]+\\z", ""), F.lit("\n")))

    return let(flat, written)


def parsed(pages: DataFrame, options: Options, doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """``doc_id, error_kind, flat, nodes, runs``: every row parsed where it is; ``flat`` is the result for text without any ``<``."""
    source = pages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(html).alias("html"))
    for columns in _input_steps(options):
        source = source.select("doc_id", *columns)
    documents = parse_documents(source, "html", keep=("doc_id", "error_kind", "flat"), keep_source=render.keep_source(options), checked=True, decoded="flat")
    return documents.withColumn("flat", _flat(options))


@built_once
def _content(options: Options) -> Column:
    """Front matter and what is rendered, or what ``flat`` holds."""
    content = F.col("content")
    if options.extract_metadata and options.output_format != "plain" and not options.convert_as_inline:
        front = T.front_matter(extract.front_map_of())
        has_head = F.exists("nodes", lambda n: n["tag"].isin("meta", "link", "base", "title"))
        content = F.concat(F.when(has_head, front).otherwise(F.lit("")), content)
    visit = _visit_error(options)
    fine = F.col("error_kind").isNull() if visit is None else F.col("error_kind").isNull() & visit.isNull()
    return F.when(fine, F.coalesce("flat", content, F.lit("")))


def _visit_error(options: Options) -> Column | None:
    """The message of the first callback, in the order given, that answers an element with an error."""
    refused = [(c, v.get("message", c)) for c, v in options.visitor.items() if v.get("action") == "error"]
    if not refused:
        return None

    def met(callback: str) -> Column:
        return F.exists("nodes", lambda n: filters.stays(n, F.col("gone")) & filters.asked(n, callback, options))

    return F.coalesce(*(F.when(met(c), F.lit(message)) for c, message in refused))


def _error(options: Options) -> Column:
    wrong = F.when(F.col("error_kind").isNotNull(), F.struct(F.lit("InvalidInput").alias("kind"), F.col("error_kind").alias("message")))
    visit = _visit_error(options)
    return wrong if visit is None else wrong.when(visit.isNotNull(), F.struct(F.lit("Visitor").alias("kind"), visit.alias("message")))


def _rendered(pages: DataFrame, options: Options, doc_id: str, html: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return render.rendered(parsed(pages, options, doc_id, html), options, (*keep, "gone"))


def convert(pages: DataFrame, options: Options | None = None, doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """``doc_id, content, error`` of every row of ``pages``.

    A page that is no text has a null content and says why in ``error``; null and
    empty pages have an empty content.  Pages without any ``<`` are text: all their
    references are decoded, their spaces collapsed (not in strict mode) and escapes
    put in (not in plain output), without parsing.  Each row
    is a document of its own, whatever its ``doc_id``; rows are never shuffled.
    """
    options = options or Options()
    return _rendered(pages, options, doc_id, html).select("doc_id", _content(options).alias("content"), _error(options).alias("error"))


def convert_result(pages: DataFrame, options: Options | None = None, doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """``doc_id, content, document, metadata, tables, images, warnings, error`` of every row of ``pages``.

    ``document`` and ``tables`` with ``include_document_structure``, ``metadata`` with
    ``extract_metadata``, and ``images`` with ``extract_images``, else null.
    ``warnings`` say what was left out: elements deeper than ``max_depth`` and
    images whose data can't be read.
    """
    options = options or Options()
    found = _rendered(pages, options, doc_id, html, keep=("lines", "texts") if options.include_document_structure else ())
    none = F.lit(None)
    tables = F.transform(
        F.filter("tables", lambda t: (t["markdown"] != "") & ~t["is_layout"]),
        lambda t: F.struct(F.struct(t["n_rows"].alias("rows"), t["n_cols"].alias("cols"), t["cells"].alias("cells")).alias("grid"), t["markdown"].alias("markdown")),
    )
    metadata = F.struct(
        extract.document_of().alias("document"), extract.headers_of().alias("headers"), extract.links_of().alias("links"), extract.images_of().alias("images"), extract.json_ld_of().alias("structured_data")
    )
    document = F.struct(structure.tree_of(F.col("tables"), render.readable).alias("nodes"), F.lit("html").alias("source_format"))
    pictures = extract.inline_images_of()
    kind = "array<struct<kind:string,message:string>>"
    deep = F.lit(None).cast(kind)
    if options.max_depth is not None:
        deep = F.when(F.exists("nodes", lambda n: n["depth"] >= options.max_depth), F.array(F.struct(F.lit("depth_limit_exceeded").alias("kind"), F.lit(f"elements deeper than {options.max_depth} were left out").alias("message"))))
    unread = F.lit(None).cast(kind)
    if options.extract_images:
        unread = F.transform(F.filter(pictures, lambda x: x["skipped"].isNotNull()), lambda x: F.struct(F.lit("image_extraction_failed").alias("kind"), x["skipped"].alias("message")))
    no = F.array().cast(kind)
    parsed_ = F.col("nodes").isNotNull()
    return found.select(
        "doc_id",
        _content(options).alias("content"),
        (F.when(parsed_, document) if options.include_document_structure else none).alias("document"),
        (F.when(parsed_, metadata) if options.extract_metadata else none).alias("metadata"),
        (F.coalesce(tables, F.array()) if options.include_document_structure else F.slice(F.coalesce(tables, F.array()), 1, 0)).alias("tables"),
        (F.coalesce(F.filter(pictures, lambda x: x["skipped"].isNull()), F.array()) if options.extract_images else none).alias("images"),
        F.concat(F.coalesce(deep, no), F.coalesce(unread, no)).alias("warnings"),
        _error(options).alias("error"),
    )
