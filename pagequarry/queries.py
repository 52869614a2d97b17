"""The registered queries over HTML and text, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import text as T
from pagequarry.operators import extract, filters
from pagequarry.operators.nodes import let, parse_documents, parse_nodes
from pagequarry.plans.convert import convert, convert_result
from pagequarry.plans.options import Options
from pagequarry.sources.io import decode_bytes, json_lines, spread, table

QUERIES = dict(rules.QUERIES)
ORACLE_SQL: dict[str, str] = dict(rules.ORACLE_SQL)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return parse_documents(spread(_pages(spark, d).select(F.col("page_id").alias("doc_id"), "html")))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return parse_nodes(spread(_pages(spark, d).select("page_id", "html")), "page_id", "html")


# --- whole pages by expressions ----------------------------------------------


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_title(spark, d):
    return _pages(spark, d).select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(
    """SELECT regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset,
       count(*) AS n_pages, CAST(sum(length(html)) AS BIGINT) AS n_chars FROM pages GROUP BY ALL"""
)
def pages_by_language(spark, d):
    p = _pages(spark, d).select(F.regexp_extract("html", '<html[^>]* lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", '<meta charset="([^"]*)"', 1).alias("charset"), F.length("html").alias("n"))
    return p.groupBy("lang", "charset").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_chars"))


#: What stands before each page, and why the whole is no text then.
_STARTS = (("", None), ("%PDF-", "binary"), ("PK\x03\x04", "binary"), ("\x00" * 90, "nul"), ("\x01" * 9000, "control"), ("\x00" * 8, None))


@query(
    "SELECT page_id, s.k AS start_no, CASE WHEN html IS NOT NULL THEN s.reason END AS reason FROM pages, (VALUES "
    + ", ".join(f"({k}, {repr(r) if r else 'CAST(NULL AS VARCHAR)'})" for k, (_, r) in enumerate(_STARTS))
    + ") s(k, reason)"
)
def input_validation(spark, d):
    starts = F.array(*(F.struct(F.lit(k).alias("start_no"), F.lit(text).alias("start")) for k, (text, _) in enumerate(_STARTS)))
    each = _pages(spark, d).select("page_id", "html", F.explode(starts).alias("s"))
    return each.select("page_id", "s.start_no", T.invalid_reason(F.concat("s.start", "html")).alias("reason"))


#: Charsets and what stands before the bytes in them.
_CHARSETS = (("utf-8", "UTF-8", ""), ("utf-16le", "UTF-16LE", ""), ("utf-16be", "UTF-16BE", ""), ("latin1", "UTF-16LE", "FFFE"), ("utf-8", "UTF-16BE", "FEFF"))


@query("SELECT page_id, c.k AS charset_no, html FROM pages, (VALUES (0), (1), (2), (3), (4)) c(k)")
def byte_decoding(spark, d):
    """Pages as bytes in several charsets, with and without a byte order mark that overrules the one said, decoded again."""
    each = [F.struct(F.lit(k).alias("k"), decode_bytes(F.concat(F.unhex(F.lit(mark)), F.encode("html", name)), said).alias("html")) for k, (said, name, mark) in enumerate(_CHARSETS)]
    return _pages(spark, d).select("page_id", F.inline(F.array(*each))).withColumnRenamed("k", "charset_no")


@query("SELECT page_id, c.k AS order_no, url FROM pages, (VALUES (0), (1), (2)) c(k)")
def utf16_in_text(spark, d):
    """Text that came as UTF-16 read as single bytes, in both orders, and as it is."""
    nul = "\u0000"
    made = (F.regexp_replace("url", "(.)", f"$1{nul}"), F.regexp_replace("url", "(.)", f"{nul}$1"), F.col("url"))
    each = F.array(*(F.struct(F.lit(k).alias("order_no"), c.alias("url")) for k, c in enumerate(made)))
    return _pages(spark, d).select("page_id", F.explode(each).alias("e")).select("page_id", "e.order_no", T.decode_utf16(F.col("e.url")).alias("url"))


@query("""SELECT '{"doc_id":' || page_id || ',"content":null,"error":null}' AS value FROM pages""")
def json_without_content(spark, d):
    return json_lines(convert(spread(_pages(spark, d).select("page_id", "html")), doc_id="page_id"), with_content=False)


@query(
    r"""SELECT page_id, regexp_replace(replace(regexp_replace(html, E'\r\n?', E'\n', 'g'), chr(0), ''), '<([A-Za-z][A-Za-z0-9:-]*)/>', '<\1 />', 'g') AS html FROM pages"""
)
def input_normalization(spark, d):
    return _pages(spark, d).select("page_id", T.normalize_input(F.col("html")).alias("html"))


@query(
    r"""SELECT doc_id, regexp_replace(text, '[ \t\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+', ' ', 'g') AS text FROM documents"""
)
def whitespace_normalization(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '([\\&<`\[\]>~#=+|-])', '\\\1', 'g'), '([0-9])([.)])', '\1\\\2', 'g') AS text FROM documents"""
)
def escape_misc(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_misc(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(text, '([!-/:-@\[-`{-~])', '\\\1', 'g') AS text FROM documents""")
def escape_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_ascii(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, replace(replace(text, '*', '\*'), '_', '\_') AS text FROM documents""")
def escape_emphasis(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape(F.col("text"), asterisks=True, underscores=True).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(replace(text, E'.\n', E'.\n\n\n'), E'\n{3,}', E'\n\n', 'g') AS text FROM documents""")
def collapse_blank_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", T.collapse_blank_lines(F.replace("text", F.lit(".\n"), F.lit(".\n\n\n"))).alias("text"))


@query(
    r"""WITH t AS (SELECT doc_id, replace(replace(text, '.', '.   '), ',', E', \t') AS s FROM documents)
    SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(s, E'\n'), lambda x:
        rtrim(regexp_replace(x, '[ \t]+$', '')) || CASE WHEN ends_with(x, '  ') AND trim(x) <> '' THEN '  ' ELSE '' END), E'\n'), E'\n+$', E'\n') AS text FROM t"""
)
def trim_line_ends(spark, d):
    s = F.replace(F.replace("text", F.lit("."), F.lit(".   ")), F.lit(","), F.lit(", \t"))
    return table(spark, d, "documents").select("doc_id", T.trim_line_ends(s).alias("text"))


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(s, '^\s') THEN ' ' ELSE '' END AS prefix,
        CASE WHEN regexp_matches(s, E'\n\n$') THEN E'\n\n' WHEN regexp_matches(s, '\s$') THEN ' ' ELSE '' END AS suffix,
        regexp_replace(s, '^\s+|\s+$', '', 'g') AS core
    FROM (SELECT doc_id, ' ' || text || CASE WHEN doc_id % 2 = 0 THEN E'\n\n' ELSE E'\n' END AS s FROM documents)"""
)
def chomp(spark, d):
    s = F.concat(F.lit(" "), "text", F.when(F.col("doc_id") % 2 == 0, F.lit("\n\n")).otherwise(F.lit("\n")))
    return table(spark, d, "documents").select("doc_id", T.chomp(s).alias("c")).select("doc_id", "c.*")


@query(
    r"""SELECT doc_id, array_to_string(list_transform(string_split(s, E'\n'), lambda x: substr(x, 3)), E'\n') AS text
    FROM (SELECT doc_id, '  ' || replace(text, E'\n', E'\n  ') AS s FROM documents WHERE NOT regexp_matches(text, '(^|\n)\s'))"""
)
def dedent(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dedent(F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("\n  ")))).alias("text"))


@query(
    """SELECT page_id, list_reduce(list_prepend(url, list_transform(range(33, 127), lambda x: chr(CAST(x AS INTEGER)))), lambda a, c:
        CASE WHEN regexp_matches(c, '^[A-Za-z0-9_.~/-]$') OR c = '%' THEN a ELSE replace(a, c, '%' || upper(hex(c))) END) AS encoded FROM pages"""
)
def percent_encode(spark, d):
    return _pages(spark, d).select("page_id", T.percent_encode(F.col("url")).alias("encoded"))


@query(
    """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host,
       regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages"""
)
def url_parts(spark, d):
    u = F.col("url")
    part = {n: F.coalesce(F.try_parse_url(u, F.lit(p)), F.lit("")) for n, p in (("scheme", "PROTOCOL"), ("host", "HOST"), ("path", "PATH"), ("query", "QUERY"), ("fragment", "REF"))}
    return _pages(spark, d).select("page_id", *(c.alias(n) for n, c in part.items()))


@query(
    """SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<footer>([^<]*)', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&') AS text FROM pages"""
)
def reference_decoding(spark, d):
    return _pages(spark, d).select("page_id", T.decode_named(F.regexp_extract("html", "<footer>([^<]*)", 1)).alias("text"))


@query(
    """SELECT page_id, list_filter(list_transform(string_split(regexp_extract(html, '<footer>([^<]*)', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS items,
       list_filter(regexp_split_to_array(regexp_extract(html, '<footer>([^<]*)', 1), '\\s+'), lambda x: x <> '') AS words FROM pages"""
)
def list_splitting(spark, d):
    s = F.regexp_extract("html", "<footer>([^<]*)", 1)
    return _pages(spark, d).select("page_id", T.comma_list(s).alias("items"), T.word_list(s).alias("words"))


@query(
    """SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<nav>.*?</nav>', '', 'g')) AS n_left FROM pages"""
)
def boilerplate_stripping(spark, d):
    s = F.col("html")
    for tag in ("script[^>]*", "style[^>]*", "nav"):
        s = F.regexp_replace(s, f"(?s)<{tag}>.*?</{tag.removesuffix('[^>]*')}>", "")
    return _pages(spark, d).select("page_id", F.length(s).cast("long").alias("n_left"))


@query(
    """SELECT doc_id, CASE WHEN n > 0 THEN '---' || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || '---' || chr(10) || chr(10) ELSE '' END AS front
    FROM (SELECT doc_id, lang, source, 1 AS n FROM documents)"""
)
def front_matter(spark, d):
    meta = F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")
    return table(spark, d, "documents").select("doc_id", T.front_matter(meta).alias("front"))


@query(
    """SELECT page_id, least(greatest(coalesce(TRY_CAST(nullif(regexp_extract(url, '/([0-9]{1,9})([/.?#]|$)', 1), '') AS INTEGER), 1), 1), 1000) AS span FROM pages"""
)
def span_parsing(spark, d):
    return _pages(spark, d).select("page_id", T.span(F.regexp_extract("url", r"/([0-9]{1,9})([/.?#]|$)", 1)).alias("span"))


# --- from nodes ---------------------------------------------------------------

_LINKS = """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)', 1)) AS label,
        generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS n FROM pages)"""
_TYPE = """CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN starts_with(href, 'mailto:') THEN 'email' WHEN starts_with(href, 'tel:') THEN 'phone'
    WHEN starts_with(href, 'http://') OR starts_with(href, 'https://') THEN 'external' WHEN starts_with(href, '/') OR starts_with(href, '../') OR starts_with(href, './') THEN 'internal' ELSE 'other' END"""


@query(_LINKS + f" SELECT page_id, n, href, label AS text, {_TYPE} AS link_type FROM l")
def links(spark, d):
    each = _documents(spark, d).select("doc_id", F.posexplode(extract.links_of(True)).alias("k", "x"))
    return each.select(F.col("doc_id").alias("page_id"), (F.col("k") + 1).cast("long").alias("n"), "x.href", "x.text", "x.link_type")


@query(_LINKS + f" SELECT {_TYPE} AS link_type, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM l GROUP BY 1")
def link_type_counts(spark, d):
    return extract.links(_documents(spark, d), autolinks=True).groupBy("link_type").agg(F.count("*").alias("n_links"), F.countDistinct("doc_id").alias("n_pages"))


@query(
    _LINKS
    + """, f AS (SELECT page_id, href, min(n) AS first FROM l GROUP BY page_id, href)
    SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY first) AS number FROM f"""
)
def reference_numbers(spark, d):
    return extract.reference_numbers(extract.links(_documents(spark, d), autolinks=True)).select(F.col("doc_id").alias("page_id"), "href", F.col("number").cast("long").alias("number"))


@query(
    r"""SELECT page_id, CAST(1 AS INTEGER) AS level, replace(replace(trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)', 1), '\s+', ' ', 'g')), '&quot;', '"'), '&amp;', '&') AS text
    FROM pages WHERE regexp_matches(html, '<h1>[^<]*\S')"""
)
def headings(spark, d):
    return extract.headers(_documents(spark, d)).where("text <> ''").select(F.col("doc_id").alias("page_id"), "level", "text")


@query("SELECT CAST(1 AS INTEGER) AS level, count(*) AS n_headings FROM pages WHERE html LIKE '%<h1>%' GROUP BY 1")
def heading_counts(spark, d):
    levels = [f"h{k}" for k in range(1, 7)]
    found = _nodes(spark, d).where(F.col("tag").isin(*levels))
    return found.groupBy(F.substring("tag", 2, 1).cast("int").alias("level")).agg(F.count("*").alias("n_headings"))


@query(
    r"""SELECT page_id, 'title' AS key, replace(replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '\s+', ' ', 'g')), '&quot;', '"'), '&amp;', '&') AS value FROM pages WHERE html LIKE '%<title>%'"""
)
def head_metadata(spark, d):
    head = extract.head_map(_documents(spark, d))
    return head.select(F.col("doc_id").alias("page_id"), F.explode("meta").alias("key", "value"))


@query("""SELECT page_id, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS language FROM pages""")
def document_language(spark, d):
    return extract.document_metadata(_documents(spark, d)).select(F.col("doc_id").alias("page_id"), "language")


@query(
    """WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)', 1)) AS text, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)', 1), 1) AS n FROM pages)
    SELECT page_id, n AS number, '- ' || text AS line FROM i"""
)
def list_items(spark, d):
    items = F.transform(extract.elements("li"), lambda n: F.struct(n["nth"].cast("long").alias("number"), F.concat(F.lit("- "), extract.label(n)).alias("line")))
    return _documents(spark, d).select(F.col("doc_id").alias("page_id"), F.inline(items))


@query(
    """SELECT page_id, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS BIGINT) AS n_paragraphs, CAST((length(html) - length(replace(html, '<br>', ''))) / 4 AS BIGINT) AS n_breaks FROM pages"""
)
def element_counts(spark, d):
    return _documents(spark, d).select(F.col("doc_id").alias("page_id"), *(F.size(extract.elements(t)).cast("long").alias(n) for t, n in (("p", "n_paragraphs"), ("br", "n_breaks"))))


@query("SELECT page_id, regexp_extract(html, '<!--(.*?)-->', 1) AS text FROM pages WHERE regexp_matches(html, '<!--.*?-->')")
def comments(spark, d):
    return _nodes(spark, d).where("kind = 'comment'").select(F.col("doc_id").alias("page_id"), "text")


@query("SELECT page_id, CAST((length(html) - length(replace(html, '<li>', ''))) / 4 AS BIGINT) AS n_hidden FROM pages WHERE html LIKE '%<nav><ul><li>%'")
def navigation_dropped(spark, d):
    hidden = let(filters.gone(Options()), lambda g: F.size(F.filter("nodes", lambda n: (n["tag"] == "li") & ~filters.stays(n, g))))
    return _documents(spark, d).select(F.col("doc_id").alias("page_id"), hidden.cast("long").alias("n_hidden")).where("n_hidden > 0")


@query(
    """SELECT page_id, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS BIGINT) AS n_paragraphs, CAST(0 AS BIGINT) AS n_excluded FROM pages"""
)
def selector_exclusion(spark, d):
    options = Options(exclude_selectors=(".ad", "nav, footer"))
    left = let(filters.gone(options), lambda g: F.transform(F.filter("nodes", lambda n: filters.stays(n, g)), lambda n: n["tag"]))
    count = lambda *tags: F.size(F.filter("left", lambda t: t.isin(*tags))).cast("long")
    rows = _documents(spark, d).select(F.col("doc_id").alias("page_id"), left.alias("left"))
    return rows.select("page_id", count("p").alias("n_paragraphs"), count("div", "nav", "footer").alias("n_excluded"))


# --- conversions ---------------------------------------------------------------


# The pages follow one template, so plain string functions can say what they become: advert, title, and paragraphs, which
# an unclosed <b> in the first makes bold throughout.
_CONVERTED = r"""WITH a AS (
        SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title,
            regexp_replace(regexp_extract(html, '(?s)<div class="ad">(.*)$', 1), '<[^>]*$', '') AS body FROM pages),
    m AS (SELECT page_id, title, regexp_replace(replace(replace(replace(replace(replace(body, '</div>', chr(2)), '<h1>', chr(2)), '</h1>', chr(2)), '<p>', chr(2)), '<footer>', chr(2)), '<[^>]*>', '', 'g') AS s FROM a),
    t AS (SELECT page_id, trim(replace(title, '&quot;', '"')) AS title, list_transform(string_split(s, chr(2)), lambda x: trim(regexp_replace(replace(replace(replace(replace(x,
        '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), ' +', ' ', 'g'))) AS parts FROM m),
    p AS (SELECT page_id, title, parts[1] AS ad, parts[3] AS h1, list_filter(parts[4:], lambda x: x <> '') AS paragraphs FROM t)
    SELECT page_id, {head}coalesce(ad, '') || CASE WHEN h1 <> '' THEN E'\n\n{hashes}' || h1 ELSE '' END ||
        array_to_string(list_transform(paragraphs, lambda x: E'\n\n{strong}' || x || '{strong}'), '') || E'\n' AS content FROM p"""


def _converted(head: str, hashes: str, strong: str) -> str:
    return _CONVERTED.replace("{head}", head).replace("{hashes}", hashes).replace("{strong}", strong)


_FRONT = r"E'---\ntitle: ' || title || E'\n---\n\n' || "


@query(_converted(_FRONT, "# ", "**"))
def convert_markdown(spark, d):
    return convert(spread(_pages(spark, d).select("page_id", "html")), doc_id="page_id").select(F.col("doc_id").alias("page_id"), "content")


@query(_converted(_FRONT, "# ", "*"))
def convert_djot(spark, d):
    return convert(spread(_pages(spark, d).select("page_id", "html")), Options(output_format="djot"), doc_id="page_id").select(F.col("doc_id").alias("page_id"), "content")


@query(_converted("", "", ""))
def convert_plain(spark, d):
    return convert(spread(_pages(spark, d).select("page_id", "html")), Options(output_format="plain"), doc_id="page_id").select(F.col("doc_id").alias("page_id"), "content")


@query("""SELECT '{"doc_id":' || page_id || ',"content":' || CAST(to_json(content) AS VARCHAR) || ',"error":null}' AS value FROM (""" + _converted(_FRONT, "# ", "**") + ")")
def convert_json(spark, d):
    return json_lines(convert(spread(_pages(spark, d).select("page_id", "html")), doc_id="page_id"))


@query(
    _LINKS
    + """, f AS (SELECT page_id, list(href ORDER BY n) AS hrefs FROM l GROUP BY page_id), c AS (SELECT page_id, content FROM ("""
    + _converted(_FRONT, "# ", "**")
    + r""")), b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*<article>', ''), '(?s)<footer>.*$', ''), '<[^>]*$', '') AS body FROM pages),
    p AS (SELECT page_id, list_filter(list_transform(string_split(body, '<p>')[2:], lambda x: trim(regexp_replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), ' +', ' ', 'g'))), lambda x: x <> '') AS parts FROM b)
    SELECT p.page_id, c.content, coalesce(f.hrefs, []) AS hrefs, list_transform(p.parts, lambda x: '**' || x || '**') AS paragraphs FROM p JOIN c USING (page_id) LEFT JOIN f USING (page_id)"""
)
def whole_pages(spark, d):
    """Content, links and the structure's paragraphs of whole results."""
    found = convert_result(spread(_pages(spark, d).select("page_id", "html")), Options(include_document_structure=True), doc_id="page_id")
    hrefs = F.transform("metadata.links", lambda x: x["href"])
    paragraphs = F.transform(F.filter("document.nodes", lambda x: (x["node_type"] == "paragraph") & (x["text"] != "")), lambda x: x["text"])
    return found.select(F.col("doc_id").alias("page_id"), "content", hrefs.alias("hrefs"), paragraphs.alias("paragraphs"))


@query(
    """SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS lang, count(*) AS n_pages, CAST(sum((length(html) - length(replace(html, '<a href', ''))) / 7) AS BIGINT) AS n_links,
    CAST(grouping(host) AS TINYINT) AS all_hosts, CAST(grouping(lang) AS TINYINT) AS all_langs FROM pages GROUP BY ROLLUP (host, lang)"""
)
def site_rollup(spark, d):
    p = _pages(spark, d).select(
        F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"),
        F.regexp_extract("html", '<html[^>]* lang="([^"]*)"', 1).alias("lang"),
        ((F.length("html") - F.length(F.replace("html", F.lit("<a href"), F.lit("")))) / 7).alias("links"),
    )
    return p.rollup("host", "lang").agg(F.count("*").alias("n_pages"), F.sum("links").cast("long").alias("n_links"), F.grouping("host").alias("all_hosts"), F.grouping("lang").alias("all_langs"))


@query(
    """WITH h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, page_id, length(html) AS n_chars FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n_chars DESC, page_id) AS place FROM h) SELECT host, page_id, n_chars, place FROM r WHERE place <= 3"""
)
def longest_pages_by_host(spark, d):
    h = _pages(spark, d).select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "page_id", F.length("html").cast("long").alias("n_chars"))
    place = F.row_number().over(W.partitionBy("host").orderBy(F.desc("n_chars"), "page_id")).cast("long")
    return h.withColumn("place", place).where("place <= 3")
