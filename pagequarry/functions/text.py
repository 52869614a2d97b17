"""String functions on columns of text or HTML source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What one space stands for besides space and tab (newlines are not among them).
SPACES = " \\t\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
#: First bytes of gzip, zstd, three kinds of zip, and PDF.
BINARY_STARTS = ("1f8b", "28b52ffd", "504b0304", "504b0506", "504b0708", "255044462d")
#: The named references that are decoded by a column function; ``&amp;`` comes last.
NAMED = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&trade;", "™"),
    ("&middot;", "·"),
    ("&hellip;", "…"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&bull;", "•"),
    ("&euro;", "€"),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&amp;", "&"),
)


def invalid_reason(html: Column) -> Column:
    """Why a page is no text (``binary``, ``nul``, ``control``), else null.

    Looks at the first 8,192 bytes: a known file signature; more than 1 % and
    more than 8 NULs; or of 32 bytes at least, more than 30 % control bytes.
    """
    data = F.substring(F.encode(html, "UTF-8"), 1, 8192)
    head = F.lower(F.hex(F.substring(data, 1, 5)))
    size = F.octet_length(data)
    sample = F.decode(data, "ISO-8859-1")
    nuls = size - F.length(F.replace(sample, F.lit("\u0000"), F.lit("")))
    control = size - F.length(F.regexp_replace(sample, "[\\x00-\\x08\\x0e-\\x1f]", ""))
    signature = F.lit(False)
    for s in BINARY_STARTS:
        signature = signature | head.startswith(s)
    return (
        F.when(signature, F.lit("binary"))
        .when((nuls > 8) & (nuls * 100 > size), F.lit("nul"))
        .when((size >= 32) & (control * 10 > size * 3), F.lit("control"))
    )


def decode_utf16(c: Column) -> Column:
    """Text whose bytes are UTF-16, decoded; any other as it is.

    It is if at least a fifth of its first 8,192 bytes are NUL, nine in ten of them at
    even or at odd places.  (Bytes with a byte order mark are no valid text; the
    reading of files sees to them.)
    """
    data = F.encode(c, "UTF-8")
    sample = F.decode(F.substring(data, 1, 8192), "ISO-8859-1")
    first, second = (F.length(F.regexp_replace(sample, p, "$1")) for p in (r"(?s)(\x00).|..?", r"(?s).(\x00)|..?"))
    n = first + second
    many = (n >= 2) & (n * 5 >= F.length(sample)) & (F.length(sample) >= 4)
    pairs = F.substring(data, F.lit(1), (F.octet_length(data) - F.octet_length(data) % 2).cast("int"))
    # Halves of characters outside the first plane would fail to decode one by one; texts with them stay as they are.
    whole = ~F.decode(data, "ISO-8859-1").rlike(r"[\xd8-\xdf]")
    nul = F.contains(c, F.lit("\u0000"))
    # The first condition stands alone, so that without a NUL nothing else is worked out.
    return (
        F.when(~nul, c)
        .when(many & whole & (second * 10 >= n * 9), F.decode(pairs, "UTF-16LE"))
        .when(many & whole & (first * 10 >= n * 9), F.decode(pairs, "UTF-16BE"))
        .otherwise(c)
    )


def strip_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\u0000"), F.lit(""))


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def space_self_closing(c: Column) -> Column:
    """``<name/>`` as ``<name />``."""
    return F.regexp_replace(c, "<([A-Za-z][A-Za-z0-9:-]*)/>", "<$1 />")


def normalize_input(c: Column) -> Column:
    return space_self_closing(unix_newlines(strip_nul(c)))


def normalize_whitespace(c: Column) -> Column:
    """Runs of spaces as one space; newlines stay."""
    return F.regexp_replace(c, f"[{SPACES}]+", " ")


def one_line(c: Column) -> Column:
    """A label: newlines and spaces as one space each, trimmed."""
    return F.trim(F.regexp_replace(c, f"[{SPACES}\r\n]+", " "))


def escape_misc(c: Column) -> Column:
    c = F.regexp_replace(c, r"([\\&<`\[\]>~#=+|-])", r"\\$1")
    return F.regexp_replace(c, r"([0-9])([.)])", r"$1\\$2")


def escape_asterisks(c: Column) -> Column:
    return F.replace(c, F.lit("*"), F.lit("\\*"))


def escape_underscores(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("\\_"))


def escape_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"([!-/:-@\[-`{-~])", r"\\$1")


def escape(c: Column, asterisks=False, underscores=False, misc=False, ascii=False) -> Column:
    """Backslashes as asked for; ``ascii`` stands for all."""
    if ascii:
        return escape_ascii(c)
    if misc:
        c = escape_misc(c)
    if asterisks:
        c = escape_asterisks(c)
    return escape_underscores(c) if underscores else c


def chomp(c: Column) -> Column:
    """``prefix, suffix, core``: one space for blanks before; two newlines or one space for blanks after."""
    return F.struct(
        F.when(c.rlike(r"^\s"), F.lit(" ")).otherwise(F.lit("")).alias("prefix"),
        F.when(c.rlike(r"\n\n\z"), F.lit("\n\n")).when(c.rlike(r"\s\z"), F.lit(" ")).otherwise(F.lit("")).alias("suffix"),
        F.regexp_replace(c, r"^\s+|\s+\z", "").alias("core"),
    )


def decode_named(c: Column) -> Column:
    """The references in :data:`NAMED` decoded; any other stays."""
    for name, char in NAMED:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def trim_line_ends(c: Column) -> Column:
    """Blanks at line ends go, but two spaces that end a line stay; one final newline at most."""
    line = F.transform(
        F.split(c, "\n"),
        lambda x: F.concat(F.rtrim(F.regexp_replace(x, "[ \t]+$", "")), F.when(x.endswith("  ") & (F.trim(x) != ""), F.lit("  ")).otherwise(F.lit(""))),
    )
    return F.regexp_replace(F.array_join(line, "\n"), "\n+\\z", "\n")


def dedent(c: Column) -> Column:
    """Without the white space that all non-blank lines start with."""
    lines = F.split(c, "\n")
    widths = F.transform(F.filter(lines, lambda x: ~x.rlike(r"^\s*$")), lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", "")))
    cut = F.coalesce(F.array_min(widths), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, cut + 1)), "\n")


def has_scheme(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def percent_encode(c: Column) -> Column:
    """All but letters, digits, ``-_.~`` and ``/``."""
    c = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markdown_target(c: Column) -> Column:
    """The target of a Markdown link that was pasted into an attribute, else the text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\[[^\]]*\]\(([^)\s]+)", 1), F.lit("")), c)


def link_type(href: Column) -> Column:
    return (
        F.when(href.startswith("#"), "anchor")
        .when(href.startswith("mailto:"), "email")
        .when(href.startswith("tel:"), "phone")
        .when(href.startswith("http://") | href.startswith("https://"), "external")
        .when(href.startswith("/") | href.startswith("../") | href.startswith("./"), "internal")
        .otherwise("other")
    )


def image_type(src: Column) -> Column:
    return (
        F.when(src.startswith("data:"), "data_uri")
        .when(src.startswith("http://") | src.startswith("https://"), "external")
        .when(src.startswith("<") & src.contains("svg"), "inline_svg")
        .otherwise("relative")
    )


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def json_ld_type(raw: Column) -> Column:
    """The first ``@type`` in a JSON-LD block: a string, or the first of a list."""
    return F.nullif(F.regexp_extract(raw, r'"@type"\s*:\s*\[?\s*"([^"]*)"', 1), F.lit(""))


def base64(data: Column) -> Column:
    """Base64 on one line."""
    return F.translate(F.base64(data), "\r\n", "")


def data_uri(src: Column) -> Column:
    """``format, data, skipped`` of a base64 image in a ``data:`` URI; ``skipped`` says why there are no bytes."""
    kind = F.regexp_extract(src, r"^data:image/([A-Za-z0-9.+-]+)", 1)
    body = F.regexp_replace(F.regexp_extract(src, r"(?s)^data:image/[^,]*;base64,(.*)$", 1), r"\s+", "")
    data = F.try_to_binary(body, F.lit("base64"))
    reason = (
        F.when(kind == "", "no image")
        .when(~src.rlike("^data:image/[^,]*;base64,"), "not base64")
        .when(body == "", "empty")
        .when(data.isNull(), "bad base64")
    )
    name = F.lower(kind)
    name = F.when(name == "jpg", "jpeg").when(name == "svg+xml", "svg").otherwise(name)
    return F.struct(F.when(reason.isNull(), name).alias("format"), F.when(reason.isNull(), data).alias("data"), reason.alias("skipped"))


def front_matter(meta: Column) -> Column:
    """A map as sorted ``key: value`` lines between rules; empty for an empty map."""
    lines = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.when(F.size(lines) > 0, F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"))).otherwise(F.lit(""))


def span(c: Column) -> Column:
    """A cell's span: 1 unless a whole number, from 1 to 1000."""
    return F.least(F.greatest(F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d{1,9})\s*$", 1), F.lit("999999999")).cast("int"), F.lit(1)), F.lit(1)), F.lit(1000))
