from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.functions import text as T
from pagequarry.operators import extract, render
from pagequarry.operators.nodes import parse, parse_documents
from pagequarry.plans.options import Options
from pyspark.sql import functions as F

PAGE = """<html lang="de" dir="RTL"><head><title>The &amp; title</title><meta name="keywords" content="a, b,,c"><meta name=description content=first><meta name=description content=second>
<meta property="og:title" content="OG"><meta name="twitter:card" content="sum"><link rel="x canonical" href="/c"><base href="/b">
<script type="application/ld+json">{"@type": "Article"}</script><script type="application/ld+json">{"@graph": [{"@type": ["Org", "x"]}]}</script></head>
<body><h1 id=top>One</h1><h2>Two</h2><h3>Three</h3><h2>Four</h2><p><a href="#top" rel="nofollow  me">up</a> <a href="/u">u <b>v</b></a> <a href="/u">again</a> <a>none</a></p>
<img src="data:image/png;base64,AAEC" alt="i" width=3 height=4><img src="/x.png" width=3 height=y><img alt="none">
<table><tr><th>h<td colspan=2>b<tr><td rowspan=x>c<td>d<td>e</table></body></html>"""


def nodes(spark, *pages):
    return parse_documents(spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string"))


def test_extraction(spark):
    n = nodes(spark, PAGE).cache()
    m = extract.document_metadata(n).first()
    assert (m.title, m.description, m.keywords, m.canonical_url, m.base_href, m.language, m.text_direction) == ("The & title", "second", ["a", "b", "c"], "/c", "/b", "de", "rtl")
    assert m.open_graph == {"title": "OG"} and m.twitter_card == {"card": "sum"}
    assert [(r.level, r.text, r.id) for r in extract.headers(n).orderBy("node_id").collect()] == [(1, "One", "top"), (2, "Two", None), (3, "Three", None), (2, "Four", None)]
    by_id = {r.node_id: r for r in extract.sections(n).collect()}
    assert {r.text: by_id[r.parent_id].text if r.parent_id is not None else None for r in by_id.values()} == {"One": None, "Two": "One", "Three": "Two", "Four": "One"}
    links = extract.links(n).orderBy("node_id").collect()
    assert [(r.href, r.text, r.link_type, r.rel) for r in links] == [("#top", "up", "anchor", ["nofollow", "me"]), ("/u", "u v", "internal", []), ("/u", "again", "internal", [])]
    assert {(r.href, r.number) for r in extract.reference_numbers(extract.links(n)).collect()} == {("#top", 1), ("/u", 2)}
    images = extract.images(n).orderBy("node_id").collect()
    assert [(r.image_type, r.width, r.height) for r in images] == [("data_uri", 3, 4), ("relative", None, None)]
    picture = extract.inline_images(n).first()
    assert (picture.format, bytes(picture.data), picture.skipped) == ("png", b"\0\1\2", None)
    assert [r.schema_type for r in extract.json_ld(n).orderBy("node_id").collect()] == ["Article", "Org"]
    assert extract.json_ld(n, most_bytes=30).count() == 1
    t = render.rendered(n, Options()).selectExpr("inline(tables)").first()
    assert (t.n_rows, t.n_cols) == (2, 3) and [(c.content, c.row, c.col, c.col_span, c.is_header) for c in t.cells] == [
        ("h", 0, 0, 1, True), ("b", 0, 1, 2, False), ("c", 1, 0, 1, False), ("d", 1, 1, 1, False), ("e", 1, 2, 1, False)]


@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<table>", "<td>", "<tr>", "</table>", "<script>", "</script>", "text", "&amp;", "<!--", "-->", "<br/>", "<", "<a href='x'>", "</a>", "<td"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_nodes_are_a_tree(tokens):
    t = parse("".join(tokens))
    assert len({len(getattr(t, c)) for c in t.COLUMNS}) == 1
    for k, parent in enumerate(t.parent):
        assert t.last[k] >= k and t.nth[k] >= 1 and (t.kind[k] == "tag") == (t.tag[k] is not None)
        assert t.depth[k] == (0 if parent is None else t.depth[parent] + 1) and t.opens[k] <= t.closes[k]
        if parent is not None:
            assert parent < k and t.last[parent] >= t.last[k] and t.opens[parent] <= t.opens[k] and t.closes[parent] >= t.closes[k]
    # Every node opens once and every element that holds something closes once, in the runs that it says.
    codes = [c for run in t.codes for c in run]
    assert sorted(c // 2 for c in codes if c % 2 == 0) == list(range(len(t.parent))) and len(set(codes)) == len(codes)
    assert all(2 * k in t.codes[run] for k, run in enumerate(t.opens))


def test_open_formatting_continues():
    t = parse("<p><b>one<p>two</b> three<p>four")
    assert {x: p.split() for x, p in zip(t.text, t.path) if x} == {"one": ["p", "b"], "two": ["p", "b"], " three": ["p"], "four": ["p"]}


def test_any_depth():
    t = parse("<div>" * 30_000 + "<nav>x</nav>y")
    assert t.depth[-1] == 30_000 and t.tag[-3] == "nav" and t.parent[-1] == 29_999


def test_invalid_pages(spark):
    pages = ["ok <b>", "\x1f\u008b", "%PDF-1", "x" * 90 + "\0" * 9, "\x01" * 20 + "y" * 20, "\x01", "PK\x03\x04", "(µ/ý"]
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, s string").select("k", T.invalid_reason(F.col("s")).alias("r")).orderBy("k").collect()
    assert [r.r for r in rows] == [None, None, "binary", "nul", "control", None, "binary", None]


def test_strings(spark):
    row = spark.createDataFrame([("  a\n\n    b\n  c", "1. x_y*z|\\", "data:image/jpg;base64,AA==", "data:image/png,xx", "see [t](http://u) now")], "d string, e string, i string, j string, l string").select(
        T.dedent(F.col("d")).alias("d"),
        T.escape(F.col("e"), misc=True, asterisks=True, underscores=True).alias("e"),
        T.data_uri(F.col("i")).alias("i"),
        T.data_uri(F.col("j")).alias("j"),
        T.markdown_target(F.col("l")).alias("l"),
        T.percent_encode(F.lit("a b/c~d*e:f?g")).alias("p"),
    ).first()
    assert row.d == "a\n\n  b\nc" and row.e == "1\\. x\\_y\\*z\\|\\\\" and row.i.format == "jpeg" and row.j.skipped == "not base64" and row.l == "http://u"
    assert row.p == "a%20b/c~d%2Ae%3Af%3Fg"


def test_structure(spark):
    from pagequarry.operators.structure import document_tree

    page = "<p>before</p><h1>A</h1><p>x</p><h2>B</h2><ul><li>i<ol><li>j</ol></ul><h1>C</h1><img src=s><pre class=language-py>c</pre><table><tr><td><p>t</table>"
    rows = document_tree(nodes(spark, page)).orderBy("position", "node_type").collect()
    by_id = {r.id: r for r in rows}
    label = lambda r: (r.node_type, r.text)
    found = [(label(r), label(by_id[r.parent]) if r.parent else None) for r in rows]
    A, B, C = ("group", "A"), ("group", "B"), ("group", "C")
    assert found == [
        (("paragraph", "before"), None), (A, None), (("heading", "A"), A), (("paragraph", "x"), A), (B, A), (("heading", "B"), B), (("list", None), B),
        (("list_item", "i"), ("list", None)), (("list", None), B), (("list_item", "j"), ("list", None)), (C, None), (("heading", "C"), C), (("image", None), C), (("code", "c"), C), (("table", None), C)]
    assert [r.ordered for r in rows if r.node_type == "list"] == [False, True] and len(by_id) == len(rows)


def test_sql_names(spark):
    from pagequarry.sql import register

    register(spark)
    assert [r.tag for r in spark.sql("SELECT tag FROM VALUES ('<p>a<b>c') AS t(html), LATERAL html_nodes(html) WHERE kind = 'tag'").collect()] == ["p", "b"]


def test_parts_of_a_page_copy_no_whole_arrays(spark):
    """``slice`` copies the whole array at each call, so a table's time would grow by the square of its rows."""
    from pyspark.sql import functions as F

    from pagequarry.operators import nodes, render
    from pagequarry.plans.options import Options

    parts = [nodes.stretch(F.col("a"), F.lit(first), F.lit(size)) for first, size in ((0, 3), (1, 2), (2, 1), (0, 0), (3, 0))]
    assert [list(x) for x in spark.sql("SELECT array('x', NULL, 'z') AS a").select(*parts).first()] == [["x", None, "z"], [None, "z"], ["z"], [], []]
    assert "slice(" not in str(render.tables(F.col("texts"), F.col("gone"), Options()))
