import pytest

from pagequarry.plans.convert import convert, convert_result
from pagequarry.plans.options import Options, parse_enum

# What a page becomes by default, without front matter.
DEFAULT = [
    ("<p>Rain fell</p><p>Later it stopped</p>", "Rain fell\n\nLater it stopped\n"),
    ("<h1>One</h1><h2>Two</h2><h6>Six</h6>", "# One\n\n## Two\n\n###### Six\n"),
    ("<p><strong><em>Both</em></strong></p>", "***Both***\n"),
    ("<p><strong>Bold <em>and slanted</em> text</strong></p>", "**Bold *and slanted* text**\n"),
    ("<b>in<b>ner</b></b>", "**inner**\n"),
    ("<p>Line 1<br>Line 2</p>", "Line 1  \nLine 2\n"),
    ("<pre><code>a  b\n  c</code></pre>", "```\na  b\n  c\n```\n"),
    ('<pre><code class="language-rust">x</code></pre>', "```rust\nx\n```\n"),
    ('<p><a href="/u" title="t">L</a></p>', '[L](/u "t")\n'),
    ('<p><a href="">Empty</a></p>', "[Empty](<>)\n"),
    ('<p><a href="https://e.org/x">https://e.org/x</a></p>', "<https://e.org/x>\n"),
    ('<p><a href="mailto:a@e.org">a@e.org</a></p>', "<a@e.org>\n"),
    ('<p><a href="/1">One</a><a href="/2">Two</a></p>', "[One](/1)[Two](/2)\n"),
    ('<p>\n<a href="/1">One</a>\n<a href="/2">Two</a>\n</p>', "[One](/1) [Two](/2)\n"),
    ('<p><img src="i.jpg" alt="Alt" /></p>', "![Alt](i.jpg)\n"),
    ("<ul><li>a</li><li>b</li></ul>", "- a\n- b\n"),
    ("<ul><li>a<li>b<li>c</ul>", "- a\n- b\n- c\n"),
    ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "- a\n  * b\n- c\n"),
    ('<ol start="4"><li>x</li><li>y</li></ol>', "4. x\n5. y\n"),
    ("<blockquote><blockquote><p>deep</p></blockquote></blockquote>", "> > deep\n"),
    ("<p>a</p><hr><p>b</p>", "a\n\n---\n\nb\n"),
    ("<p>before it</p><!----><p>after it</p>", "before it\n\nafter it\n"),
    ("<p>&lt;div&gt; &amp; &quot;q&quot;</p>", '<div> & "q"\n'),
    ("<p>many    spaces</p>", "many spaces\n"),
    ("<div>First</div><div>Second</div>", "First\n\nSecond\n"),
    ("<p>H<sub>2</sub>O</p>", "H2O\n"),
    ("<p>before\n<strong>bold</strong> after</p>", "before **bold** after\n"),
    ("<p>hello <b>world", "hello **world**\n"),
    ("<p>x1<p>x2<p>x3", "x1\n\nx2\n\nx3\n"),
    ("<p>If a < b then a < c</p>", "If a < b then a < c\n"),
    ("<nav>menu</nav><form>f</form><p>x</p><script>y</script>", "x\n"),
    ("<p><del>a</del> <mark>b</mark> <q>c</q></p>", '~~a~~ ==b== "c"\n'),
    ('<p><abbr title="long">s</abbr></p>', "s (long)\n"),
    ("<table><tr><th>A</th><th>Bee</th></tr><tr><td>1</td><td>2|3</td></tr></table>", "| A   | Bee  |\n| --- | ---- |\n| 1   | 2\\|3 |\n"),
    ("<dl><dt>t</dt><dd>d</dd></dl>", "t\nd\n"),
    ("<details><summary>s</summary><p>x</p></details>", "**s**\n\nx\n"),
    ("5 &lt; 10 &amp; ok", "5 < 10 & ok\n"),
    ("<br>\n1\n2\n<b>3</b>", "\n1\n2\n**3**\n"),
    ("<p>a <code>x``y`z</code></p>", "a ```x``y`z```\n"),
    ("<p><code>`</code></p>", "`` ` ``\n"),
    ("<blockquote cite='http://c'><p>q</p></blockquote><p>z</p>", "> q\n\n— <http://c>\n\nz\n"),
    ("<a href='/x'><h2>T</h2></a>", "## [T](/x)\n"),
    ("<p><a href='/x'>a ] b</a> <a href='/y'>[c]</a></p>", "[a \\] b](/x) [[c]](/y)\n"),
    ("<p><a href='#top'>^</a></p>", "[↑](#top)\n"),
    ("<b>a<p>x</p>c</b>", "**a**\n\n**x**\n\n**c**\n"),
    ("<select><optgroup label=G><option>a<option selected>b</select>", "**G**\na\n* b\n"),
    ("<p>x</p><audio><source src=s.mp3>text</audio>", "x\n\n[s.mp3](s.mp3)\n\ntext\n"),
    ("<p>a <math><mi>x</mi></math></p>", "a <!-- MathML: <math><mi>x</mi></math> --> x\n"),
    ("<p><svg width=1><title>T</title></svg></p>", "![T](data:image/svg+xml;base64,PHN2ZyB3aWR0aD0iMSI+PHRpdGxlPlQ8L3RpdGxlPjwvc3ZnPg==)\n"),
    ("<p><ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby></p>", "k(r)\n"),
    ("<table><caption>a-b</caption><tr><th>h</table>", "*a\\-b*\n\n| h   |\n| --- |\n"),
    ("<table><tr><th rowspan=2>a<th>b<tr><td>c</table>", "| a   | b   |\n| --- | --- |\n|     | c   |\n"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "- a b\n- c\n"),
    ("<table><tr><th>a<td><table><tr><td>in<td>ner</table></table>", "| a   | in ner |\n| --- | ------ |\n"),
    ("<table border=0><tr><td colspan=2>x</table>", "- x\n"),
    ("<table>loose<tr>text<th>a</table><p>z</p>", "| a   |\n| --- |\n\nz\n"),
    ("<ul><li>x<table><tr><th>a</table></ul>", "- x\n\n    | a   |\n    | --- |\n"),
    ("<ul><li><p>a</p><li><p>b</p></ul>", "- a\n\n- b\n"),
    ("<ul><li><input type=checkbox checked> done<li><input type=checkbox> open</ul>", "- [x] done\n- [ ] open\n"),
    ("<div " * 3 + ">x</div>", "x\n"),
    ("<head><title>t</title><p>in head</p></head>", "in head\n"),
    ("<p hidden>no</p><p>yes</p>", "yes\n"),
    ("", ""),
    (None, ""),
    ("a\u0000b", "ab\n"),
]


def run(spark, pages, **options):
    table = spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string")
    return [r.content for r in convert(table, Options.of(options)).orderBy("doc_id").collect()]


def test_default(spark):
    found = run(spark, [h for h, _ in DEFAULT], extract_metadata=False)
    wrong = [(h, w, f) for (h, w), f in zip(DEFAULT, found) if w != f]
    assert not wrong


@pytest.mark.parametrize(
    "options, page, want",
    [
        ({"heading_style": "Underlined"}, "<h1>Üb</h1><h3>x</h3>", "Üb\n===\n\n### x\n"),
        ({"heading_style": "atx_closed"}, "<h2>x</h2>", "## x ##\n"),
        ({"code_block_style": "tildes"}, "<p>Foo</p><pre><code>1\n2\n</code></pre>", "Foo\n\n~~~\n1\n2\n~~~\n"),
        ({"code_block_style": "indented"}, "<pre><code>1\n2\n</code></pre>", "    1\n    2\n"),
        ({"sub_symbol": "~", "sup_symbol": "<sup>"}, "<p>a<sub>b</sub><sup>c</sup></p>", "a~b~<sup>c</sup>\n"),
        ({"output_format": "djot"}, "<p><b>a</b> <i>b</i> <del>c</del></p>", "*a* _b_ {-c-}\n"),
        ({"output_format": "plain"}, "<h1>T</h1><p><b>x</b><br>y</p><ol start=42><li>a<li>b</ol>", "T\n\nx\ny\n\n42. a\n43. b\n"),
        ({"exclude_selectors": [".ad", "#x", "[data-a='1']", "!!bad"]}, "<p class='b ad'>1</p><p id=x>2</p><p data-a=1>3</p><p>4</p>", "4\n"),
        ({"max_depth": 0}, "<p>x</p>", ""),
        ({"preprocessing": {"enabled": False}}, "<nav>menu</nav>", "menu\n"),
        ({"preprocessing": {"preset": "aggressive"}}, "<footer>f</footer><div class='x gdpr'>a</div><div class='ad'>b</div><div id=vector:nav>c</div><p>x</p>", "b\n\nx\n"),
        ({"escape_asterisks": True}, "<p>a*b</p>", "a\\*b\n"),
        ({"newline_style": "backslash"}, "<p>a<br>b</p>", "a\\\nb\n"),
        ({"strong_em_symbol": "_"}, "<p><b>a</b></p>", "__a__\n"),
        ({"output_format": "djot"}, "<p><ins>a</ins> <mark>b</mark></p>", "{+a+} {=b=}\n"),
        ({"preserve_tags": ["sub"]}, "<p>a<sub>b  c</sub></p>", "a<sub>b  c</sub>\n"),
        ({"strip_tags": ["h1", "b"]}, "<h1>x <b>y</b></h1>", "x y\n"),
        ({"convert_as_inline": True}, "<h1>a</h1><p>b</p>", "a b\n"),
        ({"wrap": True, "wrap_width": 9}, "<ul><li>aa bb cc dd</ul><blockquote>ee ff gg</blockquote>", "- aa bb\n  cc dd\n\n> ee ff\n> gg\n"),
        ({"url_escape_style": "percent"}, "<p><a href='http://h/?q=1'>x</a></p>", "[x](http%3A//h/%3Fq%3D1)\n"),
        ({"url_escape_style": "percent"}, "<p><a href='/a b'>x</a></p>", "[x](/a%20b)\n"),
    ],
)
def test_options(spark, options, page, want):
    assert run(spark, [page], extract_metadata=False, **options) == [want]


def test_front_matter_and_errors(spark):
    rows = spark.createDataFrame([(1, "<title>T</title><meta name=b content=2><p>x"), (2, "%PDF-1.4 <b>"), (3, "<p>ok")], "doc_id long, html string")
    found = {r.doc_id: r for r in convert(rows).collect()}
    assert found[1].content == "---\nmeta-b: 2\ntitle: T\n---\n\nx\n"
    assert found[2].content is None and found[2].error.kind == "InvalidInput" and found[2].error.message == "binary"
    assert found[3].error is None


def test_rows_are_documents(spark):
    rows = spark.createDataFrame([(1, "<p>one</p><p>two</p>"), (1, "<h1>three</h1>"), (None, "<p>four")], "doc_id long, html string")
    assert sorted(r.content for r in convert(rows).collect()) == ["# three\n", "four\n", "one\n\ntwo\n"]


def test_no_shuffle(spark):
    rows = spark.range(0, 10, 1, 3).selectExpr("id AS doc_id", "concat('<p>', id) AS html")
    plan = convert(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1 and "Window" not in plan and "Sort" not in plan


def test_whole_result(spark):
    page = "<title>T</title><h1>A</h1><p>x <a href=/u>l</a></p><table><tr><th>h</table><img src='data:image/png;base64,AAEC'><img src='data:image/png,xx'><div><div><div>deep"
    options = Options(include_document_structure=True, extract_images=True, max_depth=2)
    r = convert_result(spark.createDataFrame([(1, page), (2, "PK\x03\x04"), (3, None)], "doc_id long, html string"), options).orderBy("doc_id").collect()
    first = r[0]
    assert first.metadata.document.title == "T" and [h.text for h in first.metadata.headers] == ["A"] and [x.href for x in first.metadata.links] == ["/u"]
    assert [n.node_type for n in first.document.nodes] == ["group", "heading", "paragraph", "table", "image", "image"] and first.document.source_format == "html"
    assert [bytes(i.data) for i in first.images] == [b"\0\1\2"] and "deep" not in first.content
    assert [w.kind for w in first.warnings] == ["depth_limit_exceeded", "image_extraction_failed"]
    assert r[1].content is None and r[1].error.message == "binary" and r[1].metadata is None and r[2].content == "" and r[2].warnings == []


def test_utf16_in_text(spark):
    rows = spark.createDataFrame([(1, "<\0p\0>\0h\0i\0"), (2, "\0<\0p\0>\0h\0i")], "doc_id long, html string")
    assert [r.content for r in convert(rows).collect()] == ["hi\n", "hi\n"]


def test_enums():
    assert parse_enum("heading_style", "ATX_CLOSED") == "atxclosed" and parse_enum("heading_style", "?") == "underlined" and parse_enum("output_format", "Plain-Text") == "plain"
    assert Options().update(wrap=True, bullets=None).wrap and Options().update(bullets=None).bullets == "-*+"
    with pytest.raises(ValueError):
        Options(strong_em_symbol="x")


def test_reference_links_and_wrap(spark):
    page = "<p><a href='/a'>one</a> <a href='/b' title=t>two</a> <a href='/a'>three</a></p>"
    assert run(spark, [page], extract_metadata=False, link_style="reference") == ['[one][1] [two][2] [three][1]\n\n[1]: /a\n[2]: /b "t"\n']
    assert run(spark, ["<p>aa bb cc dd</p><h1>a long heading</h1>"], extract_metadata=False, wrap=True, wrap_width=5) == ["aa bb\ncc dd\n\n# a long heading\n"]


def test_declared_visitor(spark):
    visitor = {"link": {"action": "custom_template", "template": "<{href}|{text}>"}, "image": {"action": "skip"}, "code_block": {"action": "custom", "output": "CODE"}}
    page = "<p><a href='/a'>one <b>x</b></a><img src=i></p><pre>gone</pre>"
    assert run(spark, [page], extract_metadata=False, visitor=visitor) == ["</a|one **x**>\n\nCODE\n"]
    with pytest.raises(ValueError):
        Options(visitor={"no_such": {}})


@pytest.mark.parametrize(
    "page, content",
    [
        ("<p title=Bob's>one</p><p>two</p><p>it's three</p>", "one\n\ntwo\n\nit's three\n"),
        ("<p title=Bob's>one</p><p>two</p>", "one\n\ntwo\n"),
        ("<p title='a>b' class=\"c>d\">one</p><p x=y='z>two</p>", "one\n\ntwo\n"),
    ],
)
def test_quotes_inside_tags(spark, page, content):
    rows = convert(spark.createDataFrame([(1, page)], "doc_id long, html string"), Options(extract_metadata=False)).collect()
    assert [r.content for r in rows] == [content]


def test_cells_without_a_row(spark):
    pages = ["<table><td>a<td>b</table>", "<table><tr><td>a<td>b</tr></table>", "<table><tbody><td>a</td><td>b</td></tbody></table>"]
    rows = convert(spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string"), Options(extract_metadata=False)).collect()
    assert {r.content for r in rows} == {"| a   | b   |\n| --- | --- |\n"}, rows


def test_tables_are_asked_for(spark):
    page = spark.createDataFrame([(1, "<table><tr><th>X</th></tr><tr><td>Y</td></tr></table>")], "doc_id long, html string")
    assert convert_result(page).first().tables == []
    assert len(convert_result(page, Options(include_document_structure=True)).first().tables) == 1


def test_visitor_names():
    assert Options(visitor={"visit_link": {"action": "skip"}}).visitor == {"link": {"action": "skip"}}
    with pytest.raises(ValueError):
        Options(visitor={"link": {"action": "nonsense"}})


def test_title_with_ampersands_that_are_no_reference(spark):
    """Front matter has a title's HTML: a lone ``&`` and a reference cut short stay as they are."""
    titles = {
        "a&amp;b &": "a&amp;b &",
        "x &am": "x &am",
        "y &amp": "y &amp",
        "&lt;i&gt; &#38; &quot;q&quot; &copy;": '&lt;i&gt; &amp; "q" ©',
        "R&D &nosuch; <b": "R&D &nosuch; <b",
    }
    pages = [(k, f"<html><head><title>{t}</title></head><body><p>x</p></body></html>") for k, t in enumerate(titles)]
    found = {r.doc_id: r.content for r in convert(spark.createDataFrame(pages, "doc_id long, html string")).collect()}
    assert found == {k: f"---\ntitle: {t}\n---\n\nx\n" for k, t in enumerate(titles.values())}
