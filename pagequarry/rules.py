"""Queries that hold rendering rules against SQL: pages made from each row of ``nation``, and what must become of them.

A case is a page and its result, both templates in which ``{n}`` stands for the
row's name, ``{k}`` for its key and ``{e}`` for its name with escaped underscores.  Every case meets every row of the table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators import extract, structure
from pagequarry.operators.nodes import parse_documents
from pagequarry.plans.convert import convert, convert_result
from pagequarry.plans.options import Options
from pagequarry.sources.io import json_lines, spread, table

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}

_HOLE = re.compile(r"(\{n\}|\{k\}|\{e\})")


def _column(template: str) -> Column:
    holes = {"{n}": F.col("n_name"), "{k}": F.col("n_nationkey").cast("string")}
    return F.concat(*(holes.get(p, F.lit(p)) for p in _HOLE.split(template)))


def _sql(template: str) -> str:
    def literal(text: str) -> str:
        return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))

    holes = {"{n}": "n_name", "{k}": "CAST(n_nationkey AS VARCHAR)", "{e}": "replace(n_name, '_', '\\_')"}
    return " || ".join(holes.get(p) or literal(p) for p in _HOLE.split(template))


def _pages(spark, d: str, cases: list[tuple]) -> DataFrame:
    """``doc_id, case_no, html``: every case of every row."""
    each = F.array(*(F.struct(F.lit(k).alias("case_no"), _column(c[0]).alias("html")) for k, c in enumerate(cases)))
    found = table(spark, d, "nation").select((F.col("n_nationkey") * 1000).alias("base"), F.explode(each).alias("c"))
    return spread(found.select((F.col("base") + F.col("c.case_no")).cast("long").alias("doc_id"), "c.html"))


def rules(name: str, options: dict, cases: list[tuple[str, str]]) -> None:
    """Register a query that converts the cases with some options: ``doc_id`` (key * 1000 + case) and ``content``."""

    def run(spark, d: str) -> DataFrame:
        return convert(_pages(spark, d, cases), Options.of({"extract_metadata": False} | options)).select("doc_id", "content")

    rows = ", ".join(f"({k}, {_sql(want + chr(10) if want else '')})" for k, (_, want) in enumerate(cases))
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT CAST(n_nationkey * 1000 + c.k AS BIGINT) AS doc_id, c.content FROM nation, LATERAL (VALUES {rows}) c(k, content)"


def extracted(name: str, cases: list[str], found, select: list[str], want: str) -> None:
    """Register a query for rows that ``found`` gives of the cases' documents; ``want`` is SQL over ``nation``."""

    def run(spark, d: str) -> DataFrame:
        return found(parse_documents(_pages(spark, d, [(c,) for c in cases]))).selectExpr(*select)

    QUERIES[name], ORACLE_SQL[name] = run, want


rules(
    "block_elements",
    {},
    [
        ("<h1>{n}</h1><h2>a\nb</h2><h6>{k}</h6><h3></h3>", "# {n}\n\n## a b\n\n###### {k}"),
        ("<p>{n}<p>{k}</p>", "{n}\n\n{k}"),
        ("<div>{n}</div><section><div>{k}</div></section>", "{n}\n\n{k}"),
        ("<article><header><p>{n}</p></header><main>{k}</main></article>", "{n}\n\n{k}"),
        ("<blockquote><p>{n}</p><p>{k}</p></blockquote>", "> {n}\n>\n> {k}"),
        ("<blockquote>{n}<blockquote><p>{k}</p></blockquote></blockquote>", "> {n}\n>\n> > {k}"),
        ("<blockquote cite='http://h/{k}'><p>{n}</p></blockquote>", "> {n}\n\n— <http://h/{k}>"),
        ("<p>{n}</p><hr><p>{k}</p>", "{n}\n\n---\n\n{k}"),
        ("<p>{n}<br>{k}<br/></p>", "{n}  \n{k}"),
        ("<pre><code class='language-c'>{n}\n\n  {k}\n</code></pre>", "```c\n{n}\n\n  {k}\n```"),
        ("<pre>  {n}\n    {k}</pre>", "```\n{n}\n  {k}\n```"),
        ("<dl><dt>{n}</dt><dd>{k}</dd></dl>", "{n}\n{k}"),
        ("<figure><img src=i{k}.png alt='{n}'><figcaption>{n}</figcaption></figure>", "![{n}](i{k}.png)\n\n*{n}*"),
        ("<details><summary>{n}</summary><p>{k}</p></details><dialog>d</dialog>", "**{n}**\n\n{k}\n\nd"),
        ("<fieldset><legend>{n}</legend><label>{k}</label><button>b</button></fieldset>", "**{n}**\n\n{k}\n\nb"),
        ("<select><optgroup label='{n}'><option>{k}<option selected>s</select>", "**{n}**\n{k}\n* s"),
        ("<p>x</p><audio><source src='{k}.mp3'></audio><video src='{k}.mp4'>{n}</video><iframe src='/f{k}'>no</iframe>", "x\n\n[{k}.mp3]({k}.mp3)\n\n[{k}.mp4]({k}.mp4)\n\n{n}\n\n[/f{k}](/f{k})"),
        ("<!-- c -->{n}<script>s</script><style>t</style><template>u</template><p>{k}", "{n}\n\n{k}"),
        ("<p hidden>{n}</p><div hidden=x><p>no</p></div><p>{k}</p>", "{k}"),
        ("<x-tag>{n} <time>{k}</time></x-tag>", "{n} {k}"),
        ("<b>{n}<p>{k}</p>x</b>", "**{n}**\n\n**{k}**\n\n**x**"),
    ],
)
# Broken markup as browsers read it: a formatting element ends in a block that began inside it, elements that cross, marks over blocks.
rules(
    "crossing_elements",
    {},
    [
        ("<b>1<p>2<i>3<s>{n}</b>5</p>6", "**1**\n\n**2*3~~{n}~~****~~5~~*\n\n*~~6~~*"),
        ("<p>1<b>2<i>{n}</b>4</i>{k}</p>", "1**2*{n}****4*{k}"),
        ("<p><b>{n}<p>two</b> {k}<p>four", "**{n}**\n\n**two** {k}\n\nfour"),
        ("<b>{n}<p>{k}</b>3</p>", "**{n}**\n\n**{k}**3"),
        ("<a href=/{k}>1<p>{n}</a>3</p>", "[1](/{k})\n\n[{n}](/{k})3"),
        ("<a href=/1>{n}<a href=/2>{k}</a> z", "[{n}](/1)[{k}](/2) z"),
        ("<code><em>{n}<p>{k}</p></em></code>", "`{n}`\n\n`{k}`"),
        ("<code><font><a href=/x>{n}<p>{k}", "`[{n}](/x)`\n\n`[{k}](/x)`"),
        ("<table><tr><td><b>{n}<td>{k}<tr><td>c</table>z", "- **{e}** {k}\n- c\n\nz"),
        ("<a href=/{k}>\n<p>{n}</p>\n</a>z", "[{n}](/{k})\n\nz"),
        ("<h1>{n}<h2>{k}</h1>x", "# {n}\n\n## {k}\n\nx"),
        ("<ul><li>{n}<div><li>{k}</div></ul>", "- {n}\n- {k}"),
        ("<p>{n}</span></div> {k}</p>", "{n} {k}"),
        ("<b><i><s><ins><mark><em><sub><strong><del><u><tt><small>{n}<p>{k}", "***~~===={n}====~~***\n\n***~~===={k}====~~***"),
    ],
)
rules("plain_text_pages", {}, [("{n} &amp; &#65;&eacute;&hellip;&#x1F600; &nosuch; &lt;{k}&gt;", "{n} & Aé…😀 &nosuch; <{k}>"), ("a  \t {n}\n\n b \t\n\n", "a {n}\n\n b"), ("{n}\u2003", "{n}"), ("\n\n", "")])
rules("plain_text_escaped", {"escape_misc": True, "escape_asterisks": True, "escape_underscores": True}, [("[{k}] *a* {n} &#42;", "\\[{k}\\] \\*a\\* {e} \\*")])
rules("plain_text_to_plain", {"output_format": "plain", "escape_misc": True, "escape_underscores": True}, [("a[b] {n} &copy;{k}", "a[b] {n} ©{k}")])
rules("plain_text_strict", {"whitespace_mode": "strict", "strip_newlines": True}, [("a  \t{n}\nb\n", "a  \t{n} b"), ("{k}\u2003\t ", "{k}\u2003")])
rules(
    "ruby_groups",
    {},
    [
        ("<ruby>{n}<rt>{k}</rt>b<rt>c</rt></ruby>", "{n}b({k})(c)"),
        ("<ruby> <rb> {n} </rb> <rt> {k} </rt> <rb>b</rb><rt>c</rt> </ruby>", "{n}({k})b(c)"),
        ("<ruby><rb>{n}<rb>b<rt>{k}<rt>c</ruby>", "{n}b({k})(c)"),
        ("<ruby><rb>{n}<rb>b<rt>{k}<rt>c<rtc><rt>x</rtc></ruby>", "{n}b(({k})(c))(x)"),
        ("<ruby><rb>{n}<rt>{k}<rtc>x</rtc></ruby>", "{n}({k})x"),
        ("<p>a <ruby><b>{n}</b><rp>(</rp><rt>{k}<rp>)</rp></ruby> z</p>", "a **{n}**({k}) z"),
    ],
)
rules(
    "inline_elements",
    {},
    [
        ("<p><strong>{n}</strong> <b>a <b>b</b></b> <em>{k}</em> <i>c</i></p>", "**{n}** **a b** *{k}* *c*"),
        ("<p><strong><em>{n}</em></strong><strong> {k} </strong>x</p>", "***{n}*** **{k}** x"),
        ("<p><del>{n}</del> <s>{k}</s> <ins>i</ins> <mark>m</mark> <u>u</u> <small>s</small></p>", "~~{n}~~ ~~{k}~~ ==i== ==m== u s"),
        ("<p>H<sub>{k}</sub>O<sup>2</sup> <var>{n}</var> <dfn>d</dfn> <q>{k}</q></p>", "H{k}O2 *{n}* *d* \"{k}\""),
        ("<p><code>{n}</code> <kbd>{k}</kbd> <samp>s</samp> <code> </code>x</p>", "`{n}` `{k}` `s` x"),
        ("<p><code>a`{k}</code> <code>b``c</code></p>", "``a`{k}`` ```b``c```"),
        ("<p><abbr title='{n}'>{k}</abbr> <span>s</span><span class='ocrx_word'>w</span></p>", "{k} ({n}) s w"),
        ("<p><ruby>{n}<rp>(</rp><rt>{k}</rt><rp>)</rp></ruby></p>", "{n}({k})"),
        ("<p>{n}\n<b>{k}</b>   x\t y</p>", "{n} **{k}** x y"),
        ("<p>&lt;{n}&gt; &amp;amp; &#65;&eacute;&nosuch;</p>", "<{n}> &amp; Aé&nosuch;"),
        ("<p>a <math><mi>{k}</mi></math></p>", "a <!-- MathML: <math><mi>{k}</mi></math> --> {k}"),
        ("<p><em class='x caret'></em>{n}</p>", "> {n}"),
    ],
)
rules(
    "links_and_images",
    {},
    [
        ("<a href='/{k}' title='say \"{n}\"'>{n}</a>", "[{n}](/{k} \"say \\\"{n}\\\"\")"),
        ("<a href='http://h/{k}'>http://h/{k}</a> <a href='mailto:a{k}@h.org'>a{k}@h.org</a> <a href='{k}.png'>{k}.png</a>", "<http://h/{k}> <a{k}@h.org> [{k}.png]({k}.png)"),
        ("<a href=''>{n}</a> <a href='/a b'>{k}</a> <a href='/(x'>p</a> <a>none</a>", "[{n}](<>) [{k}](</a b>) [p](/\\(x) none"),
        ("<a href='/{k}'></a>", "[/{k}](/{k})"),
        ("<a href='#{k}'>^</a> <a href='/x'>{n} ] [y]</a>", "[↑](#{k}) [{n} \\] [y]](/x)"),
        ("<a href='/{k}'><h3>{n}</h3></a>", "### [{n}](/{k})"),
        ("<a href='/{k}'><b>{n}</b>\n x</a>", "[**{n}** x](/{k})"),
        ("<img src='/{k}.png' alt='{n}' title='t'> <img alt='{k}'>", "![{n}](/{k}.png \"t\") ![{k}]()"),
        ("<graphic url='/{k}.png' filename='{n}'><img src='see [x](/{k}) now' alt=a>", "![{n}](/{k}.png)![a](/{k})"),
        ("<h2>{n} <img src=x alt='{k}'></h2>", "## {n} {k}"),
    ],
)
rules(
    "lists",
    {},
    [
        ("<ul><li>{n}<li>{k}</ul>", "- {n}\n- {k}"),
        ("<ol start=7><li>{n}</li><li>{k}</li></ol>", "7. {n}\n8. {k}"),
        ("<ul><li>{n}<ul><li>{k}<ul><li>d<ul><li>e</ul></ul></ul><li>f</ul>", "- {n}\n  * {k}\n    + d\n      - e\n- f"),
        ("<ul><li><p>{n}</p><li><p>{k}</p></ul>", "- {n}\n\n- {k}"),
        ("<ul><li><p>{n}</p><p>{k}</p></ul>", "- {n}\n\n    {k}"),
        ("<ul><li><input type=checkbox checked> {n}<li><input type=checkbox> {k}</ul>", "- [x] {n}\n- [ ] {k}"),
        ("<menu><li>{n}</menu><p>{k}</p>", "- {n}\n\n{k}"),
        ("<p>{n}</p><ul><li>{k}</ul><p>z</p>", "{n}\n\n- {k}\n\nz"),
        ("<ul><li>{n}</ul><ul><li>{k}</ul>", "- {n}\n\n- {k}"),
        ("<ol><li>{n}<pre>{k}</pre></ol>", "1. {n}\n\n    ```\n    {k}\n    ```"),
        ("<blockquote><ul><li>{n}<li>{k}</ul></blockquote>", "> - {n}\n> - {k}"),
    ],
)
rules(
    "tables_compact",
    {"compact_tables": True},
    [
        ("<table><tr><th>{n}<th>{k}<tr><td>a<td>b</table>", "| {e} | {k} |\n| --- | --- |\n| a | b |"),
        ("<table><thead><tr><td>{n}</td></tr></thead><tbody><tr><td>{k}</td></tr></tbody></table>", "| {e} |\n| --- |\n| {k} |"),
        ("<table><tr><th colspan=2>{n}<tr><td>{k}<td>b</table>", "| {e} | |\n| --- | --- |\n| {k} | b |"),
        ("<table><tr><th rowspan=2>{n}<th>b<tr><td>{k}</table>", "| {e} | b |\n| --- | --- |\n|  | {k} |"),
        ("<table><tr><th>a*_|<td><p>{n}</p><p>{k}</p></table>", "| a\\*\\_\\| | {e} {k} |\n| --- | --- |"),
        ("<table><caption>{k}-x</caption><tr><th>{n}</table>", "*{k}\\-x*\n\n| {e} |\n| --- |"),
        ("<table><tr><th>{n}<td><table><tr><td>{k}<td>in</table></table>", "| {e} | {k} in |\n| --- | --- |"),
        ("<table><tr><td>{n}<td>{k}<tr><td>c</table>", "- {e} {k}\n- c"),
        ("<table border=0><tr><td colspan=3>{n}</table>", "- {e}"),
        ("<table><tr><td><a href=/1>{n}</a> <a href=/2>b</a> <a href=/3>{k}</a></table>", "- [{e}](/1) [b](/2) [{k}](/3)"),
        ("<table><tr><td> </table><p>{n}</p>", "{n}"),
        ("<table>t<tr>u<th>{n}</table>", "| {e} |\n| --- |"),
        ("<ul><li>{k}<table><tr><th>{n}</table></ul>", "- {k}\n\n    | {e} |\n    | --- |"),
        ("<blockquote><table><tr><th>{n}</table></blockquote>", "> | {e} |\n> | --- |"),
    ],
)
rules("table_padding", {}, [("<table><tr><th>ab<th>abcdefgh<tr><td>12345<td>x</table><p>{n}</p>", "| ab    | abcdefgh |\n| ----- | -------- |\n| 12345 | x        |\n\n{n}")])
rules("br_in_tables", {"br_in_tables": True, "compact_tables": True}, [("<table><tr><th>{n}<br>{k}<td><p>a</p><p>b</p></table>", "| {e}<br>{k} | a<br>b |\n| --- | --- |")])
rules(
    "djot_elements",
    {"output_format": "djot"},
    [("<p><b>{n}</b> <i>{k}</i> <del>d</del> <ins>i</ins> <mark>m</mark> <sub>s</sub> <sup>t</sup></p>", "*{n}* _{k}_ {-d-} {+i+} {=m=} ~s~ ^t^"), ("<h2>{n}</h2><a href='/{k}'>x</a>", "## {n}\n\n[x](/{k})")],
)
rules(
    "plain_elements",
    {"output_format": "plain"},
    [
        ("<h1>{n}</h1><p><b>x</b> <a href=/y>{k}</a></p>", "{n}\n\nx {k}"),
        ("<ul><li>{n}<li>{k}</ul><ol start=42><li>a<li>b</ol>", "- {n}\n- {k}\n\n42. a\n43. b"),
        ("<p>{n}<br>{k}</p><hr><p><img src=i alt='{n}'></p>", "{n}\n{k}\n\n{n}"),
        ("<table><tr><th>{n}<th>b<tr><td>{k}<td>d</table>", "{n}\tb\n{k}\td"),
        ("<pre><code>{n}\n  {k}</code></pre><svg><title>t</title></svg>", "{n}\n  {k}"),
    ],
)
rules("heading_and_code_styles", {"heading_style": "underlined", "code_block_style": "tildes", "newline_style": "backslash", "strong_em_symbol": "_"}, [("<h1>ab</h1><h2>abc</h2><h3>{n}</h3>", "ab\n==\n\nabc\n---\n\n### {n}"), ("<pre>{n}</pre><p><b>{k}</b><br>x</p>", "~~~\n{n}\n~~~\n\n__{k}__\\\nx")])
rules("closed_headings_and_indented_code", {"heading_style": "atx_closed", "code_block_style": "indented", "highlight_style": "html", "sub_symbol": "~", "sup_symbol": "<sup>", "bullets": "+"}, [("<h2>{n}</h2><pre>a\n{k}</pre>", "## {n} ##\n\n    a\n    {k}"), ("<ul><li><mark>{n}</mark><ul><li>a<sub>{k}</sub><sup>2</sup></ul></ul>", "+ <mark>{n}</mark>\n  + a~{k}~<sup>2</sup>")])
rules("escapes", {"escape_misc": True, "escape_asterisks": True, "escape_underscores": True}, [("<p>a*b_c #{k} [x] {n}</p>", "a\\*b\\_c \\#{k} \\[x\\] {e}"), ("<p>1. {n} `t`</p><code>*{k}*</code>", "1\\. {e} \\`t\\`\n\n`*{k}*`")])
rules("tag_options", {"strip_tags": ["b", "h2", "a"], "preserve_tags": ["sub", "x-y"], "exclude_selectors": [".ad", "#x", "[data-q='1']", "!!"], "max_depth": 3}, [("<h2>{n} <b>{k}</b> <a href=/x>l</a></h2>", "{n} {k} l"), ("<p>a<sub class='z'>{n}  {k}</sub></p>", "a<sub class='z'>{n}  {k}</sub>"), ("<p class='b ad'>1</p><p id=x>2</p><p data-q=1>3</p><p>{n}</p>", "{n}"), ("<div><div><div><div>{k}</div></div></div></div>{n}", "{n}")])
rules("aggressive_preprocessing", {"preprocessing": {"preset": "aggressive"}}, [("<div class='gdpr'>a</div><div id='site:nav'>b</div><div role=tablist>c</div><div aria-label='Table of Contents'>d</div><footer>e</footer><aside>f</aside><p>{n}</p>", "{n}"), ("<header class='vector-header'>a</header><noscript>b</noscript><form>c</form><nav>d</nav><div class='ad social'>{k}</div>", "{k}")])
rules("standard_preprocessing", {}, [("<nav>a</nav><form>b</form><header class='nav'>c</header><footer>{n}</footer><aside class=toc>d</aside><div class=menu>{k}</div>", "{n}\n\n{k}")])
rules("no_preprocessing", {"preprocessing": {"enabled": False}}, [("<nav>{n}</nav><form>{k}</form>", "{n}\n\n{k}")])
rules("reference_links", {"link_style": "reference"}, [("<p><a href='/{k}'>{n}</a> <a href='/b' title=t>x</a> <a href='/{k}'>y</a></p>", "[{n}][1] [x][2] [y][1]\n\n[1]: /{k}\n[2]: /b \"t\""), ("<p><a href='/{k}'>{n}</a> <img src=/i alt='{n}' title=q> <a href=/i>x</a></p><video src=/v></video><audio src='/{k}'></audio><img src=/v alt=b>", "[{n}][1] ![{n}][2] [x][3]\n\n[/v][4]\n\n[/{k}][1]\n\n![b][4]\n\n[1]: /{k}\n[2]: /i \"q\"\n[3]: /i\n[4]: /v")])
rules("percent_urls", {"url_escape_style": "percent"}, [("<a href='http://h/?q={k}'>{n}</a> <a href='/a b~c'>x</a>", "[{n}](http%3A//h/%3Fq%3D{k}) [x](/a%20b~c)"), ("<img src='/i (1) <{k}>.png' alt='{n}'>", "![{n}](/i%20%281%29%20%3C{k}%3E.png)")])
rules("wrapping", {"wrap": True, "wrap_width": 12}, [("<p>aaa bbb ccc ddd eee</p><h1>a heading of some length</h1><p>{k}</p>", "aaa bbb ccc\nddd eee\n\n# a heading of some length\n\n{k}"), ("<ul><li>aaaa bbbb cccc</ul><blockquote>aaaa bbbb cccc</blockquote><pre>a code line that is long</pre>", "- aaaa bbbb\n  cccc\n\n> aaaa bbbb\n> cccc\n\n```\na code line that is long\n```")])
rules("inline_mode", {"convert_as_inline": True}, [("<h1>{n}</h1><p><b>{k}</b></p>", "{n} **{k}**")])
rules(
    "visitors",
    {"visitor": {"link": {"action": "custom_template", "template": "<{href}|{text}>"}, "image": {"action": "skip"}, "code_block": {"action": "custom", "output": "CODE"}, "heading": {"action": "custom_template", "template": "{level}: {text}"}, "custom_element": {"action": "preserve_html"}, "figure_end": {"action": "custom_template", "template": "{output} END"}}},
    [("<h2>{n}</h2><a href='/{k}'>x <b>y</b></a><img src=i>", "2: {n}\n\n</{k}|x **y**>"), ("<pre>{n}</pre><figure>{k}</figure>", "CODE\n\n{k} END"), ("<nav>{n}</nav>", "{n}")],
)
def _template(text: str, **more) -> dict:
    return {"action": "custom_template", "template": text, **more}


def _custom(text: str, **more) -> dict:
    return {"action": "custom", "output": text, **more}


rules(
    "inline_visitors",
    {"visitor": {"strong": _template("S({text})"), "emphasis": _template("E({text})"), "strikethrough": _template("D({text})"), "underline": _template("U({text})"), "subscript": _template("b({text})"), "superscript": _template("p({text})"), "mark": _template("M({text})"), "code_inline": _template("C({text})")}},
    [("<p><b>{n}</b> <em>{k}</em> <s>a</s> <u>b</u> <sub>c</sub><sup>d</sup> <mark>e</mark> <code>f</code></p>", "S({n}) E({k}) D(a) U(b) b(c)p(d) M(e) C(f)"), ("<p><strong>x <i>{n}</i></strong></p>", "S(x E({n}))")],
)
rules(
    "block_visitors",
    {"visitor": {"list_item": _template("I({text})"), "line_break": _custom("|"), "horizontal_rule": _custom("***"), "definition_term": _template("T({text})"), "definition_description": _template("D({text})"), "summary": _template("S({text})"), "figcaption": _template("F({text})"), "input": _template("[{input_type} {name}={value}]"), "button": _template("<{text}>"), "form": _template("{action} {method}: {text}"), "audio": _template("A({src})"), "video": _template("V({src})"), "iframe": _template("W({src})")}},
    [
        ("<ul><li>{n}<li>{k}</ul>", "- I({n})\n- I({k})"),
        ("<p>{n}<br>{k}</p><hr>", "{n}|{k}\n\n***"),
        ("<dl><dt>{n}<dd>{k}</dl>", "T({n})\n\nD({k})"),
        ("<details><summary>{n}</summary>{k}</details>", "S({n})\n\n{k}"),
        ("<figure>{k}<figcaption>{n}</figcaption></figure>", "{k}\n\nF({n})"),
        ("<form action=/{k} method=post><input type=text name=q value='{n}'><button>go</button></form>", "/{k} post: [text q={n}]\n\n<go>"),
        ("<audio src=/{k}></audio><video src=v><p>{n}</p></video><iframe src=i></iframe>", "A(/{k})\n\nV(v)\n\nW(i)"),
    ],
)
rules(
    "element_end_visitor",
    {"visitor": {"element_end": _template("[{output}]", tags=["p", "b", "h2", "span"])}},
    [("<div><p>{n} <b>{k}</b></p><h2>t</h2><span>s</span></div>", "[{n} [**{k}**]]\n\n[## t]\n\n[s]"), ("<p><span>a<span>{n}</span></span><i>{k}</i>", "[[a[{n}]]*{k}*]")],
)
rules("element_start_visitor", {"visitor": {"element_start": _custom("<{tag}>", tags=["div", "i"])}}, [("<nav>{n}</nav><div>d <i>in</i></div><p>{k} <i>q</i></p>", "{n}\n\n<div>\n\n{k} <i>")])
rules("element_skipping_visitor", {"visitor": {"element_start": {"action": "skip", "tags": ["div", "x-y"]}}}, [("<div>{n}<p>a</p></div><p>{k}<x-y>b</x-y></p>", "{k}")])
rules("table_row_visitor", {"visitor": {"table_row": _template("{cell_2}/{cell_1} {is_header}: {cells}")}}, [("<table><tr><th>a<th>{k}<tr><td>{n}<td>d</table>z", "{k}/a true: a | {k}\nd/{e} false: {e} | d\n\nz")])
rules("table_end_visitor", {"compact_tables": True, "visitor": {"table_end": _template("BEGIN\n{output}\nEND")}}, [("<table><tr><th>{n}<tr><td>{k}</table>z", "BEGIN\n| {e} |\n| --- |\n| {k} |\nEND\n\nz")])
rules("table_start_visitor", {"visitor": {"table_start": _custom("TABLE")}}, [("<table><tr><th>{n}</table>{k}", "TABLE\n\n{k}")])
rules("pictures", {}, [("<picture><source srcset='{k}.webp'><img src='{k}.png' alt='{n}'></picture>", "![{n}]({k}.png)"), ("<h3>{n} <picture><img src=x alt='{k}'></picture></h3>", "### {n} {k}")])
rules("images_skipped", {"skip_images": True}, [("<p>{n} <img src=x alt=y> <svg><title>t</title></svg>{k}</p>", "{n} {k}")])


def _visit_errors(spark, d: str) -> DataFrame:
    """Visitors that answer with an error, by their order, but not for what isn't shown."""
    cases = [("<p>{n}</p>",), ("<p>{n}<img src=x></p>",), ("<h2>{k}</h2><img src=x>",), ("<nav hidden><img src=x></nav>{n}",)]
    visitor = {"heading": {"action": "error", "message": "no headings"}, "image": {"action": "error", "message": "no images"}}
    return convert(_pages(spark, d, cases), Options(extract_metadata=False, visitor=visitor)).select("doc_id", "content", "error.kind", "error.message")


QUERIES["visit_errors"] = _visit_errors
ORACLE_SQL["visit_errors"] = """SELECT CAST(n_nationkey * 1000 + c.k AS BIGINT) AS doc_id, c.content, c.kind, c.message FROM nation, LATERAL (VALUES (0, n_name || chr(10), NULL, NULL), (1, NULL, 'Visitor', 'no images'),
    (2, NULL, 'Visitor', 'no headings'), (3, n_name || chr(10), NULL, NULL)) c(k, content, kind, message)"""

rules("custom_element_visitor", {"visitor": {"custom_element": {"action": "preserve_html"}}}, [("<p>a</p><x-custom id='{k}'>in <b>{n}</b></x-custom><p>b <y-z/>c</p>", "a\n\n<x-custom id='{k}'>in <b>{n}</b></x-custom>\n\nb <y-z />c")])
rules("text_visitor", {"visitor": {"text": {"action": "custom_template", "template": "<{text}>"}}}, [("<p>{n}</p>", "<{n}>")])

extracted(
    "image_rows",
    ["<img src='/{k}.png' alt='{n}' width=3 height=4><img src='data:image/png;base64,AAEC' width=x><img alt=none><img src='http://h/i'>"],
    extract.images,
    ["doc_id", "src", "alt", "width", "height", "image_type"],
    """SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, c.* FROM nation, LATERAL (VALUES ('/' || n_nationkey || '.png', n_name, 3, 4, 'relative'),
       ('data:image/png;base64,AAEC', NULL, NULL, NULL, 'data_uri'), ('http://h/i', NULL, NULL, NULL, 'external')) c(src, alt, width, height, image_type)""",
)
extracted(
    "inline_image_bytes",
    ["<img src='data:image/jpg;base64,QUJD' alt='{n}'><img src='data:image/png,{k}'><img src='data:image/png;base64,'><img src='data:text/x;base64,QQ=='>"],
    extract.inline_images,
    ["doc_id", "format", "hex(data) AS data", "description", "skipped"],
    """SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, c.* FROM nation, LATERAL (VALUES ('jpeg', '414243', n_name, NULL), (NULL, NULL, NULL, 'not base64'),
       (NULL, NULL, NULL, 'empty'), (NULL, NULL, NULL, 'no image')) c(format, data, description, skipped)""",
)
extracted(
    "json_ld_rows",
    ["""<script type="application/ld+json">{"@type": "{n}"}</script><script type="application/ld+json">{"@graph": [{"@type": ["B", "C"]}]}</script><script type="application/ld+json"> </script><script>{k}</script>"""],
    extract.json_ld,
    ["doc_id", "raw_json", "schema_type"],
    """SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, c.* FROM nation, LATERAL (VALUES ('{"@type": "' || n_name || '"}', n_name), ('{"@graph": [{"@type": ["B", "C"]}]}', 'B')) c(raw_json, schema_type)""",
)
extracted(
    "section_rows",
    ["<h1>{n}</h1><h3>a</h3><h2>b</h2><h3>c</h3><h1>{k}</h1>"],
    lambda docs: extract.sections(docs).alias("s").join(extract.headers(docs).selectExpr("doc_id AS d", "node_id AS p", "text AS parent"), F.expr("doc_id = d AND parent_id = p"), "left"),
    ["doc_id", "level", "text", "parent"],
    """SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, c.* FROM nation, LATERAL (VALUES (1, n_name, NULL), (3, 'a', n_name), (2, 'b', n_name), (3, 'c', 'b'), (1, CAST(n_nationkey AS VARCHAR), NULL)) c(level, text, parent)""",
)
extracted(
    "metadata_routing",
    ["<html lang=de dir=RTL><head><title>{n} &amp; x</title><meta name=description content=first><meta name=description content='{k}'><meta name=keywords content='a, ,b'><meta name=publisher content=P><meta name=creator content=C><meta property='og:title' content=O><meta name='twitter:card' content=T><meta name=x content=y><link rel='x canonical' href='/c'><base href='/b'></head>"],
    extract.document_metadata,
    ["doc_id", "title", "description", "array_join(keywords, '|') AS keywords", "author", "canonical_url", "base_href", "language", "text_direction", "open_graph['title'] AS og", "twitter_card['card'] AS tw", "meta_tags['x'] AS x"],
    """SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, n_name || ' & x' AS title, CAST(n_nationkey AS VARCHAR) AS description, 'a|b' AS keywords, 'C' AS author, '/c' AS canonical_url, '/b' AS base_href,
       'de' AS language, 'rtl' AS text_direction, 'O' AS og, 'T' AS tw, 'y' AS x FROM nation""",
)
extracted(
    "link_rows",
    ["<a href='/{k}' rel='a  b' title=t>{n} <b>x</b></a><a href='http://h/'>http://h/</a><a href='#a'><h2>h</h2></a><a href='tel:{k}'>call</a><a>none</a>"],
    extract.links,
    ["doc_id", "href", "text", "title", "link_type", "array_join(rel, '|') AS rel"],
    """SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, c.* FROM nation, LATERAL (VALUES ('/' || n_nationkey, n_name || ' x', 't', 'internal', 'a|b'), ('tel:' || n_nationkey, 'call', NULL, 'phone', '')) c(href, text, title, link_type, rel)""",
)
extracted(
    "structure_rows",
    ["<p>b</p><h1>{n}</h1><p>x</p><ul><li>i<ol><li>{k}</ol></ul><pre class=language-py>c</pre><img src=s><table><tr><td><p>t</table>"],
    structure.document_tree,
    ["doc_id", "node_type", "text", "level", "ordered", "language", "src", "parent IS NULL AS is_root"],
    """SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, c.* FROM nation, LATERAL (VALUES ('paragraph', 'b', NULL, NULL, NULL, NULL, true), ('group', n_name, 1, NULL, NULL, NULL, true), ('heading', n_name, 1, NULL, NULL, NULL, false),
       ('paragraph', 'x', NULL, NULL, NULL, NULL, false), ('list', NULL, NULL, false, NULL, NULL, false), ('list_item', 'i', NULL, NULL, NULL, NULL, false), ('list', NULL, NULL, true, NULL, NULL, false),
       ('list_item', CAST(n_nationkey AS VARCHAR), NULL, NULL, NULL, NULL, false), ('code', 'c', NULL, NULL, 'py', NULL, false), ('image', NULL, NULL, NULL, NULL, 's', false), ('table', NULL, NULL, NULL, NULL, NULL, false)) c(node_type, text, level, ordered, language, src, is_root)""",
)
extracted(
    "inline_annotations",
    ["<h2> {n} <b>é{k}</b></h2><p>a <em>{n} <code>{k}</code></em> <a href='/{k}' title=t>ü<s>x</s></a><i> </i></p><ul><li><mark>m</mark>{k}<script>s</script></ul><td><p><b>no</b></p>"],
    structure.annotations,
    ["doc_id", "node_type", "start", "`end`", "kind", "url", "title", "text"],
    # Each span's text is cut from its block's by the offsets.
    """WITH b AS (SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, CAST(n_nationkey AS VARCHAR) AS k, n_name AS n, octet_length(encode(n_name)) AS s, octet_length(encode(CAST(n_nationkey AS VARCHAR))) AS t FROM nation),
       spans AS (SELECT b.doc_id, c.node_type, c.a AS a, c.z AS z, c.kind, c.url, c.title, c.block FROM b, LATERAL (VALUES
           ('heading', s + 1, s + 3 + t, 'bold', NULL, NULL, n || ' é' || k),
           ('paragraph', 2, s + 3 + t, 'italic', NULL, NULL, 'a ' || n || ' ' || k || ' üx '),
           ('paragraph', s + 3, s + 3 + t, 'code', NULL, NULL, 'a ' || n || ' ' || k || ' üx '),
           ('paragraph', s + 4 + t, s + 7 + t, 'link', '/' || k, 't', 'a ' || n || ' ' || k || ' üx '),
           ('paragraph', s + 6 + t, s + 7 + t, 'strikethrough', NULL, NULL, 'a ' || n || ' ' || k || ' üx '),
           ('list_item', 0, 1, 'highlight', NULL, NULL, 'm' || k)) c(node_type, a, z, kind, url, title, block))
       SELECT doc_id, node_type, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS "end", kind, url, title, decode(encode(block)[a + 1:z]) AS text FROM spans""",
)
extracted(
    "definition_rows",
    ["<dl><dt>{n}</dt><dd>a</dd><dd>{k}</dd><div><dt>c<dd>d</div></dl><dl><dd>lone</dl>"],
    structure.definitions,
    ["doc_id", "term", "definition"],
    """SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, c.* FROM nation, LATERAL (VALUES (n_name, 'a'), (n_name, CAST(n_nationkey AS VARCHAR)), ('c', 'd'), (NULL, 'lone')) c(term, definition)""",
)
extracted(
    "sibling_tags",
    ["<p>{n} <b>1</b> <i>2</i><!-- c -->\n<br>{k}<u>3</u></p><script>x</script> <em>e</em>"],
    extract.siblings,
    ["doc_id", "tag", "next_tag", "previous_inline", "next_inline", "blank_behind"],
    """SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, c.* FROM nation, LATERAL (VALUES ('p', 'script', false, true, false), ('b', 'i', false, true, true), ('i', 'br', true, true, true),
       ('br', NULL, true, false, false), ('u', NULL, false, false, false), ('script', 'em', false, true, true), ('em', NULL, true, false, false)) c(tag, next_tag, previous_inline, next_inline, blank_behind)""",
)


def _svg_source(spark, d: str) -> DataFrame:
    """The source of each SVG, taken back out of its Markdown."""
    page = "<p><svg width='{k}' viewbox='0 0 1 1' class=''><title>{n} &amp; &lt;</title><lineargradient gradienttransform='r(\"a&amp;\")'/><g><!-- c --><circle r=1></circle></g></svg></p>"
    found = convert(_pages(spark, d, [(page,)]), Options(extract_metadata=False))
    data = F.unbase64(F.regexp_extract("content", r"base64,([^)]*)\)", 1))
    return found.select("doc_id", F.regexp_extract("content", r"!\[([^\]]*)\]", 1).alias("title"), F.decode(data, "UTF-8").alias("source"))


QUERIES["svg_source"] = _svg_source
ORACLE_SQL["svg_source"] = """SELECT CAST(n_nationkey * 1000 AS BIGINT) AS doc_id, n_name || ' & <' AS title, '<svg class viewBox="0 0 1 1" width="' || n_nationkey || '"><title>' || n_name ||
    ' &amp; &lt;</title><lineargradient gradientTransform="r(&quot;a&amp;&quot;)" /><g><circle r="1" /></g></svg>' AS source FROM nation"""


def _whole_result(spark, d: str) -> DataFrame:
    """Whole results as JSON lines: content, tables with their cells, structure, metadata, images and warnings."""
    page = "<title>{n}</title><h1 id=t>{n} <b>{k}</b></h1><p>a <i>{n}</i></p><table><tr><th>h<td>{k}</table><img src='data:image/png;base64,QUJD' alt='{n}'><img src='data:image/png,x'><a href='/{k}'>x</a><div><div><div><p>deep</p></div></div></div>"
    options = Options(include_document_structure=True, extract_images=True, max_depth=4)
    found = convert_result(_pages(spark, d, [(page,)]), options)
    nodes = F.transform("document.nodes", lambda x: F.struct(x["node_type"], x["text"], x["level"], x["grid"]["rows"].alias("rows"), x["grid"]["cols"].alias("cols"), F.size(x["grid"]["cells"]).alias("cells")))
    document = F.struct(nodes.alias("nodes"), F.col("document.source_format").alias("source_format"))
    metadata = F.struct("metadata.document.title", F.transform("metadata.headers", lambda h: F.struct(h["level"], h["text"], h["id"])).alias("headers"), F.transform("metadata.links", lambda x: F.struct(x["href"], x["text"], x["link_type"])).alias("links"))
    return json_lines(found.withColumn("document", document).withColumn("metadata", metadata).withColumn("images", F.transform("images", lambda x: x.dropFields("node_id", "skipped").withField("data", F.hex(x["data"])))))


QUERIES["whole_result"] = _whole_result
ORACLE_SQL["whole_result"] = r"""WITH t AS (SELECT CAST(n_nationkey * 1000 AS BIGINT) AS id, n_name AS n, CAST(n_nationkey AS VARCHAR) AS k, greatest(length(n_nationkey::VARCHAR), 3) AS w FROM nation),
    m AS (SELECT *, '| h   | ' || rpad(k, CAST(w AS INTEGER), ' ') || ' |\n| --- | ' || repeat('-', w) || ' |' AS md FROM t)
    SELECT '{"doc_id":' || id || ',"content":"---\ntitle: ' || n || '\n---\n\n# ' || n || ' **' || k || '**\n\na *' || n || '*\n\n' || md ||
        '\n\n![' || n || '](data:image/png;base64,QUJD)![](data:image/png,x)[x](/' || k || ')\n","document":{"nodes":[{"node_type":"group","text":"' || n || ' **' || k || '**","level":1,"rows":null,"cols":null,"cells":null},'
        || '{"node_type":"heading","text":"' || n || ' **' || k || '**","level":1,"rows":null,"cols":null,"cells":null},{"node_type":"paragraph","text":"a *' || n || '*","level":null,"rows":null,"cols":null,"cells":null},'
        || '{"node_type":"table","text":null,"level":null,"rows":1,"cols":2,"cells":2},{"node_type":"image","text":null,"level":null,"rows":null,"cols":null,"cells":null},{"node_type":"image","text":null,"level":null,"rows":null,"cols":null,"cells":null}],"source_format":"html"},"metadata":{"title":"' || n || '","headers":[{"level":1,"text":"' || n || ' ' || k || '","id":"t"}],"links":[{"href":"/' || k || '","text":"x","link_type":"internal"}]},'
        || '"tables":[{"grid":{"rows":1,"cols":2,"cells":[{"content":"h","row":0,"col":0,"row_span":1,"col_span":1,"is_header":true},{"content":"' || k || '","row":0,"col":1,"row_span":1,"col_span":1,"is_header":false}]},"markdown":"' || md || '"}],'
        || '"images":[{"format":"png","data":"414243","description":"' || n || '"}],"warnings":[{"kind":"depth_limit_exceeded","message":"elements deeper than 4 were left out"},{"kind":"image_extraction_failed","message":"not base64"}],"error":null}' AS value FROM m"""


def _order_pages(spark, d: str) -> DataFrame:
    """A page for each customer, a table and a list of their orders on it."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    wide = F.col("o_orderkey") % 5 == 0
    row = F.concat(F.lit("<tr><td>"), "o_orderkey", F.when(wide, F.lit("<td colspan=2>")).otherwise(F.lit("<td>")), "o_orderstatus", F.when(wide, F.lit("")).otherwise(F.concat(F.lit("<td><b>"), cents, F.lit("</b>"))))
    item = F.concat(F.lit("<li>"), "o_orderpriority", F.lit("<ul><li>"), "o_orderkey", F.lit("</ul>"))
    each = table(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", row.alias("row"), item.alias("item")).alias("o"))
    of = each.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o")).alias("o"))
    html = F.concat(
        F.lit("<h2>"), F.col("o_custkey").cast("string"), F.lit("</h2><p>"), F.size("o").cast("string"), F.lit(" orders</p><table><tr><th>order<th>status<th>cents"),
        F.array_join(F.transform("o", lambda x: x["row"]), ""), F.lit("</table><ol start=3>"), F.array_join(F.transform("o", lambda x: x["item"]), ""), F.lit("</ol>"),
    )
    return of.select(F.col("o_custkey").alias("doc_id"), html.alias("html"))


def _order_markdown(spark, d: str) -> DataFrame:
    return convert(_order_pages(spark, d), Options(extract_metadata=False)).select("doc_id", "content")


QUERIES["order_tables"] = _order_markdown
ORACLE_SQL["order_tables"] = r"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS a, o_orderstatus AS b, '**' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || '**' AS c, o_orderkey % 5 = 0 AS wide, o_orderpriority AS p FROM orders),
    w AS (SELECT doc_id, greatest(5, max(length(a))) AS wa, greatest(6, max(CASE WHEN wide THEN 0 ELSE length(b) END)) AS wb, greatest(5, max(CASE WHEN wide THEN 0 ELSE length(c) END)) AS wc FROM o GROUP BY doc_id),
    r AS (SELECT o.doc_id, k, '| ' || rpad(a, CAST(wa AS INTEGER), ' ') || ' | ' || rpad(b, CAST(wb AS INTEGER), ' ') || ' |' || CASE WHEN wide THEN ' |' ELSE ' ' || rpad(c, CAST(wc AS INTEGER), ' ') || ' |' END AS line,
        CAST(2 + row_number() OVER (PARTITION BY o.doc_id ORDER BY k) AS VARCHAR) || '. ' || p || chr(10) || '  - ' || a AS item, wa, wb, wc FROM o JOIN w USING (doc_id))
    SELECT doc_id, '## ' || doc_id || E'

' || count(*) || E' orders

| ' || rpad('order', CAST(max(wa) AS INTEGER), ' ') || ' | ' || rpad('status', CAST(max(wb) AS INTEGER), ' ') || ' | ' || rpad('cents', CAST(max(wc) AS INTEGER), ' ') || E' |
| '
        || repeat('-', CAST(max(wa) AS INTEGER)) || ' | ' || repeat('-', CAST(max(wb) AS INTEGER)) || ' | ' || repeat('-', CAST(max(wc) AS INTEGER)) || E' |
' || string_agg(line, E'
' ORDER BY k) || E'

' || string_agg(item, E'
' ORDER BY k) || E'
' AS content FROM r GROUP BY doc_id"""


def _order_grids(spark, d: str) -> DataFrame:
    """Every cell of the customers' tables, from the whole result."""
    found = convert_result(_order_pages(spark, d), Options(extract_metadata=False, include_document_structure=True))
    return found.select("doc_id", F.explode("tables").alias("t")).select("doc_id", F.col("t.grid.rows").alias("n_rows"), F.col("t.grid.cols").alias("n_cols"), F.inline("t.grid.cells"))


QUERIES["order_grids"] = _order_grids
ORACLE_SQL["order_grids"] = """WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) + 1 AS n, o_orderkey % 5 = 0 AS wide,
        CAST(o_orderkey AS VARCHAR) AS a, o_orderstatus AS b, '**' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || '**' AS c FROM orders),
    cells AS (SELECT doc_id, n, r, 0 AS col, a AS content, 1 AS span, false AS head FROM o UNION ALL SELECT doc_id, n, r, 1, b, CASE WHEN wide THEN 2 ELSE 1 END, false FROM o UNION ALL SELECT doc_id, n, r, 2, c, 1, false FROM o WHERE NOT wide
        UNION ALL SELECT doc_id, n, 0, c.col, c.content, 1, true FROM o, (VALUES (0, 'order'), (1, 'status'), (2, 'cents')) c(col, content) WHERE r = 1)
    SELECT doc_id, CAST(n AS INTEGER) AS n_rows, CAST(3 AS INTEGER) AS n_cols, content, CAST(r AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(1 AS INTEGER) AS row_span, CAST(span AS INTEGER) AS col_span, head AS is_header FROM cells"""


def _json_ld_budget(spark, d: str) -> DataFrame:
    """Blocks within the documents' budget of 30 bytes: one too large goes, smaller ones behind it still fit."""
    page = '<script type="application/ld+json">{"a":"{n}"}</script><script type=" APPLICATION/LD+JSON ">{"bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb":1}</script><script type="application/ld+json">{"c":{k}}</script><script type="application/ld+json">{"d":"{n}"}</script>'
    return extract.json_ld(parse_documents(_pages(spark, d, [(page,)])), most_bytes=30).select("doc_id", "raw_json")


QUERIES["json_ld_budget"] = _json_ld_budget
ORACLE_SQL["json_ld_budget"] = """WITH b AS (SELECT n_nationkey * 1000 AS id, 1 AS k, '{"a":"' || n_name || '"}' AS j FROM nation UNION ALL SELECT n_nationkey * 1000, 3, '{"c":' || n_nationkey || '}' FROM nation
        UNION ALL SELECT n_nationkey * 1000, 4, '{"d":"' || n_name || '"}' FROM nation), s AS (SELECT *, sum(length(j)) OVER (PARTITION BY id ORDER BY k) AS used FROM b)
    SELECT CAST(id AS BIGINT) AS doc_id, j AS raw_json FROM s WHERE used <= 30"""


def _structure_ids(spark, d: str) -> DataFrame:
    """Ids of the structure's nodes: each once, and the same in a second run."""
    docs = parse_documents(_order_pages(spark, d))
    first, again = (structure.document_tree(docs).select("doc_id", "position", "node_type", "id") for _ in range(2))
    both = first.alias("a").join(again.alias("b"), ["doc_id", "position", "node_type"])
    return both.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.countDistinct("a.id").alias("n_ids"), F.sum((F.col("a.id") == F.col("b.id")).cast("long")).alias("n_same"))


QUERIES["structure_ids"] = _structure_ids
ORACLE_SQL["structure_ids"] = """SELECT o_custkey AS doc_id, 5 + 3 * count(*) AS n_nodes, 5 + 3 * count(*) AS n_ids, CAST(5 + 3 * count(*) AS BIGINT) AS n_same FROM orders GROUP BY o_custkey"""
