"""Markup that isn't well formed, and pages that hold very much of one thing."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.operators import extract, nodes, render, structure
from pagequarry.operators.nodes import parse
from pagequarry.plans.convert import convert, parsed
from pagequarry.plans.options import Options

TOKENS = "<p> </p> <b> </b> <i> </i> <em> </em> <s> </s> <code> </code> <a!href=x> </a> <div> </div> <table> <td> </td> </table> <ul> <li> </ul> <del> </del> <mark> <sub> </sub> <pre> </pre> <br> <h2> x y z !".split()


def made(seed, n=40):
    rng = random.Random(seed)
    return "".join(rng.choice(TOKENS).replace("!", " ") for _ in range(n))


def shape(html):
    """The tree that a page becomes, as markup."""
    t = parse(html)
    kids = {}
    for k, parent in enumerate(t.parent):
        kids.setdefault(parent, []).append(k)

    def of(k):
        return t.text[k] if t.kind[k] == "text" else f"<{t.tag[k]}>{''.join(map(of, kids.get(k, [])))}</{t.tag[k]}>"

    return "".join(map(of, kids.get(None, [])))


@pytest.mark.parametrize(
    ("html", "tree"),
    [
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2<i>3<s>4</b>5</p>6", "<b>1</b><p><b>2<i>3<s>4</s></i></b><i><s>5</s></i></p><i><s>6</s></i>"),
        ("<a>1<p>2</a>3</p>", "<a>1</a><p><a>2</a>3</p>"),
        ("<a>1<a>2", "<a>1</a><a>2</a>"),
        ("<table><td><b>x<td>y</table>z", "<table><tr><td><b>x</b></td><td>y</td></tr></table>z"),
        ("<b><table><td></b>x</table>y", "<b><table><tr><td>x</td></tr></table>y</b>"),
        ("<p><b><b><b><b>x</p>y", "<p><b><b><b><b>x</b></b></b></b></p><b><b><b>y</b></b></b>"),
        ("<div><i>1</div>2", "<div><i>1</i></div><i>2</i>"),
        ("<span><div></span>x</div>y", "<span><div>x</div>y</span>"),
        ("<li>a<li>b<ul><li>c</ul>d", "<li>a</li><li>b<ul><li>c</li></ul>d</li>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<h1>a<h3>b</h2>c", "<h1>a</h1><h3>b</h3>c"),
        ("<button>a<button>b", "<button>a</button><button>b</button>"),
        ("<b>1<div>2<p>3</b>4", "<b>1</b><div><b>2</b><p><b>3</b>4</p></div>"),
        ("x</p></b></table>y", "xy"),
    ],
)
def test_read_as_browsers_do(html, tree):
    assert shape(html) == tree


@given(st.lists(st.sampled_from(TOKENS), max_size=60))
@settings(max_examples=400, deadline=None)
def test_every_text_stays_once(tokens):
    html = "".join(t.replace("!", " ") for t in tokens)
    t = parse(html)
    assert sorted("".join(x for x in t.text if x)) == sorted(re.sub("<[^>]*>", "", html))
    codes = [c for run in t.codes for c in run]
    assert len(set(codes)) == len(codes)
    for run, around, left in zip(t.codes, t.arounds, t.lefts):
        # What is open at a run's end is what was open at its start, less what it closes, with what it opens.
        now = list(around)
        for c in run:
            if c % 2 and c // 2 in now:
                now.remove(c // 2)
            elif c % 2 == 0 and t.tag[c // 2] in nodes.MARKED and t.tag[c // 2] not in {t.tag[k] for k in now} and 2 * (c // 2) + 1 not in run[run.index(c) :]:
                now.append(c // 2)
        assert set(left) == set(now) or not run


def test_marks_are_balanced(spark):
    pages = [made(k, 12 + k % 60) for k in range(400)]
    options = Options(extract_metadata=False)
    found = parsed(spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string"), options)
    for name, step in render.steps(options)[:3]:
        found = found.withColumn(name, step)
    closing = {render.CLOSE[n]: render.OPEN[n] for n in render.OPEN}
    seen = 0
    for r in found.select("doc_id", F.transform("lines", lambda x: x["content"]).alias("c")).collect():
        for content in r.c:
            stack = []
            for ch in content:
                if ch in closing:
                    assert stack and stack.pop() == closing[ch], (pages[r.doc_id], content)
                elif ch in closing.values():
                    stack.append(ch)
                    seen += 1
            assert not stack, (pages[r.doc_id], content)
    assert seen > 500
    contents = [r.content for r in convert(spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string"), options).collect()]
    assert not any(ord(c) in range(0xE000, 0xE100) for text in contents for c in text)
    assert all(text.count("~~") % 2 == 0 for text in contents)


def test_time_follows_size(spark):
    """Thousands of removed elements, hidden paragraphs, headings, metas or lists take time in proportion."""

    def seconds(part, n):
        page = spark.createDataFrame([(1, part * n)], "doc_id long, html string")
        start = time.time()
        convert(page).collect()
        return time.time() - start

    for part in ("<script>1</script><p>a</p>", "<p hidden>b</p><p>a</p>", "<ul><li><p>a</p></ul>", "<table><tr><td>a</table>", "<meta name=a content=b><h2>x</h2>"):
        seconds(part, 10)
        small, large = seconds(part, 1000), seconds(part, 8000)
        assert large < 8 * small + 4, part

    def rows(part, n, of):
        page = spark.createDataFrame([(1, part * n)], "doc_id long, html string")
        start = time.time()
        assert of(nodes.parse_documents(page)).count() >= n
        return time.time() - start

    for of in (structure.document_tree, extract.sections):
        rows("<h1>a</h1><h2>b</h2>", 10, of)
        assert rows("<h1>a</h1><h2>b</h2>", 8000, of) < 8 * rows("<h1>a</h1><h2>b</h2>", 1000, of) + 4


def test_array_helpers(spark):
    rng = random.Random(5)
    rows = [(k, [rng.randint(1, 6) for _ in range(rng.randint(0, 70))]) for k in range(60)]
    table = spark.createDataFrame(rows, "k int, x array<int>")
    places = F.array_sort(F.array_distinct(F.transform("x", lambda v, i: (v * 3 + i) % 100)))
    found = table.select(
        "k", nodes.scan(F.col("x"), F.greatest).alias("top"), nodes.scan(F.col("x"), lambda a, b: a + b).alias("sum"), extract.above(F.col("x")).alias("up"), places.alias("places"),
        nodes.marked_places(places, F.lit(200)).alias("marked"), nodes.spread_out(places, F.transform(places, lambda p, i: i), F.lit(200), F.lit(-1)).alias("spread"),
    ).collect()
    for r in found:
        x = rows[r.k][1]
        assert r.top == [max(x[: i + 1]) for i in range(len(x))] and r.sum == [sum(x[: i + 1]) for i in range(len(x))]
        assert r.up == [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), None) for i in range(len(x))]
        assert r.marked == [p in r.places for p in range(200)]
        assert r.spread == [sum(q <= p for q in r.places) - 1 for p in range(200)]


def test_nested_lists_stay_small(spark):
    """Paths name each tag once, however deep elements nest."""
    t = parse("<ul><li><kbd>" * 2000 + "x")
    assert max(map(len, t.path)) < 40 and t.lists[-1] == 2000
