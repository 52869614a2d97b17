"""Pages that differ in their texts alone share one tree."""

import random

from pagequarry.operators import nodes

TOKENS = (
    "<p>|</p>|<b>|</b>|<i>|<a href=x>|</a>|<table>|<tr>|<td>|</table>|<ul>|<li>|</ul>|<ruby>|<rt>|<rb>|</ruby>|<br/>|<svg/>|</br>|<div class='a'>|<h1>|</h2>|<button>|<x-y/>"
    "|<title>|<script>|<!-- c -->|<a b='>'>|<a b=\">| x |y|&nbsp;|&#1;| |\n|&amp;|< |>|<>|</ p>|<P>|<img src=a>"
).split("|")


def counted(monkeypatch):
    calls, real = [], nodes._built
    monkeypatch.setattr(nodes, "_built", lambda html, keep: calls.append(html) or real(html, keep))
    return calls


def test_a_make_is_read_once(monkeypatch):
    calls, makes = counted(monkeypatch), nodes.Makes()
    found = [makes.parse(f"<table><tr><td>{k}<td><b>{k * k} &amp;</b></table>") for k in range(1, 50)]
    assert len(calls) == 1
    assert [t for t in found[6][1] if t] == ["7", "49 &"]
    makes.parse("<table><tr><td> <td><b>1</b></table>")  # blank text has no siblings
    makes.parse("<table><tr><td><td><b>1</b></table>")
    assert len(calls) == 3


def test_shared_trees_equal_those_read_anew():
    rnd, makes = random.Random(3), nodes.Makes()
    pages = ["".join(rnd.choice(TOKENS) for _ in range(rnd.randint(0, 6))) for _ in range(20_000)]
    shared = nodes._arrays([makes.parse(p) for p in pages])
    anew = nodes._arrays([nodes._with_texts(nodes.parse(p)) for p in pages])
    assert len(makes.known) < len(pages) and all(a.equals(b) for a, b in zip(shared, anew))


def test_makes_met_long_ago_go(monkeypatch):
    monkeypatch.setattr(nodes, "MOST_KEPT", 1000)
    calls, makes = counted(monkeypatch), nodes.Makes()
    for k in range(100):
        makes.parse(f"<p>often</p><i class=c{k % 2}>x</i>")
        makes.parse(f"<p>once</p><b id=c{k}>x</b>")
    assert len(calls) == 102 and makes.kept <= 1000 and len(makes.known) < 20
