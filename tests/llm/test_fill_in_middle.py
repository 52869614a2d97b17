import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.llm import fill_in_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@given(st.text(alphabet="ab \t\n\x0b\x1c é😀", max_size=40))
@settings(max_examples=300, deadline=None)
def test_unit_ends(text):
    ends = M.unit_ends(M._points(text)).tolist()
    assert [text[a:b] for a, b in zip(ends, ends[1:])] == UNIT.findall(text)


def expected(doc_id, text, rate=50):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_against_plain_python(spark):
    texts = ["", None, " ", "word", "  lead and tail  ", "a <P> b", "x<M>", "<S", "<P <S <M a> b>", "é😀 zwei drei\n\n\tvier", "w " * 30000, "same", "same"]
    ids = [None, 0, -5, *range(1, 400)]
    rows = [(i, texts[k % len(texts)], "n", "kept") for k, i in enumerate(ids)] + [(7, "same id again", "n", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, own string").repartition(3)
    made = M.transform(docs, rate=90).withColumn("back", M.restored(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "text", "own", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    found = made.collect()
    assert len(found) == len(rows) and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text, 90)
        assert r.back == (r.text or "") and r.own == "kept"
    for r in M.digests(docs).collect():
        assert r.restored_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _, _ in rows}


def test_empty_table_and_sentinels(spark, docs):
    assert M.transform(docs([])).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("ab", "ba", "c"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            M.transform(docs(["x"]), sentinels=bad)
    made = M.transform(docs(["one two three %d" % k for k in range(50)]), sentinels=("(p)", "{s}", "[m]"), rate=100)
    back = made.select("text", M.restored(F.col("output"), F.col("form"), ("(p)", "{s}", "[m]")).alias("back"), "form").collect()
    assert all(r.text == r.back and r.form != "plain" for r in back)
