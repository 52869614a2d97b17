"""Rows that the SQL twins leave out."""

import re

from pagequarry import queries as Q


def dedented(text):
    """By brute force, over the text as the query indents it."""
    lines = ("  " + text.replace("\n", "\n  ")).split("\n")
    cut = min((len(x) - len(re.sub(r"^\s+", "", x)) for x in lines if x.strip()), default=0)
    return "\n".join(x[cut:] for x in lines)


def test_dedent_of_every_document(spark, tmp_path):
    texts = ["a\nb", "  a\n    b\n  c", "a\n\nb", "\n  a", "    deep\n\t\n  less", "\tx\n\ty", " ", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.text for r in Q.QUERIES["dedent"](spark, str(tmp_path)).collect()}
    assert found == {k: None if t is None else dedented(t) for k, t in enumerate(texts)}
    assert found[1] == "a\n  b\nc" and found[4] == "  deep\n\nless"


def test_validation_of_every_page(spark, tmp_path):
    pages = ["<p>x</p>", None, "%PDF-1.4 x"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r.reason for r in Q.QUERIES["input_validation"](spark, str(tmp_path)).where("start_no = 0").collect()}
    assert found == {0: None, 1: None, 2: "binary"}
