"""Rows with columns that are named like those that operators and stages work with."""

import corpus_pipeline
from pagequarry.llm import fill_in_middle, simhash_gray, suffix_dedup, url_filter

NAMES = "_id _key _null _keys _k _v h fp rep row own null kept text_key component component_id node src dst block packed key rule d g rows_to_keep rows_that_go first_id n_bytes short label score odd".split()


def clashing(spark, texts):
    rows = [(k, t, len(t or ""), *(f"{n}{k}" for n in NAMES)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, n_chars int, {', '.join(f'`{n}` string' for n in NAMES)}")


TEXTS = ["a b c d e f g h i j", "a b c d e f g h i j", None, "", "quite another text with words of its own " * 3, "and a text that repeats quite another text with words of its own quite another text with words of its own"]


def test_operators(spark):
    docs = clashing(spark, TEXTS)
    kept = simhash_gray.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5]
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[2].text is None and rows[3].text == "" and all(r[n] == f"{n}{k}" for k, r in rows.items() for n in NAMES)
    made = fill_in_middle.transform(docs)
    assert [c for c in made.columns if c in NAMES] == NAMES
    pages = docs.withColumnRenamed("text", "url")
    rules = [("net", "/", "block")]
    out = url_filter._judge_by_join(pages.selectExpr("*", "'a.net' AS host", "'/x' AS path"), rules, url_filter.F.array(url_filter.F.struct(url_filter.F.lit("net/").alias("key"))), "allow")
    assert {(r.rule, r.verdict, r._key[:4]) for r in out.collect()} == {("net/", "block", "_key")}


def test_stages(spark, tmp_path):
    docs = clashing(spark, TEXTS + [f"text number {k} has some plain words to score and to keep" for k in range(30)])
    spark.createDataFrame([(k, k % 2) for k in range(36)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one item of the benchmark that no text holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in after.collect() for n in NAMES)
    _, last = corpus_pipeline.STAGES[4]
    assert last(spark, docs, str(tmp_path)).count() == docs.count()
