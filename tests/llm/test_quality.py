import zlib

import numpy as np

from pagequarry.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.judge(documents, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_fit_where_the_classes_part_cleanly():
    rng = np.random.default_rng(2)
    y = np.repeat([0.0, 1.0], [300, 1500])
    sizes = np.stack((np.where(y == 1, 0.2, -0.2) + rng.normal(0, 0.01, len(y)), np.full(len(y), 0.5)), axis=1)
    for scale in (1e-9, 0.05):
        terms = Q._terms(sizes, sizes.mean(axis=0), np.maximum(sizes.std(axis=0), scale))
        z = terms @ Q._logistic(terms, y, np.ones(len(y)))
        assert ((z > 0) == (y == 1)).all() and np.isfinite(z).all()


def test_folds(spark):
    rows = spark.range(0, 200).selectExpr("id AS doc_id").select("doc_id", Q.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_odd_texts_and_tables(spark, docs):
    texts = [None, "", "plain words that read well enough " * 20, "SHOUTING!! " * 40, "x" * 300_000] + ["some more plain words %d" % k for k in range(40)] + ["LOUD!! %d" % k for k in range(40)]
    table = docs(texts)
    labels = spark.createDataFrame([(k, int("LOUD" not in t and "SHOUT" not in t) if t else 7, "x") for k, t in enumerate(texts)], "doc_id long, quality int, text string")
    rows = {r.doc_id: r for r in Q.judge(table, labels, dictionary_bytes=2048).collect()}
    assert len(rows) == len(texts) and rows[0].score == rows[1].score and rows[2].score > rows[3].score
    kept = Q.keep(table, labels, dictionary_bytes=2048)
    assert kept.columns == table.columns
    assert Q.judge(docs([]), labels).count() == 0
    none = labels.where("quality = 1")
    assert all(r.score > 0.9 for r in Q.judge(table, none).collect())
    assert Q.judge(table, labels.limit(0)).count() == len(texts)
