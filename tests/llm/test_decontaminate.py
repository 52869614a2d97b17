from collections import Counter

import numpy as np

from pagequarry.llm import decontaminate as D


def shingles(words, n):
    n = min(n, len(words))
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def brute(text, item, similarity=0.8):
    words, own = (text or "").lower().split(), (item or "").lower().split()
    best = 0
    if own:
        want = shingles(own, 5)
        for k in range(len(words) - len(own) + 1):
            window = shingles(words[k : k + len(own)], 5)
            best = max(best, sum((window & want).values()) / sum((window | want).values()))
    return best if best >= similarity else None


def test_against_brute_force(spark, docs):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 300, n)]
    items = [" ".join(word(n)) for n in (6, 12, 12, 30, 50, 50)] + ["tiny item", "again again again again again again again again", None, ""]
    texts = [None, "", "w1 w2", "AGAIN " * 40, "a tiny ITEM here"]
    for k in range(6):
        own = items[k].split()
        texts.append(" ".join(word(20) + own + word(9)))
        for _ in range(4):
            edited = list(own)
            edited[rng.integers(0, len(own))] = "edit"
            texts.append(" ".join(word(15) + edited + word(5)).upper())
        texts.append(" ".join(own[: len(own) // 2] + word(5)))
    texts.append(" ".join(word(20000) + items[4].split()))
    table = docs(texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(table, bench).collect()}
    want = {(d, i): s for d, t in enumerate(texts) for i, m in enumerate(items) if (s := brute(t, m)) is not None}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    kept = D.clean(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    index = D.Index([(k, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 20))) for k in range(200)], 5, 0.8, 20)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = index.near((5, 20), prints)
    for p, found in zip(prints, near):
        assert set(found) == set(np.flatnonzero(np.bitwise_count(index.prints ^ p) <= 20).tolist())


def test_several_passes(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "MOST_BYTES", 40)
    items = [(k, f"the item number {k} has these words") for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs([t for _, t in items])
    assert {(r.doc_id, r.item_id) for r in D.contaminated(table, bench).where("similarity = 1").collect()} == {(k, k) for k in range(6)}


def test_empty(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs(["a b c d e f"]), bench).count() == 0
    assert D.clean(docs(["a", None]), bench).count() == 2


def test_lookup_by_blocks():
    """Fingerprints meet all items within the radius, whether values or masks are tried, and no others."""
    rng = np.random.default_rng(3)
    for n in (5, 300, 20000):
        prints = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        asked = prints[rng.integers(0, n, 60)]
        for _ in range(20):
            asked = np.where(rng.random(60) < 0.8, asked ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64)), asked)
        index = D.Index([(1, "a b c d e f g")], 5, 0.8, 20)
        index.prints, index.by_size = prints, {(5, 7): list(range(n))}
        index.blocks = {(5, 7): [D._Lookup(D._block_of(prints, b)) for b in range(4)]}
        near = np.bitwise_count(asked[:, None] ^ prints[None]) <= 20
        assert [sorted(x) for x in index.near((5, 7), asked)] == [np.flatnonzero(row).tolist() for row in near]
