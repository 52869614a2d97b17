import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import simhash_gray as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, prints, radius):
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= radius
    comp = np.array(ids)
    while True:
        new = np.array([comp[row].min() for row in near])
        if (new == comp).all():
            return comp
        comp = new


@given(st.text(alphabet="aB \t\né1", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert S.fingerprint_of(text, block=3) == brute_fingerprint(text)


def test_forest_joins_what_is_near():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([[np.uint64(1) << np.uint64(b) for b in rng.integers(0, 64, 3)] for _ in range(200)])
    points = np.sort(base[rng.integers(0, 40, 200)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    forest = S.linked_forest(points, None, 4)
    comp = list(range(200))
    for i, j in forest:
        assert np.bitwise_count(points[i] ^ points[j]) <= 4
        a, b = comp[i], comp[j]
        comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert comp == list(brute_components(list(range(200)), points, 4))


def test_components(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 8)
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(500)]
    texts = [None, "", "  ", "one", "one", "ONE", "two words"]
    for _ in range(12):
        own = list(rng.choice(words, 150))
        texts.append(" ".join(own))
        for _ in range(4):
            copy = list(own)
            copy[rng.integers(0, 150)] = "changed"
            texts.append(" ".join(copy))
    texts.append("long " * 30000)
    rows = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in S.components(docs(texts)).collect()}
    prints = np.array([brute_fingerprint(t) for t in texts], dtype=np.uint64)
    want = brute_components(list(range(len(texts))), prints, 4)
    assert [rows[k] for k in range(len(texts))] == [(int(p), int(c)) for p, c in zip(prints, want)]
    assert len(set(want)) < len(texts) - 20


def test_leaves_of_any_size_find_the_same(spark, docs):
    prints = [(int(x) * 0x0101010101010101 % (1 << 63), k) for k, x in enumerate(np.random.default_rng(5).integers(0, 1 << 10, 300))]
    entries = spark.createDataFrame(prints, "fp long, rep long").dropDuplicates(["fp"])
    from pagequarry.llm.common import connected_components

    found = [sorted(map(tuple, connected_components(S.links(entries, 4, leaf, blocks)).collect())) for leaf, blocks in ((4, None), (512, 5), (16, 6), (8, 7))]
    assert found[0] == found[1] == found[2] == found[3] and found[0]


def test_more_blocks_for_more_fingerprints():
    assert [S.blocks_for(n, 4) for n in (0, 250_000, 10**8, 10**10, 10**12)] == [5, 5, 6, 7, 8]
    for blocks in (5, 6, 7):
        for order in S._fronts(4, blocks):
            assert sorted(b for first, width in order for b in range(first, first + width)) == list(range(64))


def test_empty_and_repeated(spark, docs):
    assert S.components(docs([])).count() == 0
    twice = docs(["a b c d e"] * 3, ids=[5, 5, 9])
    assert sorted((r.doc_id, r.component_id) for r in S.components(twice).collect()) == [(5, 5), (5, 5), (9, 5)]
    nulls = docs(["a b c d e", "a b c d e", "only null"], ids=[None, 4, None])
    assert sorted(((r.doc_id, r.component_id) for r in S.components(nulls).collect()), key=str) == [(4, 4), (None, 4), (None, None)]
    shared = docs(["copied text of five words", "another text that nobody has", "copied text of five words", "", None], ids=[2, 5, 5, 7, 8])
    assert sorted((r.doc_id, r.text) for r in S.keep_one(shared).collect()) == [(2, "copied text of five words"), (5, "another text that nobody has"), (7, "")]
    kept = S.keep_one(twice)
    assert kept.columns == twice.columns and {r.doc_id for r in kept.collect()} == {5}
