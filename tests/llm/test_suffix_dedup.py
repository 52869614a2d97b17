import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.llm import suffix_dedup as S


def brute(rows, length=50):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < doc:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@given(st.binary(min_size=60, max_size=300).map(lambda b: bytes(c % 3 for c in b)), st.sampled_from([50, 26, 33]))
@settings(max_examples=60, deadline=None)
def test_equal_suffixes(data, length):
    array = np.frombuffer(data, dtype=np.uint8)
    at = np.arange(len(data) - length + 1)
    kinds = S.equal_suffixes(array, at, length).tolist()
    seen = {}
    for k, kind in zip(at.tolist(), kinds):
        assert seen.setdefault(data[k : k + length], kind) == kind
    assert len(set(kinds)) == len(seen)


@given(st.lists(st.binary(max_size=200), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_runs_hold_every_suffix_once(texts):
    data, keys, starts, counts, text = S.runs_of(texts, 50)
    found = sorted(p for a, c in zip(starts.tolist(), counts.tolist()) for p in range(a, a + c))
    ends = np.cumsum([len(t) for t in texts])
    want = [p for e, t in zip(ends, texts) for p in range(e - len(t), e - 49)]
    assert found == want and counts.max(initial=1) <= S.RUN


@given(st.binary(min_size=50, max_size=400).map(lambda b: bytes(c % 2 for c in b)), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_split_keys_depend_on_the_suffix_alone(data, lead):
    least, both = S.suffix_keys(data, 50), S.suffix_keys(data, 50, split=True)
    again = S.suffix_keys(b"\7" * lead + data, 50, split=True)[lead:]
    assert (both == again).all() and len(least) == len(both) == len(data) - 49
    # Both hashes say more than the least alone.
    of: dict[int, int] = {}
    assert all(of.setdefault(b, a) == a for a, b in zip(least.tolist(), both.tolist()))


def test_buckets_are_even():
    data = np.random.default_rng(3).integers(97, 123, 400_000, dtype=np.uint8).tobytes()
    keys = np.unique(S.suffix_keys(data, 50))
    counts = np.bincount(S._bucket(keys, 32), minlength=32)
    assert counts.max() < 1.2 * len(keys) / 32 and counts.min() > 0.8 * len(keys) / 32


@pytest.mark.parametrize("small", [False, True, "hot"])
def test_against_brute_force(spark, docs, monkeypatch, small):
    if small == "hot":
        monkeypatch.setattr(S, "HOT_RUNS", 2)
    if small:
        for name, value in (("BLOCK_BYTES", 4000), ("SLICE_BYTES", 1500), ("BUCKET_BYTES", 6000), ("RUNS_AT_ONCE", 50)):
            monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdeé "), rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 300, "ab" * 400, passage]
    for k in range(40):
        own = " ".join(word() for _ in range(rng.integers(5, 60)))
        texts += [own, own[: len(own) // 2] + passage + own[len(own) // 2 :]] if k % 3 == 0 else [own + passage[20:130]]
    texts += [texts[12], texts[12], passage]
    ids = list(rng.permutation(len(texts)))
    ids[5] = ids[6]  # two documents with one id
    table = docs(texts, ids=[int(i) for i in ids])
    found = sorted(map(tuple, S.digests(table).collect()))
    assert found == brute([(int(i), t) for i, t in zip(ids, texts)])


def test_texts_and_columns(spark, docs):
    table = docs(["a passage that is long enough to be seen as one, é" * 2, None, "a passage that is long enough to be seen as one, é" * 2 + " more", "x"])
    kept = S.without_repeats(table)
    assert kept.columns == table.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert rows[0].endswith("é") and rows[1] is None and rows[2] == " more" and rows[3] == "x"
    assert S.without_repeats(docs([])).count() == 0 and S.digests(docs([])).count() == 0


def test_null_ids_stay_whole(spark, docs):
    text = "a passage that is long enough to be seen as a repeat, twice"
    rows = sorted(map(tuple, S.digests(docs([text, text, text], ids=[None, 1, 2])).select("doc_id", "n_removed").collect()), key=str)
    assert rows == [(1, 0), (2, len(text)), (None, 0)]


def test_table_of_copies(spark):
    """Thousands of copies, and one row many times, are no group of their own: each block holds its wanted texts only."""
    text = " ".join(f"word{k}" for k in range(1500))
    rows = [(k, text, "x") for k in range(3000)] + [(5000, text[:9000] + "!" + text[9000:], "x")] * 200 + [(6000, f"{k} other text of its own " * 9, "x") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(6)
    keyed = docs.select("doc_id", "text").withColumn("h", F.unhex(F.sha2("text", 256)))
    firsts = keyed.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    blocks = S._pack_blocks(docs.select("doc_id", "text"), firsts, 12, 50).collect()
    ids = [S._block(b.packed)[0].tolist() for b in blocks]
    assert sorted(x for part in ids for x in part) == [0, 5000] + [6000] * 50
    assert sum(6000 in part for part in ids) > 3  # rows of one id are spread
    found = {}
    for r in S.digests(docs).collect():
        found.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed))
    assert found[0] == {(len(text), 0)} and all(found[k] == {(len(text), len(text))} for k in range(1, 3000))
    assert found[5000] == {(len(text) + 1, len(text))}
    assert len(found[6000]) >= 1 and all(removed == 0 for _, removed in found[6000])
