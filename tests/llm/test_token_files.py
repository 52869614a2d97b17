import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagequarry.llm import separator_scan, token_files as T

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
library = Tokenizer.from_file(JSON)
encoder = T.ChunkEncoder(JSON, cached=40)
ODD = [None, "", " ", "a", "  two  spaces ", "line\nline \n end\n", "don't 1234 <|endoftext|> x", "é中文　字 \x1c ok", "word " * 9000]


@given(st.text(alphabet="ab' slrevdt\n\t1.,!é中　\x1c<|>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_chunks_give_the_librarys_ids(text):
    assert np.frombuffer(encoder.encode(text), dtype="<u2").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, 40_000])
def test_blocks(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.4, n), 50_000).astype(np.uint16)
    table = T.Table.of(np.bincount(ids, minlength=50_257))
    assert table.freq.sum() == 1 << 20
    block = T.encode_block(ids, table, checkpoint=4096)
    assert (T.decode_block(block, table, checkpoint=4096) == ids).all()
    for a, b in ((0, n), (n // 3, n // 2), (n - 1, n), (5, 4)):
        assert (T.decode_block(block, table, a, b, checkpoint=4096) == ids[a:b]).all()
    entropy = -(np.unique(ids, return_counts=True)[1] / n * np.log2(np.unique(ids, return_counts=True)[1] / n)).sum() * n / 8
    assert n < 40_000 or len(T.encode_block(ids, table)) < 1.05 * entropy + 6000


def test_damage_is_seen():
    ids = np.arange(1000, dtype=np.uint16)
    table = T.Table.of(np.bincount(ids))
    block = bytearray(T.encode_block(ids, table))
    block[len(block) // 2] ^= 1
    with pytest.raises(T.BadBlock):
        T.decode_block(bytes(block), table)


def test_files(spark, docs, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 5000)
    monkeypatch.setattr(T, "CHECKPOINT", 1000)
    texts = ODD + ["same", "same"]
    ids = list(range(len(texts) - 2, -1, -1)) + [3]
    files = T.write(docs(texts, ids=ids), JSON)
    rows = [tuple(r) for r in T.read_documents(files).orderBy("start").collect()]
    assert [r[0] for r in rows] == sorted(ids)
    by_id, start = {}, 0
    for doc, text in zip(ids, texts):
        own = np.array((library.encode(text, add_special_tokens=False).ids if text else []) + [0], dtype="<u4")
        by_id.setdefault(doc, []).append((len(own), zlib.crc32(own.tobytes())))
    for doc, at, n, crc in rows:
        assert at == start and (n, crc) in by_id[doc]
        start += n
    shard = files.shards.orderBy(T.F.desc("n_ids")).first()
    reader = T.ShardReader(shard.file, files.table())
    whole = reader.range(0, reader.n_ids)
    assert (reader.range(4990, 5020) == whole[4990:5020]).all() and len(whole) == shard.n_ids


@pytest.fixture
def conf(spark):
    """Sets configurations until the test ends."""
    before = {}

    def put(**values):
        for k, v in values.items():
            k = k.replace("__", ".")
            before.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _starts_follow(rows):
    start = 0
    for r in rows:
        assert r.start == start, r
        start += r.n_tokens


def test_many_ranges_of_uneven_sizes(spark, docs, conf):
    conf(spark__sql__shuffle__partitions="24", spark__sql__adaptive__coalescePartitions__enabled="false")
    texts = [f"doc {k} " + "word and 7 " * (1 + (k * 7919 % 97) * (1 + k // 50 % 7)) for k in range(1200)]
    files = T.write(docs(texts), JSON)
    shards = files.shards.orderBy("first_doc").collect()
    assert len(shards) > 12
    rows = T.read_documents(files).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(1200))
    _starts_follow(rows)
    for s, after in zip(shards, [*shards[1:], None]):  # a shard's documents are neighbours
        own = [d[0] for d in T.ShardReader(s.file, files.table()).documents()]
        assert own == list(range(s.first_doc, after.first_doc if after else 1200))


def test_one_range_read_in_parts(spark, docs, conf):
    conf(spark__sql__shuffle__partitions="1", spark__sql__files__maxPartitionBytes="20000", spark__sql__files__openCostInBytes="1")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "20000")
    try:
        texts = [f"{k} {k * 7919 % 9973} " * 40 for k in range(2000)]
        files = T.write(docs(texts, ids=[5] * 1500 + list(range(6, 506))), JSON)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    assert files.shards.count() > 1
    rows = T.read_documents(files).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [5] * 1500 + list(range(6, 506))
    _starts_follow(rows)


def test_null_ids_come_first(spark, docs):
    rows = T.read_documents(T.write(docs(["b", "a", "c"], ids=[2, None, None]), JSON)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 2), (None, 2, 2), (2, 4, 2)]


def test_no_documents(spark, docs):
    assert T.read_documents(T.write(docs([]), JSON)).count() == 0
    assert separator_scan.token_counts(docs([]), RANKS, public_tokenizers.PATTERN, 50256).count() == 0


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_separator_scan(spark, docs, block):
    rows = separator_scan.token_counts(docs(ODD), RANKS, public_tokenizers.PATTERN, 50256, block).collect()
    want = [len(library.encode(t.replace("<|endoftext|>", "<|endoftext |>"), add_special_tokens=False).ids) if t else 0 for t in ODD]
    got = {r.doc_id: r.n_tokens for r in rows}
    assert [got[k] for k in range(len(ODD)) if k != 6] == [n for k, n in enumerate(want) if k != 6]


def test_file_without_last_separator(spark, tmp_path):
    ids = np.array([9, 9, 5, 7, 9, 8], dtype="<u2")
    (tmp_path / "x.u16").write_bytes(ids.tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/x.u16",)], "file string")
    rows = sorted(tuple(r)[1:] for r in separator_scan.scan(files, eod=9, block=2).collect())
    assert rows == [(0, 0, 0), (1, 1, 0), (2, 2, 2), (3, 5, 1)]
