import hashlib

import corpus_pipeline
import numpy as np
from test_bpe import encoder

from pagequarry.llm import decontaminate, quality, simhash_gray, suffix_dedup

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage keeps what its rule, worked out in plain Python over its own input, says."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for (name, stage), k in zip(corpus_pipeline.STAGES, range(5)):
        before = {r.doc_id: r.text for r in docs.collect()}
        after_df = stage(spark, docs, SF).cache()
        after = after_df.collect()
        ids = {r.doc_id for r in after}
        if k < 4:
            assert after_df.columns == docs.columns
        if k == 0:
            model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            sizer = quality._Sizer(model.good, model.bad, model.level, model.block)
            assert ids == {d for d, t in before.items() if model.scores(np.array(sizer.sizes(t)))[0] >= 0.3} and len(ids) < len(before)
        if k == 1:
            order = sorted(before)
            prints = np.array([simhash_gray.fingerprint_of(before[d]) for d in order], dtype=np.uint64)
            near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
            comp = np.array(order)
            while True:
                new = np.array([comp[row].min() for row in near])
                if (new == comp).all():
                    break
                comp = new
            assert ids == set(comp.tolist()) and len(ids) < len(before)
        if k == 2:
            first = {}
            for d in sorted(before):
                data = before[d].encode()
                for p in range(len(data) - 49):
                    first.setdefault(data[p : p + 50], d)
            for r in after:
                data = before[r.doc_id].encode()
                gone = bytearray(len(data))
                for p in range(len(data) - 49):
                    if first[data[p : p + 50]] < r.doc_id:
                        gone[p : p + 50] = b"\1" * 50
                assert r.text == bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore") and r.n_chars == len(r.text)
        if k == 3:
            index = decontaminate.Index(bench, 5, 0.8, 20)
            held = {d for (d, t), f in zip(before.items(), decontaminate.scan(list(before.values()), index)) if f}
            assert ids == set(before) - held and held
        if k == 4:
            for r in after:
                ids_of = np.array(encoder.encoding.encode_ordinary(before[r.doc_id]), dtype="<u4")
                assert r.ids_sha256 == hashlib.sha256(ids_of.tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
        docs = after_df
    assert suffix_dedup.GRAM < 50
