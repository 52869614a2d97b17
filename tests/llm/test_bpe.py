import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import bpe

encoder = bpe.TreeEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@given(st.text(alphabet="ab 'slrevdt\n\t 1.,!é中\x1c　😀", max_size=80), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_any_tree_gives_the_librarys_ids(text, leaf):
    encoder.leaf = leaf
    ids = np.frombuffer(encoder.encode(text), dtype="<u4")
    assert ids.tolist() == encoder.encoding.encode_ordinary(text)
    assert encoder.decode(ids, leaf=3) == text.encode()


@given(st.text(alphabet="a 'l\n", max_size=20), st.text(alphabet="l a\n'", max_size=20), st.text(alphabet="a l", max_size=9))
@settings(max_examples=200, deadline=None)
def test_join_is_associative(a, b, c):
    x, y, z = (encoder._leaf(t) for t in (a, b, c))
    assert encoder.join(encoder.join(x, y), z) == encoder.join(x, encoder.join(y, z)) == encoder._leaf(a + b + c)


def test_round_trip(spark, docs):
    texts = [None, "", "don't stop", "x" * 20000, "ünï " * 3000, "don't stop"]
    rows = {r.doc_id: r for r in bpe.round_trip(docs(texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(texts):
        ids = np.array(encoder.encoding.encode_ordinary(t or ""), dtype="<u4")
        assert (rows[k].n_tokens, rows[k].ids_sha256, rows[k].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.decode(bpe.encode(docs(texts), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == {k: t or "" for k, t in enumerate(texts)}
