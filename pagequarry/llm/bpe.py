"""Byte-level BPE by a monoid tree reduction, and its inverse.

A text is cut in halves down to leaves.  A leaf is split into the pattern's
matches as if it stood alone, and each match is encoded.  Two neighbours are
joined by re-splitting a window around their border, from a boundary of the
left one that later text can't move, until it meets a boundary of the right one:

* The pattern looks at most two characters behind a match's start or one behind
  its end, so text appended on the right can change no more than the last
  :data:`LOOSE` matches.
* The pattern never looks back, so from a boundary that both splits share, all
  that follows is the same.

If the window ends before they meet, it doubles.  The join is associative: its
result is the split of the joined text, however the text was cut.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

#: Matches at a text's end that appended text may change.
LOOSE = 3

#: A node of the tree: matches, and the ids of each as little-endian bytes.
Node = tuple[list[str], list[bytes]]


class TreeEncoder:
    """Encodes by a file of ranks and a pattern; ``width`` is the bytes of an id."""

    def __init__(self, path: str, pattern: str, leaf: int = 4096, cached: int = 250_000, width: int = 4):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.leaf, self.cached = regex.compile(pattern), leaf, cached
        self.dtype = f"<u{width}"
        self.by_id = {v: k for k, v in ranks.items()}
        self.cache: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of one match; each match is merged by itself."""
        found = self.cache.get(piece)
        if found is None:
            found = np.array(self.encoding.encode_ordinary(piece), dtype=self.dtype).tobytes()
            if len(piece) <= 40:
                if len(self.cache) >= self.cached:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def _ids(self, pieces: list[str]) -> list[bytes]:
        try:
            return list(map(self.cache.__getitem__, pieces))
        except KeyError:
            return list(map(self._piece, pieces))

    def _leaf(self, text: str) -> Node:
        pieces = self.pattern.findall(text)
        return pieces, self._ids(pieces)

    def join(self, left: Node, right: Node) -> Node:
        """The node of the two texts one after the other."""
        if not left[0] or not right[0]:
            return left if left[0] else right
        keep = max(0, len(left[0]) - LOOSE)
        head = "".join(left[0][keep:])
        span = 4
        while True:
            whole = span >= len(right[0])
            window = self.pattern.findall(head + "".join(right[0][:span]))
            sure = len(window) if whole else len(window) - LOOSE
            # Walk both splits' boundaries until they meet behind the border.
            at, theirs, k = 0, len(head), 0
            for n in range(max(0, sure)):
                at += len(window[n])
                while theirs < at and k < len(right[0]):
                    theirs += len(right[0][k])
                    k += 1
                if at == theirs:
                    new = window[: n + 1]
                    return left[0][:keep] + new + right[0][k:], left[1][:keep] + self._ids(new) + right[1][k:]
            if whole:
                new = window
                return left[0][:keep] + new, left[1][:keep] + self._ids(new)
            span *= 2

    def tree(self, text: str) -> Node:
        """The node of a text: halves are encoded by themselves and joined."""
        if len(text) <= self.leaf:
            return self._leaf(text)
        middle = len(text) // 2
        return self.join(self.tree(text[:middle]), self.tree(text[middle:]))

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.tree(text or "")[1])

    def decode(self, ids: np.ndarray, leaf: int = 1 << 14) -> bytes:
        """Bytes of ids: halves are decoded by themselves and concatenated."""
        if len(ids) <= leaf:
            return b"".join(map(self.by_id.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, width: int = 4) -> TreeEncoder:
    """One encoder a Python worker, so that its cache serves all batches."""
    return TreeEncoder(path, pattern, width=width)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: little-endian unsigned 32-bit ids of every whole text (null: empty)."""

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data``: the bytes of :func:`encode`'s ids."""

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            data = [own.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    Encodes and decodes in one pass, so neither ids nor bytes leave the task.
    Null and empty texts have no ids and the hashes of nothing; rows with the
    same doc_id each get a row; other columns are ignored.
    """

    def run(batches):
        own = encoder(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py())
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(own.decode(np.frombuffer(ids, dtype="<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
