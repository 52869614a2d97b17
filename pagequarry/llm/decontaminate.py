"""Documents that hold benchmark items, found by SimHash over item-sized windows.

A window has as many words as an item.  Windows and items have a 64-bit SimHash
of their word shingles, each weighted by how often it occurs.  Item fingerprints
are indexed by four blocks of 16 bits: two fingerprints within ``radius`` bits
differ in ``radius // 4`` bits or fewer in some block, so looking up, for each
block, the items that near misses every fingerprint within the radius.  An exact
weighted similarity (sum of the smaller counts over sum of the larger) then
decides.

Only windows that can pass are fingerprinted: equal-sized windows of similarity
``s`` share ``2 s / (1 + s)`` of their shingles at least.  So one vectorised pass
hashes all shingles of the texts and finds those that any item has; documents
without enough of them end there.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bytes of benchmark text sent to the tasks at once; a larger benchmark is searched for in several passes.
MOST_BYTES = 16 << 20
_MUL = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    up = np.full(n, _MUL, dtype=np.uint64)
    down = np.full(n, pow(_MUL, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word: what stands between ASCII white space."""
    b = np.frombuffer(data, dtype=np.uint8)
    space = np.concatenate(([True], _SPACE[b], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    size = 1 << max(10, (len(b) + 1).bit_length())
    up, down = _powers(size)
    prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])))
    h = (prefix[ends] - prefix[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    return h * _STEP, starts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + n]) * _STEP
        h ^= h >> np.uint64(29)
    return h


def _bits(shingles: list[bytes]) -> np.ndarray:
    """+1 and -1 for the 64 bits of each shingle's hash."""
    h = np.array([xxhash.xxh64_intdigest(s) for s in shingles], dtype="<u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from rows of 64 sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def _block_of(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint32)


class _Lookup:
    """The items that have each value of a block of 16 bits."""

    def __init__(self, blocks: np.ndarray):
        self.order = np.argsort(blocks, kind="stable")
        self.values, self.first = np.unique(blocks[self.order], return_index=True)
        self.first = np.append(self.first, len(blocks))
        self.place = np.full(1 << 16, -1, dtype=np.int64)
        self.place[self.values] = np.arange(len(self.values))

    def items(self, values: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of some values, item) for all items whose block differs from it by one of the masks.

        Where fewer values are listed than there are masks, the listed ones are tried instead: the same pairs.
        """
        if len(self.values) < len(masks):
            which, at = np.nonzero(np.isin(values[:, None] ^ self.values[None, :], masks))
        else:
            places = self.place[values[:, None] ^ masks[None, :]]
            which, column = np.nonzero(places >= 0)
            at = places[which, column]
        n = np.diff(self.first)[at]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(which, n), self.order[np.repeat(self.first[at], n) + inner]


class Index:
    """A bounded set of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], shingle: int, similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        self.by_size: dict[tuple[int, int], list[int]] = {}  # (words in a shingle, words) -> items
        self.ids, self.counts, prints = [], [], []
        hashes: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            words = _normal(text).split()
            if not words:
                continue
            width = min(shingle, len(words))
            k = len(self.ids)
            self.ids.append(item_id)
            shingles = [b" ".join(words[j : j + width]) for j in range(len(words) - width + 1)]
            self.counts.append(Counter(shingles))
            prints.append(_fingerprint(_bits(shingles).sum(axis=0)[None])[0])
            self.by_size.setdefault((width, len(words)), []).append(k)
            own = shingle_hashes(word_hashes(b" ".join(words))[0], width)
            for h in set(own.tolist()):
                hashes.setdefault(width, {}).setdefault(h, []).append(k)
        self.prints = np.array(prints, dtype=np.uint64)
        self.hashes = hashes
        self.sorted = {w: np.array(sorted(h), dtype=np.uint64) for w, h in hashes.items()}
        self.maybe = {}
        for w, h in self.sorted.items():
            table = np.zeros(1 << 20, dtype=bool)
            table[h >> np.uint64(44)] = True
            self.maybe[w] = table
        # For each size of items: their shingles, and the multi-index over four blocks of 16 bits.
        self.shingles, self.blocks = {}, {}
        for (width, n), items in self.by_size.items():
            own = set(items)
            self.shingles[width, n] = np.array(sorted(h for h, having in hashes[width].items() if own.intersection(having)), dtype=np.uint64)
            self.blocks[width, n] = [_Lookup(_block_of(self.prints[items], b)) for b in range(4)]
        #: What two values of a block may differ by: of four blocks one has a quarter of the differing bits at most.
        self.masks = np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint32)) <= radius // 4).astype(np.uint32)

    def hits(self, h: np.ndarray, width: int) -> np.ndarray:
        """Places of the shingles that some item has."""
        at = np.flatnonzero(self.maybe[width][h >> np.uint64(44)])
        own = self.sorted[width]
        k = np.minimum(np.searchsorted(own, h[at]), len(own) - 1)
        return at[own[k] == h[at]]

    def near(self, size: tuple[int, int], prints: np.ndarray) -> list[list[int]]:
        """For each fingerprint, the items of a size within the radius.

        Each block of a fingerprint is looked up with every value that it may have in an
        item; only the items listed there are compared whole.
        """
        items = np.array(self.by_size[size])
        own = self.prints[items]
        different, place = np.unique(prints, return_inverse=True)
        found = []
        for b, lookup in enumerate(self.blocks[size]):
            values, at = np.unique(_block_of(different, b), return_inverse=True)
            by_value = np.argsort(at, kind="stable")
            first = np.searchsorted(at[by_value], np.arange(len(values) + 1))
            for k in range(0, len(values), 64):
                which, listed = lookup.items(values[k : k + 64], self.masks)
                # Every fingerprint with the value, against every item listed for it.
                n = np.diff(first)[which + k]
                rows = by_value[np.repeat(first[which + k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                columns = np.repeat(listed, n)
                fits = np.bitwise_count(different[rows] ^ own[columns]) <= self.radius
                found.append(rows[fits] * len(items) + columns[fits])
        pairs = np.unique(np.concatenate(found))
        near: list[list[int]] = [[] for _ in different]
        for r, c in zip((pairs // len(items)).tolist(), (pairs % len(items)).tolist()):
            near[r].append(int(items[c]))
        return [near[k] for k in place.tolist()]

    def matches(self, words: list[bytes], places: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[float, int]]:
        """Item -> (similarity, first word of the window), for a text with item shingles at ``places`` (by width: places, hashes)."""
        best: dict[int, tuple[float, int]] = {}
        share = 2 * self.similarity / (1 + self.similarity)
        for width, n in self.by_size:
            if width not in places or len(words) < n:
                continue
            hits, h = places[width]
            hits = hits[np.isin(h, self.shingles[width, n])]
            slots = n - width + 1  # shingles in a window
            need = max(1, math.ceil(share * slots - 1e-9))
            last = len(words) - n
            if len(hits) < need:
                continue
            # Windows from any start that have enough hits: hits i .. i + need - 1 lie within ``slots``.
            run = np.flatnonzero(hits[need - 1 :] - hits[: len(hits) - need + 1] < slots)
            if not len(run):
                continue
            starts = np.unique(np.concatenate([np.arange(max(0, hits[i + need - 1] - slots + 1), min(last, hits[i]) + 1) for i in run.tolist()]))
            # Stretches of neighbouring windows, whose sums roll.
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > slots) + 1):
                if not len(part):
                    continue
                a, b = int(part[0]), int(part[-1])
                shingles = [b" ".join(words[k : k + width]) for k in range(a, b + slots)]
                sums = np.concatenate((np.zeros((1, 64), dtype=np.int64), np.cumsum(_bits(shingles), axis=0)))
                prints = _fingerprint(sums[part - a + slots] - sums[part - a])
                for start, near in zip(part.tolist(), self.near((width, n), prints)):
                    near = [k for k in near if best.get(k, (0.0, 0))[0] < 1.0]
                    if not near:
                        continue
                    window = Counter(shingles[start - a : start - a + slots])
                    for k in near:
                        common = sum((window & self.counts[k]).values())
                        s = common / (2 * slots - common)
                        if s >= self.similarity and s > best.get(k, (0.0, 0))[0]:
                            best[k] = (s, start)
        return best


def scan(texts: list[str | None], index: Index, slice_bytes: int = 1 << 20) -> list[dict[int, tuple[float, int]]]:
    """:meth:`Index.matches` of each text."""
    out: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
    if not len(index.ids):
        return out
    data = [_normal(t) for t in texts]
    first = size = 0
    for k, d in enumerate(data):
        size += len(d) + 1
        if size < slice_bytes and k + 1 < len(data):
            continue
        part = data[first : k + 1]
        begins = np.concatenate(([0], np.cumsum([len(d) + 1 for d in part])))
        h, at = word_hashes(b"\n".join(part))
        owner = np.searchsorted(begins, at, side="right") - 1
        first_word = np.searchsorted(at, begins[:-1])
        found: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        for width in index.sorted:
            shingles = shingle_hashes(h, width)
            hits = index.hits(shingles, width)
            hits = hits[owner[hits] == owner[hits + width - 1]]
            for text in np.unique(owner[hits]).tolist():
                own = hits[owner[hits] == text]
                found.setdefault(text, {})[width] = own - first_word[text], shingles[own]
        for text, places in found.items():
            out[first + text] = index.matches(part[text].split(), places)
        first, size = k + 1, 0
    return out


def indexes(benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 20):
    """One :class:`Index` for each :data:`MOST_BYTES` of ``benchmark`` (``item_id, text``)."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / MOST_BYTES))
    for k in range(parts):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).select("item_id", "text").collect()
        yield Index(sorted(((r["item_id"], r["text"]) for r in rows if r["item_id"] is not None), key=lambda r: r[0]), shingle, similarity, radius)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: the items that a text holds, with their best window.

    Words are lower-cased and stand between white space.  Items of fewer words
    than a shingle are one shingle; empty or null items and texts match
    nothing, nor do items with a null item_id, which nothing could name.
    Repeated rows of ``docs`` give repeated results, a repeated item one for each
    of its rows; other columns are ignored.
    """
    out = None
    for index in indexes(benchmark, **options):

        def run(batches, index=index):
            for batch in batches:
                rows = []
                for doc_id, found in zip(batch.column(0).to_pylist(), scan(batch.column(1).to_pylist(), index)):
                    rows += [(doc_id, index.ids[k], s, start, len_of[k]) for k, (s, start) in sorted(found.items())]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        len_of = {k: n for (_, n), items in index.by_size.items() for k in items}
        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def _is_contaminated(text: Column, index: Index) -> Column:
    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(found) for found in scan(texts.tolist(), index)], dtype=bool)

    return test(text)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept; no shuffle of texts."""
    for index in indexes(benchmark, **options):
        docs = docs.where(~_is_contaminated(F.col("text"), index))
    return docs
