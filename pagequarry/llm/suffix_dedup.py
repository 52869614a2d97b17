"""Removal of byte strings that an earlier document already holds.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller doc_id.  The strings are suffixes of the texts, compared
over their first ``length`` bytes; they are sorted bucket by bucket, and nothing
holds more than one bucket of suffixes.

* Exact copies need no suffix: the smallest doc_id of equal texts stands for all.
* Texts are packed into blocks by a hash of id and text (the only shuffle of raw texts), streamed, so that copies are passed over.
* A suffix's bucket is the smallest hash of the grams in its first ``length``
  bytes.  It depends on those bytes alone, so equal suffixes meet in one bucket,
  and neighbouring suffixes mostly share it: such a *run* of suffixes is kept as
  one stretch of text.  A first pass finds the buckets that more than one
  document uses, and only their runs are sent on (each distinct run of a block
  once: a passage that very many documents share is as many rows as blocks).
* Keys are mixed once more before they choose a bucket, as the smallest of many
  hashes are themselves small.  A key with more than :data:`HOT_RUNS` runs is split:
  its runs are cut where the second smallest hash changes, and both hashes together
  are the key, which again depends on the suffix's first bytes alone.
* Within a bucket equal runs are settled as wholes.  The suffixes of the others
  are compared by a difference cover: positions that are 1 or 2 modulo 3 are the
  cover sample, whose ranks over ``length - 2`` bytes are computed first, by
  doubling.  Any two suffixes reach sample positions after the same shift of at
  most 2, so ties however long end with those ranks, and the rest of a suffix
  needs no order of its own.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage_table

GRAM = 20
#: Most suffixes in a run, text in a block and in a slice worked on at a time, and text behind a bucket.
RUN, BLOCK_BYTES, SLICE_BYTES, BUCKET_BYTES = 64, 4 << 20, 1 << 20, 16 << 20
#: Runs that are Python objects at a time, and most runs that a key has before it is split.
RUNS_AT_ONCE, HOT_RUNS = 40_000, 20_000
_KEY_BITS = 48

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# --- suffixes and their buckets ---------------------------------------------


def _words(data: bytes) -> np.ndarray:
    """The 8 bytes from each position, as one number."""
    n = len(data) - 7
    out = np.empty(max(0, n), dtype=np.uint64)
    for o in range(min(8, max(0, n))):
        out[o::8] = np.frombuffer(data, dtype="<u8", count=(n - o + 7) // 8, offset=o)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """Well spread numbers of :data:`_KEY_BITS` bits."""
    h = (h ^ (h >> np.uint64(31))) * _C[2]
    h = (h ^ (h >> np.uint64(29))) * _C[0]
    return (h ^ (h >> np.uint64(32))) >> np.uint64(64 - _KEY_BITS)


def _second(least: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Smallest of the others that isn't ``least`` (all ones if there is none)."""
    out = np.full(len(least), np.iinfo(np.uint64).max, dtype=np.uint64)
    for o in others:
        out = np.minimum(out, np.where(o == least, np.iinfo(np.uint64).max, o).astype(np.uint64))
    return out


def suffix_keys(data: bytes, length: int, split: bool = False) -> np.ndarray:
    """Key of the suffix at each position that has ``length`` bytes left; of both smallest hashes with ``split``."""
    w = _words(data)
    n = len(data) - GRAM + 1
    h = w[:n] * _C[0]
    h ^= (w[8 : n + 8] ^ (h >> np.uint64(31))) * _C[1]
    h ^= (w[12 : n + 12] ^ (h >> np.uint64(29))) * _C[2]
    h ^= h >> np.uint64(32)
    h *= _C[3]
    h ^= h >> np.uint64(29)
    span, have = length - GRAM + 1, 1
    second = np.full(len(h), np.iinfo(np.uint64).max, dtype=np.uint64) if split else None
    while have < span:
        step = min(have, span - have)
        least = np.minimum(h[:-step], h[step:])
        if split:
            second = _second(least, h[:-step], h[step:], second[:-step], second[step:])
        h = least
        have += step
    return _mixed(_mixed(h) << np.uint64(64 - _KEY_BITS) ^ second) if split else _mixed(h)


def runs_of(texts: list[bytes], length: int, split: bool = False):
    """Runs of a list of texts: (joined texts, key, first position, suffixes, number of the text), in order.

    Positions count from the start of the joined texts.
    """
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < length:
        none = np.empty(0, dtype=np.int64)
        return data, none.astype(np.uint64), none, none, none
    keys = suffix_keys(data, length, split)
    at = np.arange(len(keys))
    text = np.searchsorted(ends, at, side="right")
    whole = at + length <= ends[text]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    first &= whole
    starts = np.flatnonzero(first)
    # A run ends where the next begins or its text has no more suffixes.
    stops = np.minimum(np.append(starts[1:], len(keys)), ends[text[starts]] - length + 1)
    counts = stops - starts
    pieces = -(-counts // RUN)
    if len(pieces) and pieces.max() > 1:
        which = np.repeat(np.arange(len(starts)), pieces)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        counts = np.minimum(RUN, counts[which] - inner * RUN)
        starts = starts[which] + inner * RUN
    return data, keys[starts], starts, counts, text[starts]


def _slices(texts: list[bytes]):
    """(number of the first text, texts) of about :data:`SLICE_BYTES`."""
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES or k == len(texts) - 1:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0


# --- packed rows ------------------------------------------------------------


def _pack(*arrays: np.ndarray, data: bytes = b"") -> bytes:
    """Columns of 64-bit numbers (each by differences, byte plane by byte plane) and bytes, compressed."""
    parts = [struct.pack("<II", len(arrays), len(arrays[0]))]
    for a in arrays:
        delta = np.diff(a.astype(np.int64), prepend=0)
        parts.append(delta.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts) + data)


def _unpack(packed: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    k, n = struct.unpack_from("<II", raw)
    columns = [np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 + 8 * n * j).reshape(8, n).T).view("<i8").ravel()) for j in range(k)]
    return columns, raw[8 + 8 * n * k :]


def _block(row: bytes) -> tuple[np.ndarray, list[bytes]]:
    (ids, sizes), data = _unpack(row)
    ends = np.cumsum(sizes)
    return ids, [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


# --- the steps --------------------------------------------------------------


def _pack_blocks(docs: DataFrame, firsts: DataFrame, n_blocks: int, length: int) -> DataFrame:
    """``block, hashes, packed``: the texts that ``firsts`` (``doc_id, h``) names, in order of doc_id.

    Rows with texts and the names of those that are wanted are sorted together by
    block, and each task streams through its own: of any number of rows that
    repeat a wanted one the first is taken and the rest pass by, so no more than one
    block of wanted texts is held.  A block's name covers id and text, so that rows which share an id are spread as well.
    """
    block = F.pmod(F.xxhash64("doc_id", "h"), F.lit(n_blocks)).cast("int").alias("block")
    texts = docs.where(F.octet_length("text") >= length).select("doc_id", _text_hash(F.col("text")).alias("h"), "text")
    names = firsts.select("doc_id", "h", F.lit(None).cast("string").alias("text"))
    rows = names.unionByName(texts).select(block, "doc_id", "h", F.col("text").isNotNull().alias("has_text"), "text")
    ordered = rows.repartition("block").sortWithinPartitions("block", "doc_id", "h", "has_text")

    def run(batches):
        now, wanted, taken = None, None, []

        def packed() -> pa.RecordBatch:
            body = _pack(np.array([r[0] for r in taken]), np.array([len(r[2]) for r in taken]), data=b"".join(r[2] for r in taken))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([b"".join(r[1] for r in taken)], pa.binary()), pa.array([body], pa.binary())], names=["block", "hashes", "packed"])

        for batch in batches:
            of_block, doc_ids, hashes, has_text = (batch.column(k).to_pylist() for k in range(4))
            for k, (b, doc_id, h, has) in enumerate(zip(of_block, doc_ids, hashes, has_text)):
                if b != now:
                    if taken:
                        yield packed()
                    now, wanted, taken = b, None, []
                if not has:
                    wanted = (doc_id, h)
                elif wanted == (doc_id, h):
                    taken.append((doc_id, h, batch.column(4)[k].as_py().encode("utf-8", "surrogatepass")))
                    wanted = None
        if taken:
            yield packed()

    return ordered.mapInArrow(run, "block int, hashes binary, packed binary")


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of keys."""
    return (keys.astype(np.uint64) >> np.uint64(_KEY_BITS - 30)).astype(np.int64) * n >> 30


def _by_bucket(keys: np.ndarray, n: int):
    """(bucket, first, stop) of sorted keys."""
    buckets = _bucket(keys, n)
    cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
    return [(int(buckets[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(keys)))]


def _used_keys(blocks: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """``bucket, block, packed``: the keys of each block, whether more than one of its texts has them, and in how many runs."""

    def run(batches):
        for batch in batches:
            for block, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, texts = _block(row.as_py())
                keys, owner = [], []
                for base, part in _slices(texts):
                    _, k, _, _, t = runs_of(part, length)
                    keys.append(k.astype(np.int64))
                    owner.append(t + base)
                k, t = np.concatenate(keys), np.concatenate(owner)
                order = np.lexsort((t, k))
                k, t = k[order], t[order]
                new = np.diff(k, prepend=-1) != 0
                cuts = np.flatnonzero(new)
                ends = np.append(cuts[1:], len(k))
                several, n = t[ends - 1] != t[cuts], ends - cuts
                k = k[cuts]
                rows = _by_bucket(k, n_buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([_pack(k[a:z], several[a:z], n[a:z]) for _, a, z in rows], pa.binary())],
                    names=["bucket", "block", "packed"],
                )

    return blocks.select("block", "packed").mapInArrow(run, "bucket int, block int, packed binary")


def _shared_keys(used: DataFrame) -> DataFrame:
    """``block, packed``: of each block's keys, those that another text has too, and whether they are to be split."""

    def run(group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_pylist()
        parts = [_unpack(x.as_py())[0] for x in group.column("packed")]
        keys = np.concatenate([p[0] for p in parts])
        several = np.concatenate([p[1] for p in parts]) > 0
        n_runs = np.concatenate([p[2] for p in parts])
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        del parts
        order = np.argsort(keys, kind="stable")
        keys, several, owner, n_runs = keys[order], several[order], owner[order], n_runs[order]
        cuts = np.flatnonzero(np.diff(keys, prepend=-1))
        users = np.diff(np.append(cuts, len(keys)))
        shared = np.repeat(np.logical_or.reduceat(several, cuts) | (users > 1), users)
        hot = np.repeat(np.add.reduceat(n_runs, cuts) > HOT_RUNS, users)
        keys, owner, hot = keys[shared], owner[shared], hot[shared]
        order = np.lexsort((keys, owner))
        keys, owner, hot = keys[order], owner[order], hot[order]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(cuts[1:], len(keys))
        return pa.table(
            {
                "block": pa.array([blocks[owner[a]] for a in cuts], pa.int32()),
                "n": pa.array((ends - cuts).tolist(), pa.int64()),
                "packed": pa.array([_pack(keys[a:b], hot[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
            }
        )

    return used.groupBy("bucket").applyInArrow(run, "block int, n long, packed binary")


#: Rows of the next step: spans that a block settles by itself, and runs for a bucket.
_SPANS = -1


def _split_runs(data: bytes, keys: np.ndarray, starts: np.ndarray, stops: np.ndarray, text: np.ndarray, split: np.ndarray, length: int):
    """The runs, those marked by ``split`` cut to runs of longer keys."""
    own = np.flatnonzero(split)
    joined, k, s, n, which = runs_of([data[a:b] for a, b in zip(starts[own].tolist(), stops[own].tolist())], length, split=True)
    before = np.concatenate(([0], np.cumsum(stops[own] - starts[own])))[which]
    first = starts[own][which] + s - before
    left = ~split
    return (
        np.concatenate((keys[left], k.astype(np.int64))),
        np.concatenate((starts[left], first)),
        np.concatenate((stops[left], first + n + length - 1)),
        np.concatenate((text[left], text[own][which])),
    )


def _shared_runs(blocks: DataFrame, shared: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """``bucket, block, packed``: each distinct run of a block with a shared key once, and spans (bucket -1) of the others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block = left.column("block")[0].as_py()
            ids, texts = _block(left.column("packed")[0].as_py())
            wanted, hot = (np.concatenate(c) for c in zip(*(_unpack(x.as_py())[0] for x in right.column("packed"))))
            order = np.argsort(wanted)
            wanted, hot = wanted[order], hot[order] > 0
            seen: dict[bytes, int] = {}
            numbers, stretches, spans = [], [], []
            for base, part in _slices(texts):
                data, keys, starts, counts, text = runs_of(part, length)
                keys = keys.astype(np.int64)
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                use = wanted[at] == keys
                split = hot[at[use]]
                keys, starts, stops, text = keys[use], starts[use], starts[use] + counts[use] + length - 1, text[use]
                if split.any():
                    keys, starts, stops, text = _split_runs(data, keys, starts, stops, text, split, length)
                owners = ids[text + base]
                # Texts come by ascending doc_id, so the first that has a stretch is the earliest.
                first = np.array([seen.setdefault(data[a:b], o) == o for a, b, o in zip(starts.tolist(), stops.tolist(), owners.tolist())], dtype=bool)
                places = starts - np.concatenate(([0], np.cumsum([len(t) for t in part])))[text]
                rows = np.stack((keys, owners, text + base, places, stops - starts), axis=1) if len(keys) else np.empty((0, 5), dtype=np.int64)
                numbers.append(rows[first])
                stretches += [data[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())]
                late = rows[~first]
                spans.append(np.stack((late[:, 2], late[:, 3], late[:, 3] + late[:, 4]), axis=1))
            del seen
            spans, numbers = np.concatenate(spans), np.concatenate(numbers)
            if len(spans):
                out.append((_SPANS, block, _pack(*spans.T)))
            order = np.argsort(numbers[:, 0], kind="stable")
            numbers = numbers[order]
            for bucket, a, b in _by_bucket(numbers[:, 0], n_buckets) if len(numbers) else ():
                out.append((bucket, block, _pack(*numbers[a:b].T, data=b"".join(map(stretches.__getitem__, order[a:b].tolist())))))
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table({"bucket": pa.array(columns[0], pa.int32()), "block": pa.array(columns[1], pa.int32()), "packed": pa.array(columns[2], pa.binary())})

    return blocks.select("block", "packed").groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, "bucket int, block int, packed binary")


def _ids(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers of rows of numbers, in their order."""
    found = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        _, inverse = np.unique(c, return_inverse=True)
        _, found = np.unique(found * (int(inverse.max(initial=0)) + 1) + inverse, return_inverse=True)
    return found


def equal_suffixes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Class of the suffix at each of the positions ``at``: equal where ``length`` bytes are equal.

    ``data`` must hold ``length`` bytes from each position.
    """
    n = len(data)
    depth = length - 2  # of the sample's ranks
    padded = np.concatenate((data, np.zeros(length + 8, dtype=np.uint8)))
    word = _words(padded.tobytes())
    # The cover sample: positions 1 and 2 modulo 3.  Ranks over 8, 16, 32 bytes and so on, of sample positions
    # alone where a doubling step keeps their residue, as steps of 3 * 2**k bytes do.
    sample = np.flatnonzero(np.arange(n) % 3 != 0)
    rank = np.zeros(n + length + 8, dtype=np.int64)
    rank[sample] = _ids(word[sample] & np.uint64(0xFFFFFFFFFFFF))  # 6 bytes
    have = 6
    while have * 2 <= depth:
        rank[sample] = _ids(rank[sample], rank[sample + have])
        have *= 2
    step = depth - have
    step += -step % 3  # to a place with the same residue; what lies behind ``depth`` is cut off below
    if step and step + have == depth:
        rank[sample] = _ids(rank[sample], rank[sample + step])
    elif step:
        # The last bytes up to ``depth`` by themselves.
        tail = [padded[sample + k].astype(np.int64) for k in range(have, depth)]
        wide = [sum(t << (8 * j) for j, t in enumerate(tail[k : k + 7])) for k in range(0, len(tail), 7)]
        rank[sample] = _ids(rank[sample], *wide)
    byte = padded.astype(np.int64)
    residue = at % 3
    found = np.zeros(len(at), dtype=np.int64)
    # Suffixes that start in the sample: its rank, and the last two bytes.
    inside = np.flatnonzero(residue != 0)
    p = at[inside]
    found[inside] = _ids(rank[p], byte[p + depth] << 8 | byte[p + depth + 1])
    classes = int(found.max(initial=-1)) + 1
    zero = np.flatnonzero(residue == 0)
    if not len(zero):
        return found
    z = at[zero]
    mine = np.full(len(zero), -1, dtype=np.int64)
    # Against residue 1: after one byte, both are in the sample.  Against residue 2: after two.
    for r, shift in ((1, 1), (2, 2)):
        others = np.flatnonzero(residue == r)
        q = at[others]
        both = np.concatenate((q, z))
        lead = byte[both] if shift == 1 else byte[both] << 8 | byte[both + 1]
        last = byte[both + length - 1] if shift == 1 else np.zeros(len(both), dtype=np.int64)
        same = _ids(lead, rank[both + shift], last)
        table = np.full(int(same.max(initial=0)) + 1, -1, dtype=np.int64)
        table[same[: len(q)]] = found[others]
        met = table[same[len(q) :]]
        mine = np.where(mine < 0, met, mine)
        if r == 1:
            own = same[len(q) :]  # suffixes of residue 0 among themselves
    alone = mine < 0
    if alone.any():
        _, fresh = np.unique(own[alone], return_inverse=True)
        mine[alone] = classes + fresh
    found[zero] = mine
    return found


def _covered(keys: np.ndarray, ids: np.ndarray, where: np.ndarray, stretches: list[bytes], length: int) -> np.ndarray:
    """Rows of (block, text, first, stop) that an earlier document holds, of runs at ``where`` (block, text, place)."""
    first: dict[bytes, int] = {}  # smallest doc_id of each distinct run
    for stretch, doc in zip(stretches, ids.tolist()):
        if first.setdefault(stretch, doc) > doc:
            first[stretch] = doc
    least = np.array(list(map(first.__getitem__, stretches)), dtype=np.int64)
    late = least < ids
    whole = np.array([len(s) for s in stretches], dtype=np.int64)
    found = [np.column_stack((where[late], where[late, 2] + whole[late]))]
    # Distinct runs of keys that have several; only these need their suffixes compared.
    number: dict[bytes, int] = {}
    use = np.flatnonzero(~late)
    kind = np.array([number.setdefault(stretches[k], len(number)) for k in use.tolist()], dtype=np.int64)
    key_of = np.zeros(len(number), dtype=np.int64)
    key_of[kind] = keys[use]
    _, inverse, counts = np.unique(key_of, return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts[inverse] > 1)
    if not len(several):
        return np.concatenate(found)
    distinct = list(number)
    several = several[np.argsort(inverse[several], kind="stable")]
    sizes = np.array([len(distinct[k]) for k in several.tolist()])
    # Settle groups of whole keys, about a slice of text at a time.
    new_key = np.flatnonzero(np.diff(inverse[several], prepend=-1))
    piece = (np.cumsum(sizes) - sizes)[new_key] // SLICE_BYTES
    starts = new_key[np.flatnonzero(np.diff(piece, prepend=-1))]
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(several)).tolist()):
        own, size = several[a:b], sizes[a:b]
        data = np.frombuffer(b"".join(distinct[k] for k in own.tolist()), dtype=np.uint8)
        counts = size - length + 1
        base = np.cumsum(size) - size
        run = np.repeat(np.arange(len(own)), counts)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        classes = equal_suffixes(data, base[run] + inner, length)
        doc = np.array([first[distinct[k]] for k in own.tolist()], dtype=np.int64)[run]
        earliest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, classes, doc)
        hit = earliest[classes] < doc
        begin, end = hit.copy(), hit.copy()
        begin[1:] &= ~(hit[:-1] & (run[1:] == run[:-1]))
        end[:-1] &= ~(hit[1:] & (run[1:] == run[:-1]))
        spans: dict[int, list[tuple[int, int]]] = {}
        for r, i, j in zip(own[run[begin]].tolist(), inner[begin].tolist(), inner[end].tolist()):
            spans.setdefault(r, []).append((i, j + length))
        at = np.isin(kind, list(spans))
        rows = [(int(w[0]), int(w[1]), int(w[2]) + i, int(w[2]) + j) for k, w in zip(kind[at].tolist(), where[use[at]].tolist()) for i, j in spans[k]]
        found.append(np.array(rows, dtype=np.int64).reshape(-1, 4))
    return np.concatenate(found)


def _covered_runs(runs: DataFrame, length: int) -> DataFrame:
    """``block, packed``: spans of a bucket's runs that an earlier document holds."""

    def run(group: pa.Table) -> pa.Table:
        blocks = np.asarray(group.column("block").to_numpy(), dtype=np.int64)
        parts = [_unpack(x.as_py()) for x in group.column("packed")]
        data = b"".join(d for _, d in parts)
        keys, ids, texts, places, sizes = (np.concatenate([c[k] for c, _ in parts]) for k in range(5))
        owner = np.repeat(blocks, [len(c[0]) for c, _ in parts])
        del parts
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(keys, kind="stable")
        # One group of keys at a time becomes Python objects, so that these stay few.
        cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
        cuts = cuts[np.unique(np.searchsorted(cuts, np.arange(0, len(order), RUNS_AT_ONCE)).clip(max=len(cuts) - 1))]
        found = [np.empty((0, 4), dtype=np.int64)]
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
            at = order[a:b]
            stretches = [data[i:j] for i, j in zip(begins[at].tolist(), (begins[at] + sizes[at]).tolist())]
            found.append(_covered(keys[at], ids[at], np.stack((owner[at], texts[at], places[at]), axis=1), stretches, length))
        spans = np.concatenate(found)
        spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
        cuts = np.flatnonzero(np.diff(spans[:, 0], prepend=-1))
        ends = np.append(cuts[1:], len(spans))
        return pa.table({"block": pa.array([int(spans[a, 0]) for a in cuts], pa.int32()), "packed": pa.array([_pack(*spans[a:b, 1:].T) for a, b in zip(cuts, ends)], pa.binary())})

    return runs.where(F.col("bucket") != _SPANS).groupBy("bucket").applyInArrow(run, "block int, packed binary")


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text without its spans (sorted), and the number of maximal spans."""
    kept, at, n = [], 0, 0
    end = -1
    for a, b in spans:
        if a > end:
            n += 1
            kept.append(text[at:a])
        end = max(end, b)
        at = end
    kept.append(text[at:])
    return b"".join(kept), n


def _apply(blocks: DataFrame, spans: DataFrame, what: str) -> DataFrame:
    """``doc_id, h, n_removed, n_spans, kept`` of the documents in the blocks; ``kept`` is ``what`` says: bytes, digest or text."""
    show = {"bytes": lambda x: x, "digest": lambda x: hashlib.sha256(x).hexdigest(), "text": lambda x: x.decode("utf-8", "ignore")}[what]
    kind = pa.binary() if what == "bytes" else pa.string()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "h", "n_removed", "n_spans", "kept"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), kind]
        rows = []
        if left.num_rows:
            ids, texts = _block(left.column("packed")[0].as_py())
            hashes = left.column("hashes")[0].as_py()
            found: dict[int, list[tuple[int, int]]] = {}
            for x in right.column("packed"):
                for text, a, b in zip(*(c.tolist() for c in _unpack(x.as_py())[0])):
                    found.setdefault(text, []).append((a, b))
            for k, (doc_id, text) in enumerate(zip(ids.tolist(), texts)):
                kept, n = _cut(text, sorted(found[k])) if k in found else (text, 0)
                rows.append((doc_id, hashes[32 * k : 32 * k + 32], len(text) - len(kept), n, show(kept)))
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = f"doc_id long, h binary, n_removed long, n_spans long, kept {'binary' if what == 'bytes' else 'string'}"
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(run, schema)


def _text_hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _stripped(docs: DataFrame, length: int, what: str, row: Column | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, row`` of every row; ``row`` is carried along.

    Texts travel in blocks and from there to their rows; only those that are in no block stay with them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (F.lit(None) if row is None else row).alias("row"))
    size = F.octet_length("text").cast("long")
    own = docs.select("doc_id", _text_hash(F.col("text")).alias("h"), size.alias("n_bytes"), "row", F.when((size < length) | F.col("doc_id").isNull(), F.col("text")).alias("short"))
    own = stage_table(own, "text-hashes")
    docs = docs.drop("row")
    firsts = own.where("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    total = firsts.where(F.col("n_bytes") >= length).agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # Copies travel to the blocks too, so all rows' bytes count there.
    whole = own.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull()).agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(whole / BLOCK_BYTES))
    n_buckets = max(1, math.ceil(total / BUCKET_BYTES))
    blocks = stage_table(_pack_blocks(docs, firsts.where(F.col("n_bytes") >= length), n_blocks, length), "text-blocks")
    shared = stage_table(_shared_keys(_used_keys(blocks, n_buckets, length)), "shared-keys")
    runs = stage_table(_shared_runs(blocks, shared.select("block", "packed"), n_buckets, length), "shared-runs")
    drop_stage(shared)
    spans = stage_table(_covered_runs(runs, length).unionByName(runs.where(F.col("bucket") == _SPANS).select("block", "packed")), "spans")
    drop_stage(runs)
    done = _apply(blocks, spans, what)
    left = own.join(firsts.select("h", F.col("doc_id").alias("first_id")), "h", "left").alias("l")
    joined = left.join(done.alias("d"), (F.col("l.doc_id") == F.col("d.doc_id")) & (F.col("l.h") == F.col("d.h")), "left")
    copy = (F.col("l.doc_id") > F.col("first_id")) & (F.col("n_bytes") >= length)
    # A row without blocks keeps its own text.
    nothing = {"bytes": F.lit(bytearray()), "digest": F.lit(hashlib.sha256(b"").hexdigest()), "text": F.lit("")}[what]
    whole = {"bytes": F.encode("short", "UTF-8"), "digest": F.lower(F.hex("l.h")), "text": F.col("short")}[what]
    return joined.select(
        F.col("l.doc_id").alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", whole)).alias("kept"),
        "row",
    )


def strip(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row of ``docs`` (``doc_id, text``); ``kept`` is what is left, as bytes.

    Null texts are empty.  Rows with the same doc_id don't remove from each
    other; rows with a null doc_id are left whole and remove nothing.
    """
    return _stripped(docs, length, "bytes").drop("row")


def digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """:func:`strip` with the SHA-256 in hex of what is left, ``kept_sha256``."""
    return _stripped(docs, length, "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; documents of which nothing is left go.

    A cut may fall inside a character; the bytes that are left of it go too.  Null
    texts stay null, and texts that were empty stay.
    """
    names = [c for c in docs.columns if c != "text"]
    own = F.struct(*(F.col(f"`{c}`") for c in names)).alias("own")
    found = _stripped(docs, length, "text", F.struct(own, F.col("text").isNull().alias("null")))
    text = F.when(~F.col("row.null"), F.col("kept")).alias("text")
    return found.where("n_removed = 0 or kept <> ''").select(*(text if c == "text" else F.col(f"row.own.`{c}`") for c in docs.columns))
