"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``radius`` differing bits are linked; documents reachable
through links form a component.  The index is exact: no link is missed.

* Exact copies of a fingerprint are one entry (a partial aggregation).
* The bits are cut into ``radius + c`` blocks.  Two linked fingerprints agree on
  ``c`` whole blocks at least, so one index for each choice of ``c`` blocks put in
  front suffices, and its top nodes (equal fronts) accumulate no difference.  The
  more fingerprints, the more blocks, so that a front stays about a leaf's size.
* Below a top node, entries are sorted by the Gray rank of the reordered bits and
  cut into leaves.  A leaf's parent node keeps the bits all its members share
  (``mask`` and ``shared``).  Pairs of nodes whose shared bits already differ in
  more than ``radius`` places are pruned whole; the survivors are searched in
  tasks, through a further level of small nodes with the same rule.
* A searched pair of leaves returns a spanning forest of its links: the same
  components, and never more rows than entries, however dense the group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stage_table

#: Entries in a leaf of the distributed level, and in a node of the level within a task.
LEAF, INNER = 512, 16


def fingerprint_of(text: str | None, shingle: int = 4, seed: int = 42, block: int = 1 << 15) -> int:
    """SimHash of a text's word shingles, repeats included (0 without words).

    Works on ``block`` shingles at a time, so a very long text needs no more
    memory than its words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, block):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[k : k + block], last[k : k + block])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > n)
    return int(sum(1 << int(b) for b in bits))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, text_key, fp``: a hash of every whole text, and its signed 64-bit fingerprint."""

    def run(batches):
        for batch in batches:
            values = [fingerprint_of(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], names=["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key(F.col("text")).alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fp long")


def _fronts(radius: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each choice of ``blocks - radius`` blocks: the bits' order, as pieces (first bit from the left, width), the front pieces first."""
    width, rest = divmod(64, blocks)
    widths = [width + (k < rest) for k in range(blocks)]
    pieces = [(sum(widths[:k]), w) for k, w in enumerate(widths)]
    chosen = combinations(range(blocks), blocks - radius)
    return [[pieces[k] for k in front] + [p for k, p in enumerate(pieces) if k not in front] for front in chosen]


def _front_bits(radius: int, blocks: int) -> int:
    return min(sum(w for _, w in order[: blocks - radius]) for order in _fronts(radius, blocks))


def blocks_for(n: int, radius: int, leaf: int = LEAF, most: int = 4) -> int:
    """Blocks to cut the bits into, so that ``n`` fingerprints spread over fronts of about a leaf each.

    Every further block makes fronts longer and their choices more: 5, 15, 35 and
    70 indexes for ``radius`` 4, with fronts of 12, 20, 27 and 32 bits.
    """
    for extra in range(1, most + 1):
        if n >> _front_bits(radius, radius + extra) <= leaf:
            break
    return radius + extra


def _in_order(order: list[tuple[int, int]]) -> Column:
    """The fingerprint's bits in another order."""
    code, at = F.lit(0).cast("long"), 0
    for first, width in order:
        piece = F.shiftrightunsigned(F.shiftleft("fp", first) if first else F.col("fp"), 64 - width)
        code, at = code.bitwiseOR(F.shiftleft(piece, 64 - at - width)), at + width
    return code


def leaf_nodes(entries: DataFrame, radius: int, blocks: int, leaf: int = LEAF) -> DataFrame:
    """Nodes of all indexes: ``index_no, front, leaf_no, mask, shared, fps, reps``.

    Entries are dealt and sorted by range of (index, front, Gray rank); a leaf ends
    where it is full and at the border of a front or range, so no task holds a front.
    """
    rows = []
    for k, order in enumerate(_fronts(radius, blocks)):
        code, front = _in_order(order), sum(w for _, w in order[: blocks - radius])
        rows.append(F.struct(F.lit(k).alias("index_no"), F.lit(64 - front).alias("behind"), code.alias("code")))
    each = entries.select("fp", "rep", F.explode(F.array(*rows)).alias("r")).select("r.index_no", F.expr("shiftrightunsigned(r.code, r.behind)").alias("front"), F.col("r.code").alias("rank"), "fp", "rep")
    for k in (1, 2, 4, 8, 16, 32):  # the rank of a code word in the reflected Gray sequence is a prefix XOR
        each = each.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", k)))
    each = each.select("index_no", "front", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))).alias("rank"), "fp", "rep")  # ranks compare as unsigned numbers
    ordered = each.repartitionByRange("index_no", "front", "rank").sortWithinPartitions("index_no", "front", "rank")

    def cut(batches):
        part, made, kept = TaskContext.get().partitionId(), 0, None

        def nodes(rows: pa.RecordBatch, last: bool):
            nonlocal made, kept
            index_no, front, fps, reps = (np.asarray(rows.column(k)) for k in (0, 1, 3, 4))
            new = (np.diff(index_no, prepend=-1) != 0) | (np.diff(front, prepend=-1) != 0)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(front)))
            pieces = -(-sizes // leaf)
            which = np.repeat(np.arange(len(starts)), pieces)
            starts = starts[which] + leaf * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            ends = np.append(starts[1:], len(front))
            kept = None
            if not last and len(starts):  # the last one may go on in the next batch
                kept = rows.slice(int(starts[-1]))
                starts, ends = starts[:-1], ends[:-1]
            if not len(starts):
                return
            n = int(ends[-1])
            low, high = np.bitwise_and.reduceat(fps[:n], starts), np.bitwise_or.reduceat(fps[:n], starts)
            offsets = pa.array(np.append(starts, n).astype(np.int32))
            numbers = (np.int64(part) << np.int64(40)) + made + np.arange(len(starts))
            made += len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(index_no[starts]), pa.array(front[starts]), pa.array(numbers), pa.array(low), pa.array(~(low ^ high)), pa.ListArray.from_arrays(offsets, pa.array(fps[:n])), pa.ListArray.from_arrays(offsets, pa.array(reps[:n]))],
                names=["index_no", "front", "leaf_no", "shared", "mask", "fps", "reps"],
            )

        for batch in batches:
            if batch.num_rows:
                yield from nodes(batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0], False)
        if kept is not None:
            yield from nodes(kept, True)

    return ordered.mapInArrow(cut, "index_no int, front long, leaf_no long, shared long, mask long, fps array<long>, reps array<long>")


def _inner_nodes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.arange(0, len(fps), INNER)
    low, high = np.bitwise_and.reduceat(fps, cuts), np.bitwise_or.reduceat(fps, cuts)
    return low, ~(low ^ high)


def linked_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between fingerprints in ``a`` and ``b`` (or within ``a``).

    Indexes of ``b`` follow those of ``a``.  Pairs of inner nodes are pruned by
    the differences in the bits both share before any member is compared.
    """
    other = a if b is None else b
    shift = 0 if b is None else len(a)
    low_a, mask_a = _inner_nodes(a)
    low_b, mask_b = (low_a, mask_a) if b is None else _inner_nodes(b)
    differ = np.bitwise_count((mask_a[:, None] & mask_b[None, :]) & (low_a[:, None] ^ low_b[None, :]))
    pairs = np.argwhere(differ <= radius)
    if b is None:
        pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
    parent = list(range(shift + len(other)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for p, q in pairs.tolist():
        x, y = a[p * INNER : (p + 1) * INNER], other[q * INNER : (q + 1) * INNER]
        near = np.argwhere(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
        for i, j in near.tolist():
            i, j = p * INNER + i, shift + q * INNER + j
            if (r := root(i)) != (s := root(j)):
                parent[s] = r
                forest.append((i, j))
    return forest


def links(entries: DataFrame, radius: int = 4, leaf: int = LEAF, blocks: int | None = None) -> DataFrame:
    """``src, dst``: links between ``rep`` ids of ``entries`` (``fp, rep``), enough to join every component."""
    nodes = stage_table(leaf_nodes(entries, radius, blocks or blocks_for(entries.count(), radius, leaf), leaf), "gray-nodes")
    right = nodes.select("index_no", "front", *(F.col(c).alias(f"{c}_b") for c in ("leaf_no", "shared", "mask", "fps", "reps")))
    differ = F.bit_count(F.col("mask").bitwiseAND(F.col("mask_b")).bitwiseAND(F.col("shared").bitwiseXOR(F.col("shared_b"))))
    pairs = nodes.join(right, ["index_no", "front"]).where((F.col("leaf_no") <= F.col("leaf_no_b")) & (differ <= radius))
    # A single entry has no partner within its own leaf.
    pairs = pairs.where((F.col("leaf_no") < F.col("leaf_no_b")) | (F.size("fps") > 1))
    pairs = pairs.select((F.col("leaf_no") == F.col("leaf_no_b")).alias("same"), "fps", "reps", F.when(F.col("leaf_no") < F.col("leaf_no_b"), F.col("fps_b")).alias("fps_b"), F.when(F.col("leaf_no") < F.col("leaf_no_b"), F.col("reps_b")).alias("reps_b"))

    def run(batches):
        for batch in batches:
            src, dst = [], []
            for same, fps, reps, fps_b, reps_b in zip(*(batch.column(k) for k in range(5))):
                a, ids = np.asarray(fps.values).view(np.uint64), np.asarray(reps.values)
                if same.as_py():
                    b = None
                else:
                    b, ids = np.asarray(fps_b.values).view(np.uint64), np.concatenate((ids, np.asarray(reps_b.values)))
                for i, j in linked_forest(a, b, radius):
                    src.append(int(ids[i]))
                    dst.append(int(ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return pairs.mapInArrow(run, "src long, dst long")


def _placed(docs: DataFrame, radius: int, shingle: int, seed: int) -> DataFrame:
    own = stage_table(fingerprints(docs, shingle, seed), "fingerprints")
    entries = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = connected_components(links(entries.where("rep is not null"), radius))
    named = entries.join(joined, entries["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, "fp")


def components(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs`` (``doc_id, text``; other columns are ignored).

    Null and empty texts have fingerprint 0 and are linked like any other.
    Repeated doc_ids give one row each; an empty table gives an empty result.
    Rows with a null doc_id link nothing: they have the component of the documents
    with the same fingerprint, else a null one.
    """
    return _placed(docs, radius, shingle, seed).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, all columns kept.

    A row goes if the component of its own text has a smaller doc_id, so rows that
    share a doc_id are judged each by its text, and repeated rows of a kept document
    stay all.  Rows with a null doc_id stay.  Null texts are one component with
    empty ones.
    """
    drop = _placed(docs, radius, shingle, seed).where("doc_id <> component_id").select("doc_id", "text_key").distinct()
    rows, gone = "rows_to_keep", "rows_that_go"  # names of the tables, so that no column's can clash
    same = (F.col(f"{rows}.doc_id") == F.col(f"{gone}.doc_id")) & (_text_key(F.col(f"{rows}.text")) == F.col(f"{gone}.text_key"))
    return docs.alias(rows).join(drop.alias(gone), same, "left_anti")
