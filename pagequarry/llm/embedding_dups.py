"""Near-duplicate embeddings by sorted projection passes.

A pass draws random hyperplanes, concatenates the signs of a vector's
projections to one code, sorts all vectors by their codes and compares each with
the neighbours in a window (range-partitioned, so a sort of any size).  Pairs of
high cosine share long prefixes and are neighbours in some pass.  Verified pairs
of all passes are united; a task returns only a spanning forest of what it found.

How many links a vector has is then counted exactly within each component, in
blocks of vectors against blocks, so that the windows' bound loses no link of a
large group.  What can be lost is a component's only tie: that of two vectors
which no pass brought within a window.  Two vectors at angle ``a`` share a
code's first ``b`` bits with probability ``(1 - a / pi) ** b``, and meet at about
``b = log2(n / window)``; at cosine 0.9, 50 thousand vectors, 24 passes and a
window of 64 that leaves less than one pair of a hundred.  More vectors, or a
dense region of them, crowd a pair's neighbourhood: all vectors are counted around
some out of the fullest cells of codes, and passes and window grow until the same
holds for the densest of these.  (To subtract the mean of a region doesn't help: it widens the angles of links as well.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, stage_table

BITS = 60


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _kind(df: DataFrame) -> str:
    """Component type that loses nothing: float for floats, else double."""
    kind = df.schema["embedding"].dataType
    return "float" if kind.simpleString() == "array<float>" else "double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def _usable(vector: str):
    c = F.col(vector)
    finite = ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``rep, n, embedding``: usable vectors without exact copies, the smallest vec_id and the number of each."""
    return vectors.where(_usable("embedding")).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))


def _codes(entries: DataFrame, passes: int, seed: int) -> DataFrame:
    """``dim, pass, code, rep, embedding``: every vector once for each pass."""

    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                unit = _unit(_matrix(part.column(1)))
                for k in range(passes):
                    planes = np.random.default_rng([seed, k, dim]).standard_normal((dim, BITS))
                    bits = (unit @ planes > 0).astype(np.int64)
                    code = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array(code), part.column(0), part.column(1)], names=["dim", "pass", "code", "rep", "embedding"]
                    )

    return entries.select("rep", "embedding").mapInArrow(run, f"dim int, pass int, code long, rep long, embedding array<{_kind(entries)}>")


def _forest(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs.tolist():
        if ids[i] != ids[j] and (a := root(i)) != (b := root(j)):
            parent[b] = a
            out.append((int(ids[i]), int(ids[j])))
    return out


#: Angles are counted in steps of a quarter of a degree.
_STEPS = 720


def _dense_vectors(entries: DataFrame, seed: int, each: int = 24) -> dict[int, np.ndarray]:
    """For each length of vectors some hundred unit vectors at most, out of the fullest cells by counts over all ``entries``.

    A cell holds the vectors that share the first bits of a pass's code, for several
    numbers of bits in each of four passes; ``each`` cells of every kind are taken.
    """
    codes = _codes(entries, 4, seed).select("dim", "pass", "code", "rep")
    depths = F.array(*(F.struct(F.lit(b).alias("bits"), F.shiftright("code", BITS - b).alias("cell")) for b in (4, 8, 12, 16, 20)))
    cells = codes.select("dim", "pass", "rep", F.inline(depths)).groupBy("dim", "pass", "bits", "cell").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    place = F.row_number().over(W.partitionBy("dim", "pass", "bits").orderBy(F.desc("n"), "cell"))
    fullest = cells.withColumn("place", place).where(F.col("place") <= each).select("rep").distinct()
    vectors: dict[int, list] = {}
    for r in entries.join(fullest, "rep", "left_semi").orderBy("rep").select("embedding").collect():
        vectors.setdefault(len(r["embedding"]), []).append(r["embedding"])
    return {dim: _unit(np.array(v, dtype=np.float64)) for dim, v in vectors.items()}


def _crowds(entries: DataFrame, probes: dict[int, np.ndarray], cosine: float) -> dict[int, np.ndarray]:
    """For each of ``probes`` how many of all ``entries`` lie at each step of angle, links left out."""

    def run(batches):
        counts = {dim: np.zeros((len(p), _STEPS + 1), dtype=np.int64) for dim, p in probes.items()}
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                rows = batch.column(0).slice(k, 1024)
                sizes = np.asarray(rows.value_lengths())
                for dim in np.unique(sizes).tolist():
                    cos = np.clip(probes[dim] @ _unit(_matrix(rows.filter(pa.array(sizes == dim)))).T, -1, 1)
                    at = np.floor(np.arccos(cos) / np.pi * _STEPS).astype(np.int64) + (np.arange(len(cos)) * (_STEPS + 1))[:, None]
                    counts[dim] += np.bincount(at[cos < cosine], minlength=counts[dim].size).reshape(counts[dim].shape)
        for dim, found in counts.items():
            probe, step = np.nonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(probe), dim, dtype=np.int32)), pa.array(probe.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(found[probe, step])], names=["dim", "probe", "step", "n"]
            )

    out = {dim: np.zeros((len(p), _STEPS + 1)) for dim, p in probes.items()}
    for r in entries.select("embedding").mapInArrow(run, "dim int, probe int, step int, n long").groupBy("dim", "probe", "step").agg(F.sum("n").alias("n")).collect():
        out[r["dim"]][r["probe"], r["step"]] = r["n"]
    return out


def _meeting(crowd: np.ndarray, cosine: float, window: int) -> float:
    """The least chance, over vectors around which others lie as ``crowd`` says, that a pass brings a link within the window.

    A pair that shares ``b`` bits is among the vectors that share them: of those at
    an angle a part of ``(1 - angle / pi) ** b``.  Links aren't counted, as they lead to each other.
    """
    same, stay = 1 - np.arange(_STEPS + 1) / _STEPS, 1 - np.arccos(cosine) / np.pi
    best = np.zeros(len(crowd))
    for b in range(BITS + 1):
        best = np.maximum(best, stay**b * np.minimum(1, window / np.maximum(crowd @ same**b, 1)))
    return float(best.min())


def effort(entries: DataFrame, cosine: float, passes: int, window: int, seed: int, lost: float = 0.01) -> tuple[int, int]:
    """Passes and window, the given ones at least, that lose no more than ``lost`` of the single links at ``cosine``.

    All vectors are counted, around those that stand where they lie densest.
    """
    probes = _dense_vectors(entries, seed)
    crowds = _crowds(entries, probes, cosine) if probes else {}
    found = []
    for w in (window, 2 * window, 4 * window, 8 * window):
        chance = min((_meeting(crowd, cosine, w) for crowd in crowds.values()), default=1.0)
        turns = passes if chance >= 1 else max(passes, int(np.ceil(np.log(lost) / np.log1p(-chance))))
        found.append((turns * (1 + w / 256), turns, w))  # a row of a pass costs as much as some 256 comparisons
    return min(found)[1:]


def links(entries: DataFrame, cosine: float = 0.9, passes: int = 24, window: int = 64, seed: int = 7) -> DataFrame:
    """``src, dst`` between ``rep`` ids: verified pairs that unite what the passes found.

    The first and last rows of each sorted range are compared across its borders.
    """
    ordered = _codes(entries, passes, seed).repartitionByRange("dim", "pass", "code").sortWithinPartitions("dim", "pass", "code", "rep")

    def run(batches):
        kept, part, head = None, TaskContext.get().partitionId(), window

        def border(rows, k):
            n = rows.num_rows
            return pa.RecordBatch.from_arrays(
                [rows.column(3), pa.nulls(n, pa.int64()), pa.array([k] * n, pa.int32()), rows.column(0), rows.column(1), rows.column(4)], names=["src", "dst", "border", "dim", "pass", "embedding"]
            )

        for batch in batches:
            if head and batch.num_rows:
                yield border(batch.slice(0, head), part - 1)
                head -= min(head, batch.num_rows)
            rows = pa.Table.from_batches(([kept] if kept is not None else []) + [batch]).combine_chunks().to_batches()
            if not rows:
                continue
            rows = rows[0]
            kept = rows.slice(max(0, rows.num_rows - window))
            dims, turns, ids = (np.asarray(rows.column(c)) for c in (0, 1, 3))
            found = []
            cuts = np.flatnonzero(np.diff(dims, prepend=-1).astype(bool) | np.diff(turns, prepend=-1).astype(bool))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], rows.num_rows).tolist()):
                unit = _unit(_matrix(rows.column(4).slice(a, b - a)))
                for k in range(0, b - a, window):
                    near = np.argwhere(unit[k : k + window] @ unit[k : k + 2 * window].T >= cosine)
                    near = near[near[:, 0] < near[:, 1]] + (a + k)
                    found += _forest(ids[a + k : a + k + 2 * window], near - (a + k))
            src, dst = zip(*found) if found else ((), ())
            none = [pa.nulls(len(src), t) for t in (pa.int32(), pa.int32(), pa.int32(), rows.column(4).type)]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), *none], names=["src", "dst", "border", "dim", "pass", "embedding"])
        if kept is not None:
            yield border(kept, part)

    def across(group: pa.Table) -> pa.Table:
        dims, turns, ids = (np.asarray(group.column(c)) for c in ("dim", "pass", "src"))
        found = []
        for dim, turn in sorted(set(zip(dims.tolist(), turns.tolist()))):
            own = np.flatnonzero((dims == dim) & (turns == turn))
            unit = _unit(_matrix(group.column("embedding").take(pa.array(own)).combine_chunks()))
            near = np.argwhere(unit @ unit.T >= cosine)
            found += _forest(ids[own], near[near[:, 0] < near[:, 1]])
        src, dst = zip(*found) if found else ((), ())
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    found = stage_table(ordered.mapInArrow(run, f"src long, dst long, border int, dim int, pass int, embedding array<{_kind(entries)}>"), "vector-links")
    borders = found.where("border is not null").groupBy("border").applyInArrow(across, "src long, dst long")
    return found.where("border is null").select("src", "dst").unionByName(borders).distinct()


def count_links(members: DataFrame, cosine: float = 0.9, block: int = 256, cell: int = 32) -> DataFrame:
    """``rep, linked``: vectors (copies counted) linked to each of ``members`` (``component, rep, n, embedding``), others than itself.

    Every pair of a component is compared, block against block; blocks are cut from
    sorted ranges.  A component's blocks are dealt to groups of about ``cell``, and blocks
    meet by cell of the grid of groups, so that no key holds a large component: the
    pairs of two groups, or those within one, are a cell.
    """
    ordered = members.select("component", "rep", "n", "embedding").repartitionByRange("component", "rep").sortWithinPartitions("component", "rep")

    def cut(batches):
        part, made = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            component = np.asarray(batch.column(0))
            starts = np.flatnonzero((np.diff(component, prepend=-1) != 0) | (np.arange(len(component)) % block == 0))
            offsets = pa.array(np.append(starts, len(component)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(k)) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(component[starts]), pa.array(part + made + np.arange(len(starts))), *lists], names=["component", "part", "rep", "n", "v"])
            made += len(starts)

    blocks = stage_table(ordered.mapInArrow(cut, f"component long, part long, rep array<long>, n array<long>, v array<array<{_kind(members)}>>"), "vector-blocks")
    large = blocks.groupBy("component").agg(F.ceil(F.count("*") / cell).cast("int").alias("groups")).where("groups > 1")
    dealt = blocks.join(large, "component", "left").withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("part"), F.col("groups")).cast("int"))
    first = dealt.select("component", F.col("own").alias("g"), F.explode(F.sequence("own", F.col("groups") - 1)).alias("g_b"), "part", "rep", "n", "v")
    other = dealt.select("component", F.explode(F.sequence(F.lit(0), "own")).alias("g"), F.col("own").alias("g_b"), F.col("part").alias("part_b"), F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("v").alias("v_b"))
    pairs = first.join(other, ["component", "g", "g_b"]).where("g < g_b or part <= part_b")

    def run(batches):
        for batch in batches:
            reps, linked = [], []
            for same, rep, n, v, rep_b, n_b, v_b in zip(*(batch.column(k) for k in range(7))):
                ids, sizes, a = np.asarray(rep.values), np.asarray(n.values), _unit(_matrix(v.values))
                if same.as_py():
                    near = a @ a.T >= cosine
                    np.fill_diagonal(near, False)
                    reps.append(ids)
                    linked.append(near @ sizes)
                else:
                    ids_b, sizes_b, b = np.asarray(rep_b.values), np.asarray(n_b.values), _unit(_matrix(v_b.values))
                    near = a @ b.T >= cosine
                    reps += [ids, ids_b]
                    linked += [near @ sizes_b, near.T @ sizes]
            none = [np.empty(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps + none)), pa.array(np.concatenate(linked + none).astype(np.int64))], names=["rep", "linked"])

    found = pairs.select((F.col("part") == F.col("part_b")).alias("same"), "rep", "n", "v", "rep_b", "n_b", "v_b").mapInArrow(run, "rep long, linked long")
    return found.groupBy("rep").agg(F.sum("linked").alias("linked"))


def components(vectors: DataFrame, cosine: float = 0.9, passes: int = 24, window: int = 64, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding``).

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing, nor do vectors of different lengths.  Other columns are
    ignored; repeated rows are vectors of their own.  A vector with a null vec_id
    counts as a copy of those with its components, and is no component's smallest.
    ``passes`` and ``window`` are the least; see :func:`effort`.
    """
    vectors = vectors.select("vec_id", F.col("embedding").cast(f"array<{_kind(vectors)}>").alias("embedding"))
    entries = stage_table(distinct_vectors(vectors), "distinct-vectors")
    named = entries.where("rep is not null")
    passes, window = effort(named, cosine, passes, window, seed)
    joined = stage_table(connected_components(links(named, cosine, passes, window, seed)), "vector-components")
    counted = count_links(joined.join(entries, joined["node"] == entries["rep"]).select("component", "rep", "n", "embedding"), cosine)
    classes = (
        entries.join(joined, entries["rep"] == joined["node"], "left")
        .join(counted, "rep", "left")
        .select("embedding", F.coalesce("component", "rep").alias("component_id"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    out = vectors.join(classes, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
