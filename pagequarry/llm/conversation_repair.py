"""Conversations brought to the order ``system? (user assistant)+`` by the cheapest edits.

Rows are reduced to a few bytes (the role's initial, a fault, digests) before anything is
ordered, so what is sorted and grouped is small.  The ordered rows of a conversation
are cut into *pieces* of bounded length; a conversation that is very long, even one
with a third of all rows, is many pieces in many tasks.

Costs of pieces are worked out by dynamic programming over time-major NumPy tensors:
pieces of like length are put side by side, and a step updates the costs of all
states of all of them for one turn.  Costs run backward, from a piece's end to its start, and
are stored, so that the trace goes forward through all pieces at once and takes
at each turn the first letter, in ASCII order, that lies on a cheapest way.

A conversation of several pieces needs one step more on either side: a piece's costs
from each state to each (16 numbers) are combined backward along the conversation
to the costs that each piece ends with, and where each piece leads from each state
(4 numbers) forward to the state that it begins in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage_table

#: Characters that count as blank, and those that end a text well.
_BLANK, _STOPS = r"\x20\x09-\x0D", ".!?"
#: States: nothing yet; after a system row; after a user row; after an assistant row. Where an inserted or renamed row leads, and its role.
_NEXT = np.array([2, 2, 3, 2])
_ROLE = np.array(["user", "user", "assistant", "user"])
#: Costs to come at a conversation's end: what must still be inserted there, by state.
_FINAL = np.array([0, 6, 3, 0], dtype=np.int64)
_TAIL = [[], ["user", "assistant"], ["assistant"], []]
#: Roles of one or two rows put in, by the state that they lead to.
_PUT_IN = {(2, 1): ("user",), (3, 1): ("assistant",), (3, 2): ("user", "assistant"), (2, 2): ("assistant", "user")}
_FAR = np.int64(1 << 50)
_DELETE, _INSERT, _RENAME, _CUT_OFF = 4, 3, 3, 3


def _word(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of ``conversations`` after seeded damage, by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes the ends of its sentences, 3 repeats it, 4 makes
    its role user.  Nulls in texts, roles and the hashed string are a space each.
    """
    rows = conversations.select("conv_id", "turn", _word(F.col("role")).alias("role"), _word(F.col("text")).alias("text"))
    kind = F.crc32(F.concat(_word(F.col("conv_id")), F.lit(":"), _word(F.col("turn")))) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, said, key``: a digest of role and text, and one of the whole row."""
    said = F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _word(F.col("role")).alias("role"), _word(F.col("text")).alias("text")).withColumn("said", said)
    place = F.concat(_word(F.col("conv_id")), F.lit(":"), _word(F.col("turn")), F.lit(":"))
    return rows.withColumn("key", F.unhex(F.md5(F.concat(F.encode(place, "UTF-8"), "said"))))


def _faults(keyed: DataFrame) -> DataFrame:
    """One narrow row for each different row: ``conv_id, turn, role, said, key, initial, fault, n``; ``n`` counts the rows that are equal.

    ``fault``: ``b`` blank, ``d`` said by an earlier row, ``t`` truncated, else ``-``.  Equal rows are counted before they are shuffled.
    """
    last = F.substring(F.regexp_extract("text", rf"([^{_BLANK}])[{_BLANK}]*\z", 1), -1, 1)
    fault = F.when(last == "", "b").when(~F.contains(F.lit(_STOPS), last), "t").otherwise("-")
    narrow = keyed.select("conv_id", "turn", "role", "said", "key", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    distinct = narrow.groupBy("key").agg(*(F.first(c).alias(c) for c in ("conv_id", "turn", "role", "said", "initial", "fault")), F.count("*").alias("n"))
    distinct = stage_table(distinct, "turns")
    # The first turn of all that say the same: nulls come first.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = distinct.groupBy("conv_id", "said").agg(F.min(turn).alias("first"), F.count("*").alias("m")).where("m > 1")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.said") == F.col("b.said"))
    later = F.col("b.first").isNotNull() & ~F.struct(F.col("a.turn").isNotNull(), "a.turn").eqNullSafe(F.col("b.first"))
    found = distinct.alias("a").join(firsts.alias("b"), same, "left")
    return found.select("a.conv_id", "a.turn", "a.role", "a.said", "a.key", "a.initial", F.when((F.col("a.fault") != "b") & later, "d").otherwise(F.col("a.fault")).alias("fault"), "a.n")


_PIECE = "conv_id long, part int, seq long, turns array<long>, keys array<binary>, initials array<string>, faults string, n array<long>"


def _pieces(narrow: DataFrame, longest: int) -> DataFrame:
    """The rows in order, cut into pieces of one conversation and at most ``longest`` rows; ``part, seq`` give the pieces' order."""
    order = ["conv_id", "turn", "role", "said"]
    ordered = narrow.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*order)
    names = ["conv_id", "turn", "key", "initial", "fault", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        now: list[tuple] = []
        out: list[tuple] = []

        def piece() -> None:
            nonlocal seq
            columns = list(zip(*now))
            out.append((columns[0][0], part, seq, list(columns[1]), list(columns[2]), list(columns[3]), "".join(columns[4]), list(columns[5])))
            seq += 1
            now.clear()

        def batch_of() -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.string()), pa.string(), pa.list_(pa.int64())]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], names="conv_id part seq turns keys initials faults n".split())
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if now and (row[0] != now[-1][0] or len(now) >= longest):
                    piece()
                now.append(row)
            if len(out) >= 1024:
                yield batch_of()
        if now:
            piece()
        yield batch_of()

    return stage_table(ordered.select(*names).mapInArrow(run, _PIECE), "pieces")


# --- tensors --------------------------------------------------------------------


class _Bucket:
    """Pieces of like length side by side, by turn: ``step[t, c, q]`` is the state that keeping row t of piece c leads to from q, or -1."""

    def __init__(self, initials: list[list[str]], faults: list[str], n: list[list[int]]):
        self.length, self.count = max(map(len, faults)), len(faults)
        shape = (self.length, self.count)
        self.letter, self.fault = np.zeros(shape, dtype=np.int8), np.zeros(shape, dtype=np.int8)  # 0: beyond a piece's end
        self.more = np.zeros(shape, dtype=np.int64)
        codes = {"s": 1, "u": 2, "a": 3}
        for c, (i, f, k) in enumerate(zip(initials, faults, n)):
            m = len(f)
            self.letter[:m, c] = [codes.get(x, 4) for x in i]
            self.fault[:m, c] = ["-tbd".index(x) + 1 for x in f]
            self.more[:m, c] = np.array(k) - 1
        fits = np.full((5, 4), -1)
        fits[1, 0], fits[2, [0, 1, 3]], fits[3, 2] = 1, 2, 3
        self.keeps = fits[self.letter]
        self.row = self.fault > 0
        self.free = (self.fault == 1) | (self.fault == 2)
        self.extra = np.where(self.fault == 2, _CUT_OFF, 0).astype(np.int64)

    def choices(self, t: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs of deleting, keeping and renaming row t, by piece and state, if ``after`` are those behind it."""
        each = np.arange(self.count)[:, None]
        again = (_DELETE * self.more[t])[:, None]
        keeps = self.keeps[t]
        fixed = (again + self.extra[t][:, None]) + np.where(self.free[t], 0, _FAR)[:, None]
        keep = np.where(keeps >= 0, after[each, keeps], _FAR) + fixed
        return after + again + _DELETE, keep, after[:, _NEXT] + fixed + _RENAME

    def backward(self, end: np.ndarray) -> np.ndarray:
        """``costs[t, c, q]``: the least cost from before row t on, ``end`` being those behind the last."""
        costs = np.empty((self.length + 1, self.count, 4), dtype=np.int64)
        costs[-1] = end
        for t in range(self.length - 1, -1, -1):
            now = np.minimum.reduce(self.choices(t, costs[t + 1]))
            for _ in range(2):
                now = np.minimum(now, now[:, _NEXT] + _INSERT)
            costs[t] = np.where(self.row[t][:, None], np.minimum(now, _FAR), costs[t + 1])
        return costs

    def forward(self, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edits (D, K, R or nothing) and how many rows were inserted before, by turn; the states before the edits; the last states."""
        each = np.arange(self.count)
        edits = np.zeros((self.length, self.count), dtype="S1")
        inserted, states = np.zeros((self.length, self.count), dtype=np.int8), np.zeros((self.length, self.count), dtype=np.int8)
        state = state.copy()
        for t in range(self.length):
            delete, keep, rename = self.choices(t, costs[t + 1])
            left = self.row[t].copy()
            for _ in range(3):
                want = costs[t, each, state]
                use_d = left & (delete[each, state] == want)
                use_i = left & ~use_d & (costs[t, each, _NEXT[state]] + _INSERT == want)
                use_k = left & ~use_d & ~use_i & (keep[each, state] == want)
                use_r = left & ~use_d & ~use_i & ~use_k & (rename[each, state] == want)
                states[t] = np.where(left, state, states[t])
                edits[t] = np.select([use_d, use_k, use_r], [b"D", b"K", b"R"], edits[t])
                inserted[t] += use_i
                state = np.select([use_i | use_r, use_k], [_NEXT[state], self.keeps[t, each, state]], state)
                left &= use_i
        return edits, inserted, states, state


def _buckets(columns: list[list], most: int = 1 << 18) -> Iterator[list[int]]:
    """Places of pieces, those of like length (up to the same power of two) together, at most ``most`` turns at a time."""
    by_length: dict[int, list[int]] = {}
    for k, f in enumerate(columns):
        by_length.setdefault(len(f).bit_length(), []).append(k)
    for bits, places in by_length.items():
        size = max(1, most >> bits)
        for k in range(0, len(places), size):
            yield places[k : k + size]


def _of(batch: pa.RecordBatch, places: list[int]) -> _Bucket:
    initials, faults, n = (batch.column(name).to_pylist() for name in ("initials", "faults", "n"))
    return _Bucket([initials[k] for k in places], [faults[k] for k in places], [n[k] for k in places])


def _between(pieces: DataFrame) -> DataFrame:
    """``conv_id, part, seq, costs``: the 16 least costs of each piece, from each state to each."""

    def run(batches):
        for batch in batches:
            costs = [None] * batch.num_rows
            for places in _buckets(batch.column("faults").to_pylist()):
                bucket = _of(batch, places)
                ends = []
                for q in range(4):
                    end = np.full((bucket.count, 4), _FAR)
                    end[:, q] = 0
                    ends.append(bucket.backward(end)[0])
                table = np.stack(ends, axis=2)  # piece, from, to
                for c, k in enumerate(places):
                    costs[k] = table[c].ravel()
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in ("conv_id", "part", "seq")), pa.array(costs, pa.list_(pa.int64()))], names=["conv_id", "part", "seq", "costs"])

    return pieces.select("conv_id", "part", "seq", "initials", "faults", "n").mapInArrow(run, "conv_id long, part int, seq long, costs array<long>")


def _traced(pieces: DataFrame, whole: bool) -> DataFrame:
    """Pieces with ``end`` (costs behind them), ``entry`` and ``final``, followed from their entry.

    ``conv_id, part, seq, entry, exit, cost, audit``, and with ``whole`` also ``edits``: a
    struct ``key, edit, role`` for each row kept in its place and each row put in (whose key is null).
    """
    edit = "edits array<struct<key:binary,edit:string,role:string>>"
    schema = f"conv_id long, part int, seq long, entry int, exit int, cost long, audit string{', ' + edit if whole else ''}"
    item = pa.list_(pa.struct([("key", pa.binary()), ("edit", pa.string()), ("role", pa.string())]))

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            exits, costs, audits, edits = [None] * m, [None] * m, [None] * m, [None] * m
            finals, keys = batch.column("final").to_pylist(), batch.column("keys").to_pylist() if whole else None
            entry = np.array(batch.column("entry").to_pylist(), dtype=np.int64)
            ends = np.array(batch.column("end").to_pylist(), dtype=np.int64).reshape(-1, 4)
            for places in _buckets(batch.column("faults").to_pylist()):
                bucket = _of(batch, places)
                back = bucket.backward(ends[places])
                letters, inserted, states, last = bucket.forward(back, entry[places])
                for c, k in enumerate(places):
                    m = int(bucket.row[:, c].sum())
                    codes = np.stack((np.full(m, b"I", dtype="S1"), letters[:m, c], np.full(m, b"D", dtype="S1")), axis=1)
                    counts = np.stack((inserted[:m, c], np.ones(m, dtype=np.int64), bucket.more[:m, c]), axis=1)
                    tail = _TAIL[last[c]] if finals[k] else []
                    audits[k] = np.repeat(codes.ravel(), counts.ravel()).tobytes().decode() + "I" * len(tail)
                    exits[k], costs[k] = int(last[c]), int(back[0, c, entry[k]])
                    if whole:
                        made = []
                        for t in np.flatnonzero((letters[:m, c] != b"D") | (inserted[:m, c] > 0)).tolist():
                            q, letter = int(states[t, c]), letters[t, c].decode()
                            made += [(None, "I", r) for r in _PUT_IN.get((q, int(inserted[t, c])), ())]
                            if letter != "D":
                                made.append((keys[k][t], letter, str(_ROLE[q]) if letter == "R" else None))
                        edits[k] = made + [(None, "I", r) for r in tail]
            arrays = [*(batch.column(name) for name in ("conv_id", "part", "seq", "entry")), pa.array(exits, pa.int32()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())]
            names = ["conv_id", "part", "seq", "entry", "exit", "cost", "audit"]
            if whole:
                arrays, names = [*arrays, pa.array(edits, item)], [*names, "edits"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pieces.select("conv_id", "part", "seq", "initials", "faults", "n", *(["keys"] if whole else []), "end", "entry", "final").mapInArrow(run, schema)


def _framed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the costs behind them (``end``), the state they begin in (``entry``), and whether they are their conversation's last (``final``)."""
    counts = pieces.groupBy("conv_id").agg(F.count("*").alias("m"), F.max(F.struct("part", "seq")).alias("last"))
    several = stage_table(counts.where("m > 1"), "long-conversations")
    if several.isEmpty():
        ends = F.array(*(F.lit(int(x)) for x in _FINAL)).cast("array<long>")
        return pieces.select(*pieces.columns, ends.alias("end"), F.lit(0).alias("entry"), F.lit(True).alias("final"))
    marked = pieces.alias("p").join(several.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")), "left").select("p.*", "s.last")
    marked = marked.withColumn("final", F.col("last").isNull() | (F.struct("part", "seq") == F.col("last")))
    alone = marked.where("last IS NULL").select(*pieces.columns, F.array(*(F.lit(int(x)) for x in _FINAL)).cast("array<long>").alias("end"), F.lit(0).alias("entry"), "final")
    parts = stage_table(marked.where("last IS NOT NULL").drop("last"), "long-pieces")
    here = ["conv_id", "part", "seq"]

    def back(matrices: Column) -> Column:
        """From the last piece's matrix to the first's: the costs behind each."""
        start = F.struct(F.array(*(F.lit(int(x)) for x in _FINAL)).cast("array<long>").alias("now"), F.array().cast("array<struct<part:int,seq:bigint,end:array<bigint>>>").alias("done"))

        def add(a: Column, x: Column) -> Column:
            costs = F.array(*(F.array_min(F.array(*(F.get(x["costs"], F.lit(4 * p + q)) + F.get(a["now"], F.lit(q)) for q in range(4)))) for p in range(4)))
            return F.struct(costs.alias("now"), F.array_append(a["done"], F.struct(x["part"].alias("part"), x["seq"].alias("seq"), a["now"].alias("end"))).alias("done"))

        return F.aggregate(F.reverse(matrices), start, add)["done"]

    matrices = _between(parts).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "costs"))).alias("x"))
    ends = matrices.select("conv_id", F.inline(back(F.col("x"))))
    same = F.col("p.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("p.part") == F.col("e.part")) & (F.col("p.seq") == F.col("e.seq"))
    ended = stage_table(parts.alias("p").join(ends.alias("e"), same).select("p.*", "e.end"), "ended-pieces")
    ways = _traced(ended.withColumn("entry", F.explode(F.array(*(F.lit(q) for q in range(4))))), whole=False)
    ways = ways.groupBy(*here).agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "exit"))), lambda x: x["exit"]).alias("exits"))

    def on(maps: Column) -> Column:
        start = F.struct(F.lit(0).alias("now"), F.array().cast("array<struct<part:int,seq:bigint,entry:int>>").alias("done"))
        return F.aggregate(maps, start, lambda a, x: F.struct(F.get(x["exits"], a["now"]).alias("now"), F.array_append(a["done"], F.struct(x["part"].alias("part"), x["seq"].alias("seq"), a["now"].alias("entry"))).alias("done")))["done"]

    entries = ways.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "exits"))).alias("x")).select("conv_id", F.inline(on(F.col("x"))))
    entered = ended.alias("p").join(entries.alias("e"), same).select("p.*", "e.entry")
    return alone.unionByName(entered.select(*alone.columns))


# --- results ----------------------------------------------------------------------


class Repair:
    """The repair of some rows (``conv_id, turn, role, text``); null roles and texts count as a space.

    A conversation's rows are ordered by turn (nulls first), rows of one turn by role and
    then by a digest.  Null ids are a conversation too; other columns are left out; an empty table
    has no conversations.  Long conversations are cut every ``longest`` rows.
    """

    def __init__(self, rows: DataFrame, longest: int = 4096):
        self.keyed = _keyed(rows)
        self.pieces = _pieces(_faults(self.keyed), longest)
        self.traced = stage_table(_traced(_framed(self.pieces), whole=True), "repairs")

    def edits(self) -> DataFrame:
        """``conv_id, part, seq, place, key, edit, role``: the rows kept and put in, in order of the three numbers."""
        return self.traced.select("conv_id", "part", "seq", F.posexplode("edits").alias("place", "e")).select("conv_id", "part", "seq", "place", "e.key", "e.edit", "e.role")

    def rows(self) -> DataFrame:
        """The repaired conversations: ``conv_id, part, seq, place, edit, turn, role, text``; rows put in have a null turn and an empty text."""
        edits = self.edits()
        once = self.keyed.select("key", "turn", "role", "text").groupBy("key").agg(*(F.first(c).alias(c) for c in ("turn", "role", "text")))
        kept = edits.where("key IS NOT NULL").alias("e").join(once.alias("r"), "key").select("conv_id", "part", "seq", "place", "edit", "r.turn", F.coalesce("e.role", "r.role").alias("role"), "r.text")
        put_in = edits.where("key IS NULL").select("conv_id", "part", "seq", "place", "edit", F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"))
        return kept.unionByName(put_in)

    def report(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation that has rows."""
        # Of n equal rows the first has the fault that stands there, the others are blank as well, or repeats.
        counts = {
            "blank": lambda n, f: F.when(f == "b", n).otherwise(0),
            "duplicate": lambda n, f: F.when(f == "b", 0).when(f == "d", n).otherwise(n - 1),
            "truncated": lambda n, f: (f == "t").cast("long"),
        }
        total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)
        pairs = F.zip_with(F.slice("initials", F.lit(1), F.size("initials") - 1), F.slice("initials", F.lit(2), F.size("initials") - 1), lambda a, b: F.concat(a, b))
        bad = lambda pair: ~pair.isin("su", "ua", "au")
        known = F.filter("turns", lambda t: t.isNotNull())
        piece = self.pieces.select(
            "conv_id", "part", "seq",
            *(total(F.zip_with("n", F.split("faults", ""), one)).alias(name) for name, one in counts.items()),
            (F.size(F.filter(pairs, bad)) + total(F.transform("n", lambda k: k - 1))).alias("illegal"),
            F.size(F.array_distinct(known)).cast("long").alias("turns"), F.array_min(known).alias("low"), F.array_max(known).alias("high"),
            F.element_at("initials", 1).alias("begins"), F.element_at("initials", -1).alias("ends"), F.element_at("turns", 1).alias("first"), F.element_at("turns", -1).alias("last"),
        )
        # Across two pieces of a conversation; a row a piece is all that a window sees.
        before = W.partitionBy("conv_id").orderBy("part", "seq")
        pair = F.concat(F.lag("ends").over(before), "begins")
        piece = piece.withColumn("border", F.coalesce(bad(pair), F.lit(False)).cast("long")).withColumn("shared", F.coalesce(F.lag("last").over(before) == F.col("first"), F.lit(False)).cast("long"))
        sums = piece.groupBy("conv_id").agg(
            F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("shared")), F.lit(0)).alias("gaps"),
            *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
            F.sum(F.col("illegal") + F.col("border")).cast("long").alias("illegal"),
        )
        audits = self.traced.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "audit", "cost"))).alias("x"))
        audits = audits.select("conv_id", F.get("x", F.lit(0))["cost"].alias("cost"), F.array_join(F.transform("x", lambda x: x["audit"]), "").alias("audit"))
        return sums.alias("s").join(audits.alias("a"), F.col("s.conv_id").eqNullSafe(F.col("a.conv_id"))).select("s.*", "a.cost", "a.audit")


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired rows: ``role:text`` in order, joined by newlines.

    A hash runs through a conversation from start to end, so each is one task's
    stream of sorted rows, of which one is held at a time.
    """
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "place").select("conv_id", "role", "text")

    def run(batches):
        now, begun, hash_ = None, False, hashlib.sha256()
        for batch in batches:
            out = []
            for conv_id, role, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if begun and conv_id != now:
                    out.append((now, hash_.hexdigest()))
                    hash_, begun = hashlib.sha256(), False
                hash_.update(("\n" if begun else "").encode() + f"{role.as_py()}:{text.as_py()}".encode("utf-8", "surrogatepass"))
                now, begun = conv_id, True
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([hash_.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def audited(conversations: DataFrame, longest: int = 4096) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation, after :func:`damaged`.

    Conversations of which the damage leaves nothing have zeros, no edits, and the hash of nothing.
    """
    repair = Repair(damaged(conversations), longest)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    found = ids.alias("i").join(repair.report().alias("r"), same("i", "r"), "left").join(digests(repair.rows()).alias("h"), same("i", "h"), "left")
    return found.select(
        "i.conv_id", *(F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
