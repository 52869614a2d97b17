import hashlib
import random
import re
import zlib
from functools import lru_cache

from pagequarry.llm import conversation_repair as R

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(said.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repair(rows):
    """Everything about one conversation's damaged rows, by trying all edits."""
    digest = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r)))
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, q):
        """(cost, audit, repaired) from row i in a state."""
        ways = []
        if i == len(rows):
            if q in (0, 3):
                return 0, "", ()
        else:
            role, text, fault = rows[i][2], rows[i][3], faults[i]
            more = 3 if fault == "truncated" else 0
            cost, audit, left = best(i + 1, q)
            ways.append((cost + 4, "D" + audit, left))
            if fault not in ("blank", "duplicate"):
                if (role[:1], q) in KEEPS:
                    cost, audit, left = best(i + 1, KEEPS[role[:1], q])
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}", *left)))
                cost, audit, left = best(i + 1, NEXT[q])
                ways.append((cost + 3 + more, "R" + audit, ("assistant:" + text if q == 2 else "user:" + text, *left)))
        # One row put in here; two at most are ever of use.
        for first in ([NEXT[q]], [NEXT[q], NEXT[NEXT[q]]]):
            if i == len(rows):
                if first[-1] == 3:
                    ways.append((3 * len(first), "I" * len(first), tuple("assistant:" if s == 3 else "user:" for s in first)))
            else:
                for cost, audit, left in taking(i, first[-1]):
                    ways.append((cost + 3 * len(first), "I" * len(first) + audit, (*("assistant:" if s == 3 else "user:" for s in first), *left)))
        return min(ways)

    def taking(i, q):
        role, text, fault = rows[i][2], rows[i][3], faults[i]
        more = 3 if fault == "truncated" else 0
        cost, audit, left = best(i + 1, q)
        yield cost + 4, "D" + audit, left
        if fault not in ("blank", "duplicate"):
            if (role[:1], q) in KEEPS:
                cost, audit, left = best(i + 1, KEEPS[role[:1], q])
                yield cost + more, "K" + audit, (f"{role}:{text}", *left)
            cost, audit, left = best(i + 1, NEXT[q])
            yield cost + 3 + more, "R" + audit, ("assistant:" + text if q == 2 else "user:" + text, *left)

    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit, left = best(0, 0)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(left).encode()).hexdigest(),
    )


def made(seed, n):
    random.seed(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(random.randint(1, 12)):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"]) if random.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = random.choice(["Yes.", "No!", "cut off", " \t", "", None, "Well? ", "Yes."])
            rows.append((conv, random.choice([turn, turn, turn + 3, None]) if random.random() < 0.3 else turn, role, text))
    return rows


def check(spark, rows, longest, partitions=3):
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(partitions)
    found = {r.conv_id: tuple(r)[1:] for r in R.audited(table, longest).collect()}
    groups = {c: [] for c, *_ in rows}
    for r in damage(rows):
        groups[r[0]].append(r)
    assert found == {c: repair(g) for c, g in groups.items()}
    return found


def test_against_all_edits(spark):
    rows = made(1, 150)
    rows += [(1000, k, "user", "Same.") for k in range(40)] + [(1001, 5, "user", "Same.")] * 30  # repeats, and one row many times
    rows += [(1002, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(60)]
    found = check(spark, rows, 4096)
    assert any("I" in x[6] for x in found.values()) and any("R" in x[6] for x in found.values())


def test_long_conversations_in_pieces(spark):
    rows = made(2, 25)
    rows += [(1002, k // 2, random.choice(["user", "assistant", "system"]), random.choice([f"Turn {k}.", "Again.", "cut"])) for k in range(90)]
    assert check(spark, rows, 3) == check(spark, rows, 7, 5) == check(spark, rows, 4096)


def test_repaired_rows(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in (0, 1, 3, 4)] + [(2, 0, "assistant", "Hi.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = R.Repair(table).rows().orderBy("conv_id", "part", "seq", "place").collect()
    by = {c: [(r.edit, r.role, r.text) for r in found if r.conv_id == c] for c in (1, 2)}
    assert by[1] == [("K", "user", "Turn 0."), ("K", "assistant", "Turn 1."), ("I", "user", ""), ("K", "assistant", "Turn 3."), ("K", "user", "Turn 4."), ("I", "assistant", "")]
    assert by[2] == [("I", "user", ""), ("K", "assistant", "Hi.")]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.audited(none).count() == 0
