"""URL rules judged through cascades of Bloom filters, without a join on the main path.

A rule is ``host/path``: it fits the host and all its subdomains where the
url's path starts with the rule's path; the longest fitting rule wins (of two
equally long ones, that with the longer host).

For each verdict a cascade encodes its rules.  Level 0 is a Bloom filter over
the listed keys.  Level 1 holds those keys of the corpus that level 0 takes for
listed though they aren't, level 2 the listed keys that level 1 takes for
false, and so on until a level errs on nothing.  A key is listed if the first
level without it is odd.  As the levels are built over every key that the
corpus can ask for, the answers are exact.

The filters' sizes follow the rule list, not the corpus: the first level's rate
of false positives is set so that as many corpus keys pass it as there are rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Host, path, verdict.
Rule = tuple[str, str, str]

#: Largest filter sent to the tasks, in bits; longer lists are looked up by a join.
MOST_BITS = 1 << 22

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#``; A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing: ``hashes`` bit numbers from two 64-bit hashes."""
    a, b = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(level), F.lit("second")), F.lit(bits))
    return [F.pmod(a + b * i, F.lit(bits)) for i in range(hashes)]


_ONE = [1 << k for k in range(63)] + [-(1 << 63)]


def _bit(place: Column) -> Column:
    return F.element_at(F.lit(_ONE), (F.pmod(place, F.lit(64)) + 1).cast("int"))


def _has(key: Column, number: int, level: Level) -> Column:
    """Whether a level's filter may hold the key."""
    words = F.lit(list(level.words))
    found = F.lit(True)
    for p in _positions(key, number, level.bits, level.hashes):
        found = found & (F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0)
    return found


def _filter_size(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    return bits, max(1, round(bits / max(n, 1) * math.log(2))) if n else 1


def _encode(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    """A level's filter over ``keys`` (``key``); only its words come to the driver."""
    bits, hashes = _filter_size(n, rate)
    hashes = min(hashes, 30)
    places = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("p"))
    words = [0] * (bits // 64)
    for w, v in places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(_bit(F.col("p"))).alias("v")).collect():
        words[w] = v
    return Level(tuple(words), bits, hashes)


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int, most_levels: int = 40) -> list[Level] | None:
    """Levels over ``listed`` and the corpus's keys (``key`` each, without repeats).

    None if the first filter would be larger than :data:`MOST_BITS`.
    """
    n = listed.count()
    if not n:
        return []
    rate = min(0.5, max(1e-9, n / max(1, n_universe)))
    if _filter_size(n, rate)[0] > MOST_BITS:
        return None
    levels = [_encode(listed, 0, n, rate)]
    wrong, other = universe.where(_has(F.col("key"), 0, levels[0])).join(listed, "key", "left_anti"), listed
    while len(levels) < most_levels:
        m = wrong.count()
        if not m:
            return levels
        if _filter_size(m, 0.5)[0] > MOST_BITS:
            return None
        number = len(levels)
        levels.append(_encode(wrong, number, m, 0.5))
        # Of the keys on the other side, those that this level takes for its own.
        wrong, other = other.where(_has(F.col("key"), number, levels[-1])), wrong
    raise RuntimeError("the cascade did not end")


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact membership of a key of the universe."""
    found = F.lit(bool(len(levels) % 2))
    for number in range(len(levels) - 1, -1, -1):
        found = F.when(_has(key, number, levels[number]), found).otherwise(F.lit(bool(number % 2)))
    return found


def _shapes(rules: list[Rule]) -> list[tuple[int, int]]:
    """(labels in the host, characters in the path) of the rules."""
    return sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})


def _candidates(rules: list[Rule]) -> list[Column]:
    """The keys that a row can ask for, null where its host or path is too short."""
    labels = F.size(F.split("host", r"\."))
    return [
        F.when((labels >= k) & (F.length("path") >= n), F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)))
        for k, n in _shapes(rules)
    ]


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` added; ``rule`` is null and ``verdict`` the default where none fits.

    Null urls and urls without ``://`` have an empty host and path, which no rule
    fits.  Columns of ``pages`` named like an added one are replaced.  Repeated
    rows stay repeated; a rule given twice must have one verdict.
    """
    spark = pages.sparkSession
    rules = sorted({(h.translate(str.maketrans(_UPPER, _LOWER)), p if p.startswith("/") else f"/{p}", v) for h, p, v in rules})
    if len({r[:2] for r in rules}) < len(rules):
        raise ValueError("a rule has two verdicts")
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not rules:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    shapes = _candidates(rules)
    # A key could be read as host and path in two ways only if a host held a slash, which none does.
    universe = out.select(F.explode(F.array_distinct(F.array_compact(F.array(*shapes)))).alias("key")).distinct()
    # The longest key first; of equal ones, the longer host.
    keys = F.array_sort(
        F.filter(F.array(*(F.struct((-F.length(c)).alias("n"), (-F.length(F.substring_index(c, "/", 1))).alias("m"), c.alias("key")) for c in shapes)), lambda s: s["key"].isNotNull())
    )
    verdicts = sorted({v for _, _, v in rules})
    tables = {v: spark.createDataFrame([(h + p,) for h, p, w in rules if w == v], "key string") for v in verdicts}
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]
    cascades = {v: build_cascade(tables[v], universe, n_universe) for v in verdicts}
    if any(c is None for c in cascades.values()):
        return _judge_by_join(out, rules, keys, default)
    tests = {v: (lambda s, c=cascades[v]: is_listed(s["key"], c)) for v in verdicts}
    any_listed = F.filter(keys, lambda s: _any([tests[v](s) for v in verdicts]))
    out = out.withColumn("rule", F.get(any_listed, F.lit(0))["key"])
    verdict = F.lit(default)
    for v in verdicts:
        verdict = F.when(F.col("rule").isNotNull() & is_listed(F.col("rule"), cascades[v]), F.lit(v)).otherwise(verdict)
    return out.withColumn("verdict", verdict)


def _any(tests: list[Column]) -> Column:
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def _judge_by_join(out: DataFrame, rules: list[Rule], keys: Column, default: str) -> DataFrame:
    """For lists too long to send to every task: each row's keys are looked up by joins, longest first."""
    listed = out.sparkSession.createDataFrame([(h + p, v) for h, p, v in rules], "key string, v string")
    names = out.columns
    own = F.struct(*(F.col(f"`{c}`") for c in names)).alias("own")
    out = out.select(own, keys.alias("_keys"))
    out = out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    for k in range(len(_shapes(rules))):
        found = listed.select(F.col("key").alias("_key"), F.col("v").alias("_v"))
        out = out.withColumn("_k", F.when(F.col("rule").isNull(), F.get("_keys", F.lit(k))["key"]))
        out = out.join(found, F.col("_k") == F.col("_key"), "left")
        out = out.withColumns({"rule": F.coalesce("rule", "_key"), "verdict": F.coalesce("verdict", "_v")}).drop("_k", "_key", "_v")
    kept = [F.col(f"own.`{c}`") for c in names if c.lower() not in ("rule", "verdict")]
    return out.select(*kept, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
