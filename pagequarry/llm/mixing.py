"""Mixing sources to target weights by capped water-filling.

Every source gets a share by its weight, but no more than a number of epochs of what
it has; what is above goes to the others by their weights, again until no
source is above its cap.  Shares become repetitions: every document of a source as
often as its whole epochs say, and once more a seeded draw of them that makes up the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage_table

#: The characters that part words.
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column | str) -> Column:
    """Number of words of a text, 0 for a null one."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(_WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``: 0, 1, 2, ... in order of ``source`` by code point, null last.

    Places are counted within sorted ranges and shifted by the ranges' sizes, a
    number each, so that no task sees all sources.
    """
    ranges = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    # An id counts up within a partition, whose number stands in its upper bits.
    numbered = stage_table(ranges.withColumn("at", F.monotonically_increasing_id()), "source-places")
    of_range = F.shiftright("at", 33).alias("range_no")
    sizes = numbered.groupBy(of_range).agg(F.count("*").alias("n"))
    first = sizes.select("range_no", (F.sum("n").over(W.orderBy("range_no")) - F.col("n")).alias("first"))
    placed = numbered.withColumn("range_no", of_range).join(F.broadcast(first), "range_no")  # a row each range, as many as shuffle partitions
    return placed.select(*sources.columns, (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def water_fill(sources: DataFrame, total: float, epochs: float = 2.0) -> DataFrame:
    """``sources`` (``source_size, weight``, others kept) with ``target``, which sum to ``total``.

    Targets are as the weights, but at most ``epochs`` times a source's size: sources
    above it are clamped there and the excess goes to the others by weight, round by
    round until none is above.  A round is one aggregation of ``sources``; three
    numbers of it come to the driver, and all that rounds hand on is the level, a
    target for each unit of weight.  Where all caps together are below ``total`` all
    are reached.  Weights that are null or not above 0 get nothing.
    """
    cap, weight = F.col("source_size") * F.lit(float(epochs)), F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    level, clamped = 0.0, -1
    while True:
        full = (weight > 0) & (cap <= weight * F.lit(level)) if clamped >= 0 else F.lit(False)
        row = sources.agg(
            F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~full & (weight > 0), weight)), F.lit(0.0)).alias("weights")
        ).first()
        if row["n"] == clamped:
            break
        clamped = row["n"]
        if row["weights"] == 0:
            level = math.inf
            break
        level = (total - row["held"]) / row["weights"]
    filled = F.when(weight > 0, F.least(cap, weight * F.lit(level))).otherwise(0.0)
    return sources.withColumn("target", F.when(F.lit(math.isinf(level)), F.when(weight > 0, cap).otherwise(0.0)).otherwise(filled))


def _cuts(rows: DataFrame, shares: DataFrame, bits: int) -> DataFrame:
    """``source, cut``: the last place in a source's seeded order that is still drawn (null: none).

    Sizes are summed by source and the hash's first hex digits, a combining aggregation
    that no hot source burdens; a running sum over those sums finds the group that the
    share's end falls into, and only its rows are ordered one by one.
    """
    group = F.substring("place", 1, bits // 4)
    sums = rows.groupBy("source", group.alias("g")).agg(F.sum("size").alias("sum"))
    by_source = W.partitionBy("source")
    running = sums.select("source", "g", "sum", (F.sum("sum").over(by_source.orderBy("g")) - F.col("sum")).alias("before"))
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    wanted = running.alias("r").join(shares.alias("s"), same).where("s.wanted > 0 AND s.wanted >= r.before AND s.wanted < r.before + r.sum").select("r.source", "r.g", "r.before", "s.wanted")
    crossing = rows.withColumn("g", group).alias("d").join(wanted.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.g") == F.col("s.g")))
    units = crossing.groupBy("d.source", "d.place", "s.before", "s.wanted").agg(F.sum("d.size").alias("size"))
    upto = F.col("before") + F.sum("size").over(by_source.orderBy("place"))
    ends = units.select("source", "place", "wanted", "size", upto.alias("upto"))
    # The unit that crosses the share's end is drawn if that comes nearer.
    taken = ends.where(F.col("upto") - F.col("size") / 2 <= F.col("wanted")).groupBy("source").agg(F.max("place").alias("last"))
    border = wanted.select("source", F.col("g").alias("from"))
    joined = border.alias("b").join(taken.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")), "left")
    # Nothing of the group itself: all groups before it, whose places sort below its digits.
    return joined.select("b.source", F.coalesce("t.last", "b.from").alias("cut"))


def mix(rows: DataFrame, weights: DataFrame | None = None, cycle: tuple[float, ...] = (1.0,), share: float = 1.5, epochs: float = 2.0, seed: int = 42, key: tuple[str, ...] = ("doc_id",), bits: int = 16) -> DataFrame:
    """``rows`` (``source, size`` and the columns of ``key``) with ``source_size, target, repeats, taken``.

    The mix takes ``share`` times the sum of all sizes.  Weights stand in ``weights``
    (``source, weight``), or repeat ``cycle`` over the sources in order of code point,
    null last.  A row is taken ``repeats`` times, ``taken`` is that many sizes: the
    whole epochs of its source's target, and once more if its place in the order by
    hash of seed and key is among the first that make up the rest.  So a source's
    sum is off its target by half a row's size at most, and runs agree.

    Rows that share source and key are drawn together.  A null source is a
    source, null sizes are 0, null keys count as ``~``; an empty table stays empty; columns named as the new ones give way to them.
    Sources are joined by their name, so that the optimizer broadcasts them while they are few; nothing but numbers is collected.
    """
    made = ("source_size", "target", "repeats", "taken")
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in made)).alias("own")
    place = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in key)), 256), 1, 32)
    placed = rows.select(own, F.col("source"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), place.alias("place"))
    sums = stage_table(placed.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    if weights is None:
        each = F.array(*(F.lit(float(w)) for w in cycle))
        weighed = ranked(sums).withColumn("weight", F.get(each, (F.col("place") % len(cycle)).cast("int"))).drop("place")
    else:
        same = F.col("a.source").eqNullSafe(F.col("b.source"))
        weighed = sums.alias("a").join(weights.select("source", "weight").alias("b"), same, "left").select("a.source", "a.source_size", "b.weight")
    filled = water_fill(stage_table(weighed, "source-weights"), share * total, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = _cuts(placed.select("source", "size", "place"), filled.select("source", "wanted"), bits)
    shares = filled.alias("a").join(cuts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", "b.cut")
    shares = stage_table(shares, "source-shares")
    more = F.coalesce(F.col("d.place") <= F.col("s.cut"), F.lit(False)).cast("long")
    found = placed.alias("d").join(shares.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.own", "d.size", "s.source_size", "s.target", (F.col("s.whole") + more).alias("repeats"))
    return found.select("own.*", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: rows of :func:`mix` as often as they are taken, with ``copy`` from 1 on."""
    return mixed.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
