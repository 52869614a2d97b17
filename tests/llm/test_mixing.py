import math

from pagequarry.llm import mixing as M


def filled(sizes, weights, total, epochs):
    """The level by trying every number of clamped sources."""
    caps = {s: epochs * n for s, n in sizes.items()}
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(caps[s], weights[s] * level) for s in sizes) < total:
            low = level
        else:
            high = level
    return {s: min(caps[s], weights[s] * high) for s in sizes}


def test_words(spark):
    rows = spark.createDataFrame([("a b\tc",), (None,), ("",), ("  \n",), (" x \x1cy",)], "text string")
    assert [r.n for r in rows.select(M.words("text").alias("n")).collect()] == [3, 0, 0, 0, 2]


def test_ranked(spark):
    names = [f"s{k}" for k in range(200)] + ["", "Z", "a", "é", "😀", "", None]
    found = M.ranked(spark.createDataFrame([(n,) for n in names], "source string").repartition(5)).collect()
    order = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert {r.source: r.place for r in found} == {n: k for k, n in enumerate(order)}


def test_water_fill(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, "e": 0, "f": 300}
    weights = {"a": 3.0, "b": 1.0, "c": 2.0, "d": 3.0, "e": 1.0, "f": 2.0}
    rows = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    for total in (0.0, 30.0, 900.0, 2500.0, 3429.0):
        found = {r.source: r.target for r in M.water_fill(rows, total).collect()}
        want = filled(sizes, weights, total, 2.0)
        assert all(math.isclose(found[s], want[s], abs_tol=1e-3, rel_tol=1e-9) for s in sizes), total
        assert math.isclose(sum(found.values()), total, abs_tol=1e-6)
    assert {r.source: r.target for r in M.water_fill(rows, 1e9).collect()} == {s: 2.0 * n for s, n in sizes.items()}
    odd = spark.createDataFrame([("a", 10, None), ("b", 10, 0.0), ("c", 10, 1.0)], "source string, source_size long, weight double")
    assert {r.source: r.target for r in M.water_fill(odd, 12.0).collect()} == {"a": 0.0, "b": 0.0, "c": 12.0}


def test_mix(spark):
    rows = []
    for k in range(3000):
        rows.append((k, "big" if k % 3 else None if k % 5 == 0 else f"s{k % 7}", (k * 37) % 101, "x"))
    rows += [(None, "s1", 7, "x"), (None, "s1", 7, "x"), (5, "big", None, "x"), (9000, "alone", 50, "x"), (9001, "none", 0, "x")]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long, target string").repartition(6)
    mixed = M.mix(table, cycle=(3.0, 1.0, 2.0))
    assert mixed.columns == ["doc_id", "source", "size", "source_size", "target", "repeats", "taken"]
    found = mixed.collect()
    assert len(found) == len(rows)
    sums, sizes, targets = {}, {}, {}
    for r in found:
        assert r.taken == (r["size"] or 0) * r.repeats and 0 <= r.repeats <= 2
        sums[r.source] = sums.get(r.source, 0) + r.taken
        sizes[r.source] = sizes.get(r.source, 0) + (r["size"] or 0)
        targets[r.source] = r.target
    assert all(r.source_size == sizes[r.source] for r in found)
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    weights = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    want = filled(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    for s in sizes:
        assert math.isclose(targets[s], want[s], abs_tol=1e-3)
        assert abs(sums[s] - targets[s]) <= 51  # half the largest row
    again = M.mix(table.repartition(2), cycle=(3.0, 1.0, 2.0)).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert M.repeated(mixed).count() == sum(r.repeats for r in found)
    other = M.mix(table, cycle=(3.0, 1.0, 2.0), seed=7).collect()
    assert sorted(map(key, found)) != sorted(map(key, other))


def test_given_weights_and_empty_table(spark):
    table = spark.createDataFrame([(k, "ab"[k % 2], 10) for k in range(100)], "doc_id long, source string, size long")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 5.0)], "source string, weight double")
    found = {r.source: r.target for r in M.mix(table, weights, share=0.8).collect()}
    assert found == {"a": 600.0, "b": 200.0}
    assert M.mix(table.limit(0), weights).count() == 0 and M.mix(table.limit(0)).count() == 0
