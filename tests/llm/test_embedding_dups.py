import numpy as np

from pagequarry.llm import embedding_dups as E

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def brute(rows, cosine=0.9):
    good = {}
    for k, v, *_ in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        good[k] = np.array(v, dtype=np.float32).astype(float) if ok else None
    ids = [r[0] for r in rows]
    near = {i: set() for i in ids}
    for i in ids:
        for j in ids:
            a, b = good[i], good[j]
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                near[i].add(j)
    comp = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += near[x]
    return {i: (len(near[i]), comp[i], comp[i] == i) for i in ids}


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for group in (1, 1, 2, 3, 40, 25):
        centre = rng.standard_normal(16)
        rows += [centre + rng.standard_normal(16) * 0.03 for _ in range(group)]
    rows += [rows[3], rows[3], rows[10], rows[10] * 7]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e30] * 16, [1e-30] * 16]
    table = [(k, v, k % 3, "x") for k, v in enumerate(rows + odd)]
    found = E.components(spark.createDataFrame(table, SCHEMA), window=8)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert {r.vec_id: tuple(r)[1:] for r in found.collect()} == brute(table)


def test_blocks_against_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(8)
    table = [(k, [float(np.float32(x)) for x in centre + rng.standard_normal(8) * 0.2], 0, "") for k in range(60)]
    members = spark.createDataFrame([(0, k, 1 + k % 2, v) for k, v, *_ in table], "component long, rep long, n long, embedding array<float>")
    counted = {r.rep: r.linked for r in E.count_links(members, block=7).collect()}
    assert counted == {r.rep: r.linked for r in E.count_links(members, block=5, cell=2).collect()}
    m = np.array([v for _, v, *_ in table])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    assert [counted[k] for k in range(60)] == (near @ (1 + np.arange(60) % 2)).tolist()


def test_recall_of_links(spark):
    """Pairs right above the threshold, which passes find least surely."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(150):
        a = rng.standard_normal(64)
        b = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [a, a * 0.91 + b * np.sqrt(1 - 0.91**2)]
    table = [(k, [float(x) for x in v], 0, "") for k, v in enumerate(rows)]
    linked = sum(r.n_links for r in E.components(spark.createDataFrame(table, SCHEMA)).collect())
    assert linked >= 0.9 * 300


def test_recall_in_a_dense_cone(spark):
    """Vectors that share a direction crowd the windows between the two of a pair."""
    rng = np.random.default_rng(5)
    axis = rng.standard_normal(64)
    axis /= np.linalg.norm(axis)

    def across(*others):
        v = rng.standard_normal(64)
        for o in (axis, *others):
            v -= o * (o @ v)
        return v / np.linalg.norm(v)

    rows = [np.sqrt(0.7) * axis + np.sqrt(0.3) * across() for _ in range(4000)]
    for _ in range(200):
        a = across()
        b = 0.7 * a + np.sqrt(1 - 0.49) * across(a)  # cosine 0.91 with the cone's own share
        rows += [np.sqrt(0.7) * axis + np.sqrt(0.3) * v for v in (a, b)]
    table = [(k, [float(x) for x in v], 0, "") for k, v in enumerate(rows)]
    found = {r.vec_id: r.component_id for r in E.components(spark.createDataFrame(table, SCHEMA), passes=8, window=16).collect()}
    together = sum(found[k] == found[k + 1] for k in range(4000, 4400, 2))
    assert together >= 0.97 * 200, together


def test_neighbours_across_range_borders(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((150, 16))
    rows = np.float32(np.repeat(centres, 10, axis=0) + rng.standard_normal((1500, 16)) * 0.25)
    entries = spark.createDataFrame([(k, 1, [float(x) for x in v]) for k, v in enumerate(rows)], "rep long, n long, embedding array<float>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = [tuple(r) for r in E.links(entries, passes=1, window=8).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    root = list(range(1500))
    for i, j in edges:
        low, high = sorted((root[i], root[j]))
        root = [low if x == high else x for x in root]
    order = sorted((r.code, r.rep) for r in E._codes(entries, 1, 7).select("code", "rep").collect())
    ids, unit = [x for _, x in order], E._unit(rows)
    lost = [(ids[k], ids[k + d]) for k in range(1500) for d in range(1, 9) if k + d < 1500 and unit[ids[k]] @ unit[ids[k + d]] >= 0.9 + 1e-9 and root[ids[k]] != root[ids[k + d]]]
    assert edges and not lost, lost


def test_null_ids(spark):
    rows = [(None, [1.0, 0.0], 0, ""), (3, [1.0, 0.0], 0, ""), (None, [0.0, 1.0], 0, "")]
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in E.components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert found == [(3, 1, 3), (None, 0, None), (None, 1, 3)]


def test_no_rows(spark):
    assert E.components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_small_dense_cone_is_counted(spark):
    """Crowds are counted over all vectors: a cone of one row in 60 is seen whole, and links aren't in it."""
    rng = np.random.default_rng(8)
    axis = rng.standard_normal(64)
    axis /= np.linalg.norm(axis)
    cone = rng.standard_normal((500, 64))
    cone -= np.outer(cone @ axis, axis)
    cone = np.sqrt(0.85) * axis + np.sqrt(0.15) * cone / np.linalg.norm(cone, axis=1, keepdims=True)
    rows = np.concatenate([rng.standard_normal((29_500, 64)), cone]).astype(np.float32)
    entries = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(rows)], "rep long, n long, embedding array<float>")
    unit = E._unit(rows)
    probes = E._dense_vectors(entries, 7)
    crowd = E._crowds(entries, probes, 0.9)[64]
    cos = probes[64] @ unit.T
    assert (crowd.sum(axis=1) == (cos < 0.9).sum(axis=1)).all()
    near = np.arccos(0.8)
    assert crowd[:, : int(near / np.pi * E._STEPS)].sum(axis=1).max() >= 300  # some stand in the cone
    alone = E._crowds(entries.where("rep < 29500"), probes, 0.9)[64]
    assert E._meeting(crowd, 0.9, 8) < E._meeting(alone, 0.9, 8)
