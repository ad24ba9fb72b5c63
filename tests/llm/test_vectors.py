import math
import random
from collections import Counter

import numpy as np
import pytest
from corvane.llm import neighbours, whitening
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n long, g int, kept boolean"


def near(v, rng, noise):
    return [x + rng.gauss(0, noise) for x in v]


def vectors():
    rng = random.Random(3)
    d, out = 6, []
    fresh = lambda: [rng.gauss(0, 1) for _ in range(d)]
    for i in range(120):
        out.append((i, fresh(), rng.choice([0, 0, 0, 1, None])))
    for k in range(8):  # groups with copies, near copies and chains
        base, label = fresh(), k % 2
        for _ in range(14):
            base = near(base, rng, 0.2)
            out.append((len(out) + 100, base, label))
    out += [(2000 + i, out[130][1], out[130][2]) for i in range(9)]  # copies
    out += [(3000, [2 * x for x in out[130][1]], out[130][2]), (3001, out[130][1], 7)]
    out += [(4000, None, 0), (4001, [], 0), (4002, [0.0] * d, 0), (4003, [math.nan] + [1.0] * (d - 1), 0), (4004, [math.inf] + [1.0] * (d - 1), 0), (4005, [None] + [1.0] * (d - 1), 0)]
    out += [(4006, [1.0, 2.0], 0), (4007, [2.0, 4.0], 0), (4008, [1e-38] + [0.0] * (d - 1), 1), (4009, [3e38] + [0.0] * (d - 1), 1), (None, out[130][1], out[130][2]), (None, None, None)]
    return [*out, out[140], out[140]]  # a repeated row


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*v, "x", 5, 1, True) for v in vectors()], SCHEMA).repartition(4)


def brute(held, least=neighbours.LEAST_COSINE):
    held = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in held]
    able = [i is not None and c is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, c in held]

    def cosine(a, b):
        s = max(map(abs, a)), max(map(abs, b))
        a, b = [x / s[0] for x in a], [x / s[1] for x in b]
        return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))

    n = range(len(held))
    linked = {i: {j for j in n if i != j and able[i] and able[j] and held[i][2] == held[j][2] and len(held[i][1]) == len(held[j][1]) and cosine(held[i][1], held[j][1]) >= least} for i in n}
    out = []
    for i in n:
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        least_id = min((held[j][0] for j in seen if held[j][0] is not None), default=None)
        out.append((held[i][0], len(linked[i]), least_id, held[i][0] == least_id))
    return out


@pytest.mark.parametrize(("chunk", "per_root"), [(4096, 8), (7, 0.8)])
def test_links_equal_brute_force(rows, monkeypatch, chunk, per_root):
    """Also with many cells, and with blocks of some seven vectors; copies, chains, ties, nulls, odd lengths, clashing columns."""
    monkeypatch.setattr(neighbours, "PER_ROOT", per_root)
    got = [tuple(r) for r in neighbours.near_copies(rows, chunk=chunk).collect()]
    assert Counter(got) == Counter(brute(vectors()))
    assert max(r[1] for r in got) > 10


def test_no_vectors_and_other_columns(spark):
    assert neighbours.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = spark.createDataFrame([("b", [1.0, 0.0], "x"), ("a", [1.0, 0.1], "x"), ("c", None, "x")], "`i.d` string, `v v` array<double>, kind string")
    got = {tuple(r) for r in neighbours.near_copies(odd, "i.d", "v v", "kind").collect()}
    assert got == {("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)}


def test_every_linked_pair_meets_in_a_home():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 5))
    u = neighbours.unit(v)
    home, visits = neighbours.places(v, neighbours.fit(v, 25), 0.93)
    for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.93, 1)), strict=True):
        assert home[i] == home[j] or visits[i, home[j]] or visits[j, home[i]]


def test_blocks_of_a_hot_group_stay_small(spark):
    """A label of near copies alone is dealt into parts; each pair of parts is one block."""
    rng = random.Random(8)
    base = [rng.gauss(0, 1) for _ in range(8)]
    df = spark.createDataFrame([(i, near(base, rng, 0.01), 1, "x", 5, 1, True) for i in range(400)], SCHEMA)
    distinct = df.select(F.col("vec_id").cast("string").alias("node"), F.struct(F.col("label").alias("l"), F.size("embedding").alias("d")).alias("g"), F.lit(1).cast("long").alias("n"), F.col("embedding").alias("v"))
    sizes = [r["count"] for r in neighbours.blocks(neighbours.placed(distinct, 0.93), 50).groupBy("c", "i", "j").count().collect()]
    assert max(sizes) < 300 and len(sizes) > 4
    got = neighbours.near_copies(df, chunk=50).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(399, 0)}


def whole(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def test_whitening_equals_numpy(rows, spark):
    kept = [(i, whole(v)) for i, v, _ in vectors() if v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) and abs(x) < 1e9 for x in v)]
    df = rows.filter(~F.exists("embedding", lambda x: F.abs(x) > 1e9) | F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull()))
    got = whitening.whiten(df).collect()
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    x = fit.astype(float)
    apart = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(apart.T @ apart / n)
    order = np.argsort(-values)[:4]
    want = Counter()
    for i, v in kept:
        for k, c in enumerate(order, 1):
            want[i, k, n, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)), round(abs(float((np.array(v) - x.mean(axis=0)) @ axes[:, c] / math.sqrt(values[c]))), 7), round(values[c] / values.sum(), 9)] += 1
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 7), round(r["explained"], 9)) for r in got) == want
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (333, 7))
    parts = [whitening.moments_of(x[a:b]) for a, b in ((0, 1), (1, 40), (40, 41), (41, 300), (300, 333))]
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 3, 1]):
        have = parts[order[0]]
        for k in order[1:]:
            have = whitening.merged(have, parts[k])
        assert have[0] == 333 and have[1] == x.sum(axis=0).tolist()
        assert np.allclose(have[3] / have[0], np.cov(x.T, bias=True), rtol=1e-12)


def test_exact_deviations_beyond_int64_products():
    rows = np.array([[2**20, -(2**19)], [3, 4]])
    assert whitening.deviations(rows, 2000, [10, 20]).tolist() == [sum((2000 * int(a) - b) ** 2 for a, b in zip(r, (10, 20), strict=True)) for r in rows]
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[2**50]]), 10**6, [0])


def test_whitening_of_little(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, "x", 5, 1, True), (2, [1.0, 2.0], 0, "x", 5, 1, True)], SCHEMA)
    assert whitening.whiten(one).collect() == []  # no variance, no component
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0, "x", 5, 1, True) for i in range(4)], SCHEMA)
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)
