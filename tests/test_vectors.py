"""The vector index and blocked products against brute force."""

import math
import random

import pytest
from corvane.operators import vectors

D = 5


def rows():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(D)] for _ in range(6)]
    out = [(i, [x + rng.gauss(0, 0.4) for x in centres[i % 6]]) for i in range(300)]
    out += [(400 + i, list(out[7][1])) for i in range(5)]  # ties
    return [*out, (500, None), (501, [0.0] * D), (502, [math.nan] * D), (503, [None] * D), (None, out[3][1])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "vec_id long, embedding array<double>").repartition(5)


def brute(most, asked=lambda i: i % 10 == 0, least=None):
    good = [(i, v) for i, v in rows() if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))), 6)

    out = set()
    for q, a in good:
        if asked(q):
            found = sorted(((-cosine(b, a), k) for k, b in good if k != q))
            if least is None:
                out |= {(q, n, k, -s) for n, (s, k) in enumerate(found[:most], 1)}
            else:
                out |= {(q, k, -s) for s, k in found if -s >= least}
    return out


@pytest.mark.parametrize(("chunk", "queries"), [(8192, 1024), (40, 7)])
def test_top_k_is_exact_in_blocks_of_any_size(df, monkeypatch, chunk, queries):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    monkeypatch.setattr(vectors, "QUERIES", queries)
    assert {tuple(r) for r in vectors.top_k(df.filter("vec_id % 10 = 0"), df, 12).collect()} == brute(12)


@pytest.mark.parametrize("chunk", [8192, 20])
def test_index_is_exact_when_asked(df, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    index = vectors.VectorIndex(df, str(tmp_path)).build(12)
    asked = df.filter("vec_id % 10 = 0")
    assert len(index.centres) == 12 and index.codes().count() == 305
    assert {tuple(r) for r in index.search(asked, 12, probes=1, exact=True).collect()} == brute(12)
    assert {tuple(r) for r in index.within(asked, 0.9).collect()} == brute(0, least=0.9)
    near = index.search(asked, 12, probes=index.probes_for(12))
    found = vectors.recall(near, vectors.top_k(asked, df, 12)).first()
    assert found["queries"] == 31 and found["recall"] >= 0.9
    assert index.probes_for(12) < 12  # clusters need few cells


def test_a_search_reads_the_cells_of_its_queries_by_code(df, tmp_path):
    index = vectors.VectorIndex(df, str(tmp_path)).build(6)
    plan = index.codes().filter("cell = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(cell" in plan.split("PartitionFilters")[1].split("]")[0]


def test_nothing_to_index(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.VectorIndex(none, str(tmp_path)).build().search(none, 3).collect() == []
    odd = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="several lengths"):
        vectors.VectorIndex(odd, str(tmp_path)).build()
