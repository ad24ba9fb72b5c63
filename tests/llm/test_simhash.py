import random
from itertools import combinations

import brute
from brute import pulled
from corvane.llm import common, simhash
from corvane.llm.components import components
from hypothesis import given, settings
from hypothesis import strategies as st


def test_some_mask_covers_every_pair_within_the_radius():
    for radius in (1, 2):
        masks = simhash.covering_masks(radius)
        for bits in combinations(range(64), radius):
            assert any(not m & sum(1 << b for b in bits) for m in masks)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint_bytes(text) == brute.fingerprint(text)


def test_clusters_equal_brute_force(docs, texts):
    got = pulled(simhash.clusters(docs), "doc_id", "fp", "component_id")
    prints = [brute.fingerprint(t) for _, t, *_ in texts]
    want = brute.components([i for i, *_ in texts], prints)
    assert got == sorted(((i, simhash.signed(p), c) for (i, *_), p, c in zip(texts, prints, want, strict=True)), key=repr)


def test_links_of_full_buckets_equal_all_pairs(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    got = {r["node"]: r["component"] for r in components(simhash.links(df)).collect()}
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    groups = {}
    for p in prints:
        groups.setdefault(root(p), []).append(simhash.signed(p))
    want = {p: min(g) for g in groups.values() if len(g) > 1 for p in g}
    assert got == want


def test_levels_cover_and_end_in_small_buckets():
    levels = simhash.mask_levels()
    assert [len(x) for x in levels] == [7, 49, 343] and max(64 - m.bit_count() for m in levels[-1]) <= 6
    for bits in combinations(range(64), 2):
        pair = sum(1 << b for b in bits)
        for above, below in zip(levels, levels[1:], strict=False):
            for n, mask in enumerate(above):
                assert mask & pair or any(not m & pair and m & mask == mask for m in below[7 * n : 7 * n + 7])


def test_links_are_all_pairs_within_the_radius(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    ball = {centre ^ (1 << a) ^ (1 << b) for a, b in rng.sample(list(combinations(range(64), 2)), 150)} | {centre}
    low = {centre ^ n for n in range(128)}
    prints = sorted(ball | low | {rng.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(df).collect()}
    assert got == {frozenset((simhash.signed(a), simhash.signed(b))) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2}


def test_many_copies_are_one_hot_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(common, "MOST_HOT", 5)
    rows = [(i, "the same words in a row" if i % 2 else None if i % 3 else f"words of number {i} alone in it") for i in range(60)]
    got = pulled(simhash.clusters(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id")
    prints = [brute.fingerprint(t) for _, t in rows]
    assert got == sorted(zip(range(60), brute.components([i for i, _ in rows], prints), strict=True), key=repr)


def test_components_of_chains_stars_and_noise(spark):
    edges = [(i, i + 1) for i in range(100, 200)] + [(5, i) for i in range(300, 360)] + [(7, 7), (8, None), (9, 10), (10, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 201)} == {100} and {got[i] for i in range(300, 360)} == {5}
    assert got[9] == got[10] == 9 and 7 not in got and 8 not in got


def test_empty_tables(spark, no_docs):
    assert simhash.clusters(no_docs).collect() == []
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
