"""Words within two edits against brute force."""

import random

import pytest
from corvane.operators import search


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("within", [1, 2])
def test_near_terms_equal_brute_force(spark, within):
    """Short and long words, repeats, letters beyond ASCII, edits at both ends and around the eighth letter."""
    rng = random.Random(within)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 11))) for _ in range(250)} | {"", "a"}
    base = "abcdefghijklmnop" * 20
    for _ in range(60):
        x = list(base[: rng.choice([7, 8, 9, 16, 300])])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(x)) if rng.random() < 0.5 else min(len(x) - 1, rng.randint(5, 9))
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ñ"])
        words.add("".join(x))
    asked = sorted(words)[::4]
    frame = lambda w: spark.createDataFrame([(x,) for x in [*w, None, w[0]]], "term string")
    got = search.near_terms(frame(asked), frame(sorted(words)), within)
    want = sorted((q, t, d) for q in asked for t in words if q != t and abs(len(q) - len(t)) <= within and (d := distance(q, t)) <= within)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_a_word_of_any_length_has_few_keys(spark):
    df = spark.createDataFrame([("x" * 5 + "abcdefgh" * 1000,), ("abcdefgh" * 9,)], "term string")
    assert max(len(r[0]) for r in df.select(search.remains(df.term, 2)).collect()) <= 37
