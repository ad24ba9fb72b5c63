"""The walk over sentences: in one row of a text, against a plain version, with words of many texts and of few."""

import math
import re

import pytest
from corvane.operators import summaries
from pyspark.sql import functions as F

TEXTS = [(1, "One heron. Two herons!  ONE\tnation\n\nÉté one heron"), (2, None), (3, "... --"), (None, "A heron stood. The nation slept. A nation stood"), (5, "alone"), (6, ""), (7, "heron " * 50 + "\nnation")]


def plain():
    words = lambda t: set(re.findall(summaries.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    df = {}
    for _, t in TEXTS:
        for w in words(t or ""):
            df[w] = df.get(w, 0) + 1
    out = set()
    for k, t in TEXTS:
        held = {s: words(p) for s, p in enumerate(re.sub(r"([.!?])[ \t]+", r"\1\n", t or "").split("\n"))}
        held, g = {s: w for s, w in held.items() if w}, {w: math.floor(1000 * math.log(1 + len(TEXTS) / n)) for w, n in df.items()}
        r = dict.fromkeys(held, summaries.START)
        for _ in range(summaries.STEPS):
            got = {w: sum(r[s] * g[w] // sum(g[x] for x in held[s]) for s in held if w in held[s]) // sum(w in x for x in held.values()) for w in set().union(*held.values())}
            r = {s: summaries.START * (1000 - summaries.FOLLOWED) // 1000 + sum(got[w] for w in held[s]) * summaries.FOLLOWED // 1000 for s in held}
        out |= {(k, s, x) for s, x in r.items()}
    return out


@pytest.mark.parametrize("hot", [1, 10, 10**9])
def test_ranks_equal_a_plain_walk(spark, monkeypatch, hot):
    monkeypatch.setattr(summaries, "MOST_HOT", hot)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in summaries.ranked(df, "doc_id").collect()} == plain()
    said = {r["doc_id"]: r["summary"] for r in summaries.summaries(df, "doc_id", most=1).collect()}
    assert said[2] is None and said[3] is None and said[6] is None and said[5] == "alone" and len(said) == len(TEXTS)


def test_steps_are_no_sorts_of_all_words(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(summaries.ranked(df, "doc_id")) and "Window" not in plan(summaries.summaries(df, "doc_id"))
    assert summaries.ranked(df.filter(F.lit(False)), "doc_id").collect() == []
