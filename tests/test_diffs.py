"""Diffs by anchors against a plain version of the same rules."""

import random

import pytest
from corvane import catalog
from corvane.operators import diffs

SF = "/root/testdata/sf0.001"


def chain(anchors):
    """A longest chain of (a, b) rising in both; of equal ones that through the smaller b."""
    best = []
    for at, (_, b) in enumerate(anchors):
        before = [(best[i][0], -anchors[i][1], i) for i in range(at) if anchors[i][1] < b]
        top = max(before, default=(0, 0, -1))
        best.append((top[0] + 1, top[2]))
    at = max(((n, -anchors[i][1], i) for i, (n, _) in enumerate(best)), default=(0, 0, -1))[2]
    out = []
    while at >= 0:
        out.append(anchors[at])
        at = best[at][1]
    return out[::-1]


def brute(x, y, a=0, b=0):
    out, head = [], 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        out.append((a + head, b + head))
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out += [(a + len(x) - i, b + len(y) - i) for i in range(1, tail + 1)]
    x, y, a, b = x[head : len(x) - tail], y[head : len(y) - tail], a + head, b + head
    kept = chain([(i, y.index(v)) for i, v in enumerate(x) if x.count(v) == 1 and y.count(v) == 1])
    for (i, j), (u, v) in zip([(-1, -1), *kept], [*kept, (len(x), len(y))], strict=True):
        if kept:
            out += brute(x[i + 1 : u], y[j + 1 : v], a + i + 1, b + j + 1)
    return out + [(a + i, b + j) for i, j in kept]


def made(seed):
    rng = random.Random(seed)
    x = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2 + seed % 3) for _ in range(rng.randint(0, 40))]
    y = list(x)
    for _ in range(rng.randint(0, 8)):
        i, n, j = rng.randint(0, len(y)), rng.randint(0, 6), rng.randint(0, len(y))
        y = {0: y[:i] + y[i + n :], 1: y[:i] + ["new"] * n + y[i:], 2: (lambda cut, rest: rest[:j] + cut + rest[j:])(y[i : i + n], y[:i] + y[i + n :])}[rng.randint(0, 2)]
    return "\n".join(x), "\n".join(y)


CASES = {i: made(i) for i in range(80)} | {
    200: (None, "a\nb"), 201: ("a", None), 202: (None, None), 203: ("", ""), 204: ("a\nb", "a\nb"), 205: ("a", "a\na"), 206: ("", "a"),
    207: ("a\n" * 30, "a\n" * 29 + "b"), 208: ("x\na\ny\nb\nz", "z\na\nq\nb\nx"),
}


def lines(text):
    return [] if text is None else text.split("\n")


def test_kept_lines_and_hunks(spark):
    df = spark.createDataFrame([(k, *v) for k, v in CASES.items()], "k2 long, before string, after string").repartition(5)
    got = {}
    for r in diffs.matched(df, "k2", "before", "after").collect():
        got.setdefault(r["k2"], []).append((r["a"], r["b"]))
    want = {k: sorted(brute(lines(x), lines(y))) for k, (x, y) in CASES.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    parts = {}
    for r in diffs.hunks(df, "k2", "before", "after").collect():
        parts.setdefault(r["k2"], []).append(r)
    for k, (x, y) in CASES.items():  # what was before, with each hunk put in its place, is what comes after
        x, y, out, at = lines(x), lines(y), [], 0
        for r in sorted(parts.get(k, []), key=lambda r: (r["a_from"], r["b_from"])):
            out += x[at : r["a_from"]] + y[r["b_from"] : r["b_from"] + r["b_lines"]]
            at = r["a_from"] + r["a_lines"]
        assert out + x[at:] == y


def test_a_long_text_and_none(spark):
    """100,000 lines, a tenth moved or new; an empty table."""
    x = [str(i) for i in range(100_000)]
    y = x[:20_000] + x[60_000:70_000] + ["new"] * 500 + x[20_000:60_000] + x[70_000:]
    df = spark.createDataFrame([(1, "\n".join(x), "\n".join(y))], "k long, x string, y string")
    assert [tuple(r) for r in diffs.totals(df, "k", "x", "y").collect()] == [(1, 2, 10_500, 10_000)]
    assert diffs.totals(df.limit(0), "k", "x", "y").collect() == []


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="the shared tables are not here")
def test_the_query_against_the_plain_version(spark):
    got = {r["doc_id"]: r for r in catalog.queries()["s33_copies_diff"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = {}
    for k in sorted(texts):
        first.setdefault(max(lines(texts[k]), key=len, default=None), k)
    assert got.keys() == {k for k in texts if texts[k] is not None and first[max(lines(texts[k]), key=len)] != k}
    for k, r in got.items():
        x, y = lines(texts[r["base_id"]]), lines(texts[k])
        n = len(brute(x, y))
        assert r["base_id"] == first[max(y, key=len)] and (r["insertions"], r["deletions"]) == (len(y) - n, len(x) - n)
