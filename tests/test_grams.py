"""The trigram index: needs that every match meets, and the same lines as a full scan."""

import random
import re

import pytest
from corvane.operators import grams, search


def holds(needs, text):
    if needs is None:
        return True
    if isinstance(needs, str):
        return needs in text
    return (all if needs[0] == "and" else any)(holds(x, text) for x in needs[1])


@pytest.mark.parametrize(
    ("pattern", "needs"),
    [
        ("abcd", ("and", ("abc", "bcd"))),
        ("ab.cd", None),
        ("foo|barn", ("or", (("and", ("arn", "bar")), "foo"))),
        ("x(foo)+y", "foo"),
        ("x(foo)*y", None),
        ("[Hh]eron", ("and", ("ero", "her", "ron"))),
        ("colou?r", None),
        (r"\bThe\b", "the"),
        (r"the\p{L}+", "the"),
        (r"a\vbcd", "bcd"),
        (r"\Qabc\E", None),
        ("[a-z&&[^b]]xyz", None),
        ("(?iu)ski", None),
        ("éabcé", "abc"),
        ("(", None),
        ("(?:ab){2}", ("and", ("aba", "bab"))),
    ],
)
def test_needs_of_a_pattern(pattern, needs):
    got = grams.required(pattern, True)
    if pattern == "colou?r":
        assert all(holds(got, x) for x in ("color", "colour")) and not holds(got, "cool our")
    else:
        assert got == needs


def test_every_match_meets_its_needs():
    rng = random.Random(2)

    def some(depth=0):
        kind = rng.randrange(8 if depth < 3 else 3)
        if kind < 3:
            return "".join(rng.choice("abcA. ") if rng.random() < 0.9 else rng.choice([r"\w", "[ab]", "[^c]", "é"]) for _ in range(rng.randint(1, 5)))
        if kind == 3:
            return f"({some(depth + 1)}|{some(depth + 1)})"
        if kind == 4:
            inner = some(depth + 1)
            return f"(?:{inner}){rng.choice(['?', '{2}'] if re.search('[*+?}]', inner) else ['?', '*', '+', '{2}', '{0,2}', '{1,3}?'])}"  # no powers of repeats
        if kind == 5:
            return f"(?={some(depth + 1)}){some(depth + 1)}"
        return some(depth + 1) + some(depth + 1)

    texts = ["".join(rng.choice("abcABC é") for _ in range(rng.randint(3, 40))) for _ in range(60)]
    met = told = 0
    for _ in range(600):
        pattern = some()
        needs = grams.required(pattern, True)
        told += needs is not None
        for text in texts:
            if re.search(pattern, text):
                met += 1
                assert holds(needs, text.lower()), (pattern, text, needs)
    assert met > 1000 and told > 100


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(9)
    rows = [(f"u{i:03}", "\n".join(" ".join(rng.choice(["heron", "Heron", "the", "natoin", "abc", "123-4567", "é", "İx"]) for _ in range(5)) for _ in range(3))) for i in range(120)]
    rows += [("none", None), ("empty", ""), ("split", "her\non"), ("long", "x " * 5000 + "needle-42")]
    return spark.createDataFrame(rows, "uri string, text string").repartition(3)


PATTERNS = [("heron", False, None), ("Heron", False, None), ("ab", False, None), ("HERON", False, False), ("heron (the|abc)", True, None), ("needle|natoin her", True, None), (r"\d{3}-\d{4} é", True, None), ("(?i)HERON ABC", True, None), ("nowhere", False, None)]


@pytest.mark.parametrize(("pattern", "is_regex", "case"), PATTERNS)
def test_the_index_finds_what_a_scan_finds(df, index, pattern, is_regex, case):
    got, want = index.grep(df, pattern, is_regex, 200, case), search.grep(df, pattern, is_regex, 200, case)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


@pytest.fixture(scope="module")
def index(spark, df, tmp_path_factory):
    return grams.GramIndex(spark, str(tmp_path_factory.mktemp("grams"))).build(df)


def test_few_texts_are_compared(index):
    assert index.share("needle").first()["compared"] == 1
    assert index.share("ab").first()["compared"] == index.share("ab").first()["texts"] == 124
    plan = index.candidates(grams.required("needle"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(gram" in plan


def test_changed_texts(spark, df, tmp_path):
    own = grams.GramIndex(spark, str(tmp_path)).build(df)
    new = spark.createDataFrame([("u000", "a kingfisher"), ("long", "gone"), ("added", "heron needle-43")], "uri string, text string")
    own.upsert(new)
    now = df.join(new, "uri", "left_anti").unionByName(new)
    for pattern in ("kingfisher", "needle", "heron"):
        assert own.grep(now, pattern, most=500).collect() == search.grep(now, pattern, most=500).collect()
    assert own.share("needle").first().asDict() == {"pattern": "needle", "texts": 125, "compared": 1}


def test_nothing_indexed(spark, df, tmp_path):
    none = df.limit(0)
    empty = grams.GramIndex(spark, str(tmp_path)).build(none)
    assert empty.grep(none, "needle").collect() == [] and empty.share("needle").first()["compared"] == 0


def test_short_ranges_and_long_texts_in_steps(spark, df, tmp_path, monkeypatch):
    monkeypatch.setattr(grams, "RANGE", 7)
    monkeypatch.setattr(grams, "POSTINGS", 400)
    monkeypatch.setattr(grams, "STEP", 5)
    own = grams.GramIndex(spark, str(tmp_path)).build(df)
    blocks = spark.read.parquet(f"{tmp_path}/{own.segments[0]['name']}/grams")
    assert blocks.select("r").distinct().count() > 124 // 7 and blocks.groupBy("gram", "r").count().filter("count > 1").isEmpty()
    for pattern, is_regex, case in PATTERNS:
        assert own.grep(df, pattern, is_regex, 200, case).collect() == search.grep(df, pattern, is_regex, 200, case).collect()


@pytest.mark.parametrize("text", ["", "ab", "abc", "abcabc", "é abc\nde f\n\nghé i", "x" * 50, "her\non heron"])
def test_numbers_of_trigrams(text, monkeypatch):
    for step in (1, 3, 1 << 20):
        monkeypatch.setattr(grams, "STEP", step)
        assert {chr(c >> 14) + chr(c >> 7 & 127) + chr(c & 127) for c in grams.codes(text.encode()).tolist()} == grams.grams(text)


def test_keys_are_not_repeated_for_each_trigram(spark, tmp_path):
    rng = random.Random(4)
    rows = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(2000)), " ".join(str(rng.random()) for _ in range(5))) for _ in range(200)]
    own = grams.GramIndex(spark, str(tmp_path)).build(spark.createDataFrame(rows, "uri string, text string").repartition(2))
    held = sum(p.stat().st_size for p in (tmp_path / own.segments[0]["name"] / "grams").rglob("*.parquet"))
    assert held < 200_000 and own.share("0.").first()["texts"] == 200
