import re

import pytest
from brute import pulled
from corvane.llm import pii

TEXTS = [
    (1, "Mail hein.19@mail5.example.com or HEIN.20@mail5.example.com, not a@b. Call +1 (743) 555-3824 or (212) 555-0199."),
    (2, "Host 152.143.123.131 and 8.8.8.8, version 1.2.3.4.5, card 4785 3805 9239 1139 / 4785380592391139, ssn 123-45-6789."),
    (3, "Mrs. Anna Keller met Mr Peter Dorn; Anna Keller wrote. Frau Schmidt-Lang. Господин Иван Петров и Анна Иванова."),
    (4, None),
    (5, ""),
    (6, "plain text without anything of the kind"),
    (7, "again hein.19@mail5.example.com and 152.143.123.131"),
    (None, "IBAN DE89 3704 0044 0532 0130 00 ends."),
    (7, "again hein.19@mail5.example.com and 152.143.123.131"),
    (8, " ".join(f"user{i}@example.org 10.0.{i // 256}.{i % 256} +1 (555) 555-{i:04d}" for i in range(1500))),
]


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in TEXTS], "doc_id long, text string, entities string, m int")
    return pii.surrogates(df, "k")


@pytest.fixture(scope="module")
def rows(done):
    out = {}
    for r in done.collect():
        out.setdefault(r["doc_id"], r)
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_nothing_personal_stays(rows):
    for i, text in TEXTS:
        for x in rows[i]["entities"]:
            assert x["surrogate"] != x["entity"]
            if x["kind"] != "name":
                assert x["entity"] not in rows[i]["text"]
    assert [x["kind"] for x in rows[1]["entities"]] == ["email", "email", "phone", "phone"]
    assert [x["kind"] for x in rows[2]["entities"]] == ["ip", "ip", "card", "card", "ssn"]
    assert {x["kind"] for x in rows[None]["entities"]} == {"iban"}
    assert "1.2.3.4.5" in rows[2]["text"]


def test_formats_are_kept(rows):
    for x in rows[1]["entities"][:2]:
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x["entity"]))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x["surrogate"])))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", rows[1]["entities"][2]["surrogate"])
    for x in rows[2]["entities"][:2]:
        assert all(0 <= int(o) <= 255 for o in x["surrogate"].split("."))


def test_valid_cards_stay_valid_and_invalid_ones_invalid(rows):
    for x in rows[2]["entities"][2:4]:
        a, b = (re.sub(r"\D", "", v) for v in (x["entity"], x["surrogate"]))
        assert a[0] == b[0] and len(a) == len(b) and luhn(a) == luhn(b)


def test_names_keep_title_gender_and_script(rows):
    found = {x["entity"]: x["surrogate"] for x in rows[3]["entities"]}
    assert set(found) == {"Mrs. Anna Keller", "Mr Peter Dorn", "Anna Keller", "Frau Schmidt-Lang", "Господин Иван Петров", "Анна Иванова"} or "Mrs. Anna Keller" in found
    title, given, last = found["Mrs. Anna Keller"].split(" ")
    assert title == "Mrs." and given in pii.GIVEN["latin f"] and given != "Anna" and len(last) == len("Keller")
    assert found["Anna Keller"] == f"{given} {last}"
    assert re.fullmatch(r"[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+", found["Анна Иванова"])


def test_one_entity_is_one_surrogate_everywhere(rows):
    assert rows[7]["entities"][0]["surrogate"] == rows[1]["entities"][0]["surrogate"]
    assert rows[7]["entities"][1]["surrogate"] == rows[2]["entities"][0]["surrogate"]


def test_distinct_entities_stay_distinct(done, rows):
    assert all(r["distinct_kept"] for r in rows.values())
    assert pii.collisions(done).collect() == []
    x = [e["surrogate"] for e in rows[8]["entities"]]
    assert len(x) == len(set(x)) == 4500


def test_permutations_are_one_to_one(spark):
    from pyspark.sql import functions as F

    df = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("s"))
    assert df.select(pii.permuted_text(F.col("s"), F.lit("0123456789"), F.lit(16), "k", F.lit("t")).alias("x")).distinct().count() == 10_000
    letters = [(a + b + c,) for a in "bcdfgh" for b in "jklmnp" for c in "qrstvw"]
    df = spark.createDataFrame(letters, "s string")
    assert df.select(pii.permuted_text(F.col("s"), *map(F.lit, pii.CLASSES["consonant"]), "k", F.lit("t")).alias("x")).distinct().count() == len(letters)


def test_another_key_gives_other_surrogates(spark, rows):
    df = spark.createDataFrame(TEXTS[:1], "doc_id long, text string")
    other = pii.surrogates(df, key="another").first()
    assert all(a["surrogate"] != b["surrogate"] for a, b in zip(other["entities"], rows[1]["entities"], strict=True))


def test_nothing_to_do(rows, no_docs):
    assert rows[4]["text"] is None and rows[5]["text"] == "" and rows[6]["text"] == TEXTS[5][1]
    assert rows[6]["entities"] == [] and pii.surrogates(no_docs, "k").collect() == []


@pytest.mark.parametrize("text", ["Ruf (0711) 12345, danke", "+49 (711) 4711", "call (555) 12 34, thanks"])
def test_short_phones_alone_in_a_text_are_found(spark, text):
    rows = spark.createDataFrame([(1, text), (2, text + " a@example.org")], "doc_id long, text string")
    alone, beside = sorted(pii.surrogates(rows, "k").collect(), key=lambda r: r["doc_id"])
    assert [x["kind"] for x in alone["entities"]] == ["phone"] and alone["text"] != text
    assert alone["entities"][0] == beside["entities"][0]


def test_names_of_every_script_are_replaced(spark):
    names = ["Παπαδόπουλος", "Άννας", "Պետրոսյան", "ԱնԻ".capitalize(), "Їжак", "Ăţăr", "Őrsőfi", "Ⲁⲛⲟⲕ", "Ⴀⴁⴂⴃ", "Шевченко", "Ꭰꭱꭲꭳ"]
    rows = spark.createDataFrame([(i, f"Mr {n} came") for i, n in enumerate(names)], "doc_id long, text string")
    done = {r["doc_id"]: r["entities"] for r in pii.surrogates(rows, "k").collect()}
    import unicodedata

    shape = lambda s: [(unicodedata.category(c), unicodedata.name(c).split()[0]) for c in s]
    for i, n in enumerate(names):
        (x,) = done[i]
        new = x["surrogate"].removeprefix("Mr ")
        assert x["entity"] == f"Mr {n}" and new != n and shape(new) == shape(n), (n, new)
        assert sum(a != b for a, b in zip(n, new, strict=True)) * 2 >= len(n) - 1


def test_other_letters_map_one_to_one(spark):
    letters = sorted({x for g in pii._other_letters() for c in g for x in (c, c.swapcase()) if len(x) == 1})
    df = spark.createDataFrame([(c,) for c in letters], "c string")
    got = [r[0] for r in df.select(pii._turned(df.c, "k")).collect()]
    assert len(set(got)) == len(letters) and all(len(g) == 1 for g in got)


def test_no_chunk_stays_as_it_is(spark):
    from pyspark.sql import functions as F

    for alphabet, most, n in (("0123456789", 16, 1), ("0123456789", 16, 3), ("aeiou", 16, 1), ("aeiou", 16, 2), ("aeiou", 3, 5)):
        total = len(alphabet) ** n
        df = spark.range(total).select(F.expr("transform(sequence(1, %d), k -> substr('%s', int(floor(id / pow(%d, k - 1)) %% %d) + 1, 1))" % (n, alphabet, len(alphabet), len(alphabet))).alias("a"))
        got = df.select(F.array_join("a", "").alias("s")).select("s", pii.permuted_text(F.col("s"), F.lit(alphabet), F.lit(most), "k", F.lit("t")).alias("x")).collect()
        assert len({r["x"] for r in got}) == total and all(r["x"] != r["s"] and len(r["x"]) == n for r in got)
    ips = spark.range(3000).select(F.concat_ws(".", F.col("id") % 250, F.lit("7"), F.col("id") % 3, F.col("id") % 251).alias("s")).distinct()
    got = ips.select("s", pii._ip(F.col("s"), "k").alias("x")).collect()
    assert len({r["x"] for r in got}) == len(got) and all(r["x"] != r["s"] and all(0 <= int(o) < 256 for o in r["x"].split(".")) for r in got)


def test_words_of_a_name_are_one_person_throughout_a_text(spark):
    text = "John Smith came. Smith left with John. Mr Bo saw Bo, Frau Schmidt-Lang and Schmidt; Johnson stayed, smith did not."
    (row,) = pii.surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").collect()
    by = {}
    for x in row["entities"]:
        for a, b in zip(x["entity"].split(" "), x["surrogate"].split(" "), strict=True):
            assert by.setdefault(a, b) == b
    assert {"John", "Smith", "Bo", "Schmidt-Lang"} <= set(by) and "Johnson" in row["text"] and "smith did" in row["text"]
    assert by["Bo"][0] != "B" and by["Bo"][1] != "o" and by["John"] in pii.GIVEN["latin m"]
    import re as r

    assert not r.search(r"\b(John|Smith|Bo)\b", row["text"])


def mod97(iban):
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def test_accounts_stay_valid(spark):
    good = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "NO93 8601 1117 947"]
    bad = ["DE88 3704 0044 0532 0130 00"]
    rows = spark.createDataFrame([(i, f"to {x} please") for i, x in enumerate(good + bad)], "doc_id long, text string")
    for r in pii.surrogates(rows, "k").collect():
        (x,) = r["entities"]
        assert x["kind"] == "iban" and x["surrogate"] != x["entity"] and (mod97(x["surrogate"]) == 1) == (r["doc_id"] < len(good)), x
        assert x["surrogate"][:2] == x["entity"][:2] and [c == " " for c in x["surrogate"]] == [c == " " for c in x["entity"]]


LONG = {"labels": "x a@" + "a." * 100_000 + "com", "digits": "call " + "1" * 100_000, "spaced": "1 " * 100_000, "dashes": "a@" + "-" * 100_000, "at": "a@b." * 50_000, "capitals": "AB12" * 50_000, "dots": "1." * 100_000, "names": "Mr " * 50_000 + "Bo"}


@pytest.mark.parametrize("name", LONG)
def test_long_runs_neither_crash_nor_stall(spark, name):
    import time

    start = time.time()
    (row,) = pii.surrogates(spark.createDataFrame([(1, LONG[name] + " and anna@example.org")], "doc_id long, text string"), "k").collect()
    assert row["entities"][-1]["entity"] == "anna@example.org" and time.time() - start < 60


def test_a_key_is_required_and_collisions_are_an_error(spark, done):
    with pytest.raises(ValueError):
        pii.surrogates(spark.createDataFrame([], "doc_id long, text string"), "")
    assert pulled(pii.checked(done), "doc_id", "text") == pulled(done, "doc_id", "text")
    bad = spark.createDataFrame([([("ip", "1.1.1.1", "2.2.2.2")],), ([("ip", "3.3.3.3", "2.2.2.2")],)], "entities array<struct<kind:string,entity:string,surrogate:string>>")
    with pytest.raises(RuntimeError):
        pii.checked(bad)
