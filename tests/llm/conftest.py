import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, copies int, size string, n_words int, score double, path string"


def word(rng):
    return "".join(rng.choice("abcdeghiklmnoprstuväéñ") for _ in range(rng.randint(2, 8)))


def rows():
    """Documents with nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing columns."""
    rng = random.Random(5)
    vocabulary = [word(rng) for _ in range(400)]
    out = []
    for i in range(60):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 120)))
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None])))
    base = out[7][1]
    out += [(100 + i, base, "en", "a") for i in range(5)]  # exact copies
    out += [(110 + i, base + f" extra{i}", "en", "b") for i in range(3)]  # near copies
    out += [(200, None, "en", "a"), (201, "", None, None), (202, " \t\n\x0b ", "fr", "b"), (203, "12 34 -- !!", "en", "a"), (204, "one", "en", "a"), (205, "Two words", "fr", "b")]
    out += [(300, " ".join(rng.choice(vocabulary) for _ in range(30_000)), "en", "a")]  # very long
    out += [(301, ("again and again the same eight words here now " * 12).strip(), "en", "a")]
    out += [(302, "line one\nline one\n\nline one \nother\nother", "fr", None), (303, "£#*$ %&|<> é x \U0001f600 \u0085 y", None, "b")]
    out += [out[3], out[3]]  # repeated rows
    out += [(None, "a row without an id but with some words in it", "en", "a"), (None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def texts():
    return rows()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), True, 3, 2, "x", 9, 0.5, "p") for r in rows()], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
