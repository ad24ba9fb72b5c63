import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from brute import pulled
from corvane.llm import common, langid
from pyspark.sql import functions as F


def speak(rng, lang, n):
    parts = {"xx": ["lo", "ra", "mi", "no", "ta"], "yy": ["sch", "ung", "ich", "ein", "ü"], "zz": ["д", "а", "ро", "на", "ши"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    return [(i, speak(rng, lang, rng.randint(4, 80)), lang) for i in range(240) for lang in [rng.choice(["xx", "yy", "zz"])]]


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    net = langid.BiGru.fresh(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes = rng.integers(97, 105, (6, 4)).astype(np.int16)
    codes[5, 0] = langid.PAD
    truth = np.array([0, 1, 1, 0])
    _, d = net.gradients(codes, truth)
    for name in ("e", "u", "c", "w", "b"):
        flat = [i for i in np.ndindex(*net.p[name].shape) if abs(d[name][i]) > 1e-4][:6]
        for at in flat:
            old, step = net.p[name][at], 1e-3
            net.p[name][at] = old + step
            up, _ = net.gradients(codes, truth)
            net.p[name][at] = old - step
            down, _ = net.gradients(codes, truth)
            net.p[name][at] = old
            assert abs((up - down) / (2 * step) - d[name][at]) < 2e-3


def test_every_position_is_labelled_and_pieces_cover_the_text():
    net = langid.BiGru.fresh(["a", "b"])
    text = bytes(range(97, 123)) * 40
    whole = net.pooled([text], width=16, block=7)
    direct = net.pooled([text[i : i + 16] for i in range(0, len(text), 16)], width=16)
    weights = np.array([len(text[i : i + 16]) for i in range(0, len(text), 16)])
    assert np.allclose(whole[0], (direct * weights[:, None]).sum(axis=0) / weights.sum(), atol=1e-5)


def test_held_out_accuracy_and_columns(spark, corpus):
    docs = spark.createDataFrame([(*r, "clash", 0.1) for r in corpus], "doc_id long, text string, lang string, score string, lang_pred double")
    rows = langid.identify(docs).collect()
    truth = {i: lang for i, _, lang in corpus}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(corpus) and held
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_texts_alone_decide(spark, corpus):
    rows = [(i, t, lang) for i, t, lang in corpus]
    odd = [(900, None, "xx"), (901, "", "yy"), (902, "12 34 !?", "zz"), (903, rows[0][1], None), (None, rows[0][1], "yy"), (904, rows[0][1] * 3000, None), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {}
    for r in langid.identify(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], round(r["score"], 6)))
    for i in (900, 901, 902):
        assert got[i] == [("und", 0.0)]
    assert got[903] == got[None] == got[0][:1] and len(got[0]) == 2
    assert got[904][0][0] == got[0][0][0]


def test_held_out_rows_do_not_train(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    a = langid.sample(docs, "doc_id", "text", "lang")
    changed = docs.withColumn("text", F.when(langid.held_out(F.col("doc_id")), "other").otherwise(F.col("text")))
    assert a and a == langid.sample(changed, "doc_id", "text", "lang")


def test_without_labels_or_rows(spark, no_docs):
    bare = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert pulled(langid.identify(bare), "lang_pred", "score") == [("und", 0.0)]
    assert langid.identify(no_docs).collect() == []


def test_every_language_is_learned_and_copies_crowd_none_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "LEAST_DOCS", 2)
    rows = [(1000 * k + i, f"text {i} of language {k} " * 3, f"l{k:03d}") for k in range(700) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, "doc_id", "text", "lang", every=100)
    assert len({lang for lang, _ in got}) >= 690  # but for those of which all rows are held out
    assert {lang for lang, _ in got} == {r[0] for r in docs.filter(~langid.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    few = [(i, f"word {i}", "aa") for i in range(20)] + [(1, "word again", "aa")] * 500 + [(9000 + i, f"mot {i}", "zz") for i in range(12)]
    got = langid.sample(spark.createDataFrame(few, "doc_id long, text string, lang string").repartition(6), "doc_id", "text", "lang")
    assert {lang for lang, _ in got} == {"aa", "zz"} and len(got) < 200


def test_languages_beyond_the_old_limit_are_predicted(spark):
    rng = random.Random(4)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(6)]
        rows += [(100 * k + i, "".join(rng.choice(letters) for _ in range(40)), f"l{k:02d}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(langid.sample(docs, "doc_id", "text", "lang"), rounds=12)
    assert len(model.langs) == 70


@pytest.mark.parametrize("share", [1.0, 0.2, 1e-4])
def test_the_least_hashes_are_chosen_whatever_the_share(spark, share):
    rows = [(i, "aa") for i in range(4_000)] + [(i, "bb") for i in range(30)] + [(7, "aa")] * 3_000 + [(i, "cc") for i in range(900)]
    known = spark.createDataFrame(rows, "i long, lang string").repartition(7)
    order = {}
    for r in known.distinct().withColumn("h", F.xxhash64("i", "lang")).collect():
        order.setdefault(r["lang"], []).append((r["h"], r["i"]))
    want = sorted((i, lang) for lang, ids in order.items() for _, i in sorted(ids)[:40])
    got = langid._least(known, 40, {"aa": share, "bb": 1.0, "cc": max(share, 0.2)})
    assert sorted((r["__i"], r["lang"]) for r in got.collect()) == want


def distinct_between_the_sampled_pieces(n):
    """Texts of 8 pieces: the 4 that a sample takes are alike in both languages, the others are not."""
    rng = random.Random(6)
    piece = lambda letters: "".join(rng.choice(letters) for _ in range(langid.PIECE))
    return [(i, "".join(piece("uvwx ") + piece({"xx": "abcd ", "yy": "efgh "}[lang]) for _ in range(4)), lang) for i in range(n) for lang in [("xx", "yy")[i // 2 % 2]]]


def test_every_piece_of_every_labelled_text_is_learned(spark):
    rows = distinct_between_the_sampled_pieces(160)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {p for _, p in langid.sample(docs, "doc_id", "text", "lang")}.isdisjoint({t.encode()[96:192] for _, t, _ in rows})
    model = langid.learn(docs, "doc_id", "text", "lang")
    guess = model.pooled([b"abcd abcd dcba cadb" * 5, b"efgh efgh hgfe gehf" * 5])
    assert guess[0][0] > 0.8 and guess[1][1] > 0.8
    changed = docs.withColumn("text", F.when(langid.held_out(F.col("doc_id")), "other").otherwise(F.col("text")))
    again = langid.learn(changed, "doc_id", "text", "lang")
    assert all((model.p[k] == again.p[k]).all() for k in model.p)


def test_the_network_hangs_on_the_rows_and_not_on_their_division(spark, corpus, monkeypatch):
    monkeypatch.setattr(langid, "LANE", 4096)
    docs = spark.createDataFrame(corpus + corpus[:9], "doc_id long, text string, lang string")
    one, many = (langid.learn(rows, "doc_id", "text", "lang") for rows in (docs.coalesce(1), docs.orderBy(F.xxhash64("text")).repartition(11)))
    assert all((one.p[k] == many.p[k]).all() for k in one.p)


def test_a_pass_takes_every_piece_and_keeps_languages_that_are_not_in_it():
    rng = random.Random(3)
    pieces = [(lang, speak(rng, lang, 40).encode()[:96]) for lang in ("xx", "yy", "zz") * 60]
    model = langid.train(pieces)
    codes, truth = langid._coded(pieces, model.langs, langid.PIECE)
    texts = [(0, speak(rng, "xx", n).encode()) for n in (1, 30, 400, 30_000, 200_000)] + [(0, b"")]
    assert model.follow(iter(texts), codes, truth) == sum(-(-len(t) // langid.PIECE) for _, t in texts)
    assert (model.pooled([p for _, p in pieces]).argmax(axis=1) == truth).mean() > 0.98


def test_languages_and_scores_come_from_all_documents(spark, monkeypatch):
    blank = [(i, "", "zz") for i in range(3_000)] + [(50_000 + i, "да ро на ши " * 20, "zz") for i in range(12)]
    rows = blank + [(60_000 + i, "sch ung ich ein " * 20, "yy") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.learn(docs, "doc_id", "text", "lang").langs == ["yy", "zz"]
    seen = spark.createDataFrame([(i, "a", "yy") for i in range(4_000)], "doc_id long, text string, lang string")
    n = seen.filter(langid.held_out(F.col("doc_id"))).count()
    low = [r["doc_id"] for r in seen.filter(langid.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", "lang").desc()).limit(n // 50).collect()]
    odd = F.when(F.col("doc_id").isin(low), "z").otherwise(F.col("text"))  # 2 of 100, none of them among the least hashes
    monkeypatch.setattr(langid, "said", lambda spark, model, text: F.struct(F.lit("yy").alias("lang_pred"), F.when(text == "z", 0.6).otherwise(0.9).alias("score")))
    model = langid.BiGru.fresh(["yy", "zz"])
    assert langid.least_score(model, seen.withColumn("text", odd), "doc_id", "text", "lang") == pytest.approx(0.55)
    assert langid.least_score(model, seen, "doc_id", "text", "lang") == pytest.approx(0.7)
    assert langid.least_score(model, seen.limit(0), "doc_id", "text", "lang") == 0.5


def test_long_texts_are_sent_in_short_rows(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aдü€") for _ in range(n)) for n in (1, 95, 96, 383, 384, 385, 5_000, 300_000)] + [""]
    rows = spark.createDataFrame([(f"l{i}", t) for i, t in enumerate(texts)], "lang string, t string").coalesce(1)
    got = {}
    for r in langid.chunks(rows.select("lang", F.encode("t", "utf-8").alias("b"))).collect():
        got.setdefault(r["lang"], []).append(bytes(r["b"]))
    assert {k: b"".join(x) for k, x in got.items()} == {f"l{i}": t.encode() for i, t in enumerate(texts) if t}
    assert max(len(b) for x in got.values() for b in x) <= langid.CHUNK
    assert all(len(b) == langid.CHUNK for x in got.values() for b in x[:-1])


def test_a_batch_of_long_texts_takes_little_more_than_itself():
    net = langid.BiGru.fresh([f"l{k}" for k in range(8)])
    batch = pa.array(["text " * 4_000, None] * 1_500)  # 30 MB
    tracemalloc.start()
    try:
        assert sum(len(x) for some in common.few(batch) for x in some if x) == 30_000_000
        assert tracemalloc.get_traced_memory()[1] < 6e6
        tracemalloc.reset_peak()
        net.pooled([b"text " * 40_000] * 3)
        assert tracemalloc.get_traced_memory()[1] < 16e6  # 4,096 pieces side by side took 42 MB, 1,024 take 11
    finally:
        tracemalloc.stop()


def test_odd_batches_are_answered_by_row(spark):
    model = langid.BiGru.fresh(["aa", "bb"])
    rows = [(i, t) for i, t in enumerate([None, "", "12", "word " * 50, "ü"] * 301)]
    docs = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    got = {r["i"]: r["s"] for r in docs.select("i", langid.said(spark, model, F.col("t")).alias("s")).collect()}
    want = model.pooled([b"word " * 50, "ü".encode()])
    assert len(got) == len(rows)
    for i, s in got.items():
        if i % 5 < 3:
            assert (s["lang_pred"], s["score"]) == ("und", 0.0)
        else:
            assert s["lang_pred"] == model.langs[want[i % 5 - 3].argmax()] and s["score"] == pytest.approx(want[i % 5 - 3].max(), abs=1e-6)
