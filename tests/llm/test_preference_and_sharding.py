import hashlib

import pytest
from brute import pulled
from corvane.llm import preference, sharding
from corvane.llm.common import fresh_dir
from pyspark.sql import functions as F

TURNS = [
    (0, 0, "system", "be kind"), (0, 1, "user", "hello"), (0, 2, "assistant", "good"), (0, 3, "user", "bye"),
    (1, 5, "system", "be kind"), (1, 6, "user", "hello"), (1, 7, "assistant", "bad <|end|> x"),
    (2, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "more"),
    (4, 0, "user", "alone"), (4, 1, "assistant", None),
    (6, 0, None, None), (7, 0, None, None), (7, 0, "user", "tie b"), (7, 0, "user", "tie a"),
    (8, 0, "user", "x"), (8, 0, "user", "x"), (9, 0, "user", "x"), (None, 0, "user", "lost"),
    *((10, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(400)), (11, 0, "user", "turn 0"),
]


def partners():
    """As the registered query has them: 2k and 2k + 1."""
    return F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1)) == 1


def turn(role, text):
    safe = lambda v: (v or "").replace("<|", "< |")
    return f"<|{safe(role)}|>\n{safe(text)}<|end|>\n"


def brute_pairs():
    sides = {}
    none = lambda v: (v is not None, v if v is not None else "")
    for c, n, r, t in TURNS:
        if c is not None:
            sides.setdefault(c, []).append((n, r, t))
    out = []
    for p in sorted({c // 2 for c in sides}):
        a, b = ([(r, t) for n, r, t in sorted(sides.get(2 * p + s, []), key=lambda x: (x[0], none(x[1]), none(x[2])))] for s in (0, 1))
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1

        def mask(turns):
            at, spans = 0, []
            for r, t in turns:
                s = turn(r, t)
                if r == "assistant":
                    spans.append((at + len(r) + 5, at + len(s)))
                at += len(s)
            return spans

        told = lambda turns: "".join(turn(*x) for x in turns)
        out.append((p, told(a[:k]), told(a[k:]) if a else None, told(b[k:]) if b else None, mask(a[k:]) if a else None, mask(b[k:]) if b else None))
    return out


def test_pairs_equal_brute_force(spark):
    df = spark.createDataFrame([(*t, 1, "k") for t in TURNS], "conv_id long, turn long, role string, text string, pair_id int, no string").repartition(4)
    rows = preference.pairs(df, *partners()).collect()
    spans = lambda m: None if m is None else [(x["start"], x["end"]) for x in m]
    got = sorted((r["pair_id"], r["prompt"], r["chosen"], r["rejected"], spans(r["chosen_mask"]), spans(r["rejected_mask"])) for r in rows)
    assert got == sorted(brute_pairs())


def test_the_prompt_is_rendered_once_and_masks_cover_answers(spark):
    df = spark.createDataFrame(TURNS[:7], "conv_id long, turn long, role string, text string")
    r = preference.pairs(df, *partners()).first()
    assert r["prompt"] == turn("system", "be kind") + turn("user", "hello") and r["prompt_turns"] == 2
    m = r["rejected_mask"][0]
    assert r["rejected"][m["start"] : m["end"]] == "bad < |end|> x<|end|>\n"


def test_alternatives_equal_brute_force(spark):
    df = spark.createDataFrame([(*t, 1, "k") for t in TURNS], "conv_id long, turn long, role string, text string, pair_id int, no string").repartition(4)
    rows = preference.alternatives(df, *partners()).collect()
    none = lambda v: (v is not None, v if v is not None else "")
    sides = {}
    for c, n, r, t in TURNS:
        if c is not None:
            sides.setdefault(c, []).append((n, r, t))
    sides = {c: [(r, t) for n, r, t in sorted(v, key=lambda x: (x[0], none(x[1]), none(x[2])))] for c, v in sides.items()}
    told = lambda turns: "".join(turn(*x) for x in turns)
    assert sorted(r["pair_id"] for r in rows) == sorted(sides)
    for row in rows:
        mine, other = sides[row["pair_id"]], sides.get(row["pair_id"] ^ 1, [])
        places = [i for i, (r, _) in enumerate(mine) if i and r == "assistant"]
        at = int(hashlib.md5(f"{preference.SEED}|{row['pair_id']}".encode()).hexdigest()[:8], 16)
        cut = places[at % len(places)] if places else 1
        b = mine[:cut] + [x for x in other if x[0] == "assistant"][-1:]
        k = 0
        while k < min(len(mine), len(b)) and mine[k] == b[k]:
            k += 1
        assert k >= 1 and row["prompt_turns"] == k
        assert (row["prompt"], row["chosen"], row["rejected"]) == (told(mine[:k]), told(mine[k:]), told(b[k:]))


def test_a_very_long_conversation(spark):
    rows = [(0, i, "assistant" if i % 2 else "user", "w " * 20_000 if i == 7 else f"turn {i}") for i in range(5000)] + [(1, 0, "user", "u"), (1, 1, "assistant", "v")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in preference.alternatives(df, *partners()).collect()}
    assert got[0]["prompt_turns"] + got[0]["chosen_turns"] == 5000 and got[0]["rejected"] == turn("assistant", "v")
    assert got[1]["prompt_turns"] == 1 and got[1]["rejected"] == turn("assistant", "turn 4999")


def test_no_turns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.pairs(df, F.col("conv_id"), F.lit(True)).collect() == []


@pytest.fixture
def store(spark):
    return sharding.Store(spark, fresh_dir(spark, "store"), small=20_000, target=60_000, fan_in=3)


def test_rows_survive_appends_and_compaction(store, docs):
    for part in (4, 9, 1):
        store.append(docs.repartition(part, "text"))
    before = store.version()
    small = store.manifest().count()
    after = store.compact()
    assert after > before == 3 and store.manifest().count() < small
    want = sorted(map(repr, docs.collect())) * 3
    assert sorted(map(repr, store.read().collect())) == sorted(want)
    assert sorted(map(repr, store.read(1).collect())) == sorted(map(repr, docs.collect()))  # old versions stay readable
    assert store.manifest().agg(F.sum("docs")).first()[0] == len(want)
    store.vacuum()
    assert sorted(map(repr, store.read().collect())) == sorted(want)


def test_runs_hold_one_tier_and_about_a_target(store, docs):
    store.append(docs.repartition(24, "doc_id", "text"))
    plan = store.plan().join(store.manifest(), ["shard", "path", "bytes"])
    runs = plan.groupBy("run").agg(F.count_distinct("tier").alias("tiers"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most")).collect()
    assert runs and all(r["tiers"] == 1 and r["bytes"] <= store.target + r["most"] for r in runs)


def test_a_version_is_committed_once(store, docs):
    store.append(docs)
    with pytest.raises(sharding.Taken, match="already exists"):
        store._commit(1, store.manifest(), docs.schema)
    assert store.version() == 1


def test_placed_has_every_row_once(store, docs, texts):
    store.append(docs.repartition(12, "text"))
    store.compact()
    placed = store.placed()
    assert pulled(placed, "doc_id") == sorted([(t[0],) for t in texts], key=repr)
    sums = placed.groupBy("shard").agg(F.count("*").alias("n"), F.max("shard_docs").alias("m")).collect()
    assert all(r["n"] == r["m"] for r in sums)


def test_an_empty_store_and_an_empty_arrival(spark, store, no_docs):
    assert store.version() == 0 and store.placed().collect() == []
    store.append(no_docs)
    assert store.compact() == 1 and store.read().collect() == [] and store.read().columns == no_docs.columns
    assert store.placed().collect() == []


def test_a_writer_that_dies_leaves_nothing_that_is_read(store, docs):
    store.append(docs)
    for name in ("commits/aside-1", "data/00000002-x/part-00000.parquet", "manifests/00000002-x/part-0.parquet"):
        out = store._fs.create(store._path(f"{store.root}/{name}"), False)
        out.write(bytearray(b"half of"))
        out.close()
    assert store.version() == 1 and store.read().count() == docs.count()
    assert store.append(docs) == 2 and store.read().count() == 2 * docs.count()
    store.vacuum(abandoned=-60)
    assert store.read().count() == 2 * docs.count()
    assert not any(store._fs.exists(store._path(f"{store.root}/{n}")) for n in ("commits/aside-1", "data/00000002-x/part-00000.parquet", "manifests/00000002-x/part-0.parquet"))


def test_narrower_and_wider_arrivals_keep_every_column(spark, store, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_TIER", 0)  # small files are one tier
    store.append(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"))
    store.append(spark.createDataFrame([(2, "b")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(3, 0.5)], "doc_id long, score double"))
    store.compact()
    store.vacuum()
    assert store.manifest().count() == 1 and store.read().columns == ["doc_id", "text", "lang", "score"]
    assert sorted(map(tuple, store.read().collect())) == [(1, "a", "en", None), (2, "b", None, None), (3, None, None, 0.5)]
    for schema in ("doc_id string", "DOC_ID long"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], schema))


def test_a_vacuum_during_an_append_spares_its_files(store, docs, monkeypatch):
    store.append(docs)
    plain = store._written

    def late(*args):
        rows = plain(*args)
        store.vacuum()
        return rows

    monkeypatch.setattr(store, "_written", late)
    store.append(docs)
    assert store.read().count() == 2 * docs.count()


def test_of_two_writers_the_later_adds_to_what_the_first_left(spark, store, docs, monkeypatch):
    store.append(docs)
    other = sharding.Store(spark, store.root, store.small, store.target, store.fan_in)
    plain, done = store._commit, []

    def late(version, entries, schema):
        if not done:
            done.append(other.append(docs))
        return plain(version, entries, schema)

    monkeypatch.setattr(store, "_commit", late)
    assert store.append(docs) == 3 and done == [2]
    assert store.read().count() == 3 * docs.count()
    done.clear()
    store.compact()  # another arrival comes while its first round is written
    assert store.read().count() == 4 * docs.count()


def test_tiny_shards_are_merged_in_runs_of_a_bounded_number(store, docs, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_SHARDS", 5)
    monkeypatch.setattr(sharding, "LANE_SHARDS", 6)
    store.append(docs.limit(40).repartition(24), rows_per_shard=1)
    runs = store.plan().groupBy("run").agg(F.count("*").alias("n")).collect()
    assert len(runs) > 3 and all(store.fan_in <= r["n"] <= 5 for r in runs)
    before = sorted(map(repr, store.read().collect()))
    store.compact(wave=2)
    assert sorted(map(repr, store.read().collect())) == before and store.manifest().count() < 24


def test_shards_of_an_arrival_are_small_and_tiers_rise(store, docs):
    for _ in range(9):
        store.append(docs)
        store.compact()
    assert store.manifest().agg(F.max("tier")).first()[0] > sharding.LEAST_TIER
    assert store.read().count() == 9 * docs.count()


def test_arrivals_cover_all_documents(spark, docs, no_docs):
    parts = list(sharding.arrivals(docs, 4))
    assert sorted(repr(r) for p in parts for r in p.collect()) == sorted(map(repr, docs.collect())) and all(p.count() for p in parts[:2])
    assert [p.count() for p in sharding.arrivals(no_docs, 4)] == [0]


def test_op10_keeps_conversations_of_any_id(spark, tmp_path):
    """Ids that a double cannot tell apart, and negative ones, against the query's SQL."""
    import duckdb
    from corvane.llm import registry

    ids = [*range(2**53, 2**53 + 8), 2**63 - 1, 2**63 - 2, -(2**63), -(2**63) + 1, -1, -2, -3, 0, 1, 5]
    rows = [(i, t, r, f"{r} {i % 7} {t}") for i in ids for t, r in enumerate(["user", "assistant", "user", "assistant"])]
    at = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(at)
    got = registry.QUERIES["op10_preference_pairs"](spark, str(tmp_path))
    names = sorted(got.columns)
    have = sorted(repr([r[c] for c in names]) for r in got.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/*.parquet'")
    said = con.execute(registry.ORACLE["op10_preference_pairs"])
    cols = [c[0] for c in said.description]
    assert have == sorted(repr([r[cols.index(c)] for c in names]) for r in said.fetchall()) and len(have) == len(ids)
    partner = {r["chosen_id"]: r["rejected_id"] for r in got.collect()}
    assert partner[2**53 + 3] == 2**53 + 2 and partner[-1] == -2 and partner[-3] is None and partner[5] is None
