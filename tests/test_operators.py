import pytest
from corvane.operators import joins, ranking, retrieve, search
from corvane.streaming import leases, monitor, waits
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_reachability_ends_on_cycles_and_self_links(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (3, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (4,), (9,)], "node long")
    got = sorted(tuple(r) for r in joins.reachable(edges, seeds).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 5, 3), (4, 4, 0), (9, 9, 0)]


def test_cosine_without_length_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(joins.cosine(df.a, df.b)).collect()]
    assert got[0] is None and abs(got[1] - 1) < 1e-12


@pytest.mark.parametrize("few,walked", [(10_000, 200), (10_000, 1), (1, 1)])
def test_terms_of_any_length_are_found_on_every_path(spark, monkeypatch, few, walked):
    monkeypatch.setattr(joins, "FEW_TERMS", few)
    monkeypatch.setattr(joins, "WALKED_TERMS", walked)
    rows = [(1, "a b c d e f"), (2, "x " * 40 + "a b"), (3, "b a"), (4, None), (5, "")]
    terms = ["a b c d e", "a b", "x " * 40, "c", "e f g", "A  B", "", None]
    got = joins.contains(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    want = [(1, "a b c d e"), (1, "a b"), (1, "A  B"), (1, "c"), (2, "x " * 40), (2, "a b"), (2, "A  B")]
    assert sorted((r["id"], r["term"]) for r in got.collect()) == sorted(want)


def test_more_is_returned_than_lists_contribute_by_default(spark):
    docs = spark.createDataFrame([(f"u{i:04d}", f"heron number {i}") for i in range(700)], "uri string, text string")
    assert search.explore(docs, "heron", most=650).count() == 650


def test_governs_without_globs_or_targets(spark):
    capsules = spark.createDataFrame([("c", [], 1), ("d", ["**", "!x://**"], 2)], "capsule string, relevance array<string>, n int")
    targets = spark.createDataFrame([("x://a",), ("y://a",), (None,)], "uri string")
    assert [(r["uri"], r["capsule"]) for r in joins.governs(targets, capsules).collect()] == [("y://a", "d")]
    with pytest.raises(ValueError):
        joins.governs(targets.withColumn("n", F.lit(1)), capsules)


@pytest.mark.parametrize("few", [10_000, 0])
def test_wide_terms_govern_alike_sent_or_shuffled(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "WIDE_TERMS", few)
    globs = {"all": ["**"], "x": ["x://**;!x://h/b/**"], "deep": ["x://h/a/**", "x://h/a/f1"], "star": ["x://*/a/*", "y:**"], "none": ["z://q/**"]}
    capsules = spark.createDataFrame(list(globs.items()), "capsule string, relevance array<string>")
    uris = [f"x://{h}/{d}/f{i}" for h in ("h", "k") for d in "ab" for i in range(3)] + ["y://a", "plain", None]
    got = {(r["uri"], r["capsule"]) for r in joins.governs(spark.createDataFrame([(u,) for u in uris], "uri string"), capsules).collect()}
    want = {(u, "all") for u in uris if u}
    want |= {(u, "x") for u in uris if u and u.startswith("x://") and not u.startswith("x://h/b/")}
    want |= {(u, "deep") for u in uris if u and u.startswith("x://h/a/")} | {(u, "star") for u in uris if u and ("/a/" in u or u == "y://a")}
    assert got == want


@pytest.mark.parametrize("few,chars", [(200, 1), (1, 1_000), (1, 5)])
def test_redundant_aliases_on_every_path(spark, monkeypatch, few, chars):
    monkeypatch.setattr(joins, "WALKED_TERMS", few)
    monkeypatch.setattr(joins, "ALIAS_CHARS", chars)
    texts = ["one queue here", "żółw 🐢 a\nb", "", None, "x" * 200_000 + "tail"]
    wanted = ["que", "queue", "ue h", "🐢 a\nb", "xtail", "", "Queue", "nowhere", "xxxtailx", "ó", None, "que"]
    got = joins.redundant(spark.createDataFrame([(a,) for a in wanted], "alias string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    want = [(a, a is not None and any(a in t for t in texts if t is not None)) for a in wanted]
    assert sorted(map(repr, got.collect())) == sorted(f"Row(alias={a!r}, redundant={r})" for a, r in want)
    nothing = joins.redundant(spark.createDataFrame([("a",), ("",)], "alias string"), spark.createDataFrame([], "text string"))
    assert {r["redundant"] for r in nothing.collect()} == {False}


@pytest.mark.parametrize("keywords,question", [("heron bay", "where is the heron"), ("heron", ""), ("", "the bay"), ("", ""), ("zzz", "")])
def test_explore_scores_as_its_parts_do(spark, keywords, question):
    rows = [("a", "the heron heron stood"), ("b", "a bay, the bay"), ("c", None), ("d", ""), ("e", "HERON bay is_here"), ("f", "nothing"), ("g", "heron " * 5_000), (None, "heron")]
    docs = spark.createDataFrame(rows, "uri string, text string")
    lists = [search.bm25(docs, keywords, "uri"), search.vector_scores(docs, keywords, "uri"), search.bm25(docs, question, "uri")]
    assert search.explore(docs, keywords, question).collect() == search.fused(lists, "uri", 10).collect()


@pytest.mark.parametrize("most", [500_000, 3])
def test_words_are_counted_by_text(spark, monkeypatch, most):
    monkeypatch.setattr(search, "COUNTED", most)
    texts = ["Heron heron bay", "bay_1 ÉTÉ été", None, "", "the bay", "heron été the"] * 30
    got = {r["term"]: (r["df"], r["with"]) for r in search.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text", ["heron"]).collect()}
    assert got == {"heron": (60, 60), "bay": (60, 30), "bay_1": (30, 0), "été": (60, 30), "the": (60, 30)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=12), st.integers(0, 25))
def test_budget_fit_is_the_longest_prefix(spark, costs, budget):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(costs)], "id long, c long")
    got = sorted(r["id"] for r in ranking.fit_budget(df, [F.col("id")], F.col("c"), budget).collect())
    used, want = 0, []
    for i, c in enumerate(costs):
        used += max(1, c)
        if used > budget:
            break
        want.append(i)
    assert got == want


def test_ceiling_and_limits(spark):
    with pytest.raises(ValueError, match="narrow"):
        ranking.at_most(spark.range(5), 4)
    assert ranking.at_most(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        search.grep(spark.createDataFrame([], "uri string, text string"), "")


def test_smart_case():
    assert search.insensitive("abc", False, None) and not search.insensitive("Abc", False, None)
    assert not search.insensitive("abc", True, None) and search.insensitive("Abc", False, False) and not search.insensitive("abc", False, True)


def test_patches_are_unified(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "same", "same"), (3, None, "new")], "id long, old string, new string")
    got = {r["id"]: (r["insertions"], r["deletions"]) for r in retrieve.patches(df, "id", "old", "new").collect()}
    assert got == {1: (2, 1), 3: (1, 0)}


NOTHING = monitor.Facts(None, None, None, None, None, False, False, None, None)


def test_the_fold_drops_what_is_late_and_tells_of_changes_alone():
    said = NOTHING._replace(pid=1, started=2)
    first = monitor.after(monitor.View(), said, 0)
    assert first.connection == "connected" and monitor.after(first, said, 1) == first
    late = [(5, 0, said), (4, 0, NOTHING._replace(link="lost")), (6, 0, said)]
    assert list(monitor.folded(late, last=4)) == [(5, 0, first, None)]
    lost = monitor.after(first, NOTHING._replace(link="lost"), 2)
    assert lost.pid == 1 and lost.connection == "lost"
    ((_, _, other, told),) = monitor.folded([(7, 3, said._replace(started=3))], lost)
    assert told == monitor.RESTARTED and other.started == 3


def test_a_new_run_takes_over_nothing_and_hidden_work_keeps_its_time():
    busy = monitor.after(monitor.View(), NOTHING._replace(pid=1, started=1, version="1", files=5, news=True, work="w", percent=3), 10)
    assert busy.line(10_009) is None and busy.line(10_010) == "w 3%"
    quiet = monitor.after(busy, NOTHING._replace(news=True), 20)
    assert quiet.work is None and quiet.busy_since == 10
    again = monitor.after(quiet, NOTHING._replace(news=True, work="v"), 30)
    assert (again.work, again.percent, again.busy_since) == ("v", None, 10)
    assert monitor.after(again, NOTHING._replace(news=True, idle=True), 40).busy_since is None
    fresh = monitor.after(again, NOTHING._replace(pid=2, started=1), 50)
    assert fresh == monitor.View("connected", 2, 1)


def test_facts_of_records(spark):
    from corvane.streaming import feeds

    lines = [
        '{"type": "monitor.connection", "state": "lost", "host_pid": 1, "host_started_at_unix_ms": 2}',
        '{"signal": "progress", "host_pid": 1, "operation": "import:github.com/a/b", "operation_done": 1, "operation_total": 4, "registry_complete": 9, "version": ""}',
        '{"signal": "progress", "settled": true, "operation": "startup"}',
        '{"signal": "hello", "host_pid": 1, "host_started_at_unix_ms": 2, "version": "3", "operation": "startup", "registry_complete": 1}',
    ]
    df = monitor.facts(feeds.parsed(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)))
    assert [monitor.Facts(*r) for r in df.collect()] == [
        NOTHING._replace(link="lost"),
        NOTHING._replace(news=True, files=9, work="importing github://a/b", percent=25),
        NOTHING._replace(news=True, idle=True),
        NOTHING._replace(pid=1, started=2, version="3"),
    ]


def test_operations_in_words(spark):
    from corvane.functions.scalars import described

    cases = {
        ("startup", None): "indexing this repository", ("import:github.com/a/b", None): "importing github://a/b", ("import:x", "github://a/b/"): "importing github://a/b",
        ("import:/worktree://w/", None): None, ("import:", ""): None, ("sweep", None): None, (None, None): None, ("import:git.example/g", ""): "importing git.example/g",
    }
    df = spark.createDataFrame(list(cases), "o string, f string")
    assert [r[0] for r in df.select(described(df.o, df.f)).collect()] == list(cases.values())


def test_a_call_has_one_result():
    assert waits.only_result([("progress", 1), ("result", "x")]) == "x"
    for events in ([], [("result", 1), ("progress", 2)], [("other", 1)]):
        with pytest.raises(ValueError):
            waits.only_result(events)


def test_a_failed_refresh_keeps_the_value():
    answers = iter([1])
    cache = waits.Stale(lambda: next(answers), clock=lambda: 0.0)
    assert cache.get() == (1, False)
    cache.refresh()
    assert cache.get()[0] == 1


def test_idle_times_cross_hours(spark):
    spans = [("2024-01-01 00:10:00", "2024-01-01 03:30:00"), ("2024-01-01 03:20:00", "2024-01-01 03:40:00"), ("2024-01-01 05:00:00", "2024-01-01 05:10:00")]
    held = spark.createDataFrame(spans, "a string, b string").select(F.col("a").cast("timestamp").alias("began"), F.col("b").cast("timestamp").alias("ended"))
    got = [(str(r["began"]), str(r["ended"])) for r in leases.idle(held, 60).selectExpr("cast(began as string) began", "cast(ended as string) ended").collect()]
    assert got == [("2024-01-01 03:40:00", "2024-01-01 05:00:00")]
