import hashlib
import math
import re
import zlib
from collections import Counter

from corvane.llm import registry, resampling
from pyspark.sql import functions as F


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    features = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(words(text))))
    for text in items:
        t.update(map(bucket, features(words(text))))
    every_s, every_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every_s + 10000) / ((s[b] + 1) * (every_t + 10000))))
    out = []
    for i, text in docs:
        w = words(text)
        f = features(w)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    for place, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in out)


def test_op13_equals_brute_force(spark, docs, texts, tmp_path):
    items = [texts[3][1], "only Some words of a TARGET text", None, "", texts[7][1][:80]]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(str(i), x) for i, x in enumerate(items)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = registry.QUERIES["op13_importance_resampling"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == brute([(r[0], r[1]) for r in texts], items)


def test_nothing_to_draw_from(spark, docs, no_docs):
    assert resampling.resampled(no_docs, docs).collect() == []
    few = resampling.resampled(docs.filter("doc_id = 204"), no_docs).collect()
    assert len(few) == 1 and few[0]["rank"] is None and few[0]["n_features"] == 1


def test_places_follow_the_order_over_many_partitions(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"), "id").repartition(13)
    got = resampling.ranked(rows, [F.col("k").desc(), F.col("id").asc()]).collect()
    want = {r: n for n, r in enumerate(sorted(((r["k"], r["id"]) for r in got), key=lambda x: (-x[0], x[1])), 1)}
    assert {(r["k"], r["id"]): r["place"] for r in got} == want


def test_no_python_on_executors(spark, docs):
    plan = resampling.resampled(docs, docs.limit(3))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
