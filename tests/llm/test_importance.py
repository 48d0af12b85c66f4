"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridleaf.llm import importance
from gridleaf.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def buckets_by_hand(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def expected(rows, targets, least=20, percent=5):
    """Rows as a multiset of (key, n_features, weight, score, rank)."""
    docs = [(k, *buckets_by_hand(t)) for k, t in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in targets for b in buckets_by_hand(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (all_s + 10_000)) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    scored = []
    for k, n, own in docs:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        scored.append((k, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((d for d in scored if d[1] >= least), key=lambda d: (-d[4], d[0] is not None, d[0] or 0))
    drawn = percent * len(able) // 100
    out = [(d[0], *d[2:], i + 1 if i < drawn else None) for i, d in enumerate(able)]
    return Counter(out + [(d[0], *d[2:], None) for d in scored if d[1] < least])


def test_words_and_buckets_by_hand(spark):
    texts = ["", None, "a", "A b", "Ärger, ÄRGER x9!", "one\x00two\x7fthree__four five", "9 KK z-z z z z", "  lead and trail. ", "🎉 漢字 x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    cut = df.select("i", importance.words(F.col("text")).alias("w"))
    for r in cut.select("i", "w", importance.bucket_array(F.col("w")).alias("b")).collect():
        n, want = buckets_by_hand(texts[r["i"]])
        assert (len(r["w"]), sorted(r["b"])) == (n, sorted(want)), texts[r["i"]]


ROWS = [(3, "b c " * 15), (1, None), (2, ""), (None, "null key of some words " * 5), (3, "b c " * 15), (9, "word " * 20_000), (None, None), (-5, "é漢 " * 19), (4, "é漢 " * 20)] + [(100 + i, f"words of text number {i} " * 5) for i in range(60)]


def test_edges(spark):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in ROWS], "doc_id long, text string, rank long, __words string").repartition(3)
    targets = ["b c d", None, "", "number 7"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "weight long, text string")
    found = importance.resample(df, items)
    assert found.columns == ["doc_id", *importance.RESULTS]
    assert Counter(map(tuple, found.collect())) == expected(ROWS, targets)
    assert Counter(map(tuple, importance.resample(df, items, least_words=0, percent=50).collect())) == expected(ROWS, targets, 0, 50)
    assert Counter(map(tuple, importance.resample(df, items.limit(0)).collect())) == expected(ROWS, [])
    assert importance.resample(df.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        importance.resample(df.drop("rank").withColumnRenamed("doc_id", "rank"), items, key="rank")


def test_ties_and_hot_copies(spark):
    rows = [(5, "the same words again and again " * 4)] * 200 + [(i % 7, "other words than those " * 6) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([("other words",)], "text string")
    assert Counter(map(tuple, importance.resample(df, items, percent=60).collect())) == expected(rows, ["other words"], percent=60)


def test_draw_prefers_the_target(spark):
    rows = [(i, ("red green blue " if i % 10 == 0 else f"plain{i % 3} words only ") * 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = importance.draw(df, spark.createDataFrame([("red green blue red green blue",)], "text string")).collect()
    assert len(drawn) == 50 and all(r["doc_id"] % 10 == 0 for r in drawn)


def test_scoring_explodes_nothing(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = importance.score(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Generate", "Exchange", "Python", "Arrow"))


def test_query(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    found = QUERIES["op11_importance"](spark, sf)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == expected([(r["doc_id"], r["text"]) for r in docs], [r["text"] for r in items])
