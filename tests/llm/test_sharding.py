"""Sharding against plain Python, and its promise when a shard is appended."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridleaf.llm import sharding
from gridleaf.llm.queries import QUERIES


def jump_by_hand(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def key_of(value):
    return int(hashlib.md5(("" if value is None else str(value)).encode()).hexdigest()[:15], 16)


def test_jump_matches_one_key_at_a_time():
    keys = np.r_[np.random.default_rng(3).integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 1, 2**64 - 1], dtype=np.uint64)]
    for shards in (1, 2, 7, 8, 9, 1000):
        assert sharding.jump(keys, shards).tolist() == [jump_by_hand(int(k), shards) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_one_more_shard_takes_its_part_only():
    keys = np.random.default_rng(4).integers(0, 2**64, 100_000, dtype=np.uint64)
    for shards in (1, 8, 99):
        before, after = sharding.jump(keys, shards), sharding.jump(keys, shards + 1)
        assert set(after[before != after].tolist()) <= {shards}
        assert abs((before != after).mean() - 1 / (shards + 1)) < 0.01
        assert np.bincount(before, minlength=shards).max() < 1.2 * len(keys) / shards + 100


def expected(rows, shards=8):
    out, held = [], defaultdict(list)
    for key, text in rows:
        raw = (text or "").encode()
        held[jump_by_hand(key_of(key), shards)].append((key is not None, key or 0, len(raw) + 1, zlib.crc32(raw), jump_by_hand(key_of(key), shards + 1)))
    for shard, members in held.items():
        out += [(m[1] if m[0] else None, m[2], m[3], "key", shard, slot, m[4]) for slot, m in enumerate(sorted(members))]
    return Counter(out)


COLUMNS = ["doc_id", *sharding.RESULTS[:5], "grown_shard"]


def test_edges(spark):
    rows = [(3, "b c"), (1, None), (2, ""), (None, "null key"), (3, "b c"), (3, "a"), (9, "word " * 20_000), (None, None), (-5, "é漢")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, slot long, shard string").repartition(4)
    found = sharding.assign(df.select("doc_id", "text", "slot", "shard"))
    assert found.columns == COLUMNS
    assert Counter(map(tuple, found.collect())) == expected(rows)
    assert sharding.assign(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(df.withColumnRenamed("slot", "Size"), key="Size")


def test_hot_key_and_partitions_do_not_matter(spark):
    rows = [(7 if i % 3 == 0 else i, f"text {i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 9):
        found = [tuple(r) for r in sharding.assign(df.repartition(parts)).collect()]
        assert Counter(found) == expected(rows)


def test_keys_of_any_type(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "name string, body string")
    found = {r["name"]: r["shard"] for r in sharding.assign(df, 5, "name", "body").collect()}
    assert found == {k: jump_by_hand(key_of(k), 5) for k in ("a", "b", None)}


def test_folders_grow(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    sharding.write(df, str(tmp_path / "a"), 4)
    moved = {r["doc_id"]: r["from_shard"] for r in sharding.grow(spark, str(tmp_path / "a"), str(tmp_path / "b"), 4).collect()}
    old = {r["doc_id"]: r["shard"] for r in sharding.read(spark, str(tmp_path / "a")).collect()}
    assert old == {i: jump_by_hand(key_of(i), 4) for i in range(2000)}
    assert moved == {i: s for i, s in old.items() if jump_by_hand(key_of(i), 5) == 4}
    assert sorted(r["text"] for r in sharding.read(spark, str(tmp_path / "b"), 4).collect()) == sorted(f"text {i}" for i in moved)
    with pytest.raises(ValueError):
        sharding.write(df.withColumn("shard", F.lit(1)), str(tmp_path / "c"), 4)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op13_jump_shards"](spark, sf)
    assert found.columns == COLUMNS
    assert Counter(map(tuple, found.collect())) == expected(rows)
