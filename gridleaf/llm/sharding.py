"""Sharding by jump consistent hashing (Lamping and Veach 2014).

``jump`` maps a stable 64-bit key to one of n shards by arithmetic alone: no ring, no table.  When a
shard is appended, a key either stays or moves into the new shard; 1 of n + 1 keys moves.  Key and
number of shards decide, nothing else: neither order, nor partitions, nor other rows.

The stable key of a row is the first 60 bits of the MD5 of its key column as text, so ids of any type
will do and neighbouring ids do not meet.

* ``place`` adds shard, grown_shard, size and digest to the keys and never shuffles a text.
* ``slots`` numbers the rows of every shard without gaps, in the order of shard, key, size and digest.  Rows (numbers only, no
  text) are dealt out by ranges, written once, and every part is counted; the sums of the counts, one row a part and shard, are joined back.
* ``write`` puts whole rows into one folder a shard; ``grow`` appends a shard to such folders: it reads all keys,
  but writes only the rows that move, and says what stays.

A null key is a key of its own, like an empty one: its rows are all in one shard.  Null and empty texts have size 1.  Rows of
one key are all in one shard, however many they are; of repeated rows each has a slot of its own; ties (rows alike in key, size and
digest) take slots in any order.  Texts of any length count whole.  An empty table gives an empty one.  Extra columns are not
read; a key column named as a result is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridleaf.llm.shared import no_clash, written

#: The generator of the published algorithm, a fixed value.
FACTOR = np.uint64(2862933555777941757)
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("there is no shard")
    state = keys.astype(np.uint64)
    shard, then = np.full(len(state), -1, dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    going = np.arange(len(state))
    while len(going):
        shard[going] = then[going]
        state[going] = state[going] * FACTOR + np.uint64(1)
        share = float(1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1)
        then[going] = ((shard[going] + 1) * share).astype(np.int64)
        going = going[then[going] < shards]
    return shard


def stable_key(key: Column) -> Column:
    """60 bits that depend on the text of the key alone."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column of any type, 0 to ``shards`` - 1."""
    if shards < 1:
        raise ValueError("there is no shard")

    @F.arrow_udf("int")
    def jumped(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.to_numpy(zero_copy_only=False), shards), pa.int32())

    return jumped(stable_key(key))


def place(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard and grown_shard (with one shard more) of every row."""
    no_clash([key], RESULTS)
    bytes_of = F.coalesce(F.col(text), F.lit("")).cast("binary")
    measured = df.select(F.col(key), (F.octet_length(bytes_of) + F.lit(1)).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32"))
    return measured.select("*", F.lit("key").alias("law"), shard_of(F.col(key), shards).alias("shard"), shard_of(F.col(key), shards + 1).alias("grown_shard"))


def numbered(df: DataFrame, order: list[Column], name: str, number: str, group: str | None = None) -> DataFrame:
    """``df`` with ``number``, the place of each row in ``order`` from 0 on, over all rows or within each ``group``, by which ``order`` then begins.

    Rows are dealt out by ranges of the order, split further by their place in the input where they are alike; no
    task sees more than its range.  Sums of counts are one row a range and group.
    """
    place_in = F.monotonically_increasing_id()
    ranged = df.withColumn("__tie", place_in).repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    ranged = written(ranged.withColumn("__at", F.monotonically_increasing_id()), name)
    # The upper bits of an __at are the part, the lower ones count within it.
    part = F.shiftright("__at", 33)
    counts = ranged.groupBy(part.alias("__part"), *([group] if group else [])).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    parts = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("__part")
    before = counts.select("__part", *([group] if group else []), (F.sum("__n").over(parts) - F.col("__n") - F.col("__first")).alias("__before"))
    keys = ["__part", *([group] if group else [])]
    joined = ranged.withColumn("__part", part).join(F.broadcast(before), keys)
    return joined.select(*df.columns, (F.col("__at") + F.col("__before")).alias(number))


def slots(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """What ``place`` gives, with the slot of each row in its shard, gapless from 0."""
    order = [F.col(c) for c in ("shard", key, "size", "text_crc32")]
    return numbered(placed, order, "slots", "slot", "shard")


def assign(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``RESULTS`` of every row."""
    return slots(place(df, shards, key, text), key).select(key, *RESULTS)


def write(df: DataFrame, folder: str, shards: int = 8, key: str = "doc_id") -> None:
    """Whole rows in folders ``shard=0`` ...; every task writes its rows where they belong, no text is shuffled."""
    no_clash(df.columns, ("shard",))
    df.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(folder)


def read(spark: SparkSession, folder: str, shard: int | None = None) -> DataFrame:
    """All shards with their number, or the rows of one, of which alone the files are then read."""
    rows = spark.read.parquet(folder)
    return rows if shard is None else rows.where(F.col("shard") == shard).drop("shard")


def grow(spark: SparkSession, folder: str, grown: str, shards: int, key: str = "doc_id") -> DataFrame:
    """Append shard number ``shards`` to what ``write`` made with so many: the rows that move there are written to ``grown``.

    Gives the keys that moved and the shard that each came from; a reader takes the old folder without them and the new one.
    """
    rows = read(spark, folder)
    moved = rows.withColumn("__to", shard_of(F.col(key), shards + 1)).where(F.col("__to") != F.col("shard"))
    moved.drop("__to").withColumnRenamed("shard", "from_shard").withColumn("shard", F.lit(shards)).write.partitionBy("shard").parquet(grown)
    return spark.read.parquet(grown).select(key, "from_shard").distinct()
