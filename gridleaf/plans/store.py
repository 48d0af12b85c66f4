"""The process store: documents and their structure for a limited time.

An append-only Parquet table of events in buckets by a hash of the process id, compacted bucket by bucket at will:
creating appends a row, deleting appends a tombstone, reading takes each id's last row if
it has not expired.  A lookup reads the buckets of its ids alone; it finds the last events by ids and versions, and
fetches only the documents that are asked for.  All of it is DataFrame work, so thousands of ids are one job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("process_id", T.StringType()),
    T.StructField("pdf", T.BinaryType()),
    T.StructField("structure", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("expires_at", T.TimestampType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("version", T.LongType()),
    T.StructField("event", T.StringType()),
])
TTL_SECONDS = 24 * 3600
#: Folders of a store; a fixed number, since it is part of the layout.
BUCKETS = 64


def bucket_of(process_id: Column) -> Column:
    return F.pmod(F.xxhash64(process_id), F.lit(BUCKETS)).cast("int")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, or on one machine a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gridleaf-"))
            held = context._jsc.sc().getCheckpointDir()
        root = held.get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to a shared folder and read back: made once, and safe when an executor is lost."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def latest(events: DataFrame, keys: list[str], version: str | Column = "version") -> DataFrame:
    """The last row of each key: one aggregation, pre-combined before the shuffle."""
    others = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("e"))
    return last.select(*keys, *(F.col(f"e.{c}").alias(c) for c in others))


def live(events: DataFrame, now: Column) -> DataFrame:
    """Last rows that are neither deleted nor expired; an entry is gone at its expiry, and of one version a deletion is the last."""
    last = F.struct("version", F.coalesce("deleted", F.lit(False)))
    return latest(events, ["process_id"], last).where(~F.coalesce("deleted", F.lit(False)) & (F.col("expires_at") > now))


def last_events(events: DataFrame, now: Column) -> DataFrame:
    """process_id, bucket and event of the last rows that are neither deleted nor expired; of one instant a tombstone is the last."""
    head = F.struct("version", F.coalesce("deleted", F.lit(False)).alias("deleted"), "event", "expires_at")
    last = events.groupBy("process_id", "bucket").agg(F.max(head).alias("e")).where(~F.col("e.deleted") & (F.col("e.expires_at") > now))
    return last.select("process_id", "bucket", F.col("e.event").alias("event"))


class ProcessStore:
    """A store in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = TTL_SECONDS):
        self.spark, self.path, self.ttl = spark, path, ttl_seconds

    def events(self, buckets: list[int] | None = None) -> DataFrame:
        """All events, or those of some buckets, of which alone the files are read."""
        schema = T.StructType([*SCHEMA.fields, T.StructField("bucket", T.IntegerType())])
        try:
            rows = self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _append(self, rows: DataFrame) -> None:
        whole = rows.withColumn("event", F.expr("uuid()")).select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA.fields), bucket_of(F.col("process_id")).alias("bucket"))
        whole.write.mode("append").partitionBy("bucket").parquet(self.path)

    def create(self, documents: DataFrame, now: Column | None = None) -> DataFrame:
        """Store documents (pdf, structure) under new ids; returns what was stored, with process_id.

        The ids are drawn once: the rows are read back from what was written.
        """
        now = F.current_timestamp() if now is None else now
        path = f"{self.path.rstrip('/')}-new/{uuid.uuid4().hex}"
        documents.withColumn("process_id", F.expr("uuid()")).write.parquet(path)
        stored = self.spark.read.parquet(path)
        self.put(stored, now)
        return stored

    def put(self, rows: DataFrame, now: Column | None = None) -> None:
        """Store rows (process_id, pdf, structure)."""
        now = F.current_timestamp() if now is None else now
        added = rows.withColumn("created_at", now).withColumn("expires_at", F.timestamp_seconds(F.unix_micros(now) / 1e6 + self.ttl))
        self._append(added.withColumn("deleted", F.lit(False)).withColumn("version", F.unix_micros(now)))

    def get(self, ids: DataFrame, now: Column | None = None) -> DataFrame:
        """ids (process_id) with pdf, structure and created_at; null if missing, expired or deleted.

        What is found is a small table of ids and events, written; as long as it may be broadcast no document is shuffled.
        """
        now = F.current_timestamp() if now is None else now
        asked = ids.select("process_id", bucket_of(F.col("process_id")).alias("bucket"))
        buckets = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # at most BUCKETS numbers
        events = self.events(buckets)
        heads = events.select("process_id", "bucket", "version", "deleted", "expires_at", "event").join(asked.distinct(), ["bucket", "process_id"], "left_semi")
        found = kept(asked.join(last_events(heads, now), ["process_id", "bucket"], "left").select("process_id", "bucket", "event"), "found")
        columns = ["pdf", "structure", "created_at"]
        there = found.where("event is not null").join(events.select("bucket", "event", *columns), ["bucket", "event"])
        none = [F.lit(None).cast(SCHEMA[c].dataType).alias(c) for c in columns]
        return there.select("process_id", *columns).unionByName(found.where("event is null").select("process_id", *none))

    def delete(self, ids: DataFrame, now: Column | None = None) -> None:
        """Deleting what is not there, or twice, changes nothing."""
        now = F.current_timestamp() if now is None else now
        nothing = {f.name: F.lit(None).cast(f.dataType) for f in SCHEMA.fields}
        gone = nothing | {"process_id": F.col("process_id"), "deleted": F.lit(True), "version": F.unix_micros(now)}
        self._append(ids.select(*(c.alias(n) for n, c in gone.items())))

    def compact(self, target: str, now: Column | None = None, buckets: list[int] | None = None) -> ProcessStore:
        """A store at ``target`` with the live rows only; with ``buckets`` only those are written anew there, so that a large store is compacted bit by bit.

        Documents stay where they are until the few columns that tell which are live have met.
        """
        now = F.current_timestamp() if now is None else now
        events = self.events(buckets)
        held = kept(last_events(events.select("process_id", "bucket", "version", "deleted", "expires_at", "event"), now).select("bucket", "event"), "live")
        rows = events.join(held, ["bucket", "event"]).select(*SCHEMA.names, "bucket")
        writer = rows.write.mode("overwrite").partitionBy("bucket")
        if buckets is None:
            writer.parquet(target)
        else:
            stale = [b for b in buckets if b not in {r["bucket"] for r in held.select("bucket").distinct().collect()}]
            writer.option("partitionOverwriteMode", "dynamic").parquet(target)
            for b in stale:  # nothing is left of it
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/bucket={b}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return ProcessStore(self.spark, target, self.ttl)
