"""Live processes over several batches: created, replaced, deleted, expired by a timer."""

import datetime

from gridleaf.streaming.live import live_processes

SCHEMA = "process_id string, structure string, created_at timestamp, deleted boolean"


def at(seconds):
    return datetime.datetime.fromtimestamp(1_700_000_000 + seconds, datetime.UTC)


def test_life_of_processes(spark, tmp_path):
    folder, results = str(tmp_path / "events"), str(tmp_path / "changes")
    batches = [
        [("a", "a1", at(0), False), ("b", "b1", at(1), False), ("c", "c1", at(2), False), (None, "x", at(2), False), ("x", "x", None, False)],
        [("a", "a2", at(5), False), ("b", None, at(6), True), ("nobody", None, at(6), True), ("c", "c0", at(-3), False)],
        [("d", "d1", at(13), False), ("a", "a2 again", at(5), False)],  # c, of second 2, is gone after this batch
        [("e", "e1", at(16), False), ("b", "b2", at(14), False), ("f", "f1", at(15), False), ("f", None, at(15), True)],
        [("e", "e2", at(40), False)],
    ]
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        changes = live_processes(spark.readStream.schema(SCHEMA).parquet(folder), 10)
        query = changes.writeStream.format("parquet").option("path", results).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        rows = {(r["process_id"], r["change"], r["structure"], int(r["at"].timestamp()) - 1_700_000_000) for r in spark.read.schema("process_id string, change string, structure string, at timestamp").parquet(results).collect()}
        seen.append(rows - set().union(*seen))
    assert seen[0] == {("a", "created", "a1", 0), ("b", "created", "b1", 1), ("c", "created", "c1", 2)}
    assert seen[1] == {("a", "replaced", "a2", 5), ("b", "deleted", "b1", 6)}
    assert seen[2] == {("d", "created", "d1", 13), ("c", "expired", "c1", 12)}
    assert ("a", "expired", "a2", 15) in seen[3] and ("b", "created", "b2", 14) in seen[3] and ("e", "created", "e1", 16) in seen[3] and not any(r[0] == "f" for r in seen[3])
    assert {("d", "expired", "d1", 23), ("b", "expired", "b2", 24)} <= seen[4]
    assert not any(r[0] in ("x", "nobody", None) for rows in seen for r in rows)
