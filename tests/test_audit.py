import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import audit
from lattica.streaming.audit import write_events

ID = "123e4567-e89b-12d3-a456-426614174000"
VALUES = {"user_id": ID, "unlocked_by": ID, "success": True, "account_locked": False, "logout_all_devices": True, "failed_attempts": 3, "locked_until": "2024-05-01T10:00:00Z"}


def _whole(kind):
    return {f: VALUES.get(f, f"some {f}") for f, _ in audit.fields(kind)}


def _records(spark, rows):
    return spark.createDataFrame([(i, kind, text) for i, (kind, text) in enumerate(rows)], "id long, event_type string, payload string")


@pytest.mark.parametrize("kind", sorted(audit.SHAPES))
def test_shapes(spark, kind):
    rows, want = [(kind, json.dumps(_whole(kind)))], [None]
    for name, required in audit.fields(kind):
        rows.append((kind, json.dumps({k: v for k, v in _whole(kind).items() if k != name})))
        want.append(f"Missing field: {name}" if required else None)
        if name in audit.TYPES or name in audit.IDS:
            rows.append((kind, json.dumps({**_whole(kind), name: "neither"})))
            want.append(f"Wrong type: {name}")
    judged = audit.checked(_records(spark, rows)).orderBy("id")
    assert [r.problem for r in judged.select("problem").collect()] == want
    first = audit.typed(judged.where("id = 0")).first()
    assert {c for c in audit.ALL_FIELDS if first[c] is not None} == set(_whole(kind))
    assert all(first[c] == VALUES[c] for c in ("success", "failed_attempts", "user_id") if c in _whole(kind))


def test_what_fits_no_kind(spark):
    rows = [("nothing", "{}"), (None, "{}"), ("logout", "{not json"), ("logout", None), ("logout", "[]")]
    assert [r.problem for r in audit.checked(_records(spark, rows)).orderBy("id").select("problem").collect()] == [
        "Unknown kind: nothing", "Unknown kind: ", "Not JSON", "Not JSON", "Missing field: user_id"]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    rows = [(kind, json.dumps(_whole(kind))) for kind in audit.SHAPES] + [("logout", "{}")]
    root = str(tmp_path / "audit")
    for _ in range(2):
        audit.write(_records(spark, rows), root, 7)
    audit.write(_records(spark, rows[:2]), root, 8)
    assert audit.read(spark, root).count() == len(audit.SHAPES) + 2
    assert spark.read.parquet(f"{root}/rejected").count() == 1
    locked = audit.read(spark, root, "account_locked")
    assert [(r.failed_attempts, str(r.locked_until)) for r in locked.collect()] == [(3, "2024-05-01 10:00:00")]
    assert len(locked.inputFiles()) == 1 or "event_type" in locked._jdf.queryExecution().executedPlan().toString()


def test_stream_writes_each_event_once(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(kind, json.dumps(_whole(kind))) for kind in audit.SHAPES]
    _records(spark, rows).write.json(source)
    stream = spark.readStream.schema("id long, event_type string, payload string").json(source)
    for _ in range(2):
        query = write_events(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
        _records(spark, rows[:3]).write.mode("append").json(source)
    got = audit.read(spark, str(tmp_path / "out")).groupBy("event_type").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == len(rows) + 3 and len(got) == len(audit.SHAPES)
