import datetime

import pytest

from faultlens.operators import incidents
from faultlens.operators.logtext import key_block_lines
from faultlens.streaming import logs, state

@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


LINES = "artifact_id string, line_no bigint, line string"


def feed(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, df, folder):
    """All rows the stream gives; its state stays in ``folder/progress``."""
    run = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def test_key_block_that_spans_batches(spark, tmp_path):
    batches = [[("a", 1, "x"), ("a", 2, "-----BEGIN PRIVATE KEY-----"), ("b", 1, "keep")], [("a", 3, "secret"), ("b", 2, "keep2"), (None, 1, None)],
               [("a", 5, "after"), ("a", 4, "-----END PRIVATE KEY-----")]]
    rows = logs.key_block_stream(feed(spark, tmp_path / "in", batches, LINES), ["artifact_id"], "line_no")
    got = sorted((tuple(r) for r in drained(spark, rows, tmp_path).collect()), key=str)
    whole = spark.createDataFrame([row for rows in batches for row in rows], LINES)
    assert got == sorted((tuple(r) for r in key_block_lines(whole, ["artifact_id"], "line_no").collect()), key=str)
    assert got == sorted([("a", 1, "x"), ("a", 2, "[REDACTED:private_key]"), ("a", 5, "after"), ("b", 1, "keep"), ("b", 2, "keep2"), (None, 1, None)], key=str)
    assert state.state_table(spark, f"{tmp_path}/progress", "open").count() == 0  # closed blocks leave nothing behind


SIGHTINGS = "artifact_id bigint, ts timestamp, dedup_key string, kind string, message string"


def at(day):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


def test_recurrence_counts_run_across_batches(spark, tmp_path):
    batches = [[(2, at(1), "k", "timeout", "m2"), (1, at(0), "k", "timeout", "m1")], [(3, at(2), "k", None, "m3"), (4, at(2), "j", "unknown", "")]]
    rows = state.recurrence_stream(feed(spark, tmp_path / "in", batches, SIGHTINGS), ["ts", "artifact_id"])
    counts = {r.artifact_id: (r.occurrence_count, r.is_duplicate_of, r.recurring) for r in drained(spark, rows, tmp_path).collect()}
    assert counts == {1: (1, None, False), 2: (2, "k", False), 3: (3, "k", True), 4: (1, None, False)}
    store = [tuple(r) for r in state.incident_store(spark, f"{tmp_path}/progress").collect()]
    assert store == [("k", "timeout", "m1", 3, at(0), at(2))]


def test_batches_give_what_one_batch_gives(spark, tmp_path):
    rows = [(i, at(i // 3), "hot" if i % 3 else f"k{i % 7}", "unknown" if i % 11 == 0 else "timeout", f"m{i}") for i in range(120)]
    whole = incidents.recurrence(spark.createDataFrame(rows, SIGHTINGS), ["ts", "artifact_id"])
    stream = state.recurrence_stream(feed(spark, tmp_path / "in", [rows[:50], rows[50:60], rows[60:]], SIGHTINGS), ["ts", "artifact_id"])
    assert sorted(map(str, drained(spark, stream, tmp_path).collect())) == sorted(map(str, whole.select(*stream.columns).collect()))


def test_forgotten_incidents_start_anew(spark, tmp_path):
    batches = [[(1, at(0), "a", "timeout", "m"), (2, at(1), "a", "timeout", "m"), (3, at(0), "b", "timeout", "m")], [(4, at(31), "c", "timeout", "m")],
               [(5, at(31), "a", "timeout", "m"), (6, at(40), "b", "timeout", "m")], [(7, at(62), "c", "timeout", "m")], [(8, at(63), "d", "timeout", "m"), (9, at(900), "e", "unknown", "")]]
    rows = state.recurrence_stream(feed(spark, tmp_path / "in", batches, SIGHTINGS), ["ts", "artifact_id"], ttl_days=30, delay="0 seconds")
    counts = {r.artifact_id: r.occurrence_count for r in drained(spark, rows, tmp_path).collect()}
    # a was last seen exactly 30 days before the newest sighting and is remembered, b one day more and is not.
    assert counts == {1: 1, 2: 2, 3: 1, 4: 1, 5: 3, 6: 1, 7: 2, 8: 1, 9: 1}
    left = {r.key: r["count"] for r in state.incident_store(spark, f"{tmp_path}/progress").collect()}
    assert left == {"b": 1, "c": 2, "d": 1}


def test_a_batch_touches_its_own_keys_only(spark, tmp_path):
    many = [(i, at(0), f"k{i}", "timeout", "m") for i in range(3000)]
    rows = state.recurrence_stream(feed(spark, tmp_path / "in", [many, [(9000, at(1), "k5", "timeout", "m")]], SIGHTINGS), ["ts", "artifact_id"])
    run = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    updated = [sum(op["numRowsUpdated"] for op in progress["stateOperators"]) for progress in run.recentProgress if progress["numInputRows"]]
    assert updated[0] >= 3000 and updated[-1] <= 2
    assert state.incident_store(spark, f"{tmp_path}/progress").count() == 3000


def test_closed_deliveries_stay_closed_across_batches(spark, tmp_path):
    from collections import Counter

    at = lambda seconds: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=seconds)
    schema = "incident_key string, destination string, at timestamp, action string"
    events = [("a", 0, "reserve"), ("a", 10, "confirm"), ("a", 20, "reserve"), ("b", 25, "reserve"), ("b", 30, "fail"), ("b", 40, "reserve"), ("b", 50, "confirm"),
              ("c", 60, "reserve"), ("d", 70, "confirm"), ("e", 80, "reserve"), ("e", 500, "reserve"), ("z", 2000, "reserve"), ("c", 2100, "reserve"), ("z", 9000, "reserve")]
    want = Counter([("a", "confirmed"), ("b", "failed"), ("b", "confirmed"), ("c", "unknown"), ("e", "unknown"), ("z", "unknown")])
    for name, size in (("one", 1), ("all", len(events))):
        batches = [[(k, "chat", at(s), action) for k, s, action in events[i:i + size]] for i in range(0, len(events), size)]
        stream = feed(spark, tmp_path / name, batches, schema)
        out = str(tmp_path / f"{name}-out")
        run = state.pending_timeouts(stream).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / f"{name}-progress")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert Counter((r.incident_key, r.state) for r in spark.read.parquet(out).collect()) == want, name


def test_many_deliveries_share_a_group(spark, tmp_path):
    schema = "incident_key string, destination string, at timestamp, action string"
    start = datetime.datetime(2024, 1, 1)
    after = lambda seconds: start + datetime.timedelta(seconds=seconds)
    opened = [(f"k{i}", None if i % 2 else "chat", after(i), "reserve") for i in range(2000)]
    closed = [(k, place, t + datetime.timedelta(seconds=20), "confirm") for k, place, t, _ in opened if int(k[1:]) % 3]
    # The newest event lies exactly 300 seconds behind one that stays open (1998), which is then unknown.
    batches = [opened[:1000], closed[:600] + opened[1000:], closed[600:] + [("none", "chat", None, "reserve")], [("last", "chat", after(1998 + 300), "reserve")]]
    rows = state.pending_timeouts(feed(spark, tmp_path / "in", batches, schema), groups=8)
    got = sorted((r.incident_key, r.state) for r in drained(spark, rows, tmp_path).collect())
    late = {k for k, _, t, _ in opened if int(k[1:]) % 3 == 0}
    assert {k for k, s in got if s == "unknown"} >= late
    assert {k for k, s in got if s == "confirmed"} <= {k for k, _, _, _ in closed}
    assert state.state_table(spark, f"{tmp_path}/progress", "deliveries").count() == 8


def test_a_hot_incident_waits_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "HELD_ROWS", 30)
    rows = [(i, None if i % 50 == 7 else at((i * 37) % 91), "hot" if i % 5 else f"k{i % 3}", None if i % 13 == 1 else "unknown" if i % 4 == 0 else "timeout", f"m{i}") for i in range(400)]
    confs = ("spark.sql.execution.arrow.maxRecordsPerBatch",)
    kept = {name: spark.conf.get(name) for name in confs}
    for name in confs:
        spark.conf.set(name, "16")
    try:
        stream = state.recurrence_stream(feed(spark, tmp_path / "in", [rows[:300], rows[300:]], SIGHTINGS), ["ts", "artifact_id"])
        got = {r.artifact_id: r for r in drained(spark, stream, tmp_path).collect()}
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    number = {}
    for part in (rows[:300], rows[300:]):
        for i, ts, key, kind, _ in sorted(part, key=lambda r: (r[1] is None, r[1] or at(0), r[0])):
            number[key] = number.get(key, 0) + (kind != "unknown")
            want = number[key] if kind != "unknown" else 1
            assert (got[i].occurrence_count, got[i].is_duplicate_of, got[i].recurring) == (want, key if kind != "unknown" and want > 1 else None, kind != "unknown" and want >= 3)
    assert len(got) == 400
    store = {r.key: (r["count"], r.message) for r in state.incident_store(spark, f"{tmp_path}/progress").collect()}
    lead = min((r for r in rows[:300] if r[2] == "hot" and r[3] != "unknown" and r[1]), key=lambda r: (r[1], r[0]))
    assert store["hot"] == (number["hot"], lead[4])
