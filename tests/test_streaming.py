"""Hand-made micro-batches through the streaming jobs."""

import json
from datetime import timedelta

import pytest
from helpers import at
from pyspark.sql import functions as F

from waitline.operators import ingest, lifecycle, policy, windows
from waitline.params import Params
from waitline.sources import tables, topic, versions
from waitline.sources.events import RECORD_SCHEMA, bronze_records, publish, publishable, read_record_stream, topic_options
from waitline.streaming import jobs
from waitline.streaming.hold import hold_policy_stream

P = Params()


def event(event_id, minute, kind="PATIENT_ARRIVAL", patient="P1", lab="LAB_A", **more):
    e = {"event_id": event_id, "event_type": kind, "patient_id": patient, "lab_id": lab,
         "event_time": at(minute).strftime("%Y-%m-%dT%H:%M:%SZ"), "schema_version": 1, **more}
    return json.dumps({k: v for k, v in e.items() if v is not None})


def write_batch(spark, root, number, texts, ingested=None):
    """One file of bronze rows; `ingested` minutes after 08:00."""
    rows = [("t", 0, number * 100 + i, at(ingested or 0), f"k{i}", text, at(ingested or 0)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, jobs.BRONZE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/bronze")


def drain(queries):
    out = []
    for q in queries if isinstance(queries, list) else [queries]:
        q.awaitTermination()
        out += q.recentProgress
    return out


def run_silver(spark, root):
    return drain(jobs.silver_job(jobs.table_stream(spark, f"{root}/bronze", jobs.BRONZE_SCHEMA), root, P, drain=True))


def silver_rows(spark, root):
    return jobs.silver_table(spark, root)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def test_quarantine_reasons(spark, root):
    texts = [event("e1", 0), None, "", "not json", '{"event_id":', event("e2", 1, patient=None), event("e3", 2, kind=None),
             event("e4", 3, lab=None), event("e5", 4).replace("2024-01-01T", "x"), "[]"]
    write_batch(spark, root, 0, texts)
    run_silver(spark, root)
    got = {r.offset: r.quarantine_reason for r in jobs.quarantine_table(spark, root).collect()}
    assert got == {1: "MALFORMED_JSON", 2: "MALFORMED_JSON", 3: "MISSING_EVENT_ID", 4: "MISSING_EVENT_ID", 5: "MISSING_PATIENT_ID",
                   6: "MISSING_EVENT_TYPE", 7: "MISSING_LAB_ID", 8: "MISSING_EVENT_TIME", 9: "MISSING_EVENT_ID"}
    assert [r.event_id for r in silver_rows(spark, root).collect()] == ["e1"]
    bronze = spark.read.schema(jobs.BRONZE_SCHEMA).parquet(f"{root}/bronze")
    strict = {r.offset: r.quarantine_reason for r in ingest.rejected(ingest.parse(bronze, strict_json=True)).collect()}
    assert strict[3] == strict[4] == "MALFORMED_JSON" and strict[8] == "MISSING_EVENT_TIME" and strict[5] == "MISSING_PATIENT_ID"


def test_duplicates_late_and_dropped_events(spark, root):
    write_batch(spark, root, 0, [event("a", 0), event("b", 20)], ingested=20)
    run_silver(spark, root)
    write_batch(spark, root, 1, [event("a", 0), event("b", 10), event("c", 18)], ingested=21)
    run_silver(spark, root)
    write_batch(spark, root, 2, [event("d", 0), event("e", 80)], ingested=80)
    run_silver(spark, root)
    write_batch(spark, root, 3, [event("f", 20), event("g", 79)], ingested=81)
    run_silver(spark, root)
    rows = {r.event_id: r for r in silver_rows(spark, root).collect()}
    assert set(rows) == {"a", "b", "c", "d", "e", "g"}, "f is more than 30 minutes behind"
    assert rows["b"].event_time == at(20), "the first record of an id is kept"
    assert rows["a"].event_lag_seconds == 1200 and rows["a"].is_late and not rows["c"].is_late


@pytest.mark.parametrize("bounded,kept", [(False, 1), (True, 2)])
def test_an_id_sent_again_after_the_watermark(spark, root, bounded, kept):
    p = Params(bounded_dedup=bounded)
    for n, minute in enumerate((0, 60, 95)):
        write_batch(spark, root, n, [event("a" if minute != 60 else "z", minute)], ingested=minute)
        drain(jobs.silver_job(jobs.table_stream(spark, f"{root}/bronze", jobs.BRONZE_SCHEMA), root, p, drain=True))
    rows = [r for r in silver_rows(spark, root).collect() if r.event_id == "a"]
    assert len(rows) == kept and min(r.event_time for r in rows) == at(0)


def test_copies_in_one_batch_and_a_batch_run_again(spark, root):
    """The record read first stays, and running a stored batch again changes nothing."""
    write_batch(spark, root, 0, [event("a", 3), event("a", 1), event("b", 2), "broken"])
    run_silver(spark, root)
    first = silver_rows(spark, root).collect()
    assert sorted((r.event_id, r.offset) for r in first) == [("a", 0), ("b", 2)]
    from waitline.sources import versions

    assert not versions.append(silver_rows(spark, root), f"{root}/silver", 0)
    assert silver_rows(spark, root).collect() == first
    write_batch(spark, root, 1, [event("a", 0), event("b", 2)])
    run_silver(spark, root)
    assert silver_rows(spark, root).collect() == first, "stored before"


def test_one_read_of_the_source_and_a_failing_sink(spark, root):
    write_batch(spark, root, 0, [event("a", 0), "broken"])
    stream = jobs.table_stream(spark, f"{root}/bronze", jobs.BRONZE_SCHEMA)
    (q,) = [jobs.silver_job(stream, root, P, drain=True)]
    q.awaitTermination()
    assert sum(s["numInputRows"] for s in q.recentProgress) == 2
    write_batch(spark, root, 1, [event("b", 1), "broken"])
    with open(f"{root}/blocked", "w"):
        pass
    import os
    os.rename(f"{root}/quarantine", f"{root}/aside")
    os.rename(f"{root}/blocked", f"{root}/quarantine")  # a file where the folder should be: this sink cannot write
    with pytest.raises(Exception):
        jobs.wait_for_any(spark, jobs.silver_job(stream, root, P), jobs.bronze_job(
            spark.readStream.schema(RECORD_SCHEMA).parquet(f"{root}/bronze"), f"{root}/other"))
    assert not [x for x in spark.streams.active]
    os.remove(f"{root}/quarantine")
    os.rename(f"{root}/aside", f"{root}/quarantine")
    drain(jobs.silver_job(stream, root, P, drain=True))
    assert {r.event_id for r in silver_rows(spark, root).collect()} == {"a", "b"}


def test_lateness_is_strict(spark):
    row = [("t", 0, i, at(0), "k", event(str(i), 0), at(0) + timedelta(seconds=s)) for i, s in enumerate((300, 301))]
    df = ingest.with_lag(ingest.accepted(ingest.parse(spark.createDataFrame(row, jobs.BRONZE_SCHEMA))))
    assert {r.event_lag_seconds: r.is_late for r in df.collect()} == {300: False, 301: True}


def test_windows_close_after_the_watermark(spark, root):
    write_batch(spark, root, 0, [event("a", 1), event("b", 2, kind="SERVICE_STARTED"), event("c", 7)], ingested=10)
    run_silver(spark, root)
    follow = lambda: drain(jobs.window_count_job(jobs.follow_silver(spark, root), root, P, drain=True))
    follow()
    assert spark.read.schema("lab_id string").parquet(f"{root}/window_counts").count() == 0
    write_batch(spark, root, 1, [event("d", 4), event("e", 37)], ingested=37)
    run_silver(spark, root)
    follow()
    got = spark.read.parquet(f"{root}/window_counts").collect()
    assert [(r.window_start, r.arrivals, r.services_started, r.late_event_count) for r in got] == [(at(0), 2, 1, 3)]
    batch = windows.event_counts(silver_rows(spark, root), P).filter(F.col("window_start") == F.lit(at(0)))
    assert [tuple(r) for r in batch.collect()] == [tuple(r) for r in got]


def test_lifecycle_upserts(spark, root):
    """Later batches win column by column, even with an earlier time; missing values change nothing."""
    def silver(number, *events):
        write_batch(spark, f"{root}/{number}", 0, list(events))
        return ingest.with_lag(ingest.accepted(ingest.parse(spark.read.parquet(f"{root}/{number}/bronze"))))

    store = jobs.upsert(f"{root}/state")
    first = silver(0, event("a", 10, patient_type="WALK_IN"), event("b", 12, kind="QUEUE_ENTERED"), event("z", 1, patient="P2"))
    second = silver(1, event("c", 5), event("d", 20, kind="SERVICE_STARTED", staff_id="S1"))
    store(first, 0)
    store(second, 1)
    store(second, 1)
    read = lambda: {r.patient_id: r for r in jobs.read_lifecycles(spark, f"{root}/state").collect()}
    before = read()
    r = before["P1"]
    assert (r.arrival_time, r.queue_entry_time, r.service_start_time) == (at(5), at(12), at(20))
    assert (r.patient_type, r.staff_id, r.departure_time) == ("WALK_IN", "S1", None) and before["P2"].arrival_time == at(1)
    store(silver(2, event("e", 30, kind="SERVICE_COMPLETED"), event("f", 31, kind="PATIENT_DEPARTED")), 2)
    done = lifecycle.finished(jobs.read_lifecycles(spark, f"{root}/state")).collect()
    assert [(x.patient_id, x.arrival_time, x.departure_time) for x in done] == [("P1", at(5), at(31))]
    store(first, 0)
    assert {x.patient_id: x.arrival_time for x in jobs.read_lifecycles(spark, f"{root}/state").collect()}["P1"] == at(5)


def test_lifecycle_stream_matches_batch(spark, root):
    for n, texts in enumerate([[event("a", 0), event("b", 2, kind="QUEUE_ENTERED")], [event("c", 9, kind="SERVICE_STARTED")],
                               [event("d", 12, kind="SERVICE_COMPLETED"), event("x", 3, patient="P9")]]):
        write_batch(spark, root, n, texts)
        run_silver(spark, root)
        drain(jobs.lifecycle_job(jobs.follow_silver(spark, root), f"{root}/state", f"{root}/checkpoints/state", drain=True))
    got = jobs.read_lifecycles(spark, f"{root}/state").orderBy("patient_id").collect()
    assert got == lifecycle.lifecycle_state(silver_rows(spark, root)).select(*got[0].__fields__).orderBy("patient_id").collect()


@pytest.mark.parametrize("seed", [None, 3])
def test_hold_policy_stream_matches_batch(spark, root, seed):
    """Also with rows that arrive out of order by less than the watermark; the last half hour still waits."""
    import random

    schema = "policy string, lab_id string, timestamp timestamp, instantaneous_recommendation int"
    plan = [1, 0, 2, 2, 1, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    steps = [("X", lab, at(5 * i + shift), asked) for lab, shift in (("A", 0), ("B", 5)) for i, asked in enumerate(plan)]
    steps.sort(key=lambda s: s[2])
    sent = list(steps)
    if seed:
        rng = random.Random(seed)
        sent.sort(key=lambda s: (s[2] - at(0)).total_seconds() / 60 + rng.uniform(0, 25))
    for n in range(0, len(sent), 6):
        spark.createDataFrame(sent[n:n + 6], schema).coalesce(1).write.mode("append").parquet(f"{root}/steps")
        stream = spark.readStream.schema(schema).parquet(f"{root}/steps")
        drain(jobs.append(hold_policy_stream(stream, P), f"{root}/actions", f"{root}/checkpoints/actions", drain=True))
    columns = ["lab_id", "timestamp", "policy_action", "staff_change", "active_additional_staff", "reason"]
    got = spark.read.parquet(f"{root}/actions").select(*columns).orderBy("lab_id", "timestamp").collect()
    want = policy.apply_hold_policy(spark.createDataFrame(steps, schema), p=P).select(*columns).orderBy("lab_id", "timestamp").collect()
    limit = max(s[2] for s in steps) - timedelta(minutes=30)
    assert got == [r for r in want if r.timestamp < limit] and len(got) > 20


def test_a_lab_that_has_ended_is_forgotten(spark, root):
    """Its state goes; without a limit it stays for ever."""
    schema = "policy string, lab_id string, timestamp timestamp, instantaneous_recommendation int"
    sent = [[("X", "A", at(0), 2), ("X", "B", at(0), 1)], [("X", "B", at(300), 0)], [("X", "A", at(301), 0), ("X", "B", at(302), 0)],
            [("X", "B", at(600), 0)]]
    for limit in (None, 120):
        for rows in sent:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/{limit}/steps")
            stream = spark.readStream.schema(schema).parquet(f"{root}/{limit}/steps")
            drain(jobs.append(hold_policy_stream(stream, P, limit), f"{root}/{limit}/actions", f"{root}/{limit}/checkpoint", drain=True))
        got = {(r.lab_id, r.timestamp): (r.staff_change, r.active_additional_staff)
               for r in spark.read.parquet(f"{root}/{limit}/actions").collect()}
        assert got["A", at(0)] == (2, 2) and got["B", at(300)] == ((-1, 0) if limit is None else (0, 0))
        assert got["A", at(301)] == ((-2, 0) if limit is None else (0, 0))


def test_publish_then_read_back(spark, root):
    events = spark.createDataFrame([("e1", "PATIENT_ARRIVAL", "P1", "LAB_A", at(0))],
                                   "event_id string, event_type string, patient_id string, lab_id string, event_time timestamp")
    row = publishable(events).first()
    assert row.key == "e1" and json.loads(row.value)["patient_id"] == "P1"
    publish(events, "parquet", f"{root}/topic")
    stored = spark.read.parquet(f"{root}/topic").select(
        F.col("key").cast("binary"), F.col("value").cast("binary"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
        F.lit(7).cast("long").alias("offset"), F.lit(at(1)).cast("timestamp").alias("timestamp"))
    stored.write.parquet(f"{root}/records")
    stream = read_record_stream(spark, "parquet", f"{root}/records")
    assert stream.schema == RECORD_SCHEMA
    drain(jobs.bronze_job(stream, root, drain=True))
    run_silver(spark, root)
    got = silver_rows(spark, root).first()
    assert (got.event_id, got.offset, got.event_time) == ("e1", 7, at(0))
    assert set(bronze_records(stored).columns) == {f.name for f in jobs.BRONZE_SCHEMA}
    assert topic_options("h:1", "t")["startingOffsets"] == "earliest"


def test_full_refresh_replaces_schema(spark, root):
    with pytest.raises(FileNotFoundError):
        tables.current(spark, f"{root}/t")
    tables.refresh(spark.range(3), f"{root}/t")
    tables.refresh(spark.range(5).withColumn("b", F.lit(1)), f"{root}/t")
    now = tables.current(spark, f"{root}/t")
    assert now.columns == ["id", "b"] and now.count() == 5
    assert [r.id for r in tables.head(now, 2, "id").collect()] == [0, 1]


def test_refresh_survives_a_lost_marker_and_a_half_written_version(spark, root):
    import os

    t = f"{root}/t"
    tables.refresh(spark.range(3), t)
    old = tables.current(spark, t)
    tables.refresh(spark.range(4), t)
    os.remove(f"{t}/{tables.MARKER}")
    folder = tables.refresh(spark.range(5), t)
    assert folder.endswith("v000003") and tables.current(spark, t).count() == 5
    os.makedirs(f"{t}/v000004/_temporary")  # a version whose writer died
    assert tables.current(spark, t).count() == 5
    assert tables.refresh(spark.range(6), t).endswith("v000005") and tables.current(spark, t).count() == 6
    assert old.count() == 3, "a reader of an older version keeps its files"


# Committed versions --------------------------------------------------------------------------

def test_a_follower_sees_committed_batches_only(spark, root, monkeypatch):
    """A batch that fails between its two sinks and runs again, while a second stream follows silver."""
    follow = lambda: drain(jobs.append(jobs.follow_silver(spark, root), f"{root}/copy", f"{root}/checkpoints/copy", drain=True))
    write_batch(spark, root, 0, [event("a", 0), "broken"])
    run_silver(spark, root)
    follow()
    write_batch(spark, root, 1, [event("b", 1), event("c", 2), "broken"])
    real = versions.append

    def fails(df, folder, version):
        if folder.endswith("/silver"):  # what was written before the failure stays behind
            df.write.parquet(f"{folder}/{versions.attempt(version)}")
            raise OSError("no room")
        return real(df, folder, version)

    monkeypatch.setattr(versions, "append", fails)
    with pytest.raises(Exception):
        run_silver(spark, root)
    monkeypatch.undo()
    follow()
    copied = lambda: sorted(r.event_id for r in spark.read.schema(jobs.SILVER_SCHEMA).parquet(f"{root}/copy").collect())
    assert copied() == ["a"] and {r.event_id for r in silver_rows(spark, root).collect()} == {"a"}
    run_silver(spark, root)
    follow()
    assert copied() == ["a", "b", "c"] and jobs.quarantine_table(spark, root).count() == 2
    assert sorted(map(str, silver_rows(spark, root).collect())) == sorted(map(str, spark.read.schema(jobs.SILVER_SCHEMA).parquet(f"{root}/copy").collect()))


def test_a_version_is_committed_once(spark, root):
    assert versions.append(spark.range(3), root, 0) and not versions.append(spark.range(5), root, 0)
    assert versions.append(spark.range(0), root, 1) and versions.latest(spark, root) == 1
    assert not versions.commit(spark, root, 1, {"folder": "data/other"})
    assert versions.read(spark, root, "id long").count() == 3
    assert versions.read(spark, f"{root}/none", "id long").count() == 0


def test_a_version_has_files_by_rows_not_by_state_partitions(spark, root):
    """A follower has a task for each file; a batch without records is none."""
    import glob

    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        write_batch(spark, root, 0, [event(f"e{i}", i % 50) for i in range(400)] + ["broken"], ingested=60)
        run_silver(spark, root)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert versions.versions(spark, f"{root}/silver") == [0] and silver_rows(spark, root).count() == 400
    assert len(glob.glob(f"{root}/silver/data/*/*.parquet")) <= spark.sparkContext.defaultParallelism
    assert jobs.quarantine_table(spark, root).first().event_json == "broken"


def test_batches_cost_what_they_hold(spark, root):
    """Ids are kept as state: stored silver is not read, even if it is out of reach."""
    import os

    for n in range(6):
        write_batch(spark, root, n, [event(f"e{n}", n), event("same", n), event(f"e{max(0, n - 1)}", n)])
    stream = jobs.table_stream(spark, f"{root}/bronze", jobs.BRONZE_SCHEMA, files_per_batch=1)
    batches = [b for b in drain(jobs.silver_job(stream, root, P, drain=True)) if b["numInputRows"]]
    assert [b["numInputRows"] for b in batches] == [3] * 6
    assert [b["stateOperators"][0]["numRowsUpdated"] for b in batches] == [2, 1, 1, 1, 1, 1], "only new ids change the state"
    os.rename(f"{root}/silver/data", f"{root}/silver/away")
    write_batch(spark, root, 6, [event("same", 6), event("e3", 6), event("new", 6)])
    run_silver(spark, root)
    os.rename(f"{root}/silver/data", f"{root}/silver/last")
    os.rename(f"{root}/silver/away", f"{root}/silver/data")
    for name in os.listdir(f"{root}/silver/last"):
        os.rename(f"{root}/silver/last/{name}", f"{root}/silver/data/{name}")
    assert sorted(r.event_id for r in silver_rows(spark, root).collect()) == ["e0", "e1", "e2", "e3", "e4", "e5", "new", "same"]


def test_an_id_is_looked_up_once(spark, root):
    """Writing a new id asks the state nothing more: it was asked when the id was read."""
    write_batch(spark, root, 0, [event(f"e{i}", i % 50) for i in range(300)])
    state = [b["stateOperators"][0] for b in run_silver(spark, root) if b["numInputRows"]]
    assert [s["numRowsUpdated"] for s in state] == [300] and silver_rows(spark, root).count() == 300
    assert sum(s["customMetrics"]["rocksdbGetCount"] for s in state) == 300


def test_the_record_read_first_stays_whatever_file_brought_it(spark, root):
    rows = [("t", i % 3, i, at(20 - i % 7), "k", event(f"e{i % 10}", i % 5), at(30)) for i in range(200)]
    spark.createDataFrame(rows, jobs.BRONZE_SCHEMA).repartition(8).write.parquet(f"{root}/bronze")
    run_silver(spark, root)
    want = {}
    for r in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        want.setdefault(json.loads(r[5])["event_id"], r[2])
    assert {r.event_id: r.offset for r in silver_rows(spark, root).collect()} == want


def test_counts_of_each_micro_batch(spark, root):
    """By a listener: read, rejected, late, repeated, dropped and stored add up."""
    import time

    counts = jobs.BatchCounts(spark, f"{root}/counts")
    spark.streams.addListener(counts)
    try:
        write_batch(spark, root, 0, [event("a", 0), event("b", 20), event("b", 21), "broken", None], ingested=20)
        progress = run_silver(spark, root)
        write_batch(spark, root, 1, [event("a", 0), event("c", 80)], ingested=80)
        progress += run_silver(spark, root)
        write_batch(spark, root, 2, [event("f", 20), event("g", 79), ""], ingested=81)
        progress += run_silver(spark, root)
        for _ in range(100):
            if jobs.counts_table(spark, f"{root}/counts").count() == 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counts)
    for p in progress:
        counts.record(p)  # again: counted once
    got = [tuple(r)[1:] for r in jobs.counts_table(spark, f"{root}/counts").orderBy("batch_id").collect()]
    #       records, accepted, rejected, late, repeated, dropped, stored
    assert got == [(5, 3, 2, 1, 1, 0, 2), (2, 2, 0, 1, 1, 0, 1), (3, 2, 1, 1, 0, 1, 1)]


def test_lifecycle_buckets(spark, root):
    """A batch writes the buckets it touches; a read takes one folder per bucket, whatever came before; old files go."""
    def silver(number, *events):
        write_batch(spark, f"{root}/{number}", 0, list(events))
        return ingest.with_lag(ingest.accepted(ingest.parse(spark.read.parquet(f"{root}/{number}/bronze"))))

    store = jobs.upsert(f"{root}/state", buckets=8)
    store(silver(0, *[event(f"a{i}", i, patient=f"P{i}") for i in range(60)]), 0)
    first = versions.note(spark, f"{root}/state", 0)["folders"]
    assert len(first) == 8
    for n in range(1, 12):
        store(silver(n, event(f"b{n}", 100 + n, kind="QUEUE_ENTERED", patient="P7")), n)
    last = versions.note(spark, f"{root}/state", 11)["folders"]
    assert sum(first[b] != last[b] for b in first) == 1 and len(last) == 8
    assert versions.versions(spark, f"{root}/state") == [10, 11]
    got = {r.patient_id: r for r in jobs.read_lifecycles(spark, f"{root}/state").collect()}
    assert len(got) == 60 and got["P7"].queue_entry_time == at(111) and got["P7"].arrival_time == at(7)
    import glob

    assert len(glob.glob(f"{root}/state/data/*/bucket=*")) == 9, "eight in use and the one before the last batch"


# Topic of segments ---------------------------------------------------------------------------

def topic_rows(low, high):
    return [(f"k{i}".encode(), event(f"e{i}", i % 60).encode(), "t", i % 2, i, at(i % 60)) for i in range(low, high)]


def read_topic(spark, root, name, **options):
    stream = topic.read_segments(spark, f"{root}/topic", **options)
    drain(jobs.bronze_job(stream, f"{root}/{name}", drain=True))
    return sorted(r.offset for r in spark.read.schema(jobs.BRONZE_SCHEMA).parquet(f"{root}/{name}/bronze").collect())


def test_topic_positions(spark, root):
    assert topic.publish_segments(spark.createDataFrame(topic_rows(0, 50), RECORD_SCHEMA), f"{root}/topic", 0, 10)
    assert not topic.publish_segments(spark.createDataFrame(topic_rows(0, 50), RECORD_SCHEMA), f"{root}/topic", 0, 10)
    assert read_topic(spark, root, "a") == [*range(50)]
    assert read_topic(spark, root, "b", starting='{"0": 20, "1": 41}') == sorted([*range(20, 50, 2), *range(41, 50, 2)])
    assert read_topic(spark, root, "c", starting="latest") == []
    topic.publish_segments(spark.createDataFrame(topic_rows(50, 65), RECORD_SCHEMA), f"{root}/topic", 1, 10)
    assert read_topic(spark, root, "a") == [*range(65)], "only what is new is read again"
    assert read_topic(spark, root, "c", starting="latest") == [*range(50, 65)]
    run_silver(spark, f"{root}/a")
    assert silver_rows(spark, f"{root}/a").count() == 65


def test_lost_segments(spark, root):
    import shutil

    topic.publish_segments(spark.createDataFrame(topic_rows(0, 40), RECORD_SCHEMA), f"{root}/topic", 0, 10)
    gone = next(s for s in versions.note(spark, f"{root}/topic", 0)["segments"] if s["partition"] == 1 and s["first"] == 11)
    shutil.rmtree(f"{root}/topic/{gone['folder']}")
    with pytest.raises(Exception, match="partition 1 are gone"):
        read_topic(spark, root, "strict", fail_on_data_loss=True)
    assert read_topic(spark, root, "lenient") == [i for i in range(40) if not (i % 2 and 10 <= i < 20)]


# What stays on disk ---------------------------------------------------------------------------

def shuffle_files(spark):
    names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {n for n in names if "/shuffle_" in n}


def test_shuffles_go_with_their_micro_batch(spark, root):
    """Of the silver job and its followers; those of earlier batches do not pile up until the driver collects garbage."""
    import time

    before = shuffle_files(spark)
    for n in range(3):
        write_batch(spark, root, n, [event(f"e{n}-{i}", n, patient=f"P{i}") for i in range(50)])
    drain(jobs.silver_job(jobs.table_stream(spark, f"{root}/bronze", jobs.BRONZE_SCHEMA, files_per_batch=1), root, P, drain=True))
    drain(jobs.window_count_job(jobs.follow_silver(spark, root), root, P, drain=True))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and silver_rows(spark, root).count() == 150
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false", "for the streams alone"


def test_a_consumed_table_shrinks_as_it_is_read(spark, root):
    import glob

    for n in range(4):
        write_batch(spark, root, n, [event(f"e{n}", n)])
    files = lambda: len(glob.glob(f"{root}/bronze/*.parquet"))
    assert files() == 4
    drain(jobs.silver_job(jobs.table_stream(spark, f"{root}/bronze", jobs.BRONZE_SCHEMA, 1, consume=True), root, P, drain=True))
    assert files() <= 1 and sorted(r.event_id for r in silver_rows(spark, root).collect()) == ["e0", "e1", "e2", "e3"]


@pytest.mark.parametrize("build,kept", [("silver_events", {"silver"}), ("batch_counts", {"batch_counts"}),
                                        ("window_counts", {"window_counts"}), ("lifecycles", {"lifecycles"})])
def test_a_drained_stream_leaves_what_its_result_reads(spark, root, monkeypatch, build, kept):
    """The rest goes at once, what is left when the application ends; the records are stored once."""
    import os

    from waitline.plans import streams

    staged = []
    monkeypatch.setattr(streams, "workspace", lambda _: f"{root}/work")
    monkeypatch.setattr(streams, "stage", lambda df: staged.append(df) or tables.stage(df))
    got = getattr(streams, build)(spark, "/root/testdata/sf0.001", P)
    assert got.count() > 0 and not staged
    assert {"silver", "batch_counts", "window_counts", "lifecycles", "bronze"} & set(os.listdir(f"{root}/work")) <= kept | {"batch_counts"}
    _, target, fs = tables._filesystem(spark, f"{root}/work")
    assert fs.cancelDeleteOnExit(target), "noted for deletion"
