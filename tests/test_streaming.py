"""Streams give what their batch twins give, over files read with availableNow."""

import random
import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetlens.streaming import jobs as J


def streamed(spark, df, tmp_path, job, order, parts=3, mode="append"):
    """Rows of ``job`` over ``df`` written as ``parts`` files, one to a batch."""
    source = str(tmp_path / "in")
    marked = df.withColumn("_n", F.ntile(parts).over(W.orderBy(order)))
    split = [marked.filter(F.col("_n") == k + 1).drop("_n") for k in range(parts)]
    for part in split:
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = []
    q = job(stream).writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def events(spark, sf_dir, n=400):
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_id") < n).withColumn("ts", F.col("ts").cast("timestamp"))


def arriving(rows, minutes, files=5):
    """Rows (minute first) as files in the order of arrival, each up to ``minutes`` late; a last file moves the watermark past them all."""
    r = random.Random(5)
    arrival = sorted(rows, key=lambda x: (x[0] + r.uniform(0, minutes), r.random()))
    size = -(-len(arrival) // files)
    return [arrival[k : k + size] for k in range(0, len(arrival), size)]


def stream_of(spark, tmp_path, files, names):
    path = str(tmp_path / "in")
    at = F.expr("timestamp'2024-01-31 10:00:00' + make_dt_interval(0, 0, minute)")
    for rows in files:
        spark.createDataFrame(rows, names).withColumn("at", at).drop("minute").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)  # files are read by their times
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def collected(job, stream, tmp_path):
    out = []
    job(stream).writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_drift_monitor_of_shuffled_batches(spark, tmp_path):
    r = random.Random(1)
    rows = [(m, r.randrange(3), r.choice(["MATCH", "MATCH", "MISMATCH", "continue"]), r.choice([1, 2, None]), r.choice("hhmMyd" if m < 60 else "e"), r.random() < 0.4) for m in range(80)]
    names = "minute int, device_id long, status string, every int, unit string, manual boolean"
    stream, table = stream_of(spark, tmp_path, [*arriving(rows, 8), [(10_000, 99, "MATCH", 1, "h", False)], [(1, 1, "late", 1, "h", False)], [(20_000, 98, "MATCH", 1, "h", False)]], names)
    got = [x for x in collected(J.drift_monitor, stream, tmp_path) if x["device_id"] < 90]
    want = J.drift_monitor(table.filter("status <> 'late' AND device_id < 90")).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, want))
    assert {x["action"] for x in got} == {"none", "paused", "kept_paused", "resumed", "skipped", "disabled", "one_shot_done"}
    assert any(x["action"] == "resumed" and x["next_at"] is not None for x in got)


def test_signatures_of_shuffled_batches(spark, tmp_path):
    r = random.Random(2)
    rows = [(m, m, m % 4, r.choice(J.ROLES)) for m in range(60)]
    stream, table = stream_of(spark, tmp_path, [*arriving(rows, 8), [(10_000, 900, 99, "admin")], [(20_000, 901, 99, "admin")]], "minute int, id long, sheet_id long, role string")
    got = [x for x in collected(J.signature_flow, stream, tmp_path) if x["sheet_id"] < 90]
    want = J.signature_flow(table.filter("sheet_id < 90")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(x["accepted"] for x in got) == 12


def test_drift_rules():
    import pandas as pd

    at = [pd.Timestamp(2024, 1, d) for d in range(1, 10)]
    given = [("MISMATCH", 5, "h", False), ("MATCH", 9, "d", False), ("MISMATCH", 7, "m", True), ("MATCH", 1, "m", True), ("MATCH", 1, "M", False), ("MATCH", 2, "d", True), ("MISMATCH", 2, "e", False), ("MATCH", 3, "h", True), ("MATCH", 2, "h", False)]
    rows = pd.DataFrame([(t, *g) for t, g in zip(at, given)], columns=["at", "status", "every", "unit", "manual"])
    state, out = J._drift_steps(None, rows)
    assert [r[-2] for r in out] == ["paused", "skipped", "kept_paused", "resumed", "none", "none", "paused", "resumed", "disabled"]
    assert out[3][3:5] == (5, "h") and state == (False, None, None, False, None)
    # A resume counts from itself, a manual check sets nothing, a one-shot check ends the schedule although it pauses.
    assert [r[-1] for r in out] == [None, None, None, at[3] + pd.Timedelta(hours=5), pd.Timestamp(2024, 2, 5), pd.Timestamp(2024, 2, 5), None, None, None]
    assert J._next_time(pd.Timestamp(2024, 1, 31), 1, "M") == pd.Timestamp(2024, 2, 29) and J._next_time(pd.Timestamp(2024, 2, 29), 1, "y") == pd.Timestamp(2025, 2, 28)


def test_signature_rules(spark):
    roles = ["supervisor", "technician", "admin", "supervisor", "technician", "admin", "admin"]
    df = spark.createDataFrame([(k, 1, r, k) for k, r in enumerate(roles)], "id long, sheet_id long, role string, k int").select("id", "sheet_id", "role", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, k)").alias("at"))
    assert [r["accepted"] for r in J.signature_flow(df).orderBy("id").collect()] == [False, True, False, True, False, True, False]


def test_progress(spark, sf_dir, tmp_path):
    df = events(spark, sf_dir).selectExpr("user_id AS job_id", "event_id AS id", "value - 5 AS completed", "80D AS total")
    got = streamed(spark, df, tmp_path, J.monotonic_progress, "id")
    assert sorted(map(tuple, got)) == sorted(map(tuple, J.monotonic_progress(df).collect()))


def test_tickets(spark, sf_dir, tmp_path):
    df = events(spark, sf_dir).selectExpr("user_id % 3 AS ticket_id", "event_id AS id")
    last = {r["ticket_id"]: tuple(r) for r in streamed(spark, df, tmp_path, J.ticket_flow, "id", mode="update")}
    assert sorted(last.values()) == sorted(map(tuple, J.ticket_flow(df).collect()))


def test_ingest_once(spark, tmp_path):
    """Requests a day apart are taken again, in whatever order they come; a stream forgets what it no longer needs."""
    r = random.Random(6)
    rows = [(60 * h + r.randrange(60), f"k{r.randrange(4)}", h) for h in range(0, 130, 2)]
    stream, table = stream_of(spark, tmp_path, [*arriving(rows, 8), [(10_000, "last", 0)], [(20_000, "last", 1)], [(30_000, "end", 1)]], "minute int, idempotency_key string, n int")
    got = [x for x in collected(J.ingest_once, stream, tmp_path) if x["idempotency_key"].startswith("k")]
    want = J.ingest_once(table.filter("idempotency_key like 'k%'")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and 12 <= len(got) < 30
    state = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "cp"))
    assert state.count() == 0  # a day after its last request each key is forgotten


def test_ingest_again_after_a_day(spark):
    hours = (0, 5, 23, 24, 30, 47, 48, 100)
    df = spark.createDataFrame([("k", h) for h in hours] + [("m", 3)], "idempotency_key string, h int").select("idempotency_key", F.expr("timestamp'2024-01-01' + make_dt_interval(0, h)").alias("at")).repartition(3)
    got = sorted((r["idempotency_key"], r["at"].day, r["at"].hour) for r in J.ingest_once(df).collect())
    assert got == [("k", 1, 0), ("k", 2, 0), ("k", 3, 0), ("k", 5, 4), ("m", 1, 3)]


def test_stage_pairs(spark, tmp_path):
    at = lambda c: F.expr(f"timestamp'2024-01-01' + make_dt_interval(0, 0, 0, {c})")
    headers = spark.createDataFrame([(1, 0, "SUCCESS"), (2, 0, "FAILED"), (3, 5000, "SUCCESS"), (9, 90000, "SUCCESS")], "job_id long, s int, header_status string").select("job_id", at("s").alias("header_at"), "header_status")
    details = spark.createDataFrame([(1, 30), (2, 60), (3, 10), (8, 90000)], "job_id long, s int").select("job_id", at("s").alias("detail_at"))
    assert {r["job_id"]: r["outcome"] for r in J.pair_stages(headers, details).collect()} == {1: "READY", 2: "SKIPPED", 3: "FAILED", 8: "FAILED"}
    headers.write.parquet(str(tmp_path / "h"))
    h = spark.readStream.schema(headers.schema).parquet(str(tmp_path / "h"))
    got = {r["job_id"]: r["outcome"] for r in streamed(spark, details, tmp_path, lambda d: J.pair_stages(h, d), "detail_at")}
    assert got[1] == "READY" and got[2] == "SKIPPED" and got.get(3, "FAILED") == "FAILED"


def test_live_counts(spark, sf_dir, tmp_path):
    df = events(spark, sf_dir).selectExpr("event_id % 60 AS job_id", "event_id AS id", "event_type AS status", "user_id % 5 AS creator", "ts AS at")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}
    J.live_status_counts(stream, str(tmp_path / "changes"), lambda d, n: seen.update({n: d.collect()}), str(tmp_path / "cp")).awaitTermination()
    want = sorted(map(str, J.status_totals(J.latest_status(df)).collect()))
    assert len(seen) == 3 and sorted(map(str, J.status_totals_of(spark, str(tmp_path / "changes")).collect())) == want
    assert any(r["n"] < 0 for r in seen[2])
    # One more job, and rows older than what is known, change that job's totals alone.
    old = df.withColumn("at", F.col("at") - F.expr("INTERVAL 9 YEARS"))
    old.unionByName(df.limit(1).withColumn("job_id", F.lit(999).cast("long"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    J.live_status_counts(stream, str(tmp_path / "changes"), lambda d, n: seen.update({n: d.collect()}), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["n"] for r in seen[3]) == [1, 1]


def synced(spark, tmp_path, rows, schema, buckets=4):
    table = J.SyncedTable(spark, str(tmp_path / "t"), buckets)
    table.create(spark.createDataFrame(rows, schema))
    return table


def test_sync_stream(spark, tmp_path):
    table = synced(spark, tmp_path, [("a", "old", 1)], "code string, name string, extra int")
    batch = spark.createDataFrame([(1, "a", "new"), (2, "b", "more")], "place int, c string, title string")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    told = []
    J.sync_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), table, ["c"], {"name": "title"}, "place", str(tmp_path / "cp"), lambda *x: told.append(x)).awaitTermination()
    assert told == [(0, 2, 2, "SUCCESS: 2 rows read, 2 rows known")]
    assert sorted(tuple(r) for r in table.read().select("code", "name", "extra").collect()) == [("a", "new", 1), ("b", "more", None)]


def test_sync_writes_touched_buckets_and_expires_old_ones(spark, tmp_path):
    table = synced(spark, tmp_path, [(f"c{k}", "old") for k in range(40)], "code string, name string", buckets=8)
    first = table.manifest(0)
    schema = "place int, c string, title string"
    for k in range(4):
        spark.createDataFrame([(1, "c3", f"new {k}"), (2, "c3", f"newer {k}"), (3, "", "nobody")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
        J.sync_stream(stream, table, ["c"], {"name": "title"}, "place", str(tmp_path / "cp"), lambda *_: None).awaitTermination()
    assert table.versions() == [3, 4]
    now = table.manifest(4)
    assert sum(now[b] != first[b] for b in first) == 1 and sum(n for _, n in now.values()) == 40
    names = {r["code"]: r["name"] for r in table.read().collect()}
    assert names.pop("c3") == "newer 3" and set(names.values()) == {"old"} and len(names) == 39
    kept = {p.parent.relative_to(tmp_path / "t").as_posix() for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    assert kept == {folder for v in (3, 4) for folder, _ in table.manifest(v).values()}


@pytest.mark.parametrize("where", ["data", "manifest"])
def test_sync_killed_and_started_anew(spark, tmp_path, monkeypatch, where):
    table = synced(spark, tmp_path, [(f"c{k}", "old") for k in range(10)], "code string, name string")
    spark.createDataFrame([(1, "c3", "new"), (2, "c11", "more")], "place int, c string, title string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("place int, c string, title string").parquet(str(tmp_path / "in"))
    start = lambda: J.sync_stream(stream, table, ["c"], {"name": "title"}, "place", str(tmp_path / "cp"), lambda *_: None).awaitTermination()
    with monkeypatch.context() as m:  # the driver goes after the files are written, or before any is
        frame = type(spark.range(0))
        m.setattr(frame, "coalesce" if where == "manifest" else "repartition", lambda *_: 1 / 0)
        with pytest.raises(Exception):
            start()
    assert {r["name"] for r in table.read().collect()} == {"old"} and table.versions() == [0]
    start()
    assert sorted(r["name"] for r in table.read().collect()) == ["more", "new"] + ["old"] * 9 and table.versions() == [0, 1]


def test_sync_stream_links_and_reports_failures(spark, tmp_path):
    table = synced(spark, tmp_path, [("a", "old", None, 7), ("z", "far", None, None)], "code string, site string, site_id long, extra int")
    parents = spark.createDataFrame([(1, "S1"), (2, "S1"), (3, " ")], "id long, code string")
    batch = spark.createDataFrame([(1, "a", "S1"), (2, "b", " ")], "place int, c string, s string")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    told = []

    def run(target):
        stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
        J.sync_stream(stream, target, ["c"], {"site": "s"}, "place", f"{target.path}-cp", lambda *x: told.append(x), parents, ("site_id", "site", "code")).awaitTermination()

    run(table)
    assert sorted((r["code"], r["site_id"]) for r in table.read().collect()) == [("a", 1), ("b", None), ("z", None)]
    with pytest.raises(Exception):
        run(J.SyncedTable(spark, str(tmp_path / "absent")))
    assert told[0][3].startswith("SUCCESS: 2 rows") and told[1][3].startswith("FAILED: ") and len(told[1][3]) <= 58


def test_activity(spark, sf_dir, tmp_path):
    df = events(spark, sf_dir)
    last = {r["start"]: r["n"] for r in streamed(spark, df.select("ts"), tmp_path, J.activity_stream, "ts", mode="update")}
    assert last == {r["start"]: r["n"] for r in J.activity_stream(df).collect()}


def due_cases(spark):
    schedule = spark.createDataFrame([(1, True, False, 5), (2, True, True, 5), (3, True, False, 50), (4, True, None, 61), (5, False, False, 1), (6, True, False, None)], "id long, enabled boolean, paused boolean, m int").withColumn("next_at", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, m)"))
    return schedule, lambda *minutes: spark.createDataFrame([(m,) for m in minutes], "m int").select(F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, m)").alias("at"))


def test_due_tick(spark):
    schedule, ticks = due_cases(spark)
    told = lambda df: sorted((r["tick"].hour * 60 + r["tick"].minute, r["id"]) for r in df.collect())
    assert told(J.due_tick(ticks(1, 10, 59), schedule)) == [(10, 1), (59, 1), (59, 3)]
    assert told(J.due_tick(ticks(0, 30, 60, 90, 120), schedule, "30 minutes")) == [(30, 1), (60, 3), (90, 4)]
    assert told(J.due_tick(ticks(1), schedule.filter("false"))) == []
    plan = J.due_tick(ticks(1, 10), schedule)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and J.minute_ticks(spark).isStreaming


def test_ticks_of_a_stream_tell_each_device_once(spark, tmp_path):
    schedule, ticks = due_cases(spark)
    got = streamed(spark, ticks(*range(70)), tmp_path, lambda t: J.due_tick(t, schedule), "at")
    assert sorted((r["tick"].hour * 60 + r["tick"].minute, r["id"]) for r in got) == [(5, 1), (50, 3), (61, 4)]
