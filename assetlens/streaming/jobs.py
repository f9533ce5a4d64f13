"""Structured Streaming jobs and their batch twins (section J).

Each job takes an event table, read with ``readStream`` or ``read``.  Late rows: a watermark of
``DELAY`` unless stated, beyond which Spark drops them and counts them in the query's progress.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.scalars import next_occurrence

DELAY = "10 minutes"

# --- Rows of a key in the order of their times

Forget = Callable[[tuple], datetime.datetime]
Step = Callable[[tuple | None, object, pd.DataFrame], tuple[tuple, pd.DataFrame]]
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class HeldUntilWatermark(StatefulProcessor):
    """Keeps the rows of a key until the watermark has passed their time, then gives them to ``step`` in order.

    A timer stands at the earliest time that is held.  Rows at the watermark or before are late and dropped by Spark, so what a timer
    finds up to the watermark is complete, however the rows were dealt to micro-batches.
    """

    def __init__(self, step: Step, columns: list[str], order: list[str], held: T.StructType, state: str, forget: Forget | None = None):
        self.step, self.columns, self.order, self.held_schema, self.state_schema, self.forget = step, columns, order, held, state, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.held = handle.getListState("held", self.held_schema)

    def _wake(self, earliest: pd.Timestamp) -> None:
        self.handle.registerTimer(-int(-_micros(earliest) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            # Whole numbers beside a null come as doubles.
            kinds = [int if isinstance(f.dataType, T.IntegralType) else None for f in self.held_schema]
            columns = [[None if pd.isna(v) else kind(v) if kind else v for v in pdf[c]] for c, kind in zip(self.columns, kinds)]
            self.held.appendList(list(zip(*columns)))
            self._wake(pdf[self.order[0]].min())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rows = pd.DataFrame(list(self.held.get()), columns=self.columns, dtype=object)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        past = rows[self.order[0]].map(_micros) <= watermark
        ready, later = rows[past], rows[~past]
        if self.forget and not len(rows) and self.state.exists() and _micros(self.forget(self.state.get())) <= watermark:
            self.state.clear()
        if len(ready):
            state, out = self.step(self.state.get() if self.state.exists() else None, key[0], ready.sort_values(self.order, kind="stable"))
            self.state.update(state)
            if self.forget:
                self._wake(self.forget(state))
            if len(later):
                self.held.put(list(later.itertuples(index=False, name=None)))
                self._wake(later[self.order[0]].min())
            else:
                self.held.clear()
            yield out

    def close(self) -> None:
        pass


def _micros(at) -> int:
    """Microseconds since 1970, of an instant or of a time in UTC."""
    at = pd.Timestamp(at)
    return (at.tz_localize("UTC") if at.tzinfo is None else at).value // 1000


def in_order(rows: DataFrame, key: str, order: list[str], step: Step, out: str | T.StructType, state: str, forget: Forget | None = None) -> DataFrame:
    """``step`` over the rows of each key in ``order``, whose first column is their time; state is what it returns beside its rows.
    ``forget`` tells from a state when it has no effect any more; a stream then drops it.

    A table is sorted within tasks and streams through them, so that no key is held in memory.  A stream is held back by the watermark
    (``DELAY``); it needs the RocksDB state store, which is set here, and a session in UTC.  Rows without key or time take no part.
    """
    at, columns = order[0], [c for c in rows.columns if c != key]
    rows = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    if rows.isStreaming:
        if rows.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
            raise ValueError("times that are held back need a session in UTC")
        rows.sparkSession.conf.set(*_PROVIDER)
        held = T.StructType([rows.schema[c] for c in columns])
        return rows.withWatermark(at, DELAY).groupBy(key).transformWithStateInPandas(HeldUntilWatermark(step, columns, order, held, state, forget), out, "append", "eventTime")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = None, None
        for pdf in frames:
            for own, part in pdf.groupby(key, sort=False):
                known, done = step(known if own == last else None, own, part)
                last = own
                yield done

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, out)


# --- J1: drift monitor

_DRIFT = "device_id long, at timestamp, status string, paused boolean, every int, unit string, action string, next_at timestamp"
_DRIFT_STATE = "paused boolean, every int, unit string, enabled boolean, next_at timestamp"
_OFFSETS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "M": "months", "y": "years"}


@cache
def _offset(every: int, unit: str) -> pd.DateOffset | pd.Timedelta:
    return pd.DateOffset(**{_OFFSETS[unit]: every}) if unit in ("M", "y") else pd.Timedelta(**{_OFFSETS.get(unit, "hours"): every if unit in _OFFSETS else 1})


def _next_time(at: pd.Timestamp, every: int | None, unit: str | None) -> pd.Timestamp | None:
    """``next_occurrence`` of one row."""
    return None if unit == "e" or every is None else pd.Timestamp(at) + _offset(int(every), unit)


def _drift_steps(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """State (paused, saved every, saved unit, enabled, next time) after the device's checks in order, and a row for each.

    MISMATCH pauses and saves the schedule (the first one while paused stays) and leaves the next time alone; MATCH or ``continue``
    while paused restores it and counts the next time from there.  A check by schedule is skipped while paused or disabled; else it sets
    the next time, or, with a one-shot schedule (unit e), disables the device.  A manual recheck sets no next time.
    """
    paused, every, unit, enabled, next_at = state or (False, None, None, True, None)
    out = []
    for at, status, e, u, manual in rows[["at", "status", "every", "unit", "manual"]].itertuples(index=False):
        e, scheduled, action = None if pd.isna(e) else int(e), not manual and status != "continue", "none"
        if scheduled and (paused or not enabled):
            action = "skipped" if enabled else "disabled"
        else:
            if status == "MISMATCH":
                action = "kept_paused" if paused else "paused"
                if not paused:
                    paused, every, unit = True, e, u
            elif paused:
                action, e, u = "resumed", every, unit
                paused, every, unit = False, None, None
                next_at = _next_time(at, e, u)
            if scheduled and u == "e":
                enabled, next_at, action = False, None, "one_shot_done" if action == "none" else action
            elif scheduled and not paused:
                next_at = _next_time(at, e, u)
        out.append((at, status, paused, e, u, action, next_at))
    return (paused, every, unit, enabled, None if next_at is None else pd.Timestamp(next_at).to_pydatetime()), out


def drift_monitor(checks: DataFrame) -> DataFrame:
    """checks (device_id, at, status, every, unit, manual) -> a row for each with pause, schedule and next time after it.

    Checks of one device at one time are ordered by status, then by the rest.
    """

    def step(state, device, rows):
        after, out = _drift_steps(state, rows)
        return after, pd.DataFrame([(device, *r) for r in out], columns=[x.split()[0] for x in _DRIFT.split(", ")])

    given = checks.select("device_id", F.col("at").cast("timestamp").alias("at"), "status", "every", "unit", "manual")
    return in_order(given, "device_id", ["at", "status", "every", "unit", "manual"], step, _DRIFT, _DRIFT_STATE)


# --- J2: tickets

TICKET_STEPS = 5


def ticket_flow(signatures: DataFrame) -> DataFrame:
    """Step of each ticket (one for each signature, up to the last), and signatures after the end."""
    counts = signatures.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("ticket_id", F.least("n", F.lit(TICKET_STEPS)).alias("step"), F.greatest(F.col("n") - TICKET_STEPS, F.lit(0)).alias("rejected"), (F.col("n") >= TICKET_STEPS).alias("finished"))


def restore_schedules(devices: DataFrame, finished: DataFrame, now: Column) -> DataFrame:
    """Devices after the tickets that have just finished: not paused, with the schedule saved (missing parts: 1, h) and the next time
    counted from ``now``.  Other devices stay as they are.

    devices: id, every, unit, last_at, next_at, paused, saved struct<every, unit>; finished: device_id.
    """
    ended = finished.select(F.col("device_id").alias("id")).distinct().withColumn("_ended", F.lit(True))
    had = F.col("saved").isNotNull()
    rows = devices.join(ended, "id", "left").withColumn("_ended", F.coalesce("_ended", F.lit(False)))
    every, unit = F.when(had, F.coalesce("saved.every", F.lit(1))).otherwise(F.col("every")), F.when(had, F.coalesce("saved.unit", F.lit("h"))).otherwise(F.col("unit"))
    new = {"every": every, "unit": unit, "last_at": now, "next_at": next_occurrence(now, every, unit), "paused": F.lit(False), "saved": F.lit(None)}
    return rows.withColumns({c: F.when(~F.col("_ended"), F.col(c)).otherwise(value) for c, value in new.items()}).select(devices.columns)


# --- J3: signatures in the order of roles

ROLES = ("technician", "supervisor", "admin")


def signature_flow(signatures: DataFrame) -> DataFrame:
    """signatures (id, sheet_id, role, at) with ``accepted``: a role signs after the one before it has, and once."""
    if not signatures.isStreaming:
        w = W.partitionBy("sheet_id").orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1)
        rows, before = signatures, F.lit(True)
        for role in ROLES:
            mine = (F.col("role") == role) & before
            rows = rows.withColumn(f"_{role}", mine).withColumn(f"_had_{role}", F.coalesce(F.max(f"_{role}").over(w), F.lit(False)))
            before = F.col(f"_had_{role}")
        accepted = F.lit(False)
        for role in ROLES:
            accepted = accepted | (F.col(f"_{role}") & ~F.col(f"_had_{role}"))
        return rows.select("id", "sheet_id", "role", "at", accepted.alias("accepted"))

    def step(state, sheet, rows):
        (n,), taken = state or (0,), []
        for role in rows["role"]:
            good = n < len(ROLES) and role == ROLES[n]
            taken.append(good)
            n += good
        return (n,), rows.assign(sheet_id=sheet, accepted=taken)[["id", "sheet_id", "role", "at", "accepted"]]

    return in_order(signatures.select("id", "sheet_id", "role", "at"), "sheet_id", ["at", "id"], step, "id long, sheet_id long, role string, at timestamp, accepted boolean", "n int")


# --- J4: idempotent intake


def ingest_once(requests: DataFrame, key: str = "idempotency_key", column: str = "at") -> DataFrame:
    """The first request of each key, and again the first one 24 hours or more after the last that was taken.

    A stream holds requests until the watermark (``DELAY``), so that it takes the same ones in whatever order they come, and forgets a key
    24 hours after the one it took.
    """
    day, names = datetime.timedelta(hours=24), requests.columns
    if requests.isStreaming:

        def step(state, own, rows):
            last, kept = None if state is None else pd.Timestamp(state[0]), []
            for at in pd.to_datetime(rows[column]):
                kept.append(last is None or at - last >= day)
                last = at if kept[-1] else last
            return (last.to_pydatetime(),), rows[kept].assign(**{key: own})[names]

        others = [c for c in requests.columns if c not in (key, column)]
        typed = requests.withColumn(column, F.col(column).cast("timestamp"))
        return in_order(typed, key, [column, *others], step, typed.schema, "last timestamp", lambda state: state[0] + day)

    def taken(batches):
        last = None  # key and time taken last; rows come in order
        for batch in batches:
            kept = []
            for own, at in zip(batch.column(key).to_pylist(), batch.column("_at").to_pylist()):
                kept.append(last is None or last[0] != own or at - last[1] >= 24 * 3600 * 10**6)
                last = (own, at) if kept[-1] else last
            yield batch.filter(pa.array(kept, pa.bool_())).drop_columns("_at")

    rest = [c for c in requests.columns if c not in (key, column)]
    ordered = requests.withColumn("_at", F.unix_micros(F.col(column).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "_at", *rest)
    return ordered.mapInArrow(taken, requests.schema)


# --- J5: progress


def monotonic_progress(events: DataFrame) -> DataFrame:
    """events (job_id, id, completed, total): percent from 0 to 100 that never falls, sequence numbers, and whether it is done."""
    raw = F.when(F.col("total") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("completed") / F.col("total") * 100))).otherwise(0.0)
    if not events.isStreaming:
        w = W.partitionBy("job_id").orderBy("id")
        percent = F.round(F.max(raw).over(w.rowsBetween(W.unboundedPreceding, 0)), 4)
        return events.select("job_id", "id", F.row_number().over(w).cast("long").alias("sequence"), percent.alias("percent")).withColumn("terminal", F.col("percent") >= 100)

    def step(key, frames, state: GroupState):
        n, top = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values("id")
        best = rows["raw"].cummax().clip(lower=top)
        out = rows.assign(sequence=range(n + 1, n + len(rows) + 1), percent=best.round(4), terminal=best.round(4) >= 100)
        state.update((n + len(rows), float(best.iloc[-1])))
        yield out[["job_id", "id", "sequence", "percent", "terminal"]]

    return events.withColumn("raw", raw).select("job_id", "id", "raw").groupBy("job_id").applyInPandasWithState(step, "job_id long, id long, sequence long, percent double, terminal boolean", "n long, top double", "append", GroupStateTimeout.NoTimeout)


# --- J6: stages that wait for one another

WAIT = "600 seconds"


def pair_stages(headers: DataFrame, details: DataFrame) -> DataFrame:
    """details (job_id, detail_at) with the outcome of the header (job_id, header_at, header_status) of the same job:
    READY within the wait, SKIPPED if the header failed, FAILED if none came."""
    d, h = details, headers.withColumnRenamed("job_id", "header_job")
    if details.isStreaming:
        d, h = d.withWatermark("detail_at", DELAY), h.withWatermark("header_at", DELAY)
    span = F.expr(f"job_id = header_job AND header_at >= detail_at - INTERVAL {WAIT} AND header_at <= detail_at + INTERVAL {WAIT}")
    outcome = F.when(F.col("header_job").isNull(), "FAILED").when(F.col("header_status") == "FAILED", "SKIPPED").otherwise("READY")
    return d.join(h, span, "left").select("job_id", "detail_at", "header_at", outcome.alias("outcome"))


# --- J7: live counts


def latest_status(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "creator"), F.struct("at", "id")).alias("s"), F.max(F.struct("at", "id")).alias("_at")).select("job_id", "s.status", "s.creator", F.col("_at.at").alias("at"), F.col("_at.id").alias("id"))


def status_totals(latest: DataFrame) -> DataFrame:
    """Jobs by status, over all (creator null) and for each creator."""
    return latest.groupingSets([["status"], ["status", "creator"]], "status", "creator").agg(F.count(F.lit(1)).alias("n"))


_LATEST = "at timestamp, id long, status string, creator long"


def status_changes(events: DataFrame) -> DataFrame:
    """A stream of retractions: for each job whose latest status or creator changes, the old one with -1 and the new one with +1.

    The latest row is the one of greatest (at, id), so the order of arrival doesn't matter; only this row of a job is kept as state.
    """

    def step(key, frames, state: GroupState) -> Iterator[pd.DataFrame]:
        known = before = tuple(state.get) if state.exists else None
        for pdf in frames:
            top = pdf.sort_values(["at", "id"]).iloc[-1]
            if known is None or (_micros(top["at"]), top["id"]) > (_micros(known[0]), known[1]):
                known = (top["at"].to_pydatetime(), int(top["id"]), top["status"], None if pd.isna(top["creator"]) else int(top["creator"]))
        if known != before:
            state.update(known)
        out = [] if before and known[2:] == before[2:] else [(*known[2:], 1)] + ([(*before[2:], -1)] if before else [])
        yield pd.DataFrame(out, columns=["status", "creator", "n"])

    rows = events.select("job_id", F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), "status", F.col("creator").cast("long").alias("creator"))
    return rows.groupBy("job_id").applyInPandasWithState(step, "status string, creator long, n long", _LATEST, "append", GroupStateTimeout.NoTimeout)


def live_status_counts(events: DataFrame, changes_path: str, sink, checkpoint: str):
    """Starts a stream that writes the changes of the totals of each batch (by status, and by status and creator) and gives them to ``sink``.

    What is written is a row for each total that the batch changes, in a folder of the batch's number, so a repeated batch replaces
    itself.  ``status_totals_of`` adds them up.
    """

    def add(batch: DataFrame, number: int) -> None:
        path = f"{changes_path}/batch={number}"
        batch.groupingSets([["status"], ["status", "creator"]], "status", "creator").agg(F.sum("n").alias("n"), F.grouping("creator").cast("boolean").alias("overall")).filter("n <> 0").write.mode("overwrite").parquet(path)
        sink(batch.sparkSession.read.schema(_CHANGES).parquet(path), number)

    return status_changes(events).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_CHANGES = "status string, creator long, n long, overall boolean"


def status_totals_of(spark, changes_path: str) -> DataFrame:
    """The totals as of now: (status, creator, n), as ``status_totals`` gives them."""
    changes = spark.read.schema(_CHANGES).option("recursiveFileLookup", True).parquet(changes_path)
    return changes.groupBy("status", "creator", "overall").agg(F.sum("n").alias("n")).filter("n <> 0").drop("overall")


# --- J8: reference data


class SyncedTable:
    """A table in ``buckets`` buckets by code, with a manifest for each version: which folder holds each bucket, and its rows.

    A version writes the buckets that it touches and then its manifest, whose commit makes it the current one; a version that was
    cut short is written anew.  Files that neither the current nor the previous version names are deleted; a reader of an older one
    must read again.
    """

    def __init__(self, spark, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _folder(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def versions(self) -> list[int]:
        """Numbers of the complete versions, ascending."""
        fs, path = self._folder("manifest")
        found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(p.getName()) for p in found if self._folder(f"manifest/{p.getName()}/_SUCCESS")[0].exists(self._folder(f"manifest/{p.getName()}/_SUCCESS")[1]))

    def manifest(self, version: int) -> dict[int, tuple[str, int]]:
        """Folder and rows of each bucket that has rows; ``buckets`` entries at most."""
        return {r["bucket"]: (r["folder"], r["n"]) for r in self.spark.read.parquet(f"{self.path}/manifest/{version}").collect()}

    @property
    def schema(self) -> T.StructType:
        """Column names and types, from the file beside the first manifest."""
        return T.StructType.fromDDL(self.spark.read.text(f"{self.path}/schema").first()[0])

    def bucket(self, code: str = "code") -> Column:
        return F.pmod(F.xxhash64(code), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Version 0; a column ``code`` names the rows."""
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.spark.createDataFrame([(ddl,)], "ddl string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        self.write(rows, 0, {}, range(self.buckets))

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """Rows of the current version, or of the buckets ``only``."""
        version = self.versions()[-1] if version is None else version
        folders = [folder for b, (folder, _) in self.manifest(version).items() if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{x}" for x in folders))

    def write(self, rows: DataFrame, version: int, before: dict[int, tuple[str, int]], touched) -> int:
        """``rows`` of the ``touched`` buckets become version ``version``; returns the rows of the whole table."""
        data = f"data/{version}"
        rows.withColumn("_bucket", self.bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{data}")
        fs, path = self._folder(data)
        there = [f.getPath().getName() for f in fs.listStatus(path)]
        there = [int(x.partition("=")[2]) for x in there if x.startswith("_bucket=")]
        counts = dict.fromkeys(there, 0)
        if there:
            written = self.spark.read.parquet(f"{self.path}/{data}").groupBy("_bucket").count()
            counts = dict(map(tuple, written.collect()))  # a row for each bucket
        now = {b: x for b, x in before.items() if b not in set(touched)} | {b: (f"{data}/_bucket={b}", n) for b, n in counts.items()}
        entries = self.spark.createDataFrame([(b, *x) for b, x in sorted(now.items())], "bucket int, folder string, n long")
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")
        return sum(n for _, n in now.values())

    def expire(self) -> None:
        """Deletes manifests before the previous one, and the files that only these name."""
        *old, previous, current = [-1, *self.versions()] if len(self.versions()) < 2 else self.versions()
        kept = {folder for v in (previous, current) if v >= 0 for folder, _ in self.manifest(v).values()}
        for version in (v for v in old if v >= 0):
            for folder, _ in self.manifest(version).values():
                if folder not in kept:
                    fs, path = self._folder(folder)
                    fs.delete(path, True)
            fs, path = self._folder(f"manifest/{version}")
            fs.delete(path, True)


def sync_stream(batches: DataFrame, target: SyncedTable, codes: list[str], mapping: dict[str, str], order: str, checkpoint: str, report, parents: DataFrame | None = None, link: tuple[str, str, str] | None = None):
    """Starts a stream that upserts each micro-batch into the table and reports (number, rows read, rows after, status text).

    Only the buckets of the batch's codes are read and written.  ``link`` (column, own key, parent's key) fills that column of rows
    without it from ``parents``.  A batch that fails is reported with the start of its error and ends the stream; started anew, the stream
    takes it up again from the last complete version.
    """
    from ..operators.joins import link_orphans
    from ..operators.versions import code_of, upsert_by_code

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            before = target.manifest(number)
            touched = [r[0] for r in batch.select(code_of(codes).alias("code")).filter("code is not null").select(target.bucket()).distinct().collect()]
            rows = upsert_by_code(target.read(number, touched), batch, codes, mapping, order)
            if parents is not None and link is not None:
                rows = link_orphans(rows, parents, *link).select(rows.columns)
            after = target.write(rows.select(target.schema.names), number + 1, before, touched)
            target.expire()
            read = batch.count()
        except Exception as error:
            report(number, 0, 0, f"FAILED: {str(error)[:50]}")
            raise
        finally:
            batch.unpersist()
        report(number, read, after, f"SUCCESS: {read} rows read, {after} rows known")

    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- J9: ticks


def _hour(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / 3600)


def due_tick(ticks: DataFrame, schedule: DataFrame, every: str | None = None) -> DataFrame:
    """(tick, id) of the devices due at each tick (``at``) of a stream or table, by a calendar of hours.

    Devices stand at the hour of their next time; a tick looks up hours and compares the times within.  With ``every``, the time from one
    tick to the next, a device is told at the first tick at or after its next time alone, and a tick looks up the hours of that span; a
    stream always does so (``1 minute`` unless stated).  Without it a tick tells all devices that are due, from the calendar's first hour.
    """
    due = schedule.filter("enabled AND NOT coalesce(paused, false)").select("id", "next_at", _hour(F.col("next_at")).alias("_hour"))
    every = "1 minute" if every is None and ticks.isStreaming else every
    rows = ticks.select(F.col("at").alias("tick"))
    if every is None:
        first = due.agg(F.min("_hour")).first()[0]
        rows, since = rows.filter(_hour(F.col("tick")) >= F.lit(first)), F.lit(True)
        hours = F.sequence(F.lit(first), _hour(F.col("tick")))
    else:
        before = F.col("tick") - F.expr(f"INTERVAL {every}")
        hours, since = F.sequence(_hour(before), _hour(F.col("tick"))), F.col("next_at") > before
    return rows.withColumn("_hour", F.explode(hours)).join(due, "_hour").filter((F.col("next_at") <= F.col("tick")) & since).select("tick", "id")


def minute_ticks(spark) -> DataFrame:
    """A tick each minute."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.second("timestamp") == 0).select(F.col("timestamp").alias("at"))


def activity_stream(events: DataFrame, column: str = "ts", width: str = "1 day", zone_hours: int = 7) -> DataFrame:
    """Counts of events by local day, as they come in."""
    local = F.window(column, width, startTime=f"{(24 - zone_hours) % 24} hours")
    counted = events.withWatermark(column, DELAY) if events.isStreaming else events
    return counted.groupBy(local.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
