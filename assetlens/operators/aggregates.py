"""Aggregations (section D)."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import tag_spans


def child_counts(parent: DataFrame, child: DataFrame, link: str) -> DataFrame:
    """Distinct children of each parent, zero included."""
    counts = child.filter(F.col(link).isNotNull()).groupBy(F.col(link).alias("id")).agg(F.count_distinct(child["id"]).alias("n_children"))
    return parent.join(counts, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def status_counts(df: DataFrame, groups: dict[str, tuple[str, ...]], column: str = "status") -> DataFrame:
    """One row of counts, a column for each group and ``total``; zeros for an empty table."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(column).isin(*values)).alias(name) for name, values in groups.items()))


def workload(users: DataFrame, sheets: DataFrame, open_states: tuple[str, ...]) -> DataFrame:
    """Open sheets of each user, zero included, least loaded first."""
    counts = sheets.filter(F.col("status").isin(*open_states)).groupBy(F.col("assigned_to").alias("id")).agg(F.count(F.lit(1)).alias("n_open"))
    return users.join(counts, "id", "left").withColumn("n_open", F.coalesce("n_open", F.lit(0))).orderBy("n_open", "id")


def coverage(devices: DataFrame, sheets: DataFrame) -> DataFrame:
    """One row: total, configured, unconfigured, whole percent configured (0 for no devices)."""
    known = sheets.select(F.col("device_id").alias("id")).distinct().withColumn("_k", F.lit(True))
    row = devices.join(known, "id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("_k").alias("configured"))
    percent = F.when(F.col("total") == 0, 0).otherwise((F.col("configured") / F.col("total") * 100).cast("int"))
    return row.withColumns({"unconfigured": F.col("total") - F.col("configured"), "percent": percent})


def activity_series(df: DataFrame, start: str, end: str, monthly: bool | None = None, column: str = "created_at", zone: str = "Asia/Ho_Chi_Minh") -> DataFrame:
    """(bucket, label, n) for every local day, or month beyond 90 days, from start to end, zeros included; reversed ends are swapped."""
    start, end = sorted((start, end))
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    if monthly is None:
        monthly = (date.fromisoformat(end) - date.fromisoformat(start)).days > 90
    local = F.from_utc_timestamp(column, zone).cast("date")
    bucket = (lambda c: F.trunc(c, "month")) if monthly else (lambda c: c)
    step = F.expr("INTERVAL 1 MONTH" if monthly else "INTERVAL 1 DAY")
    axis = df.sparkSession.range(1).select(F.explode(F.sequence(bucket(first), bucket(last), step)).alias("bucket"))
    counts = df.filter((local >= first) & (local <= last)).groupBy(bucket(local).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    label = F.concat(F.lit("T"), F.month("bucket"), F.lit("/"), F.year("bucket")) if monthly else F.date_format("bucket", "dd/MM")
    return axis.join(counts, "bucket", "left").select("bucket", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def period_bounds(period: str, today: date, start: str | None = None, end: str | None = None) -> tuple[date, date, bool]:
    """First day, last day and whether months are counted, for a preset: ``this_month``, ``this_year``, ``custom``, else the last 7 days.

    Reversed custom ends are swapped, and more than 90 days are counted by month.  If the start can't be read the default stays; if
    only the end can't, the last day stays today.
    """
    if period == "this_month":
        return today.replace(day=1), today, False
    if period == "this_year":
        return today.replace(month=1, day=1), today, True
    first, last = today - timedelta(days=6), today
    if period == "custom" and start and end:
        try:
            first = datetime.strptime(start, "%Y-%m-%d").date()
            last = datetime.strptime(end, "%Y-%m-%d").date()
        except ValueError:
            return first, last, False
        first, last = min(first, last), max(first, last)
        return first, last, (last - first).days > 90
    return first, last, False


def activity_by_period(df: DataFrame, period: str, today: date, start: str | None = None, end: str | None = None, **options) -> DataFrame:
    """``activity_series`` over a preset period; no rows if a start after today comes with an end that can't be read."""
    first, last, monthly = period_bounds(period, today, start, end)
    series = activity_series(df, first.isoformat(), last.isoformat(), monthly, **options)
    return series if first <= last else series.limit(0)


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts).groupBy().pivot("name", list(tables)).agg(F.sum("n"))


def schedule_stats(devices: DataFrame, now: Column) -> DataFrame:
    soon = F.col("enabled") & (F.col("next_at") > now) & (F.col("next_at") <= now + F.expr("INTERVAL 1 HOUR"))
    return devices.agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"), F.count_if(soon).alias("due_within_hour"))


def diff_counts(diffs: DataFrame) -> DataFrame:
    kinds = ("ADDED", "REMOVED", "CHANGED")
    return diffs.groupBy("sheet_id").agg(*(F.count_if(F.col("kind") == k).alias(k.lower()) for k in kinds), F.count(F.lit(1)).alias("total"))


def run_summary(pages: DataFrame) -> DataFrame:
    """Totals of a batch from page rows (document_id, skipped, records, multi_line, unassigned, warnings, elapsed)."""
    by_doc = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("skipped").alias("skipped"), *(F.sum(c).alias(c) for c in ("records", "multi_line", "unassigned", "warnings", "elapsed"))
    )
    sums = [F.sum(c).alias(c) for c in ("pages", "skipped", "records", "multi_line", "unassigned", "warnings")]
    return by_doc.agg(F.count(F.lit(1)).alias("documents"), *sums, F.count_if(F.col("warnings") > 0).alias("documents_with_warnings"), F.round(F.sum("elapsed"), 2).alias("elapsed")).withColumn("processed", F.col("pages") - F.col("skipped"))


def mode_first_seen(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent value of each key, the one seen first on ties; nulls don't count."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.round(a / b, 6))


def prf_metrics(pairs: DataFrame, outside: str = "O") -> DataFrame:
    """Precision, recall and F1 of each class of (gold, predicted) and over all (``micro``), the outside class left out."""
    classes = pairs.select(F.explode(F.array_distinct(F.array("gold", "predicted"))).alias("class"), "gold", "predicted").filter(F.col("class") != outside)
    hit, miss, extra = (F.col("gold") == F.col("predicted")), (F.col("gold") == F.col("class")) & (F.col("predicted") != F.col("class")), (F.col("gold") != F.col("class"))
    counts = [F.count_if(hit).alias("tp"), F.count_if(extra).alias("fp"), F.count_if(miss).alias("fn")]
    rows = classes.rollup("class").agg(*counts).withColumn("class", F.coalesce("class", F.lit("micro")))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return rows.withColumns({"precision": p, "recall": r, "f1": f1})


def span_metrics(tokens: DataFrame) -> DataFrame:
    """``prf_metrics`` of whole entities: a span counts if class, first and last place are equal.

    tokens: document_id, place, gold, predicted; tags B-, I- or O, where a stray I- opens an entity.
    """
    sides = [tag_spans(tokens, side).select("document_id", "entity", "first_place", "last_place", F.lit(side).alias("side")) for side in ("gold", "predicted")]
    spans = sides[0].unionByName(sides[1]).groupBy("document_id", "entity", "first_place", "last_place")
    found = spans.agg(*(F.max(F.when(F.col("side") == side, F.col("entity"))).alias(f"_{side}") for side in ("gold", "predicted")))
    return prf_metrics(found.select(*(F.coalesce(f"_{side}", F.lit("O")).alias(side) for side in ("gold", "predicted"))))


def acceptance_summary(plan: DataFrame, runs: DataFrame, required_families: list[str]) -> DataFrame:
    """One row on a run of a plan (execution_id, case_id, family): completeness, failures, coverage, repeatability.

    runs: execution_id, case_id, family, status, fingerprint, workspace.
    """
    missing = plan.select("execution_id").exceptAll(runs.select("execution_id")).agg(F.count(F.lit(1)).alias("n_missing"))
    by_case = runs.groupBy("case_id").agg(F.count_distinct("fingerprint").alias("k")).agg(F.count_if(F.col("k") > 1).alias("unrepeatable"))
    row = runs.agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("status") != "passed").alias("n_failed"),
        F.array_sort(F.array_except(F.array(*map(F.lit, required_families)), F.collect_set("family"))).alias("missing_families"), (F.count_distinct("workspace") == F.count(F.lit(1))).alias("own_workspaces"),
    )
    out = row.join(missing).join(by_case)
    good = (F.col("n_missing") == 0) & (F.col("n_failed") == 0) & (F.size("missing_families") == 0) & (F.col("unrepeatable") == 0) & F.col("own_workspaces")
    return out.withColumns({"missing_families": F.array_join("missing_families", ","), "accepted": good})


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document: values preserved, supplemented (null before), changed; compatible if none changed or went."""
    b, a = before.select("document_id", "field", F.col("value").alias("old")), after.select("document_id", "field", F.col("value").alias("new"))
    return compare_pairs(b.join(a, ["document_id", "field"], "full"))


def compare_pairs(both: DataFrame) -> DataFrame:
    """The same from the values paired: (document_id, old, new)."""
    same, more = F.col("old").eqNullSafe(F.col("new")), F.col("old").isNull() & F.col("new").isNotNull()
    out = both.groupBy("document_id").agg(F.count_if(same).alias("preserved"), F.count_if(more).alias("supplemented"), F.count_if(~same & ~more).alias("changed"))
    return out.withColumn("compatible", F.col("changed") == 0)


def paired_snapshots(rows: DataFrame) -> DataFrame:
    """(document_id, old, new) of two snapshots of the same rows (document_id, field, in_old, old, in_new, new), each the largest value of a field.

    The pairs are those of a full join of the two, but the rows are grouped once: a task holds one table of fields, where the join has one
    for each snapshot and sorts both.  As in the join, fields without a name or a document have no counterpart.
    """
    has, value = (lambda side: F.coalesce(F.max(f"in_{side}"), F.lit(False)).alias(f"in_{side}")), (lambda side: F.max(F.when(F.col(f"in_{side}"), F.col(side))).alias(side))
    fields = rows.groupBy("document_id", "field").agg(has("old"), value("old"), has("new"), value("new")).filter("in_old OR in_new")
    apart = (F.col("document_id").isNull() | F.col("field").isNull()) & F.col("in_old") & F.col("in_new")
    pairs = F.expr("array(named_struct('old', old, 'new', if(in_old AND in_new, NULL, new)), named_struct('old', NULL, 'new', new))")
    return fields.withColumn("pair", F.explode(F.when(apart, pairs).otherwise(F.array(F.struct("old", "new"))))).select("document_id", "pair.old", "pair.new")


def trace_summary(events: DataFrame) -> DataFrame:
    """Per trace (trace_id, seq, terminal, completed, total): events, terminal ones, last progress."""
    return events.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if("terminal").alias("n_terminal"), F.max_by("completed", "seq").alias("last_completed"), F.max_by("total", "seq").alias("last_total")
    )


def pool_predictions(vectors: DataFrame) -> DataFrame:
    """(word, window, probabilities array) -> mean vector's best label, its mean probability, number of windows."""
    flat = vectors.select("word", "window", F.posexplode("probabilities").alias("label", "p"))
    means = flat.groupBy("word", "label").agg(F.avg(F.col("p").cast("double")).alias("mean"))
    best = means.groupBy("word").agg(F.max(F.struct("mean", -F.col("label"))).alias("m")).select("word", (-F.col("m.col2")).alias("label"), F.round("m.mean", 6).alias("probability"))
    windows = vectors.groupBy("word").agg(F.count_distinct("window").alias("n_windows"))
    return best.join(windows, "word")


def vote_labels(words: DataFrame) -> DataFrame:
    """Block label by the largest sum of confidence (first seen on ties); the words' text in order, their joint box, whether all agree.

    words: block_id, word_index, text, label, confidence, x1, y1, x2, y2.
    """
    votes = words.groupBy("block_id", "label").agg(F.sum("confidence").alias("s"), F.min("word_index").alias("first"))
    best = votes.groupBy("block_id").agg(F.max_by("label", F.struct("s", -F.col("first"))).alias("label"), (F.count(F.lit(1)) == 1).alias("agree"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_index", "text"))), lambda w: w["text"]), " ")
    boxes = words.groupBy("block_id").agg(text.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return best.join(boxes, "block_id")
