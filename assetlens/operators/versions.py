"""Versions of sheets, latest rows, differences and upserts (sections E and G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import differs


def latest_per_key(df: DataFrame, key: str, order: str, tie: str = "id") -> DataFrame:
    """Newest row of each key, the highest tie id among equals."""
    rows = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(rows, F.struct(order, tie)).alias("_row")).select("_row.*")


def active_version(sheets: DataFrame) -> DataFrame:
    """Newest completed sheet of each device, else its newest of any status."""
    rows = F.struct(*sheets.columns)
    newest = F.struct((F.col("status") == "COMPLETED").alias("done"), "created_at", "id")
    return sheets.filter("device_id is not null").groupBy("device_id").agg(F.max_by(rows, newest).alias("_row")).select("_row.*")


def previous_version(sheets: DataFrame) -> DataFrame:
    """Adds ``previous_id``: the newest sheet of the device strictly earlier (highest id among equals); null without one."""
    known = sheets.filter("device_id is not null")  # sheets without a device would all fall into one group
    earlier = W.partitionBy("device_id").orderBy(F.unix_micros(F.col("created_at").cast("timestamp"))).rangeBetween(W.unboundedPreceding, -1)
    found = F.max(F.struct("created_at", "id")).over(earlier)["id"]
    without = sheets.filter("device_id is null").withColumn("previous_id", F.lit(None).cast(sheets.schema["id"].dataType))
    return known.withColumn("previous_id", found).unionByName(without)


def first_by_role(signatures: DataFrame, roles: list[str]) -> DataFrame:
    """Per sheet, the earliest-written signature of each role as columns, and whether it exists."""
    first = signatures.groupBy("sheet_id").pivot("role", roles).agg(F.min_by("signer", "id").alias("signer"), F.min("id").alias("first"))
    out = [F.col("sheet_id")]
    for r in roles:
        out += [F.col(f"{r}_signer"), F.col(f"{r}_first").isNotNull().alias(f"has_{r}")]
    return first.select(*out)


def _with_new(rows: DataFrame, keys: list[str], order: str, new: Column) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_island", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def tag_spans(tokens: DataFrame, column: str) -> DataFrame:
    """Entities (document_id, entity, first_place, last_place) of the tags in a column; tags that are neither B- nor I- belong to none."""
    w = W.partitionBy("document_id").orderBy("place")
    kind = F.when(F.col(column).rlike("^[BI]-"), F.expr(f"substring({column}, 3)"))
    tagged = tokens.withColumn("_kind", kind).withColumn("_before", F.lag("_kind").over(w))
    opens = F.coalesce(F.startswith(F.col(column), F.lit("B-")), F.lit(False)) | ~F.col("_kind").eqNullSafe(F.col("_before"))
    runs = _with_new(tagged, ["document_id"], "place", opens).filter("_kind is not null")
    return runs.groupBy("document_id", "_island").agg(F.first("_kind").alias("entity"), F.min("place").alias("first_place"), F.max("place").alias("last_place")).drop("_island")


def merge_spans(tokens: DataFrame) -> DataFrame:
    """Tag runs (B-, I-, O) as entities: label, first and last place, text, box, mean confidence; a stray I- opens one.

    tokens: document_id, place, text, label, confidence, x1, y1, x2, y2.
    """
    w = W.partitionBy("document_id").orderBy("place")
    kind = F.when(F.col("label") != "O", F.expr("substring(label, 3)"))
    tagged = tokens.withColumn("_kind", kind).withColumn("_before", F.lag("_kind").over(w))
    opens = F.startswith(F.col("label"), F.lit("B-")) | ~F.col("_kind").eqNullSafe(F.col("_before"))
    runs = _with_new(tagged, ["document_id"], "place", opens).filter("_kind is not null")
    return runs.groupBy("document_id", "_island").agg(
        F.first("_kind").alias("entity"), F.min("place").alias("first_place"), F.max("place").alias("last_place"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda t: t["text"]), " ").alias("text"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.round(F.avg("confidence"), 6).alias("confidence"),
    ).drop("_island")


def sequence_violations(tokens: DataFrame, known: list[str]) -> DataFrame:
    """I- tags that don't follow B- or I- of their kind; unknown tags break a run."""
    w = W.partitionBy("document_id").orderBy("place")
    label = F.when(F.col("label").isin(known), F.col("label"))
    kind = F.expr("substring(_label, 3)")
    rows = tokens.withColumn("_label", label).withColumn("_kind", F.when(F.col("_label") != "O", kind)).withColumn("_before", F.lag("_kind").over(w))
    return rows.filter(F.startswith("_label", F.lit("I-")) & ~F.col("_kind").eqNullSafe(F.col("_before"))).select("document_id", "place", "label")


def numbering_jumps(pages: DataFrame) -> DataFrame:
    """Numbered pages whose step in number differs from their step in place."""
    w = W.partitionBy("source").orderBy("page_index")
    rows = pages.filter("current_page is not null").withColumns({"before_index": F.lag("page_index").over(w), "before_page": F.lag("current_page").over(w)})
    return rows.filter("before_index is not null and current_page - before_page <> page_index - before_index").select("source", "page_index", "before_page", "current_page")


def rank_candidates(scored: DataFrame, least: float = 70.0, margin: float = 15.0, key: tuple[str, ...] = ("field",), kept: tuple[str, ...] = ()) -> DataFrame:
    """Per field (of ``key``) the leader, its margin to the runner-up, and whether it is selected, with reasons; ``kept``: columns of the leader."""
    w = W.partitionBy(*key).orderBy(F.desc("score"), "candidate_id")
    rows = scored.withColumns({"rank": F.row_number().over(w), "runner_up": F.lead("candidate_id").over(w), "margin": F.round(F.col("score") - F.lead("score").over(w), 4)}).filter("rank = 1")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("constrained"), "leading_candidate_has_hard_constraints"),
            F.when(F.col("score") < least, "below_auto_select_minimum"),
            F.when(F.col("margin") < margin, "winner_margin_below_minimum"),
        )
    )
    out = rows.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "auto_selected").otherwise("review_required"))
    told = F.when(F.size("reasons") == 0, F.array(F.lit("auto_select_conditions_satisfied"))).otherwise(F.col("reasons"))
    return out.select(*key, F.col("candidate_id").alias("leader"), "runner_up", "score", "margin", "status", F.array_join(told, ",").alias("reasons"), *kept)


def text_after_marker(blocks: DataFrame, marker: str) -> DataFrame:
    """Per page, the text in reading order from the first block with the marker to the end; null if there is none."""
    from .joins import PAGE

    hit = F.when(F.contains(F.lower("text"), F.lit(marker.lower())), F.struct("y1", "x1", "block_id"))
    rows = blocks.withColumn("_from", F.min(hit).over(W.partitionBy(*PAGE))).withColumn("_at", F.struct("y1", "x1", "block_id"))
    kept = F.collect_list(F.when(F.col("_at") >= F.col("_from"), F.struct("_at", "text")))
    text = F.array_join(F.transform(F.sort_array(kept), lambda r: r["text"]), "\n")
    return rows.groupBy(*PAGE).agg(text.alias("text")).withColumn("text", F.nullif("text", F.lit("")))


def fill_merged_cells(records: DataFrame, role: str, table: str = "table_id") -> DataFrame:
    """Where a role has exactly one value in a table, its gaps take that value and are marked."""
    w = W.partitionBy(table)
    single = F.when(F.min(role).over(w) == F.max(role).over(w), F.max(role).over(w))
    return records.withColumns({"inherited": F.col(role).isNull() & single.isNotNull(), role: F.coalesce(F.col(role), single)})


def last_parameters(params: DataFrame, order: str = "place") -> DataFrame:
    """(sheet_id, code, value): the last entry of each code; codes without text dropped."""
    named = params.filter(F.coalesce(F.col("code"), F.lit("")) != "")
    return named.groupBy("sheet_id", "code").agg(F.max_by("value", order).alias("value"))


def explode_parameters(df: DataFrame, column: str, key: str = "sheet_id") -> DataFrame:
    """(key, place, code, value) of a JSON array of parameters or an object code -> value; the last of equal codes stays."""
    item = "array<struct<parameter_code:string,value:string>>"
    text = F.col(column)
    listed = F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("[")), text), item)
    mapped = F.map_entries(F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("{")), text), "map<string,string>"))
    items = F.coalesce(F.transform(listed, lambda x: F.struct(x["parameter_code"].alias("code"), x["value"].alias("value"))), F.transform(mapped, lambda x: F.struct(x["key"].alias("code"), x["value"].alias("value"))))
    rows = df.select(key, F.posexplode(items).alias("place", "item")).select(key, "place", "item.code", "item.value").filter(F.coalesce("code", F.lit("")) != "")
    return rows.groupBy(key, "code").agg(F.max(F.struct("place", "value")).alias("m")).select(key, "m.place", "code", "m.value")


def diff_parameters(sheets: DataFrame, params: DataFrame) -> DataFrame:
    """(sheet_id, code, kind, old_value, new_value) of each sheet against the device's previous one."""
    pairs = previous_version(sheets).filter("previous_id is not null").select(F.col("id").alias("sheet_id"), "previous_id")
    # A sheet's parameters are the new ones of itself and the old ones of its successors: one join, one evaluation.
    side = F.array(F.struct(F.col("sheet_id").alias("_from"), "sheet_id", F.lit(True).alias("_new")), F.struct(F.col("previous_id").alias("_from"), "sheet_id", F.lit(False).alias("_new")))
    sides = pairs.select(F.explode(side).alias("_s")).select("_s.*")
    rows = sides.join(last_parameters(params).withColumnRenamed("sheet_id", "_from"), "_from")
    of = lambda new: [F.max(F.when(F.col("_new") == new, F.col("value"))), F.count_if(F.col("_new") == new)]
    (new_value, n_new), (old_value, n_old) = of(True), of(False)
    both = rows.groupBy("sheet_id", "code").agg(new_value.alias("new_value"), n_new.alias("_n"), old_value.alias("old_value"), n_old.alias("_o"))
    kind = F.when(F.col("_o") == 0, "ADDED").when(F.col("_n") == 0, "REMOVED").when(differs(F.col("old_value"), F.col("new_value")), "CHANGED")
    return both.withColumn("kind", kind).filter("kind is not null").select("sheet_id", "code", "kind", "old_value", "new_value")


def flag_changed(sheets: DataFrame, params: DataFrame) -> DataFrame:
    """Sheets with ``changed``: whether any parameter differs from the previous version; false without one or without data."""
    data = params.select(F.col("sheet_id").alias("id")).distinct().withColumn("_data", F.lit(True))
    changed = diff_parameters(sheets, params).select(F.col("sheet_id").alias("id")).distinct().withColumn("_changed", F.lit(True))
    return sheets.join(data, "id", "left").join(changed, "id", "left").withColumn("changed", F.col("_data").isNotNull() & F.col("_changed").isNotNull()).drop("_data", "_changed")


#: Codes that describe a reading rather than a parameter (fixed values).
READING_METADATA = ("timestamp", "device")


def compare_readings(readings: DataFrame, active: DataFrame) -> DataFrame:
    """Per device: MATCH or MISMATCH and the differing codes of its readings (device_id, code, value) against (device_id, code, expected)."""
    named = readings.filter(~F.col("code").isin(*READING_METADATA))
    devices = active.select("device_id").distinct()
    both = named.join(devices, "device_id").join(active, ["device_id", "code"], "left")
    off = differs(F.coalesce("value", F.lit("")), F.coalesce("expected", F.lit("")), trimmed=True)
    flagged = both.withColumn("is_diff", off)
    out = flagged.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_readings"), F.count_if("is_diff").alias("n_diff"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_diff"), F.col("code")))), ",").alias("codes"))
    return out.withColumn("status", F.when(F.col("n_diff") > 0, "MISMATCH").otherwise("MATCH"))


def correction_rows(logs: DataFrame, now: Column, items: DataFrame) -> DataFrame:
    """Corrective sheets for the newest drifted check of each device: targets, wrong values and a stamped code.

    logs: id, device_id, checked_at, status; items: log_id, code, value, expected, is_diff.
    """
    newest = latest_per_key(logs, "device_id", "checked_at").filter(F.col("status") == "MISMATCH").select(F.col("id").alias("log_id"), "device_id")
    rows = newest.join(items, "log_id").select(
        "device_id", F.concat(F.lit("FIX-"), F.col("device_id"), F.lit("-"), F.date_format(now, "yyyyMMddHHmm")).alias("sheet_code"), "code",
        F.coalesce("expected", "value").alias("target"), F.when(F.col("is_diff"), F.col("value")).alias("wrong_value"),
    )
    return rows.withColumn("status", F.lit("RECEIVED"))


def code_of(codes: list[str]) -> Column:
    """The first of the columns ``codes`` with text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in codes))


def upsert_by_code(target: DataFrame, batch: DataFrame, codes: list[str], mapping: dict[str, str], order: str) -> DataFrame:
    """Target rows with the batch's last row of each code applied and new codes added.

    The code is the first of ``codes`` with text; rows without one are skipped.  A mapped column is
    overwritten (with '' where the batch row has none); the others stay.
    """
    rows = batch.withColumn("code", code_of(codes)).filter("code is not null")
    last = rows.groupBy("code").agg(F.max_by(F.struct(*(F.coalesce(F.col(s), F.lit("")).alias(t) for t, s in mapping.items())), order).alias("_new"))
    joined = target.join(last, "code", "full")
    out = [F.col("code")] + [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in mapping else F.col(c) for c in target.columns if c != "code"]
    return joined.select(*out)


def timeline(sheets: DataFrame, signatures: DataFrame, edits: DataFrame) -> DataFrame:
    """(sheet_id, at, kind, who) of creation, signatures, assignment and edits; the rows of a sheet lie together, newest first.

    edits: sheet_id, time (text; unparsable dropped), user.  Assignment is dated by the first
    dispatcher signature, else by creation.
    """
    created = sheets.select(F.col("id").alias("sheet_id"), F.col("created_at").alias("at"), F.lit("created").alias("kind"), F.col("created_by").cast("string").alias("who"), F.lit(0).alias("branch"))
    signed = signatures.select("sheet_id", F.col("signed_at").alias("at"), F.concat(F.lit("signed:"), "role").alias("kind"), F.col("signer").cast("string").alias("who"), F.lit(1).alias("branch"))
    sent = signatures.filter(F.col("role") == "dispatcher").groupBy("sheet_id").agg(F.min("signed_at").alias("sent_at"))
    assigned = (
        sheets.filter("assigned_to is not null").join(sent, sheets["id"] == sent["sheet_id"], "left")
        .select(F.col("id").alias("sheet_id"), F.coalesce("sent_at", "created_at").alias("at"), F.lit("assigned").alias("kind"), F.col("assigned_to").cast("string").alias("who"), F.lit(2).alias("branch"))
    )
    edited = edits.select("sheet_id", F.try_to_timestamp("time").alias("at"), F.lit("edited").alias("kind"), F.col("user").cast("string").alias("who"), F.lit(3).alias("branch")).filter("at is not null")
    every = created.unionByName(signed).unionByName(assigned).unionByName(edited)
    return every.repartition("sheet_id").sortWithinPartitions("sheet_id", F.desc("at"), "branch", "kind", "who")


def apply_edits(params: DataFrame, edits: DataFrame) -> DataFrame:
    """Parameters (sheet_id, place, code, value, original) with edits (sheet_id, place, new) applied.

    Blank edits and numerically equal ones are ignored; a number is stored as a number's text; the
    first original is kept; ``change`` tells what happened.
    """
    rows = params.join(edits, ["sheet_id", "place"], "left")
    given = F.trim(F.coalesce("new", F.lit("")))
    took = (given != "") & differs(F.col("value"), given)
    return rows.select(
        "sheet_id", "place", "code", F.when(took, given).otherwise(F.col("value")).alias("value"), F.when(took, F.coalesce("original", "value")).otherwise(F.col("original")).alias("original"),
        F.when(took, F.concat_ws(" ", F.concat("code", F.lit(":")), "value", F.lit("->"), given)).alias("change"),
    )


def plan_runs(cases: DataFrame, run_id: str) -> DataFrame:
    """(execution_id, case_id, attempt, family) for each repetition of a case, and one forced failure."""
    rows = cases.select(F.col("case_id"), "family", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "repeat"))).alias("attempt"))
    out = rows.select(F.concat(F.lit(f"{run_id}-"), "case_id", F.lit("-"), F.lpad(F.col("attempt").cast("string"), 2, "0")).alias("execution_id"), "case_id", "attempt", "family")
    forced = cases.sparkSession.range(1).select(F.lit(f"{run_id}-forced-failure-01").alias("execution_id"), F.lit("forced-failure").alias("case_id"), F.lit(1).alias("attempt"), F.lit(None).cast("string").alias("family"))
    return out.unionByName(forced)


def reset_jobs(jobs: DataFrame, mode: str) -> DataFrame:
    """``retry``: failed jobs wait again, without their error, and their sheet is a draft; ``restart``: running jobs fail."""
    hit = F.col("status") == ("FAILED" if mode == "retry" else "PROCESSING")
    new, error = (F.lit("PENDING"), F.lit(None).cast("string")) if mode == "retry" else (F.lit("FAILED"), F.lit("WORKER_RESTARTED"))
    parent = F.when(hit & F.lit(mode == "retry"), "DRAFT").otherwise(F.col("sheet_status"))
    return jobs.withColumns({"status": F.when(hit, new).otherwise(F.col("status")), "error_code": F.when(hit, error).otherwise(F.col("error_code")), "sheet_status": parent})


def enrich_from_header(jobs: DataFrame, sheets: DataFrame) -> DataFrame:
    """(id, code, duplicate): a sheet takes the code its job read, unless another sheet has it.

    jobs: sheet_id, found_code; sheets: id, code.
    """
    owners = sheets.groupBy("code").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    rows = sheets.join(jobs, sheets["id"] == jobs["sheet_id"]).select("id", sheets["code"], "found_code").join(owners.withColumnRenamed("code", "found_code"), "found_code", "left")
    other = (F.col("low") != F.col("id")) | (F.col("high") != F.col("id"))
    taken = F.coalesce(other, F.lit(False))
    return rows.select("id", F.when((F.coalesce("found_code", F.lit("")) != "") & ~taken, F.col("found_code")).otherwise(F.col("code")).alias("code"), taken.alias("duplicate"))


def merge_stage_results(header: DataFrame, details: DataFrame) -> DataFrame:
    """Per job: fields of the header, records of the details, summaries merged (details win), pages one after the other."""
    h = header.select("job_id", "fields", F.col("summary").alias("_hs"), F.col("pages").alias("_hp"))
    d = details.select("job_id", "records", F.col("summary").alias("_ds"), F.col("pages").alias("_dp"))
    left = F.map_filter("_hs", lambda k, _: ~F.map_contains_key("_ds", k))
    return h.join(d, "job_id").select("job_id", "fields", "records", F.map_concat(left, "_ds").alias("summary"), F.concat("_hp", "_dp").alias("pages"))
