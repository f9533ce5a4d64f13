"""Queries of versions, differences, edits and upserts over the register's stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as D
from ..operators import versions as V
from .registry import query

_LAST = "last AS (SELECT sheet_id, code, arg_max(value, place) AS value FROM parameters GROUP BY ALL)"
_PREV = """
ts AS (SELECT DISTINCT device_id, created_at FROM sheets), pt AS (SELECT device_id, created_at, lag(created_at) OVER (PARTITION BY device_id ORDER BY created_at) AS p FROM ts),
prev AS (SELECT s.id AS sheet_id, max(o.id) AS previous_id FROM sheets s JOIN pt USING (device_id, created_at) LEFT JOIN sheets o ON o.device_id = s.device_id AND o.created_at = pt.p GROUP BY s.id)"""
_DIFF = (
    _PREV
    + ", "
    + _LAST
    + """,
n AS (SELECT p.sheet_id, code, value AS new_value FROM prev p JOIN last l ON l.sheet_id = p.sheet_id WHERE previous_id IS NOT NULL), o AS (SELECT p.sheet_id, code, value AS old_value FROM prev p JOIN last l ON l.sheet_id = p.previous_id),
diff AS (SELECT sheet_id, code, CASE WHEN old_value IS NULL THEN 'ADDED' WHEN new_value IS NULL THEN 'REMOVED' WHEN old_value::DOUBLE <> new_value::DOUBLE THEN 'CHANGED' END AS kind, old_value, new_value FROM o FULL JOIN n USING (sheet_id, code))"""
)
_SIGNED = "signatures AS (SELECT event_id AS id, event_id % 800 AS sheet_id, 'u' || user_id AS signer, CASE event_type WHEN 'click' THEN 'technician' WHEN 'view' THEN 'supervisor' WHEN 'purchase' THEN 'dispatcher' ELSE 'admin' END AS role, ts AS signed_at FROM events)"


def signatures(t):
    return t.events.selectExpr(
        "event_id AS id", "event_id % 800 AS sheet_id", "concat('u', user_id) AS signer",
        "CASE event_type WHEN 'click' THEN 'technician' WHEN 'view' THEN 'supervisor' WHEN 'purchase' THEN 'dispatcher' ELSE 'admin' END AS role", "ts AS signed_at",
    )


@query(_LAST + ", f AS (SELECT sheet_id, code, value, place FROM parameters) ; SELECT sheet_id, code, value FROM last")
def a5_explode_array(t):
    item = F.struct(F.col("code").alias("parameter_code"), "value")
    lists = t.parameters.groupBy("sheet_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"]).alias("items"))
    return V.explode_parameters(lists.select("sheet_id", F.to_json("items").alias("params")), "params").select("sheet_id", "code", "value")


@query("SELECT user_id AS sheet_id, event_type AS code, floor(arg_max(value, event_id))::INTEGER::VARCHAR AS value FROM events GROUP BY ALL")
def a5_explode_object(t):
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    text = F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", F.floor("v").cast("int").cast("string")))))
    return V.explode_parameters(last.groupBy(F.col("user_id").alias("sheet_id")).agg(text.alias("params")), "params").select("sheet_id", "code", "value")


@query(_DIFF + "; SELECT DISTINCT sheet_id AS id FROM diff WHERE kind IS NOT NULL AND sheet_id IN (SELECT sheet_id FROM parameters)")
def b9_flag_changed_only(t):
    return V.flag_changed(t.sheets, t.parameters).filter("changed").select("id")


@query(_DIFF + "; SELECT sheet_id, count(*) FILTER (WHERE kind = 'ADDED') AS added, count(*) FILTER (WHERE kind = 'REMOVED') AS removed, count(*) FILTER (WHERE kind = 'CHANGED') AS changed, count(*) AS total FROM diff WHERE kind IS NOT NULL GROUP BY 1")
def d8_diff_counts(t):
    return D.diff_counts(V.diff_parameters(t.sheets, t.parameters))


@query("r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY created_at DESC, id DESC) AS k FROM sheets WHERE status = 'COMPLETED'); SELECT id, device_id, created_at FROM r WHERE k = 1")
def e1_latest_per_key(t):
    return V.latest_per_key(t.sheets.filter("status = 'COMPLETED'"), "device_id", "created_at").select("id", "device_id", "created_at")


@query("r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY (status = 'COMPLETED') DESC, created_at DESC, id DESC) AS k FROM sheets); SELECT id, device_id, status FROM r WHERE k = 1")
def e2_active_version(t):
    return V.active_version(t.sheets).select("id", "device_id", "status")


@query(_PREV + "; SELECT sheet_id AS id, previous_id FROM prev")
def e3_previous_version(t):
    return V.previous_version(t.sheets).select("id", "previous_id")


@query(_SIGNED + """; SELECT sheet_id, arg_min(signer, id) FILTER (WHERE role = 'technician') AS technician_signer, count(*) FILTER (WHERE role = 'technician') > 0 AS has_technician,
  arg_min(signer, id) FILTER (WHERE role = 'supervisor') AS supervisor_signer, count(*) FILTER (WHERE role = 'supervisor') > 0 AS has_supervisor, arg_min(signer, id) FILTER (WHERE role = 'dispatcher') AS dispatcher_signer, count(*) FILTER (WHERE role = 'dispatcher') > 0 AS has_dispatcher FROM signatures GROUP BY 1""")
def e4_first_by_role(t):
    return V.first_by_role(signatures(t), ["technician", "supervisor", "dispatcher"])


@query("r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events); SELECT event_id AS id, user_id AS device_id, ts AS checked_at, event_type AS status FROM r WHERE k = 1")
def e5_latest_log(t):
    return V.latest_per_key(t.events.selectExpr("event_id AS id", "user_id AS device_id", "ts AS checked_at", "event_type AS status"), "device_id", "checked_at")


_TAGS = "tok AS (SELECT user_id AS document_id, event_id AS place, 'w' || event_id AS text, CASE event_type WHEN 'click' THEN 'B-KEY' WHEN 'view' THEN 'I-KEY' WHEN 'purchase' THEN 'I-VAL' ELSE 'O' END AS label, round(value) AS confidence FROM events)"


def tagged(t):
    label = F.expr("CASE event_type WHEN 'click' THEN 'B-KEY' WHEN 'view' THEN 'I-KEY' WHEN 'purchase' THEN 'I-VAL' ELSE 'O' END AS label")
    return t.events.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("place"), F.concat(F.lit("w"), "event_id").alias("text"), label, F.round("value").alias("confidence"), *(F.col("value").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(_TAGS + """, k AS (SELECT *, CASE WHEN label <> 'O' THEN substr(label, 3) END AS kind FROM tok), l AS (SELECT *, lag(kind) OVER (PARTITION BY document_id ORDER BY place) AS b FROM k),
i AS (SELECT *, sum((label LIKE 'B-%' OR kind IS DISTINCT FROM b)::INTEGER) OVER (PARTITION BY document_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS island FROM l);
SELECT document_id, any_value(kind) AS entity, min(place) AS first_place, max(place) AS last_place, string_agg(text, ' ' ORDER BY place) AS text, round(avg(confidence), 6) AS confidence FROM i WHERE kind IS NOT NULL GROUP BY document_id, island""")
def e6_merge_spans(t):
    return V.merge_spans(tagged(t)).drop("x1", "y1", "x2", "y2")


@query(_TAGS + ", l AS (SELECT *, lag(CASE WHEN label <> 'O' THEN substr(label, 3) END) OVER (PARTITION BY document_id ORDER BY place) AS b FROM tok); SELECT document_id, place, label FROM l WHERE label LIKE 'I-%' AND substr(label, 3) IS DISTINCT FROM b")
def e7_sequence_violations(t):
    return V.sequence_violations(tagged(t), ["B-KEY", "I-KEY", "I-VAL", "O"])


@query("""
p AS (SELECT conv_id AS source, turn AS i, (turn + 1 + (length(text) % 9 = 0)::INTEGER)::BIGINT AS c FROM conversations WHERE length(text) % 5 <> 0), l AS (SELECT *, lag(i) OVER w AS bi, lag(c) OVER w AS bc FROM p WINDOW w AS (PARTITION BY source ORDER BY i));
SELECT source, i AS page_index, bc AS before_page, c AS current_page FROM l WHERE bi IS NOT NULL AND c - bc <> i - bi""")
def e8_numbering_jumps(t):
    pages = t.conversations.selectExpr("conv_id AS source", "turn AS page_index", "CASE WHEN length(text) % 5 <> 0 THEN turn + 1 + CAST(length(text) % 9 = 0 AS INT) END AS current_page")
    return V.numbering_jumps(pages)


@query("""
s AS (SELECT p_brand AS field, p_partkey AS cid, (p_partkey % 97) + (p_size % 4) * 0.25 AS score, p_partkey % 13 = 0 AS k FROM part), r AS (SELECT *, row_number() OVER w AS n, lead(cid) OVER w AS runner_up, round(score - lead(score) OVER w, 4) AS margin FROM s WINDOW w AS (PARTITION BY field ORDER BY score DESC, cid));
SELECT field, cid AS leader, runner_up, score::DOUBLE AS score, margin::DOUBLE AS margin, CASE WHEN k OR score < 70 OR margin < 15 THEN 'review_required' ELSE 'auto_selected' END AS status,
  CASE WHEN k OR score < 70 OR margin < 15 THEN array_to_string(list_filter([CASE WHEN k THEN 'leading_candidate_has_hard_constraints' END, CASE WHEN score < 70 THEN 'below_auto_select_minimum' END, CASE WHEN margin < 15 THEN 'winner_margin_below_minimum' END], lambda x: x IS NOT NULL), ',') ELSE 'auto_select_conditions_satisfied' END AS reasons FROM r WHERE n = 1""")
def e9_rank_candidates(t):
    scored = t.part.selectExpr("p_brand AS field", "p_partkey AS candidate_id", "CAST(p_partkey % 97 + (p_size % 4) * 0.25D AS DOUBLE) AS score", "p_partkey % 13 = 0 AS constrained")
    return V.rank_candidates(scored)


@query("""
h AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY y1, x1, block_id) AS k FROM blocks), f AS (SELECT document_id, page_number, min(k) FILTER (WHERE contains(lower(text), 'thon')) AS f FROM h GROUP BY ALL);
SELECT document_id, page_number, string_agg(text, chr(10) ORDER BY k) FILTER (WHERE k >= f) AS text FROM h JOIN f USING (document_id, page_number) GROUP BY ALL""")
def e10_text_after_marker(t):
    return V.text_after_marker(t.blocks, "thon")


@query("r AS (SELECT p_partkey, p_type AS tab, CASE WHEN p_partkey % 4 <> 0 AND (p_type LIKE '%O%' OR p_size = 1) THEN left(p_type, 3) || (p_type LIKE '%A%' AND p_size % 2 = 0) END AS unit FROM part), c AS (SELECT tab, CASE WHEN count(DISTINCT unit) = 1 THEN max(unit) END AS u FROM r GROUP BY 1); SELECT p_partkey, coalesce(unit, u) AS unit, unit IS NULL AND u IS NOT NULL AS inherited FROM r JOIN c USING (tab)")
def e11_fill_merged_cells(t):
    records = t.part.selectExpr("p_partkey", "p_type AS table_id", "CASE WHEN p_partkey % 4 <> 0 AND (p_type LIKE '%O%' OR p_size = 1) THEN concat(left(p_type, 3), CAST(p_type LIKE '%A%' AND p_size % 2 = 0 AS STRING)) END AS unit")
    return V.fill_merged_cells(records, "unit").select("p_partkey", "unit", "inherited")


@query(_DIFF + "; SELECT sheet_id, code, kind, old_value, new_value FROM diff WHERE kind IS NOT NULL")
def g1_diff_parameters(t):
    return V.diff_parameters(t.sheets, t.parameters)


@query(_DIFF + "; SELECT id, id IN (SELECT sheet_id FROM parameters) AND id IN (SELECT sheet_id FROM diff WHERE kind IS NOT NULL) AS changed FROM sheets")
def g2_flag_changed(t):
    return V.flag_changed(t.sheets, t.parameters).select("id", "changed")


_ACTIVE = "act AS (SELECT device_id, id FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY (status = 'COMPLETED') DESC, created_at DESC, id DESC) AS k FROM sheets) WHERE k = 1), exp AS (SELECT device_id, code, value AS expected FROM act JOIN last ON last.sheet_id = act.id)"
_READ = "readings AS (SELECT l_suppkey AS device_id, l_linenumber::VARCHAR AS code, ' ' || max(l_quantity)::INTEGER || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE '.0' END AS value FROM lineitem GROUP BY l_suppkey, l_linenumber)"


@query(_LAST + ", " + _ACTIVE + ", " + _READ + """, j AS (SELECT r.device_id, r.code, trim(r.value) AS v, e.expected FROM readings r JOIN (SELECT DISTINCT device_id FROM exp) USING (device_id) LEFT JOIN exp e USING (device_id, code)),
f AS (SELECT *, CASE WHEN expected IS NULL THEN v <> '' ELSE v::DOUBLE <> expected::DOUBLE END AS d FROM j);
SELECT device_id, count(*) AS n_readings, count(*) FILTER (WHERE d) AS n_diff, coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE d), '') AS codes, CASE WHEN count(*) FILTER (WHERE d) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM f GROUP BY 1""")
def g3_compare_readings(t):
    active = V.active_version(t.sheets).select(F.col("id").alias("sheet_id"), "device_id")
    expected = V.last_parameters(t.parameters).join(active, "sheet_id").select("device_id", "code", F.col("value").alias("expected"))
    value = F.concat(F.lit(" "), F.max("l_quantity").cast("int").cast("string"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(".0"))
    readings = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(value.alias("value")).select(F.col("l_suppkey").alias("device_id"), F.col("l_linenumber").cast("string").alias("code"), "value")
    return V.compare_readings(readings, expected)


@query("""
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), m AS (SELECT event_id, user_id FROM n WHERE k = 1 AND event_type <> 'view'),
i AS (SELECT event_id, user_id, unnest(['a', 'b']) AS code, unnest([event_id % 5, event_id % 7])::VARCHAR AS value, unnest([NULL, '3']) AS expected FROM m);
SELECT user_id AS device_id, 'FIX-' || user_id || '-199806150000' AS sheet_code, code, coalesce(expected, value) AS target, CASE WHEN value <> '3' THEN value END AS wrong_value, 'RECEIVED' AS status FROM i""")
def g4_correction_rows(t):
    logs = t.events.selectExpr("event_id AS id", "user_id AS device_id", "ts AS checked_at", "CASE WHEN event_type <> 'view' THEN 'MISMATCH' ELSE 'MATCH' END AS status")
    items = t.events.selectExpr("event_id AS log_id", "inline(array(named_struct('code', 'a', 'value', CAST(event_id % 5 AS STRING), 'expected', CAST(NULL AS STRING)), named_struct('code', 'b', 'value', CAST(event_id % 7 AS STRING), 'expected', '3')))")
    return V.correction_rows(logs, F.expr("timestamp'1998-06-15 00:00:00'"), items.withColumn("is_diff", F.col("value") != "3"))


@query("""
b AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN NULL ELSE 'Supplier#' || lpad((p_partkey % 150)::VARCHAR, 9, '0') END AS c1, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'X' || p_size END AS c2, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS name FROM part),
c AS (SELECT *, coalesce(nullif(c1, ''), nullif(c2, '')) AS code FROM b), l AS (SELECT code, arg_max(coalesce(name, ''), place) AS name FROM c WHERE code IS NOT NULL GROUP BY 1);
SELECT code, CASE WHEN l.name IS NOT NULL THEN l.name ELSE t.s_nationkey::VARCHAR END AS name, t.s_acctbal AS balance FROM (SELECT *, s_name AS code FROM supplier) t FULL JOIN l USING (code)""")
def g5_upsert_by_code(t):
    target = t.supplier.selectExpr("s_name AS code", "CAST(s_nationkey AS STRING) AS name", "s_acctbal AS balance")
    batch = t.part.selectExpr("p_partkey AS place", "CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 17 <> 0 THEN concat('Supplier#', lpad(CAST(p_partkey % 150 AS STRING), 9, '0')) END AS c1", "CASE WHEN p_partkey % 9 <> 0 THEN concat('X', p_size) END AS c2", "CASE WHEN p_size % 4 <> 0 THEN p_name END AS title")
    return V.upsert_by_code(target, batch, ["c1", "c2"], {"name": "title"}, "place")


@query(_SIGNED + """, d AS (SELECT sheet_id, min(signed_at) AS s FROM signatures WHERE role = 'dispatcher' GROUP BY 1);
SELECT id AS sheet_id, created_at AS at, 'created' AS kind, created_by::VARCHAR AS who FROM sheets UNION ALL SELECT sheet_id, signed_at, 'signed:' || role, signer FROM signatures
UNION ALL SELECT id, coalesce(s, created_at), 'assigned', assigned_to::VARCHAR FROM sheets LEFT JOIN d ON d.sheet_id = id
UNION ALL SELECT l_orderkey, l_shipdate, 'edited', l_suppkey::VARCHAR FROM lineitem WHERE l_partkey % 5 <> 0""")
def g6_timeline(t):
    edits = t.lineitem.selectExpr("l_orderkey AS sheet_id", "CASE WHEN l_partkey % 5 = 0 THEN 'soon' ELSE CAST(l_shipdate AS STRING) END AS time", "l_suppkey AS user")
    return V.timeline(t.sheets, signatures(t), edits).drop("branch")


@query("""
p AS (SELECT event_id % 2000 AS sheet_id, event_id AS place, event_type AS code, round(value)::INTEGER || '.0' AS value, CASE WHEN event_id % 10 = 0 THEN 'first' END AS original, event_id % 6 AS k, round(value)::INTEGER AS v FROM events),
e AS (SELECT *, CASE k WHEN 0 THEN v::VARCHAR WHEN 1 THEN ' ' WHEN 2 THEN (v + 1)::VARCHAR WHEN 3 THEN 'off' END AS g FROM p), t AS (SELECT *, k IN (2, 3) AS took FROM e);
SELECT sheet_id, place, code, CASE WHEN took THEN g ELSE value END AS value, CASE WHEN took THEN coalesce(original, value) ELSE original END AS original, CASE WHEN took THEN code || ': ' || value || ' -> ' || g END AS change FROM t""")
def g7_apply_edits(t):
    v = "CAST(round(value) AS INT)"
    params = t.events.selectExpr("event_id % 2000 AS sheet_id", "event_id AS place", "event_type AS code", f"concat({v}, '.0') AS value", "CASE WHEN event_id % 10 = 0 THEN 'first' END AS original")
    edits = t.events.selectExpr("event_id % 2000 AS sheet_id", "event_id AS place", f"CASE event_id % 6 WHEN 0 THEN CAST({v} AS STRING) WHEN 1 THEN ' ' WHEN 2 THEN CAST({v} + 1 AS STRING) WHEN 3 THEN 'off' END AS new")
    return V.apply_edits(params, edits)


@query("c AS (SELECT 'c' || p_partkey AS case_id, p_brand AS family, unnest(range(1, 1 + greatest(1, p_size % 4))) AS attempt FROM part); SELECT 'run-' || case_id || '-' || lpad(attempt::VARCHAR, 2, '0') AS execution_id, case_id, attempt::INTEGER AS attempt, family FROM c UNION ALL SELECT 'run-forced-failure-01', 'forced-failure', 1, NULL")
def g8_plan_runs(t):
    return V.plan_runs(t.part.selectExpr("concat('c', p_partkey) AS case_id", "p_brand AS family", "p_size % 4 AS repeat"), "run")


_JOBS = "jobs AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PROCESSING' ELSE 'SUCCESS' END AS status, CASE WHEN event_type = 'error' THEN 'E' || user_id END AS error_code, 'ISSUED' AS sheet_status FROM events)"


def _jobs(t):
    return t.events.selectExpr("event_id AS id", "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PROCESSING' ELSE 'SUCCESS' END AS status", "CASE WHEN event_type = 'error' THEN concat('E', user_id) END AS error_code", "'ISSUED' AS sheet_status")


@query(_JOBS + "; SELECT id, CASE WHEN status = 'FAILED' THEN 'PENDING' ELSE status END AS status, CASE WHEN status <> 'FAILED' THEN error_code END AS error_code, CASE WHEN status = 'FAILED' THEN 'DRAFT' ELSE sheet_status END AS sheet_status FROM jobs")
def g9_retry_jobs(t):
    return V.reset_jobs(_jobs(t), "retry")


@query(_JOBS + "; SELECT id, CASE WHEN status = 'PROCESSING' THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'PROCESSING' THEN 'WORKER_RESTARTED' ELSE error_code END AS error_code, sheet_status FROM jobs")
def g9_restart_jobs(t):
    return V.reset_jobs(_jobs(t), "restart")


@query("""
s AS (SELECT p_partkey AS id, 'K' || p_partkey % 1200 AS code FROM part), j AS (SELECT p_partkey AS sheet_id, CASE WHEN p_size % 5 = 0 OR p_partkey % 2 = 1 THEN '' ELSE 'K' || p_partkey % 1500 END AS f FROM part);
SELECT id, CASE WHEN f <> '' AND NOT EXISTS (SELECT 1 FROM s o WHERE o.code = f AND o.id <> s.id) THEN f ELSE code END AS code, EXISTS (SELECT 1 FROM s o WHERE o.code = f AND o.id <> s.id) AS duplicate FROM s JOIN j ON sheet_id = id""")
def g10_enrich_from_header(t):
    sheets = t.part.selectExpr("p_partkey AS id", "concat('K', p_partkey % 1200) AS code")
    return V.enrich_from_header(t.part.selectExpr("p_partkey AS sheet_id", "CASE WHEN p_size % 5 = 0 OR p_partkey % 2 = 1 THEN '' ELSE concat('K', p_partkey % 1500) END AS found_code"), sheets)


@query("SELECT o_orderkey AS job_id, o_orderpriority AS station, o_orderkey % 9 AS records, o_orderstatus AS status_told, 'h' || o_custkey AS origin, '1,3,' || (3 + o_orderkey % 4) AS pages FROM orders")
def g11_merge_stage_results(t):
    header = t.orders.selectExpr("o_orderkey AS job_id", "map('station', o_orderpriority) AS fields", "map('status', 'header', 'origin', concat('h', o_custkey)) AS summary", "array(1) AS pages")
    details = t.orders.selectExpr("o_orderkey AS job_id", "o_orderkey % 9 AS records", "map('status', o_orderstatus) AS summary", "array(3, CAST(3 + o_orderkey % 4 AS INT)) AS pages")
    out = V.merge_stage_results(header, details)
    return out.selectExpr("job_id", "fields['station'] AS station", "records", "summary['status'] AS status_told", "summary['origin'] AS origin", "array_join(CAST(pages AS ARRAY<STRING>), ',') AS pages")


