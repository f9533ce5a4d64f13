"""Queries of the column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import query

_NUM = r"'^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


@query(f"""
v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity::VARCHAR AS a,
  CASE l_linenumber % 4 WHEN 0 THEN l_quantity::VARCHAR || ' A' WHEN 1 THEN l_quantity::INTEGER::VARCHAR WHEN 2 THEN ' ' || (l_quantity + l_partkey % 2)::VARCHAR ELSE NULL END AS b FROM lineitem);
SELECT *, CASE WHEN regexp_matches(trim(a), {_NUM}) AND coalesce(regexp_matches(trim(b), {_NUM}), false) THEN try_cast(trim(a) AS DOUBLE) <> try_cast(trim(b) AS DOUBLE) ELSE a IS DISTINCT FROM b END AS differs FROM v""")
def h1_differs(t):
    other = F.expr("CASE l_linenumber % 4 WHEN 0 THEN concat(CAST(l_quantity AS STRING), ' A') WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN 2 THEN concat(' ', CAST(l_quantity + l_partkey % 2 AS STRING)) END")
    out = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_quantity").cast("string").alias("a"), other.alias("b"))
    return out.withColumn("differs", S.differs(F.col("a"), F.col("b")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(CASE WHEN p_retailprice = 0 THEN 0.0 ELSE abs(l_extendedprice / l_quantity - p_retailprice) / abs(p_retailprice) * 100 END, 6) AS deviation,
  l_extendedprice / l_quantity >= p_retailprice * 0.95 AND l_extendedprice / l_quantity <= p_retailprice * 1.05 AS within FROM lineitem JOIN part ON l_partkey = p_partkey""")
def h2_tolerance(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    measured, standard = F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.round(S.deviation_percent(measured, standard), 6).alias("deviation"), S.within_tolerance(measured, standard * 0.95, standard * 1.05).alias("within")
    )


@query("""
v AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS ts, (o_orderkey % 37 + 1)::INTEGER AS n, substr('smhdMyex', (o_custkey % 8)::INTEGER + 1, 1) AS unit FROM orders);
SELECT o_orderkey, ts, n, unit, CASE unit WHEN 'e' THEN NULL WHEN 's' THEN ts + INTERVAL 1 SECOND * n WHEN 'm' THEN ts + INTERVAL 1 MINUTE * n WHEN 'h' THEN ts + INTERVAL 1 HOUR * n
  WHEN 'd' THEN ts + INTERVAL 1 DAY * n WHEN 'M' THEN ts + INTERVAL 1 MONTH * n WHEN 'y' THEN ts + INTERVAL 1 YEAR * n ELSE ts + INTERVAL 1 HOUR END AS next_at FROM v""")
def h3_next_occurrence(t):
    out = t.orders.selectExpr("o_orderkey", "CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, o_orderkey % 86400) AS ts", "CAST(o_orderkey % 37 + 1 AS INT) AS n", "substr('smhdMyex', CAST(o_custkey % 8 AS INT) + 1, 1) AS unit")
    return out.withColumn("next_at", S.next_occurrence(F.col("ts"), F.col("n"), F.col("unit")))


@query("""
v AS (SELECT p_partkey, (CASE p_size % 5 WHEN 0 THEN 525600 WHEN 1 THEN 43200 WHEN 2 THEN 1440 WHEN 3 THEN 60 ELSE 7 END * (p_partkey % 12 + 1))::BIGINT AS m FROM part);
SELECT p_partkey, m AS minutes, CASE WHEN m % 525600 = 0 THEN (m // 525600) || ' year' WHEN m % 43200 = 0 THEN (m // 43200) || ' month' WHEN m % 1440 = 0 THEN (m // 1440) || ' day' WHEN m % 60 = 0 THEN (m // 60) || ' hour' ELSE m || ' minute' END AS label FROM v""")
def h4_interval_label(t):
    out = t.part.selectExpr("p_partkey", "CAST(CASE p_size % 5 WHEN 0 THEN 525600 WHEN 1 THEN 43200 WHEN 2 THEN 1440 WHEN 3 THEN 60 ELSE 7 END * (p_partkey % 12 + 1) AS BIGINT) AS minutes")
    return out.withColumn("label", S.interval_label(F.col("minutes")))


@query("SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g')) AS folded FROM documents")
def h5_fold_text(t):
    return t.documents.select("doc_id", S.fold_text(F.col("text")).alias("folded"))


@query("""
SELECT document_id, block_id, CASE WHEN regexp_matches(text, '[:：]') THEN trim(regexp_extract(text, '^([^:：]*)[:：](.*)$', 1)) ELSE trim(text) END AS label,
  CASE WHEN regexp_matches(text, '[:：]') THEN trim(regexp_extract(text, '^([^:：]*)[:：](.*)$', 2)) END AS value, regexp_matches(text, '[:：]') AS found FROM blocks""")
def h6_split_label_value(t):
    return t.blocks.select("document_id", "block_id", S.split_label_value(F.col("text")).alias("s")).select("document_id", "block_id", "s.*")


@query("""
v AS (SELECT document_id, page_number, block_id, x1, x2, lead(x1) OVER w AS b1, lead(x2) OVER w AS b2 FROM blocks WINDOW w AS (PARTITION BY document_id, page_number ORDER BY block_id));
SELECT document_id, page_number, block_id, round(greatest(0.0, least(x2, b2) - greatest(x1, b1)) / greatest(1.0, least(x2 - x1, b2 - b1)), 6) AS overlap FROM v WHERE b1 IS NOT NULL""")
def h7_overlap(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("document_id", "page_number").orderBy("block_id")
    out = t.blocks.withColumns({"b1": F.lead("x1").over(w), "b2": F.lead("x2").over(w)}).filter("b1 is not null")
    return out.select("document_id", "page_number", "block_id", F.round(S.overlap_1d(F.col("x1"), F.col("x2"), F.col("b1"), F.col("b2")), 6).alias("overlap"))


@query("""
SELECT document_id, block_id, least(x1, x2 - 3, x1 + 5) AS bx1, least(y1, y2 - 2) AS by1, greatest(x1, x2 - 3, x1 + 5) AS bx2, greatest(y1, y2 - 2) AS by2,
  round_even(greatest(0.0, least(1.0, x1 / 900.0)) * 1000, 0)::INTEGER AS nx1, round_even(greatest(0.0, least(1.0, x2 / 900.0)) * 1000, 0)::INTEGER AS nx2 FROM blocks""")
def h8_bbox(t):
    point = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    box = S.polygon_bbox(F.array(point("x1", "y1"), point("x2 - 3", "y2 - 2"), point("x1 + 5", "y1")))
    n = lambda c: S.unit_coordinate(F.col(c), F.lit(900.0), 1000)
    out = t.blocks.select("document_id", "block_id", box.alias("b"), n("x1").alias("nx1"), n("x2").alias("nx2"))
    return out.select("document_id", "block_id", *(F.col(f"b.{c}").alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")), "nx1", "nx2")


@query("SELECT conv_id, turn, CASE turn + 1 WHEN 1 THEN 'cover' WHEN 2 THEN 'skipped' ELSE 'detail' END AS page_role FROM conversations")
def h9_page_role(t):
    return t.conversations.select("conv_id", "turn", S.page_role(F.col("turn") + 1).alias("page_role"))


@query("SELECT event_id, CASE WHEN v >= 80 THEN 'VERY_HIGH' WHEN v >= 60 THEN 'HIGH' WHEN v >= 40 THEN 'MEDIUM' WHEN v >= 20 THEN 'LOW' ELSE 'VERY_LOW' END AS level FROM (SELECT event_id, value % 101 AS v FROM events)")
def h10_confidence_level(t):
    return t.events.select("event_id", S.confidence_level(F.col("value") % 101).alias("level"))


_RULE_TABLE = [
    ("unit_suffix", ["A", "kV"], None, None, None, True), ("endswith", ["đóng", "ring"], None, None, None, False), ("startswith", ["small", "MC"], None, None, None, False), ("regex", None, "[a-z]+ w[a-z]+", None, None, True),
    ("enum", ["Đóng", "red widget", "120"], None, None, None, False), ("numeric", None, None, None, None, True), ("numeric_range", None, None, 100.0, 1500.0, True), ("version", None, None, None, None, False),
    ("ticket_number", None, None, None, None, False), ("year", None, None, None, None, False), ("page_reference", None, None, None, None, True),
]


@query("""
k AS (SELECT unnest(['unit_suffix','endswith','startswith','regex','enum','numeric','numeric_range','version','ticket_number','year','page_reference']) AS kind),
v AS (SELECT p_partkey, trim(CASE p_partkey % 8 WHEN 0 THEN p_partkey || ' A' WHEN 1 THEN p_name WHEN 2 THEN replace(p_retailprice::VARCHAR, '.', ',') WHEN 3 THEN 'V' || p_size || '.7.' || p_partkey % 10 WHEN 4 THEN 'A1-29-20' || (10 + p_partkey % 80) || '/E5.8/220' WHEN 5 THEN (1890 + p_partkey % 200)::VARCHAR WHEN 6 THEN (p_partkey % 9) || ' / ' || (p_size % 9) ELSE '' END) AS t FROM part),
n AS (SELECT *, CASE WHEN regexp_matches(replace(t, ',', '.'), '^[+-]?[0-9]+([.][0-9]+)?$') THEN replace(t, ',', '.')::DOUBLE END AS x, replace(t, ' ', '') AS tight, trim(regexp_replace(strip_accents(lower(t)), '[^a-z0-9]+', ' ', 'g')) AS f FROM v CROSS JOIN k),
p AS (SELECT *, coalesce(CASE kind
  WHEN 'unit_suffix' THEN (lower(tight) LIKE '%a' AND length(tight) > 1) OR (lower(tight) LIKE '%kv' AND length(tight) > 2) WHEN 'endswith' THEN f LIKE '%dong' OR f LIKE '%ring' WHEN 'startswith' THEN f LIKE 'small%' OR f LIKE 'mc%'
  WHEN 'regex' THEN regexp_matches(lower(t), '^[a-z]+ w[a-z]+$') WHEN 'enum' THEN f IN ('dong', 'red widget', '120') WHEN 'numeric' THEN x IS NOT NULL WHEN 'numeric_range' THEN x >= 100 AND x <= 1500
  WHEN 'version' THEN regexp_matches(t, '^[vV]?[0-9]+([.][0-9]+){1,4}[A-Za-z]?$') WHEN 'ticket_number' THEN regexp_matches(t, '^[A-Za-z][0-9]+-[0-9]+-[0-9]{4}/[A-Za-z][0-9]+([.][0-9]+)?/[0-9]+$') WHEN 'year' THEN regexp_matches(t, '^(19|20)[0-9]{2}$')
  ELSE try_cast(regexp_extract(t, '^([0-9]{1,4}) */ *([0-9]{1,4})$', 1) AS INTEGER) >= 1 AND try_cast(regexp_extract(t, '^([0-9]{1,4}) */ *([0-9]{1,4})$', 2) AS INTEGER) >= try_cast(regexp_extract(t, '^([0-9]{1,4}) */ *([0-9]{1,4})$', 1) AS INTEGER) END, false) AS ok FROM n);
SELECT p_partkey, kind, CASE WHEN t = '' THEN CASE WHEN kind IN ('unit_suffix','regex','numeric','numeric_range','page_reference') THEN 'failed' ELSE 'not_evaluated' END WHEN ok THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN t = '' THEN CASE WHEN kind IN ('unit_suffix','regex','numeric','numeric_range','page_reference') THEN 'required_value_missing' ELSE 'optional_value_missing' END WHEN ok THEN CASE WHEN kind = 'regex' THEN 'regex_fullmatch' ELSE kind || '_matched' END ELSE kind || '_mismatch' END AS reason FROM p""")
def h11_check_value(t):
    rules = t.spark.createDataFrame(_RULE_TABLE, "kind string, options array<string>, pattern string, low double, high double, required boolean")
    value = F.expr("CASE p_partkey % 8 WHEN 0 THEN concat(p_partkey, ' A') WHEN 1 THEN p_name WHEN 2 THEN replace(CAST(p_retailprice AS STRING), '.', ',') WHEN 3 THEN concat('V', p_size, '.7.', p_partkey % 10) WHEN 4 THEN concat('A1-29-20', 10 + p_partkey % 80, '/E5.8/220') WHEN 5 THEN CAST(1890 + p_partkey % 200 AS STRING) WHEN 6 THEN concat(p_partkey % 9, ' / ', p_size % 9) ELSE '' END")
    pairs = t.part.select("p_partkey", value.alias("value")).join(F.broadcast(rules))
    checked = pairs.withColumn("c", S.check_value(*(F.col(c) for c in ("value", "kind", "options", "pattern", "low", "high", "required"))))
    return checked.select("p_partkey", "kind", "c.status", "c.reason")


@query("""
v AS (SELECT p_partkey, regexp_replace(regexp_replace(upper(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_size || ' ' || p_brand ELSE '#' END), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS t FROM part);
SELECT p_partkey, CASE WHEN regexp_matches(t, '^[A-Z]') THEN t ELSE 'OCR_' || CASE WHEN t = '' THEN 'WARNING' ELSE t END END AS status_name FROM v""")
def h12_status_name(t):
    return t.part.select("p_partkey", S.status_name(F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_size, ' ', p_brand) ELSE '#' END")).alias("status_name"))


@query("SELECT event_id, sha256(event_id || '|' || user_id || '|' || event_type) AS signature FROM events")
def h13_signature_hash(t):
    return t.events.select("event_id", S.signature_hash("event_id", "user_id", "event_type").alias("signature"))


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS fingerprint FROM nation""")
def h14_stable_fingerprint(t):
    return t.nation.select("n_nationkey", S.stable_fingerprint("n_regionkey", "n_name").alias("fingerprint"))


@query("""
v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE l_linenumber % 3 WHEN 0 THEN (l_partkey % 1000) || '.' || l_suppkey % 100 || 'A' WHEN 1 THEN (l_partkey % 9000 + 7)::VARCHAR ELSE 'Công ty ' || l_partkey END AS text FROM lineitem);
SELECT *, regexp_matches(replace(text, ' ', ''), '^([A-Za-z]{0,4}[0-9]{1,4}|[0-9]{2,4})([.][0-9A-Za-z]{1,4})+[A-Za-z]?$') OR regexp_matches(replace(text, ' ', ''), '^[0-9]{3,4}[A-Za-z]?$') AS is_code, regexp_matches(text, '(?i)công ty|trung tâm điều độ|số phiếu|phiếu chỉnh định') AS is_metadata FROM v""")
def h15_code_shape(t):
    text = F.expr("CASE l_linenumber % 3 WHEN 0 THEN concat(l_partkey % 1000, '.', l_suppkey % 100, 'A') WHEN 1 THEN CAST(l_partkey % 9000 + 7 AS STRING) ELSE concat('Công ty ', l_partkey) END").alias("text")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", text).withColumns({"is_code": S.is_code(F.col("text")), "is_metadata": S.is_metadata(F.col("text"))})


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 50 THEN 'manual_review_required' ELSE 'ready_for_use' END AS outcome,
  CASE WHEN event_id % 5 = 0 THEN 'not_available' WHEN event_id % 7 = 0 THEN 'preserved_existing' WHEN event_type = 'click' THEN 'auto_selected' ELSE 'review_required' END AS field_status FROM events""")
def h16_review_outcome(t):
    status = F.when(F.col("event_type") == "error", "failed").otherwise("done")
    review = F.when(F.col("value") > 50, "review_required").otherwise("none")
    value = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    told = F.when(F.col("event_type") == "click", "auto_selected").otherwise(F.col("event_type"))
    return t.events.select("event_id", S.review_outcome(status, review).alias("outcome"), S.field_status(value, told, F.col("event_id") % 7 == 0).alias("field_status"))


@query("""
v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'scan_Page-00' || doc_id % 40 || '_x' WHEN 1 THEN 'file_p0' || doc_id % 9 || '-b' WHEN 2 THEN source ELSE 'page7' END AS name, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 11)::INTEGER END AS payload FROM documents),
w AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(name, '(?i)page[-_]?0*([0-9]+)', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(name, '(?i)_p0*([0-9]+)(?:$|[_-])', 1), '') AS INTEGER)) AS n FROM v);
SELECT doc_id, coalesce(payload, n, 1) AS page, CASE WHEN payload IS NOT NULL THEN 'payload' WHEN n IS NOT NULL THEN 'filename' ELSE 'default' END AS origin, coalesce(payload, n, 1) >= 3 AS eligible FROM w""")
def h17_page_number(t):
    v = t.documents.selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN concat('scan_Page-00', doc_id % 40, '_x') WHEN 1 THEN concat('file_p0', doc_id % 9, '-b') WHEN 2 THEN source ELSE 'page7' END AS name", "CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 11 AS INT) END AS payload")
    return v.select("doc_id", S.page_number_of(F.col("name"), F.col("payload")).alias("p")).select("doc_id", "p.*")
