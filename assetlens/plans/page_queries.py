"""Queries of page, layout and streaming jobs (batch twins) over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import pages as P
from ..operators.resolution import resolve_fields
from ..streaming import jobs as J
from .registry import query
from .version_queries import signatures


def _nearest_int(x: str) -> str:
    return f"round_even(greatest(0.0, least(1.0, ({x}) / 900.0)) * 1000, 0)::INTEGER"


@query(f"""
g AS (SELECT *, regexp_extract_all(text, '\\S+') AS ws, regexp_split_to_array(text, '\\S+') AS gs FROM blocks), w AS (SELECT *, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM g),
p AS (SELECT *, (list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:k - 1], lambda x: length(x))), 0))::DOUBLE AS lo FROM w);
SELECT document_id, page_number, block_id, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY block_id, k) - 1)::INTEGER AS word_index, word AS text,
 {_nearest_int("x1 + (x2 - x1) * lo / greatest(1, length(text))")} AS nx1, {_nearest_int("y1")} AS ny1, {_nearest_int("x1 + (x2 - x1) * (lo + length(word)) / greatest(1, length(text))")} AS nx2, {_nearest_int("y2")} AS ny2 FROM p WHERE block_id % 7 = 0""".replace(" FROM p WHERE block_id % 7 = 0", " FROM p"))
def i1_words_from_blocks(t):
    return P.words_from_blocks(t.blocks, 900.0, 900.0)


@query("""
t AS (SELECT document_id, page_number, block_id, x1 + CASE WHEN block_id % 5 IN (0, 1, 2) THEN 500 ELSE 0 END AS x1, y1, x2 + CASE WHEN block_id % 5 IN (0, 1, 2) THEN 500 ELSE 0 END AS x2, y2, block_id % 40 = 0 AND document_id % 3 <> 0 AS tk,
  block_id % 5 = 1 AND document_id % 4 <> 2 AS ref, block_id % 5 = 2 AS lone, block_id % 3 + 1 AS a, block_id % 4 + 1 AS b, block_id % 2 = 0 AS lab FROM blocks),
pg AS (SELECT *, max(x2) OVER p AS w, max(y2) OVER p AS h FROM t WINDOW p AS (PARTITION BY document_id, page_number)),
hd AS (SELECT * FROM pg WHERE y1 <= CASE WHEN h <= 0.5 * w THEN h ELSE 0.22 * h END),
tk AS (SELECT document_id, page_number, x1 AS tx, y1 AS ty1, y2 AS ty2 FROM hd WHERE tk),
c AS (SELECT hd.*, tx IS NOT NULL AS has, coalesce(y1 >= ty1 AND y1 - ty2 <= greatest(40.0, 0.08 * h) AND abs(x1 - tx) <= 0.18 * w, false) AS near FROM hd LEFT JOIN tk USING (document_id, page_number) WHERE NOT hd.tk AND (x1 + x2) / 2 >= 0.52 * w),
m AS (SELECT *, true AS full_ref, CASE WHEN lab THEN 'Page' END AS label, a AS cur, b AS tot, CASE WHEN lab THEN 0.3 ELSE 0 END + CASE WHEN near THEN 0.2 ELSE 0 END + (x1 + x2) / greatest(1.0, 2 * w) + 0.5 * (1 - y1 / greatest(1.0, h)) AS sc FROM c WHERE ref AND a <= b AND (near OR NOT has)
  UNION ALL SELECT *, false, NULL, block_id % 900 + 1, NULL, 0.2 FROM c WHERE lone AND near),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY full_ref DESC, round(sc, 6) DESC, block_id) AS k FROM m);
SELECT document_id, page_number, cur::INTEGER AS current_page, tot::INTEGER AS total_pages, label, round(sc, 4)::DOUBLE AS score FROM r WHERE k = 1""")
def i2_page_reference(t):
    reference = F.concat(F.when(F.col("block_id") % 2 == 0, "Page: ").otherwise(""), F.col("block_id") % 3 + 1, F.lit(" / "), F.col("block_id") % 4 + 1, F.lit(" x"))
    text = F.when((F.col("block_id") % 40 == 0) & (F.col("document_id") % 3 != 0), "A1-29-2026/E5.8/220").when((F.col("block_id") % 5 == 1) & (F.col("document_id") % 4 != 2), reference).when(F.col("block_id") % 5 == 2, (F.col("block_id") % 900 + 1).cast("string"))
    shift = F.when(F.col("block_id") % 5 < 3, 500.0).otherwise(0.0)
    return P.detect_page_reference(t.blocks.withColumns({"text": text.otherwise("-"), "x1": F.col("x1") + shift, "x2": F.col("x2") + shift}))


_PHRASES = [("the thon", 0.2), ("of the", 0.18), ("and", 0.18), ("de la", 0.3), ("license", 0.1), ("is", 0.5)]


@query("""
g AS (SELECT document_id, page_number, trim(regexp_replace(replace(strip_accents(lower(string_agg(text, ' ' ORDER BY block_id))), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g')) AS f, count(*) AS n, arg_min(list_min(regexp_extract_all(text, '[0-9]{4,}')), y1) FILTER (WHERE regexp_matches(text, '[0-9]{4,}')) AS tk FROM blocks GROUP BY ALL);
SELECT document_id, page_number, round(least(1.0, contains(f, 'the thon')::INTEGER * 0.2 + contains(f, 'of the')::INTEGER * 0.18 + contains(f, 'and')::INTEGER * 0.18 + contains(f, 'de la')::INTEGER * 0.3 + contains(f, 'license')::INTEGER * 0.1 + contains(f, 'is')::INTEGER * 0.5), 4)::DOUBLE AS cover_score, tk AS ticket_number, n AS n_blocks,
  concat_ws(',', CASE WHEN r.document_id IS NULL THEN 'pagination_not_detected' WHEN r.total IS NULL THEN 'pagination_total_missing' END, CASE WHEN least(1.0, contains(f, 'the thon')::INTEGER * 0.2 + contains(f, 'of the')::INTEGER * 0.18 + contains(f, 'and')::INTEGER * 0.18 + contains(f, 'de la')::INTEGER * 0.3 + contains(f, 'license')::INTEGER * 0.1 + contains(f, 'is')::INTEGER * 0.5) < 0.2 THEN 'no_cover_signature' END) AS warnings
FROM g LEFT JOIN (SELECT document_id, page_number, CASE WHEN document_id % 2 = 0 THEN 9 END AS total FROM blocks WHERE block_id % 40 = 5) r USING (document_id, page_number)""")
def i3_page_evidence(t):
    references = t.blocks.filter("block_id % 40 = 5").selectExpr("document_id", "page_number", "page_number AS current_page", "CASE WHEN document_id % 2 = 0 THEN 9 END AS total_pages")
    return P.page_evidence(t.blocks, _PHRASES, r"\d{4,}", references)


@query()
def i4_segment_pages(t):
    cover = F.when(F.col("role") == "system", 0.6).when(F.length("text") % 7 == 0, 0.3).otherwise(0.0)
    pages = t.conversations.select(
        F.col("conv_id").alias("source"), (F.col("turn") + 1).alias("page_index"), F.when(F.length("text") % 5 != 0, F.col("turn") % 4 + 1).alias("current_page"), F.when(F.length("text") % 5 != 0, F.lit(4).cast("long")).alias("total_pages"),
        F.when(F.length("text") % 3 == 0, F.concat(F.lit("T"), F.col("turn") % 2)).alias("ticket_number"), cover.alias("cover_score"),
    )
    return L.segment_pages(pages)


@query()
def i5_build_rows(t):
    return L.build_rows(t.blocks)


@query()
def i5_overlap_rows(t):
    return L.build_rows(t.blocks, "overlap")


@query()
def i6_infer_columns(t):
    return L.infer_columns(t.blocks)


@query()
def i7_column_roles(t):
    return L.infer_roles(t.blocks)


def _three_columns(t):
    """The blocks dealt to three columns, so that rows have several cells; every fourth first cell is a code."""
    left, top = F.expr("260D * (block_id % 3)"), F.expr("20D * (block_id div 3)")
    code = F.when(F.col("block_id") % 12 == 0, F.format_string("%04d", "block_id")).otherwise(F.substring("text", 1, 30))
    return t.blocks.withColumns({"text": code, "x1": left, "y1": top, "x2": left + F.least(F.length("text"), F.lit(30)) * 7, "y2": top + 12})


@query()
def i8_reconstruct_page(t):
    return L.records(L.reconstruct_page(_three_columns(t)))


def _grids(t):
    """A grid on every second page: four columns, and a line every 40 units below the first 100."""
    pages = t.blocks.filter("page_number % 2 = 1").select("document_id", "page_number").distinct()
    return pages.selectExpr("*", "1 AS region", "array(0D, 120D, 320D, 560D, 900D) AS across", "transform(sequence(100, 700, 40), y -> CAST(y AS DOUBLE)) AS down")


@query()
def i8_gridded_pages(t):
    return L.reconstruct_page(P.mark_page_numbers(t.blocks), _grids(t)).drop("crossing").withColumn("cells", F.to_json("cells"))


@query()
def i8_document_layouts(t):
    return L.document_layouts(L.page_layouts(t.blocks, _grids(t))).withColumn("families", F.to_json("families"))


@query()
def i9_code_records(t):
    coded = F.when(F.col("block_id") % 3 == 0, F.concat(F.col("block_id") + 100, F.lit(".1 "), F.col("text"))).otherwise(F.col("text"))
    return L.group_code_records(t.blocks.withColumn("text", coded))


#: Capitals letter by letter, as SQL has them: ``upper`` makes two letters of some (ß), which lengthens a text.
_CAPITALS = "array_join(transform(split(replace(text, 'ß', 'ẞ'), ''), c -> CASE WHEN length(upper(c)) = 1 THEN upper(c) ELSE c END), '')"


@query("""
b AS (SELECT *, block_id // 2 AS row_id, trim(CASE block_id % 6 WHEN 0 THEN (block_id + 10) || '.25 x' WHEN 1 THEN text || ':' WHEN 2 THEN upper(text) ELSE text END) AS tx FROM blocks),
s AS (SELECT *, median(y2 - y1) OVER (PARTITION BY document_id, page_number) AS m, row_number() OVER (PARTITION BY document_id, page_number, row_id ORDER BY x1, block_id) AS k, length(regexp_replace(tx, '\\P{L}', '', 'g')) AS n, length(regexp_replace(tx, '\\P{Lu}', '', 'g')) AS u FROM b),
r AS (SELECT *, CASE WHEN regexp_matches(tx, '^([A-Za-z]{1,4}[- ]?)?[0-9]{2,4}[.][0-9]{2,4}([.][0-9]{1,4})?(\\b|\\s|$)') THEN 'parameter_code' WHEN tx LIKE '%:' AND length(tx) <= 100 THEN 'parameter_name'
  WHEN abs((x1 + x2) / 2 / 900.0 - 0.5) <= 0.18 AND length(tx) <= 120 AND y2 - y1 >= 1.08 * m AND n > 0 AND u / n >= 0.55 THEN 'section_heading' WHEN k > 1 AND (regexp_matches(tx, '(?i)[0-9]|[<>=±%Ω]|(^|[^\\p{L}\\p{N}_])(ms|s|A|V|kV|Hz|Ohm)($|[^\\p{L}\\p{N}_])') OR x1 / 900.0 >= 0.32) THEN 'parameter_value' WHEN k > 1 THEN 'parameter_name2' ELSE 'unassigned' END AS role FROM s);
SELECT document_id, page_number, block_id, rtrim(role, '2') AS role, CASE role WHEN 'parameter_code' THEN 0.92 WHEN 'parameter_name' THEN 0.78 WHEN 'section_heading' THEN 0.72 WHEN 'parameter_value' THEN 0.58 WHEN 'parameter_name2' THEN 0.42 ELSE 0 END::DOUBLE AS role_confidence FROM r""")
def i10_semantic_roles(t):
    text = F.expr(f"CASE block_id % 6 WHEN 0 THEN concat(block_id + 10, '.25 x') WHEN 1 THEN concat(text, ':') WHEN 2 THEN {_CAPITALS} ELSE text END")
    return P.semantic_roles(t.blocks.withColumns({"row_id": F.expr("block_id DIV 2"), "text": text}), 900.0)


@query()
def i11_heuristic_records(t):
    return L.heuristic_records(t.blocks)


@query()
def i12_embedded_labels(t):
    text = F.regexp_replace("text", r"\b(the|of|la|der)\b", "$1:")
    return L.split_embedded_labels(t.blocks.withColumn("text", text), ["the", "of", "la", "der"])


@query()
def i13_cover_fields(t):
    slots = {(k, side): f"{side}_{k}" for k in range(7) for side in ("left", "right")}
    return L.cover_fields(t.blocks, slots)


@query()
def i13_ruled_cover_fields(t):
    slots = {(k, side): f"{side}_{k}" for k in range(7) for side in L.LABEL_SHARE}
    return L.cover_fields(t.blocks, slots, grids=_grids(t))


@query()
def i14_fields_and_versions(t):
    labels = {"device": ["the", "die", "la"], "program": ["of", "der", "de"], "device_version": ["and", "und", "et"], "program_version": ["and", "und", "et"]}
    blocks = t.blocks.withColumn("text", F.regexp_replace("text", r"\b(the|of|and|die|der|und|la|de|et)\b", "$1:"))
    return L.labelled_fields(blocks, labels, ("program",), {"device_version": "device", "program_version": "program"}, grids=_grids(t))


@query()
def i14_labelled_fields(t):
    return L.labelled_fields(t.blocks, {"station": ["the", "die"], "purpose": ["of", "de la"], "ticket": ["and the"]}, ("ticket",))


_PAIRS = "pr AS (SELECT a.*, b.block_id AS anchor_id, b.x1 + 40 AS ax1, b.y1 - 6 AS ay1, b.x2 + 40 AS ax2, b.y2 - 6 AS ay2, ['above', 'below', 'left', 'right', 'same_row', 'same_column', 'same_row_right'][(a.block_id % 7 + 1)] AS rel FROM blocks a JOIN blocks b ON a.document_id = b.document_id AND a.page_number = b.page_number AND b.block_id BETWEEN a.block_id - 4 AND a.block_id + 4 AND b.block_id <> a.block_id)"


def _pairs(t):
    b = t.blocks.selectExpr("document_id", "page_number", "block_id AS anchor_id", "x1 + 40 AS ax1", "y1 - 6 AS ay1", "x2 + 40 AS ax2", "y2 - 6 AS ay2")
    pairs = t.blocks.join(b, ["document_id", "page_number"]).filter("anchor_id BETWEEN block_id - 4 AND block_id + 4 AND anchor_id <> block_id")
    return pairs.withColumn("rel", F.element_at(F.array(*map(F.lit, P.RELATIONS)), F.col("block_id") % 7 + 1))


#: Relations of the pairs ``pr``.
_RELATED = """q AS (SELECT *, greatest(1.0, (y2 - y1 + ay2 - ay1) / 2) AS sc, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (ax1 + ax2) / 2 AS ax, (ay1 + ay2) / 2 AS ay,
  greatest(0, least(x2, ax2) - greatest(x1, ax1)) / greatest(1.0, least(x2 - x1, ax2 - ax1)) AS ho, greatest(0, least(y2, ay2) - greatest(y1, ay1)) / greatest(1.0, least(y2 - y1, ay2 - ay1)) AS vo FROM pr),
e AS (SELECT *, abs(cy - ay) / sc AS re, least(abs(x1 - ax1), abs(cx - ax), abs(x2 - ax2)) / sc AS ce, greatest(0, greatest(x1, ax1) - least(x2, ax2)) / sc AS gx, greatest(0, greatest(y1, ay1) - least(y2, ay2)) / sc AS gy, rel IN ('left', 'right', 'same_row', 'same_row_right') AS side, CASE WHEN rel LIKE 'same%' THEN 12.0 ELSE 8.0 END AS lim FROM q),
f AS (SELECT *, CASE WHEN side THEN gx ELSE gy END AS d, CASE rel WHEN 'above' THEN cy < ay WHEN 'below' THEN cy > ay WHEN 'left' THEN cx < ax WHEN 'right' THEN cx > ax WHEN 'same_row_right' THEN cx > ax ELSE true END AS way,
  CASE WHEN rel IN ('same_row', 'same_row_right') THEN re <= 0.75 WHEN side THEN vo >= 0.2 OR re <= 0.75 ELSE ho >= 0.2 OR ce <= 2 END AS al FROM e)"""


@query(_PAIRS + ", " + _RELATED + """;
SELECT document_id, page_number, block_id, anchor_id, rel, way AND al AND d <= lim AS matched, round(d, 4) AS distance, round(CASE WHEN side THEN re ELSE ce END, 4) AS alignment, round(CASE WHEN side THEN vo ELSE ho END, 4) AS overlap, round(CASE WHEN way AND al AND d <= lim THEN greatest(0, 1 - d / lim) ELSE 0 END, 4) AS score,
  CASE WHEN NOT way THEN 'direction_mismatch' WHEN NOT al THEN 'axis_alignment_mismatch' WHEN d > lim THEN 'normalized_distance_exceeded' ELSE 'relation_matched' END AS reason FROM f""")
def i15_relate(t):
    return P.relate(_pairs(t), F.col("rel")).drop("x1", "y1", "x2", "y2", "ax1", "ay1", "ax2", "ay2", "text")


@query("""c AS (SELECT concat_ws('-', document_id, page_number, block_id) AS candidate_id, 'f' || block_id % 3 AS field, CASE WHEN block_id % 2 = 0 THEN 'cover_row_' || block_id % 7 || ':left' END AS cell, x1, y1, x2, y2 FROM blocks),
an AS (SELECT * FROM (VALUES ('f0', 'below', 'a1', 0.0::DOUBLE, 0.0::DOUBLE, 60.0::DOUBLE, 18.0::DOUBLE), ('f2', 'right', 'a2', 0.0, 300.0, 40.0, 320.0), ('f2', 'same_row', 'a3', 10.0, 200.0, 90.0, 215.0)) v(field, rel, anchor_id, ax1, ay1, ax2, ay2)),
pr AS (SELECT * FROM c JOIN an USING (field)), """ + _RELATED + """,
m AS (SELECT candidate_id, anchor_id, way AND al AND d <= lim AS matched, round(CASE WHEN way AND al AND d <= lim THEN greatest(0, 1 - d / lim) ELSE 0 END, 4) AS s FROM f),
b AS (SELECT candidate_id, max(s) AS s, max(CASE WHEN matched THEN (s, anchor_id) END) AS best FROM m GROUP BY 1),
r AS (SELECT candidate_id, field, CASE field WHEN 'f0' THEN ((x1 + x2) / 2 >= 450 AND (y1 + y2) / 2 <= 820 * 0.22)::INTEGER WHEN 'f1' THEN CASE WHEN cell IS NOT NULL THEN (cell = 'cover_row_4:left')::INTEGER END END AS t FROM c);
SELECT candidate_id, field, coalesce(t, 0)::DOUBLE AS topology_score, coalesce(s, 0)::DOUBLE AS anchor_score, best[2] AS anchor_id, CASE WHEN t = 0 THEN 'LOW' END AS cap FROM r LEFT JOIN b USING (candidate_id)""")
def i16_spatial_evidence(t):
    c = t.blocks.selectExpr("concat_ws('-', document_id, page_number, block_id) AS candidate_id", "concat('f', block_id % 3) AS field", "CASE WHEN block_id % 2 = 0 THEN concat('cover_row_', block_id % 7, ':left') END AS source_cell", "900D AS page_width", "820D AS page_height", "x1", "y1", "x2", "y2")
    topology = t.spark.createDataFrame([("f0", "page_region", "top_right_header"), ("f1", "cover_slot", "cover_row_4:left")], "field string, kind string, expected string")
    anchors = t.spark.createDataFrame([("f0", "below", "a1", 0.0, 0.0, 60.0, 18.0), ("f2", "right", "a2", 0.0, 300.0, 40.0, 320.0), ("f2", "same_row", "a3", 10.0, 200.0, 90.0, 215.0)], "field string, relation string, anchor_id string, ax1 double, ay1 double, ax2 double, ay2 double")
    return P.spatial_evidence(c, topology, anchors)


@query("""
v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'amount' WHEN 1 THEN 'year' WHEN 2 THEN 'note' ELSE 'other' END AS field, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN (1950 + p_size)::VARCHAR ELSE p_name END AS value FROM part),
r AS (SELECT p_partkey, field, value, unnest(CASE field WHEN 'amount' THEN ['numeric', 'numeric_range'] WHEN 'year' THEN ['year'] WHEN 'note' THEN ['enum'] ELSE ['none'] END) AS kind FROM v),
c AS (SELECT p_partkey, kind, CASE WHEN kind = 'none' THEN NULL WHEN value = '' THEN CASE WHEN kind = 'numeric' THEN 'failed' ELSE 'not_evaluated' END WHEN CASE kind WHEN 'numeric' THEN regexp_matches(value, '^[0-9]+$') WHEN 'numeric_range' THEN coalesce(try_cast(value AS DOUBLE) BETWEEN 10 AND 1990, false) WHEN 'year' THEN regexp_matches(value, '^(19|20)[0-9]{2}$') ELSE value IN ('red widget', '7') END THEN 'passed' ELSE 'failed' END AS s FROM r),
a AS (SELECT p_partkey, count(*) FILTER (WHERE s = 'passed') AS p, count(*) FILTER (WHERE s IN ('passed', 'failed')) AS e, count(*) FILTER (WHERE s = 'failed' AND kind = 'numeric') AS b FROM c GROUP BY 1);
SELECT p_partkey AS value_id, CASE WHEN b > 0 THEN 'failed' WHEN e = 0 THEN 'not_evaluated' WHEN p = e THEN 'passed' ELSE 'partial' END AS status, CASE WHEN e = 0 THEN 0.0 ELSE round(p / e, 4) END AS score, CASE WHEN b > 0 THEN 'LOW' END AS cap FROM a""")
def i17_validate_values(t):
    values = t.part.selectExpr("p_partkey AS value_id", "CASE p_partkey % 4 WHEN 0 THEN 'amount' WHEN 1 THEN 'year' WHEN 2 THEN 'note' ELSE 'other' END AS field", "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN CAST(1950 + p_size AS STRING) ELSE p_name END AS value")
    rules = [("amount", "numeric", None, None, None, None, True, True), ("amount", "numeric_range", None, None, 10.0, 1990.0, False, True), ("year", "year", None, None, None, None, False, True), ("note", "enum", ["red widget", "7"], None, None, None, False, True), ("note", "numeric", None, None, None, None, True, False)]
    return P.validate_values(values, t.spark.createDataFrame(rules, "field string, kind string, options array<string>, pattern string, low double, high double, required boolean, active boolean"))


@query("""
s AS (SELECT p_partkey, (p_partkey % 11) / 10.0 AS a, (p_partkey % 7) / 6.0 AS b, (p_partkey % 2)::DOUBLE AS c, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 5) / 4.0 END AS d, 1.0 AS e, (p_size / 50.0) AS f, CASE WHEN p_partkey % 9 = 0 THEN 'LOW' WHEN p_partkey % 10 = 0 THEN 'MEDIUM' END AS cap FROM part),
r AS (SELECT *, round(round(a * 25, 4) + round(b * 25, 4) + round(c * 15, 4) + round(coalesce(d, 0) * 15, 4) + round(e * 15, 4) + round(f * 5, 4), 4) AS raw FROM s), q AS (SELECT *, round(least(raw, CASE cap WHEN 'LOW' THEN 39.9999 WHEN 'MEDIUM' THEN 59.9999 ELSE 100 END), 4) AS score FROM r);
SELECT p_partkey, raw::DOUBLE AS raw_score, score::DOUBLE AS score, CASE WHEN score >= 80 THEN 'VERY_HIGH' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 20 THEN 'LOW' ELSE 'VERY_LOW' END AS level FROM q""")
def i18_score_candidates(t):
    c = t.part.selectExpr(
        "p_partkey", "(p_partkey % 11) / 10D AS topology", "(p_partkey % 7) / 6D AS anchor", "CAST(p_partkey % 2 AS DOUBLE) AS alias", "CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 5) / 4D END AS separator", "1D AS value_validation", "p_size / 50D AS ocr_confidence",
        "CASE WHEN p_partkey % 9 = 0 THEN 'LOW' WHEN p_partkey % 10 = 0 THEN 'MEDIUM' END AS cap",
    )
    return P.score_candidates(c).select("p_partkey", "raw_score", "score", "level")


@query()
def i19_resolve_fields(t):
    fields = F.explode(F.array(*map(F.lit, ("station", "purpose", "ticket"))))
    existing = t.documents.select(F.col("doc_id").alias("document_id"), fields.alias("field")).withColumn("value", F.when((F.col("document_id") % 4 == 0) & (F.col("field") == "station"), "kept"))
    blocks = t.blocks.withColumn("text", F.regexp_replace("text", r"\b(the|of|la|und)\b", "$1:"))
    rules = t.spark.createDataFrame([("ticket", "numeric", None, None, None, None, True, True)], "field string, kind string, options array<string>, pattern string, low double, high double, required boolean, active boolean")
    topology = t.spark.createDataFrame([("purpose", "page_region", "top_right_header")], "field string, kind string, expected string")
    anchors = t.spark.createDataFrame([("purpose", "below", "a1", 0.0, 0.0, 600.0, 18.0)], "field string, relation string, anchor_id string, ax1 double, ay1 double, ax2 double, ay2 double")
    return resolve_fields(existing, blocks, [("the", "station"), ("of", "purpose"), ("la", "station"), ("und", "ticket")], rules, topology, anchors, ["ticket"], 900.0, 820.0)


@query()
def i19_sibling_fields(t):
    """Values that are there with their boxes, and anchors that are candidates of other fields."""
    fields = F.explode(F.array(*map(F.lit, ("station", "purpose", "ticket"))))
    first = t.blocks.filter("page_number = 1").groupBy("document_id").agg(F.min_by(F.struct("block_id", "text", "x1", "y1", "x2", "y2"), "block_id").alias("b"))
    there = F.when((F.col("document_id") % 3 == 0) & (F.col("field") == "station"), F.col("b.text")).alias("value")
    existing = first.withColumn("field", fields).select("document_id", "field", there, F.lit(1).alias("page_number"), F.array("b.block_id").alias("blocks"), *(f"b.{c}" for c in ("x1", "y1", "x2", "y2")))
    blocks = t.blocks.withColumn("text", F.regexp_replace("text", r"\b(the|of|la|und)\b", "$1:"))
    none = {"rules": "field string, kind string, options array<string>, pattern string, low double, high double, required boolean, active boolean", "topology": "field string, kind string, expected string", "anchors": "field string, relation string, anchor_id string, ax1 double, ay1 double, ax2 double, ay2 double"}
    rules, topology, anchors = (t.spark.createDataFrame([], x) for x in none.values())
    siblings = t.spark.createDataFrame([("purpose", "below", "station"), ("ticket", "right", "purpose")], "field string, relation string, anchor_field string")
    aliases = [("the", "station"), ("of", "purpose"), ("la", "station"), ("und", "ticket")]
    return resolve_fields(existing, blocks, aliases, rules, topology, anchors, [], 900.0, 820.0, siblings, ["ticket"])


def _document_results(t):
    fields = t.events.selectExpr("user_id AS document_id", "event_type AS field", "CAST(value AS STRING) AS value", "CASE WHEN value > 90 THEN 'review_required' ELSE 'auto_selected' END AS status", "round(value / 100, 4) AS confidence")
    settings = t.events.selectExpr("user_id AS document_id", "event_id % 3 AS page_number", "event_id AS place", "event_type AS name", "CAST(value AS STRING) AS value")
    return P.document_result(fields, settings, t.events.filter("event_type = 'error'").selectExpr("user_id AS document_id", "concat('W', event_id % 5) AS code"), t.events.filter("event_type = 'view'").selectExpr("user_id AS document_id", "event_id % 3 AS page_number", "event_id AS place", "event_type AS text"))


@query()
def i20_document_result(t):
    return _document_results(t)


@query("""
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS num FROM events);
SELECT user_id AS document_id,
  string_agg(event_type || '=' || value::VARCHAR || '/' || CASE WHEN value > 90 THEN 'review_required' ELSE 'auto_selected' END, '|' ORDER BY event_type, value::VARCHAR, value) AS fields,
  string_agg((event_id % 3)::VARCHAR || '.' || num::VARCHAR || ':' || event_type || '=' || value::VARCHAR, '|' ORDER BY event_id % 3, num) AS settings,
  coalesce(string_agg(DISTINCT 'W' || (event_id % 5)::VARCHAR, '|' ORDER BY 'W' || (event_id % 5)::VARCHAR) FILTER (WHERE event_type = 'error'), '') AS warnings,
  coalesce(string_agg((event_id % 3)::VARCHAR || ':' || event_type, '|' ORDER BY event_id % 3, event_id) FILTER (WHERE event_type = 'view'), '') AS notes,
  bool_or(value > 90 OR event_type IN ('error', 'view')) AS review FROM e GROUP BY 1""")
def i20_result_lines(t):
    """The same results with each list in one line."""
    line = lambda column, of: F.array_join(F.transform(column, of), "|").alias(column)
    return _document_results(t).select(
        "document_id",
        line("fields", lambda x: F.concat(x["field"], F.lit("="), x["value"], F.lit("/"), x["status"])),
        line("settings", lambda x: F.concat(x["page_number"], F.lit("."), x["number"], F.lit(":"), x["name"], F.lit("="), x["value"])),
        line("warnings", lambda x: x),
        line("notes", lambda x: F.concat(x["page_number"], F.lit(":"), x["text"])),
        "review",
    )


@query("""
p AS (SELECT conv_id AS document_id, (turn + 1 + (conv_id % 7 = 0 AND turn > 1)::INTEGER) AS n, CASE WHEN turn = 0 THEN 'cover' WHEN turn = 1 AND conv_id % 5 <> 0 THEN 'skipped' ELSE 'detail' END AS role, length(text) % 50 <> 0 AS pay FROM conversations), per AS (SELECT document_id, count(*) AS c, count(DISTINCT n) AS d, min(n) AS lo, max(n) AS hi FROM p GROUP BY 1);
SELECT document_id, 'pages_not_unique' AS rule FROM per WHERE c <> d UNION SELECT document_id, 'pages_not_contiguous' FROM per WHERE lo <> 1 OR hi - lo + 1 <> d UNION SELECT document_id, 'wrong_role' FROM p WHERE role <> CASE n WHEN 1 THEN 'cover' WHEN 2 THEN 'skipped' ELSE 'detail' END
UNION SELECT document_id, 'status_without_payload' FROM p WHERE NOT pay UNION SELECT document_id, 'unknown_artifact' FROM p WHERE n = 3 AND document_id % 4 = 0 UNION SELECT document_id, 'path_not_relative' FROM p WHERE document_id % 6 = 0 AND document_id % 4 <> 0""")
def i21_validate_result(t):
    pages = t.conversations.selectExpr(
        "conv_id AS document_id", "turn + 1 + CAST(conv_id % 7 = 0 AND turn > 1 AS INT) AS page_number", "CASE WHEN turn = 0 THEN 'cover' WHEN turn = 1 AND conv_id % 5 <> 0 THEN 'skipped' ELSE 'detail' END AS role",
        "'done' AS status", "CASE WHEN length(text) % 50 <> 0 THEN text END AS payload",
    ).withColumn("artifact_id", F.when(F.col("page_number") == 3, "a3"))
    artifacts = t.conversations.select(F.col("conv_id").alias("document_id")).distinct().filter("document_id % 4 <> 0").selectExpr("document_id", "'a3' AS artifact_id", "CASE WHEN document_id % 6 = 0 THEN '/tmp/x' ELSE 'pages/3.json' END AS path")
    return P.validate_result(pages, artifacts)


@query("""
r AS (SELECT c_custkey AS d, CASE c_custkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'success_with_warnings' WHEN 2 THEN 'failed' ELSE 'success' END AS st, CASE WHEN c_custkey % 3 = 0 THEN 'review_required' ELSE 'not_required' END AS rv, c_custkey % 5 AS pc, c_custkey % 7 <> 0 AS biz, c_custkey % 11 = 0 OR c_custkey % 4 = 2 AND c_custkey % 5 <> 0 AS err FROM customer),
o AS (SELECT o_custkey AS d, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS bad FROM orders GROUP BY 1), e AS (SELECT DISTINCT o_custkey AS d FROM orders WHERE o_orderpriority = '1-URGENT'), x AS (SELECT DISTINCT o_custkey AS d FROM orders WHERE o_orderpriority = '5-LOW'),
a AS (SELECT r.*, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, e.d IS NOT NULL AS ev, x.d IS NOT NULL AS w, st <> 'failed' AS good FROM r LEFT JOIN o USING (d) LEFT JOIN e USING (d) LEFT JOIN x USING (d));
SELECT d AS document_id, 'success_has_warnings' AS rule FROM a WHERE st = 'success' AND w UNION ALL SELECT d, 'warnings_missing' FROM a WHERE st = 'success_with_warnings' AND NOT w UNION ALL SELECT d, 'success_without_payload' FROM a WHERE good AND NOT biz UNION ALL SELECT d, 'success_has_error' FROM a WHERE good AND err
UNION ALL SELECT d, 'pages_do_not_cover' FROM a WHERE good AND n <> pc UNION ALL SELECT d, 'review_not_raised' FROM a WHERE good AND rv <> 'review_required' AND (ev OR bad > 0) UNION ALL SELECT d, 'failed_has_business' FROM a WHERE NOT good AND biz UNION ALL SELECT d, 'failed_without_error' FROM a WHERE NOT good AND NOT err
UNION ALL SELECT d, 'failed_without_review' FROM a WHERE NOT good AND rv <> 'review_required' UNION ALL SELECT d, 'forbidden_key' FROM a WHERE biz AND d % 13 = 0 UNION ALL SELECT d, 'absolute_path' FROM a WHERE biz AND d % 17 = 0""")
def i21_result_envelope(t):
    results = t.customer.selectExpr(
        "c_custkey AS document_id", "CASE c_custkey % 4 WHEN 1 THEN 'success_with_warnings' WHEN 2 THEN 'failed' ELSE 'success' END AS status", "CASE WHEN c_custkey % 3 = 0 THEN 'review_required' ELSE 'not_required' END AS review_status", "c_custkey % 5 AS page_count",
        "CASE WHEN c_custkey % 7 <> 0 THEN to_json(map('name', c_name, if(c_custkey % 13 = 0, 'Raw_OCR', 'raw'), 'x', 'file', if(c_custkey % 17 = 0, '/srv/a', 'a/b'))) END AS business", "CASE WHEN c_custkey % 11 = 0 OR c_custkey % 4 = 2 AND c_custkey % 5 <> 0 THEN 'E' END AS error",
    )
    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = t.orders.select(F.col("o_custkey").alias("document_id"), number.alias("page_number"), F.when(F.col("o_orderstatus") == "F", "review_required").alias("review_status"))
    orders = t.orders.withColumnRenamed("o_custkey", "document_id")
    return P.envelope_violations(results, orders.filter("o_orderpriority = '5-LOW'"), pages, orders.filter("o_orderpriority = '1-URGENT'"))


_OVER = "o AS (SELECT p_brand || CASE WHEN p_size % 7 = 0 THEN '?' ELSE '' END AS field, CASE WHEN p_size % 5 = 0 THEN 'magic' ELSE 'enum' END AS kind, p_name AS argument, 'active' AS status, CASE WHEN p_size % 11 = 0 THEN 'default' ELSE 'user' END AS origin, CASE WHEN p_size % 13 = 0 THEN '' ELSE 'me' END AS author FROM part)"


def _rule_tables(t):
    default = t.part.selectExpr("p_brand AS field", "'numeric' AS kind", "p_type AS argument", "CASE WHEN p_size % 3 = 0 THEN 'disabled' ELSE 'active' END AS status", "'default' AS origin", "CAST(NULL AS STRING) AS author").distinct()
    overlay = t.part.selectExpr("concat(p_brand, CASE WHEN p_size % 7 = 0 THEN '?' ELSE '' END) AS field", "CASE WHEN p_size % 5 = 0 THEN 'magic' ELSE 'enum' END AS kind", "p_name AS argument", "'active' AS status", "CASE WHEN p_size % 11 = 0 THEN 'default' ELSE 'user' END AS origin", "CASE WHEN p_size % 13 = 0 THEN '' ELSE 'me' END AS author")
    return P.rule_tables(default, overlay, ["enum", "numeric"])


@query(_OVER + "; SELECT DISTINCT p_brand AS field, 'numeric' AS kind, p_type AS argument, 'active' AS status, 'default' AS origin, NULL::VARCHAR AS author FROM part WHERE p_size % 3 <> 0 UNION SELECT * FROM o WHERE field IN (SELECT p_brand FROM part) AND kind = 'enum' AND origin = 'user' AND author <> ''")
def i22_rule_tables(t):
    return _rule_tables(t)[0]


@query(_OVER + "; SELECT *, CASE WHEN field NOT IN (SELECT p_brand FROM part) THEN 'unknown_field' WHEN kind <> 'enum' THEN 'unknown_kind' WHEN origin <> 'user' THEN 'wrong_origin' ELSE 'author_missing' END AS reason FROM o WHERE NOT (field IN (SELECT p_brand FROM part) AND kind = 'enum' AND origin = 'user' AND author <> '')")
def i22_invalid_rules(t):
    return _rule_tables(t)[1]


@query("SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS alias, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS fields FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def i22_alias_conflicts(t):
    return P.alias_conflicts(t.part.selectExpr("upper(p_name) AS alias", "p_type AS field"))


@query()
def c16_match_aliases(t):
    return L.match_aliases(t.blocks, [("the", "article"), ("of the", "genitive"), ("de la", "genitive"), ("de la", "place"), ("und", "joint"), ("license", "license")])


@query("""
RECURSIVE o AS (SELECT document_id AS d, page_number AS p, x1, row_number() OVER (PARTITION BY document_id, page_number ORDER BY (y1 + y2) / 2, x1, block_id) AS k FROM blocks WHERE regexp_matches(text, '\\S')),
g AS (SELECT DISTINCT d, p, 0::BIGINT AS k, []::STRUCT(m DOUBLE, n BIGINT)[] AS a FROM o UNION ALL
  SELECT d, p, k, CASE WHEN h IS NULL THEN list_append(a, {'m': x1, 'n': 1::BIGINT}) ELSE list_transform(a, lambda z, i: CASE WHEN i = h THEN {'m': z.m + (x1 - z.m) / (z.n + 1), 'n': z.n + 1} ELSE z END) END
  FROM (SELECT g.d, g.p, o.k, o.x1, g.a, nullif(list_position(list_transform(g.a, lambda z: abs(o.x1 - z.m) <= 12), true), 0) AS h FROM g JOIN o ON o.d = g.d AND o.p = g.p AND o.k = g.k + 1)),
l AS (SELECT d, p, arg_max(a, k) AS a FROM g GROUP BY d, p), u AS (SELECT d, p, unnest(a) AS z FROM l);
SELECT d AS document_id, p AS page_number, round(z.m, 4) AS x, z.n::INTEGER AS support FROM u WHERE z.n >= 2""")
def d15_column_anchors(t):
    return L.column_anchors(t.blocks)


@query()
def d16_table_candidates(t):
    return L.table_candidates(t.blocks.withColumn("y1", F.expr("y1 - 20 * (block_id % 2)")).withColumn("y2", F.col("y1") + 18))


# --- J


@query("""
RECURSIVE e AS (
  SELECT user_id AS d, ts AS tm, CASE event_type WHEN 'error' THEN 'MISMATCH' WHEN 'purchase' THEN 'continue' ELSE 'MATCH' END AS status, (event_id % 50 + 1)::INTEGER AS ev, CASE WHEN event_id % 97 = 0 THEN 'e' WHEN event_id % 5 = 0 THEN 'M' ELSE 'h' END AS un, event_id % 4 = 0 AS man FROM events
), r AS (
  SELECT *, row_number() OVER (PARTITION BY d ORDER BY tm, status, ev, un, man) AS k, NOT man AND status <> 'continue' AS auto,
         CASE un WHEN 'M' THEN tm + to_months(ev) WHEN 'h' THEN tm + to_hours(ev) END AS nxt FROM e
), g AS (
  SELECT d, 0::BIGINT AS k, NULL::TIMESTAMP AS tm, NULL::VARCHAR AS status, false AS paused, NULL::INTEGER AS sev, NULL::VARCHAR AS sun, true AS enabled, NULL::TIMESTAMP AS next_at, NULL::INTEGER AS every, NULL::VARCHAR AS unit, NULL::VARCHAR AS action FROM (SELECT DISTINCT d FROM r)
  UNION ALL
  SELECT d, k, tm, status, CASE WHEN does THEN mis OR paused AND NOT res ELSE paused END, CASE WHEN does AND mis AND NOT paused THEN ev WHEN does AND res THEN NULL ELSE sev END, CASE WHEN does AND mis AND NOT paused THEN un WHEN does AND res THEN NULL ELSE sun END,
         enabled AND NOT (does AND auto AND u = 'e'),
         CASE WHEN does AND auto AND u = 'e' THEN NULL WHEN does AND res THEN CASE sun WHEN 'M' THEN tm + to_months(sev) WHEN 'h' THEN tm + to_hours(sev) END WHEN does AND auto AND NOT mis AND NOT paused THEN nxt ELSE next_at END,
         CASE WHEN does AND res THEN sev ELSE ev END, CASE WHEN does THEN u ELSE un END,
         CASE WHEN NOT does THEN CASE WHEN enabled THEN 'skipped' ELSE 'disabled' END WHEN mis AND paused THEN 'kept_paused' WHEN mis THEN 'paused' WHEN res THEN 'resumed' WHEN auto AND u = 'e' THEN 'one_shot_done' ELSE 'none' END
  FROM (SELECT r.*, g.paused, g.sev, g.sun, g.enabled, g.next_at, NOT auto OR NOT g.paused AND g.enabled AS does, r.status = 'MISMATCH' AS mis, r.status <> 'MISMATCH' AND g.paused AS res, CASE WHEN r.status <> 'MISMATCH' AND g.paused THEN g.sun ELSE r.un END AS u FROM g JOIN r ON r.d = g.d AND r.k = g.k + 1)
);
SELECT d AS device_id, tm AS "at", status, paused, every, unit, action, next_at FROM g WHERE k > 0""")
def j1_drift_monitor(t):
    status = F.expr("CASE event_type WHEN 'error' THEN 'MISMATCH' WHEN 'purchase' THEN 'continue' ELSE 'MATCH' END AS status")
    unit = F.expr("CASE WHEN event_id % 97 = 0 THEN 'e' WHEN event_id % 5 = 0 THEN 'M' ELSE 'h' END AS unit")
    return J.drift_monitor(t.events.select(F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("at"), status, (F.col("event_id") % 50 + 1).cast("int").alias("every"), unit, (F.col("event_id") % 4 == 0).alias("manual")))


@query("SELECT user_id AS ticket_id, least(count(*), 5) AS step, greatest(count(*) - 5, 0) AS rejected, count(*) >= 5 AS finished FROM events GROUP BY 1")
def j2_ticket_flow(t):
    return J.ticket_flow(t.events.withColumnRenamed("user_id", "ticket_id"))


@query("""
d AS (SELECT c_custkey AS id, c_custkey % 9 + 1 AS every, 'h' AS unit, c_custkey % 3 <> 0 AS paused, CASE WHEN c_custkey % 3 = 1 THEN 1 + c_custkey % 4 END AS saved_every FROM customer),
e AS (SELECT user_id AS id FROM events GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT d.*, e.id IS NOT NULL AS ended FROM d LEFT JOIN e USING (id)), n AS (SELECT *, CASE WHEN ended THEN coalesce(saved_every, every) ELSE every END AS new_every FROM r);
SELECT id, new_every::INTEGER AS every, unit, paused AND NOT ended AS paused, CASE WHEN ended THEN timestamp '2024-03-01 08:00:00' + to_hours(new_every::INTEGER) END AS next_at, CASE WHEN NOT ended THEN saved_every END::INTEGER AS saved_every FROM n""")
def j2_restore_schedules(t):
    saved = "CASE WHEN c_custkey % 3 = 1 THEN struct(CAST(1 + c_custkey % 4 AS INT) AS every, 'h' AS unit) END AS saved"
    devices = t.customer.selectExpr("c_custkey AS id", "CAST(c_custkey % 9 + 1 AS INT) AS every", "'h' AS unit", "CAST(NULL AS TIMESTAMP) AS last_at", "CAST(NULL AS TIMESTAMP) AS next_at", "c_custkey % 3 <> 0 AS paused", saved)
    flow = J.ticket_flow(t.events.withColumnRenamed("user_id", "ticket_id")).filter("finished").withColumnRenamed("ticket_id", "device_id")
    return J.restore_schedules(devices, flow, F.expr("timestamp '2024-03-01 08:00:00'")).select("id", "every", "unit", "paused", "next_at", F.col("saved.every").alias("saved_every"))


@query("""
s AS (SELECT event_id AS id, event_id % 800 AS sheet_id, CASE event_type WHEN 'click' THEN 'technician' WHEN 'view' THEN 'supervisor' WHEN 'purchase' THEN 'dispatcher' ELSE 'admin' END AS role, ts AS tm FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY tm, id) AS k FROM s), t1 AS (SELECT sheet_id, min(k) AS k FROM t WHERE role = 'technician' GROUP BY 1), t2 AS (SELECT sheet_id, min(t.k) AS k FROM t JOIN t1 USING (sheet_id) WHERE role = 'supervisor' AND t.k > t1.k GROUP BY 1), t3 AS (SELECT sheet_id, min(t.k) AS k FROM t JOIN t2 USING (sheet_id) WHERE role = 'admin' AND t.k > t2.k GROUP BY 1),
a AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3);
SELECT id, t.sheet_id, role, tm AS "at", a.k IS NOT NULL AS accepted FROM t LEFT JOIN a ON a.sheet_id = t.sheet_id AND a.k = t.k""")
def j3_signature_flow(t):
    return J.signature_flow(signatures(t).selectExpr("id", "sheet_id", "role", "signed_at AS at"))


@query("""
RECURSIVE e AS (SELECT user_id || ':' || event_type AS idempotency_key, ts FROM events), g AS (
  SELECT idempotency_key, min(ts) AS "at" FROM e GROUP BY 1 UNION ALL
  SELECT g.idempotency_key, min(e.ts) AS "at" FROM g JOIN e ON e.idempotency_key = g.idempotency_key AND e.ts >= g."at" + INTERVAL 24 HOUR GROUP BY g.idempotency_key);
SELECT idempotency_key, "at" FROM g""")
def j4_ingest_once(t):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return J.ingest_once(t.events.select(key.alias("idempotency_key"), F.col("ts").alias("at")))


@query("SELECT user_id AS job_id, event_id AS id, row_number() OVER w AS sequence, round(max(greatest(0.0, least(100.0, (value - 5) / 80 * 100))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS percent, round(max(greatest(0.0, least(100.0, (value - 5) / 80 * 100))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) >= 100 AS terminal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def j5_monotonic_progress(t):
    return J.monotonic_progress(t.events.selectExpr("user_id AS job_id", "event_id AS id", "value - 5 AS completed", "80D AS total"))


@query("""
h AS (SELECT event_id AS job_id, ts + INTERVAL 1 DAY * (event_id % 6 = 0)::INTEGER AS header_at, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS header_status FROM events), d AS (SELECT event_id AS job_id, ts - INTERVAL 1 SECOND * (event_id % 1500) AS detail_at FROM events);
SELECT d.job_id, detail_at, header_at, CASE WHEN h.job_id IS NULL THEN 'FAILED' WHEN header_status = 'FAILED' THEN 'SKIPPED' ELSE 'READY' END AS outcome FROM d LEFT JOIN h ON d.job_id = h.job_id AND header_at >= detail_at - INTERVAL 600 SECOND AND header_at <= detail_at + INTERVAL 600 SECOND""")
def j6_pair_stages(t):
    rows = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    headers = rows.selectExpr("event_id AS job_id", "at + make_dt_interval(IF(event_id % 6 = 0, 1, 0)) AS header_at", "CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS header_status")
    return J.pair_stages(headers, rows.selectExpr("event_id AS job_id", "at - make_dt_interval(0, 0, 0, event_id % 1500) AS detail_at"))


@query("l AS (SELECT event_id % 777 AS job_id, arg_max(event_type, event_id) AS status, arg_max(user_id, event_id) % 5 AS creator FROM events GROUP BY 1); SELECT status, NULL::BIGINT AS creator, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT status, creator, count(*) FROM l GROUP BY 1, 2")
def j7_status_counts(t):
    latest = J.latest_status(t.events.selectExpr("event_id % 777 AS job_id", "event_id AS id", "event_type AS status", "user_id % 5 AS creator", "ts AS at"))
    return J.status_totals(latest)


@query("l AS (SELECT event_id % 777 AS job_id, arg_max(event_type, event_id) AS status, arg_max(user_id, event_id) % 5 AS creator FROM events GROUP BY 1); SELECT status, NULL::BIGINT AS creator, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT status, creator, count(*) FROM l GROUP BY 1, 2")
def j7_live_changes(t):
    """The same totals by way of the stream of changes."""
    source, changes = t.folder("statuses"), t.folder("changes")
    t.events.selectExpr("event_id % 777 AS job_id", "event_id AS id", "event_type AS status", "user_id % 5 AS creator", "CAST(ts AS TIMESTAMP) AS at").write.parquet(source)
    events = t.spark.readStream.schema("job_id long, id long, status string, creator long, at timestamp").option("maxFilesPerTrigger", 4).parquet(source)
    J.live_status_counts(events, changes, lambda *_: None, t.folder("live")).awaitTermination()
    return J.status_totals_of(t.spark, changes)


@query("""
b AS (SELECT 'C' || c_custkey % 700 AS code, coalesce(c_name, '') AS name, c_custkey AS k FROM customer), l AS (SELECT code, arg_max(name, k) AS name FROM b GROUP BY 1), s AS (SELECT 'C' || s_suppkey AS code, s_name AS name, s_nationkey::VARCHAR AS kind FROM supplier);
SELECT code, coalesce(l.name, s.name) AS name, s.kind FROM s FULL JOIN l USING (code)""")
def j8_sync_stream(t):
    source, target = t.folder("batches"), t.folder("target")
    t.customer.selectExpr("c_custkey AS k", "concat('C', c_custkey % 700) AS ext", "c_name AS label").write.parquet(source)
    table = J.SyncedTable(t.spark, target)
    table.create(t.supplier.selectExpr("concat('C', s_suppkey) AS code", "s_name AS name", "CAST(s_nationkey AS STRING) AS kind"))
    batches = t.spark.readStream.schema("k long, ext string, label string").parquet(source)
    J.sync_stream(batches, table, ["ext"], {"name": "label"}, "k", t.folder("sync"), lambda *_: None).awaitTermination()
    return table.read()


@query("SELECT tick, c_custkey AS id FROM (SELECT DISTINCT date_trunc('day', ts) AS tick FROM events) JOIN customer ON c_custkey % 3 <> 0 AND timestamp '2024-01-01' + INTERVAL 1 HOUR * (c_custkey % 500) <= tick")
def j9_due_tick(t):
    schedule = t.customer.selectExpr("c_custkey AS id", "c_custkey % 3 <> 0 AS enabled", "false AS paused", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, CAST(c_custkey % 500 AS INT)) AS next_at")
    return J.due_tick(t.events.select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at")).distinct(), schedule)


@query("SELECT tick, id FROM (SELECT c_custkey AS id, timestamp '2024-01-01' + INTERVAL 17 MINUTE * (c_custkey % 5000) AS next_at FROM customer WHERE c_custkey % 3 <> 0) JOIN (SELECT DISTINCT date_trunc('day', ts) AS tick FROM events) ON next_at <= tick AND next_at > tick - INTERVAL 1 DAY")
def j9_newly_due(t):
    schedule = t.customer.selectExpr("c_custkey AS id", "c_custkey % 3 <> 0 AS enabled", "false AS paused", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(17 * (c_custkey % 5000) AS INT)) AS next_at")
    return J.due_tick(t.events.select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at")).distinct(), schedule, "1 day")


@query("SELECT date_trunc('day', ts + INTERVAL 7 HOUR) - INTERVAL 7 HOUR AS start, count(*) AS n FROM events GROUP BY 1")
def j10_activity_windows(t):
    return J.activity_stream(t.events.withColumn("ts", F.col("ts").cast("timestamp")))
