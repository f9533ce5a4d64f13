"""Page evidence, spatial relations, scoring and result checks, natively (section I)."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import CEILINGS, check_value, confidence_level, fold_text, overlap_1d, unit_coordinate
from .joins import BOX, PAGE


#: Words as the expressions of Spark take them: anything between ASCII blanks.
_WORD = re.compile(r"\S+", re.ASCII)


def word_starts(text: str) -> list[int]:
    """Where each word starts, in one pass."""
    return [m.start() for m in _WORD.finditer(text)]


def words_from_blocks(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Words of the blocks with boxes interpolated by character offset, in 0..1000, and their order on the page."""
    # Blocks are put in order, not their words: a word's number is that of the words in the blocks before, and its own place.
    before = W.partitionBy(*PAGE).orderBy("block_id").rowsBetween(W.unboundedPreceding, -1)
    counted = blocks.select(*PAGE, "block_id", "text", *BOX).filter(F.col("text").rlike(r"\S")).withColumn("_before", F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\S+"))).over(before), F.lit(0)).cast("int"))
    starts = F.udf(word_starts, "array<int>", useArrow=True)
    words = F.arrays_zip(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("word"), starts("text").alias("lo"))
    rows = counted.select(*PAGE, "block_id", *BOX, "_before", F.greatest(F.lit(1), F.length("text")).alias("_n"), F.posexplode(words).alias("_k", "_w"))
    rows = rows.withColumn("_w", F.struct("_w.word", "_w.lo", (F.col("_w.lo") + F.length("_w.word")).alias("hi")))
    left = F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("_w.lo") / F.col("_n")
    right = F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("_w.hi") / F.col("_n")
    index = F.col("_before") + F.col("_k")
    w, h = F.lit(page_width), F.lit(page_height)
    return rows.select(
        *PAGE, "block_id", index.alias("word_index"), F.col("_w.word").alias("text"),
        unit_coordinate(left, w, 1000).alias("nx1"), unit_coordinate(F.col("y1"), h, 1000).alias("ny1"), unit_coordinate(right, w, 1000).alias("nx2"), unit_coordinate(F.col("y2"), h, 1000).alias("ny2"),
    )


#: Weights of the signals for a page reference (fixed values).
#: Patterns, weights and limits of page references (fixed values); shares are of the page's width or height.
TICKET = r"[A-Za-z]\d+-\d+-\d{4}/[A-Za-z]\d+(?:\.\d+)?/\d+"
REFERENCE = r"(?<![\d/])\d{1,4}\s*/\s*\d{1,4}(?![\d/])"
REFERENCE_WEIGHTS = {"label": 0.3, "ticket": 0.2, "top": 0.5}
HEADER, RIGHT_SIDE, TICKET_BELOW, TICKET_ASIDE, LABEL_GAP = 0.22, 0.52, 0.08, 0.18, 0.22


def _label(c: Column) -> Column:
    """Text as a label: without closing punctuation; null if nothing or a number is left, or for a ticket number."""
    t = F.regexp_replace(F.trim(c), r"[:：.\- ]+$", "")
    return F.when((t != "") & ~t.rlike(r"^\d+$") & ~t.rlike(TICKET), t)


def detect_page_reference(blocks: DataFrame, page_width: float | None = None, page_height: float | None = None, with_block: bool = False) -> DataFrame:
    """Page, total, label and score of the best ``x/y`` in each page's header, else of a lone number near the ticket number (no total);
    pages without either are absent.

    A reference stands in the right half and, on a page with a ticket number in the header, close below or beside it.  The score adds
    the confidence, a label (the text before it, or the nearest block to its left), the ticket, the place to the right and nearness to
    the top.  Without a page height a wide, low page counts as a crop of the header.  ``with_block`` adds its block.
    """
    page, g = W.partitionBy(*PAGE), REFERENCE_WEIGHTS
    width = F.lit(page_width) if page_width is not None else F.max("x2").over(page)
    height = F.lit(page_height) if page_height is not None else F.max("y2").over(page)
    sized = blocks.filter(F.trim("text") != "").withColumns({"_w": width, "_h": height})
    crop = F.lit(page_height is None) & (F.col("_h") <= 0.5 * F.col("_w"))
    head = sized.filter(F.col("y1") <= F.when(crop, F.col("_h")).otherwise(HEADER * F.col("_h"))).withColumn("_is_ticket", F.col("text").rlike(TICKET))
    tickets = F.collect_set(F.when(F.col("_is_ticket"), F.struct("x1", "y1", "y2"))).over(page)
    near = F.exists("_tickets", lambda t: (F.col("y1") >= t["y1"]) & (F.col("y1") - t["y2"] <= F.greatest(F.lit(40.0), TICKET_BELOW * F.col("_h"))) & (F.abs(F.col("x1") - t["x1"]) <= TICKET_ASIDE * F.col("_w")))
    right = head.withColumn("_tickets", tickets).withColumn("_near", near).filter(~F.col("_is_ticket") & ((F.col("x1") + F.col("x2")) / 2 >= RIGHT_SIDE * F.col("_w")))

    found, between = F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0)), F.split("text", REFERENCE, -1)
    pieces = F.flatten(F.transform(F.arrays_zip(between.alias("a"), found.alias("b")), lambda z: F.array(z["a"], z["b"])))
    whole = right.filter((F.size("_tickets") == 0) | F.col("_near")).withColumn("_pieces", pieces).select("*", F.posexplode(found).alias("_k", "_m"))
    number = [F.trim(F.split("_m", "/")[k]).cast("int") for k in (0, 1)]
    prefix = F.array_join(F.slice("_pieces", 1, 2 * F.col("_k") + 1), "")
    whole = whole.withColumns({"current_page": number[0], "total_pages": number[1], "_inline": _label(prefix)}).filter("current_page >= 1 AND total_pages >= current_page")
    lone = right.filter(F.trim("text").rlike(r"^\d{1,3}$") & F.col("_near")).withColumns({"_k": F.lit(0), "current_page": F.trim("text").cast("int"), "total_pages": F.lit(None).cast("int"), "_inline": F.lit(None).cast("string")}).filter("current_page >= 1")
    confidence = F.coalesce(F.col("recognition_score"), F.lit(0.0)) if "recognition_score" in blocks.columns else F.lit(0.0)
    place = (F.col("x1") + F.col("x2")) / F.greatest(F.lit(1.0), 2 * F.col("_w")) + g["top"] * (1 - F.col("y1") / F.greatest(F.lit(1.0), F.col("_h")))
    rows = whole.drop("_pieces", "_m").unionByName(lone).withColumn("_base", confidence + g["ticket"] * F.col("_near").cast("int") + F.when(F.col("total_pages").isNotNull(), place).otherwise(0.0))
    rows = rows.select(*PAGE, "block_id", "_k", "x1", "y1", "y2", "_w", "current_page", "total_pages", "_inline", "_base")

    labels = head.select(*PAGE, F.col("block_id").alias("_other"), F.col("x2").alias("_lx"), F.col("y1").alias("_ly1"), F.col("y2").alias("_ly2"), _label(F.col("text")).alias("_left")).filter(F.col("_left").isNotNull() & ~F.col("_left").rlike(REFERENCE))
    gap = F.col("x1") - F.col("_lx")
    beside = (F.col("_other") != F.col("block_id")) & gap.between(F.lit(-20.0), LABEL_GAP * F.col("_w")) & (overlap_1d(F.col("y1"), F.col("y2"), F.col("_ly1"), F.col("_ly2")) >= 0.25)
    left = rows.join(labels, PAGE).filter(beside).groupBy(*PAGE, "block_id", "_k", F.col("total_pages").isNull().alias("_lone")).agg(F.min_by("_left", F.struct(F.abs(gap), "_other")).alias("_left"))
    told = rows.withColumn("_lone", F.col("total_pages").isNull()).join(left, [*PAGE, "block_id", "_k", "_lone"], "left").withColumn("label", F.coalesce("_inline", "_left"))
    told = told.withColumn("score", F.col("_base") + g["label"] * F.col("label").isNotNull().cast("int"))
    best = told.groupBy(*PAGE).agg(F.max_by(F.struct("current_page", "total_pages", "label", "score", "block_id"), F.struct(~F.col("_lone"), F.round("score", 6), -F.col("block_id"), -F.col("_k"))).alias("m"))
    block = ["m.block_id"] if with_block else []
    return best.select(*PAGE, "m.current_page", "m.total_pages", "m.label", F.round("m.score", 4).alias("score"), *block)


def mark_page_numbers(blocks: DataFrame, page_width: float | None = None, page_height: float | None = None) -> DataFrame:
    """Blocks with ``is_page_number``: whether the page's reference stands in them."""
    found = detect_page_reference(blocks, page_width, page_height, with_block=True).select(*PAGE, "block_id", F.lit(True).alias("_is"))
    return blocks.join(found, [*PAGE, "block_id"], "left").withColumn("is_page_number", F.coalesce("_is", F.lit(False))).drop("_is")


#: Phrases of a cover page in folded text, with their weights (fixed values).
COVER_PHRASES = [
    ("phieu chinh dinh ro le bao ve", 0.20),
    ("mo ta chung", 0.18),
    ("thiet bi duoc bao ve", 0.18),
    ("nguyen tac hoat dong", 0.18),
    ("muc dich ban hanh phieu", 0.16),
    ("yeu cau cua trung tam dieu do", 0.10),
]


#: Cover scores below this are no signature (fixed value).
LEAST_COVER = 0.20


def page_evidence(blocks: DataFrame, phrases: list[tuple[str, float]] | None = None, ticket: str = TICKET, references: DataFrame | None = None) -> DataFrame:
    """Per page: cover score (weights of the phrases found, at most 1), ticket number (the top-most, then the surest, then the first by
    name), number of blocks and warnings; those on the page reference need ``references`` from ``detect_page_reference``."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_id", "text"))), lambda b: b["text"]), " ")
    sure = -F.coalesce(F.col("recognition_score"), F.lit(0.0)) if "recognition_score" in blocks.columns else F.lit(0.0)
    tickets = F.min(F.when(F.col("text").rlike(ticket), F.struct("y1", sure.alias("s"), F.array_min(F.regexp_extract_all("text", F.lit(ticket), F.lit(0))).alias("t"))))
    pages = blocks.groupBy(*PAGE).agg(fold_text(lines).alias("_text"), tickets["t"].alias("ticket_number"), F.count(F.lit(1)).alias("n_blocks"))
    score = sum((F.when(F.contains("_text", F.lit(p)), w).otherwise(0.0) for p, w in phrases or COVER_PHRASES), F.lit(0.0))
    pages = pages.withColumn("cover_score", F.round(F.least(F.lit(1.0), score), 4))
    warned = [F.when(F.col("cover_score") < LEAST_COVER, "no_cover_signature")]
    if references is not None:
        pages = pages.join(references.select(*PAGE, "current_page", "total_pages"), PAGE, "left")
        warned = [F.when(F.col("current_page").isNull(), "pagination_not_detected").when(F.col("total_pages").isNull(), "pagination_total_missing"), *warned]
    return pages.select(*PAGE, "cover_score", "ticket_number", "n_blocks", F.concat_ws(",", *warned).alias("warnings"))


def semantic_roles(rows: DataFrame, page_width: float) -> DataFrame:
    """Role and confidence of each block of (row_id) by its code shape, colon, centring and capitals, or place in the row."""
    height = F.col("y2") - F.col("y1")
    letters, capitals = F.length(F.regexp_replace("text", r"\P{L}", "")), F.length(F.regexp_replace("text", r"\P{Lu}", ""))
    upper = F.when(letters > 0, capitals / letters).otherwise(0.0)
    place = F.row_number().over(W.partitionBy(*PAGE, "row_id").orderBy("x1", "block_id"))
    sized = rows.withColumns({"_median": F.median(height).over(W.partitionBy(*PAGE)), "_place": place, "_t": F.trim("text")})
    centred = F.abs((F.col("x1") + F.col("x2")) / 2 / page_width - 0.5) <= 0.18
    heading = centred & (F.length("_t") <= 120) & (height >= 1.08 * F.col("_median")) & (upper >= 0.55)
    value = (F.col("_place") > 1) & (F.col("_t").rlike(r"(?i)\d|[<>=±%Ω]|(?<![\p{L}\p{N}_])(ms|s|A|V|kV|Hz|Ohm)(?![\p{L}\p{N}_])") | (F.col("x1") / page_width >= 0.32))
    role = (
        F.when(F.col("_t").rlike(r"^([A-Za-z]{1,4}[- ]?)?\d{2,4}\.\d{2,4}(\.\d{1,4})?(\b|\s|$)"), F.struct(F.lit("parameter_code"), F.lit(0.92)))
        .when(F.endswith("_t", F.lit(":")) & (F.length("_t") <= 100), F.struct(F.lit("parameter_name"), F.lit(0.78)))
        .when(heading, F.struct(F.lit("section_heading"), F.lit(0.72)))
        .when(value, F.struct(F.lit("parameter_value"), F.lit(0.58)))
        .when(F.col("_place") > 1, F.struct(F.lit("parameter_name"), F.lit(0.42)))
        .otherwise(F.struct(F.lit("unassigned"), F.lit(0.0)))
    )
    out = sized.withColumn("_r", role)
    return out.select(*PAGE, "block_id", F.col("_r.col1").alias("role"), F.col("_r.col2").alias("role_confidence"))


#: Limits of the spatial relations in text heights (fixed values).
ROW_TOLERANCE, COLUMN_TOLERANCE, FAR, FAR_ON_AXIS, LEAST_OVERLAP = 0.75, 2.0, 8.0, 12.0, 0.20
RELATIONS = ("above", "below", "left", "right", "same_row", "same_column", "same_row_right")


class Arrays:
    """For arrays what relations take of columns; missing numbers (NaN) are passed over, as nulls are."""

    lit, abs = float, np.abs
    greatest, least = (lambda *x: reduce(np.fmax, x)), (lambda *x: reduce(np.fmin, x))


def _measured(box, anchor, m=F) -> tuple:
    """Centres of both boxes (across, down, then the anchor's), gaps, errors and overlaps, each in rows and in columns."""
    (x1, y1, x2, y2), (ax1, ay1, ax2, ay2) = box, anchor
    scale = m.greatest(m.lit(1.0), (y2 - y1 + ay2 - ay1) / 2)
    centres = cx, cy, ax, ay = (x1 + x2) / 2, (y1 + y2) / 2, (ax1 + ax2) / 2, (ay1 + ay2) / 2
    overlaps = overlap_1d(y1, y2, ay1, ay2, m=m), overlap_1d(x1, x2, ax1, ax2, m=m)
    errors = m.abs(cy - ay) / scale, m.least(m.abs(x1 - ax1), m.abs(cx - ax), m.abs(x2 - ax2)) / scale
    gap = lambda a1, a2, b1, b2: m.greatest(m.lit(0.0), m.greatest(a1, b1) - m.least(a2, b2)) / scale
    return centres, (gap(x1, x2, ax1, ax2), gap(y1, y2, ay1, ay2)), errors, overlaps


SIDEWAYS, ON_AXIS = ("left", "right", "same_row", "same_row_right"), ("same_row", "same_column", "same_row_right")


def relation_of(box: list[Column], anchor: list[Column], r: Column) -> dict[str, Column]:
    """matched, distance, alignment, overlap, score and reason of a box (x1..y2) and an anchor's."""
    (cx, cy, ax, ay), (gap_x, gap_y), (row_error, column_error), (down, across) = _measured(box, anchor)
    sideways = r.isin(*SIDEWAYS)
    limit = F.when(r.isin(*ON_AXIS), FAR_ON_AXIS).otherwise(FAR)
    distance, alignment, overlap = F.when(sideways, gap_x).otherwise(gap_y), F.when(sideways, row_error).otherwise(column_error), F.when(sideways, down).otherwise(across)
    way = F.when(r == "above", cy < ay).when(r == "below", cy > ay).when(r == "left", cx < ax).when(r.isin("right", "same_row_right"), cx > ax).otherwise(F.lit(True))
    strict = row_error <= ROW_TOLERANCE
    aligned = F.when(r.isin("same_row", "same_row_right"), strict).when(sideways, (down >= LEAST_OVERLAP) | strict).otherwise((across >= LEAST_OVERLAP) | (column_error <= COLUMN_TOLERANCE))
    near = distance <= limit
    matched = way & aligned & near
    reason = F.when(~way, "direction_mismatch").when(~aligned, "axis_alignment_mismatch").when(~near, "normalized_distance_exceeded").otherwise("relation_matched")
    score = F.when(matched, F.greatest(F.lit(0.0), 1 - distance / limit)).otherwise(0.0)
    return {"matched": matched, "distance": F.round(distance, 4), "alignment": F.round(alignment, 4), "overlap": F.round(overlap, 4), "score": F.round(score, 4), "reason": reason}


def relate(pairs: DataFrame, relation: Column) -> DataFrame:
    """Adds matched, distance, alignment, overlap, score and reason of candidate (x1..y2) to anchor (ax1..ay2)."""
    return pairs.withColumns(relation_of([F.col(k) for k in BOX], [F.col(f"a{k}") for k in BOX], relation))


def rounded(x: np.ndarray) -> np.ndarray:
    """To four digits as ``F.round`` does: of two equally near, up, by the digits that the number is written with."""
    scaled = x * 1e4
    out = np.floor(scaled + 0.5) / 1e4
    for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    return out


def relation_scores(boxes: np.ndarray, anchors: np.ndarray, r: str) -> np.ndarray:
    """Score of each box (a row x1..y2) with each anchor's as ``relate`` tells it, -1 where they don't match."""
    (cx, cy, ax, ay), (gap_x, gap_y), (row_error, column_error), (down, across) = _measured(boxes.T[:, :, None], anchors.T[:, None, :], Arrays)
    sideways, limit = r in SIDEWAYS, FAR_ON_AXIS if r in ON_AXIS else FAR
    distance = gap_x if sideways else gap_y
    ways = {"above": cy < ay, "below": cy > ay, "left": cx < ax, "right": cx > ax, "same_row_right": cx > ax}
    strict = row_error <= ROW_TOLERANCE
    aligned = strict if r in ("same_row", "same_row_right") else (down >= LEAST_OVERLAP) | strict if sideways else (across >= LEAST_OVERLAP) | (column_error <= COLUMN_TOLERANCE)
    matched = ways.get(r, True) & aligned & (distance <= limit)
    return np.where(matched, rounded(np.fmax(0.0, 1 - distance / limit)), -1.0)


def with_spatial_evidence(candidates: DataFrame, topology: DataFrame, anchors: DataFrame) -> DataFrame:
    """The candidates with topology_score, anchor_score, anchor_id and cap; the fields' rules and anchors are small and come to each task."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    cell = F.regexp_extract(F.coalesce("source_cell", F.lit("")), r"(?:^|:)(cover_row_\d+:(?:right_primary|right_secondary|left|right))(?::|$)", 1)
    region = (cx >= F.col("page_width") * 0.5) & (cy <= F.col("page_height") * 0.22)
    hit = lambda t: F.when((t["kind"] == "page_region") & (t["expected"] == "top_right_header"), region.cast("double")).when((t["kind"] == "cover_slot") & (cell != ""), (cell == t["expected"]).cast("double")).when(t["kind"] == "source_policy", 1.0)

    def scored(a):
        told = relation_of([F.col(c) for c in BOX], [a[f"a{c}"] for c in BOX], a["relation"])
        return F.struct(told["score"].alias("score"), a["anchor_id"].alias("anchor_id"), told["matched"].alias("matched"))

    rules = topology.groupBy("field").agg(F.collect_list(F.struct("kind", "expected")).alias("_rules"))
    placed = anchors.groupBy("field").agg(F.collect_list(F.struct("relation", "anchor_id", *(f"a{c}" for c in BOX))).alias("_anchors"))
    rows = candidates.join(F.broadcast(rules), "field", "left").join(F.broadcast(placed), "field", "left").withColumn("_related", F.transform("_anchors", scored))
    best = F.array_max(F.transform(F.filter("_related", lambda a: a["matched"]), lambda a: F.struct(a["score"], a["anchor_id"].alias("anchor_id"))))
    told = {
        "topology_score": F.array_min(F.transform("_rules", hit)), "anchor_score": F.coalesce(F.array_max(F.transform("_related", lambda a: a["score"])), F.lit(0.0)), "anchor_id": best["anchor_id"],
    }
    rows = rows.withColumns(told).withColumn("cap", F.when(F.coalesce(F.col("topology_score") == 0, F.lit(False)), "LOW"))
    return rows.withColumn("topology_score", F.coalesce("topology_score", F.lit(0.0))).drop("_rules", "_anchors", "_related")


def spatial_evidence(candidates: DataFrame, topology: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per candidate: the least score of its region and slot rules, the best anchor's score and id, and a cap on any mismatch.

    candidates: candidate_id, field, source_cell, page_width, page_height, x1..y2; topology: field,
    kind (page_region, cover_slot, source_policy: met by any value), expected; anchors: field, relation, anchor_id, ax1..ay2.
    """
    return with_spatial_evidence(candidates, topology, anchors).select("candidate_id", "field", "topology_score", "anchor_score", "anchor_id", "cap")


def with_value_checks(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (field, value, ...) with ``checks``: of each active rule of the field, its status and whether it is required; null without a rule."""
    rule = ["kind", "options", "pattern", "low", "high", "required"]
    told = rules.filter("active and kind is not null").groupBy("field").agg(F.collect_list(F.struct(*rule)).alias("_rules"))
    checked = lambda r: F.struct(check_value(F.col("value"), *(r[c] for c in rule))["status"].alias("status"), r["required"].alias("required"))
    return values.join(F.broadcast(told), "field", "left").withColumn("checks", F.transform("_rules", checked)).drop("_rules")


def _share_passed(passed: Column, evaluated: Column) -> Column:
    return F.when(evaluated == 0, 0.0).otherwise(F.round(passed / evaluated, 4))


def value_signal(checks: Column) -> tuple[Column, Column]:
    """Share of passed rules, and a cap if a required one failed, of one value's ``checks``."""
    n = lambda test: F.coalesce(F.size(F.filter(checks, test)), F.lit(0))
    broken = F.coalesce(F.exists(checks, lambda c: (c["status"] == "failed") & c["required"]), F.lit(False))
    return _share_passed(n(lambda c: c["status"] == "passed"), n(lambda c: c["status"].isin("passed", "failed"))), F.when(broken, "LOW")


def validate_values(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Per value (value_id, field, value): share of passed rules, status, and a cap if a required rule failed.

    rules: field, kind, options, pattern, low, high, required, active.
    """
    pairs = values.join(rules.filter("active"), "field", "left")
    checked = pairs.withColumn("_c", F.when(F.col("kind").isNotNull(), check_value(*(F.col(c) for c in ("value", "kind", "options", "pattern", "low", "high", "required")))))
    s = F.col("_c.status")
    agg = checked.groupBy("value_id").agg(F.count_if(s == "passed").alias("passed"), F.count_if(s.isin("passed", "failed")).alias("evaluated"), F.count_if((s == "failed") & F.col("required")).alias("broken"))
    status = F.when(F.col("broken") > 0, "failed").when(F.col("evaluated") == 0, "not_evaluated").when(F.col("passed") == F.col("evaluated"), "passed").otherwise("partial")
    return agg.select("value_id", status.alias("status"), _share_passed(F.col("passed"), F.col("evaluated")).alias("score"), F.when(F.col("broken") > 0, "LOW").alias("cap"))


#: Weights of the six signals of a candidate (fixed values).
WEIGHTS = {"topology": 25.0, "anchor": 25.0, "alias": 15.0, "separator": 15.0, "value_validation": 15.0, "ocr_confidence": 5.0}


def score_candidates(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds raw_score, score (capped by the level in ``cap``) and level from the signals' columns (null: 0)."""
    points = sum((F.round(F.coalesce(F.col(k), F.lit(0.0)) * w, 4) for k, w in (weights or WEIGHTS).items()), F.lit(0.0))
    ceiling = F.create_map(*(F.lit(x) for kv in CEILINGS.items() for x in kv))[F.col("cap")]
    out = candidates.withColumn("raw_score", F.round(points, 4)).withColumn("score", F.round(F.least("raw_score", F.coalesce(ceiling, F.lit(100.0))), 4))
    return out.withColumn("level", confidence_level(F.col("score")))


def document_result(fields: DataFrame, settings: DataFrame, warnings: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One row for each document: its fields by name, settings numbered within pages, notes, warnings, and whether it needs review.

    fields: document_id, field, value, status, confidence (may be absent); settings: document_id, page_number, place, name, value;
    warnings: document_id, code; notes: document_id, page_number, place, text.  A note asks for review.
    """
    if notes is None:
        notes = settings.limit(0).select("document_id", "page_number", "place", F.col("name").alias("text"))
    if "confidence" not in fields.columns:
        fields = fields.withColumn("confidence", F.lit(None).cast("double"))
    f = fields.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("field", "value", "status", "confidence"))).alias("fields"), F.bool_or(F.col("status") == "review_required").alias("_review"))
    number = F.row_number().over(W.partitionBy("document_id", "page_number").orderBy("place"))
    s = settings.withColumn("number", number).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "number", "name", "value"))).alias("settings"))
    w = warnings.groupBy("document_id").agg(F.array_sort(F.collect_set("code")).alias("warnings"))
    n = notes.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "place", "text"))).alias("notes"))
    out = f.join(s, "document_id", "full").join(w, "document_id", "full").join(n, "document_id", "full")
    empty = {"fields": f.schema["fields"].dataType, "notes": n.schema["notes"].dataType, "warnings": "array<string>"}
    out = out.withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in empty.items()}).withColumn("settings", F.coalesce("settings", F.filter("settings", lambda _: F.lit(False)), F.array().cast(s.schema["settings"].dataType)))
    return out.withColumn("review", F.coalesce("_review", F.lit(False)) | (F.size("warnings") > 0) | (F.size("notes") > 0)).drop("_review")


def validate_result(pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Violations (document_id, rule) of a result's contract.

    pages: document_id, page_number, role, status, payload, artifact_id; artifacts: document_id,
    artifact_id, path.
    """
    per = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_number").alias("d"), F.min("page_number").alias("lo"), F.max("page_number").alias("hi"))
    role = F.when(F.col("page_number") == 1, "cover").when(F.col("page_number") == 2, "skipped").otherwise("detail")
    found = [
        per.filter("n <> d").select("document_id", F.lit("pages_not_unique").alias("rule")),
        per.filter("lo <> 1 or hi - lo + 1 <> d").select("document_id", F.lit("pages_not_contiguous").alias("rule")),
        pages.filter(F.col("role") != role).select("document_id", F.lit("wrong_role").alias("rule")),
        pages.filter((F.col("status") == "done") != F.col("payload").isNotNull()).select("document_id", F.lit("status_without_payload").alias("rule")),
        pages.filter("artifact_id is not null").join(artifacts, ["document_id", "artifact_id"], "left_anti").select("document_id", F.lit("unknown_artifact").alias("rule")),
        artifacts.filter(F.col("path").rlike(r"^(/|[A-Za-z]:[\\/])|(^|[\\/])\.\.([\\/]|$)")).select("document_id", F.lit("path_not_relative").alias("rule")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


#: Keys that a public payload must not hold (fixed values).
FORBIDDEN_KEYS = ("exception", "image_path", "input_pdf", "model_object", "output_root", "raw_ocr", "stack_trace", "stacktrace", "temporary_path", "traceback")


def envelope_violations(results: DataFrame, warnings: DataFrame, pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Violations (document_id, rule) of the rules between a result's status and its parts.

    results: document_id, status (success, success_with_warnings, else failed), review_status, page_count, business (JSON or null), error;
    warnings: document_id; pages: document_id, page_number, review_status; evidence (fields to review, settings, notes): document_id.
    """
    count = F.count(F.lit(1))
    warned = warnings.groupBy("document_id").agg(count.alias("_warnings"))
    paged = pages.groupBy("document_id").agg(count.alias("_pages"), F.max("page_number").alias("_last"), F.bool_or(F.col("review_status") == "review_required").alias("_page_review"))
    nested = evidence.groupBy("document_id").agg(count.alias("_evidence"))
    rows = results.join(warned, "document_id", "left").join(paged, "document_id", "left").join(nested, "document_id", "left")
    good, n = F.col("status").isin("success", "success_with_warnings"), F.coalesce("_warnings", F.lit(0))
    to_review = F.coalesce("_page_review", F.lit(False)) | (F.coalesce("_evidence", F.lit(0)) > 0)
    no_review = ~F.col("review_status").eqNullSafe("review_required")
    covered = (F.coalesce("_pages", F.lit(0)) == F.col("page_count")) & (F.coalesce("_last", F.lit(0)) == F.col("page_count"))
    value = r'[:\[,]\s*"(?:/|\\\\\\\\|[A-Za-z]:(?:\\\\|/))(?!(?:[^"\\]|\\.)*"\s*:)'
    rules = {
        "success_has_warnings": (F.col("status") == "success") & (n > 0),
        "warnings_missing": (F.col("status") == "success_with_warnings") & (n == 0),
        "success_without_payload": good & (F.col("business").isNull() | F.col("page_count").isNull()),
        "success_has_error": good & F.col("error").isNotNull(),
        "pages_do_not_cover": good & ~covered,
        "review_not_raised": good & to_review & no_review,
        "failed_has_business": ~good & F.col("business").isNotNull(),
        "failed_without_error": ~good & F.col("error").isNull(),
        "failed_without_review": ~good & no_review,
        "forbidden_key": F.col("business").rlike(r'(?i)[{,]\s*"(?:' + "|".join(FORBIDDEN_KEYS) + r')"\s*:'),
        "absolute_path": F.col("business").rlike(value),
    }
    broken = F.array_compact(F.array(*(F.when(holds, name) for name, holds in rules.items())))
    return rows.select("document_id", F.explode(broken).alias("rule"))


def rule_tables(default: DataFrame, overlay: DataFrame, known_kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rules (field, kind, argument, status, origin, author) after a user's overlay, and the overlay's invalid rows with reasons.

    The overlay may only add, to known fields, with a known kind, the origin ``user`` and an author;
    rules that aren't active don't count.
    """
    fields = default.select("field").distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("_known").isNull(), "unknown_field").when(~F.col("kind").isin(known_kinds), "unknown_kind").when(F.coalesce(F.col("origin"), F.lit("")) != "user", "wrong_origin").when(F.coalesce(F.trim("author"), F.lit("")) == "", "author_missing")
    judged = overlay.join(fields, "field", "left").withColumn("reason", reason)
    good = judged.filter("reason is null").select(default.columns)
    return default.unionByName(good).filter(F.coalesce("status", F.lit("active")) == "active").distinct(), judged.filter("reason is not null").select(*overlay.columns, "reason")


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Folded aliases that stand for several fields: (alias, fields)."""
    rows = aliases.select(fold_text(F.col("alias")).alias("alias"), "field").distinct()
    return rows.groupBy("alias").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
