"""Small inputs with exact outputs for the operators that SQL can't check, and the sources."""

import datetime
import hashlib
import json
import random
import re
import tempfile
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.functions import scalars as S
from assetlens.operators import aggregates as D
from assetlens.operators import filters as B
from assetlens.operators import joins as C
from assetlens.operators import layout as L
from assetlens.operators import pages as P
from assetlens.operators import versions as V
from assetlens.operators.resolution import resolve_fields, sibling_evidence
from assetlens.plans import catalog
from assetlens.sources import readers as A


def blocks(spark, rows, high=18.0):
    """rows: (text, x, y); boxes of 70 by ``high``."""
    data = [(1, 3, k, t, float(x), float(y), float(x) + 70, float(y) + high) for k, (t, x, y) in enumerate(rows)]
    return spark.createDataFrame(data, "document_id long, page_number int, block_id int, text string, x1 double, y1 double, x2 double, y2 double")


@pytest.mark.parametrize(
    "a, b, want",
    [("5", "5.0", False), ("5", "5 A", True), (None, None, False), (None, "", True), ("nan", "nan", True), ("1d", "1", True), ("1e2", "100", False), ("x", "x", False), ("inf", "Infinity", False), (" 7 ", "7", False)],
)
def test_differs(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(S.differs(F.col("a"), F.col("b"))).first()[0] is want


def test_next_occurrence_keeps_time_and_clamps(spark):
    rows = [("2024-01-31 10:11:12", 1, "M", "2024-02-29 10:11:12"), ("2024-02-29 01:00:00", 1, "y", "2025-02-28 01:00:00"), ("2024-02-29 01:00:00", 3, "e", None), ("2024-02-29 01:00:00", 3, "?", "2024-02-29 02:00:00")]
    df = spark.createDataFrame(rows, "t string, n int, u string, want string")
    out = df.select(S.next_occurrence(F.col("t").cast("timestamp"), F.col("n"), F.col("u")).cast("string").alias("got"), "want").collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_fold_text(spark):
    df = spark.createDataFrame([("PHIẾU chỉnh  Định—Rơ-le!",), ("Đường dây",)], "t string")
    assert [r[0] for r in df.select(S.fold_text(F.col("t"))).collect()] == ["phieu chinh dinh ro le", "duong day"]
    assert df.select(S.fold_text(F.col("t"), False)).collect()[1][0] == "uong day"


@pytest.mark.parametrize(
    "kind, value, options, want",
    [
        ("unit_suffix", "20 A", ["A"], True), ("endswith", "220 kV", ["kv"], True), ("startswith", "MC 273", ["mc"], True), ("enum", "ĐÓNG", ["đóng"], True), ("numeric", "10,5", None, True), ("numeric", "10,5x", None, False),
        ("version", "V6.7.0.2", None, True), ("ticket_number", "A1-29-2026/E5.8/220", None, True), ("page_reference", "7/5", None, False), ("page_reference", "5 / 7", None, True), ("year", "2026", None, True),
    ],
)
def test_check_value(spark, kind, value, options, want):
    df = spark.createDataFrame([(value, kind, options, None, None, None, True)], "v string, k string, o array<string>, p string, l double, h double, r boolean")
    assert (df.select(S.check_value(*(F.col(c) for c in "vkoplhr")).alias("c")).first()["c"]["status"] == "passed") is want


def test_search_is_literal(spark):
    df = spark.createDataFrame([("50% off", "a_b"), ("x", "aXb")], "a string, b string")
    assert B.search_any(df, "%", ["a", "b"]).count() == 1 and B.search_any(df, "A_B", ["a", "b"]).count() == 1 and B.search_any(df, "", ["a"]).count() == 2


@pytest.mark.parametrize("page, want", [("2", 2), ("x", 1), ("99", 3), ("0", 3), (None, 1)])
def test_paginate(spark, page, want):
    rows = B.paginate(spark.range(25), page, 10, F.col("id")).collect()
    assert {r["page"] for r in rows} == {want} and [r["id"] for r in rows] == list(range((want - 1) * 10, min(25, want * 10)))


@pytest.mark.parametrize("page, want", [("2", 2), ("x", 1), ("99", 17), (None, 1), (16, 16)])
def test_paginate_by_index(spark, page, want, monkeypatch):
    """Pages from the index are those of a plain sort: nulls, ties, a hot value, descending order."""
    monkeypatch.setattr(B, "TOP_ROWS", 0)
    data = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"v{i % 7}") for i in range(161)]
    df = spark.createDataFrame(data, "id long, v string").repartition(5)
    rows = B.paginate(df, page, 10, F.desc_nulls_first("v"), F.col("id")).collect()
    plain = sorted(data, key=lambda r: r[0])
    plain = [r for r in plain if r[1] is None] + sorted((r for r in plain if r[1]), key=lambda r: r[1], reverse=True)
    assert [(r["id"], r["v"]) for r in rows] == plain[(want - 1) * 10 : want * 10]
    assert {(r["page"], r["pages"], r["total"]) for r in rows} == {(want, 17, 161)}


def test_page_index(spark, monkeypatch):
    monkeypatch.setattr(B, "TOP_ROWS", 0)
    index = B.PageIndex(spark.range(1000).repartition(7), F.desc("id"))
    assert sorted((r["place"], r["id"]) for r in index.numbered().collect()) == [(k + 1, 999 - k) for k in range(1000)]
    assert [r["id"] for r in index.span(0, 1000).collect()] == list(range(999, -1, -1)) and index.span(1000, 5).count() == 0
    repeated = B.PageIndex(spark.createDataFrame([("a",)] * 50 + [(None,)] * 3, "v string"), F.col("v"))
    assert [r["v"] for r in repeated.span(0, 60).collect()] == [None] * 3 + ["a"] * 50 and repeated.total == 53
    empty = spark.range(0)
    assert B.paginate(empty, 3, 10, F.col("id")).count() == 0 and B.PageIndex(empty, F.col("id")).numbered().count() == 0


def test_previous_version_is_strictly_earlier(spark):
    rows = [(1, 7, "2024-01-01"), (2, 7, "2024-01-02"), (3, 7, "2024-01-02"), (4, 7, "2024-01-03"), (5, None, "2024-01-01")]
    df = spark.createDataFrame(rows, "id long, device_id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert {r["id"]: r["previous_id"] for r in V.previous_version(df).collect()} == {1: None, 2: 1, 3: 1, 4: 3, 5: None}


def test_explode_parameters(spark):
    df = spark.createDataFrame([(1, '[{"parameter_code":"a","value":"1"},{"parameter_code":"","value":"2"},{"parameter_code":"a","value":3}]'), (2, '{"b": 5, "c": null}'), (3, None)], "sheet_id long, params string")
    assert sorted((r["sheet_id"], r["code"], r["value"]) for r in V.explode_parameters(df, "params").collect() if r["value"]) == [(1, "a", "3"), (2, "b", "5")]


def test_upsert_keeps_unmapped_columns(spark):
    target = spark.createDataFrame([("a", "old", 1), ("b", "keep", 2)], "code string, name string, extra int")
    batch = spark.createDataFrame([(1, "", "a", "x"), (2, "a", None, None), (3, "", "", "lost"), (4, "n", "q", "new")], "place int, c1 string, c2 string, title string")
    got = {r["code"]: (r["name"], r["extra"]) for r in V.upsert_by_code(target, batch, ["c1", "c2"], {"name": "title"}, "place").collect()}
    assert got == {"a": ("", 1), "b": ("keep", 2), "n": ("new", None)}


def test_merge_spans(spark):
    labels = ["I-KEY", "B-KEY", "I-KEY", "O", "I-VAL", "I-VAL", "B-VAL"]
    rows = [(1, k, f"w{k}", x, 1.0, float(k), 0.0, float(k + 1), 1.0) for k, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "document_id long, place int, text string, label string, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r["first_place"], r["last_place"], r["entity"], r["text"]) for r in V.merge_spans(df).collect()) == [(0, 0, "KEY", "w0"), (1, 2, "KEY", "w1 w2"), (4, 5, "VAL", "w4 w5"), (6, 6, "VAL", "w6")]
    assert [r["place"] for r in V.sequence_violations(df, ["B-KEY", "I-KEY", "B-VAL", "I-VAL", "O"]).orderBy("place").collect()] == [0, 4]


def scored(spark, *rows):
    return V.rank_candidates(spark.createDataFrame([("f", i, s, c) for i, s, c in rows], "field string, candidate_id string, score double, constrained boolean")).first()


def test_rank_candidates(spark):
    assert scored(spark, ("a", 70.0, False), ("b", 55.0, False))["status"] == "auto_selected"
    assert scored(spark, ("a", 69.0, False))["reasons"] == "below_auto_select_minimum"
    assert scored(spark, ("a", 70.0, False), ("b", 56.0, False))["reasons"] == "winner_margin_below_minimum"
    assert scored(spark, ("b", 70.0, True), ("a", 70.0, False))["leader"] == "a"


def test_capped_score(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "LOW"), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None)], "topology double, anchor double, alias double, separator double, value_validation double, ocr_confidence double, cap string")
    got = P.score_candidates(df).collect()
    assert (got[0]["score"], got[0]["level"], got[1]["score"], got[1]["level"]) == (39.9999, "LOW", 100.0, "VERY_HIGH")


def pages_of(*rows):
    return [dict(zip(("page_index", "current_page", "total_pages", "cover_score", "ticket_number"), r)) for r in rows]


def spans(pages):
    return [(s["start_page"], s["end_page"]) for s in L.split_pages(pages)]


def test_segments():
    numbered = pages_of((1, 1, 3, 0.5, "A"), (2, 2, 3, 0.0, None), (3, 3, 3, 0.0, None), (4, 1, 2, 0.5, "B"), (5, 2, 2, 0.0, None))
    assert spans(numbered) == [(1, 3), (4, 5)]
    assert spans(pages_of((1, None, None, 0.6, None), (2, None, None, 0.0, None), (3, None, None, 0.6, None), (4, None, None, 0.0, None))) == [(1, 2), (3, 4)]
    assert spans(pages_of((1, 1, 5, 0.5, None), (2, 1, None, 0.0, None))) == [(1, 2)]  # page 1 alone makes no boundary
    orphan = L.split_pages(pages_of((1, 1, 1, 0.6, None), (2, 2, 3, 0.0, None)))
    assert orphan[1]["start_reasons"] == "after_terminal_page" and "segment_does_not_start_at_logical_page_1" in orphan[1]["warnings"]
    changed = L.split_pages(pages_of((1, 1, None, 0.5, "A"), (2, 2, None, 0.0, "A"), (3, None, None, 0.3, "B")))
    assert [s["ticket_number"] for s in changed] == ["A", "B"]
    gap = L.split_pages(pages_of((1, 1, None, 0.5, None), (2, None, None, 0.0, None), (3, 3, None, 0.0, None)))
    assert "jump" not in gap[0]["warnings"]


def test_page_of_codes(spark):
    df = blocks(spark, [("09.05", 50, 100), ("Active Group", 200, 101), ("Group 1", 420, 100), ("09.0A", 50, 130), ("Setting Group 4", 200, 129), ("Disabled", 420, 130)])
    got = {(r["record_id"], r["role"]): r["text"] for r in L.records(L.reconstruct_page(df)).collect()}
    assert got[2, "parameter_code"] == "09.0A" and got[2, "parameter_name"] == "Setting Group 4" and got[2, "value"] == "Disabled"


def test_continuation_and_groups(spark):
    rows = [("0103", 50, 100), ("Name one", 200, 100), ("On", 420, 100), ("of two lines", 200, 122), ("0104", 50, 150), ("Name two", 200, 150), ("Off", 420, 150), ("OTHER SETTINGS", 50, 180), ("0105", 50, 210), ("Name three", 200, 210), ("5 A", 420, 210)]
    rows = L.reconstruct_page(blocks(spark, rows))
    kinds = [r["row_type"] for r in rows.orderBy("row_id").collect()]
    assert kinds == ["record", "continuation", "record", "group", "record"]
    texts = {(r["record_id"], r["role"]): (r["text"], r["group_id"]) for r in L.records(rows).collect()}
    assert texts[1, "parameter_name"] == ("Name one of two lines", 0) and texts[3, "parameter_name"] == ("Name three", 1)


def test_values_in_two_columns(spark):
    rows = []
    for k in range(3):
        rows += [(str(k + 1), 50, 100 + 40 * k), (f"Item {k}", 160, 100 + 40 * k), (f"v{k}", (320, 480)[k % 2], 100 + 40 * k)]
    rows += [("9", 50, 220), ("Item 9", 160, 220), ("w", 480, 220), ("10", 50, 260), ("Item 10", 160, 260), ("z", 320, 260)]
    got = [r["role"] for r in L.infer_roles(blocks(spark, rows)).orderBy("column").collect()]
    assert got == ["record_key", "parameter_name", "value", "value"]


def test_code_records(spark):
    rows = [("GENERAL SETTINGS", 50, 60), ("040.076", 50, 100), ("Starting", 200, 100), ("040.077 Starting IN>", 420, 100), ("040.078", 50, 140), ("Ending", 200, 140), ("Off", 420, 140), ("and more", 420, 160)]
    got = [(r["kind"], r["code"], r["value"]) for r in L.group_code_records(blocks(spark, rows)).orderBy("row_id").collect()]
    assert got == [("section", None, None), ("record", "040.076", "040.077 Starting IN>"), ("record", "040.078", "Off and more")]


def test_aliases(spark):
    df = blocks(spark, [("Trạm: E5 Ngăn lộ: 273 MC", 10, 10), ("the relay type is here", 10, 40), ("Type: 7SJ62", 10, 70)])
    got = [(r["block_id"], r["field"], r["value"]) for r in L.match_aliases(df, [("Trạm", "station"), ("Ngăn lộ", "bay"), ("Ngăn", "other"), ("type", "model"), ("relay type", "model"), ("type", "kind")]).orderBy("block_id", "start", "field").collect()]
    assert got == [(0, "station", "E5"), (0, "bay", "273 MC"), (2, "kind", "7SJ62"), (2, "model", "7SJ62")]


def test_aliases_without_accents(spark):
    df = blocks(spark, [("TRAM: E5 ngan lo: 273", 10, 10), ("Tra\u0323m: E6", 10, 40), ("Đường dây: 1", 10, 70)])
    got = [(r["alias"], r["start"], r["value"]) for r in L.match_aliases(df, [("Trạm", "station"), ("Ngăn lộ", "bay"), ("duong day", "line")]).orderBy("block_id", "start").collect()]
    assert got == [("trạm", 0, "E5"), ("ngăn lộ", 9, "273"), ("trạm", 0, "E6"), ("duong day", 0, "1")]


def test_block_jobs_need_no_shuffle(spark, capsys):
    L.split_embedded_labels(L.match_aliases(blocks(spark, [("a", 0, 0)]), [("a", "b")]).selectExpr("document_id", "page_number", "block_id", "value AS text", "0D AS x1", "0D AS y1", "1D AS x2", "1D AS y2"), ["a"]).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_wide_block_belongs_to_the_column_at_its_centre():
    row = L.Row([L.Block(1, "wide", 50.0, 0.0, 400.0, 10.0), L.Block(2, "x", 420.0, 0.0, 440.0, 10.0)])
    assert L.cells_of(row, [50.0, 200.0, 420.0]) == ["", "wide", "x"]


def test_embedded_labels(spark):
    got = [(r["text"], r["x1"]) for r in L.split_embedded_labels(blocks(spark, [("Unit: A Range: 1-5", 0, 0)]), ["Unit", "Range"]).orderBy("part").collect()]
    assert [t for t, _ in got] == ["Unit: A", "Range: 1-5"] and got[0][1] == 0 < got[1][1]


def test_cover_and_labelled_fields(spark):
    rows = [(f"L{k}: v{k}", 10, 20 + 40 * k) for k in range(7)] + [("free text", 400, 20)]
    got = {r["field"]: r["value"] for r in L.cover_fields(blocks(spark, rows), {(0, "left"): "a", (0, "right"): "b", (6, "left"): "c"}).collect()}
    assert got == {"a": "v0", "b": "free text", "c": "v6"}
    rows = [("Station", 10, 10), ("E5.8", 200, 10), ("Purpose: test", 10, 40), ("Ticket", 10, 70), ("A1-29", 10, 95)]
    got = {r["field"]: (r["value"], r["warning"]) for r in L.labelled_fields(blocks(spark, rows), {"station": ["Station"], "purpose": ["Purpose"], "ticket": ["Ticket"], "model": ["Model"]}, ("model",)).collect()}
    assert got == {"station": ("E5.8", None), "purpose": ("test", None), "ticket": ("A1-29", None), "model": (None, "missing_required_field:model")}


def test_label_over_two_lines(spark):
    rows = [("Purpose of", 10, 10), ("the ticket", 10, 32), ("to test", 200, 32), ("Device", 10, 100), ("model: 7SJ", 10, 122)]
    got = {r["field"]: r["value"] for r in L.labelled_fields(blocks(spark, rows), {"purpose": ["Purpose of the ticket"], "model": ["Device model"], "other": ["Purpose at"]}, ("other",)).collect()}
    assert got == {"purpose": "to test", "model": "7SJ", "other": None}


def test_confidence_of_code_records(spark):
    rows = [("040.076", 50, 100), ("Starting", 200, 100), ("On", 420, 100), ("040.078", 50, 140), ("Off", 420, 140), ("and more", 420, 160), ("040.079", 50, 200)]
    assert [r["confidence"] for r in L.group_code_records(blocks(spark, rows)).orderBy("row_id").collect()] == [0.85, 0.84, 0.46]


def test_anchors_and_tables(spark):
    rows = [(f"a{k}", 10, 30 * k) for k in range(4)] + [(f"b{k}", 200 + k, 30 * k) for k in range(4)]
    df = blocks(spark, rows)
    assert [r["support"] for r in L.column_anchors(df).orderBy("x").collect()] == [4, 4]
    table = L.table_candidates(df).first()
    assert table["n_rows"] == 4 and table["alignment"] == 1.0 and (table["x1"], table["y2"]) == (10.0, 108.0)
    assert L.build_rows(df, "overlap").agg(F.max("row_id")).first()[0] == 3


def test_resolve_fields(spark):
    df = blocks(spark, [("Station: E5", 10, 10), ("Model: 7SJ", 10, 40), ("Model: 7UT", 10, 70)])
    existing = spark.createDataFrame([(1, "station", None), (1, "model", None), (1, "ticket", "kept"), (1, "other", None)], "document_id long, field string, value string")
    none = "field string, kind string, options array<string>, pattern string, low double, high double, required boolean, active boolean", "field string, kind string, expected string", "field string, relation string, anchor_id string, ax1 double, ay1 double, ax2 double, ay2 double"
    args = [spark.createDataFrame([], s) for s in none]
    got = {r["field"]: (r["value"], r["status"]) for r in resolve_fields(existing, df, [("Station", "station"), ("Model", "model")], *args, [], 900.0, 900.0).collect()}
    assert got == {"station": ("E5", "auto_selected"), "model": (None, "review_required"), "ticket": ("kept", "preserved_existing"), "other": (None, "not_available")}


def test_metrics(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "O"), ("O", "O"), ("B", "A")], "gold string, predicted string")
    got = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in D.prf_metrics(df).collect()}
    assert got == {"A": (1, 1, 1), "B": (0, 0, 1), "micro": (1, 1, 2)}
    assert D.status_counts(df.filter("false").withColumnRenamed("gold", "status"), {"a": ("A",)}).first()["a"] == 0


def test_span_metrics(spark):
    tags = [("B-A", "B-A"), ("I-A", "I-A"), ("O", "O"), ("I-B", "I-B"), ("I-B", "O"), ("B-B", "B-B"), ("O", None)]
    df = spark.createDataFrame([(1, k, g, p) for k, (g, p) in enumerate(tags)], "document_id long, place int, gold string, predicted string")
    got = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in D.span_metrics(df).collect()}
    assert got == {"A": (1, 0, 0), "B": (1, 1, 1), "micro": (2, 1, 1)}
    assert [r["class"] for r in D.span_metrics(df.limit(0)).collect()] in ([], ["micro"])


@pytest.mark.parametrize(
    "period, start, end, want",
    [
        ("this_month", None, None, ("2024-05-01", "2024-05-20", False)), ("this_year", None, None, ("2024-01-01", "2024-05-20", True)), ("7d", None, None, ("2024-05-14", "2024-05-20", False)), ("custom", "2024-03-01", "2024-01-01", ("2024-01-01", "2024-03-01", False)),
        ("custom", "2023-01-01", "2024-01-01", ("2023-01-01", "2024-01-01", True)), ("custom", "x", "2024-01-01", ("2024-05-14", "2024-05-20", False)), ("custom", "2024-05-01", "x", ("2024-05-01", "2024-05-20", False)), ("custom", None, "2024-01-01", ("2024-05-14", "2024-05-20", False)),
    ],
)
def test_period_bounds(period, start, end, want):
    first, last, monthly = D.period_bounds(period, datetime.date(2024, 5, 20), start, end)
    assert (first.isoformat(), last.isoformat(), monthly) == want


def test_start_after_today_with_bad_end_is_empty(spark):
    df = spark.createDataFrame([("2024-05-01",)], "created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert D.activity_by_period(df, "custom", datetime.date(2024, 5, 20), "2024-06-01", "x").count() == 0


PAGE_BLOCKS = "document_id long, page_number int, block_id int, text string, x1 double, y1 double, x2 double, y2 double"


def references(spark, *rows):
    """rows: (text, x1, y1, x2) on a page of 1000 by 1400."""
    df = spark.createDataFrame([(1, 1, k, t, float(x), float(y), float(r), float(y) + 20) for k, (t, x, y, r) in enumerate(rows)], PAGE_BLOCKS)
    return [(r["current_page"], r["total_pages"], r["label"]) for r in P.detect_page_reference(df, 1000.0, 1400.0).collect()]


def test_page_reference(spark):
    ticket = ("A1-29-2026/E5.8/220", 700, 40, 900)
    for label in ("Page", "Tờ", "Leaf marker"):
        assert references(spark, (f"{label}: 1/7", 700, 80, 800)) == references(spark, (label, 600, 80, 690), ("1/7", 700, 80, 760)) == [(1, 7, label)]
    assert references(spark, ("1/7", 100, 80, 160)) == []  # left half
    assert references(spark, ("1/7", 700, 600, 760)) == []  # below the header
    assert references(spark, ticket, ("2/7", 300, 80, 900), ("1/7", 710, 80, 760)) == [(1, 7, None)]  # away from the ticket
    assert references(spark, ticket, ("x", 600, 80, 690), ("3", 710, 80, 730)) == [(3, None, "x")]
    assert references(spark, ("3", 710, 80, 730)) == []  # a lone number needs the ticket
    assert references(spark, ("7/5 and 2/5 and 3/5", 700, 80, 900)) == [(2, 5, "7/5 and")]


def test_ticket_of_page_by_score(spark):
    df = spark.createDataFrame([(1, 1, 0, "A1-1-2026/E5/1", 10.0, 0.2), (1, 1, 1, "B1-1-2026/E5/1", 10.0, 0.9), (1, 1, 2, "C1-1-2026/E5/1", 50.0, 1.0)], "document_id long, page_number int, block_id int, text string, y1 double, recognition_score double")
    row = P.page_evidence(df, references=df.limit(0).selectExpr("document_id", "page_number", "1 AS current_page", "1 AS total_pages")).first()
    assert (row["ticket_number"], row["warnings"]) == ("B1-1-2026/E5/1", "pagination_not_detected,no_cover_signature")


@pytest.mark.parametrize("business, want", [('{"a":"C:\\\\x"}', ["absolute_path"]), ('{"a":"b/c","/k":1}', []), ('{"a":["/x"]}', ["absolute_path"]), ('{"a":"\\\\\\\\srv"}', ["absolute_path"]), ('{"a":{"Traceback":1}}', ["forbidden_key"]), ('{"a":"traceback"}', [])])
def test_public_payload(spark, business, want):
    results = spark.createDataFrame([(1, "success", "none", 1, business, None)], "document_id long, status string, review_status string, page_count int, business string, error string")
    pages = spark.createDataFrame([(1, 1, None)], "document_id long, page_number int, review_status string")
    none = pages.limit(0)
    assert [r["rule"] for r in P.envelope_violations(results, none, pages, none).collect()] == want


def test_envelopes(spark, tmp_path):
    rows = [{"id": 1, "name": "x"}, {"id": 2, "name": None}]
    for k, shape in enumerate(([{"lst": rows}], {"lst": rows}, rows)):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.json").write_text(json.dumps(shape, indent=1))
        assert sorted((r["id"], r["name"]) for r in A.read_envelope(spark, str(tmp_path / str(k)), "id:int,name:string").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="neither a list"):
        A.read_envelope(spark, str(tmp_path / "bad"), "id:int").collect()


def test_csv_and_sinks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("h1,h2,h3\n a , b \n ,x,y\nc,d,e\n")
    rows = A.read_positional_csv(spark, str(tmp_path / "in.csv"), ["p", "q", "r"])
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "b", ""), ("c", "d", "e")]
    df = spark.createDataFrame([(1, 3, ["a", "b"], "n")], "document_id int, page_number int, vals array<string>, name string")
    A.write_record_csv(df, str(tmp_path / "csv"), ["vals"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["vals"] == "a | b"
    A.write_page_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["page_number"] == 3
    A.write_xml(df, str(tmp_path / "xml"), "records", "record")
    assert spark.read.format("xml").option("rowTag", "record").load(str(tmp_path / "xml")).first()["vals"] == ["a", "b"]
    (tmp_path / "files" / "sub").mkdir(parents=True)
    (tmp_path / "files" / "sub" / "x.json").write_bytes(b"{}")
    row = A.content_manifest(spark, str(tmp_path / "files")).first()
    assert (row["path"], row["size"], row["media_type"]) == ("sub/x.json", 2, "application/json") and len(row["sha256"]) == 64


def test_folders_by_document(spark, tmp_path):
    """One file for each document, named as by partitionBy and moved by no driver; what is read back is what was written."""
    rows = [(d, k, f"v,{k}" if k else None) for d in (*(f"d{i}" for i in range(3000)), "a/b=c", "é ü") for k in range(2)] + [(None, 7, 'x"y'), ("", 8, "z\\")]
    df = spark.createDataFrame(rows, "document_id string, n int, name string")
    path = f"file://{tmp_path}/csv"
    for _ in range(2):  # the second time over the first
        A.write_record_csv(df, path, [])
    files = [p.relative_to(tmp_path / "csv").parts for p in (tmp_path / "csv").rglob("*.csv")]
    assert len(files) == 3003 and all(len(p) == 2 and p[1] == "part.csv" for p in files)
    want = sorted(((d or None, n, name) for d, n, name in rows), key=repr)
    back = A.read_folders(spark, path, "document_id string", head=True).select("document_id", F.from_csv("value", "n int, name string").alias("r")).select("document_id", "r.*")
    assert sorted(map(tuple, back.collect()), key=repr) == want
    plain = spark.read.schema("n int, name string, document_id string").csv(path, header=True).select("document_id", "n", "name")
    assert sorted(map(tuple, plain.collect()), key=repr) == want
    A.write_page_json(spark.createDataFrame([(1, p, "l1\nl2") for p in range(3)], "document_id long, page_number int, text string"), f"{tmp_path}/json")
    assert sorted(p.parent.name for p in (tmp_path / "json").rglob("part.json")) == [f"page_number={p}" for p in range(3)]
    assert {r["value"] for r in A.read_folders(spark, f"{tmp_path}/json", "document_id long, page_number int").collect()} == {'{"text":"l1\\nl2"}'}


def test_aliases_of_a_long_block(spark):
    """What follows a label is read up to the next blank, not to the end of the block."""
    n = 20_000
    df = spark.createDataFrame([(1, 1, 1, "the: a " * n + "other THE", 0.0, 0.0, 9.0, 9.0), (1, 1, 2, " the A1", 0.0, 0.0, 9.0, 9.0), (1, 1, 3, "bathe: x", 0.0, 0.0, 9.0, 9.0), (1, 1, 4, "the a", 0.0, 0.0, 9.0, 9.0)], PAGE_BLOCKS)
    found = L.match_aliases(df, [("the", "station")])
    began = time.perf_counter()
    rows = found.groupBy("block_id", "separated").count().collect()
    assert time.perf_counter() - began < 10
    assert sorted(map(tuple, rows)) == [(1, True, n), (2, False, 1)]


def test_siblings_meet_by_box(spark):
    """Of candidates in one box the last id is told, to every candidate of the other field."""
    box = lambda y: (0.0, y, 50.0, y + 10)
    made = [(f"a{k:04}", 1, 1, "station", *box(0.0)) for k in range(2000)] + [(f"b{k:04}", 1, 1, "purpose", *box(20.0)) for k in range(2000)] + [("c", 1, 1, "purpose", *box(900.0))]
    candidates = spark.createDataFrame(made, "candidate_id string, document_id long, page_number int, field string, x1 double, y1 double, x2 double, y2 double")
    rules = spark.createDataFrame([("purpose", "below", "station")], "field string, relation string, anchor_field string")
    rows = sibling_evidence(candidates, rules).collect()
    assert len(rows) == 2000 and {(r["sibling_id"], r["sibling_score"]) for r in rows} == {("a1999", 0.875)}


def page_of(spark, boxes):
    """boxes: (text, x1, y1) of 70 by 18, or (text, x1, y1, x2, y2)."""
    rows = [(1, 1, k, b[0], *map(float, b[1:] if len(b) == 5 else (b[1], b[2], b[1] + 70, b[2] + 18))) for k, b in enumerate(boxes)]
    return spark.createDataFrame(rows, PAGE_BLOCKS)


def grid_of(spark, across, down):
    return spark.createDataFrame([(1, 1, 1, [float(x) for x in across], [float(y) for y in down])], "document_id long, page_number int, region int, across array<double>, down array<double>")


FOUR = (80, 180, 350, 650, 900)


def read_records(spark, boxes, grid=None):
    rows = L.reconstruct_page(page_of(spark, boxes), grid).orderBy("row_id").collect()
    records = L.records(L.reconstruct_page(page_of(spark, boxes), grid)).collect()
    out = {}
    for r in records:
        out.setdefault(r["record_id"], {})[r["role"]] = r["text"]
    return [r["row_type"] for r in rows], [out[k] for k in sorted(out)]


def line_of(y, *cells):
    return [(text, x, y) for text, x in cells if text]


def test_three_columns_without_grid(spark):
    kinds, found = read_records(spark, line_of(100, ("Code", 100), ("Parameter", 300), ("Value", 700)) + line_of(140, ("09.0A", 100), ("Setting Group 4", 300), ("Disabled", 700)))
    assert found[-1] == {"parameter_code": "09.0A", "parameter_name": "Setting Group 4", "value": "Disabled"}
    kinds, found = read_records(spark, line_of(100, ("0103", 100), ("Parameter one", 300), ("Enabled", 700)) + line_of(140, ("0104", 100), ("Parameter two", 300), ("Disabled", 700)))
    assert kinds == ["record", "record"] and found[1]["parameter_code"] == "0104"


def test_headings_of_a_grid_by_its_lines(spark):
    heads = line_of(100, ("Group/Attributes", 160), ("Value Set", 514), ("Unit", 694), ("Description", 788))
    data = line_of(140, ("AI1_Ch1_Ratio", 160), ("1100", 514), ("-", 694), ("For AC analog input ch#1", 788))
    grid = grid_of(spark, (156, 510, 691, 783, 1462), (90, 120, 160))
    kinds, found = read_records(spark, heads + data, grid)
    assert kinds == ["table_header", "record"]
    assert found == [{"parameter_name": "AI1_Ch1_Ratio", "value": "1100", "unit": "-", "description": "For AC analog input ch#1"}]
    layout = L.page_layouts(page_of(spark, heads + data), grid).first()
    assert layout["region_roles"] == {"1": "parameter_name,value,unit,description"} and layout["family"] == "bon_cot_can_chinh"
    assert (layout["n_rows"], layout["n_columns"], layout["n_regions"], layout["n_groups"], layout["n_records"], layout["n_blocks"]) == (2, 4, 1, 0, 1, 8)


def test_merged_heading_keeps_the_usual_roles(spark):
    boxes = line_of(100, ("Index Item", 100), ("Description", 400), ("Setting", 800)) + line_of(140, ("2", 100), ("21D", 220), ("Distance protection", 400), ("Enable", 800))
    layout = L.page_layouts(page_of(spark, boxes), grid_of(spark, FOUR, (90, 120, 160))).first()
    assert layout["region_roles"] == {"1": "record_key,parameter_name,description,value"}


def test_two_columns_of_values_are_one_field(spark):
    boxes = [b for k, (x, v) in enumerate(((500, "Disabled"), (800, "Definite Time only"), (500, "Enabled"), (800, "50 Hz"))) for b in line_of(100 + 30 * k, (f"010{3 + k}", 100), (f"Parameter {k}", 300), (v, x))]
    _, found = read_records(spark, boxes)
    assert [r["value"] for r in found] == ["Disabled", "Definite Time only", "Enabled", "50 Hz"] and all("description" not in r for r in found)


def test_bands_of_a_grid_part_tall_boxes(spark):
    boxes = [("12", 100, 125, 160, 158), ("50/51P1", 210, 123, 330, 146), ("Enable stage 1", 380, 123, 620, 146), ("Enable", 700, 123, 820, 146), ("13", 100, 145, 160, 180), ("50/51P2", 210, 163, 330, 184), ("Enable stage 2", 380, 163, 620, 184), ("Disable", 700, 163, 820, 184)]
    _, found = read_records(spark, boxes, grid_of(spark, FOUR, (120, 160, 200)))
    assert [r["record_key"] for r in found] == ["12", "13"]
    crossing = {r["row_id"]: r["crossing"] for r in L.reconstruct_page(page_of(spark, [*boxes, ("wide", 100, 205, 400, 220)]), grid_of(spark, FOUR, (120, 160, 200, 240))).collect()}
    assert crossing == {0: [], 1: [4], 2: [8]}


def test_rows_that_go_on_and_rows_that_do_not(spark):
    kinds, found = read_records(spark, line_of(100, ("0103", 100), ("Parameter one", 300), ("Enabled", 700)) + line_of(130, ("", 0), ("Parameter two", 300), ("Disabled", 700)))
    assert kinds == ["record", "record"] and found[1]["parameter_name"] == "Parameter two"
    kinds, found = read_records(spark, line_of(100, ("0103", 100), ("Long parameter", 300), ("Enabled", 700)) + line_of(130, ("0104", 100), ("Second parameter", 300), ("Disabled", 700)) + line_of(160, ("continued description", 300)))
    assert kinds == ["record", "record", "continuation"] and found[1]["parameter_name"] == "Second parameter continued description"


def test_groups_metadata_and_page_numbers(spark):
    boxes = line_of(20, ("Số phiếu", 100), ("A1", 300)) + line_of(60, ("GENERAL", 100)) + line_of(100, ("0103", 100), ("One", 300), ("On", 700)) + line_of(140, ("LINE", 100)) + line_of(180, ("0104", 100), ("Two", 300), ("Off", 700)) + line_of(220, ("7", 700))
    df = page_of(spark, boxes).withColumn("is_page_number", F.col("block_id") == 10)
    rows = L.reconstruct_page(df).orderBy("row_id").collect()
    assert [(r["row_type"], r["group_id"]) for r in rows] == [("document_metadata", 0), ("group", 1), ("record", 1), ("group", 2), ("record", 2), ("document_metadata", 2)]
    layouts = L.page_layouts(df)
    assert layouts.first()["groups"] == ["GENERAL", "LINE"] and layouts.first()["family"] == "ba_cot_can_chinh"
    assert L.document_layouts(layouts.unionByName(layouts.withColumn("page_number", F.lit(2)))).first().asDict() == {"document_id": 1, "pages": 2, "records": 4, "families": {"ba_cot_can_chinh": 2}}


def test_page_number_blocks_are_marked(spark):
    df = page_of(spark, [("Page", 600, 80, 690, 100), ("1/7", 700, 80, 760, 100), ("text", 100, 900, 300, 920), ("1/9", 100, 80, 160, 100)])
    assert [r["block_id"] for r in P.mark_page_numbers(df, 1000.0, 1400.0).filter("is_page_number").collect()] == [1]


def test_smallest_bands_are_merged():
    def by_scan(lines, bands):
        lines = list(lines)
        while len(lines) - 1 > bands:
            k = min(range(len(lines) - 1), key=lambda i: lines[i + 1] - lines[i])
            lines.pop(k or 1)
        return lines

    r = random.Random(4)
    for _ in range(200):
        lines = sorted(r.sample(range(1000), r.randint(3, 30)))
        bands = r.randint(1, 8)
        assert L.merged_lines(lines, bands) == by_scan(lines, bands)
    assert L.merged_lines([0, 100, 103, 200], 2) == [0, 103, 200] and L.merged_lines([0, 4, 100], 1) == [0, 100]


COVER = {(0, "left"): "equipment", (0, "right"): "kind", (1, "left"): "breaker", (1, "right_primary"): "relay", (1, "right_secondary"): "version", (6, "right"): "circuit"}


def test_cover_table_by_lines(spark):
    boxes = [
        ("Thiết bị được bảo vệ:", 10, 120, 200, 145), ("MC 273", 350, 120, 480, 145), ("Loại bảo vệ: so lệch", 510, 120, 740, 145), ("dọc", 760, 120, 800, 145),
        ("Máy cắt", 10, 220, 100, 245), ("273", 350, 220, 420, 245), ("Tên rơ-le: 7SD", 510, 220, 700, 245), ("Phiên bản", 810, 220, 880, 245), ("V4.8", 930, 220, 990, 245), ("Mạch", 510, 720, 560, 745),
    ]
    small = grid_of(spark, (0, 500, 1000), (10, 60, 90)).withColumn("region", F.lit(2))
    grid = grid_of(spark, (0, 500, 800, 1000), (100, 103, 200, 300, 400, 500, 598, 600, 700, 800)).unionByName(small)
    got = {r["field"]: (r["slot"], r["label"], r["value"]) for r in L.cover_fields(page_of(spark, boxes), COVER, grids=grid).collect()}
    assert got == {
        "equipment": ("cover_row_0:left", "Thiết bị được bảo vệ", "MC 273"), "kind": ("cover_row_0:right", "Loại bảo vệ", "so lệch dọc"), "breaker": ("cover_row_1:left", "Máy cắt", "273"),
        "relay": ("cover_row_1:right_primary", "Tên rơ-le", "7SD"), "version": ("cover_row_1:right_secondary", "Phiên bản", "V4.8"), "circuit": ("cover_row_6:right", "Mạch", None),
    }
    assert L.cover_fields(page_of(spark, boxes), COVER, grids=small).count() == 0


def test_slots_of_the_cover_table():
    assert L.cover_slots([0, 500, 800, 1000]) == {"left": (0, 500), "right": (500, 1000), "right_primary": (500, 800), "right_secondary": (800, 1000)}
    assert L.cover_slots([0, 100, 1000])["right_primary"] == (500, 810)  # neither a middle nor a second line
    assert L.cover_slots([0, 600, 820, 840, 1000])["right_secondary"] == (830, 1000)


FIELDS = {"relay": ["Tên rơ-le"], "software": ["Phần mềm"], "relay_version": ["Phiên bản"], "software_version": ["Phiên bản"], "breaker": ["Máy cắt"], "ratio": ["Tỷ số/ chỉ danh biến dòng điện"], "maker": ["Hãng sản xuất", "Nhà sản xuất"], "purpose": ["Mục đích ban hành phiếu chỉnh định"], "station": ["Trạm"]}
VERSIONS = {"relay_version": "relay", "software_version": "software"}


def fields_of(spark, boxes, grid=None, **more):
    return {r["field"]: r["value"] for r in L.labelled_fields(page_of(spark, boxes), FIELDS, versions=VERSIONS, grids=grid, **more).collect()}


def test_versions_belong_to_the_thing_beside(spark):
    boxes = [("Tên rơ-le:", 520, 120, 640, 145), ("PCS-902 Phiên bản: V2.1", 650, 120, 940, 145), ("Phần mềm:", 520, 200, 640, 225), ("PCSExplorer Phiên bản: V3.4", 650, 200, 950, 225)]
    want = {"relay": "PCS-902", "relay_version": "V2.1", "software": "PCSExplorer", "software_version": "V3.4"}
    assert fields_of(spark, boxes, grid_of(spark, (0, 500, 1000), (100, 180, 260))) == want == fields_of(spark, boxes)
    assert fields_of(spark, boxes[:3]) == {"relay": "PCS-902", "relay_version": "V2.1"}  # the version is too far from the software


def test_labels_over_two_lines_and_equal_wordings(spark):
    boxes = [("Tỷ số/ chỉ danh biến", 10, 115, 210, 140), ("dòng điện:", 10, 140, 120, 165), ("1500/5A (TI272)", 250, 120, 430, 150), ("Nhà sản xuất: AREVA", 520, 220, 820, 250)]
    assert fields_of(spark, boxes, grid_of(spark, (0, 500, 1000), (100, 200, 300))) == {"ratio": "1500/5A (TI272)", "maker": "AREVA"}


def test_values_go_down_to_a_rule_or_the_next_label(spark):
    boxes = [("Mục đích ban hành phiếu chỉnh định:", 100, 500, 500, 525), ("Cải tạo", 550, 500, 800, 525), ("nhánh 220kV", 550, 530, 800, 555), ("Trạm: E5.8", 100, 600, 300, 625)]
    assert fields_of(spark, boxes) == {"purpose": "Cải tạo nhánh 220kV", "station": "E5.8"}
    rule = grid_of(spark, (90, 900), (528,))
    assert fields_of(spark, boxes, rule) == {"purpose": "Cải tạo", "station": "E5.8"}
    aside = grid_of(spark, (900, 990), (528,))  # a rule elsewhere on the page
    assert fields_of(spark, boxes, aside)["purpose"] == "Cải tạo nhánh 220kV"


def test_short_labels_in_values_and_repeated_texts(spark):
    boxes = [("Máy cắt", 10, 100, 100, 125), ("Máy cắt liên lạc 220kV", 150, 100, 400, 125)]
    assert fields_of(spark, boxes) == {"breaker": "Máy cắt liên lạc 220kV"}
    assert fields_of(spark, [("MAY CAT 273", 10, 100, 100, 125), ("273", 150, 100, 200, 125), ("273 MC", 250, 100, 300, 125)]) == {"breaker": "273 MC"}
    got = L.labelled_fields(page_of(spark, [("Trạm:", 10, 10, 60, 30)]), FIELDS, ("station", "maker")).collect()
    assert sorted((r["field"], r["warning"]) for r in got) == [("maker", "missing_required_field:maker"), ("station", "empty_required_field:station")]
    boxes = [("Trạm: E", 10, 100, 100, 125), ("220kV Hoành Bồ", 150, 100, 300, 125)]
    assert fields_of(spark, boxes, least={"station": 5}) == {"station": "220kV Hoành Bồ"}


NONE = {"rules": "field string, kind string, options array<string>, pattern string, low double, high double, required boolean, active boolean", "topology": "field string, kind string, expected string", "anchors": "field string, relation string, anchor_id string, ax1 double, ay1 double, ax2 double, ay2 double", "siblings": "field string, relation string, anchor_field string"}


def resolved(spark, boxes, existing, aliases, locked=(), cover=(), **given):
    tables = {k: spark.createDataFrame(given.get(k, []), schema) for k, schema in NONE.items()}
    known = spark.createDataFrame(existing, "document_id long, field string, value string, page_number int, blocks array<int>, x1 double, y1 double, x2 double, y2 double, source_cell string, confidence double, alias double, separator double")
    out = resolve_fields(known, page_of(spark, boxes), aliases, tables["rules"], tables["topology"], tables["anchors"], list(locked), 1000.0, 1400.0, tables["siblings"], list(cover))
    return {r["field"]: r for r in out.collect()}


def null_field(name):
    return (1, name, *[None] * 11)


def test_existing_values_are_candidates_without_their_duplicates(spark):
    there = (1, "model", "7SJ 62", 1, [0], 10.0, 10.0, 200.0, 30.0, None, 0.9, 1.0, 1.0)
    boxes = [("Model: 7sj-62", 10, 10, 200, 30), ("Model: 7UT", 10, 300, 200, 320)]
    got = resolved(spark, boxes[:1], [there], [("Model", "model")])["model"]
    assert (got["value"], got["status"], got["candidate_id"], got["margin"], got["reasons"]) == ("7SJ 62", "preserved_existing", "existing-1-model", None, "auto_select_conditions_satisfied")
    got = resolved(spark, boxes, [there], [("Model", "model")])["model"]  # another value stays beside it
    assert got["margin"] is not None and "winner_margin_below_minimum" in got["reasons"] and got["value"] == "7SJ 62"
    over = (*there[:4], [77], *there[5:])  # of other blocks, but over the one found
    assert resolved(spark, boxes[:1], [over], [("Model", "model")])["model"]["margin"] is None
    apart = (*over[:5], 500.0, 10.0, 600.0, 30.0, *over[9:])
    assert resolved(spark, boxes[:1], [apart], [("Model", "model")])["model"]["margin"] is not None


def test_values_beside_bare_aliases_and_separators(spark):
    boxes = [("Station:", 10, 10, 90, 30), ("E5.8", 120, 10, 200, 30), ("Model:", 10, 60, 90, 80), ("7SJ", 10, 90, 90, 110)]
    got = resolved(spark, boxes, [null_field("station"), null_field("model")], [("Station", "station"), ("Model", "model")])
    assert {f: (r["value"], r["status"]) for f, r in got.items()} == {"station": ("E5.8", "auto_selected"), "model": ("7SJ", "auto_selected")}
    bare = resolved(spark, [("Model 7SJ", 10, 60, 90, 80)], [null_field("model")], [("Model", "model")])["model"]
    assert bare["score"] == 85.0 and got["model"]["score"] == 100.0  # a separator adds, its lack takes nothing away


def test_sibling_fields_are_anchors(spark):
    boxes = [("Relay: 7SD", 510, 100, 700, 120), ("Version: V4.8", 720, 100, 900, 120), ("Version: V9", 720, 400, 900, 420)]
    aliases = [("Relay", "relay"), ("Version", "version")]
    alone = resolved(spark, boxes, [null_field("relay"), null_field("version")], aliases)["version"]
    assert (alone["value"], alone["status"], alone["margin"]) == (None, "review_required", 0.0)
    got = resolved(spark, boxes, [null_field("relay"), null_field("version")], aliases, siblings=[("version", "same_row_right", "relay")])["version"]
    assert (got["value"], got["status"], got["anchor_id"]) == ("V4.8", "auto_selected", "1-1-0-0-relay") and got["margin"] >= 15


def test_cover_fields_need_a_slot_or_an_anchor(spark):
    boxes, aliases = [("Relay: 7SD", 510, 100, 700, 120), ("Maker: AREVA", 720, 100, 900, 120)], [("Relay", "relay"), ("Maker", "maker")]
    fields = [null_field("relay"), null_field("maker")]
    got = resolved(spark, boxes, fields, aliases, cover=["maker"], locked=["relay"])
    assert (got["maker"]["value"], got["maker"]["status"]) == (None, "review_required") and got["maker"]["reasons"].endswith("cover_ownership_evidence_required")
    assert got["relay"]["reasons"].endswith("structure_owned_null_not_overridden") and got["relay"]["value"] is None
    got = resolved(spark, boxes, fields, aliases, cover=["maker"], siblings=[("maker", "right", "relay")])
    assert (got["maker"]["value"], got["maker"]["status"]) == ("AREVA", "auto_selected")
    slot = (1, "maker", "ABB", 1, [5], 720.0, 100.0, 900.0, 120.0, "table_01:cover_row_3:right", 0.9, 1.0, 1.0)
    got = resolved(spark, boxes, [slot], aliases, topology=[("maker", "cover_slot", "cover_row_3:right")])["maker"]
    assert got["value"] == "ABB" and got["candidate_id"] == "existing-1-maker"
    got = resolved(spark, boxes, [slot], aliases, topology=[("maker", "source_policy", "right_cell")])["maker"]
    assert got["value"] == "ABB" and got["candidate_id"] == "1-1-1-0-maker"  # read more surely


def below_by_hand(boxes, apart):
    out = []
    for i, x1, y1, x2, y2 in boxes:
        near = [(b1, j) for j, a1, b1, a2, _ in boxes if j != i and b1 >= y2 and abs(a1 + a2 - x1 - x2) / 2 <= max(a2 - a1, x2 - x1, apart)]
        if near:
            top, j = min(near)
            out.append((i, j, top - y2))
    return out


def test_neighbours_below():
    r = random.Random(8)
    for n in (1, 2, 7, 60):
        for _ in range(30):
            boxes = [(k, float(x := r.randrange(-50, 900)), float(y := r.randrange(0, 800, 10)), float(x + r.choice((0, 5, 60, 400))), float(y + r.choice((0, 10, 30)))) for k in range(n)]
            assert sorted(C.nearest_below(boxes, 36.0)) == sorted(below_by_hand(boxes, 36.0))


def test_neighbours_of_a_long_page():
    r = random.Random(9)
    boxes = [(k, float(x := r.randrange(900)), float(12 * k), float(x + r.choice((10, 60, 300))), 12.0 * k + 10) for k in range(10_000)]
    began = time.perf_counter()
    found = C.nearest_below(boxes, 36.0)
    assert len(found) >= 9_990 and time.perf_counter() - began < 20
    assert max(g for _, _, g in found) < 12 * 60


def test_no_page_is_multiplied_out(spark):
    """Pairs that meet in squares are far fewer than blocks times cells, and none is missed."""
    rows = [(1, 1, k, 7.0 * (k % 90), 9.0 * k, 7.0 * (k % 90) + 40 + k % 300, 9.0 * k + 8 + k % 50) for k in range(300)]
    df = spark.createDataFrame(rows, "document_id long, page_number int, block_id int, x1 double, y1 double, x2 double, y2 double")
    cells = spark.range(600).selectExpr("1L AS document_id", "1 AS page_number", "CAST(id DIV 6 AS INT) AS row", "CAST(id % 6 AS INT) AS col", "150D * (id % 6) AS cx1", "27D * (id DIV 6) AS cy1", "150D * (id % 6) + 150 AS cx2", "27D * (id DIV 6) + 27 AS cy2")
    met = C.touching(df, cells, {"x": ("x1", "x2", "cx1", "cx2"), "y": ("y1", "y2", "cy1", "cy2")})
    touch = "x1 <= cx2 AND x2 >= cx1 AND y1 <= cy2 AND y2 >= cy1"
    assert met.filter(touch).count() == df.crossJoin(cells.drop("document_id", "page_number")).filter(touch).count() == met.filter(touch).select("block_id", "row", "col").distinct().count()
    assert met.count() < 0.1 * 300 * 600


def test_sources_whose_pages_are_not_one_to_n_are_refused():
    page = {"current_page": None, "total_pages": None, "ticket_number": None, "cover_score": 0.0}
    for indices in ([1, 3], [2, 3], [1, 1, 2]):
        (row,) = L.split_pages([{**page, "page_index": i} for i in indices])
        assert (row["segment"], row["warnings"], row["start_page"], row["end_page"]) == (0, "pages_are_not_1_to_n", indices[0], indices[-1])
    assert [s["segment"] for s in L.split_pages([{**page, "page_index": i} for i in (2, 1)])] == [1]


# --- groups as streams


def test_pages_pass_as_one_stream(spark):
    """Pages cut by a batch's end stay whole, and no page costs a call of its own."""
    rows = [(d, p, k, f"w{k}", float(200 * (k % 2)), 20.0 * (k // 2), 200.0 * (k % 2) + 50, 20.0 * (k // 2) + 12) for d in range(40) for p in (1, 2) for k in range(7)]
    blocks = spark.createDataFrame(rows, "document_id long, page_number int, block_id long, text string, x1 double, y1 double, x2 double, y2 double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for df in (L.build_rows(blocks), L.reconstruct_page(blocks)):
            assert "MapInArrow" in (plan := df._jdf.queryExecution().toString()) and "FlatMap" not in plan
        found = L.build_rows(blocks).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len(rows) and all(r.row_id == r.block_id // 2 and r.place == r.block_id % 2 for r in found)


def test_page_without_a_box_and_grid_without_blocks(spark):
    schema = "document_id long, page_number int, block_id long, text string, x1 double, y1 double, x2 double, y2 double"
    blocks = spark.createDataFrame([(1, 1, 1, None, None, None, None, None), (1, 1, 2, "a b", 0.0, 0.0, 50.0, 10.0)], schema)
    grids = spark.createDataFrame([(2, 1, 1, [0.0, 9.0], [0.0, 5.0, 9.0])], "document_id long, page_number int, region int, across array<double>, down array<double>")
    assert [(r.document_id, r.n_blocks) for r in L.page_layouts(blocks, grids).collect()] == [(1, 1)]


def test_segment_warnings_tell_whole_numbers(spark):
    """A page without pagination in the source must not turn the others' numbers into decimals."""
    pages = spark.createDataFrame([(1, 1, 1, 9, "T", 0.6), (1, 2, None, None, None, 0.0), (1, 3, 7, 9, "T", 0.0)], "source long, page_index long, current_page long, total_pages long, ticket_number string, cover_score double")
    (row,) = L.segment_pages(pages).collect()
    assert "pagination_jump:1->7" in row.warnings and "physical_page_count_mismatch:3!=9" in row.warnings and row.expected_pages == 9


def test_boxes_meet_within_their_page(spark):
    """One pass by page, whether the boxes come one by one or a page in a row; none is dealt to squares in a shuffle."""
    schema = "document_id long, page_number int, block_id int, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame([(d, 1, k, 40.0 * k, 30.0 * k, 40.0 * k + 200, 30.0 * k + 20) for d in (1, 2) for k in range(20)] + [(1, 1, 99, None, 0.0, 9.0, 9.0), (3, 1, 0, 0.0, 0.0, 9.0, 9.0)], schema)
    flat = spark.range(400).selectExpr("1 + id % 2 AS document_id", "1 AS page_number", "CAST(id DIV 8 AS INT) AS row", "CAST(id DIV 2 % 4 AS INT) AS col", "250D * (id DIV 2 % 4) AS cx1", "13D * (id DIV 8) AS cy1", "250D * (id DIV 2 % 4) + 250 AS cx2", "13D * (id DIV 8) + 13 AS cy2")
    paged = flat.groupBy("document_id", "page_number").agg(F.collect_list(F.struct("row", "col", "cx1", "cy1", "cx2", "cy2")).alias("boxes"))
    found = []
    for cells in (flat, paged):
        met = C.touching(df, cells, {"x": ("x1", "x2", "cx1", "cx2"), "y": ("y1", "y2", "cy1", "cy2")})
        assert "Join" not in met._jdf.queryExecution().toString()
        found.append(sorted((r.document_id, r.block_id, r.row, r.col) for r in met.collect()))
    joined = df.join(flat, ["document_id", "page_number"]).filter("x1 <= cx2 AND x2 >= cx1 AND y1 <= cy2 AND y2 >= cy1")
    assert found[0] == found[1] == sorted((r.document_id, r.block_id, r.row, r.col) for r in joined.collect())


def test_capitals_keep_a_text_as_long_as_it_is(spark, tmp_path):
    """A centred line of 120 letters with ß is a heading in capitals, too; as SS it would be one too long."""
    import duckdb

    from assetlens.plans import catalog

    text = "\n".join(["x"] * 26 + ["Aß" + "b" * 118, *["x"] * 11, "ßßß ²²²² ªªª"])
    spark.createDataFrame([(1, text, "de", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = catalog.QUERIES["i10_semantic_roles"](spark, str(tmp_path)).select("block_id", "role").collect()
    assert sorted(map(tuple, found)) == sorted(c.sql(f"select block_id, role from ({catalog.SQL['i10_semantic_roles']})").fetchall())
    assert dict(map(tuple, found))[26] == "section_heading"


def test_words_of_a_long_block(spark):
    """Blocks are ordered, not words, and a long block takes time in proportion: 60,000 words at once, numbered on after the block before."""
    long = "é\t" + "ab  c d " * 30_000
    df = spark.createDataFrame([(1, 1, 2, long, 0.0, 0.0, 900.0, 10.0), (1, 1, 1, " x y", 0.0, 0.0, 40.0, 10.0), (1, 1, 3, None, 0.0, 0.0, 1.0, 1.0)], "document_id long, page_number int, block_id int, text string, x1 double, y1 double, x2 double, y2 double")
    began = time.perf_counter()
    found = P.words_from_blocks(df, 900.0, 900.0).orderBy("word_index").collect()
    assert time.perf_counter() - began < 20
    assert [r.word_index for r in found] == list(range(60_003)) and [r.text for r in found[:6]] == ["x", "y", "é", "ab", "c d", "ab"]
    assert [(r.nx1, r.nx2) for r in found[:2]] == [(11, 22), (33, 44)]


# --- pages of boxes


def test_text_stays_behind_where_boxes_are_enough(spark, monkeypatch):
    """Blocks of blanks, as Python tells blanks, are no blocks; the text of the others goes to no shuffle."""
    blanks = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    rows = [(1, 1, k, x, 0.0, 20.0 * k, 50.0, 20.0 * k + 12) for k, x in enumerate([*blanks, "".join(blanks), "", None, "\u200b", " a ", "\x00", "\U0001f600"])]
    blocks = spark.createDataFrame(rows, "document_id long, page_number int, block_id long, text string, x1 double, y1 double, x2 double, y2 double")
    shuffled, in_groups = [], L.in_groups
    monkeypatch.setattr(L, "in_groups", lambda df, *rest: shuffled.append(df.columns) or in_groups(df, *rest))
    for policy in ("baseline", "overlap"):
        assert sorted(r.block_id for r in L.build_rows(blocks, policy).collect()) == [k for k, *_ in (r[2:] for r in rows) if rows[k][3] and rows[k][3].split()]
    L.infer_columns(blocks), L.column_anchors(blocks), L.table_candidates(blocks)
    assert len(shuffled) == 5 and not any("text" in columns for columns in shuffled)


def first_row_that_fits(bs):
    rows = []
    for b in bs:
        for r in rows:
            top, bottom = min((x.y1 for x in r), default=0), max(x.y2 for x in r)
            common = min(b.y2, bottom) - max(b.y1, top)
            if common / min(b.height, max(1.0, bottom - top)) >= 0.35 or abs(b.middle - (top + bottom) / 2) <= 0.65 * max(b.height, L.median(x.height for x in r)):
                r.append(b)
                break
        else:
            rows.append([b])
    return sorted(sorted(b.id for b in r) for r in rows)


def test_overlap_rows_in_one_sweep(monkeypatch):
    rnd = random.Random(3)
    for _ in range(300):
        boxes = [(k, "x", rnd.uniform(0, 500), y := rnd.choice([20.0 * rnd.randrange(9), rnd.uniform(0, 180)]), 0.0, y + rnd.choice([0, 3, 12, 18, 18, 150, rnd.uniform(-5, 40)])) for k in range(rnd.randrange(30))]
        bs = L.page_blocks(boxes)
        assert sorted(sorted(b.id for b in r.blocks) for r in L.overlap_rows(bs)) == first_row_that_fits(bs)
    asked, median = [], L.median
    monkeypatch.setattr(L, "median", lambda values: asked.append(1) or median(values))
    long = L.page_blocks([(k, "x", 0.0, 20.0 * k, 9.0, 20.0 * k + 12) for k in range(600)] + [(999, "x", None, None, None, None)])
    assert len(L.overlap_rows(long)) == 601 and len(asked) < 1200  # some 180,000 when each row is asked for each block


def test_labels_are_told_by_the_start_of_a_text(monkeypatch):
    read, plain_letter = [], L.plain_letter
    monkeypatch.setattr(L, "plain_letter", lambda x: read.append(x) or plain_letter(x))
    label, pair = L.Wording("trạm", "station"), L.Wording("de la", "purpose")
    read.clear()
    assert L.labels_in("Trạm: " + "é " * 50_000, [label, pair]) == {label: 4}
    assert L.labels_in("é " * 50_000, [label, pair]) == {} and len(read) < 200
    for text in ("trạm" + "́" * 90 + ": x", "." * 90 + "Trạm" + " " * 90 + "A1", "trạm" + "́" * 90, "trạm" + "́" * 90 + "x", "De" + "-" * 90 + "la AB", "de", ""):
        plain, place = L.folded(text)
        assert L.labels_in(text, [label, pair]) == {w: end for w in (label, pair) if (end := w.end_in(text, plain, place)) is not None}


def test_snapshots_of_the_same_rows_are_grouped_once(spark, sf_dir):
    """The pairs of a full join, in which a field without a name or a document has no counterpart, without the join."""
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice(["a", "b", "c", None]), rnd.choice([True, False, None]), rnd.choice([1.0, 2.0, None]), rnd.choice([True, True, False]), rnd.choice([1.0, 2.0, None])) for _ in range(60)]
    for part in (rows, rows[:9], rows[:1]):
        df = spark.createDataFrame(part, "document_id long, field string, in_old boolean, old double, in_new boolean, new double")
        before, after = (df.filter(f"in_{x}").groupBy("document_id", "field").agg(F.max(x).alias("value")) for x in ("old", "new"))
        got, want = (sorted(map(str, x.collect())) for x in (D.compare_pairs(D.paired_snapshots(df)), D.compare_snapshots(before, after)))
        assert got == want
    plan = catalog.QUERIES["d13_compare_snapshots"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.split("== Physical Plan ==")[1].count("FileScan") == 1


def moved(spark, run):
    """Bytes that tasks write for others while ``run`` runs: shuffles, and tables in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = held() + shuffled()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return held() + shuffled() - before


def labelled_documents(spark, n=100):
    """Each document a page of 40 blocks with two labels and long values that don't repeat."""
    word = lambda *at: "".join(hashlib.md5(f"{at}{k}".encode()).hexdigest() for k in range(10))
    rows = [(d, 1, b, f"Station: {word(d, b, 1)} Model: {word(d, b, 2)}", 10.0, 20.0 * b, 900.0, 20.0 * b + 12) for d in range(n) for b in range(40)]
    path = tempfile.mkdtemp(prefix="blocks-")
    spark.createDataFrame(rows, PAGE_BLOCKS).write.mode("overwrite").parquet(path)
    existing = spark.createDataFrame([(d, f, None) for d in range(n) for f in ("station", "model")], "document_id long, field string, value string")
    return spark.read.parquet(path), existing, sum(len(r[3]) for r in rows)


def test_sibling_resolution_moves_texts_once(spark):
    df, existing, size = labelled_documents(spark)
    tables = {k: spark.createDataFrame([], schema) for k, schema in NONE.items() if k != "siblings"}
    siblings = spark.createDataFrame([("model", "below", "station")], NONE["siblings"])
    resolve = lambda: resolve_fields(existing, df, [("Station", "station"), ("Model", "model")], tables["rules"], tables["topology"], tables["anchors"], [], 900.0, 820.0, siblings)
    assert moved(spark, lambda: resolve().write.format("noop").mode("overwrite").save()) < 1.3 * size  # hex digits take half of their bytes


def test_relations_of_arrays_are_those_of_columns(spark):
    rng = random.Random(1)
    box = lambda: (x := rng.randrange(40) / 4, y := rng.randrange(400) / 16, x + rng.randrange(60) / 8, y + 1 + rng.randrange(5))
    boxes, anchors = [box() for _ in range(60)], [box() for _ in range(40)]
    pairs = spark.createDataFrame([(k, j, *a, *b) for k, a in enumerate(boxes) for j, b in enumerate(anchors)], "k int, j int, x1 double, y1 double, x2 double, y2 double, ax1 double, ay1 double, ax2 double, ay2 double")
    for r in P.RELATIONS:
        told = P.relation_scores(np.array(boxes), np.array(anchors), r)
        rows = P.relate(pairs, F.lit(r)).select("k", "j", "matched", "score").collect()
        assert any(x["matched"] for x in rows) and all(told[x["k"], x["j"]] == (x["score"] if x["matched"] else -1) for x in rows)
    ties = np.array([0.00005, 0.12345, 0.99995, 0.5, 1 / 3, 0.28125])
    assert P.rounded(ties).tolist() == [r[0] for r in spark.createDataFrame([(float(x),) for x in ties], "x double").select(F.round("x", 4)).collect()]


def test_values_are_folded_alike(spark):
    rows = [(chr(c), f"a{chr(c)}B  1{chr(c)}") for c in (*range(1, 0x800), *range(0x1E00, 0x2200))]
    assert all(S.folded_value(r["t"]) == r["f"] for r in spark.createDataFrame(rows, "c string, t string").select("t", S.fold_text(F.col("t")).alias("f")).collect())


def test_resolution_with_rules_moves_texts_once(spark):
    df, existing, size = labelled_documents(spark)
    rules = spark.createDataFrame([("model", "numeric", None, None, None, None, True, True)], NONE["rules"])
    topology = spark.createDataFrame([("station", "page_region", "top_right_header")], NONE["topology"])
    anchors = spark.createDataFrame([("station", "below", "a1", 0.0, 0.0, 600.0, 18.0), ("station", "right", "a2", 0.0, 0.0, 5.0, 12.0)], NONE["anchors"])
    resolve = lambda: resolve_fields(existing, df, [("Station", "station"), ("Model", "model")], rules, topology, anchors, ["model"], 900.0, 820.0)
    assert moved(spark, lambda: resolve().write.format("noop").mode("overwrite").save()) < 1.3 * size
    got = {r["field"]: r for r in resolve().filter("document_id = 7").collect()}
    # The first block stands right of one anchor, the second below the other and closer.
    assert got["station"]["anchor_id"] == "a1" and got["station"]["candidate_id"] == "7-1-1-0-station" and got["model"]["anchor_id"] is None


def test_many_labels_in_a_line(spark):
    """Labels of one line are looked up by their places, not each with each."""
    n = 6000
    line = " ".join(f"{('Station', 'Type', 'Version')[k % 3]}: v{k}" for k in range(n))
    boxes = [(line, 0, 100, 60_000, 112), ("beside", 60_010, 100, 60_100, 112), ("further", 10, 113, 59_000, 125), ("Station: below", 0, 140, 100, 152)]
    began = time.perf_counter()
    out = L.labelled_fields(page_of(spark, boxes), {"station": ["Station"], "type": ["Type"], "version": ["Version"], "other": ["Version"]}, ("station",), {"version": "type", "other": "station"})
    got = {r["field"]: r["value"] for r in out.collect()}
    assert time.perf_counter() - began < 15
    # What goes on below has its centre right of the first half's labels; of equally long texts the first counts.
    assert got == {"station": "v2991 further", "type": "v1000", "version": "v1001", "other": "v2993"}
    grid = grid_of(spark, (0, 30_000, 70_000), (90, 120, 160))
    out = L.labelled_fields(page_of(spark, boxes[:2]), {"station": ["Station"], "version": ["Version"]}, grids=grid)
    assert {r["field"]: r["value"] for r in out.collect()} == {"station": "v1002 Type: v1003", "version": "v5999 beside"}


@pytest.mark.parametrize("labels", [["the", "die", "de la", "la"], ["Đường dây", "Straße", "K"], ["*", "a.b"]])
def test_labels_are_found_where_they_begin(labels):
    text = "bathe: the : DE LA: la: x the; die：\nThe:the: Đường DÂY: đường dây : straſse: STRASSE: Straße: K: k: *: a*: a.b: xa.b: A.B :"
    plain = re.compile(rf"(?<!\w)(?=(?:{'|'.join(map(re.escape, labels))})\s*[:：])", re.IGNORECASE)
    assert [m.start() for m in L.labels_pattern(labels).finditer(text)] == [m.start() for m in plain.finditer(text)] != []
