"""Field resolution: candidates from values and text, their evidence and scores, and the decision for each field."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import folded_value
from . import layout, pages
from .joins import PAGE
from .shared import in_groups, written
from .versions import rank_candidates

BOX = ["x1", "y1", "x2", "y2"]
#: Scores of boxes with anchors that a task holds at once.
SCORES_HELD = 1 << 18


def existing_candidates(existing: DataFrame, blocks: DataFrame) -> DataFrame:
    """The fields and their values, those that are there and have a box (page_number, x1, y1, x2, y2) as candidates ``there``; blocks, source_cell,
    confidence, alias and separator may be told."""
    block = blocks.schema["block_id"].dataType.simpleString()
    given = {"blocks": F.array().cast(f"array<{block}>"), "source_cell": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "alias": F.lit(0.0), "separator": F.lit(0.0), **{c: F.lit(None).cast("double") for c in BOX}, "page_number": F.lit(None).cast("int")}
    rows = existing.withColumns({c: default for c, default in given.items() if c not in existing.columns})
    numbers = {c: F.col(c).cast("double") for c in (*BOX, "confidence", "alias", "separator")}
    rows = rows.withColumns({**numbers, "blocks": F.coalesce("blocks", given["blocks"]), "there": F.expr("value is not null and x1 is not null and page_number is not null")})
    own = F.concat_ws("-", F.lit("existing"), "document_id", "field").alias("candidate_id")
    return rows.select("document_id", "page_number", F.struct("field", "there", own, "value", "blocks", F.struct(*BOX).alias("box"), "confidence", "source_cell", "alias", "separator").alias("known"))


def value_beside(label: tuple, others: list[tuple]) -> tuple | None:
    """Of blocks (id, box, ...) the value of a bare label (id, box), as ``joins.adjacent_value`` tells it."""
    i, (x1, y1, x2, y2) = label[:2]
    high, found = max(1.0, y2 - y1), []
    for o in others:
        ox1, oy1, ox2, oy2 = o[1]
        if o[0] == i:
            continue
        if ox1 >= x2 and abs((y1 + y2) / 2 - (oy1 + oy2) / 2) / high <= 1.25:
            found.append(((0, ox1 - x2, o[0]), o))
        elif oy1 >= y2 and oy1 - y2 <= 3 * high and min(x2, ox2) > max(x1, ox1):
            found.append(((1, oy1 - y2, o[0]), o))
    return min(found, key=lambda f: f[0])[1] if found else None


def best_siblings(candidates: list[tuple[str, str, tuple]], rules: list[tuple[str, str, str]]) -> dict[tuple[str, tuple], tuple[float, str]]:
    """Of the candidates (id, field, box) of a page, by field and box, the best score of a relation to a sibling field's candidate, and its id."""
    # Candidates of one block have one box: boxes meet, and of the candidates in one the last id stands for all.
    ids: dict[str, dict[tuple, str]] = {}
    for i, field, box in candidates:
        held = ids.setdefault(field, {})
        held[box] = max(i, held.get(box, i))
    best: dict[tuple[str, tuple], tuple[float, str]] = {}
    for field, relation, anchor_field in rules:
        own, anchors = [b for b in ids.get(field, ()) if None not in b], sorted(((i, b) for b, i in ids.get(anchor_field, {}).items()), key=lambda a: a[0], reverse=True)
        if not own or not anchors:
            continue
        at = np.array([b for _, b in anchors], float)
        n = max(1, SCORES_HELD // len(anchors))
        for k in range(0, len(own), n):
            scores = pages.relation_scores(np.array(own[k : k + n], float), at, relation)
            first = scores.argmax(axis=1).tolist()
            for box, j, score in zip(own[k : k + n], first, scores.max(axis=1).tolist()):
                if score >= 0:
                    best[field, box] = max((score, anchors[j][0]), best.get((field, box), (-1.0, "")))
    return best


def _rules(siblings: DataFrame) -> list[tuple[str, str, str]]:
    """The rules (a few for each field) as values."""
    return [tuple(r) for r in siblings.select("field", "relation", "anchor_field").distinct().collect()]


def sibling_evidence(candidates: DataFrame, siblings: DataFrame) -> DataFrame:
    """(candidate_id, sibling_score, sibling_id): the best relation to a candidate of a sibling field on the page, by rules (field, relation,
    anchor_field)."""
    rules = _rules(siblings)

    def work(_, rows):
        told = [(i, field, tuple(box)) for i, field, *box in rows]
        best = best_siblings(told, rules)
        return ({"candidate_id": i, "sibling_score": best[field, box][0], "sibling_id": best[field, box][1]} for i, field, box in told if (field, box) in best)

    placed = candidates.dropna(subset=PAGE).select(*PAGE, "candidate_id", "field", *(F.col(c).cast("double").alias(c) for c in BOX))
    return in_groups(placed, PAGE, work, "candidate_id string, sibling_score double, sibling_id string").drop(*PAGE)


_CANDIDATE = "candidate_id string, field string, value string, x1 double, y1 double, x2 double, y2 double, confidence double, source_cell string, alias double, separator double, sibling_score double, sibling_id string"


def _joined(a: tuple, b: tuple) -> tuple:
    """The box around two."""
    ends = zip((min, min, max, max), a, b)
    return tuple(pick((x for x in both if x is not None), default=None) for pick, *both in ends)


def _repeated(found: list[tuple], there: list[tuple], page: int) -> set[str]:
    """Ids of the found candidates of a value that an earlier one has in one of their blocks, or one that is there in one of its blocks or over
    it; values are compared by their letters and digits, without accents and case, and only where candidates meet."""
    held: dict[tuple, list[tuple[str, str]]] = {}
    for i, field, value, blocks, *_ in found:
        for b in blocks:
            held.setdefault((field, b), []).append((i, value))
    out: set[str] = set()
    for own in held.values():
        if len(own) > 1:
            first: dict[str, str] = {}
            for i, value in (plain := [(i, folded_value(value)) for i, value in own]):
                first[value] = min(i, first.get(value, i))
            out.update(i for i, value in plain if first[value] != i)
    over = lambda a, b: None not in a + b and min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])
    for at, (field, _, _, value, blocks, box, *_) in there:
        meeting = [c for c in found if c[1] == field and (not set(c[3]).isdisjoint(blocks) or at == page and over(c[4], box))]
        plain = folded_value(value) if meeting else ""
        out.update(c[0] for c in meeting if folded_value(c[2]) == plain)
    return out


def page_candidates(blocks: DataFrame, existing: DataFrame, aliases: list[tuple[str, str]], siblings: DataFrame) -> DataFrame:
    """Candidates of the fields of ``existing`` with their sibling evidence: values after the fields' aliases, or where an alias has none in its
    block, in the nearest block without an alias beside or below it; and the values that are there, without what repeats them.

    Blocks are read where they lie, and only what they hold for the fields moves, once, to a task that has a document's pages one by one.
    """
    rules = _rules(siblings)
    sure = F.col("recognition_score") if "recognition_score" in blocks.columns else F.lit(1.0)
    boxes = [F.col(c).cast("double").alias(c) for c in BOX]
    read = layout.with_hits(blocks.dropna(subset=[*PAGE, "block_id"]).select(*PAGE, "block_id", F.struct(*boxes).alias("box"), sure.cast("double").alias("sure"), "text"), aliases)
    value = F.when(F.size("hits") == 0, F.trim("text"))
    held = read.select(*PAGE, "block_id", "box", "sure", value.alias("text"), "hits").filter("size(hits) > 0 or text <> ''")
    known = existing_candidates(existing, blocks).withColumn("page_number", F.col("page_number").cast(blocks.schema["page_number"].dataType))
    # What is known of a document comes before its pages; the page of each value that is there is named, in case it has no block.
    at = known.filter("known.there").select(*PAGE).distinct()
    first = known.select("document_id", F.struct(F.col("page_number").alias("page"), "known").alias("known"))
    rows = held.unionByName(first, allowMissingColumns=True).unionByName(at, allowMissingColumns=True)
    rows = rows.select(*PAGE, "block_id", "box", "sure", "text", "hits", "known")
    document: dict = {}

    def found_on(key, placed):
        plain = [r for r in placed if not r[4] and None not in r[1]]
        for i, box, confidence, _, hits in placed:
            beside = value_beside((i, box), plain) if None not in box and any(h[2] == "" for h in hits) else None
            for field, start, text, separated in hits:
                own = f"{key[0]}-{key[1]}-{i}-{start}-{field}"
                if text != "":
                    yield own, field, text, (i,), box, confidence, None, 1.0, float(separated)
                elif beside:
                    o, o_box, o_sure, o_text, _ = beside
                    both = None if confidence is None or o_sure is None else (confidence + o_sure) / 2
                    yield own, field, o_text, (i, o), _joined(box, o_box), both, None, 1.0, float(separated)

    def work(key, rows):
        if key[1] is None:
            document.clear()
            known = [r[5] for r in rows]
            document.update(id=key[0], fields={k[0] for _, k in known}, there=[(at, k) for at, k in known if k[1]])
            return
        if document.get("id") != key[0]:
            return
        there, fields = document["there"], document["fields"]
        found = [c for c in found_on(key, [r[:5] for r in rows if r[0] is not None]) if c[1] in fields]
        gone = _repeated(found, there, key[1])
        found = [c for c in found if c[0] not in gone]
        found += ((i, field, text, held, box, *more) for at, (field, _, i, text, held, box, *more) in there if at == key[1])
        best = best_siblings([(c[0], c[1], c[4]) for c in found], rules)
        for i, field, text, _, box, confidence, cell, alias, separator in found:
            score, anchor = best.get((field, box), (None, None))
            yield {
                "candidate_id": i, "field": field, "value": text, **dict(zip(BOX, box)), "confidence": confidence, "source_cell": cell, "alias": alias, "separator": separator,
                "sibling_score": score, "sibling_id": anchor,
            }

    return in_groups(rows, PAGE, work, _CANDIDATE, dealt=["document_id"])


def _best_two(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the two candidates of each field of a document that come first."""
    for b in batches:
        order = pc.sort_indices(b, [("document_id", "ascending"), ("field", "ascending"), ("score", "descending"), ("candidate_id", "ascending")])
        own = pa.table({c: b.column(c) for c in ("document_id", "field")}).take(order)
        third = pa.array([False] * min(2, len(b)))
        if len(b) > 2:
            same = [pc.equal(own[c].combine_chunks().slice(2), own[c].combine_chunks().slice(0, len(b) - 2)) for c in own.column_names]
            third = pa.concat_arrays([third, pc.and_(*same)])
        yield b.take(order.filter(pc.invert(third)))


def resolve_fields(
    existing: DataFrame, blocks: DataFrame, aliases: list[tuple[str, str]], value_rules: DataFrame, topology: DataFrame, anchors: DataFrame, locked: list[str], page_width: float, page_height: float,
    siblings: DataFrame | None = None, cover: list[str] = [],  # noqa: B006
) -> DataFrame:
    """(document_id, field, value, status, candidate_id, margin, reasons, score, anchor_id) of every field of ``existing`` (document_id, field, value).

    A value that is there stays; with a box it is a candidate beside those found, so that its evidence and margin are told too.  A
    signal of which the field has no rule counts fully.  Anchors are given boxes, or by ``siblings`` the candidates of other fields.  A field
    in ``locked`` (its structure decides that it is empty) is only proposed for review, and so is one in ``cover`` whose candidate
    neither stands in the slot expected nor at an anchor.
    """
    siblings = siblings if siblings is not None else anchors.sparkSession.createDataFrame([], "field string, relation string, anchor_field string")
    existing = written(existing, "existing-fields")
    sized = page_candidates(blocks, existing, aliases, siblings).withColumns({"page_width": F.lit(page_width), "page_height": F.lit(page_height)})
    rows = pages.with_value_checks(pages.with_spatial_evidence(sized, topology, anchors).withColumnsRenamed({"anchor_id": "_fixed", "cap": "_sc"}), value_rules)
    share, broken = pages.value_signal(F.col("checks"))
    rows = rows.withColumns({"_v": share, "_vc": broken}).drop("checks")
    anchored = anchors.select("field").unionByName(siblings.select("field"))
    slots = topology.filter("kind = 'cover_slot'")
    for df, name in ((topology, "_t"), (anchored, "_a"), (value_rules.filter("active"), "_r"), (slots, "_slot")):
        rows = rows.join(F.broadcast(df.select("field").distinct().withColumn(name, F.lit(True))), "field", "left")
    signal = lambda name, score: F.when(F.col(name).isNull(), 1.0).otherwise(score)
    aliased = F.col("field").isin(sorted({name for _, name in aliases}))
    best_anchor = F.greatest("anchor_score", F.coalesce("sibling_score", F.lit(0.0)))
    signals = pages.score_candidates(
        rows.withColumns(
            {
                "topology": signal("_t", F.col("topology_score")), "anchor": signal("_a", best_anchor), "value_validation": signal("_r", F.col("_v")), "alias": F.when(aliased, F.col("alias")).otherwise(1.0),
                "ocr_confidence": F.coalesce("confidence", F.lit(0.0)), "cap": F.coalesce("_sc", "_vc"), "anchor_id": F.when(F.coalesce("sibling_score", F.lit(0.0)) > F.col("anchor_score"), F.col("sibling_id")).otherwise(F.col("_fixed")),
            }
        )
    )
    owned = (F.col("_slot").isNotNull() & (F.col("topology_score") > 0)) | F.col("anchor_id").isNotNull()
    scored = signals.select("document_id", "field", "candidate_id", "score", F.col("cap").isNotNull().alias("constrained"), F.col("value").alias("_value"), "anchor_id", owned.alias("_owned"))
    decided = rank_candidates(scored.mapInArrow(_best_two, scored.schema), key=("document_id", "field"), kept=("_value", "anchor_id", "_owned")).withColumnRenamed("status", "_s")
    out = existing.select("document_id", "field", "value").join(decided, ["document_id", "field"], "left")
    empty, selected = F.col("value").isNull(), F.col("_s") == "auto_selected"
    held = F.col("field").isin(locked) if locked else F.lit(False)
    unsure = (F.col("field").isin(cover) if cover else F.lit(False)) & ~held & ~F.col("_owned") & selected
    auto = empty & selected & ~held & ~unsure
    why = F.concat_ws(",", "reasons", F.when(empty & held, "structure_owned_null_not_overridden").when(empty & unsure, "cover_ownership_evidence_required"))
    status = F.when(~empty, "preserved_existing").when(F.col("_s").isNull(), "not_available").when(auto, "auto_selected").otherwise("review_required")
    return out.select("document_id", "field", F.when(auto, F.col("_value")).otherwise(F.col("value")).alias("value"), status.alias("status"), F.col("leader").alias("candidate_id"), "margin", F.when(F.col("_s").isNotNull(), why).alias("reasons"), "score", "anchor_id")
