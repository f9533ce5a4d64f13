"""Joins of the register and of text geometry (section C)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import overlap_1d
from .filters import search_any
from .shared import in_groups

PAGE = ["document_id", "page_number"]


def with_hierarchy(sheets: DataFrame, devices: DataFrame, bays: DataFrame, sites: DataFrame, users: DataFrame) -> DataFrame:
    """Sheets with the codes of device, bay and site and the creator's name; nulls kept."""
    d = devices.select(F.col("id").alias("device_id"), F.col("code").alias("device_code"), "bay_id")
    b = bays.select(F.col("id").alias("bay_id"), F.col("code").alias("bay_code"), "site_id")
    s = sites.select(F.col("id").alias("site_id"), F.col("code").alias("site_code"))
    u = users.select(F.col("id").alias("created_by"), F.col("name").alias("creator"))
    return sheets.join(d, "device_id", "left").join(b, "bay_id", "left").join(s, "site_id", "left").join(u, "created_by", "left")


def configured(devices: DataFrame, sheets: DataFrame) -> DataFrame:
    return devices.join(sheets, devices["id"] == sheets["device_id"], "left_semi")


def unconfigured(devices: DataFrame, sheets: DataFrame) -> DataFrame:
    return devices.join(sheets, devices["id"] == sheets["device_id"], "left_anti")


def search_tree(sites: DataFrame, bays: DataFrame, devices: DataFrame, q: str) -> DataFrame:
    """Sites that match or have a matching bay or device, with the count of all their bays."""
    by_bay = search_any(bays, q, ["code"]).select("site_id")
    by_device = search_any(devices, q, ["code"]).select(F.col("bay_id").alias("id")).distinct().join(bays, "id").select("site_id")
    hit = search_any(sites, q, ["code"]).select(F.col("id").alias("site_id")).unionByName(by_bay).unionByName(by_device).distinct()
    counts = bays.groupBy("site_id").agg(F.count_distinct("id").alias("n_bays"))
    found = sites.join(hit, sites["id"] == hit["site_id"], "left_semi").withColumnRenamed("id", "site_id")
    return found.join(counts, "site_id", "left").select("site_id", "code", F.coalesce("n_bays", F.lit(0)).alias("n_bays"))


def link_orphans(child: DataFrame, parent: DataFrame, link: str, child_key: str, parent_key: str, pick: str = "first") -> DataFrame:
    """Fills a null ``link`` by external keys; blank keys never match; of several parents the first or last id."""
    choose = F.min if pick == "first" else F.max
    keys = parent.filter(F.coalesce(F.trim(F.col(parent_key).cast("string")), F.lit("")) != "").groupBy(F.col(parent_key).alias("_key")).agg(choose("id").alias("_parent"))
    found = child.join(keys, F.col(child_key) == F.col("_key"), "left")
    linked = found.withColumn("linked", F.col(link).isNull() & F.col("_parent").isNotNull()).withColumn("orphan", F.col(link).isNull())
    return linked.withColumn(link, F.coalesce(F.col(link), F.col("_parent"))).drop("_key", "_parent")


def match_by_containment(df: DataFrame, parents: DataFrame, text: str) -> DataFrame:
    """Adds ``parent_id``: the lowest id whose name holds the text, else whose code does; blank texts match nothing.

    A text stands in a name only if each three letters of it do (the text itself, if it is shorter).  The three that fewest parents have
    are the join's key; a text with three that none has matches nothing.  Each distinct text is compared once.
    """
    texts = df.select(F.col(text).alias("_t")).filter(F.trim("_t") != "").distinct()
    p = parents.select(F.col("id").alias("_id"), F.upper("name").alias("_n"), F.upper("code").alias("_c"))

    def grams(c: Column, *sizes: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c)))
        return F.flatten(F.transform(at, lambda i: F.transform(F.array(*map(F.lit, sizes)), lambda n: F.substring(c, i, n))))

    empty = F.array().cast("array<string>")
    p = p.withColumn("_g", F.explode(F.array_distinct(F.concat(F.coalesce(grams(F.col("_n"), 1, 2, 3), empty), F.coalesce(grams(F.col("_c"), 1, 2, 3), empty)))))
    own = F.when(F.length("_t") <= 3, F.array(F.upper("_t"))).otherwise(F.filter(F.array_distinct(grams(F.upper("_t"), 3)), lambda g: F.length(g) == 3))
    frequency = p.groupBy("_g").agg(F.count(F.lit(1)).alias("_k"))
    counted = texts.withColumn("_g", F.explode(own)).join(frequency, "_g", "left")
    rarest = counted.groupBy("_t").agg(F.min(F.struct(F.coalesce("_k", F.lit(0)).alias("k"), F.col("_g").alias("g"))).alias("m")).filter("m.k > 0").select("_t", F.col("m.g").alias("_g"))
    by_name, by_code = F.contains("_n", F.upper("_t")), F.contains("_c", F.upper("_t"))
    pairs = rarest.join(p, (rarest["_g"] == p["_g"]) & (by_name | by_code)).groupBy("_t").agg(F.min(F.when(by_name, F.col("_id"))).alias("_x"), F.min(F.when(by_code, F.col("_id"))).alias("_y"))
    found = pairs.select("_t", F.coalesce("_x", "_y").alias("parent_id"))
    return df.join(found, F.col(text) == F.col("_t"), "left").drop("_t")


def items_with_setting(items: DataFrame, settings: DataFrame) -> DataFrame:
    """Items with the first setting (lowest id) of the same device and code, if any."""
    first = settings.groupBy("device_id", "code").agg(F.min_by(F.struct("standard", "low", "high"), "id").alias("s"))
    return items.join(first, ["device_id", "code"], "left").select(*items.columns, "s.standard", "s.low", "s.high")


def provision_items(checks: DataFrame, settings: DataFrame) -> DataFrame:
    """A zeroed item for each check and setting of its device."""
    zero = F.lit(0.0)
    return checks.join(settings.select("device_id", "code"), "device_id").select("check_id", "code", zero.alias("measured"), zero.alias("deviation"), F.lit(False).alias("within"))


def grant_matrix(groups: DataFrame, permissions: DataFrame, grants: DataFrame) -> DataFrame:
    """Every group with every permission and whether it is granted.  Both lists are the output's own axes."""
    given = grants.select("group", "permission").distinct().withColumn("_g", F.lit(True))
    return groups.join(permissions).join(given, ["group", "permission"], "left").select("group", "permission", F.col("_g").isNotNull().alias("granted"))


#: Side of the squares in which boxes of a page look for each other; the boxes may have any size.
SQUARE = 64.0


def _stretch(lo: float, hi: float) -> range:
    """The squares that lo..hi touches along an axis."""
    first, last = (0 if x != x else int(x // SQUARE) for x in (lo, hi))
    return range(first, max(first, last) + 1)


def _in_squares(boxes: list[tuple], ends: list[tuple[int, int]]) -> dict[tuple, list[int]]:
    """Places of the boxes by the squares that they touch; ``ends`` are the places of lo and hi on each axis."""
    held = defaultdict(list)
    for k, b in enumerate(boxes):
        if all(b[e] is not None for e in chain(*ends)):
            for at in product(*(_stretch(b[lo], b[hi]) for lo, hi in ends)):
                held[at].append(k)
    return held


def _meeting(blocks: list[tuple], boxes: list[tuple], held: dict[tuple, list[int]], own: list[tuple[int, int]], ends: list[tuple[int, int]]) -> Iterator[tuple]:
    """Pairs of one page: each block looks into its squares."""
    for a in blocks:
        if any(a[e] is None for e in chain(*own)):
            continue
        reach = [(a[lo], a[hi], *e) for (lo, hi), e in zip(own, ends)]
        met = set().union(*(held.get(at, ()) for at in product(*(_stretch(lo, hi) for lo, hi, _, _ in reach))))
        for lo, hi, blo, bhi in reach:
            met = [k for k in met if not (hi < boxes[k][blo] or boxes[k][bhi] < lo)]
        yield from (a + boxes[k] for k in met)


def touching(blocks: DataFrame, others: DataFrame, axes: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """Pairs of blocks and other boxes of the page that touch along each axis (columns lo, hi of both): they meet in squares, so no page is
    multiplied out.

    Both sides pass once, by page; squares are told within it.  ``others`` has a row for each box, or for each page an array ``boxes``.
    """
    names = [c for c in blocks.columns if c not in PAGE]
    if "boxes" not in others.columns:
        others = others.select(*PAGE, F.array(F.struct(*(c for c in others.columns if c not in PAGE))).alias("boxes"))
    box = others.schema["boxes"].dataType.elementType
    own, ends = [(names.index(lo), names.index(hi)) for lo, hi, _, _ in axes.values()], [(box.names.index(lo), box.names.index(hi)) for _, _, lo, hi in axes.values()]
    rows = blocks.select(*PAGE, F.struct(*names).alias("block")).unionByName(others.select(*PAGE, "boxes"), allowMissingColumns=True)
    both, last = [*names, *box.names], [[], {}]  # pages of one form have the same boxes: those of the page before stay dealt

    def pairs(_, page):
        boxes = [x for _, xs in page if xs for x in xs]
        if boxes != last[0]:
            last[:] = boxes, _in_squares(boxes, ends)
        return (dict(zip(both, x)) for x in _meeting([b for b, _ in page if b is not None], *last, own, ends))

    return in_groups(rows, PAGE, pairs, T.StructType([T.StructField(f.name, f.dataType) for f in (*(blocks.schema[c] for c in names), *box)]))


BOX = ["x1", "y1", "x2", "y2"]
_DOWN, _ACROSS = ("y1", "y2", "cy1", "cy2"), ("x1", "x2", "cx1", "cx2")


def assign_to_bands(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """Blocks with the row band of largest vertical overlap in their region (first on ties) and whether they cross its inner lines.

    bands: document_id, page_number, region_id, band, rx1, rx2 (region), by1, by2 (band).
    """
    centre = (F.col("x1") + F.col("x2")) / 2
    common = F.least("y2", "by2") - F.greatest("y1", "by1")
    pairs = touching(blocks.select(*PAGE, "block_id", *BOX), bands, {"y": ("y1", "y2", "by1", "by2")}).filter((centre >= F.col("rx1")) & (centre <= F.col("rx2")) & (common > 0))
    best = pairs.groupBy(*PAGE, "block_id", "region_id").agg(
        F.max_by("band", F.struct(common, -F.col("band"))).alias("band"), F.max(common).alias("overlap"),
        F.bool_or((F.col("y1") < F.col("by1") - 2) & (F.col("y2") > F.col("by1") + 2)).alias("crosses"),
    )
    return best


def assign_to_cells(blocks: DataFrame, cells: DataFrame, rule: str = "overlap") -> DataFrame:
    """Blocks in cells (row, col, cx1, cy1, cx2, cy2) by shares of overlap or by their centre."""
    if rule == "centre":
        centred = blocks.select(*PAGE, "block_id", *BOX).withColumns({"_cx": (F.col("x1") + F.col("x2")) / 2, "_cy": (F.col("y1") + F.col("y2")) / 2})
        pairs = touching(centred, cells, {"x": ("_cx", "_cx", "cx1", "cx2"), "y": ("_cy", "_cy", "cy1", "cy2")})
        inside = (F.col("_cx") >= F.col("cx1")) & (F.col("_cx") < F.col("cx2")) & (F.col("_cy") >= F.col("cy1")) & (F.col("_cy") < F.col("cy2"))
    else:
        pairs = touching(blocks.select(*PAGE, "block_id", *BOX), cells, {"x": _ACROSS, "y": _DOWN})
        inside = (overlap_1d(F.col("y1"), F.col("y2"), F.col("cy1"), F.col("cy2")) >= 0.35) & (overlap_1d(F.col("x1"), F.col("x2"), F.col("cx1"), F.col("cx2")) >= 0.25)
    return pairs.filter(inside).select(*PAGE, "block_id", "row", "col")


def assign_to_nearest(blocks: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Blocks with the row of nearest centre (row, centre) and the first column (col, right) not ending left of their centre.

    Centres and edges are put in order with the blocks: a block looks at the row before and the row after it, and at the least column
    among the edges from its centre on.
    """
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    empty = F.lit(None)
    told = blocks.select(*PAGE, "block_id", cy.alias("at"), empty.cast("struct<centre:double,row:bigint>").alias("r"))
    lines = rows.groupBy(*PAGE, "centre").agg(F.min("row").alias("row")).select(*PAGE, empty.cast(blocks.schema["block_id"].dataType).alias("block_id"), F.col("centre").cast("double").alias("at"), F.struct(F.col("centre").cast("double").alias("centre"), F.col("row").cast("bigint").alias("row")).alias("r"))
    w = W.partitionBy(*PAGE).orderBy("at", F.col("r").isNull())
    both = told.unionByName(lines).withColumns({"_b": F.last("r", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_a": F.first("r", True).over(w.rowsBetween(0, W.unboundedFollowing))})
    pick = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.centre")).alias("d"), F.col(f"{c}.row").alias("row")))
    near = both.filter("r is null").select(*PAGE, "block_id", F.least(pick("_b"), pick("_a"))["row"].cast(rows.schema["row"].dataType).alias("row")).filter("row is not null")
    kind = columns.schema["col"].dataType
    ends = blocks.select(*PAGE, "block_id", cx.alias("at"), empty.cast(kind).alias("col"), F.lit(1).alias("k")).unionByName(columns.select(*PAGE, empty.cast(blocks.schema["block_id"].dataType).alias("block_id"), F.col("right").cast("double").alias("at"), "col", F.lit(0).alias("k")))
    v = W.partitionBy(*PAGE).orderBy(F.desc("at"), "k").rowsBetween(W.unboundedPreceding, 0)
    first = ends.withColumn("_col", F.min("col").over(v)).filter("k = 1 and _col is not null").select(*PAGE, "block_id", F.col("_col").alias("col"))
    return near.join(first, [*PAGE, "block_id"], "left")


def cells_to_reread(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells that a block overlaps by more than 4 square units while it crosses a cell edge by the larger of 4 units and 22%, unless it is alone in its row."""
    wide = F.least("x2", "cx2") - F.greatest("x1", "cx1")
    high = F.least("y2", "cy2") - F.greatest("y1", "cy1")
    pairs = touching(blocks.select(*PAGE, "block_id", *BOX), cells, {"x": _ACROSS, "y": _DOWN}).withColumns({"_w": wide, "_h": high}).filter("_w > 0 and _h > 0 and _w * _h > 4")
    limit = F.greatest(F.lit(4.0), 0.22 * (F.col("x2") - F.col("x1")))
    over = F.greatest(F.col("cx1") - F.col("x1"), F.col("x2") - F.col("cx2")) >= limit
    peers = W.partitionBy(*PAGE, "row")
    counted = pairs.withColumn("_n", F.size(F.collect_set("block_id").over(peers)))
    return counted.filter(over & (F.col("_n") > 1)).select(*PAGE, "row", "col").distinct()


#: How far centres of neighbours above and below may be apart (or the wider one's width), how far left edges of aligned blocks, and their
#: centres down the page; shares of the page (fixed values).
CENTRES_APART, EDGES_APART, DOWN_APART = 0.04, 0.018, 0.25


def nearest_below(boxes: list[tuple], apart: float) -> list[tuple]:
    """(source, target, gap): for each box (id, x1, y1, x2, y2) the nearest one below it whose centre is no farther aside than the wider one's
    width or ``apart``; the least id of equals.

    One sweep from the bottom: boxes enter, by their tops, the columns of width ``apart`` that hold their centre and those within their
    reach; a box asks, at its bottom, the columns that it reaches and the one of its centre, latest first.
    """
    entries = []
    for i, x1, y1, x2, y2 in boxes:
        reach = max(x2 - x1, apart)
        entries.append((y1, i, (x1 + x2) / 2, reach, y2))
    columns = lambda c, reach: range(int((c - reach) // apart), int((c + reach) // apart) + 1)
    by_top = sorted(entries, key=lambda e: (-e[0], -e[1]))
    centred: dict[int, list] = defaultdict(list)
    reached: dict[int, list] = defaultdict(list)
    out, entered = [], 0
    for top, i, centre, reach, bottom in sorted(entries, key=lambda e: -e[4]):
        while entered < len(by_top) and by_top[entered][0] >= bottom:
            e = by_top[entered]
            centred[int(e[2] // apart)].append(e)
            for k in columns(e[2], e[3]):
                reached[k].append(e)
            entered += 1
        best = None
        for held in (*(centred[k] for k in columns(centre, reach) if k in centred), reached.get(int(centre // apart), ())):
            for e in reversed(held):
                if best is not None and e[:2] >= best:
                    break
                if e[1] != i and abs(e[2] - centre) <= max(reach, e[3]):
                    best = e[:2]
                    break
        if best is not None:
            out.append((i, best[1], best[0] - bottom))
    return out


def nearest_neighbours(rows: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Typed edges (source, target, kind, distance) between blocks of (row_id): the next ones left and right in the row, the nearest above and
    below, and ``aligned_left`` between blocks with left edges close together and centres within a quarter of the page."""
    w = W.partitionBy(*PAGE, "row_id").orderBy("x1", "block_id")
    line = rows.withColumns({"_next": F.lead("block_id").over(w), "_gap": F.lead("x1").over(w) - F.col("x2")}).filter("_next is not null")
    right = line.select(*PAGE, F.col("block_id").alias("source"), F.col("_next").alias("target"), F.lit("right").alias("kind"), F.greatest(F.lit(0.0), "_gap").alias("distance"))
    left = right.select(*PAGE, F.col("target").alias("source"), F.col("source").alias("target"), F.lit("left").alias("kind"), "distance")

    def vertical(_, boxes):
        turned = [(i, x1, -y2, x2, -y1) for i, x1, y1, x2, y2 in boxes]
        apart = CENTRES_APART * page_width
        for kind, b in (("below", boxes), ("above", turned)):
            for s, t, g in nearest_below(b, apart):
                yield {"source": s, "target": t, "kind": kind, "distance": g}

    box = rows.select(*PAGE, "block_id", "x1", "y1", "x2", "y2")
    updown = in_groups(box, PAGE, vertical, T.StructType([*(T.StructField(c, right.schema[c].dataType) for c in ("source", "target")), T.StructField("kind", T.StringType()), T.StructField("distance", T.DoubleType())]))
    # Blocks meet in cells as wide and high as the limits, each looking into the cells around its own.
    wide, high, centre = EDGES_APART * page_width, DOWN_APART * page_height, (F.col("y1") + F.col("y2")) / 2
    own = box.select(*PAGE, F.col("block_id").alias("source"), "x1", centre.alias("cy"), F.floor(F.col("x1") / wide).alias("i"), F.floor(centre / high).alias("j"))
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    other = own.select(*PAGE, F.col("source").alias("target"), F.col("x1").alias("_x1"), F.col("cy").alias("_cy"), around("i").alias("i"), "j").withColumn("j", around("j"))
    offset = F.abs(F.col("x1") - F.col("_x1"))
    aligned = own.join(other, [*PAGE, "i", "j"]).filter((F.col("source") != F.col("target")) & (offset <= wide) & (F.abs(F.col("cy") - F.col("_cy")) <= high))
    return right.unionByName(left).unionByName(updown).unionByName(aligned.select(*PAGE, "source", "target", F.lit("aligned_left").alias("kind"), offset.alias("distance")))


def nearest_left_label(values: DataFrame, labels: DataFrame, page_width: float) -> DataFrame:
    """The closest label left of each value: gap from -20 to 22% of the width, vertical overlap of 0.25 or more."""
    label = labels.select(*PAGE, *(F.col(c).alias(f"l_{c}") for c in ("block_id", "x2", "y1", "y2")))
    gap = F.col("x1") - F.col("l_x2")
    good = (gap >= -20) & (gap <= 0.22 * page_width) & (overlap_1d(F.col("y1"), F.col("y2"), F.col("l_y1"), F.col("l_y2")) >= 0.25) & (F.col("block_id") != F.col("l_block_id"))
    return values.join(label, PAGE).filter(good).groupBy(*PAGE, "block_id").agg(F.min(F.struct(F.abs(gap).alias("gap"), F.col("l_block_id").alias("label_id"))).alias("m")).select(*PAGE, "block_id", "m.label_id", "m.gap")


def adjacent_value(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """The value of each bare label: first in the same row to the right, else below within three heights; ties by distance, then id."""
    v = blocks.select(*PAGE, *(F.col(c).alias(f"v_{c}") for c in ("block_id", "x1", "y1", "x2", "y2")))
    high = F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    row_error = F.abs((F.col("y1") + F.col("y2")) / 2 - (F.col("v_y1") + F.col("v_y2")) / 2) / high
    right = (row_error <= 1.25) & (F.col("v_x1") >= F.col("x2"))
    below = (F.col("v_y1") >= F.col("y2")) & (F.col("v_y1") - F.col("y2") <= 3 * high) & (overlap_1d(F.col("x1"), F.col("x2"), F.col("v_x1"), F.col("v_x2")) > 0)
    rank = F.when(right, 0).when(below, 1)
    distance = F.when(right, F.col("v_x1") - F.col("x2")).otherwise(F.col("v_y1") - F.col("y2"))
    pairs = labels.join(v, PAGE).filter((F.col("block_id") != F.col("v_block_id")) & rank.isNotNull())
    best = pairs.groupBy(*PAGE, "block_id").agg(F.min(F.struct(rank.alias("rank"), distance.alias("distance"), F.col("v_block_id").alias("value_id"))).alias("m"))
    return best.select(*PAGE, "block_id", "m.*")
