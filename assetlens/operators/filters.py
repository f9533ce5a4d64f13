"""Filters, row scope, paging and top rows (sections B and F)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written


def search_any(df: DataFrame, q: str | None, columns: list[str]) -> DataFrame:
    """Rows where ``q`` is a part of any of the columns, whatever its case; all rows for an empty q."""
    if not q:
        return df
    return df.filter(reduce(or_, (F.contains(F.upper(F.col(c)), F.upper(F.lit(q))) for c in columns)))


#: Groups of job states (fixed values).
STATE_GROUPS = {"SUCCESS": ("SUCCESS", "SUCCESS_WITH_WARNINGS"), "PROCESSING": ("PENDING", "PROCESSING")}


def filter_in(df: DataFrame, column: str, listed: str, groups: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows whose column is in a comma list; a group's name stands for its members; all rows for an empty list."""
    wanted = [x.strip() for x in listed.split(",") if x.strip()]
    values = [v for x in wanted for v in (groups or {}).get(x, (x,))]
    return df.filter(F.col(column).isin(values)) if values else df


def scope_rows(sheets: DataFrame, devices: DataFrame, bays: DataFrame, role: str, user_id: int | None = None, site_id: int | None = None) -> DataFrame:
    """Sheets a user may see: all for the privileged; a site's own or those of its devices; else one's own."""
    if role == "privileged":
        return sheets
    if site_id is None:
        return sheets.filter(F.col("created_by") == user_id)
    owner = devices.join(bays.filter(F.col("site_id") == site_id).select(F.col("id").alias("bay_id")), "bay_id")
    mine = sheets.join(owner.select(F.col("id").alias("device_id")).distinct().withColumn("_here", F.lit(True)), "device_id", "left")
    own = F.coalesce(F.col("site_id") == site_id, F.lit(False)) if "site_id" in sheets.columns else F.lit(False)
    return mine.filter(own | F.col("_here").isNotNull()).select(sheets.columns)


def my_rows(sheets: DataFrame, user_id: int) -> DataFrame:
    return sheets.filter((F.col("created_by") == user_id) | (F.col("assigned_to") == user_id) | (F.col("supervisor") == user_id))


def filter_by_reference_code(df: DataFrame, lookup: DataFrame, code: str, column: str) -> DataFrame:
    """Rows whose column equals the code's old name in the lookup (code, legacy), or the code if it has none."""
    known = lookup.filter(F.col("code") == code).select(F.coalesce(F.nullif("legacy", F.lit("")), "code").alias(column))
    return df.join(known.limit(1), column, "left_semi")


def recent(df: DataFrame, now: Column, hours: int = 24, column: str = "created_at") -> DataFrame:
    """Rows of the trailing window, newest first."""
    return df.filter((F.col(column) >= now - F.make_dt_interval(hours=F.lit(hours))) & (F.col(column) <= now)).orderBy(F.desc(column), F.desc("id"))


def due_rows(devices: DataFrame, now: Column, sheets: DataFrame | None = None) -> DataFrame:
    """Enabled, not paused, next time not after now.  With sheets: a sheet is needed, no next time is due, pauses don't count."""
    enabled = devices.filter("enabled")
    if sheets is None:
        return enabled.filter(~F.coalesce("paused", F.lit(False)) & (F.col("next_at") <= now))
    return enabled.join(sheets.select(F.col("device_id").alias("id")), "id", "left_semi").filter(F.col("next_at").isNull() | (F.col("next_at") <= now))


def due_intervals(configs: DataFrame, now: Column) -> DataFrame:
    """Enabled and never run, or the interval in minutes has passed since the last run."""
    return configs.filter(F.col("enabled") & (F.col("last_at").isNull() | (F.col("last_at") + F.make_dt_interval(mins=F.col("minutes")) <= now)))


def pluck_fields(jobs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, value) of the fields map; empties dropped; labels from the dictionary, else the key in title case."""
    rows = jobs.select("id", F.explode("fields").alias("key", "value")).filter(F.coalesce(F.trim("value"), F.lit("")) != "")
    named = rows.join(labels.select("key", "label"), "key", "left")
    return named.select("id", F.coalesce("label", F.initcap(F.replace("key", F.lit("_"), F.lit(" ")))).alias("label"), "value")


def header_blocks(blocks: DataFrame, share: float, by: str = "centre") -> DataFrame:
    """Blocks in the top share of their page, by centre or by top edge."""
    page = W.partitionBy("document_id", "page_number")
    y = (F.col("y1") + F.col("y2")) / 2 if by == "centre" else F.col("y1")
    return blocks.withColumn("_height", F.max("y2").over(page)).filter(y <= F.col("_height") * share).drop("_height")


#: Pages that end within so many rows are the top rows of the order; later ones are read from an index.
TOP_ROWS = 10_000


class PageIndex:
    """Rows written once in the order of their pages, so that any page is read from the files that hold it.

    Rows are dealt by ranges of ``order`` and sorted within them; nothing is put in order by one task.  A row's mark is its
    range and its place there, so a page is a span of marks in one range or a few, which the files' statistics find.
    Rows that ``order`` can't tell apart stand in any order; an empty table has one page without rows.
    """

    def __init__(self, df: DataFrame, *order: Column):
        self.columns = df.columns
        self.rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mark", F.monotonically_increasing_id()), "pages")
        pieces = self.rows.groupBy(F.shiftright("_mark", 33).alias("piece")).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        # One row for each range, not for each row.
        self.pieces = written(pieces.withColumn("before", before), "page-ranges")
        self.total: int = self.pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def numbered(self, name: str = "place") -> DataFrame:
        """All rows with their place in the whole order, from 1."""
        placed = self.rows.withColumn("piece", F.shiftright("_mark", 33)).join(self.pieces, "piece")
        place = F.col("before") + F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        return placed.select(*self.columns, place.alias(name))

    def span(self, first: int, n: int) -> DataFrame:
        """``n`` rows from place ``first`` (from 0) on, in order."""
        held = self.pieces.filter((F.col("before") < first + n) & (F.col("before") + F.col("n") > first)).collect()  # n ranges at most
        marks = [((r["piece"] << 33) + max(0, first - r["before"]), (r["piece"] << 33) + min(r["n"], first + n - r["before"]) - 1) for r in held]
        return self.rows.filter(reduce(or_, [F.col("_mark").between(*m) for m in marks], F.lit(False))).orderBy("_mark").select(*self.columns)


def paginate(df: DataFrame, page: str | int, size: int, *order: Column) -> DataFrame:
    """Rows of a page with page, pages and total; no number means the first page, out of range the last.

    A page deep in the order comes from a ``PageIndex``; who turns many pages keeps one.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    try:
        wanted = int(page)
    except (TypeError, ValueError):
        wanted = 1
    wanted = wanted if 1 <= wanted <= pages else pages
    first = (wanted - 1) * size
    rows = df.orderBy(*order).limit(first + size).offset(first) if first + size <= TOP_ROWS else PageIndex(df, *order).span(first, size)
    return rows.withColumns({"page": F.lit(wanted).cast("long"), "pages": F.lit(pages).cast("long"), "total": F.lit(total).cast("long")})


def top_recent(df: DataFrame, n: int, column: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(column), F.desc("id")).limit(n)


def suggest(q: str, sites: DataFrame, bays: DataFrame, devices: DataFrame) -> DataFrame:
    """Up to 3 sites, 3 bays and 5 devices whose code holds q, lowest ids first, in this order."""
    out = None
    for rank, (df, n) in enumerate(((sites, 3), (bays, 3), (devices, 5))):
        part = search_any(df, q, ["code"]).orderBy("id").limit(n).select(F.lit(rank).alias("rank"), F.col("id").cast("long").alias("id"), "code")
        out = part if out is None else out.unionAll(part)
    return out


def number_files(df: DataFrame, name: str = "name") -> DataFrame:
    """Names in case-insensitive order numbered ``P_001``...; more than 999 are refused before they are put in order."""
    if df.limit(1000).count() > 999:
        raise ValueError("more than 999 files")
    place = F.row_number().over(W.orderBy(F.lower(name), name))
    return df.withColumn("place", place).withColumn("new_name", F.format_string("P_%03d", "place"))


def order_board(devices: DataFrame) -> DataFrame:
    return devices.orderBy(F.desc("enabled"), F.asc_nulls_last("next_at"), "id")
