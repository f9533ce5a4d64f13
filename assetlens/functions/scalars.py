"""Column expressions: comparison, intervals, text folding, geometry and value rules."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_ENDLESS = r"^([+-]?)(?i:inf|infinity)$"


def number(c: Column) -> Column:
    """Double of a numeric text (blanks around it allowed), NaN and infinities included; else null."""
    t = F.trim(c)
    return (
        F.when(t.rlike(_NUMBER), t.try_cast("double"))
        .when(t.rlike(_ENDLESS), F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .when(t.rlike(r"^[+-]?(?i:nan)$"), F.lit(float("nan")))
    )


def differs(a: Column, b: Column, trimmed: bool = False) -> Column:
    """Numeric inequality if both are numbers (NaN differs from all), else text inequality; never null."""
    x, y = number(a), number(b)
    s, t = (F.trim(a), F.trim(b)) if trimmed else (a, b)
    return F.when(x.isNotNull() & y.isNotNull(), F.isnan(x) | F.isnan(y) | (x != y)).otherwise(~s.eqNullSafe(t))


def deviation_percent(measured: Column, standard: Column) -> Column:
    """|measured - standard| / |standard| * 100; 0 for a standard of 0."""
    return F.when(standard == 0, F.lit(0.0)).otherwise(F.abs(measured - standard) / F.abs(standard) * 100)


def within_tolerance(c: Column, low: Column, high: Column) -> Column:
    return (c >= low) & (c <= high)


def next_occurrence(ts: Column, n: Column, unit: Column) -> Column:
    """ts plus n units (s m h d M y); ``e`` has no next time; other units mean one hour."""
    zero = F.lit(0)
    fixed = lambda **k: ts + F.make_dt_interval(*(k.get(x, zero) for x in ("days", "hours", "mins", "secs")))
    return (
        F.when(unit == "e", F.lit(None).cast("timestamp"))
        .when(unit == "s", fixed(secs=n.cast("decimal(18,6)")))
        .when(unit == "m", fixed(mins=n))
        .when(unit == "h", fixed(hours=n))
        .when(unit == "d", fixed(days=n))
        .when(unit == "M", ts + F.make_ym_interval(zero, n))
        .when(unit == "y", ts + F.make_ym_interval(n, zero))
        .otherwise(fixed(hours=F.lit(1)))
    )


#: Minutes of the units that an interval may be told in (fixed values).
INTERVAL_UNITS = (("year", 525600), ("month", 43200), ("day", 1440), ("hour", 60))


def interval_label(minutes: Column) -> Column:
    """Largest unit that divides the minutes, as ``3 day``; else minutes."""
    out = None
    for name, size in INTERVAL_UNITS:
        hit, text = (minutes >= size) & (minutes % size == 0), F.concat_ws(" ", F.floor(minutes / size).cast("string"), F.lit(name))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(F.concat_ws(" ", minutes.cast("string"), F.lit("minute")))


def _plain_letters() -> tuple[str, str]:
    """Accented letters and their plain ones, from Unicode's own decompositions."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code).lower()) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain.isascii() and plain != chr(code):
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _PLAIN = _plain_letters()


def fold_text(c: Column, map_dstroke: bool = True) -> Column:
    """Lower case without accents; runs of anything but a-z and 0-9 become one space."""
    t = F.translate(F.lower(c), _ACCENTED, _PLAIN)
    if map_dstroke:
        t = F.translate(t, "đĐ", "dd")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\p{Mn}", ""), "[^a-z0-9]+", " "))


class _FoldedLetters(dict):
    """For ``str.translate``: what ``fold_text`` makes of each lower-case letter, a blank for what it takes out."""

    def __missing__(self, code: int) -> str:
        x = _TO_PLAIN.get(chr(code), chr(code))
        self[code] = x = x if x in _KEPT else "" if unicodedata.category(x) == "Mn" else " "
        return x


_TO_PLAIN, _KEPT, _FOLDED = {**dict(zip(_ACCENTED, _PLAIN)), "đ": "d"}, frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), _FoldedLetters()


def folded_value(text: str) -> str:
    """``fold_text`` of one text within a task."""
    return " ".join(text.lower().translate(_FOLDED).split())


def split_label_value(c: Column) -> Column:
    """Struct (label, value, found): split once at the first ASCII or full-width colon."""
    at = r"(?s)^([^:：]*)[:：](.*)$"
    found = c.rlike(r"[:：]")
    return F.struct(
        F.when(found, F.trim(F.regexp_extract(c, at, 1))).otherwise(F.trim(c)).alias("label"),
        F.when(found, F.trim(F.regexp_extract(c, at, 2))).alias("value"),
        found.alias("found"),
    )


def overlap_1d(a1, a2, b1, b2, floor: float = 1.0, m=F):
    """Length in common over the shorter length (at least ``floor``); ``m`` has greatest, least and lit, of columns if not told."""
    common = m.greatest(m.lit(0.0), m.least(a2, b2) - m.greatest(a1, b1))
    return common / m.greatest(m.lit(floor), m.least(a2 - a1, b2 - b1))


def polygon_bbox(points: Column) -> Column:
    """Struct (x1, y1, x2, y2) of an array of (x, y) points; null for fewer than three."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    return F.when(F.size(points) >= 3, box)


def unit_coordinate(c: Column, length: Column, scale: int = 1) -> Column:
    """Coordinate as a share of the page, kept from 0 to ``scale``; integers by half-even rounding beyond 1."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / length))
    return share if scale == 1 else F.bround(share * scale).cast("int")


def page_role(n: Column) -> Column:
    return F.when(n < 1, F.raise_error(F.lit("page numbers start at one"))).when(n == 1, "cover").when(n == 2, "skipped").otherwise("detail")


#: Lower bounds of the confidence bands (fixed values), highest first.
LEVELS = (("VERY_HIGH", 80.0), ("HIGH", 60.0), ("MEDIUM", 40.0), ("LOW", 20.0))
#: Highest score under a cap at each level: just below the next band.
CEILINGS = {"VERY_LOW": 19.9999, "LOW": 39.9999, "MEDIUM": 59.9999, "HIGH": 79.9999, "VERY_HIGH": 100.0}


def confidence_level(score: Column) -> Column:
    out = None
    for name, low in LEVELS:
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name)
    return out.otherwise("VERY_LOW")


_VERSION = r"^[vV]?\d+(\.\d+){1,4}[A-Za-z]?$"
_TICKET = r"^[A-Za-z]\d+-\d+-\d{4}/[A-Za-z]\d+(\.\d+)?/\d+$"
_PAGE = r"^\s*(\d{1,4})\s*/\s*(\d{1,4})\s*$"


def plain_number(value: Column) -> Column:
    """Number of a text with comma or point as the decimal mark; else null."""
    t = F.replace(F.trim(value), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), t.try_cast("double"))


def number_text(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def check_value(value: Column, kind: Column, options: Column, pattern: Column, low: Column, high: Column, required: Column) -> Column:
    """Struct (status, reason, normalised) of one rule on one value.

    Kinds: unit_suffix, endswith, startswith, regex, enum, numeric, numeric_range, version,
    ticket_number, year, page_reference.  An empty value fails a required rule and leaves others
    unevaluated.
    """
    t = F.trim(F.coalesce(value, F.lit("")))
    tight, spaced, folded = F.regexp_replace(t, r"\s+", ""), F.regexp_replace(t, r"\s+", " "), fold_text(t)
    x = plain_number(t)
    folds = F.transform(options, lambda o: fold_text(o))
    page = F.regexp_extract(t, _PAGE, 1).try_cast("int"), F.regexp_extract(t, _PAGE, 2).try_cast("int")
    tests = {
        "unit_suffix": F.exists(options, lambda o: F.endswith(F.lower(tight), F.lower(o)) & (F.length(tight) > F.length(o))),
        "endswith": F.exists(folds, lambda o: F.endswith(folded, o)),
        "startswith": F.exists(folds, lambda o: F.startswith(folded, o)),
        "regex": F.regexp_like(t, F.concat(F.lit("^(?i:"), pattern, F.lit(")$"))),
        "enum": F.array_contains(folds, folded),
        "numeric": x.isNotNull(),
        "numeric_range": x.isNotNull() & (x >= low) & (x <= high),
        "version": t.rlike(_VERSION),
        "ticket_number": t.rlike(_TICKET),
        "year": t.rlike(r"^(19|20)\d{2}$"),
        "page_reference": (page[0] >= 1) & (page[1] >= page[0]),
    }
    passed, normal = None, F.when(kind.isin("numeric", "numeric_range"), F.coalesce(number_text(x), t))
    for name, test in tests.items():
        test = F.coalesce(test, F.lit(False))
        passed = F.when(kind == name, test) if passed is None else passed.when(kind == name, test)
    normal = normal.when(kind.isin("unit_suffix", "page_reference"), tight).when(kind.isin("endswith", "startswith"), spaced).when(kind == "enum", folded).otherwise(t)
    empty = t == ""
    status = F.when(empty, F.when(required, "failed").otherwise("not_evaluated")).when(passed, "passed").otherwise("failed")
    word = F.when(kind == "regex", "regex_fullmatch").otherwise(F.concat(kind, F.lit("_matched")))
    reason = F.when(empty, F.when(required, "required_value_missing").otherwise("optional_value_missing")).when(passed, word).otherwise(F.concat(kind, F.lit("_mismatch")))
    return F.struct(status.alias("status"), reason.alias("reason"), F.when(empty, "").otherwise(normal).alias("normalised"))


def status_name(c: Column) -> Column:
    """Upper snake case; a prefix if no letter leads; at least two characters."""
    t = F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    t = F.when(t.rlike("^[A-Z]"), t).otherwise(F.concat(F.lit("OCR_"), F.when(t == "", "WARNING").otherwise(t)))
    return F.substring(F.when(F.length(t) < 2, F.concat(t, F.lit("_WARNING"))).otherwise(t), 1, 128)


def signature_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def stable_fingerprint(*columns: str) -> Column:
    """SHA-256 of the row's columns as JSON, in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


#: Shapes of parameter codes and of document headings (fixed values).
CODE_SHAPES = (r"^([A-Za-z]{0,4}\d{1,4}|\d{2,4})(\.[0-9A-Za-z]{1,4})+[A-Za-z]?$", r"^\d{3,4}[A-Za-z]?$")
METADATA = r"(?iu)công ty|trung tâm điều độ|số phiếu|phiếu chỉnh định"


def is_code(c: Column) -> Column:
    t = F.replace(c, F.lit(" "), F.lit(""))
    return t.rlike(CODE_SHAPES[0]) | t.rlike(CODE_SHAPES[1])


def is_metadata(c: Column) -> Column:
    return c.rlike(METADATA)


def review_outcome(status: Column, review: Column) -> Column:
    return F.when(status == "failed", "failed").when(review == "review_required", "manual_review_required").otherwise("ready_for_use")


def field_status(value: Column, status: Column, preserved: Column) -> Column:
    known = ("preserved_existing", "auto_selected", "review_required", "not_available")
    raw = F.coalesce(status, F.lit("preserved_existing"))
    return (
        F.when(value.isNull(), "not_available")
        .when(F.coalesce(preserved, F.lit(False)), "preserved_existing")
        .when(~raw.isin(*known), "review_required")
        .when(raw == "not_available", "preserved_existing")
        .otherwise(raw)
    )


def page_number_of(name: Column, payload: Column) -> Column:
    """Struct (page, origin, eligible) from the payload, the file name, or the default 1."""
    found = [F.regexp_extract(name, p, 1) for p in (r"(?i)page[-_]?0*(\d+)", r"(?i)_p0*(\d+)(?:$|[_-])")]
    by_name = F.coalesce(*(F.when(x != "", x.try_cast("int")) for x in found))
    page = F.coalesce(payload, by_name, F.lit(1))
    origin = F.when(payload.isNotNull(), "payload").when(by_name.isNotNull(), "filename").otherwise("default")
    return F.struct(page.alias("page"), origin.alias("origin"), (page >= 3).alias("eligible"))
