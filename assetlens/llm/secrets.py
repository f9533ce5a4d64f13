"""Secret scans with an incremental blob ledger, Spark expressions only.

Every version of a text is content-addressed (SHA-256).  The ledger is a Parquet table of
(blob_id, rule_version, findings); a blob is scanned once for each rule version that the ledger
does not hold yet, and findings are joined back to all paths that ever had the blob.

Positions are code points with an exclusive end.  They come from splitting the text at the
matches: the lengths of pieces and matches, summed up, are the positions.

An entry that stands in the ledger twice (two runs at once, a repeated driver) counts once.

Cases: null text counts as empty; repeated rows and equal texts share one blob and all get its
findings; a null path is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

_FINDINGS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; ``group`` of it must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}:{hashlib.sha256(f'{self.pattern}|{self.group}|{self.least}'.encode()).hexdigest()[:16]}"


#: Fixed values.  For access and hex the least length stands in the pattern: a run of such
#: characters is taken whole either way.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further rules, whose spans come beside the base ones.  A scheme has 32 characters at most and a token's header 253, so that a long run of
#: such characters is read a bounded number of times.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,250}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{0,31}://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{20,}"),
)


def _spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of one rule as (kind, start, end)."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    found = F.arrays_zip(
        pieces.alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m)).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m)).alias("kept"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FINDINGS).alias("out"))

    def add(acc: Column, m: Column) -> Column:
        lo = acc["at"] + m["gap"]
        hi = lo + F.coalesce(m["size"], F.lit(0))
        one = F.array(F.struct(F.lit(rule.kind).alias("kind"), lo.alias("start"), hi.alias("end")))
        return F.struct(hi.alias("at"), F.when(m["kept"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(found, start, add)["out"]).otherwise(F.array().cast(_FINDINGS))


def address(versions: DataFrame) -> DataFrame:
    """Adds ``blob_id``, the content address of ``text`` (null: empty)."""
    return versions.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob_id", F.sha2(F.col("text").cast("binary"), 256))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger so far; None before its first entry."""
    try:
        return spark.read.schema(f"blob_id string, rule_version string, findings {_FINDINGS}").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the blobs of ``versions`` (path, text) for the rule versions not in the ledger and adds the findings."""
    spark = versions.sparkSession
    blobs = address(versions.select("text")).groupBy("blob_id").agg(F.any_value("text").alias("text"))
    wanted = F.array(*(F.lit(r.version) for r in rules))
    if (seen := _ledger(spark, ledger_path)) is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        seen = seen.groupBy("blob_id").agg(F.collect_set("rule_version").alias("seen"))
        todo = blobs.join(seen, "blob_id", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    scanned = F.array_compact(
        F.array(*(F.when(F.array_contains("todo", r.version), F.struct(F.lit(r.version).alias("rule_version"), _spans(F.col("text"), r).alias("findings"))) for r in rules))
    )
    todo.select("blob_id", F.inline(scanned)).write.mode("append").parquet(ledger_path)


def find_secrets(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, text) -> (path, blob_id, findings) for every row, by way of the ledger at ``ledger_path``.

    An entry that two runs have added counts once.  Findings are put together and stored by blob
    first, so that the paths of one blob with many can be joined by several tasks.
    """
    update_ledger(versions, ledger_path, rules)
    current = _ledger(versions.sparkSession, ledger_path).filter(F.col("rule_version").isin([r.version for r in rules]) & (F.size("findings") > 0))
    entries = F.collect_set(F.struct("rule_version", "findings"))
    by_blob = stored(current.groupBy("blob_id").agg(F.flatten(F.transform(entries, lambda x: x["findings"])).alias("found")), "secret-findings")
    found = F.coalesce("found", F.array().cast(_FINDINGS)).alias("findings")
    return address(versions.select("path", "text")).select("path", "blob_id").join(by_blob, "blob_id", "left").select("path", "blob_id", found)


def first_saved(documents: DataFrame) -> DataFrame:
    """The earlier version of each document: as first saved, with its first line alone."""
    return documents.select(F.col("doc_id").alias("path"), F.substring_index("text", "\n", 1).alias("text"))


def _of_kind(kind: str):
    return lambda f: f["kind"] == kind


def _joined(findings: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end by start, then in order of the rules."""
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    spans = F.sort_array(F.transform(findings, lambda f: F.struct(f["start"].alias("start"), order[f["kind"]].alias("rank"), f["end"].alias("end"), f["kind"].alias("kind"))))
    return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def secret_digest(documents: DataFrame, ledger_path: str, more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Per document: counts and digest of the base rules' spans, and all spans as text."""
    rules = (*RULES, *more)
    found = find_secrets(documents.select(F.col("doc_id").alias("path"), "text"), ledger_path, rules)
    base = F.filter("findings", lambda f: f["kind"].isin([r.kind for r in RULES]))
    counts = [F.size(F.filter("findings", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in RULES]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(_joined(base, RULES).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings"), rules).alias("spans"))
