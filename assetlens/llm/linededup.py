"""Line deduplication by a log-template tree of fixed depth.

A line's tokens that hold a digit, "@" or "://" are variable fields and become ``<*>``.  The tree
is parsed by the number of tokens, then by the ``LEAD`` leading tokens.  A leaf holds any number of
templates, of two kinds:

* a line of ``LEAST`` tokens or more with one token after the leading ones left open: all lines of the
  leaf that differ in this token alone are of this template, whatever else the leaf holds;
* in a branch (a block of tokens: a line of n tokens has n // OPEN + 1 equal ones, and at least two from
  ``LEAST`` tokens on) the first line in order of doc_id and line: a line of the branch that differs from it in at
  most n // OPEN tokens joins it, and the positions that differ are open.

So up to 19 tokens, where at most one may be open, every two lines that are near enough share a template;
of longer lines each joins every line that differs in one token, and the first of each branch in more.
Templates that share a line are one.  Two lines that are near share a block, and all blocks but one if
they differ in one token, so only such lines are read again and opened.  Branches and templates are
found by hash and split over tasks: no leaf is gathered in one, and only a line's distance to the first
lines of its branches is measured, on the tokens.

A template that recurs in two documents or more is boilerplate: of all its lines, those of all
templates joined to it included, only the first in order of doc_id and line stays.

Cases: null or empty text has one empty line; lines without a token are left alone; rows of one
doc_id count as one document; a null doc_id takes no part (nothing is dropped); a text or line of
any length is read whole; an empty table gives no rows; other columns are ignored by
``recurring_lines`` and kept by ``drop_lines``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, mix64, only, slices, stored, texts_of, words_in
from .jaccard import components

LEAD, OPEN, LEAST = 2, 10, 5
FIELD = "<*>"
_VARIABLE = np.zeros(256, bool)
_VARIABLE[[*b"0123456789@"]] = True
_FIELD_HASH = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x589965CC75374CC3))


@dataclass
class Lines:
    """The lines with tokens of some texts: text and number of each, hashes of all tokens, first token and count of each."""

    owner: np.ndarray
    number: np.ndarray
    halves: tuple[np.ndarray, np.ndarray]
    start: np.ndarray
    n: np.ndarray
    words: Words
    variable: np.ndarray

    def terms(self) -> list[np.ndarray]:
        """For both halves, hashes of all tokens mixed with their places in the line."""
        place = (np.arange(self.n.sum()) - np.repeat(self.start, self.n)).astype(np.uint64) + np.uint64(1)
        out = []
        for half in self.halves:
            place = mix64(place)
            out.append(mix64(half ^ place))
        return out

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each masked line: its terms summed up."""
        return tuple(mix64(np.add.reduceat(t, self.start) + self.n.astype(np.uint64)) for t in self.terms())

    def open_ids(self, picked: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """128 bits of each of the lines ``wanted`` with one token after the leading ones left open: the sum without its term, and its
        place; and how many there are before each line."""
        n = np.where(wanted & (self.n[picked] >= LEAST), self.n[picked] - LEAD, 0)
        before = np.concatenate([[0], np.cumsum(n)])
        owner = np.repeat(np.arange(len(picked)), n)
        at = np.arange(before[-1]) - before[owner] + LEAD
        token = self.start[picked][owner] + at
        mark = at.astype(np.uint64) + (self.n[picked][owner].astype(np.uint64) << np.uint64(32))
        ids = []
        for t in self.terms():
            mark = mix64(mark + np.uint64(0x9E3779B97F4A7C15))
            ids.append(mix64(np.add.reduceat(t, self.start)[picked][owner] - t[token] + mark).view(np.int64))
        return before, *ids

    def branches(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the branches of each line (number of tokens, leading tokens, block), and where each line's start."""
        place = np.arange(self.n.sum()) - np.repeat(self.start, self.n)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(self.halves[0] + place.astype(np.uint64)))])
        leaf = mix64(upto[self.start + np.minimum(self.n, LEAD)] - upto[self.start] + self.n.astype(np.uint64))
        blocks = np.maximum(self.n // OPEN + 1, np.where(self.n >= LEAST, 2, 1))
        first = np.cumsum(blocks) - blocks
        owner = np.repeat(np.arange(len(self.n)), blocks)
        b = np.arange(blocks.sum()) - first[owner]
        lo, hi = (self.start[owner] + self.n[owner] * x // blocks[owner] for x in (b, b + 1))
        return mix64(upto[hi] - upto[lo] + mix64(leaf[owner] + b.astype(np.uint64))).view(np.int64), first

    def text(self, k: int) -> str:
        """Masked tokens of line k between single blanks."""
        w, here = self.words, range(self.start[k], self.start[k] + self.n[k])
        if not self.variable[here.start : here.stop].any():
            return " ".join(w.data[w.starts[here.start] : w.ends[here.stop - 1]].tobytes().decode().split())
        return " ".join(FIELD if self.variable[i] else w.data[w.starts[i] : w.ends[i]].tobytes().decode() for i in here)


def lines_of(texts: list[bytes]) -> Lines:
    words = words_in(texts)
    data = words.data
    marks = np.cumsum(_VARIABLE[data])
    variable = marks[words.ends - 1] > marks[words.starts] - _VARIABLE[data[words.starts]]
    colon = np.flatnonzero(data[:-2] == ord(":"))
    colon = colon[(data[colon + 1] == ord("/")) & (data[colon + 2] == ord("/"))]
    variable[np.searchsorted(words.starts, colon, "right") - 1] = True
    halves = tuple(np.where(variable, field, h) for h, field in zip(words.hashes(), _FIELD_HASH))
    breaks = np.flatnonzero(data == ord("\n"))
    line = np.searchsorted(breaks, words.starts)  # over all texts
    start = np.flatnonzero(np.diff(line, prepend=-1))
    at = line[start]
    owner = np.searchsorted(words.upto, start, "right")
    first_line = np.concatenate([[0], np.searchsorted(breaks, np.cumsum([len(t) + 1 for t in texts]))])[owner]
    return Lines(owner, at - first_line, halves, start, np.diff(start, append=len(line)), words, variable)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")


def parsed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, line, id1, id2, branches) of each line that has a token."""

    def run(batches):
        for batch in slices(batches):
            lines = lines_of(texts_of(batch.column("text")))
            if len(lines.n):
                keys, first = lines.branches()
                ids = [pa.array(x.view(np.int64)) for x in lines.ids()]
                owner = [batch.column(c).take(pa.array(lines.owner)) for c in ("doc_id", "version")]
                branches = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)), pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([*owner, pa.array(lines.number, pa.int32()), *ids, branches], names=["doc_id", "version", "line", "id1", "id2", "branches"])

    return _rows(docs).withColumn("version", version(F.col("text"))).mapInArrow(run, "doc_id long, version long, line int, id1 long, id2 long, branches array<long>")


def line_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, line, version, masked, t1, t2) of the lines at the places ``chosen``; t1, t2: the open templates of those that are ``near``."""
    places = chosen.groupBy("doc_id", "version").agg(F.collect_set("line").alias("chosen"), F.collect_set(F.when(F.col("near"), F.col("line"))).alias("near"))
    rows = _rows(docs).withColumn("version", version(F.col("text"))).join(places.hint("merge"), ["doc_id", "version"]).select("doc_id", "version", "text", "chosen", "near")

    def run(batches):
        for batch in slices(batches):
            lines = lines_of(texts_of(batch.column("text")))
            named = lines.owner << 32 | lines.number
            told = []
            for wanted in (batch.column("chosen"), batch.column("near")):
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy())
                told.append(np.isin(named, owner << 32 | wanted.flatten().to_numpy()))
            picked = np.flatnonzero(told[0])
            doc_id, at = (batch.column(c).take(pa.array(lines.owner[picked])) for c in ("doc_id", "version"))
            texts = pa.array([lines.text(k) for k in picked.tolist()], pa.string())
            before, *ids = lines.open_ids(picked, told[1][picked]) if len(picked) else (np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 2)
            opened = [pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(x)) for x in ids]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(lines.number[picked], pa.int32()), at, texts, *opened], names=["doc_id", "line", "version", "masked", "t1", "t2"])

    return rows.mapInArrow(run, "doc_id long, line int, version long, masked string, t1 array<long>, t2 array<long>")


def version(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text)


def _fits(a: Column, b: Column) -> Column:
    """Whether masked lines share the leaf and differ in at most one token of OPEN."""
    x, y = F.split(a, " "), F.split(b, " ")
    differ = F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d))
    return (F.size(x) == F.size(y)) & (F.slice(x, 1, LEAD) == F.slice(y, 1, LEAD)) & (differ <= F.floor(F.size(x) / OPEN))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n_lines, n_dropped, dropped) of every row; ``dropped``: line numbers, ascending, from 0."""
    # What is joined grows with the input, so it is never broadcast: the plan is the same at any size.
    with Scratch() as kept:
        parsed = kept.stored(parsed_lines(docs), "parsed-lines")
        place = F.struct("doc_id", "line", "version")
        lines = kept.stored(parsed.groupBy("id1", "id2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(place).alias("first"), F.first("branches").alias("branches")), "lines")
        at = lines.select(F.explode("branches").alias("branch"), F.size("branches").alias("blocks"), "first")
        heads = kept.stored(at.groupBy("branch").agg(F.min("first").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("branch", "u"), "heads").hint("merge")
        shared = kept.stored(at.join(heads, "branch").select("u", "first", "blocks"), "shared-blocks")
        pairs = kept.stored(shared.filter("u <> first").select("u", F.col("first").alias("v")).distinct(), "pairs")
        # A line that differs from another one in one token shares all its blocks but one.
        places = shared.groupBy("first").agg((F.max("blocks") - F.count(F.lit(1)) <= 1).alias("near")).select("first.*", "near")
        read = kept.stored(line_texts(docs, places).select(place.alias("at"), "masked", "t1", "t2").dropDuplicates(["at"]), "line-texts")
        texts = read.select("at", "masked").hint("merge")
        ends = pairs.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v").filter(_fits(F.col("a"), F.col("b")))
        opened = read.select("at", F.explode(F.arrays_zip("t1", "t2")).alias("t")).select("t.t1", "t.t2", "at")
        recur = kept.stored(opened.groupBy("t1", "t2").agg(F.min("at").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared-templates").hint("merge")
        alike = opened.join(recur, ["t1", "t2"]).filter("u <> at").select("u", F.col("at").alias("v"))
        roots = components(ends.select("u", "v").unionByName(alike), kept).toDF("first", "root")
        roots = kept.stored(roots.unionByName(roots.select(F.col("root").alias("first"), "root").distinct()), "roots").hint("merge")
        # A template's root is its first line.
        joined = lines.drop("branches").join(roots, "first")
        merged = joined.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("root").hint("merge")
        alone = lines.filter("low <> high").join(roots, "first", "left_anti").select("id1", "id2", "first")
        recurring = kept.stored(alone.unionByName(joined.join(merged, "root").select("id1", "id2", F.col("root").alias("first"))), "recurring").hint("merge")
        gone = parsed.join(recurring, ["id1", "id2"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line") != F.col("first.line")))
        gone = gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version(F.col("text")).alias("version"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
        n, dropped = F.coalesce(F.size("dropped"), F.lit(0)).cast("long"), F.coalesce("dropped", F.array().cast("array<int>"))
        return stored(rows.join(gone.hint("merge"), ["doc_id", "version"], "left").select("doc_id", "version", "n_lines", n.alias("n_dropped"), dropped.alias("dropped")), "recurring-lines")


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that recur; lines are joined again by newlines."""
    lines = recurring_lines(docs).filter("n_dropped > 0").select("doc_id", F.col("version").alias("_version"), F.col("dropped").alias("_dropped")).distinct()
    left = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("_dropped", i), x)), lambda x: x.isNotNull())
    kept = only(docs, "_version", "_dropped").withColumn("_version", version(F.col("text"))).join(lines, ["doc_id", "_version"], "left")
    return kept.withColumn("text", F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(docs.columns)
