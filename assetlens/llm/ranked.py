"""Exact ranked lexical search by NRA (no random access) over impact-sorted lists.

Index.  Documents are read once, where they lie.  Each task cuts its documents into segments of
about ``SEGMENT`` postings: for every term that some item asks for, the documents that hold it and
how often.  The corpus statistics (documents, terms, documents of a term) are sums over segments.

Search.  In a segment each list is sorted by impact.  An item reads its lists from the front, some
entries more in each round, and keeps an interval for every document: the lower end is what has
been read of it, the upper end adds, for each list that it hasn't shown up in, the last impact read
there (nothing once a list is at its end).  A document is out when its upper end lies below the
score that ``top`` documents are known to reach, those of earlier segments of the task included.
Only lists that an open document may still be in are read on.  Reading ends when every document is
out or its interval is a point, so membership, ties and scores are final; equal scores are kept,
and told apart by doc_id.  The best of each task meet in one ranking for each item.

The items are the stated query set; they are taken in blocks of ``ITEM_BYTES`` of text, whose terms
(never more than that text) are what is broadcast, with the corpus statistics of these terms.

Cases: a null text, or one without terms, is no document of the statistics and in no result; rows of
one doc_id are documents of their own; a row without doc_id counts in the statistics and is in no
result; a text of any length is read whole, in stretches of ``STRETCH`` bytes; rows of one item_id
are one item that asks for the terms of all of them (a null item_id too); items without terms, or
whose terms occur nowhere, have no rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, slices, stored, texts_of

TOP = 10
#: Postings of a segment; bytes of item text in a block; bytes of text split at once; entries read of each list in the first round, and growth.
SEGMENT, ITEM_BYTES, STRETCH = 1 << 20, 8 << 20, 1 << 20
DEPTH, DEEPER = 256, 4
#: Upper case becomes lower case; every other ASCII character but digits and letters a space.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
_SEGMENT = "docs long, terms long, doc_id array<long>, n array<long>, term array<int>, df array<int>, held array<int>, doc array<int>, tf array<int>"


def terms_in(text: bytes, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch at a time; no term is cut."""
    text, lo = text.translate(_FOLD), 0
    while lo < len(text):
        hi = text.find(b" ", lo + stretch)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


class Counts(NamedTuple):
    """A document: its id, its terms with repeats, and numbers and occurrences of the terms asked for."""

    doc_id: int | None
    n: int
    terms: list[int]
    tf: list[int]


def counted(doc_id: int | None, text: bytes, number: dict[bytes, int]) -> Counts:
    n, found = 0, Counter()
    for words in terms_in(text):
        n += len(words)
        here = Counter(words)
        for w in number.keys() & here.keys():
            found[number[w]] += here[w]
    return Counts(doc_id, n, list(found), list(found.values()))


def segment(docs: list[Counts]) -> list:
    """A row of the index.  ``df`` counts all documents, ``held`` those in the lists: rows with a doc_id."""
    named = [d for d in docs if d.doc_id is not None]
    everywhere = np.array([t for d in docs for t in d.terms], np.int64)
    term, df = np.unique(everywhere, return_counts=True)
    own = np.array([t for d in named for t in d.terms], np.int64)
    order = np.argsort(own, kind="stable")
    doc = np.repeat(np.arange(len(named)), [len(d.terms) for d in named])[order]
    tf = np.array([c for d in named for c in d.tf], np.int64)[order]
    held = np.bincount(np.searchsorted(term, own), minlength=len(term))
    return [sum(d.n > 0 for d in docs), sum(d.n for d in docs), [d.doc_id for d in named], [d.n for d in named], term, df, held, doc, tf]


def index_segments(docs: DataFrame, vocabulary) -> DataFrame:
    """The segments of the documents; ``vocabulary``: broadcast terms, joined by spaces, numbered in order."""
    kinds = [f.dataType for f in T.StructType.fromDDL(_SEGMENT)]
    names = [f.name for f in T.StructType.fromDDL(_SEGMENT)]

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array([x], to_arrow_type(k)) for x, k in zip(segment(held), kinds)], names=names)

    def run(batches):
        number = {w: k for k, w in enumerate(vocabulary.value.split())}
        held, size = [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                held.append(counted(doc_id, text, number))
                size += len(held[-1].terms) + 1
                if size >= SEGMENT:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SEGMENT)


class Impacts(NamedTuple):
    """A term's list: documents of the segment by falling impact."""

    docs: np.ndarray
    gains: np.ndarray


def nra(lists: list[Impacts], n_docs: int, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment (ascending) that score ``least`` or more and are among its best ``top``, ties included, and their scores.

    Sums of impacts are whole numbers below 2**53, so doubles hold them exactly.
    """
    size = np.array([len(x.docs) for x in lists])
    at, depth = np.zeros(len(lists), np.int64), DEPTH
    reading = size > 0
    while True:
        at = np.where(reading, np.minimum(size, at + depth), at)
        depth *= DEEPER
        last = np.array([x.gains[a - 1] if 0 < a < n else 0 for x, a, n in zip(lists, at, size)], float)
        docs = np.concatenate([x.docs[:a] for x, a in zip(lists, at)])
        owner = np.repeat(np.arange(len(lists)), at)
        low = np.bincount(docs, np.concatenate([x.gains[:a] for x, a in zip(lists, at)]), n_docs)
        upper = low + last.sum() - np.bincount(docs, last[owner], n_docs)
        reached = max(least, np.partition(low, -top)[-top]) if n_docs >= top else least
        in_reach = upper >= reached
        open_ = in_reach & (upper > low)
        if not open_.any():
            found = np.flatnonzero(in_reach)
            return found, low[found].astype(np.int64)
        reading = (last > 0) & (np.bincount(owner, open_[docs], len(lists)) < open_.sum())


class Items(NamedTuple):
    """A block of items: their ids, and for each the numbers of its terms with repeats; statistics of the terms."""

    ids: list
    asked: list[dict[int, int]]
    weight: np.ndarray
    n_docs: int
    n_terms: int


def search_segment(row: dict, items: Items, best: list[list[tuple[int, int]]], top: int) -> None:
    """Merges the best documents of a segment into ``best``: (-score, doc_id) of each item, ascending."""
    doc_id, n, term = row["doc_id"], row["n"], row["term"]
    m = 100 - 75 + (75 * n * items.n_docs) // items.n_terms
    owner = np.repeat(np.arange(len(term)), row["held"])
    impact = (1_000_000_000 * row["tf"]) // (1000 * row["tf"] + 8 * m[row["doc"]])
    order = np.lexsort((row["doc"], -impact, owner))
    doc, impact = row["doc"][order], impact[order]
    starts = np.concatenate([[0], np.cumsum(row["held"])])
    place = {t: k for k, t in enumerate(term.tolist())}
    for k, asked in enumerate(items.asked):
        lists = []
        for t, times in asked.items():
            if (at := place.get(t)) is not None and starts[at] < starts[at + 1] and items.weight[t]:
                here = slice(starts[at], starts[at + 1])
                lists.append(Impacts(doc[here], impact[here] * (items.weight[t] * times)))
        if lists:
            least = -best[k][top - 1][0] if len(best[k]) >= top else 1
            found, scores = nra(lists, len(doc_id), top, least)
            best[k] = sorted([*best[k], *zip((-scores).tolist(), doc_id[found].tolist())])[:top]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    return [items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def _search(docs: DataFrame, block: DataFrame, kept: Scratch, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best of each task for the items of a block."""
    context, item_type = docs.sparkSession.sparkContext, block.schema["item_id"].dataType
    number: dict[bytes, int] = {}
    asked: dict[object, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for item_id, text in block.collect():
        for words in terms_in((text or "").encode()):
            for w in words:
                asked[item_id][number.setdefault(w, len(number))] += 1
    index = kept.stored(index_segments(docs, context.broadcast(b" ".join(number))), "ranked-segments")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    weight = np.zeros(len(number), np.int64)
    pairs = index.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    for t, df in pairs.collect():  # the terms of a block at most
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    sent = context.broadcast(Items(list(asked), [dict(x) for x in asked.values()], weight, n_docs, n_terms))

    def run(batches):
        items = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in items.ids]
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "n", "term", "held", "doc", "tf")}
                search_segment(row, items, best, top)
        rows = [(items.ids[k], d, -s) for k, found in enumerate(best) for s, d in found]
        cols = list(zip(*rows)) or [()] * 3
        kinds = (to_arrow_type(item_type), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=["item_id", "doc_id", "score"])

    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return index.select("doc_id", "n", "term", "held", "doc", "tf").mapInArrow(run, schema)


def ranked_search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item."""
    with Scratch() as kept:
        found = None
        for block in _blocks(benchmark, block_bytes):
            part = kept.stored(_search(docs, block, kept, top), "ranked-best")
            found = part if found is None else found.unionByName(part)
        rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
        return stored(found.withColumn("rank", rank).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"), "ranked")
