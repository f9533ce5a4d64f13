"""Exact top-k search by inner product with a pivot-distance index.

A vector counts as the whole numbers floor(SCALE * x).  Equal vectors are one entry with its
``top`` + 1 least vec_ids (more can't be among the answers), and are asked for once.

Index.  ``PIVOTS`` pivots are drawn, far from each other, from a sample of at most ``SAMPLE`` entries
(they affect the speed alone).  Every entry is keyed by its nearest pivot and the distance to it;
entries are sorted by this key, which splits a crowded pivot over many tasks, and cut into pages.  A
pivot's pages fall into ``RINGS`` annuli.  A page and an annulus know their least and largest
distance and their largest norm.

Search.  For a query at distance d of a pivot, whatever lies in an annulus [lo, hi] of that pivot is
at least g = max(lo - d, d - hi, 0) away (triangle inequality), and since
2 * inner = |q|^2 + |v|^2 - |q - v|^2, no score there is above (|q|^2 + norm - g^2) / 2.  A query's
annuli are expanded in falling order of this bound, ``FANS`` of them in each round, and the query
stops at the first one that is below its score of place ``top`` + 1.  Queries that lie near each
other form blocks; a page meets a block by a matrix product over the queries that still want it,
after the page's own bounds.  All annuli that the bounds can't rule out are read, so the result is
exact.  The queries are the stated query set; they are never broadcast.

Cases: rows with a null vec_id, a null vector, or a null or non-finite component take no part; a
shorter vector counts as followed by zeros, so an empty one scores 0; rows of one vec_id are rows of
their own, each a candidate of the other, and queries of their own; whole numbers are held within
32 bits and scores within 64; fewer candidates than ``top`` are all returned; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, stored

TOP, SCALE, ASKED = 20, 64, 20
PIVOTS, RINGS, SAMPLE = 64, 16, 4096
#: Annuli expanded up to rounds 1, 2, ...; after these all that are left.
FANS = (2, 16)
#: Numbers in a page and in a block of queries; vectors that one task compares with a block; scores held before the best are picked.
PAGE_CELLS, BLOCK_CELLS, PART_ROWS, HELD = 1 << 16, 1 << 16, 1 << 16, 1 << 20


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, z) of the rows that take part; z: whole numbers of 32 bits, end to end."""

    def run(batches):
        for batch in batches:
            lists = batch.column("x")
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            values = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (np.diff(bad[ends]) == 0) & lists.is_valid().to_numpy(zero_copy_only=False) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                z = np.clip(np.floor(scale * np.nan_to_num(values, posinf=0, neginf=0)), -(2**31) + 1, 2**31 - 1).astype("<i4")
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(z)])
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(kept), packed.filter(kept)], names=["vec_id", "z"])

    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, z binary")


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows of doubles, with zeros after the shorter ones."""
    if all(len(z) == 4 * dim for z in packed):
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), dim).astype(float)
    out = np.zeros((len(packed), dim))
    for k, z in enumerate(packed):
        out[k, : len(z) // 4] = np.frombuffer(z, "<i4")
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exactly: by doubles where no sum can leave 53 bits, else by Python's integers (held within 64 bits)."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = a.astype(np.int64).astype(object) @ b.T.astype(np.int64).astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def distances(z: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (z * z).sum(1)[:, None] - 2 * (z @ pivots.T) + (pivots * pivots).sum(1)))


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows of the sample, each the farthest from those before."""
    picked, gap = [0], np.full(len(sample), np.inf)
    while len(picked) < n:
        gap = np.minimum(gap, distances(sample, sample[picked[-1:]])[:, 0])
        if gap.max() <= 1e-6:
            break
        picked.append(int(gap.argmax()))
    return sample[picked]


class Keys(NamedTuple):
    """Pivots, and the distances at which the annuli of each begin (after the first)."""

    pivots: np.ndarray
    edges: np.ndarray

    def of(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, annulus and distance of each vector."""
        apart = distances(z, self.pivots)
        cell = apart.argmin(1)
        near = apart[np.arange(len(z)), cell]
        return cell, (near[:, None] >= self.edges[cell]).sum(1), near


def fit_keys(sample: np.ndarray) -> Keys:
    pivots = far_apart(sample, PIVOTS)
    apart = distances(sample, pivots)
    cell = apart.argmin(1)
    levels = np.arange(1, RINGS) / RINGS
    return Keys(pivots, np.array([np.quantile(apart[cell == c, c], levels) for c in range(len(pivots))]))


def index_pages(entries: DataFrame, keys: Keys, dim: int) -> DataFrame:
    """Sorted pages (cell, ring, lo, hi, norm, entry, least, z) of the entries (entry, least, z)."""

    def key(batches):
        for batch in batches:
            z = matrix(batch.column("z").to_pylist(), dim)
            cell, ring, near = keys.of(z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(ring, pa.int32()), pa.array(near), pa.array((z * z).sum(1))], names=["entry", "least", "z", "cell", "ring", "near", "norm"])

    keyed = entries.select("entry", "least", "z").mapInArrow(key, "entry long, least long, z binary, cell int, ring int, near double, norm double")
    rows = max(1, PAGE_CELLS // max(1, dim))
    names = ["cell", "ring", "lo", "hi", "norm", "entry", "least", "z"]

    def page(held):
        near, norm = held["near"].to_numpy(), held["norm"].to_numpy()
        one = [[held["cell"][0].as_py()], [held["ring"][0].as_py()], [near.min()], [near.max()], [norm.max()], *([held[c].to_pylist()] for c in ("entry", "least", "z"))]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, kinds)], names=names)

    def cut(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            ring = held["cell"].to_numpy().astype(np.int64) * RINGS + held["ring"].to_numpy()
            turns = [0, *(np.flatnonzero(np.diff(ring)) + 1).tolist(), len(ring)]
            done = 0
            for lo, hi in zip(turns, turns[1:]):
                for at in range(lo, hi, rows):
                    if at + rows <= hi or hi < len(ring):
                        done = min(at + rows, hi)
                        yield page(held.slice(at, done - at))
            held = held.slice(done)
        if held is not None and held.num_rows:
            ring = held["ring"].to_numpy()
            for part in np.split(np.arange(len(ring)), np.flatnonzero((np.diff(ring) != 0) | (np.diff(held["cell"].to_numpy()) != 0)) + 1):
                for at in range(0, len(part), rows):
                    yield page(held.slice(part[at], min(rows, len(part) - at)))

    ordered = keyed.repartitionByRange("cell", "near", "entry").sortWithinPartitions("cell", "near", "entry")
    return ordered.mapInArrow(cut, "cell int, ring int, lo double, hi double, norm double, entry array<long>, least array<long>, z array<binary>")


class Directory(NamedTuple):
    """Cell, ring, least and largest distance and largest norm of each annulus."""

    cell: np.ndarray
    ring: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    norm: np.ndarray


def bounds(norm: np.ndarray, apart: np.ndarray, lo: np.ndarray, hi: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """What no score of a query (norm, distance to the pivot) with a vector of an annulus exceeds, a trifle added for rounding."""
    gap = np.maximum(0, np.maximum(lo - apart, apart - hi))
    most = norm + largest
    return (most - gap * gap) / 2 + 1e-6 + 1e-9 * most


def wanted(queries: DataFrame, keys: Keys, directory: Directory, dim: int, start: int, end: int) -> DataFrame:
    """(query, z, tau, block, rings): for each query the annuli of places ``start`` to ``end`` in its order that may hold a score of tau or more."""

    def run(batches):
        for batch in batches:
            z = matrix(batch.column("z").to_pylist(), dim)
            apart = distances(z, keys.pivots)[:, directory.cell]
            most = bounds((z * z).sum(1)[:, None], apart, directory.lo, directory.hi, directory.norm)
            order = np.lexsort((apart, -most), axis=1)[:, start:end]
            tau = pc.fill_null(batch.column("tau").cast(pa.float64()), -np.inf).to_numpy(zero_copy_only=False)
            kept = np.take_along_axis(most, order, 1) >= tau[:, None]
            rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept.sum(1))]), pa.int32()), pa.array(order[kept], pa.int32()))
            some = pa.array(kept.any(1))
            yield pa.RecordBatch.from_arrays([x.filter(some) for x in (*(batch.column(c) for c in ("query", "z", "tau", "block")), rings)], names=["query", "z", "tau", "block", "rings"])

    return queries.select("query", "z", "tau", "block").mapInArrow(run, "query long, z binary, tau long, block long, rings array<int>")


class Block:
    """Queries compared at once, and the best entries of each found so far."""

    def __init__(self, rows: dict, keys: Keys, directory: Directory, dim: int, top: int):
        self.query, self.top = np.array(rows["query"], np.int64), top
        self.z = matrix(rows["z"], dim)
        self.norm, self.apart = (self.z * self.z).sum(1), distances(self.z, keys.pivots)
        self.tau = np.array([-np.inf if t is None else t for t in rows["tau"]], float)
        self.wants = np.zeros((len(self.query), len(directory.cell)), bool)
        for k, rings in enumerate(rows["rings"]):
            self.wants[k, rings] = True
        self.held, self.size = [], 0

    def meet(self, ring: int, cell: int, lo: float, hi: float, norm: float, entry: np.ndarray, least: np.ndarray, z: np.ndarray) -> None:
        near = np.flatnonzero(self.wants[:, ring] & (bounds(self.norm, self.apart[:, cell], lo, hi, norm) >= self.tau))
        if len(near):
            scores = inner(self.z[near], z)
            q, v = np.nonzero(scores >= self.tau[near, None])
            self.held.append((near[q], scores[q, v], least[v], entry[v]))
            self.size += len(q)
            if self.size > HELD:
                self.pick()

    def pick(self) -> None:
        q, score, least, entry = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((entry, least, -score, q))
        first = np.searchsorted(q[order], np.arange(len(self.query)))
        order = order[np.arange(len(order)) - first[q[order]] < self.top]
        self.held = [(q[order], score[order], least[order], entry[order])]
        self.size = len(order)
        full = np.bincount(q[order], minlength=len(self.query)) == self.top
        lowest = np.full(len(self.query), np.inf)
        np.minimum.at(lowest, q[order], score[order])
        self.tau[full] = np.maximum(self.tau[full], lowest[full])

    def best(self) -> pa.RecordBatch:
        if self.held:
            self.pick()
        q, score, least, entry = self.held[0] if self.held else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.query[q], entry, least, score)], names=["query", "entry", "least", "score"])


def compare(queries: DataFrame, pages: DataFrame, keys: Keys, directory: Directory, dim: int, parts: int, top: int) -> DataFrame:
    """(query, entry, least, score): the best entries of each query among the annuli that it wants, ``top`` of each task.

    A block of queries goes to every part of the pages that it wants, a page to every block that wants it.
    """
    part = F.pmod(F.xxhash64(F.get("entry", F.lit(0))), F.lit(parts))
    asked = queries.select("block", F.explode("rings").alias("number")).distinct()
    sent = pages.withColumn("part", part).join(asked, "number")
    blocks = queries.join(sent.select("block", "part").distinct(), "block")
    null = lambda kind: F.lit(None).cast(kind)
    left = blocks.select("block", "part", F.lit(-1).alias("number"), "query", "tau", "rings", F.array("z").alias("z"), *(null("double").alias(c) for c in ("lo", "hi", "norm")), *(null("array<long>").alias(c) for c in ("entry", "least")))
    right = sent.select("block", "part", "number", null("long").alias("query"), null("long").alias("tau"), null("array<int>").alias("rings"), "z", "lo", "hi", "norm", "entry", "least")

    def run(batches):
        key, block, rows = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["number"] < 0:
                    if key != (r["block"], r["part"]) or block is not None:
                        if block is not None:
                            yield block.best()
                        key, block, rows = (r["block"], r["part"]), None, {c: [] for c in ("query", "z", "tau", "rings")}
                    for c in rows:
                        rows[c].append(r["z"][0] if c == "z" else r[c])
                    continue
                if block is None:
                    block = Block(rows, keys, directory, dim, top)
                block.meet(r["number"], int(directory.cell[r["number"]]), r["lo"], r["hi"], r["norm"], np.array(r["entry"], np.int64), np.array(r["least"], np.int64), matrix(r["z"], dim))
        if block is not None:
            yield block.best()

    dealt = left.unionByName(right).repartition("block", "part").sortWithinPartitions("block", "part", "number")
    return dealt.mapInArrow(run, "query long, entry long, least long, score long")


def _first(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def best_entries(entries: DataFrame, asked: DataFrame, kept: Scratch, top: int) -> DataFrame:
    """(query, entry, score): the ``top`` best entries of each entry ``asked`` (query, z)."""
    dim = (entries.agg(F.max(F.length("z"))).first()[0] or 0) // 4
    sample = [bytes(r["z"]) for r in entries.select("z").orderBy(F.xxhash64("z"), "z").limit(SAMPLE).collect()]
    if not sample:
        return entries.select(F.col("entry").alias("query"), "entry", F.lit(0).cast("long").alias("score"))
    keys = fit_keys(matrix(sample, dim))
    pages = kept.stored(index_pages(entries, keys, dim), "pages")
    found = pages.groupBy("cell", "ring").agg(F.min("lo"), F.max("hi"), F.max("norm"), F.sum(F.size("entry"))).collect()  # PIVOTS * RINGS rows at most
    directory = Directory(*(np.array(c) for c in list(zip(*sorted(map(tuple, found))))[:5]))
    number = {(int(c), int(r)): k for k, (c, r) in enumerate(zip(directory.cell, directory.ring))}
    numbers = F.create_map(*(F.lit(x) for (c, r), k in number.items() for x in (c * RINGS + r, k)))
    pages = pages.withColumn("number", numbers[F.col("cell") * RINGS + F.col("ring")])
    parts = -(-sum(r[5] for r in found) // PART_ROWS)

    def home(batches):
        for batch in batches:
            cell, _, _ = keys.of(matrix(batch.column("z").to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["query", "z", "cell"])

    at_home = kept.stored(asked.mapInArrow(home, "query long, z binary, cell int"), "queries")
    size = max(1, BLOCK_CELLS // max(1, dim))
    counts = dict(sorted(at_home.groupBy("cell").count().collect()))  # PIVOTS rows at most
    before = dict(zip(counts, np.cumsum([0, *counts.values()]).tolist()))
    table = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, F.struct(F.lit(before[c]).alias("before"), F.lit(n).alias("n"))))) if counts else None
    if table is None:
        return entries.filter("false").select(F.col("entry").alias("query"), "entry", F.lit(0).cast("long").alias("score"))
    block = F.floor((table[F.col("cell")]["before"] + F.pmod(F.xxhash64("query"), table[F.col("cell")]["n"])) / size)
    queries, best = kept.stored(at_home.select("query", "z", block.alias("block")), "blocks"), None
    for start, end in zip((0, *FANS), (*FANS, len(directory.cell))):
        tau = queries.withColumn("tau", F.lit(None).cast("long"))
        if best is not None:
            reached = best.groupBy("query").agg(F.min("score").alias("tau"), F.count("score").alias("n")).filter(F.col("n") >= top).drop("n")
            tau = queries.join(reached, "query", "left")
        todo = kept.stored(wanted(tau, keys, directory, dim, start, max(start, end)), "wanted")
        if todo.isEmpty():
            break
        new = compare(todo, pages, keys, directory, dim, parts, top)
        best = new if best is None else best.unionByName(new)
        best = kept.stored(_first(best, "query", [F.desc("score"), F.col("least"), F.col("entry")], top), "best")
    return best.select("query", "entry", "score")


def top_inner(vectors: DataFrame, top: int = TOP, asked: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``asked`` the ``top`` best other rows."""
    with Scratch() as kept:
        rows = kept.stored(whole_vectors(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
        # More than top + 1 rows of one vector can't be among the answers.
        least = _first(rows, "z", [F.col("vec_id"), F.col("row")], top + 1)
        ids = F.sort_array(F.collect_list(F.struct("vec_id", "row")))
        entries = kept.stored(least.groupBy("z").agg(ids.alias("ids")).select(F.monotonically_increasing_id().alias("entry"), F.col("ids")[0]["vec_id"].alias("least"), "z", "ids"), "entries")
        queries = kept.stored(rows.filter(F.col("vec_id") % asked == 0).join(entries.select("z", "entry"), "z").select("row", "vec_id", F.col("entry").alias("query")), "asked")
        found = best_entries(entries, queries.select("query").distinct().join(entries.select(F.col("entry").alias("query"), "z"), "query"), kept, top + 1)
        each = found.join(entries.select("entry", F.explode("ids").alias("id")), "entry").select("query", (-F.col("score")).alias("less"), "id")
        each = _first(each, "query", [F.col("less"), F.col("id.vec_id"), F.col("id.row")], top + 1)
        answers = kept.stored(each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("less", "id"))).alias("found")), "answers")
        own = queries.join(answers, "query").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("found", lambda x: x["id"]["row"] != F.col("row")), 1, top)).alias("at", "x"))
        return stored(own.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score")), "top-inner")
