"""Trie of the conversations' shared beginnings, with a minimal-perfect-hash node table.

Rebuilding.  A conversation c starts with the first h turns of the conversation c - c % ``SERIES``
(h: CRC-32 of its decimal id, modulo ``LEADS``), followed by its own turns after its first h.

Prefix digests.  A turn's key is 128 bits of a keyed hash of role and text; the digest of the first
d turns is the sum of hashes of (place, key), in two 64-bit halves.  Sums can be put together from
parts, so turns are numbered and summed up in ranges of the sorted rows, and only what a range adds
to a conversation that spans several (two for each range at most) goes through the driver: one
conversation may hold any share of the rows.

Nodes.  Rows of one depth and digest are a node; last turn and parent must agree, else the digests
have collided and the job fails.  A node's name is its smallest member and its depth.

Node table.  Nodes with one member have one leaf below them and nothing to save; only the others are
summed up.  They are dealt into shards by the first turn.  A task gives the digests of its shards
slots 0..n-1 by a minimal perfect hash (``NodeTable``; what stands in the slot is compared, so a
foreign digest has none), scatters the counts into flat arrays, and adds them up through the array
of parent slots from the deepest level.  A shard of more than ``SHARD_NODES`` nodes is cut where it
first branches: what lies below becomes shards by the turn at that depth, cut again if need be, and
their sums are added to the nodes above the cut before these are summed up.

Cases: a null role or text is empty; turns are ordered by turn (null first), then role, then the
SHA-256 of the text; repeated rows are turns of their own; rows without conv_id take no part; a
conversation whose turns all go is a member of the root; an empty table gives no rows, not even a
root; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, slices, stored, texts_of, words_in

SERIES, LEADS = 20, 4
#: Nodes of a shard; characters of ids put together in one row.
SHARD_NODES, ID_CHARACTERS = 1 << 20, 1 << 16
NODE = ["d", "d1", "d2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, tie, k1, k2, words): 128 bits for each turn in place of its text."""

    def run(batches):
        for batch in slices(batches):
            roles, texts = texts_of(batch.column("role")), texts_of(batch.column("text"))
            keys = b"".join(hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16, key=b"turn").digest() for r, t in zip(roles, texts))
            keys = np.frombuffer(keys, "<i8").reshape(-1, 2)
            ties = pa.array([hashlib.sha256(t).hexdigest()[:16] for t in texts], pa.string())
            words = pa.array(words_in(texts).counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), ties, pa.array(keys[:, 0]), pa.array(keys[:, 1]), words], names=["conv_id", "turn", "role", "tie", "k1", "k2", "words"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), "text").filter("conv_id is not null")
    return rows.mapInArrow(run, "conv_id long, turn long, role string, tie string, k1 long, k2 long, words long")


def _runs(batches, column: str = "conv_id"):
    """Batches with the place of each row in its run of equal ids, and the start of each row's run in the batch (-1: before it)."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(column).to_numpy()
        new = np.diff(ids, prepend=~ids[:1]) != 0
        new[0] = ids[0] != last
        start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        place = np.where(start < 0, np.arange(len(ids)) + n, np.arange(len(ids)) - start)
        last, n = ids[-1], int(place[-1]) + 1
        yield batch, place, start


def _spanning(ranged: DataFrame, **values: Column) -> dict[int, list]:
    """What each range holds of the conversations that lie in several, in order of the ranges: two conversations of a range at most."""
    held = ranged.groupBy("conv_id", "part").agg(*(v.alias(c) for c, v in values.items()))
    parts = held.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", *values))).alias("parts"))
    return {r["conv_id"]: r["parts"] for r in parts.filter(F.size("parts") > 1).collect()}


def _beside(ranged: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """``ranged`` with the numbers told for (conv_id, part), 0 where none are; ``rows``: two for each range at most, so they are broadcast."""
    told = ranged.sparkSession.createDataFrame(rows, ", ".join(f"{c} long" for c in ("conv_id", "part", *names)))
    return ranged.join(F.broadcast(told), ["conv_id", "part"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def numbered_turns(turns: DataFrame, kept: Scratch) -> DataFrame:
    """(conv_id, pos, k1, k2, words): turns numbered from 1 in the order of their conversation."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "tie"]

    def run(batches):
        part = TaskContext.get().partitionId()
        for batch, place, _ in _runs(batches):
            columns = [batch.column(c) for c in ("conv_id", "k1", "k2", "words")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place + 1, pa.int64()), pa.array(np.full(len(place), part), pa.int64())], names=["conv_id", "k1", "k2", "words", "pos", "part"])

    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "conv_id long, k1 long, k2 long, words long, pos long, part long")
    ranged = kept.stored(ranged, "numbered-turns")
    before = []
    for conv, parts in _spanning(ranged, n=F.count(F.lit(1))).items():
        before += [(conv, p["part"], n) for p, n in zip(parts, np.cumsum([0, *(p["n"] for p in parts)]).tolist())]
    return _beside(ranged, before, ["before"]).withColumn("pos", F.col("pos") + F.col("before")).drop("part", "before")


def rebuilt(turns: DataFrame, kept: Scratch) -> DataFrame:
    """(conv_id, pos, k1, k2, words, last): the rebuilt conversations; one without turns has a row at 0."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEADS
    turn = F.struct("pos", "k1", "k2", "words")
    leads = turns.filter((F.col("pos") < LEADS) & (F.col("conv_id") % SERIES == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("lead"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % SERIES})
    lead = F.filter(F.coalesce("lead", F.array().cast("array<struct<pos:long,k1:long,k2:long,words:long>>")), lambda t: t["pos"] <= F.col("h"))
    convs = convs.join(leads, "base", "left").withColumn("lead", lead).withColumn("led", F.size("lead").cast("long"))
    convs = kept.stored(convs.withColumn("last", F.col("led") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("base", "n"), "rebuilt-heads")
    own = turns.join(convs.drop("lead"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("led")).alias("pos"), "k1", "k2", "words", "last")
    none = [F.lit(0).cast("long").alias(c) for c in ("pos", "k1", "k2", "words")]
    led = convs.select("conv_id", "last", F.explode(F.concat(F.array(F.struct(*none)), F.col("lead"))).alias("t")).select("conv_id", "t.pos", "t.k1", "t.k2", "t.words", "last")
    return own.unionByName(led)


def _place_hash(pos: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a turn at its place; none for the root's row."""
    at, a, b = (x.view(np.uint64) for x in (pos, k1, k2))
    one = mix64(mix64(at + np.uint64(0x9E3779B97F4A7C15)) ^ a) + b
    two = mix64(mix64(at ^ np.uint64(0xC2B2AE3D27D4EB4F)) + b) ^ a
    return tuple(np.where(pos > 0, mix64(x + np.uint64(salt)), np.uint64(0)) for x, salt in ((one, 1), (two, 2)))


def prefixes(rows: DataFrame, kept: Scratch) -> DataFrame:
    """(conv_id, d, d1, d2, p1, p2, first, k1, words, ends): digests of the first d turns and of those but the last; ``first``: of the first."""

    def run(batches):
        part = TaskContext.get().partitionId()
        base, head = np.zeros(2, np.uint64), np.uint64(0)
        for batch, _, start in _runs(batches):
            pos, k1, k2 = (batch.column(c).to_numpy() for c in ("pos", "k1", "k2"))
            own = _place_hash(pos, k1, k2)
            sums = []
            for i, x in enumerate(own):
                upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
                sums.append(upto[1:] - upto[np.maximum(start, 0)] + np.where(start < 0, base[i], np.uint64(0)))
            opening = np.where(pos == 1, own[0], np.uint64(0))  # rows 0 and 1 begin a conversation
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(opening)])
            first = upto[1:] - upto[np.maximum(start, 0)] + np.where(start < 0, head, np.uint64(0))
            base, head = np.array([s[-1] for s in sums], np.uint64), first[-1]
            numbers = [pa.array(x.view(np.int64)) for x in (*sums, *(s - x for s, x in zip(sums, own)), first)]
            ends = pa.array(pos == batch.column("last").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("pos"), *numbers, batch.column("k1"), batch.column("words"), ends, pa.array(np.full(len(pos), part), pa.int64())], names=["conv_id", "d", "d1", "d2", "p1", "p2", "first", "k1", "words", "ends", "part"])

    order = ["conv_id", "pos"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "conv_id long, d long, d1 long, d2 long, p1 long, p2 long, first long, k1 long, words long, ends boolean, part long")
    ranged = kept.stored(ranged, "prefixes")
    names, added = ["_d1", "_d2", "_first"], []
    for conv, parts in _spanning(ranged, **{c: F.max_by(c, "d") for c in ("d1", "d2", "first")}).items():
        upto = np.cumsum(np.array([(0, 0, 0), *((p["d1"], p["d2"], p["first"]) for p in parts)], np.int64).view(np.uint64), 0).view(np.int64).tolist()
        added += [(conv, p["part"], *v) for p, v in zip(parts, upto)]
    sums = {"d1": "_d1", "d2": "_d2", "p1": "_d1", "p2": "_d2", "first": "_first"}
    return _beside(ranged, added, names).withColumns({c: _wrapped(F.col(c), F.col(by)) for c, by in sums.items()}).drop("part", *names)


def _wrapped(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, as signed numbers, without overflow: by halves of 32 bits."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def trie_nodes(rows: DataFrame) -> DataFrame:
    """(d, d1, d2, p1, p2, first, words, conv_id, n_convs): a row for each distinct prefix."""
    same = [F.min(c) == F.max(c) for c in ("p1", "p2", "k1", "words")]
    agreed = F.when(same[0] & same[1] & same[2] & same[3], F.min("conv_id")).otherwise(F.raise_error(F.lit("digests of different prefixes are equal")).cast("long"))
    return rows.groupBy(*NODE).agg(*(F.min(c).alias(c) for c in ("p1", "p2", "first", "words")), agreed.alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))


class NodeTable:
    """Slots 0..n-1 for n different 128-bit digests, by a minimal perfect hash.

    On each level a digest is sent to a place of a bitmap; those alone at their place are settled there,
    the others go to the next level.  A slot is the rank of the place among all settled ones.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.levels, left, settled = [], np.arange(len(lo)), 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("a digest is given twice")
            at = self._place(lo[left], hi[left], len(self.levels), size := max(16, 2 * len(left)))
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, settled + np.cumsum(alone) - 1))
            settled += int(alone.sum())
            left = left[~alone[at]]
        self.lo, self.hi = np.zeros(len(lo), np.uint64), np.zeros(len(lo), np.uint64)
        own = self._slots(lo, hi)
        self.lo[own], self.hi[own] = lo, hi

    @staticmethod
    def _place(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(mix64(lo + np.uint64(level)) + hi) % np.uint64(size)).astype(np.int64)

    def _slots(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out, left = np.full(len(lo), -1), np.arange(len(lo))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(lo[left], hi[left], level, len(alone))
            out[left[alone[at]]] = rank[at[alone[at]]]
            left = left[~alone[at]]
        return out

    def slots(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The slot of each digest, told by comparing; -1: not in the table."""
        found = self._slots(lo, hi)
        return np.where((found >= 0) & (self.lo[found] == lo) & (self.hi[found] == hi), found, -1) if len(self.lo) else found


def summed_up(depth: np.ndarray, own: tuple, parent: tuple, counts: list[np.ndarray]) -> list[np.ndarray]:
    """``counts`` of each node with those of all nodes below it."""
    table = NodeTable(*own)
    slot = table.slots(*own)
    up = np.full(len(slot), -1)
    up[slot] = table.slots(*parent)
    flat = []
    for c in counts:
        flat.append(np.zeros(len(slot), np.int64))
        flat[-1][slot] = c
    order = np.argsort(-depth, kind="stable")
    for level in np.split(slot[order], np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[up[level] >= 0]
        for c in flat:
            np.add.at(c, up[level], c[level])
    return [c[slot] for c in flat]


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(d, d1, d2, p1, p2, top, leaves, saved) of nodes (..., shard, top, leaves, saved): ``leaves`` and ``saved`` summed up within each shard."""
    names = ["d", "d1", "d2", "p1", "p2", "top", "leaves", "saved"]

    def flushed(table: pa.Table):
        c = {x: table[x].to_numpy() for x in names}
        halves = {x: c[x].view(np.uint64) for x in names[1:5]}
        sums = summed_up(c["d"], (halves["d1"], halves["d2"]), (halves["p1"], halves["p2"]), [c["leaves"], c["saved"]])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*(c[x] for x in names[:6]), *sums)], names=names)

    def run(batches):
        held, n, last = [], 0, None  # whole shards, and the rows of the one that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy()
            starts = np.flatnonzero(np.diff(shard, prepend=shard[0] if last is None else last))
            if n >= SHARD_NODES and len(starts):
                if starts[0]:
                    held.append(batch.slice(0, starts[0]))
                yield flushed(pa.Table.from_batches(held))
                held, batch = [], batch.slice(starts[0])
            held.append(batch)
            n, last = sum(b.num_rows for b in held), shard[-1]
        if held:
            yield flushed(pa.Table.from_batches(held))

    schema = ", ".join(f"{c} long" for c in names)
    return nodes.select(*names, "shard").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def shared_sums(shared: DataFrame, rows: DataFrame, kept: Scratch, shard_nodes: int) -> DataFrame:
    """(d, d1, d2, p1, p2, top, leaves, saved) of the nodes below the root that several conversations share.

    Shards that are too large are cut; each round of cuts is a level, summed up from the last one.
    """
    todo = kept.stored(shared.withColumns({"shard": F.col("first"), "top": F.lit(1).cast("long")}), "shared-nodes")
    levels = []
    while True:
        large = todo.groupBy("shard", "top").count().filter(F.col("count") > shard_nodes)
        if large.isEmpty():
            levels.append(todo)
            break
        at_depth = todo.join(large.select("shard", "top"), ["shard", "top"]).groupBy("shard", "top", "d").count()
        # Above the cut there is one node at each depth, and no more than a shard may have.
        cut = at_depth.groupBy("shard", "top").agg(F.least(F.min(F.when(F.col("count") > 1, F.col("d"))), F.min("d") + shard_nodes).alias("cut")).withColumn("cut", F.greatest("cut", F.col("top") + 1))
        told = kept.stored(todo.join(cut, ["shard", "top"], "left"), "cut-shards")
        levels.append(told.filter("cut is null or d < cut").drop("cut"))
        below = told.filter("d >= cut").drop("shard", "top")
        deeper = rows.select("conv_id", F.col("d").alias("cut"), F.col("d1").alias("shard"))
        todo = kept.stored(below.join(deeper, ["conv_id", "cut"]).withColumnRenamed("cut", "top"), "shared-nodes")
    done = None
    for nodes in reversed(levels):
        if done is not None:
            tops = done.filter("d = top").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
            nodes = nodes.join(tops, NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("leaves", "saved")})
        level = kept.stored(subtree_sums(nodes), "subtree-sums")
        done = level if done is None else done.unionByName(level)
    return done


def end_digests(rows: DataFrame) -> DataFrame:
    """(d, d1, d2, ends_sha256) of the nodes where conversations end.

    Ids are sorted in ranges and put together in stretches there; what one task reads of a node in order are stretches, not ids.
    """
    order = [*NODE, "conv_id"]

    def stretches(batches):
        part, number, held, done = TaskContext.get().partitionId(), 0, None, []

        def close():
            nonlocal number, held
            done.append((*held[0], part, number, ",".join(held[1])))
            number, held = number + 1, None

        def out():
            kinds = (*[pa.int64()] * 5, pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done)) or [()] * 6, kinds)], names=[*NODE, "part", "number", "ids"])
            done.clear()
            return batch

        for batch in batches:
            for node, found in groupby(zip(*(batch.column(c).to_pylist() for c in order)), key=lambda r: r[:3]):
                if held is not None and held[0] != node:
                    close()
                for *_, c in found:
                    if held is not None and held[2] > ID_CHARACTERS:
                        close()
                    held = held or [node, [], 0]
                    held[1].append(str(c))
                    held[2] += len(held[1][-1]) + 1
            yield out()
        if held is not None:
            close()
        yield out()

    def digests(batches):
        last, sha = None, None
        for batch in batches:
            rows = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if node != last:
                    if last is not None:
                        rows.append((*last, sha.hexdigest()))
                    last, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, (*[pa.int64()] * 3, pa.string()))], names=[*NODE, "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, sha.hexdigest())], names=[*NODE, "ends_sha256"])

    ids = rows.filter("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ids.mapInArrow(stretches, "d long, d1 long, d2 long, part long, number long, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "part", "number").mapInArrow(digests, "d long, d1 long, d2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    with Scratch() as kept:
        turns = numbered_turns(turn_keys(conversations), kept)
        rows = prefixes(rebuilt(turns, kept), kept)
        found = kept.stored(trie_nodes(rows), "nodes")
        children = found.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"), F.count(F.when(F.col("n_convs") == 1, True)).alias("single"))
        n = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_children", "single")}
        nodes = found.join(children, NODE, "left").withColumns(n)
        # Each child with one member has one leaf below it.
        own = {"leaves": F.col("single") + F.when(F.col("n_children") == 0, 1).otherwise(0), "saved": (F.col("n_convs") - 1) * F.col("words")}
        nodes = kept.stored(nodes.withColumns(own).drop("single"), "counted-nodes")
        sums = shared_sums(nodes.filter("d > 0 and n_convs > 1"), rows, kept, shard_nodes).select(*NODE, "p1", "p2", "top", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
        root = sums.filter("d = 1").groupBy(F.lit(0).cast("long").alias("d"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.sum("all_leaves").alias("all_leaves"), F.sum("all_saved").alias("all_saved"))
        sums = sums.select(*NODE, "all_leaves", "all_saved").unionByName(root)
        whole = nodes.join(sums, NODE, "left").join(end_digests(rows), NODE, "left")
        parents = nodes.select((F.col("d") + 1).alias("d"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        # The root's sums are those of its children; what they lack are its own single ones.
        leaves = F.when(F.col("d") == 0, F.col("leaves") + F.coalesce("all_leaves", F.lit(0))).otherwise(F.coalesce("all_leaves", F.lit(1)))
        out = whole.join(parents, ["d", "p1", "p2"], "left").select(
            "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", leaves.cast("long").alias("n_leaves"),
            F.coalesce("all_saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        )
        return stored(out, "trie")
