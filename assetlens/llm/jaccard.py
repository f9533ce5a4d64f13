"""Exact Jaccard join on word shingles, with set-relation skipping.

A text's set is its distinct shingles of ``SHINGLE`` words, by 128-bit hashes.  Two sets link when
``den * intersection >= num * union``.  Equal sets form one class; only classes are joined, and
the answer is each document's component, so copies are never expanded into pairs.

Index lists.  If two sets link, at most H elements differ, where H follows from their sizes.  The
elements are dealt by hash into more than H parts, so one part of both has the same elements: its
hash names an index list.  A set enters the lists of its size class and, if it is small enough to
link downwards, of the class below.  (Parts that are empty count only for sets with so few full
parts that the argument needs them.)  An entry carries its position: how many of the set's
elements lie in earlier parts.  Entries that link differ by at most H in position, so a list,
sorted by position, falls into blocks wherever the gap is larger, and pairs across blocks are
skipped without being looked at.

Answers from similar sets.  In a list, not all pairs are compared.  First each set is compared
with the one leader it shares most lists with; a linked set takes over the leader's component.
Lists whose members all have one component are done.  In what remains, members outside a list's
largest component are compared with the members of other components, some leaders of a list at a
time, unless their known distances to a common leader differ by more than the threshold distance (the
Jaccard distance is a metric), or they have become connected meanwhile.  Rounds go on until no
list has two components left, or all its pairs have been settled: no link between different sets
is lost, and no list is ever cut off.

Before the exact comparison, a pair must pass two exact bounds: the sizes' ratio, and the number of
bits in which the sets' parity bitmaps (``BITS`` bits: is the number of elements with this hash
odd?) differ, which is at most the number of elements in which the sets differ.

Cases: null text, or text without words, is an empty set and links with nothing (component: its
own doc_id); rows of one doc_id are one node, each with its own size; a null doc_id has a null
component; a text of any length is read whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, slices, stored, texts_of, words_in

SHINGLE, NUM, DEN, BITS = 4, 85, 100, 512
#: Growth of the size classes; leaders of a list compared in rounds 1, 2, ...; members of one leader compared in one task.
GROWTH, LEADERS, FAN = 1.6, (16, 256, 4096, 65536), 256
#: Rows of one list held in memory, a longer one is cut as it streams by; sets that a task remembers having entered.
LIST_ROWS, SEEN = 1 << 16, 1 << 19


class Shingles(NamedTuple):
    """A set: the sorted first halves of its elements' 128-bit hashes, and the second halves beside them."""

    lo: np.ndarray
    hi: np.ndarray

    @property
    def key(self) -> tuple[int, int]:
        """128 bits that name the set."""
        return int(self.lo.sum(dtype=np.uint64).view(np.int64)), int(mix64(self.hi).sum(dtype=np.uint64).view(np.int64))

    def common(self, other: Shingles) -> int:
        """Number of common elements, by all 128 bits."""
        _, i, j = np.intersect1d(self.lo, other.lo, assume_unique=True, return_indices=True)
        return int((self.hi[i] == other.hi[j]).sum())


def sets_of(texts: list[bytes], shingle: int = SHINGLE) -> list[Shingles]:
    """The set of each text: its distinct sequences of ``shingle`` words, or its only, shorter one."""
    words = words_in(texts, lower=True)
    halves, count, ends = words.hashes(), words.counts, words.upto
    left = np.repeat(ends, count) - np.arange(len(halves[0]))  # words up to the text's end
    mixed = [np.full(len(left), 0x9E3779B97F4A7C15, np.uint64), np.zeros(len(left), np.uint64)]
    for k in range(shingle):
        full = np.flatnonzero(left > k)
        own, other = (h[full + k] for h in halves)
        mixed[0][full] = mix64((mixed[0][full] ^ own) * np.uint64(0xD6E8FEB86659FD93) + other)
        mixed[1][full] = mixed[1][full] * np.uint64(0xA0761D6478BD642F) + (own ^ other)
    out = []
    for a, b in zip((ends - count).tolist(), ends.tolist()):
        lo, first = np.unique(mixed[0][a : max(a + 1, b - shingle + 1) if b > a else a], return_index=True)
        out.append(Shingles(lo, mixed[1][a:b][first]))
    return out


def bitmaps(sets: list[Shingles]) -> np.ndarray:
    """Parity of the number of elements at each of BITS hashes, as rows of signed 64-bit numbers."""
    owner = np.repeat(np.arange(len(sets)) * BITS, [len(s.lo) for s in sets])
    every = np.concatenate([s.lo for s in sets]) if sets else np.zeros(0, np.uint64)
    place = (mix64(every ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(owner + place, minlength=len(sets) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), BITS), axis=1).view(np.int64)


class Parts:
    """Size classes and numbers of parts for a threshold num/den."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * GROWTH)))
        self.low = np.array(self.low, np.int64)
        self.top = den * (self.low[1:] - 1) // num  # largest size that enters a class's lists
        self.differ = (den - num) * 2 * self.top // (den + num)  # elements that may differ
        self.parts = self.differ + 2 + (self.differ + 1) // 16

    def entries(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, class) pairs: the own class, and the one below where links can reach down."""
        own = np.searchsorted(self.low, sizes, "right") - 1
        down = np.flatnonzero((own > 0) & (sizes <= self.top[np.maximum(own - 1, 0)]))
        which = np.concatenate([np.arange(len(sizes)), down])
        group = np.concatenate([own, own[down] - 1])
        some = self.differ[group] > 0  # otherwise only equal sets link
        return which[some], group[some]


def signatures(sets: list[Shingles], parts: Parts) -> tuple[np.ndarray, ...]:
    """Index entries: list hash, set number, position, size."""
    sizes = np.array([len(s.lo) for s in sets], np.int64)
    which, group = parts.entries(sizes)
    if not len(which):
        return (np.zeros(0, np.int64),) * 4
    elements = np.concatenate([sets[k].lo for k in which])
    size, n_parts = sizes[which], parts.parts[group]
    base = np.cumsum(n_parts) - n_parts
    salt = mix64(group.astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F))
    dealt = mix64(elements ^ np.repeat(salt, size))
    slot = np.repeat(base, size) + (dealt % np.repeat(n_parts, size).astype(np.uint64)).astype(np.int64)
    own = mix64(dealt + np.uint64(0x165667B19E3779F9))
    total = int(n_parts.sum())
    count = np.bincount(slot, minlength=total)
    low = np.bincount(slot, (own & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
    high = np.bincount(slot, (own >> np.uint64(32)).astype(float), total).astype(np.uint64)
    entry = np.repeat(np.arange(len(which)), n_parts)
    number = np.arange(total) - base[entry]
    name = mix64(low + (high << np.uint64(32)) + mix64((group[entry].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(7)))
    before = np.cumsum(count) - count
    position = before - before[base[entry]]
    full = np.add.reduceat((count > 0).astype(np.int64), base)
    kept = np.flatnonzero((count > 0) | (full <= parts.differ[group])[entry])
    return name[kept].view(np.int64), which[entry[kept]], position[kept], size[entry[kept]]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")


def document_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bits): the size, name and parity bitmap of each document's set."""

    def run(batches):
        for batch in slices(batches):
            sets = sets_of(texts_of(batch.column("text")), shingle)
            keys = [s.key for s in sets]
            numbers = [pa.array(x, pa.int64()) for x in ([len(s.lo) for s in sets], [k[0] for k in keys], [k[1] for k in keys])]
            bits = pa.array(bitmaps(sets).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, bits], names=["doc_id", "n_shingles", "k1", "k2", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bits array<long>")


def index_entries(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(list, doc_id, position, size) of each different set of a task."""

    def run(batches):
        parts, seen = Parts(num, den), set()
        for batch in slices(batches):
            ids, sets = [], []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), sets_of(texts_of(batch.column("text")), shingle)):
                if len(s.lo) and (key := s.key) not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(key)
                    ids.append(doc_id)
                    sets.append(s)
            name, which, position, size = signatures(sets, parts)
            owner = np.array(ids, np.int64)[which] if len(which) else which
            for at in range(0, len(name), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(name[cut]), pa.array(owner[cut]), pa.array(position[cut].astype(np.int32)), pa.array(size[cut].astype(np.int32))], names=["list", "doc_id", "position", "size"])

    return _rows(docs).mapInArrow(run, "list long, doc_id long, position int, size int")


def index_blocks(entries: DataFrame, num: int, den: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """(block, doc_id): blocks of lists that may hold links; blocks of equal members have one name.

    A list of more than ``list_rows`` rows is cut while it streams by, with the largest size of its
    class in place of its own; its blocks are named by number.
    """

    def blocks(name, doc, position, size):
        """Blocks of whole lists that are sorted by list and position."""
        new = np.diff(name, prepend=~name[:1]) != 0
        first = np.flatnonzero(new)
        most = np.repeat(np.maximum.reduceat(size, first), np.diff(first, append=len(name)))
        cut = new.copy()
        cut[1:] |= (position[1:] - position[:-1]) * (den + num) > 2 * (den - num) * most[1:]
        lo = np.flatnonzero(cut)
        n = np.diff(lo, append=len(name))
        mixed = mix64(doc.astype(np.uint64) + np.uint64(0x27D4EB2F165667C5))
        members = mix64(np.add.reduceat(mixed, lo) + n.astype(np.uint64)).view(np.int64)
        kept = np.repeat(n > 1, n)
        return np.repeat(members, n)[kept], doc[kept]

    def out(block, doc):
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(doc)], names=["block", "doc_id"])

    def run(batches):
        parts = Parts(num, den)
        held, passing = None, None  # passing: name, largest size, last position and block number of a long list

        def passed(doc, position):
            name, most, last, number = passing
            cut = np.diff(position, prepend=position[0] if last is None else last) * (den + num) > 2 * (den - num) * most
            numbers = number + np.cumsum(cut)
            passing[2:] = int(position[-1]), int(numbers[-1])
            return out(mix64(mix64(numbers.astype(np.uint64) + np.uint64(1)) + np.uint64(name % 2**64)).view(np.int64), doc)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy().astype(np.int64) for c in ("list", "doc_id", "position", "size")]
            if passing is not None:
                n = int(np.argmax(np.append(cols[0] != passing[0], True)))
                if n:
                    yield passed(cols[1][:n], cols[2][:n])
                    cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                passing = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = int(np.searchsorted(cols[0] == cols[0][-1], True))
            if last:
                yield out(*blocks(*(c[:last] for c in cols)))
            held = [c[last:] for c in cols]
            if len(held[0]) > list_rows:
                own = int(np.searchsorted(parts.low, held[3].max(), "right")) - 1
                passing = [int(held[0][0]), int(parts.top[own]), None, 0]
                yield passed(held[1], held[2])
                held = None
        if held is not None and len(held[0]):
            yield out(*blocks(*held))

    ordered = entries.repartition("list").sortWithinPartitions("list", "position", "doc_id")
    return ordered.mapInArrow(run, "block long, doc_id long").dropDuplicates()


def compare(pairs: DataFrame, texts: DataFrame, shingle: int, kept: Scratch) -> DataFrame:
    """(a, b) -> (a, b, common, size_a, size_b, sets_a), exactly, from the texts.

    The ids grow with the input, so they are never broadcast: the joins are merge joins at any size.
    """
    texts = texts.hint("merge")
    many = kept.stored(pairs.groupBy("a").count().filter(F.col("count") > FAN), "many").hint("merge")
    fans = F.ceil(F.coalesce("count", F.lit(1)) / FAN)
    pairs = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), fans).alias("fan"))
    left = pairs.select("a", "fan").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "fan", F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "fan", "b", "text")

    def run(batches):
        key, leaders = None, []
        for batch in slices(batches):
            sets = sets_of(texts_of(batch.column("text")), shingle)
            rows = []
            for a, fan, b, s in zip(batch.column("a").to_pylist(), batch.column("fan").to_pylist(), batch.column("b").to_pylist(), sets):
                if b is None:
                    leaders = [*leaders, s] if key == (a, fan) else [s]
                    key = (a, fan)
                    continue
                # a doc_id of several rows has several sets: the most similar one counts
                n, k = max(((s.common(x), -len(x.lo)) for x in leaders), default=(0, 0))
                rows.append((a, b, n, -k, len(s.lo), len(leaders)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 6)], names=["a", "b", "common", "size_a", "size_b", "sets_a"])

    dealt = left.unionByName(right).repartition("a", "fan").sortWithinPartitions("a", "fan", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long, common long, size_a long, size_b long, sets_a long")


def _is_star(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    n, m = edges.agg(F.count("u"), F.count_distinct("u")).first()
    return n == m and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(edges: DataFrame, kept: Scratch) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v): the least node of each component, by star contraction."""
    edges = kept.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while not _is_star(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = kept.stored(small.filter("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _links(compared: DataFrame, num: int, den: int) -> Column:
    return F.col("common") * (den + num) >= num * (F.col("size_a") + F.col("size_b"))


def _merge(labels: DataFrame, links: DataFrame, kept: Scratch) -> DataFrame:
    """Labels (node, comp, ...) after joining the components of linked nodes (a, b)."""
    of = labels.select("node", "comp")
    ends = links.join(of.toDF("a", "u"), "a").join(of.toDF("b", "v"), "b").select("u", "v")
    roots = components(ends, kept)
    joined = labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left")
    return kept.stored(joined.select("node", F.coalesce("root", "comp").alias("comp"), *[c for c in labels.columns if c not in ("node", "comp")]), "labels")


def _side(rows: DataFrame, info: DataFrame, side: str) -> DataFrame:
    """``rows`` (node, ...) with the sizes and bitmaps of ``info`` (node, size, bits), all columns named for a side."""
    joined = rows.join(info, "node")
    return joined.toDF(*(f"{side}_{c}" for c in joined.columns))


def _near(num: int, den: int) -> Column:
    """Whether the sizes and bitmaps of sides a and b allow a link; true where they aren't known."""
    a, b = F.col("a_size"), F.col("b_size")
    differ = sum((F.bit_count(F.get("a_bits", F.lit(i)).bitwiseXOR(F.get("b_bits", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return F.coalesce((F.least(a, b) * den >= F.greatest(a, b) * num) & (differ * (den + num) <= (a + b) * (den - num)), F.lit(True))


def _first_pairs(lists: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """For each member the leader (least member of a block) it shares most blocks with, of those it may link with."""
    shared = lists.filter("a <> node").groupBy("a", "node").count()
    ends = _side(shared, info, "b").join(info.toDF("b_a", "a_size", "a_bits"), "b_a").filter(_near(num, den))
    best = ends.groupBy(F.col("b_node").alias("b")).agg(F.max(F.struct("b_count", (-F.col("b_a")).alias("less"))).alias("m"))
    return best.select((-F.col("m.less")).alias("a"), "b")


def _open_lists(lists: DataFrame, labels: DataFrame, k: int, kept: Scratch) -> DataFrame:
    """Members of blocks with several components; ``lead``: some of those outside the block's largest one.

    About LEADERS[k] members lead in round k.  Which ones is told by a hash, other for each round, so
    that no block has to be sorted in one task.
    """
    leaders = LEADERS[min(k, len(LEADERS) - 1)]
    own = kept.stored(lists.join(labels, "node"), "own")
    sizes = own.groupBy("block", "comp").count().groupBy("block").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("n"))
    open_ = sizes.filter("n > top.count").select("block", F.col("top.comp").alias("top"), (F.col("n") - F.col("top.count")).alias("others"))
    place = F.shiftrightunsigned(F.xxhash64("block", "node", F.lit(k)), 1)
    lead = (F.col("comp") != F.col("top")) & (place.cast("double") * F.col("others") < leaders * 2.0**63)
    return kept.stored(own.join(kept.stored(open_, "open"), "block").withColumn("lead", lead).withColumn("place", place).drop("top", "others"), "open-lists")


def linked_classes(docs: DataFrame, sets: DataFrame, shingle: int, num: int, den: int, kept: Scratch) -> DataFrame:
    """(node, comp) for class representatives that share a block with another one."""
    rep = sets.select("doc_id", F.col("rep").alias("node"))
    blocks = index_blocks(index_entries(docs, shingle, num, den), num, den)
    lists = kept.stored(blocks.join(rep, "doc_id").select("block", "node").distinct(), "lists")
    heads = kept.stored(lists.groupBy("block").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "heads")
    lists = kept.stored(lists.join(heads, "block"), "lists")
    nodes = kept.stored(lists.select("node").distinct(), "nodes")
    labels = nodes.select("node", F.col("node").alias("comp"), F.lit(None).cast("long").alias("pivot"), F.lit(None).cast("double").alias("distance"))
    if nodes.isEmpty():
        return labels
    texts = kept.stored(_rows(docs).join(nodes.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left_semi"), "texts")
    known = sets.filter("doc_id = rep").join(nodes, F.col("rep") == F.col("node"), "left_semi").groupBy(F.col("rep").alias("node"))
    single = F.count(F.lit(1)) == 1  # a doc_id with several rows may have several sets
    info = kept.stored(known.agg(F.when(single, F.first("n_shingles")).alias("size"), F.when(single, F.first("bits")).alias("bits")), "info")
    pairs, tried, limit = kept.stored(_first_pairs(lists, info, num, den), "pairs"), None, 1 - num / den + 1e-9
    lists = lists.drop("a")
    for k in range(1 << 30):
        if not pairs.isEmpty():
            done = kept.stored(compare(pairs, texts, shingle, kept), "compared")
            if k == 0:
                apart = 1 - F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
                once = done.withColumn("d", apart).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("pivot"), F.min("d").alias("distance"), F.count("d").alias("n"), F.max("sets_a").alias("m"))
                pivots = once.filter("n = 1 and m = 1").drop("n", "m")
                labels = labels.drop("pivot", "distance").join(pivots, "node", "left")
            labels = _merge(labels, done.filter(_links(done, num, den)), kept)
            tried = done.select("a", "b") if tried is None else tried.unionByName(done.select("a", "b"))
        own = _open_lists(lists, labels, k, kept)
        if own.isEmpty():
            return labels
        a, b = _side(own.filter("lead"), info, "a"), _side(own, info, "b")
        far = F.coalesce((F.col("a_pivot") == F.col("b_pivot")) & (F.abs(F.col("a_distance") - F.col("b_distance")) > limit), F.lit(False))
        once = ~F.col("b_lead") | (F.struct("a_place", "a_node") < F.struct("b_place", "b_node"))
        new = a.join(b, (F.col("a_block") == F.col("b_block")) & (F.col("a_comp") != F.col("b_comp")) & once & ~far & _near(num, den))
        pairs = new.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
        if tried is not None:
            known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = kept.stored(pairs, "pairs")
        lists = own.filter("not lead").select("block", "node")


def similarity_components(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    with Scratch() as kept:
        sets = kept.stored(document_sets(docs, shingle), "sets")
        known = sets.filter("doc_id is not null and n_shingles > 0")
        rep = kept.stored(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
        classes = kept.stored(known.join(rep, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "rep", "bits"), "members")
        comps = linked_classes(docs, classes, shingle, num, den, kept).select(F.col("node").alias("rep"), "comp")
        joined = classes.join(comps, "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
        alone = sets.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return stored(joined.unionByName(alone), "components")
