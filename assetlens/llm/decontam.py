"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is the word: a document is the sequence of its words, a pattern is a window of ten
words of a benchmark item (a shorter item is one pattern).  For patterns of one length m a shift
table over blocks of two words tells how far the search may move; where the shift is nothing, the
block's bucket, divided by the patterns' first words, names the patterns to compare directly.

The benchmark is the stated query set.  It is cut into blocks of about ``BLOCK_BYTES`` of item text;
tasks make each block's tables, flat arrays of about ten bytes for each of text, and write them
below ``spark.checkpoint.dir``.  The documents pass once, whatever the size of the benchmark, and are
never shuffled: a task holds one block's tables at a time and a few MB of texts, over which the
blocks pass; a worker keeps the tables it opened last, so a single block is opened once.

Cases: null or empty text has no words and no hit; an item without words has no window; repeated
items and repeated windows count for each item_id once; repeated documents are each answered;
empty tables give empty results; other document columns are carried along, except those that have
a result's name, which the result replaces.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, only, shared_dir, slices, texts_of, widened

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Bytes of documents over which the blocks pass at once.
SLICE_BYTES = 32 << 20
_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Upper case becomes lower case; every other ASCII character but digits and letters a space.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


_A, _B, _C = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D


class WuManber:
    """Patterns of one length: places in an array of word numbers, and the items of each."""

    def __init__(self, length: int, ids: np.ndarray, starts: np.ndarray, items: np.ndarray):
        """``ids``: numbers (from 1) of all items' words; ``starts``, ``items``: place and item of each window."""
        self.length, self.block = length, min(2, length)
        windows = np.ascontiguousarray(ids[starts[:, None] + np.arange(length)])
        _, first, which = np.unique(windows.view(np.dtype((np.void, windows.itemsize * length))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((items, which))
        which, items = which[order], items[order]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (items[1:] != items[:-1])
        self.items = items[new].astype(np.uint32)
        self.items_at = np.searchsorted(which[new], np.arange(len(first) + 1)).astype(np.uint32)
        self.starts = starts[first].astype(np.uint32)
        bits = max(10, int(8 * len(first)).bit_length())
        self.mask, self.bucket_mask = (1 << bits) - 1, (1 << bits - 3) - 1
        words = windows[first].astype(np.uint64)
        self.shift = np.full(1 << bits, length - self.block + 1, np.uint8)
        for end in range(self.block, length + 1):  # later blocks move less and overwrite earlier ones
            self.shift[self._key(words, end)] = length - end
        bucket = ((self._key(words, length).astype(np.uint64) * np.uint64(_C) + words[:, 0]) & np.uint64(self.bucket_mask)).astype(np.int64)
        self.patterns = np.argsort(bucket, kind="stable").astype(np.uint32)
        self.buckets = np.searchsorted(bucket[self.patterns], np.arange(self.bucket_mask + 2)).astype(np.uint32)

    def _key(self, words: np.ndarray, end: int) -> np.ndarray:
        key = words[:, end - 1] * np.uint64(_B)
        if self.block == 2:
            key = key + words[:, end - 2] * np.uint64(_A)
        return (key & np.uint64(self.mask)).astype(np.int64)

    def search(self, words: list[bytes], number, ids: memoryview):
        """Yields (first word, items) of each occurrence; ``number`` gives a word's number or 0."""
        m, mask, bucket_mask = self.length, self.mask, self.bucket_mask
        shift, buckets, patterns, starts = (memoryview(x) for x in (self.shift, self.buckets, self.patterns, self.starts))
        i, n, single = m - 1, len(words), self.block == 1
        while i < n:
            last = number(words[i], 0)
            if not last:  # a word of no item
                i += m
                continue
            key = last * _B
            if not single:
                before = number(words[i - 1], 0)
                if not before:
                    i += m - 1
                    continue
                key += before * _A
            key &= mask
            if move := shift[key]:
                i += move
                continue
            low = i - m + 1
            at = (key * _C + number(words[low], 0)) & bucket_mask
            lo, hi = buckets[at], buckets[at + 1]
            if lo < hi:
                window = [number(w, 0) for w in words[low : i + 1]]
                for k in range(lo, hi):
                    p = patterns[k]
                    if ids[starts[p] : starts[p] + m].tolist() == window:
                        yield low, self.items[self.items_at[p] : self.items_at[p + 1]].tolist()
                        break
            i += 1


class Searches:
    """All patterns of a block of items: one search for each length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        ids, windows, at = [], defaultdict(list), 0
        for name, text in items:
            own = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
            if own:
                ids.append(np.array(own, np.uint32))
                m = min(window, len(own))
                windows[m].append((at, at + len(own) - m + 1, place[name]))
                at += len(own)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        self.words = b" ".join(number)
        self.by_length = []
        for m, found in sorted(windows.items()):
            lo, hi, item = np.array(found, np.int64).T
            size = hi - lo
            starts = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self.by_length.append(WuManber(m, self.ids, starts, np.repeat(item, size)))

    def hits(self, words: list[bytes], marks: bytearray | None = None) -> tuple[bytearray | None, set[str]]:
        """Marks of the words hit (None: none), added to those given, and the items found."""
        if "number" not in self.__dict__:  # once in each worker
            self.number = {w: k for k, w in enumerate(self.words.split(), 1)}
        ids, items = memoryview(self.ids), set()
        for s in self.by_length:
            one = b"\1" * s.length
            for at, found in s.search(words, self.number.get, ids):
                if marks is None:
                    marks = bytearray(len(words))
                marks[at : at + s.length] = one
                items.update(found)
        return marks, {self.names[k] for k in items}


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def write_blocks(benchmark: DataFrame, folder: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Files of the tables of each block of the benchmark (item_id, text), written by tasks.

    A repeated item counts once.  Attempts write files of their own; those of the attempt that counted are returned.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = items.filter("text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    keyed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-total // block_bytes)))))

    def build(block: pa.Table) -> pa.Table:
        made = Searches(list(zip(block.column("item_id").to_pylist(), block.column("text").to_pylist())), window)
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path)
        name = f"block-{block.column('block')[0].as_py()}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(pickle.dumps(made))
        return pa.table({"file": [f"{folder}/{name}"]})

    return sorted(r[0] for r in keyed.groupBy("block").applyInArrow(build, "file string").collect())


@lru_cache(maxsize=1)
def opened(file: str) -> Searches:
    """A block's tables; a worker holds those of one block."""
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_stream(path) as source:
        return pickle.loads(source.read())


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    docs = only(docs, *(x.split()[0] for x in _RESULT.split(", ")))
    files = write_blocks(benchmark, shared_dir(docs.sparkSession, "benchmark-blocks"), window, block_bytes)

    def scan(batches):
        for batch in slices(batches, limit=SLICE_BYTES):
            texts = texts_of(batch.column("text"))
            sizes, marks, items = [0] * len(texts), [None] * len(texts), [set() for _ in texts]
            for file in files or [None]:
                block = opened(file) if file else Searches([])
                for k, text in enumerate(texts):
                    words = words_of(text)
                    marks[k], found = block.hits(words, marks[k])
                    sizes[k] = len(words)
                    items[k] |= found
            yield appended(
                batch,
                n_words=pa.array(sizes, pa.int64()),
                n_hit=pa.array([sum(m) if m else 0 for m in marks], pa.int64()),
                n_items=pa.array([len(x) for x in items], pa.int64()),
                items_sha256=pa.array([_digest(x) for x in items], pa.string()),
                contaminated=pa.array([bool(m) for m in marks], pa.bool_()),
            )

    return docs.mapInArrow(scan, widened(docs, _RESULT))
