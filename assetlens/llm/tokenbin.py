"""Token ids in Arrow IPC files of fixed-size-list batches.

Documents in ascending doc_id order are encoded and laid end to end, each followed by the end id,
in equal sequences of ``SEQUENCE`` ids with a mask (1: an id, 0: padding after a shard's last
document).  A shard is an Arrow IPC file; every batch but its last has ``BATCH`` sequences, so
sequence k is row k % BATCH of batch k // BATCH, and a reader maps the file and slices the ids
without copying.  Beside it an index file has each document's id, start and length.

Encoding uses the tokenizer of the library.  Byte-pair merges never cross the pieces that the
tokenizer's own splitting rule makes, so pieces are found by array operations, each distinct piece
is encoded by the library once, and the ids of all texts are gathered from these.  A piece is looked
up by hash and its bytes are compared with the kept ones; texts for which they differ anywhere are
left to the library.  What kind of
character a code point is, is asked of the library's splitter as well.

Order: rows are range-partitioned and sorted by doc_id; a partition writes its own shards, so
nothing gathers in one task, and the starts over the whole corpus come from adding up the shards'
totals.  Shards are renamed when complete and depend only on their partition's rows.

Cases: null or empty text is the end id alone; null doc_id sorts first; rows of equal doc_id are
ordered by text and each is written; a text of any length lies in one shard; an empty table gives
no shard and no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, span_hashes, stored

SEQUENCE = 2048
BATCH = 128
SHARD_IDS = 16 << 20
END_ID = 2
#: Pieces kept with their ids in each worker; beyond, the store starts anew.
KEPT_PIECES = 1_000_000
PIECES_AT_ONCE = 5_000

_SPACE, _BLANK, _LETTER, _NUMBER, _OTHER, _UNKNOWN = 0, 1, 2, 3, 4, 255


class PieceEncoder:
    """Encodes many texts with a byte-level tokenizer by encoding each distinct piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.bytes_used, self.byte_at, self.byte_size = np.zeros(1 << 16, np.uint8), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, self.width), 0
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn_kinds(self, codes: np.ndarray) -> None:
        for code in np.unique(codes[self.kind[codes] == _UNKNOWN]).tolist():
            c = chr(code)
            alone = [k for k, before in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(self.split(before + c)) == 1]
            self.kind[code] = _SPACE if c == " " else alone[0] if alone else _BLANK

    def starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start; ``first`` marks the first code point of each text."""
        self._learn_kinds(codes)
        kind = self.kind[codes]
        blank = kind <= _BLANK
        group = np.where(blank, _SPACE, kind)
        start = first.copy()
        start[1:] |= group[1:] != group[:-1]
        # The last blank before a word is a piece of its own, or part of the word if it is a space.
        after = np.flatnonzero(start[1:] & ~first[1:] & ~blank[1:] & blank[:-1]) + 1
        start[after - 1] = True
        start[after[kind[after - 1] == _SPACE]] = False
        # Contractions (fixed values): 's 't 'm 'd 're 've 'll after something other than a space.
        mark = np.flatnonzero((codes == 0x27) & start)
        mark = mark[mark + 1 < len(codes)]
        mark = mark[~first[mark + 1]]
        one = codes[mark + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        two = np.minimum(mark + 2, len(codes) - 1)
        second = np.where((two == mark + 2) & ~first[two], codes[two], 0)
        long = ((one == ord("r")) | (one == ord("v"))) & (second == ord("e")) | (one == ord("l")) & (second == ord("l"))
        for chosen, size in ((mark[short], 2), (mark[long], 3)):
            start[chosen + 1] = False
            ends = chosen + size
            start[ends[ends < len(codes)]] = True
        return np.flatnonzero(start)

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate(each) if each else np.zeros(0, self.width), np.array([len(e) for e in each], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the count of each text."""
        whole = "".join(texts)
        if not whole or any(s in t for s in self.special for t in texts):
            return self._by_library(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        text_ends = np.cumsum(lengths)
        first = np.zeros(len(codes) + 1, bool)
        first[text_ends - lengths] = True
        lo = self.starts(codes, first[:-1])
        hi = np.append(lo[1:], len(codes))
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass") + bytes(8), np.uint8)
        places = np.arange(len(codes) + 1)
        if len(data) - 8 != len(codes):
            places[1:] = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
        byte_lo, byte_hi = places[lo], places[hi]
        hashes, where, inverse = np.unique(span_hashes(data, byte_lo, byte_hi)[0], return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_PIECES:
            self._clear()
        place = np.searchsorted(self.keys, hashes)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != hashes if len(self.keys) else np.ones(len(hashes), bool))
        if len(new):
            chosen = where[new]
            self._keep(hashes[new], [whole[a:b] for a, b in zip(lo[chosen].tolist(), hi[chosen].tolist())], data, byte_lo[chosen], byte_hi[chosen])
            place = np.searchsorted(self.keys, hashes)
        rows = self.rows[place][inverse]
        size = byte_hi - byte_lo  # pieces lie end to end
        kept = self.byte_size[rows]
        if (kept != size).any() or (self.bytes[np.repeat(self.byte_at[rows] - byte_lo, size) + np.arange(len(data) - 8)] != data[:-8]).any():
            return self._by_library(texts)
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at[rows] - (ends - sizes), sizes) + np.arange(ends[-1])]
        cut = np.searchsorted(lo, text_ends)  # pieces before each text's end
        upto = np.concatenate([[0], ends])[cut]
        return ids, np.diff(upto, prepend=0)

    def _keep(self, keys: np.ndarray, pieces: list[str], data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Encodes new pieces (in order of their keys) and keeps their ids and bytes."""
        ids, sizes = [], []
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            some = pieces[at : at + PIECES_AT_ONCE]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, self.width))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), self.width)])
        self.flat[self.used : self.used + len(ids)] = ids
        rows = np.arange(len(self.at), len(self.at) + len(keys))
        self.at = np.concatenate([self.at, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, place, keys), np.insert(self.rows, place, rows)
        size = hi - lo
        ends = np.cumsum(size)
        if self.bytes_used + ends[-1] > len(self.bytes):
            self.bytes = np.concatenate([self.bytes[: self.bytes_used], np.zeros(self.bytes_used + 2 * int(ends[-1]), np.uint8)])
        self.bytes[self.bytes_used : self.bytes_used + ends[-1]] = data[np.repeat(lo - (ends - size), size) + np.arange(ends[-1])]
        self.byte_at, self.byte_size = np.concatenate([self.byte_at, self.bytes_used + ends - size]), np.concatenate([self.byte_size, size])
        self.bytes_used += int(ends[-1])


_encoders: dict[str, PieceEncoder] = {}


def encoder_for(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file: later tasks use the pieces that earlier ones met."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class _ShardWriter:
    def __init__(self, folder: str, width, sequence: int, batch: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder)
        task = TaskContext.get()
        self.part, self.attempt, self.number = task.partitionId(), task.taskAttemptId(), 0
        self.width, self.sequence, self.batch = np.dtype(width), sequence, batch
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.width), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.open = False

    def _name(self, kind: str) -> tuple[str, str]:
        name = f"{kind}-{self.part:06d}-{self.number:04d}.arrow"
        return f"{self.folder}/.{name}.{self.attempt}", f"{self.folder}/{name}"

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if not self.open:
            self.sink = self.fs.open_output_stream(self._name("ids")[0])
            self.out = pa.ipc.new_file(self.sink, self.schema)
            self.held, self.n_held, self.total, self.index, self.open = [], 0, 0, [], True
        self.index.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        full = self.sequence * self.batch
        if self.n_held >= full:
            ids = np.concatenate(self.held)
            whole = len(ids) // full * full
            for at in range(0, whole, full):
                self._write(ids[at : at + full], full)
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)], schema=self.schema))

    def close(self) -> dict | None:
        if not self.open:
            return None
        ids = np.concatenate(self.held)
        if len(ids):
            room = np.zeros(-(-len(ids) // self.sequence) * self.sequence, self.width)
            room[: len(ids)] = ids
            self._write(room, len(ids))
        self.out.close()
        self.sink.close()
        partial, final = self._name("index")
        docs, starts, sizes = zip(*self.index)
        table = pa.table({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        with self.fs.open_output_stream(partial) as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        self.fs.move(partial, final)
        self.fs.move(*self._name("ids"))
        done = {"part": self.part, "number": self.number, "n_docs": len(docs), "n_ids": self.total}
        self.number, self.open = self.number + 1, False
        return done


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, sequence: int = SEQUENCE, batch: int = BATCH, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes (doc_id, text) and writes the files; returns the shards with their first id's place in the corpus."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        encoder = encoder_for(tokenizer)
        out = _ShardWriter(folder, encoder.width, sequence, batch)
        end, done = np.array([end_id], encoder.width), []
        for part in slices(batches, limit=1 << 20):
            ids, counts = encoder.encode(part.column("text").to_pylist())
            at = 0
            for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist()):
                out.add(doc_id, np.concatenate([ids[at : at + n], end]))
                at += n
                if out.total >= shard_ids:
                    done.append(out.close())
        done.append(out.close())
        yield pa.RecordBatch.from_pylist([d for d in done if d], schema=pa.schema([(k, pa.int64()) for k in ("part", "number", "n_docs", "n_ids")]))

    shards = stored(ordered.mapInArrow(write, "part long, number long, n_docs long, n_ids long"), "token-shards")
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class TokenShard:
    """Random access to the sequences and ids of one shard, mapped where the file is local."""

    def __init__(self, folder: str, part: int, number: int):
        fs, path = pafs.FileSystem.from_uri(folder)
        opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        name = f"{part:06d}-{number:04d}.arrow"
        self.file = pa.ipc.open_file(opened(f"{path}/ids-{name}"))
        self.index = pa.ipc.open_file(opened(f"{path}/index-{name}")).read_all()
        self.sequence = self.file.schema.field("ids").type.list_size
        self.batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

        self.held = None  # the batch read last: on a remote file it isn't fetched for each document

    def _values(self, column: str, batch: int) -> pa.Array:
        if self.held is None or self.held[0] != batch:
            self.held = batch, self.file.get_batch(batch)
        return self.held[1].column(column).flatten()

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the mapped file) and mask of sequence k."""
        b, r = divmod(k, self.batch)
        lo = r * self.sequence
        mask = self._values("mask", b).slice(lo, self.sequence)
        return self._values("ids", b).to_numpy()[lo : lo + self.sequence], mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the shard; a view unless they lie in several batches."""
        full, parts, end = self.sequence * self.batch, [], start + n
        while start < end:
            b, lo = divmod(start, full)
            hi = min(full, lo + end - start)
            parts.append(self._values("ids", b).to_numpy()[lo:hi])
            start += hi - lo
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def token_digest(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files."""
    n = max(1, min(shards.count(), 4 * shards.sparkSession.sparkContext.defaultParallelism))

    def read(batches):
        for batch in batches:
            for s in batch.to_pylist():
                shard = TokenShard(folder, s["part"], s["number"])
                starts, sizes = shard.index["start"].to_numpy(), shard.index["n_tokens"].to_numpy()
                sums = [zlib.crc32(shard.ids(a, k).astype("<u4").tobytes()) for a, k in zip(starts.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [shard.index["doc_id"].combine_chunks(), pa.array(starts + s["base"]), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return shards.select("part", "number", "base").repartition(n, "part", "number").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
