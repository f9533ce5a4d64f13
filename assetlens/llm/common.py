"""Helpers shared by the training-data operators: shared folders, Arrow batches, hashes."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once by the vectorised Python code; bounds a worker's memory.
CHUNK_BYTES = 1 << 21


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``.

    The setting names the folder that the driver and all executors share.  Only a local
    session without it (tests) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = "file://" + tempfile.mkdtemp(prefix="spark-assetlens-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/assetlens/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: cuts the lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables stored while a job runs; leaving the ``with`` block deletes them."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(df.sparkSession, name)
        self.paths.append(path)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        for uri in self.paths:
            fs, path = pafs.FileSystem.from_uri(uri)
            fs.delete_dir(path)


def only(df: DataFrame, *drop: str) -> DataFrame:
    """``df`` without the columns named, whatever their case: results replace clashing inputs."""
    gone = {x.lower() for x in drop}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def widened(df: DataFrame, added: str) -> T.StructType:
    """Schema of ``df`` followed by the fields of the DDL string ``added``."""
    return T.StructType(df.schema.fields + T.StructType.fromDDL(added).fields)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches, column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 14):
    """Re-cuts record batches so that each slice has about ``limit`` bytes of text, one row at least and ``rows`` at most."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        lo = 0
        while lo < batch.num_rows:
            done = ends[lo - 1] if lo else 0
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, done + limit, "right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with further columns at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element (public murmur3 constants)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one by BLAKE2b.
LONG_WORD = 64


@dataclass
class Words:
    """The words of texts that lie end to end in ``data``, each followed by a newline."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    upto: np.ndarray  # words before each text's end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.upto, prepend=0)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit hash of each span of ``data``, which has eight bytes more at its end.

    Eight bytes at a time are mixed into the state; spans of more than LONG_WORD bytes go to BLAKE2b.
    """
    size = ends - starts
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    lo = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hi = lo ^ np.uint64(0xC2B2AE3D27D4EB4F)
    for at in range(0, LONG_WORD, 8):
        live = np.flatnonzero(size > at)
        if not len(live):
            break
        x = lanes[starts[live] + at] & _LANE[np.minimum(size[live] - at, 8)]
        a, b = lo[live], hi[live]
        a = mix64((a ^ x) * np.uint64(0xD6E8FEB86659FD93) + b)
        lo[live], hi[live] = a, mix64((b + x) * np.uint64(0xA0761D6478BD642F) ^ a)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=16, key=b"assetlens").digest()
        lo[k], hi[k] = np.frombuffer(digest, np.uint64)
    return lo, hi


def words_in(texts: list[bytes], lower: bool = False) -> Words:
    """Words between ASCII blanks; ``lower`` lower-cases A-Z."""
    whole = b"\n".join([*texts, bytes(8)])
    data = np.frombuffer(whole.lower() if lower else whole, np.uint8)
    blank = _BLANK[data[:-8]]
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(blank) and not blank[0]:
        turns = np.concatenate([[0], turns])
    starts, ends = turns[::2], turns[1::2]
    return Words(data, starts, ends, np.searchsorted(starts, np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))))
