"""Media columns: archives of encoded payloads and a Spark data source that reads them.

A payload is stored as a lossless PNG image of 8-bit grey samples, 192 to a row, in ZIP archives
without further compression.  The data source lists the archives (paths and sizes only) and plans
partitions by byte ranges (at most an archive of full size each, several small ones together); each
task reads its archives' directories once, keeps the members that start in its ranges, and streams
their bytes through Arrow in bounded batches.  A member that can't be
read, or whose checksum is wrong, is read again from its own offset, independently of the others.

Archives are written under a name of the task attempt and renamed when complete, and their content
depends only on the partition, so a repeated or speculative task leaves the same archive.

Cases: null text counts as empty; the payload is padded with spaces to a positive multiple of 192,
so empty text is one row of spaces; a text of any length is one member; repeated rows are members
of their own; a null doc_id comes back as null; an empty table gives no archive and no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import slices, stored, texts_of

WIDTH = 192
SHARD_BYTES = 128 << 20
#: A partition's bytes: as many as give each task slot two partitions, between these bounds.
RANGE_BYTES, LEAST_RANGE = 128 << 20, 4 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, note: bytes, level: int = 1) -> bytes:
    """Grey 8-bit image of ``payload``, whose length is a multiple of the row width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Comment\0" + note) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> tuple[np.ndarray, bytes]:
    """Samples and note of an image made by ``encode_png``; raises ValueError on anything else."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, parts = 8, {}
    while at < len(image):
        size = struct.unpack_from(">I", image, at)[0]
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"damaged {kind!r}")
        parts[kind] = parts.get(kind, b"") + data
        at += 12 + size
    width, height, depth, colour = struct.unpack_from(">IIBB", parts[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("only unfiltered grey 8-bit images are read")
    return lines[:, 1:], parts[b"tEXt"].partition(b"\0")[2]


def features(samples: np.ndarray) -> str:
    """Height, mean, deviation, entropy in bits and mean step between neighbours of the samples."""
    share = np.bincount(samples.ravel(), minlength=256) / samples.size
    values = np.arange(256)
    mean = float(share @ values)
    spread = float(np.sqrt(max(0.0, share @ values**2 - mean**2)))
    seen = share[share > 0]
    step = float(np.abs(np.diff(samples.astype(np.int16), axis=1)).mean())
    return f"rows={len(samples)};mean={mean:.4f};std={spread:.4f};entropy={abs(float(seen @ np.log2(seen))):.4f};step={step:.4f}"


class _Shards:
    """Writes members to archives of bounded size, each renamed when complete."""

    def __init__(self, folder: str, limit: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder)
        task = TaskContext.get()
        self.part, self.attempt, self.limit = task.partitionId(), task.taskAttemptId(), limit
        self.number, self.stream, self.done = 0, None, []

    def add(self, name: str, data: bytes) -> None:
        if self.stream is None:
            self.final = f"shard-{self.part:06d}-{self.number:04d}.zip"
            self.partial = f"{self.folder}/.{self.final}.{self.attempt}"
            self.stream = self.fs.open_output_stream(self.partial)
            self.zip, self.members = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED), 0
        self.zip.writestr(zipfile.ZipInfo(f"{self.members:08d}/{name}"), data)
        self.members += 1
        if self.stream.tell() >= self.limit:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.zip.close()
            size = self.stream.tell()
            self.stream.close()
            self.fs.move(self.partial, f"{self.folder}/{self.final}")
            self.done.append({"shard": self.final, "members": self.members, "bytes": size})
            self.number, self.stream = self.number + 1, None


def write_archives(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stores each row (doc_id, text) as a member of an archive in ``folder``; returns the written manifest."""

    def pack(batches):
        shards = _Shards(folder, shard_bytes)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                shards.add(f"{'' if doc_id is None else doc_id}.png", encode_png(padded(text), str(len(text)).encode()))
        shards.close()
        yield pa.RecordBatch.from_pylist(shards.done, schema=pa.schema([("shard", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())]))

    return stored(docs.select("doc_id", "text").mapInArrow(pack, "shard string, members long, bytes long"), "media-manifest")


@dataclass
class ByteRanges(InputPartition):
    """Ranges (archive, low, high) that one task reads: a part of an archive, or several small ones."""

    parts: list[tuple[str, int, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 0)))
        self.slots = int(options.get("slots", 1))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self):
        fs, folder = pafs.FileSystem.from_uri(self.folder)
        files = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        files = sorted((f.path, f.size) for f in files if f.is_file and f.base_name.endswith(".zip"))
        limit = self.range_bytes or min(RANGE_BYTES, max(LEAST_RANGE, sum(size for _, size in files) // (2 * self.slots)))
        planned, parts, held = [], [], 0
        for path, size in files:
            for lo in range(0, size, limit):
                hi = min(lo + limit, size)
                if parts and held + hi - lo > limit:
                    planned.append(ByteRanges(parts))
                    parts, held = [], 0
                parts.append((path, lo, hi))
                held += hi - lo
        return [*planned, ByteRanges(parts)]

    def retried(self, archive: _Archive, where: str, work):
        """Result of ``work`` and the tries it took; each try after a failure opens the archive anew."""
        for tried in range(1, self.tries + 1):
            try:
                return work(archive.opened()), tried
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                archive.close()
                wrong = e
        raise OSError(f"{archive.path} {where}: {wrong}") from wrong

    def member(self, archive: _Archive, info: zipfile.ZipInfo) -> tuple[bytes, int]:
        """Bytes of the member at its own offset and the tries it took."""

        def read(f) -> bytes:
            f.seek(info.header_offset)
            head = f.read(30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no member starts here")
            f.seek(info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
            data = f.read(info.file_size)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise ValueError("checksum differs")
            return data

        return self.retried(archive, f"at {info.header_offset}", read)

    def read(self, partition):
        fs = pafs.FileSystem.from_uri(self.folder)[0]
        rows, held = [], 0
        for path, lo, hi in partition.parts:
            archive = _Archive(fs, path)
            members, _ = self.retried(archive, "directory", lambda f: zipfile.ZipFile(f).infolist())
            for info in members:
                if not lo <= info.header_offset < hi:
                    continue
                data, tried = self.member(archive, info)
                rows.append((path.rpartition("/")[2], info.filename.partition("/")[2], info.header_offset, data, tried))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            archive.close()
        if rows:
            yield _batch(rows)


class _Archive:
    """One handle on an archive, opened when needed."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.handle = fs, path, None

    def opened(self):
        if self.handle is None:
            self.handle = self.fs.open_input_file(self.path)
        return self.handle

    def close(self) -> None:
        if self.handle is not None:
            self.handle.close()
            self.handle = None


_MEMBERS = "archive string, member string, offset long, payload binary, tries int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "member", "offset", "payload", "tries"])


class ArchiveSource(DataSource):
    """``spark.read.format("payload_archive").load(folder)``; options ``rangeBytes``, ``slots`` (of tasks) and ``tries``."""

    @classmethod
    def name(cls) -> str:
        return "payload_archive"

    def schema(self) -> str:
        return _MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("payload_archive").options(slots=str(spark.sparkContext.defaultParallelism), **options).load(folder)


def media_digest(members: DataFrame) -> DataFrame:
    """Checks and features of each stored member, from its bytes alone."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in schema.split(", ")]

    def digest(batches):
        for batch in batches:
            rows = []
            for member, image in zip(batch.column("member").to_pylist(), batch.column("payload").to_pylist()):
                samples, note = decode_png(image)
                payload = samples.tobytes()
                own = member.removesuffix(".png")
                rows.append((int(own) if own else None, int(note), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return members.select("member", "payload").mapInArrow(digest, schema)
