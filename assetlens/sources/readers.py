"""Readers and writers (section A)."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import batched, chain, groupby, islice

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_envelope(spark: SparkSession, path: str, item: str, key: str = "lst") -> DataFrame:
    """Rows of JSON payload files in three shapes: a list whose first element has ``key``, an object with it, a bare list; else an error.

    ``item`` is the DDL of a row.
    """
    text = spark.read.text(path, wholetext=True)
    return envelope_rows(text, "value", item, key)


def envelope_rows(df: DataFrame, column: str, item: str, key: str = "lst") -> DataFrame:
    rows = f"array<struct<{item}>>"
    keyed = f"struct<{key}:{rows}>"
    c = F.ltrim(F.col(column))
    inside = F.get_json_object(c, f"$[0].{key}").isNotNull(), F.get_json_object(c, f"$.{key}").isNotNull()
    listed = F.startswith(c, F.lit("["))
    found = (
        F.when(listed & inside[0], F.get(F.from_json(c, f"array<{keyed}>"), F.lit(0))[key])
        .when(listed, F.from_json(c, rows))
        .when(inside[1], F.from_json(c, keyed)[key])
        .otherwise(F.raise_error(F.lit(f"neither a list nor an object with {key}")))
    )
    return df.select(F.explode(found).alias("_r")).select("_r.*")


def read_positional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV by position: the header is dropped, cells trimmed, missing ones '', rows with a blank first cell skipped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE")
    return clean_cells(df, columns)


def clean_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns)).filter(F.col(columns[0]) != "")


def read_tab_lines(df: DataFrame, column: str, columns: list[str]) -> DataFrame:
    """Cells of tab-separated lines without a header, cleaned as above."""
    cells = F.split(F.col(column), "\t", -1)
    return clean_cells(df.select(*(F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(columns))), columns)


def split_wide_hierarchy(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flat rows (place, n_cells, site, site_name, bay, bay_name, device, device_name, model) -> sites, bays, devices.

    Rows of fewer than five cells or a blank first one are skipped; a blank name becomes the code;
    the first row of a code supplies its name; devices aren't made unique.
    """
    rows = df.filter((F.col("n_cells") >= 5) & (F.trim("site") != ""))
    named = lambda name, code: F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.col(code))
    sites = rows.groupBy(F.col("site").alias("code")).agg(F.min_by(named("site_name", "site"), "place").alias("name"))
    bays = rows.filter(F.trim("bay") != "").groupBy("site", F.col("bay").alias("code")).agg(F.min_by(named("bay_name", "bay"), "place").alias("name"))
    devices = rows.filter(F.trim("device") != "").select("site", "bay", F.col("device").alias("code"), named("device_name", "device").alias("name"), "model")
    return sites, bays, devices


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Recognised regions (JSON lines) as block rows."""
    schema = "document_id string, page_number int, block_id string, text string, polygon array<struct<x:double,y:double>>, recognition_score double"
    return block_rows(spark.read.schema(schema).json(path))


def block_rows(regions: DataFrame) -> DataFrame:
    """Blank text dropped, blanks collapsed, the box from the polygon (three points at least)."""
    from ..functions.scalars import polygon_bbox

    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    out = regions.withColumns({"text": text, "_b": polygon_bbox(F.col("polygon"))}).filter((F.col("text") != "") & F.col("_b").isNotNull())
    return out.select("document_id", "page_number", "block_id", "text", "_b.*", "recognition_score")


def api_envelope(df: DataFrame, message: str) -> DataFrame:
    """One row (success, message, data): the answer of the interface."""
    return df.agg(F.collect_list(F.struct("*")).alias("data")).select(F.lit(True).alias("success"), F.lit(message).alias("message"), "data")


def write_xml(df: DataFrame, path: str, root: str = "root", row: str = "item") -> None:
    """Records as XML files; array columns repeat their element."""
    df.write.format("xml").option("rootTag", root).option("rowTag", row).option("nullValue", "").mode("overwrite").save(path)


def record_lines(df: DataFrame, multi: list[str]) -> DataFrame:
    """One flat row for each record: array columns joined by `` | ``."""
    return df.withColumns({c: F.array_join(c, " | ") for c in multi})


#: Characters that Spark writes by their number in the name of a partition's folder, and the name of one without a value.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Files or lines that a task tells of at once.
_TOLD = 4096


def folder_of(keys: Iterable[str], values: Iterable[str | None]) -> str:
    """The folder that ``partitionBy`` has for these values."""
    return "/".join(f"{k}={NO_VALUE if v is None else _ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in zip(keys, values))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)


def _batches(rows: Iterable[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    return (pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=names) for held in batched(rows, _TOLD))


def write_folders(df: DataFrame, keys: list[str], line: Column, path: str, ending: str, head: str | None = None) -> None:
    """``line`` of every row in one file for each value of the keys, below ``head``, in the folders of ``partitionBy``; ``_files`` lists them.

    Rows come sorted by their folder and a task writes one file at a time as they pass, since Spark's own writer has the driver move each
    file and its reader has it list each folder.  A file is renamed when complete, so a second attempt changes nothing.
    """
    system, root = FileSystem.from_uri(path)
    system.create_dir(root)
    system.delete_dir_contents(root)
    fields = T.StructType([T.StructField(c, T.StringType()) for c in (*keys, "file")])

    def files(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        system, root = FileSystem.from_uri(path)  # the task's own
        for values, group in groupby(_rows(batches), key=lambda r: r[:-1]):
            folder = f"{root}/{folder_of(keys, values)}"
            part = f"{folder}/.{uuid.uuid4().hex}"
            system.create_dir(folder)
            with system.open_output_stream(part) as out:
                if head is not None:
                    out.write(f"{head}\n".encode())
                for *_, text in group:
                    out.write(f"{text}\n".encode())
            system.move(part, f"{folder}/part.{ending}")
            yield (*values, f"{folder_of(keys, values)}/part.{ending}")

    run = lambda batches: _batches(files(batches), fields.names)
    rows = df.select(*(F.nullif(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys), line.alias("_line"))
    rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, fields).write.parquet(f"{path.rstrip('/')}/_files")


def read_folders(spark: SparkSession, path: str, keys: str, head: bool = False) -> DataFrame:
    """(keys, value) of every line that ``write_folders`` wrote, without heads; ``keys`` is their DDL.  Tasks open the files that are listed."""
    told = spark.read.parquet(f"{path.rstrip('/')}/_files")
    named = T.StructType.fromDDL(keys)
    fields = T.StructType([*(T.StructField(f.name, T.StringType()) for f in named), T.StructField("value", T.StringType())])

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        system, root = FileSystem.from_uri(path)
        for *values, file in _rows(batches):
            with system.open_input_stream(f"{root}/{file}") as stream:
                for raw in islice(io.BufferedReader(stream), int(head), None):
                    yield (*values, raw.decode().removesuffix("\n"))

    run = lambda batches: _batches(lines(batches), fields.names)
    return told.select(*named.names, "file").mapInArrow(run, fields).select(*(F.col(f.name).cast(f.dataType) for f in named), "value")


def write_record_csv(df: DataFrame, path: str, multi: list[str]) -> None:
    """Flat records as CSV, a folder for each document."""
    rows = record_lines(df, multi)
    names = [c for c in rows.columns if c != "document_id"]
    head = df.sparkSession.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(c) for c in names)))).first()[0]
    write_folders(rows, ["document_id"], F.to_csv(F.struct(*names)), path, "csv", head)


def write_record_files(records: DataFrame, unassigned: DataFrame, path: str, multi: list[str]) -> None:
    """Records by document below ``by_document``, all of them below ``all``, and rows that belong to no record below ``unassigned``."""
    write_record_csv(records, f"{path}/by_document", multi)
    for name, df in (("all", records), ("unassigned", unassigned)):
        record_lines(df, [c for c in multi if c in df.columns]).write.option("header", True).mode("overwrite").csv(f"{path}/{name}")


def write_page_json(df: DataFrame, path: str) -> None:
    """One JSON file folder for each document and page."""
    keys = ["document_id", "page_number"]
    write_folders(df, keys, F.to_json(F.struct(*(c for c in df.columns if c not in keys))), path, "json")


#: Media types by file ending (fixed values).
MEDIA_TYPES = {"json": "application/json", "csv": "text/csv", "png": "image/png", "pdf": "application/pdf", "txt": "text/plain"}


def content_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, kind, media_type) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = F.regexp_replace(F.lit(path), "^file:/*", "/")
    own = F.ltrim(F.replace(F.regexp_replace("path", "^file:/*", "/"), base, F.lit("")), F.lit("/"))
    ending = F.lower(F.element_at(F.split(own, r"\."), -1))
    media: Column = F.coalesce(F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))[ending], F.lit("application/octet-stream"))
    return files.select(own.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), ending.alias("kind"), media.alias("media_type"))


def audit_manifest(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, verdict) of declared files against the actual ones: verified, missing, size_mismatch, checksum_mismatch, undeclared."""
    d, a = declared.select("path", F.col("size").alias("_ds"), F.col("sha256").alias("_dh")), actual.select("path", F.col("size").alias("_as"), F.col("sha256").alias("_ah"))
    verdict = F.when(F.col("_as").isNull(), "missing").when(F.col("_ds").isNull(), "undeclared").when(F.col("_ds") != F.col("_as"), "size_mismatch").when(F.col("_dh") != F.col("_ah"), "checksum_mismatch").otherwise("verified")
    return d.join(a, "path", "full").select("path", verdict.alias("verdict"))
