"""Tables written once in the folder that the driver and all executors share, and small groups worked on in streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without it (tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = "file://" + tempfile.mkdtemp(prefix="spark-assetlens-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/assetlens/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table written now: what reads it several times doesn't work it out again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of results that a task hands over at once.
HANDED_OVER = 4096


def _values(c: pa.Array) -> list:
    """The column in Python, structs as tuples; texts and numbers pass as a whole, and a column of nulls is not looked into."""
    if c.null_count == len(c):
        return [None] * len(c)
    if pa.types.is_list(c.type):
        flat, ends = _values(c.flatten()), [0, *accumulate(n or 0 for n in _values(c.value_lengths()))]
        return [flat[lo:hi] if there else None for there, (lo, hi) in zip(_values(c.is_valid()), pairwise(ends))]
    if pa.types.is_struct(c.type):
        rows = zip(*map(_values, c.flatten()))
        return list(rows) if c.null_count == 0 else [x if there else None for there, x in zip(_values(c.is_valid()), rows)]
    if pa.types.is_string(c.type) or c.null_count == 0 and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type) or pa.types.is_boolean(c.type)):
        return c.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(c.type) or pa.types.is_floating(c.type):
        return [x if there else None for there, x in zip(_values(c.is_valid()), _values(c.fill_null(0)))]
    return c.to_pylist()


def in_groups(df: DataFrame, keys: list[str], work: Callable[[tuple, list[tuple]], Iterable[dict]], schema: str | T.StructType, dealt: list[str] | None = None) -> DataFrame:
    """``work`` (key, the group's rows without it, structs as tuples) on every group, its dicts as rows of the keys and ``schema``.

    Groups lie one after the other in sorted partitions and a task reads them as one stream, so that many small ones share a batch: a
    grouped map costs a call with its own frames for each.  A task holds one group at a time.  ``dealt``: the first of the keys; groups
    that share them come to one task, one after the other, nulls first.
    """
    n = len(keys)
    told = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    fields = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keys), *told])
    target = to_arrow_schema(fields)
    maps = [f.name for f in fields if isinstance(f.dataType, T.MapType)]

    def results(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        rows = chain.from_iterable(zip(*map(_values, b.columns)) for b in batches)
        for key, group in groupby(rows, key=lambda r: r[:n]):
            for found in work(key, [r[n:] for r in group]):
                yield dict(zip(keys, key)) | found | {m: list(found[m].items()) for m in maps}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in results(batches):
            held.append(row)
            if len(held) == HANDED_OVER:
                yield pa.RecordBatch.from_pylist(held, schema=target)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=target)

    first = df.select(*keys, *(c for c in df.columns if c not in keys))
    return first.repartition(*(dealt or keys)).sortWithinPartitions(*keys).mapInArrow(run, fields)
