"""Shared plumbing of the text operators: Arrow maps, bounded slices, checkpoints.

Every Arrow map here gets only the columns it needs under fixed internal names, so extra columns of
the caller, whatever their names, never reach Python.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes that the JVM puts in one Arrow batch at most; Python cuts them further by bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Arrow batches of bounded size, and this package on the path of local Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir; a local folder only if none is set on one machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned and stored in here leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; the lineage above is not needed again."""
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def cut_to_table(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed columnar table in the same folder: for wide rows, of which later steps read parts."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def named(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the named string column holds about max_bytes at most; one longer text stays whole."""
    if not batch.num_rows:
        return
    lengths = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(lengths), 0), dtype=np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    yield batch.slice(start)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty, without a copy per row."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64, count=len(array) + 1 + array.offset)[array.offset :]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def typed(df: DataFrame, column: str, name: str) -> str:
    """DDL of a column that keeps its type under another name."""
    return f"{name} {df.schema[column].dataType.simpleString()}"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only these columns, under fixed names; works for names with dots and beside any other columns."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
