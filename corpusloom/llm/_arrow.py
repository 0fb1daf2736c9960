"""Small helpers around Arrow batches that the kernels of this subpackage share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

SPACE = b" \t\n\x0b\x0c\r"

#: Bytes of text that a kernel looks at together; a longer batch is cut into slices.
SLICE_BYTES = 1 << 20


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice holds much more than SLICE_BYTES of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Send less at a time to Python workers: texts may be long, and a batch is held on both sides.

    Lowers ``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch`` of the session where they are
    larger; a single row may exceed the bytes.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"[^0-9-]", "", spark.conf.get(key)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on, beside the next stage's needs."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: nothing to do
        pass


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def project(df: DataFrame, **columns: str | T.DataType) -> DataFrame:
    """Only the named columns, under the given names; all others are left behind."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict[str, object]], schema: str, text: str = "text") -> DataFrame:
    """Apply ``kernel`` to bounded slices of every Arrow batch; it returns columns of ``schema``."""
    fields = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = kernel(part)
                yield pa.RecordBatch.from_arrays([_as(made[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, fields)


def _as(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def ranked(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``place``, the 0-based place of its distinct ``column``, null last: by ranges, without one task for all."""
    ranges = df.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last())) - 1), "ranked")
    offsets, total = {}, 0
    for row in sorted(ranges.groupBy("part").count().collect()):  # one row per range
        offsets[row["part"]] = total
        total += row["count"]
    starts = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)) if offsets else F.lit(None).cast("map<int,int>")
    return ranges.withColumn("place", (F.col("own") + starts[F.col("part")]).cast("long")).drop("part", "own")
