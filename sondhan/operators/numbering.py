"""Numbering rows in a total order without one task that holds them all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondhan.session import materialise


def number_rows(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """``df`` with its row number from 0 in the given order in the column ``out`` (long).

    Rows are range-partitioned and sorted, each range counts its own, and the counted ranges are written to
    the shared folder before they are read for the offsets and for the rows, so both readings see the
    same ranges whatever is planned or lost.  The offsets are one row a range.  Rows that the order does not tell
    apart are numbered in any order; an empty table stays empty.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__range", T.IntegerType()), T.StructField("__at", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * size, pa.int32()), pa.array(range(n, n + size), pa.int64())], [*batch.schema.names, "__range", "__at"])
            n += size

    ranged = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, schema))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__from"))
    return ranged.join(F.broadcast(starts), "__range").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__from") + F.col("__at")).alias(out))
