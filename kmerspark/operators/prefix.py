"""Global running totals without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from kmerspark.session import checkpointed

RANGE_ROWS = 200_000


def fresh_name(taken: list[str], name: str) -> str:
    """``name``, with underscores until no column has it."""
    while any(c.lower() == name.lower() for c in taken):
        name += "_"
    return name


def with_offsets(rows: DataFrame, keys: list[Column], amount: Column, name: str = "offset", range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with the sum of ``amount`` over all rows before each in ``name``, one row with the grand total in ``total``).

    Rows are ordered by ``keys``. One range partitioning puts them into sorted partitions, each
    summed by a running total as it is read; the partitions' totals (a row each) are summed up
    in order and added. Rows with equal keys stand in any order, so they too are spread over
    partitions. The ranges are written down, as bounds drawn again could differ.
    """
    spark = rows.sparkSession
    add, part, tie = (fresh_name(rows.columns, c) for c in ("_amount", "_part", "_tie"))
    ranges = max(1, -(-rows.count() // range_rows), spark.sparkContext.defaultParallelism)
    marked = rows.withColumn(add, F.coalesce(amount.cast("bigint"), F.lit(0))).withColumn(tie, F.monotonically_increasing_id())
    sorted_rows = marked.repartitionByRange(ranges, *keys, F.col(tie)).sortWithinPartitions(*keys, tie).drop(tie).withColumn(part, F.spark_partition_id())
    inside = fresh_name(sorted_rows.columns, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(add)).to_numpy()
            before = upto + np.cumsum(own) - own
            upto += int(own.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, inside])

    fields = [*rows.schema.fields, StructField(add, LongType()), StructField(part, IntegerType()), StructField(inside, LongType())]
    summed = checkpointed(sorted_rows.mapInArrow(run, StructType(fields)))
    totals = summed.groupBy(part).agg(F.sum(add).alias("_sum"))
    # one row a range
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(part).alias("_range"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    joined = summed.join(F.broadcast(offsets), F.col(part) == F.col("_range"))
    found = joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(inside) + F.col("_before")).cast("bigint").alias(name))
    return found, totals.agg(F.coalesce(F.sum("_sum"), F.lit(0)).cast("bigint").alias("total"))
