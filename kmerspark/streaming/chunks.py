"""Reads that keep arriving: each micro-batch is a chunk of the cumulative histogram.

The state is the count table itself, written anew for each batch beside the one before it,
so a batch that is run again starts from the same state and gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerspark.operators import counting, histogram
from kmerspark.operators.kmers import DEFAULT_K


def count_stream(reads: DataFrame, folder: str, k: int = DEFAULT_K, most: int = histogram.MAX_COUNT):
    """A streaming query that keeps ``folder/counts-<batch>`` and appends to ``folder/histogram``.

    ``histogram`` has (chunk, count, n_kmers) after each batch.
    """
    spark = reads.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        fresh = counting.count_kmers(batch, k)
        held = spark.read.parquet(f"{folder}/counts-{number - 1}") if number else fresh.limit(0)
        counting.merge_counts(held, fresh).write.mode("overwrite").parquet(f"{folder}/counts-{number}")
        now = histogram.histogram(spark.read.parquet(f"{folder}/counts-{number}"), most)
        now.withColumn("chunk", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/histogram/chunk={number}")

    return reads.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
