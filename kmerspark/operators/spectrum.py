"""Peaks, valleys and genome size from count histograms (chunk, count, n_kmers).

A histogram is a small table: a row per count and chunk. ``legacy`` gives positions as
0-based rows, one less than the count, as older reports did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VIEW_BINS = 100


def _filled(histo: DataFrame, bins: int) -> DataFrame:
    """The first ``bins`` counts of every chunk, with 0 for those that are absent."""
    spark = histo.sparkSession
    grid = histo.select("chunk").distinct().crossJoin(spark.range(1, bins + 1).select(F.col("id").alias("count")))
    return grid.join(histo, ["chunk", "count"], "left").select("chunk", "count", F.coalesce("n_kmers", F.lit(0)).alias("n_kmers"))


def extrema(histo: DataFrame, threshold: int = 1000, distance: int = 1, valleys: bool = False, bins: int = VIEW_BINS, legacy: bool = False) -> DataFrame:
    """(chunk, idx, coverage, frequency) of bins that exceed both neighbours by ``threshold``.

    ``idx`` ranks them by coverage, from 0. Valleys are the peaks of the negated histogram.
    """
    sign = -1 if valleys else 1
    order = Window.partitionBy("chunk").orderBy("count")
    y = F.col("n_kmers") * sign
    near = _filled(histo, bins).withColumn("_b", F.lag(y, distance).over(order)).withColumn("_a", F.lead(y, distance).over(order))
    hits = near.where((y - F.col("_b") >= threshold) & (y - F.col("_a") >= threshold))
    return hits.select("chunk", (F.row_number().over(order) - 1).cast("int").alias("idx"), (F.col("count") - (1 if legacy else 0)).alias("coverage"), F.col("n_kmers").alias("frequency"))


def tallest(peaks: DataFrame, most: int) -> DataFrame:
    """The ``most`` highest peaks of each chunk."""
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("frequency"), "coverage"))
    return peaks.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def integral(histo: DataFrame, upto: int | None = None) -> DataFrame:
    """(chunk, kmers): occurrences of the k-mers with counts up to a bound."""
    rows = histo if upto is None else histo.where(F.col("count") <= upto)
    return rows.groupBy("chunk").agg(F.sum(F.col("count") * F.col("n_kmers")).alias("kmers"))


def genome_size(histo: DataFrame, threshold: int = 1000, bins: int = VIEW_BINS, legacy: bool = False) -> DataFrame:
    """(chunk, peak, coverage, valley, size): all k-mers past the first valley over the peak.

    The first peak is taken as heterozygous (its size is halved), the second as homozygous.
    Chunks without as many valleys as peaks are left out.
    """
    peaks = extrema(histo, threshold, bins=bins, legacy=legacy)
    valleys = extrema(histo, threshold, valleys=True, bins=bins, legacy=legacy)
    counts = peaks.groupBy("chunk").agg(F.count("*").alias("p")).join(valleys.groupBy("chunk").agg(F.count("*").alias("v"), F.min("coverage").alias("valley")), "chunk").where("p = v")
    shift = 1 if legacy else 0
    # counts past the bins shown, and the bin of all larger ones, take no part
    total = histo.where(F.col("count") <= bins).join(counts.select("chunk", "valley"), "chunk").groupBy("chunk", "valley").agg(F.sum(F.col("count") * F.col("n_kmers")).alias("all"), F.sum(F.when(F.col("count") - shift <= F.col("valley"), F.col("count") * F.col("n_kmers")).otherwise(0)).alias("errors"))
    sized = peaks.where("idx < 2").join(total, "chunk")
    size = (F.col("all") - F.col("errors")) / F.col("coverage") / F.when(F.col("idx") == 0, 2).otherwise(1)
    return sized.select("chunk", F.col("idx").alias("peak"), "coverage", "valley", F.round(size, 6).alias("size"))


def track(peaks: DataFrame) -> DataFrame:
    """(chunk, feature, coverage, frequency): peaks named by their rank in coverage.

    An approximation of clustering peaks across chunks: with well separated peaks the rank
    by coverage is the cluster.
    """
    return peaks.select("chunk", F.concat(F.lit("peak_"), F.col("idx") + 1).alias("feature"), "coverage", "frequency")
