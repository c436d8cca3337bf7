"""Files of results: FASTA by gene, histograms, and the summary of a run.

FASTA goes out by the executors. Histograms and summaries are bounded (a row a bin, a row a
gene) and written by the driver through Hadoop's file system, so any address will do.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerspark.operators.amplicons import fasta

log = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _warn(spark: SparkSession, path: str) -> None:
    if exists(spark, path):
        log.warning("overwriting %s", path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in place of any that is there."""
    _warn(spark, path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_fasta(products: DataFrame, folder: str, sample: str) -> None:
    """A folder ``gene=<gene>`` for each gene, with one file of its products in order."""
    _warn(products.sparkSession, folder)
    records = fasta(products, sample).withColumn("value", F.regexp_replace("record", "\n$", ""))
    # products of a gene are few (the search is bounded), so a gene is one file
    placed = records.repartition("gene").sortWithinPartitions("gene", "product")
    placed.select("gene", "value").write.partitionBy("gene").mode("overwrite").text(folder)


def read_fasta_files(spark: SparkSession, folder: str) -> DataFrame:
    """(gene, name, seq) of what ``write_fasta`` wrote."""
    records = spark.read.text(folder, lineSep=">").where(F.trim("value") != "")
    parts = F.split("value", "\n")
    return records.select(F.col("gene").cast("string"), F.split(parts[0], " ")[0].alias("name"), F.concat_ws("", F.slice(parts, 2, F.size(parts))).alias("seq"))


def write_histograms(wide: DataFrame, prefix: str) -> list[str]:
    """``prefix``.histo with a column for each chunk and ``prefix``.final.histo with the last one."""
    spark = wide.sparkSession
    rows = [tuple(r) for r in wide.orderBy("count").collect()]
    names = wide.columns

    def table(columns: list[int]) -> str:
        head = "# k-mer counts\n" + "\t".join(names[c] for c in columns) + "\n"
        return head + "".join("\t".join(str(row[c]) for c in columns) + "\n" for row in rows)

    paths = [f"{prefix}.histo", f"{prefix}.final.histo"]
    write_text(spark, paths[0], table(list(range(len(names)))))
    write_text(spark, paths[1], table([0, len(names) - 1]))
    return paths


def read_histogram(spark: SparkSession, path: str, chunks: int | None = None) -> DataFrame:
    """A histogram with a header, or (``chunks`` given) one of the older form without."""
    if chunks is None:
        return spark.read.csv(path, sep="\t", comment="#", header=True, inferSchema=True)
    columns = ", ".join(["count bigint", *(f"chunk_{i + 1} bigint" for i in range(chunks))])
    return spark.read.csv(path, sep="\t", comment="#", schema=columns)


def stats_yaml(facts: dict, results: DataFrame | None = None) -> str:
    """The facts of a run, and a block for each gene (``amplicons.results``), as YAML."""

    def scalar(value) -> str:
        return json.dumps(value)

    lines = [f"{key}: {scalar(value)}" for key, value in facts.items()]
    genes = [r.asDict() for r in results.orderBy("gene").collect()] if results is not None else []
    if results is not None:
        lines.append("genes:" if genes else "genes: []")
    for gene in genes:
        lines += [f"{'- ' if i == 0 else '  '}{key}: {scalar(value)}" for i, (key, value) in enumerate(gene.items())]
    return "\n".join(lines) + "\n"


def console_table(results: DataFrame) -> str:
    """The results of all genes as aligned text."""
    head = ("gene", "status", "products", "lengths", "reason")
    rows = [(r.gene, r.status, str(r.n_products), ",".join(map(str, r.product_lengths)) or "-", r.reason or "") for r in results.orderBy("gene").collect()]
    widths = [max(len(row[i]) for row in [head, *rows]) for i in range(len(head))]
    return "\n".join("  ".join(cell.ljust(width) for cell, width in zip(row, widths)).rstrip() for row in [head, *rows])
