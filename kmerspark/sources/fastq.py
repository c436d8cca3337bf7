"""FASTQ and FASTA files as DataFrames.

``spark.read.format("fastq").load(path)`` after ``register(spark)`` reads plain or gzip files,
a task a file: (file, rec, seq). ``read`` numbers the records of several files in order.
"""

from __future__ import annotations

import glob
import gzip
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kmerspark.operators.prefix import with_offsets

SCHEMA = "file string, rec bigint, seq string"


class FastqError(ValueError):
    """A file that is not FASTQ."""


def check_record(number: int, header: str, seq: str, sep: str, quality: str) -> None:
    """Raise unless the four lines are a record."""
    if header.startswith(">"):
        raise FastqError(f"record {number}: this looks like FASTA, not FASTQ")
    if not header.startswith("@"):
        raise FastqError(f"record {number}: the header does not begin with @")
    if not sep.startswith("+"):
        raise FastqError(f"record {number}: the third line does not begin with +")
    if len(seq) != len(quality):
        raise FastqError(f"record {number}: {len(seq)} bases but {len(quality)} qualities")


def records(path: str, most: int = 0, validate_every: int = 0) -> Iterator[tuple[int, str]]:
    """(number, sequence) of each record; the first and every n-th are checked in full."""
    with open(path, "rb") as raw:
        packed = raw.read(2) == b"\x1f\x8b"
    with gzip.open(path, "rt") if packed else open(path) as lines:
        number = 0
        while not most or number < most:
            header = lines.readline()
            if not header:
                return
            rest = [lines.readline() for _ in range(3)]
            if number == 0 and header.startswith(">"):
                raise FastqError("record 0: this looks like FASTA, not FASTQ")
            if not rest[2]:
                raise FastqError(f"record {number} is cut short")
            seq = rest[0].rstrip("\r\n")
            if number == 0 or (validate_every and number % validate_every == 0):
                check_record(number, header, seq, rest[1], rest[2].rstrip("\r\n"))
            yield number, seq
            number += 1


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        path = re.sub("^file:(//)?", "", self.options["path"])
        # of a folder, not the marks that writers leave in it
        found = sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.basename(p)[0] not in "._") if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return [_File(p) for p in found]

    def read(self, partition):
        for number, seq in records(partition.path, int(self.options.get("maxReads", 0)), int(self.options.get("validateEvery", 0))):
            yield partition.path, number, seq


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read(spark: SparkSession, paths: list[str], max_reads: int = 0, validate_every: int = 0) -> DataFrame:
    """(read_id, seq) of several files, one after the other, up to ``max_reads`` in all."""
    register(spark)
    frames = [spark.read.format("fastq").option("maxReads", max_reads).option("validateEvery", validate_every).load(p).withColumn("_file", F.lit(i)) for i, p in enumerate(paths)]
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    sizes = every.groupBy("_file", "file").agg((F.max("rec") + 1).alias("n")).withColumn("_key", F.dense_rank().over(_file_order()))
    offsets = with_offsets(sizes, [F.col("_key").asc()], F.col("n"))[0].select(F.col("file").alias("_name"), F.col("_file").alias("_number"), "offset")
    joined = every.join(F.broadcast(offsets), (F.col("file") == F.col("_name")) & (F.col("_file") == F.col("_number")))
    numbered = joined.select((F.col("offset") + F.col("rec")).alias("read_id"), "seq")
    return numbered.where(F.col("read_id") < max_reads) if max_reads else numbered


def _file_order():
    from pyspark.sql import Window

    return Window.orderBy("_file", "file")


def read_paired(spark: SparkSession, first: str, second: str, max_reads: int = 0, validate_every: int = 0) -> DataFrame:
    """(read_id, mate, seq): mates in turn, up to the end of the shorter file.

    Where that is R2, the R1 read before it was found to end stays, as the last one; no more is read.
    """
    pairs = -(-max_reads // 2)
    sides = [read(spark, [p], pairs, validate_every) for p in (first, second)]
    second_side = sides[1].select("read_id", F.col("seq").alias("_other"))
    ends = F.broadcast(sides[1].agg(F.count("*").alias("_n")))
    both = sides[0].join(second_side, "read_id", "left").join(ends, F.col("read_id") <= F.col("_n"))
    each = F.explode(F.array(F.struct(F.lit(0).alias("m"), F.col("seq").alias("seq")), F.struct(F.lit(1).alias("m"), F.col("_other").alias("seq")))).alias("r")
    return both.select("read_id", each).select((F.col("read_id") * 2 + F.col("r.m")).alias("read_id"), F.when(F.col("r.m") == 0, "R1").otherwise("R2").alias("mate"), "r.seq").where("seq is not null")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq) of each record."""
    blocks = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    lines = F.split("value", "\r?\n")
    head = lines[0]
    return blocks.select(F.split(head, " ")[0].alias("name"), head.alias("description"), F.concat_ws("", F.slice(lines, 2, F.size(lines))).alias("seq"))


def write_histogram(wide: DataFrame, path: str) -> None:
    """A tab-separated histogram with a comment line and a header; a few thousand rows."""
    rows = wide.orderBy("count").toPandas()
    with open(path, "w") as out:
        out.write("# kmerspark histogram\n")
        rows.to_csv(out, sep="\t", index=False)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", header=True, inferSchema=True)
