import gzip

import pytest
from pyspark.sql import functions as F

from kmerspark.operators import counting, histogram
from kmerspark.sources import fastq
from kmerspark.streaming.chunks import count_stream


def write(path, seqs, pack=False):
    text = "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs))
    (gzip.open(path, "wt") if pack else open(path, "w")).write(text)
    return str(path)


def test_files_are_numbered_in_order(spark, tmp_path):
    a, b = write(tmp_path / "a.fastq", ["ACGT", "GGGG"]), write(tmp_path / "b.fastq", ["TTTT", "CCCC"])
    assert [tuple(r) for r in fastq.read(spark, [b, a], 3).orderBy("read_id").collect()] == [(0, "TTTT"), (1, "CCCC"), (2, "ACGT")]


def test_gzip_by_its_first_bytes(tmp_path):
    path = tmp_path / "x.txt"
    with gzip.open(path, "wt") as out:
        out.write("@a\nAC\n+\nII\n")
    assert list(fastq.records(str(path))) == [(0, "AC")]


def test_pairs_end_with_the_shorter_file(spark, tmp_path):
    a, b = write(tmp_path / "1.fastq", ["AA", "CC", "GG"]), write(tmp_path / "2.fastq", ["TT", "AC"])
    got = [tuple(r) for r in fastq.read_paired(spark, a, b).orderBy("read_id").collect()]
    # the R1 that was read before R2 was found to end
    assert got == [(0, "R1", "AA"), (1, "R2", "TT"), (2, "R1", "CC"), (3, "R2", "AC"), (4, "R1", "GG")]
    got = [tuple(r) for r in fastq.read_paired(spark, b, a).orderBy("read_id").collect()]
    assert got == [(0, "R1", "TT"), (1, "R2", "AA"), (2, "R1", "AC"), (3, "R2", "CC")]
    assert fastq.read_paired(spark, a, b, 3).count() == 4


@pytest.mark.parametrize("text", [">a\nACGT\n", "a\nAC\n+\nII\n", "@a\nAC\n-\nII\n", "@a\nACG\n+\nII\n", "@a\nAC\n"])
def test_bad_files(tmp_path, text):
    path = tmp_path / "bad.fastq"
    path.write_text(text)
    with pytest.raises(fastq.FastqError):
        list(fastq.records(str(path)))


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first\nACG\nT\n>two\nGG\n")
    assert sorted(tuple(r) for r in fastq.read_fasta(spark, str(tmp_path / "a.fasta")).collect()) == [("one", "one first", "ACGT"), ("two", "two", "GG")]


def test_histogram_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, 6), (2, 0, 1)], "count int, chunk_1 int, chunk_2 int")
    fastq.write_histogram(rows, str(tmp_path / "h.tsv"))
    assert sorted(map(tuple, fastq.read_histogram(spark, str(tmp_path / "h.tsv")).collect())) == [(1, 5, 6), (2, 0, 1)]


def test_stream_equals_batch(spark, tmp_path):
    seqs = ["ACGTACGTTT", "TTTTACGATC", "ACGTACGAAA", "GGGACGTACG"]
    for i, s in enumerate(seqs):
        spark.createDataFrame([(s,)], "seq string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    count_stream(stream, f"{tmp_path}/out", 5, 50).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/histogram")
    last = got.agg(F.max("chunk")).first()[0]
    want = histogram.histogram(counting.count_kmers(spark.createDataFrame([(s,) for s in seqs], "seq string"), 5), 50)
    assert last >= 3
    assert sorted((r["count"], r.n_kmers) for r in got.where(F.col("chunk") == last).collect()) == sorted(map(tuple, want.collect()))
