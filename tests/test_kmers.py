import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerspark.functions import sequences as sq
from kmerspark.operators import counting, histogram, kmers, primers, spectrum


def plain(seq, k):
    out = []
    for i in range(len(seq) - k + 1):
        s = seq[i : i + k]
        if "N" not in s:
            rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
            out.append((i, min(s, rc)))
    return out


def text(value, k):
    return "".join("ACGT"[value >> 2 * (k - 1 - i) & 3] for i in range(k))


@pytest.mark.parametrize("k", [1, 3, 5, 9, 11, 19, 31])
def test_kernel_equals_plain_windows(k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTACGTACGTN") for _ in range(rng.randint(0, 90))) for _ in range(60)] + [None, ""]
    row, pos, values = kmers.batch_kmers(pa.array(seqs), k)
    got = [(int(r), int(p), text(int(v), k)) for r, p, v in zip(row, pos, values)]
    assert got == [(r, p, s) for r, seq in enumerate(seqs) for p, s in plain(seq or "", k)]


def test_kernel_rejects_other_letters():
    with pytest.raises(ValueError):
        kmers.batch_kmers(pa.array(["ACGX"]), 3)


def test_k_must_be_odd_and_short():
    for k in (0, 2, 32, 33):
        with pytest.raises(ValueError):
            kmers.check_k(k)


def test_sql_path_equals_kernel(spark):
    reads = spark.createDataFrame([(0, "ACGTNACGTTGCA"), (1, "TTTTTTT"), (2, "AC")], "read_id bigint, seq string")
    a = {tuple(r) for r in kmers.extract_sql(reads, 5).collect()}
    b = {(r.read_id, r.pos, text(r.kmer, 5)) for r in kmers.extract(reads, 5).collect()}
    assert a == b


def test_reverse_complement_of_reads_leaves_counts(spark):
    reads = spark.createDataFrame([("ACGTNACGTTGCAGGCT",), ("TTGACCATTTT",)], "seq string")
    turned = reads.select(sq.revcomp("seq").alias("seq"))
    count = lambda r: sorted(map(tuple, counting.count_kmers(r, 5).collect()))
    assert count(reads) == count(turned)


def test_codec_and_revcomp(spark):
    row = spark.createDataFrame([("GCGA", "RYN")], "s string, p string").select(sq.encode("s").alias("e"), sq.decode(sq.encode("s"), 4).alias("d"), sq.revcomp("p").alias("r"), sq.last_base(sq.encode("s")).alias("l")).first()
    assert tuple(row) == (152, "GCGA", "NRY", "A")


def test_histogram_overflow_and_totals(spark):
    counts = spark.createDataFrame([(1, 5), (20, 5), (2, 7), (11, 11), (12, 12)], "kmer bigint, n bigint")
    rows = {r["count"]: r.n_kmers for r in histogram.dense(histogram.histogram(counts, 10), 10).collect()}
    assert [rows[i] for i in range(1, 12)] == [0, 0, 0, 0, 2, 0, 1, 0, 0, 0, 2]
    assert tuple(histogram.totals(counts).first()) == (40, 5)


@pytest.mark.parametrize("values, want", [([], 0), ([42], 42), ([3, 5], 3), ([1, 5, 9], 5), ([1, 2, 3, 4], 2)])
def test_integer_median_floors_each_half(spark, values, want):
    counts = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "kmer bigint, n bigint")
    assert counting.integer_median(counts).first()[0] == want


def test_final_histogram_does_not_depend_on_chunks(spark):
    rng = random.Random(5)
    reads = spark.createDataFrame([(i, "".join(rng.choice("AC") for _ in range(12))) for i in range(60)], "read_id bigint, seq string")

    def last(chunks):
        parts = counting.count_kmers(reads.withColumn("chunk", sq.chunk_of("read_id", chunks, 1)), 5, ("chunk",))
        rows = histogram.cumulative(parts, chunks, 50).where(F.col("chunk") == chunks - 1).where("n_kmers > 0")
        return sorted((r["count"], r.n_kmers) for r in rows.collect())

    assert last(1) == last(7) == sorted(map(tuple, histogram.histogram(counting.count_kmers(reads, 5), 50).collect()))


def test_peaks(spark):
    histo = spark.createDataFrame([(0, c, n) for c, n in enumerate([9000, 10, 3000, 10, 20, 5000, 0], 1)], "chunk int, count bigint, n_kmers bigint")
    assert [(r.coverage, r.frequency) for r in spectrum.extrema(histo, 1000).orderBy("idx").collect()] == [(3, 3000), (6, 5000)]


def test_expansion_and_mismatch_levels(spark):
    one = spark.createDataFrame([("g", "ARY", "A" * 15)], "gene string, forward_seq string, reverse_seq string")
    found = primers.oligos(one, 19, 2)
    assert sorted(r.oligo for r in found.where("dir = 'fwd' and level = 0").collect()) == ["AAC", "AAT", "AGC", "AGT"]
    assert found.where("dir = 'rev'").count() == 991


@pytest.mark.parametrize("count, want", [(4, [2]), (20, [10, 8, 6, 2]), (9, [4, 2])])
def test_threshold_ladder(spark, count, want):
    from kmerspark.operators.assembly import ladder

    assert ladder(count, 2) == want
    assert spark.range(1).select(primers.thresholds(F.lit(count), F.lit(2)).alias("t")).first().t == want


def test_topk_breaks_ties_by_kmer(spark):
    rows = spark.createDataFrame([("g", "fwd", 0, k, 5) for k in (9, 3, 7, 1, 5)], "gene string, dir string, level int, kmer bigint, n bigint")
    assert sorted(r.kmer for r in primers.most_frequent(rows, 3).collect()) == [1, 3, 5]


def test_counting_is_empty_on_empty_reads(spark):
    none = spark.createDataFrame([], "seq string")
    assert counting.count_kmers(none, 19).count() == 0
    assert tuple(counting.summary(counting.count_kmers(none, 19)).first()) == (0, 0, 0, 0, 0)
