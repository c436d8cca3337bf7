import io
import random
import re
from collections import Counter
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerspark.operators import histogram, tally
from kmerspark.sources import synthetic as syn


def plain(seq, k):
    for i in range(len(seq) - k + 1):
        s = seq[i : i + k]
        if "N" not in s:
            yield min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))


def number(s):
    return int("".join(str("ACGT".index(c)) for c in s), 4)


def dna(text):
    return text.encode().hex().upper().translate(str.maketrans("0123456789ABCDEF", "ACGTACGTACGNACGT"))


@pytest.mark.parametrize("k", [1, 5, 19, 31])
@pytest.mark.parametrize("held", [20, 5_000_000])
def test_counts_equal_plain_ones_whatever_a_task_holds(spark, monkeypatch, k, held):
    rng = random.Random(k)
    rows = [(i % 3, "".join(rng.choice("ACGTACGTN") for _ in range(rng.randint(0, 80)))) for i in range(90)] + [(None, "ACGT" * 9), (1, None), (1, "A" * 900)]
    monkeypatch.setattr(tally, "HELD", held)
    monkeypatch.setattr(tally, "ADDED", 50 if held == 20 else tally.ADDED)
    frame = spark.createDataFrame(rows, "g int, seq string")
    found = tally.counted(frame, k, "g int", tally.column_groups(("g",))).collect()
    want = Counter((g, number(s)) for g, seq in rows for s in plain(seq or "", k))
    assert {(r.g, r.kmer): r.n for r in found} == want and len(found) == len(want)


def test_blobs_keep_wide_steps_and_large_counts():
    numbers, n = np.array([0, 3, 65538, 1 << 37, (1 << 38) - 1]), np.array([1, 254, 255, 1 << 40, 7])
    parts = dict(tally.packed(numbers, n, np.array([0, 1 << 36, 1 << 37, 1 << 38])))
    assert sorted(parts) == [0, 2]
    back = [tally.unpacked(parts[i]) for i in sorted(parts)]
    assert np.concatenate([b[0] for b in back]).tolist() == numbers.tolist()
    assert np.concatenate([b[1] for b in back]).tolist() == n.tolist()


def test_sieve_passes_all_that_is_sought(spark):
    sought = np.arange(0, 1 << 30, 104_729)
    kept = tally.Sieve(spark, sought)(np.arange(1 << 20))
    assert kept[sought[sought < 1 << 20]].all() and kept.mean() < 0.1


def test_windows_of_texts_are_those_of_their_reads(spark, tmp_path):
    texts = ["", "k", "short", "kkkkkkkkkkkkkkkkkkkkk", "wörds " * 80, "a line of some length, read in several windows " * 9]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = tally.counted(syn.texts(spark, str(tmp_path)), 19, codes=syn.text_codes).collect()
    reads = [r.seq for r in syn.plain_reads(spark, str(tmp_path)).collect()]
    assert {r.kmer: r.n for r in found} == Counter(number(s) for seq in reads for s in plain(seq, 19)) == Counter(number(s) for t in texts for s in plain(dna(t), 19))


def test_moves_of_a_task_equal_those_by_window(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(40), rng.randint(1, 6)) for _ in range(300)]
    counts = spark.createDataFrame(rows, "chunk int, kmer bigint, n bigint").groupBy("chunk", "kmer").agg(F.sum("n").alias("n"))
    found = {}
    for r in counts.orderBy("kmer").collect():
        found.setdefault((r.chunk,), []).append((r.kmer, r.n))
    groups = {g: tuple(np.array(c) for c in zip(*v)) for g, v in found.items()}
    got = [dict(zip(("chunk", "count", "delta"), row)) for b in histogram.found_moves(groups, 20) for row in zip(*(b.column(i).to_pylist() for i in range(3)))]
    want = {(r.chunk, r["count"]): r.delta for r in histogram.moves(counts, 20).collect() if r.delta}
    assert {(r["chunk"], r["count"]): r["delta"] for r in got if r["delta"]} == want


@pytest.mark.parametrize("k", [5, 31])
def test_keys_hold_all_their_rows_however_they_are_cut(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([None, 1, 2, 3, *range(10, 60)]), "".join(rng.choice("ACGTACGTN") for _ in range(rng.randint(0, 90)))) for _ in range(300)] + [(99, "AC"), (98, None)]
    found = tally.by_key(spark.createDataFrame(rows, "doc_id bigint, seq string"), k, "doc_id", slice_bytes=200).collect()
    want = {}
    for key, seq in rows:
        for s in plain(seq or "", k):
            want.setdefault(key, []).append(s)
    assert len(found) == len(want)
    assert {r.doc_id: (r.n, r.n_distinct, r.least, r.greatest) for r in found} == {key: (len(v), len(set(v)), min(v), max(v)) for key, v in want.items()}


def test_extract_expands_no_rows(spark):
    import __spark_entry__

    with redirect_stdout(io.StringIO()) as said:
        __spark_entry__.queries()["kmer_extract"](spark, "/root/testdata/sf0.001").explain()
    assert not re.search(r"Generate explode|HashAggregate", said.getvalue())


@pytest.mark.parametrize("query", ["kmer_histogram", "kmer_histogram_moves", "kmer_counts", "kmer_counts_by_chunk", "kmer_min_count_filter", "kmer_stats"])
def test_no_row_for_each_kmer_is_shuffled(spark, query):
    import __spark_entry__

    with redirect_stdout(io.StringIO()) as said:
        __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001").explain()
    assert not re.search(r"hashpartitioning\([^)]*kmer", said.getvalue())


def test_reads_cut_from_texts_equal_those_cut_by_columns(spark, tmp_path):
    texts = ["", None, "k", "wörds " * 80, "a line of some length, read in several windows " * 9, "x" * 75, "y" * 76]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    # a text that is null has no bases
    want = sorted((r.doc_id, r.o, r.seq) for r in syn.plain_reads(spark, str(tmp_path)).where("seq is not null").collect())
    cut = syn.texts(spark, str(tmp_path)).select("doc_id", "seq").mapInArrow(lambda batches: (c for b in batches for c in syn.cut_reads(b)), "doc_id bigint, o int, seq string")
    assert sorted(map(tuple, cut.collect())) == want


def test_primer_sieve_keeps_every_match(spark):
    from kmerspark.operators import primers

    pairs = spark.createDataFrame([("g", "ACGTTGCARYACGTTGAC", "TTGACCATTTGACCAGTA")], "gene string, forward_seq string, reverse_seq string")
    oligos = primers.oligos(pairs, 19, 1)
    only, ends = primers.sieve(oligos, 19), [r.oligo for r in oligos.select("oligo").distinct().collect()]
    turned = [o[::-1].translate(str.maketrans("ACGT", "TGCA")) for o in ends]
    assert only(np.array([number(o + "ACGT") for o in ends] + [number("CCAA" + o) for o in turned])).all()
    assert only(np.random.default_rng(1).integers(0, 1 << 38, 10_000)).mean() < 0.2


@pytest.mark.parametrize("query", ["primer_match", "edge_support", "branch_links"])
def test_kmers_that_cannot_match_are_not_counted(spark, query):
    import __spark_entry__

    asked = []
    plain_counted = tally.counted

    def counted(*args, only=None, **more):
        asked.append(only)
        return plain_counted(*args, only=only, **more)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tally, "counted", counted)
        __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001")
    assert asked and all(asked)
