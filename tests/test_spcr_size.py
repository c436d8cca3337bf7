import io
import random
import tempfile
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from kmerspark.operators import amplicons, assembly, counting, primers, tally


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_near_copies_by_bounded_distance_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = []
    for gene in ("a", "b"):
        seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(20, 40))) for _ in range(6)]
        for s in seqs * 4:
            s = list(s)
            for _ in range(rng.randint(0, 14)):
                s[rng.randrange(len(s))] = rng.choice("ACGT")
            rows.append((gene, "".join(s), float(rng.randint(1, 9))))
    for most in (3, 20):
        found = amplicons.distinct_products(spark.createDataFrame(rows, "gene string, seq string, score double"), 10, most)
        with redirect_stdout(io.StringIO()) as said:
            found.explain()
        # genes are dealt out, not put together for being few bytes
        assert "REPARTITION_BY_NUM" in said.getvalue()
        for gene in ("a", "b"):
            kept = []
            for _, seq in sorted((-score, seq) for g, seq, score in rows if g == gene):
                if all(distance(seq, other) > 10 for other in kept):
                    kept.append(seq)
            assert [r.seq for r in found.where(F.col("gene") == gene).orderBy("product").collect()] == kept[:most]


def test_graphs_from_a_stored_table_equal_those_from_a_broadcast_one(spark):
    rng, k = random.Random(7), 19
    genome = "".join(rng.choice("ACGT") for _ in range(600))
    other = genome[:300] + "ACGT"["ACGT".index(genome[300]) - 1] + genome[301:]
    reads = spark.createDataFrame([(s[i : i + 100],) for s in (genome, other) * 3 for i in range(0, 501, 25)], "seq string")
    turned = genome[-18:][::-1].translate(str.maketrans("ACGT", "TGCA"))
    pairs = primers.with_defaults(spark.createDataFrame([("g", genome[:18], turned)], "gene string, forward_seq string, reverse_seq string"))
    counts = counting.count_kmers(reads, k)
    top = primers.most_frequent(primers.match(counts, primers.oligos(pairs, k), k, 2))
    folder = assembly.stored(lambda finish, schema: tally.counted(reads, k, finish=finish, schema=schema), tempfile.mkdtemp())
    table = assembly.FileTable(folder, k)
    solid = {r.kmer: r.n for r in counts.collect() if r.n >= 2}
    assert len(table.kmers) == len(solid) and (np.diff(table.kmers) > 0).all()
    assert all(table.count(kmer) == n for kmer, n in solid.items())
    edges = lambda c: sorted(map(tuple, assembly.grow(c, top, pairs, k).collect()))
    assert len(edges(folder)) > 500 and edges(folder) == edges(counts)
