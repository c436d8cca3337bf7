import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerspark.llm import mixing, packing, sharding

DOC = "doc_id bigint, text string, source string, n_chars bigint, size string, _id int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOC)


def test_pivot_keeps_the_sum_and_settles_all_but_one():
    rng = np.random.default_rng(0)
    mass = rng.integers(1, mixing.ONE, 501)
    out = mixing.pivot(np.zeros(501, int), mass, rng.integers(0, 2**60, 501), 3)
    assert out.sum() == mass.sum()
    assert ((out > 0) & (out < mixing.ONE)).sum() <= 1


def test_pivot_is_fair():
    mass = np.array([mixing.ONE // 4, mixing.ONE // 2, mixing.ONE // 4] * 400)
    groups = np.repeat(np.arange(400), 3)
    hits = np.zeros(3)
    for seed in range(20):
        out = mixing.pivot(groups, mass, np.arange(1200), seed * 7919)
        hits += (out == mixing.ONE).reshape(400, 3).sum(0)
    assert np.allclose(hits / 8000, [0.25, 0.5, 0.25], atol=0.03)


@pytest.mark.parametrize("bucket", [7, 50_000])
def test_copies_meet_the_epochs_of_each_source(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(1)
    table = docs(spark, [(i, "t", rng.choice("aab"), rng.randint(1, 50)) for i in range(120)])
    epochs = {r.source: r.epochs * r.rows for r in mixing.epochs_by_source(table, None, 0.5).collect()}
    got = Counter()
    for r in mixing.copies(table, alpha=0.5).collect():
        got[r.source] += r.copies
    assert all(abs(got[s] - e) < 1 + 1e-6 for s, e in epochs.items())
    mixed = mixing.mix_documents(table, alpha=0.5)
    assert mixed.columns == table.columns and mixed.count() == sum(got.values())


def test_mixing_edge_cases(spark):
    table = docs(spark, [(None, "a", "s", 5), (1, "b", None, None), (1, "b", None, None), (2, "", "s", 0)])
    rows = {(r.doc_id, r.source): r.copies for r in mixing.copies(table).collect()}
    assert set(rows) == {(None, "s"), (1, None), (2, "s")} and rows[(1, None)] == 1
    assert mixing.mix_documents(table).where("doc_id = 1").count() == 2
    assert mixing.copies(table.limit(0)).count() == 0 and mixing.mix_documents(table.limit(0)).count() == 0
    given = {(r.doc_id, r.source): r.copies for r in mixing.copies(table, mixing.weights_frame(spark, {"s": 1.0, "gone": 2.0})).collect()}
    assert given[(1, None)] == 0 and given[(None, "s")] + given[(2, "s")] == 2


@pytest.mark.parametrize("range_rows", [3, 100])
def test_shards_equal_a_plain_running_sum(spark, range_rows):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(20)]), "ü" * rng.randint(0, 9), "s", 1) for _ in range(40)] + [(7, None, "s", 1), (8, "x" * 5000, "s", 1)]
    got = sorted((r.start_byte, r.n_bytes, r.shard) for r in sharding.assign(docs(spark, rows), 5, range_rows).collect())
    sizes = [len((t or "").encode()) for _, t in sorted(((d is not None, d or 0, len((t or "").encode())), t) for d, t, *_ in rows)]
    start, want, target = 0, [], max(1, -(-sum(sizes) // 5))
    for n in sizes:
        want.append((start, n, min(start // target, 4)))
        start += n
    assert got == sorted(want)
    assert sharding.assign(docs(spark, rows).limit(0)).count() == 0


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([None, 3, 3, *range(8)]), "x" * rng.randint(0, 30), 1, 2, i) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, low int, start_byte int")
    name = sharding.write_shards(table, f"{tmp_path}/s", 7, 10)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert name == "shard_" and sorted(map(tuple, back.select(*table.columns).collect()), key=str) == sorted(rows, key=str)
    numbers = sorted((r.start_byte, r.shard) for r in sharding.assign(table, 7, 10).collect())
    assert Counter(r[name] for r in back.collect()) == Counter(s for _, s in numbers)
    sharding.write_shards(table.limit(0), f"{tmp_path}/none", 7)


def brute_copies(spark, rows, alpha, seed=17):
    """Sequential pivotal rounding: lists instead of arrays, one pair at a time."""
    from kmerspark.llm.text import mix

    one, m64 = mixing.ONE, (1 << 64) - 1
    m = lambda v: int(mix(np.array([v & m64], dtype=np.uint64))[0])
    table = docs(spark, rows)
    epochs = {r.source: r.epochs for r in mixing.epochs_by_source(table, None, alpha).collect()}
    units = table.select("doc_id", "source").distinct().select("doc_id", "source", F.xxhash64("doc_id", "source", F.lit(seed)).alias("tie"))
    units = units.withColumn("h", F.xxhash64("tie")).withColumn("last", F.pmod(F.xxhash64("tie", F.lit(seed + 1)), F.lit(one))).collect()
    base = {(u.doc_id, u.source): int(epochs[u.source] // 1) for u in units}
    mass = {(u.doc_id, u.source): round((epochs[u.source] - epochs[u.source] // 1) * one) for u in units}
    bucket = max(1, -(-len(rows) // mixing.BUCKET_ROWS))
    place, level = {(u.doc_id, u.source): u.h % bucket for u in units}, 0
    while True:
        for group in {(place[u.doc_id, u.source], u.source) for u in units}:
            live = sorted((u for u in units if (place[u.doc_id, u.source], u.source) == group and 0 < mass[u.doc_id, u.source] < one), key=lambda u: u.tie)
            turn = 0
            while len(live) > 1:
                for a, b in zip(live[0::2], live[1::2]):
                    x, y = (a.doc_id, a.source), (b.doc_id, b.source)
                    u = (m(m(a.tie + seed + 1000 * level) ^ m(b.tie + turn + 1)) >> 11) / (1 << 53)
                    total = mass[x] + mass[y]
                    chance = mass[x] / total if total < one else (one - mass[y]) / max(2 * one - total, 1)
                    mass[x] = min(total, one) if u < chance else max(total - one, 0)
                    mass[y] = total - mass[x]
                live, turn = [u for u in live if 0 < mass[u.doc_id, u.source] < one], turn + 1
        if bucket == 1:
            break
        bucket, level = -(-bucket // mixing.FAN_IN), level + 1
        place = {k: v % bucket for k, v in place.items()}
    for u in units:
        if 0 < mass[u.doc_id, u.source] < one:
            mass[u.doc_id, u.source] = one if u.last < mass[u.doc_id, u.source] else 0
    return {k: base[k] + (mass[k] >= one) for k in base}


@pytest.mark.parametrize("bucket,broadcast", [(9, 10**6), (50_000, 0)])
def test_copies_equal_brute_force(spark, monkeypatch, bucket, broadcast):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    monkeypatch.setattr(mixing, "BROADCAST_UNITS", broadcast)
    rng = random.Random(5)
    rows = [(rng.choice([None, i]) if i % 9 == 0 else i, "t", rng.choice(["a", "a", "b", None]), rng.randint(0, 40)) for i in range(70)]
    rows += rows[:6]
    want = brute_copies(spark, rows, 0.4)
    assert {(r.doc_id, r.source): r.copies for r in mixing.copies(docs(spark, rows), alpha=0.4).collect()} == want
    mixed = Counter((r.doc_id, r.source) for r in mixing.mix_documents(docs(spark, rows), alpha=0.4).collect())
    rows_of = Counter((d, s) for d, _, s, _ in rows)
    assert mixed == Counter({k: n * want[k] for k, n in rows_of.items() if want[k]})


def fewest(sizes, capacity):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_bins_are_as_few_as_brute_force_finds():
    rng = random.Random(3)
    for _ in range(150):
        sizes = sorted((rng.randint(0, 60) for _ in range(rng.randint(0, 10))), reverse=True)
        bins = packing.complete_bins(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) == fewest(sizes, 100)


def test_bin_completion_beats_best_fit():
    rng, won = random.Random(6), 0
    for _ in range(60):
        sizes = sorted((rng.randint(15, 60) for _ in range(24)), reverse=True)
        best, bins = packing.best_fit(sizes, 100), packing.complete_bins(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= len(bins) <= len(best)
        won += len(bins) < len(best)
    assert won > 0


def test_lower_bound_looks_at_every_size():
    rng = random.Random(7)
    for _ in range(200):
        sizes = sorted((rng.randint(0, 100) for _ in range(rng.randint(0, 150))), reverse=True)
        want = max(-(-sum(sizes) // 100), sum(2 * s > 100 for s in sizes), 1 if sizes else 0)
        for k in {s for s in sizes if 0 < 2 * s <= 100}:
            middle = [s for s in sizes if 2 * s > 100 and s <= 100 - k]
            rest = sum(s for s in sizes if k <= s and 2 * s <= 100) - (len(middle) * 100 - sum(middle))
            want = max(want, sum(2 * s > 100 for s in sizes) + max(0, -(-rest // 100)))
        assert packing.lower_bound(sizes, 100) == want


def test_one_identifier_does_not_fill_one_cell(spark):
    same = docs(spark, [(i if i % 3 else None, "x" * 10, "s", 1) for i in range(900)])
    cells = Counter(r.bin >> 32 for r in packing.pack(same, 100, cell_items=50).collect())
    assert max(cells.values()) < 150


def test_every_piece_is_packed_once(spark):
    rows = [(i, "x" * (i * 37 % 290), "s", 1) for i in range(60)] + [(None, None, "s", 1), (5, "y", "s", 1), (5, "y", "s", 1), (9, "z" * 1000, "s", 1)]
    out = packing.pack(docs(spark, rows), 100, cell_items=16).collect()
    bins, pieces = Counter(), Counter()
    for r in out:
        bins[r.bin] += r.length
        pieces[r.doc_id] += r.length
    assert max(bins.values()) <= 100
    want = Counter()
    for d, t, *_ in rows:
        want[d] += len(t or "")
    assert pieces == want and len({(r.bin, r.slot) for r in out}) == len(out)
    assert packing.pack(docs(spark, rows).limit(0), 100).count() == 0
    assert packing.pack(docs(spark, rows), 100, F.col("n_chars")).count() == len(rows)
