"""Approximate nearest neighbours by cross-polytope hashing, reranked exactly.

Vectors are scaled to length one and turned by pseudo-random rotations, each three rounds of
random signs and a fast Hadamard transform; the signed axis nearest to the turned vector is
its hash, one of twice the dimension. A table's bucket joins the hashes of one or more
rotations. Every vector is stored once in each of ``TABLES`` tables; a query is looked up in
the ``probes`` buckets of each table that it is nearest to, in the order of their cost. A
bucket's stored vectors meet its lookups in matrix products, so every candidate is compared by
its exact cosine; no bucket is cut short.

Queries are the rows whose identifier ``every`` divides, searched against all rows.

How many rotations a table and how many probes it takes is fitted: the exact neighbours of
``FIT_QUERIES`` queries (a bounded sample, chosen by a hash) are found by one scan, and for each
number of rotations the least number of probes is taken that finds ``FIT_RECALL`` of them; of
these settings the one with the fewest expected comparisons is used. More rows give finer
buckets where the data let them: vectors with close neighbours are found in a few small
buckets, whereas random unit vectors, whose neighbours are hardly nearer than others, need
many probes in coarse ones.

Equal vectors are one entry with its ``k`` + 1 least identifiers, which are all that a result
can name, so a group of copies costs one row whatever its size; copies fold in each task
before anything is shuffled. Each table is cut into shards; a query goes to a shard once with
the list of its buckets there. A bucket that a bounded sample of rows shows to hold over
``HOT_ROWS`` is stored in several shards, and looked up in all of them.

Defined results: rows with a null identifier, a null, empty or zero vector, a null or
non-finite entry, or a dimension other than the most frequent one take no part. Rows that
repeat an identifier never find each other; each other row finds the identifier once, by its
best vector; as a query, it is answered once, by the best of its vectors. Ties go to the lesser
identifier. Fewer than ``k`` others give fewer rows. An empty table, or one without a query,
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerspark.llm.text import U64, mix
from kmerspark.session import checkpointed

NEIGHBOURS = 10
EVERY = 20
TABLES = 8
MOST_ROTATIONS, MOST_PROBES = 3, 256
FIT_QUERIES, FIT_RECALL, FIT_ROWS = 100, 0.95, 20_000
#: Stored rows a shard, and rows of one bucket past which it is cut.
SHARD_ROWS, HOT_ROWS = 50_000, 200_000
RESULT = "vec_id bigint, rank int, neighbor_id bigint, cosine double"
_CELLS = 1 << 21
#: What one lookup costs beside its comparisons, in comparisons.
_LOOKUP_COST = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row (a power of two wide)."""
    rows, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(rows, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, width)
        h *= 2
    return x / np.float32(np.sqrt(width))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    if width > x.shape[1]:
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.float32), (3, width))
    for row in signs:
        x = hadamard(x * row)
    return x


def axes(dim: int) -> int:
    """Signed axes, the buckets of one rotation."""
    return 2 * max(2, 1 << (dim - 1).bit_length())


def probe_buckets(x: np.ndarray, table: int, rotations: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of each row (or all, if fewer), the nearest first."""
    codes = np.zeros((len(x), 1), dtype=np.int64)
    costs = np.zeros((len(x), 1), dtype=np.float32)
    for r in range(rotations):
        y = rotate(x, 1_000_003 * table + r)
        both = np.concatenate([y, -y], axis=1)
        most = min(probes, both.shape[1])
        near = np.argpartition(-both, most - 1, axis=1)[:, :most]
        value = np.take_along_axis(both, near, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        cost = (value[:, :1] - value) ** 2
        # both lists rise in cost: of their pairs (i, j), those before it number (i + 1)(j + 1) - 1 at least
        i, j = np.nonzero(np.outer(np.arange(codes.shape[1]) + 1, np.arange(most) + 1) <= probes)
        codes, costs = codes[:, i] * both.shape[1] + near[:, j], costs[:, i] + cost[:, j]
        if r:
            keep = np.argsort(costs, axis=1, kind="stable")[:, :probes]
            codes, costs = np.take_along_axis(codes, keep, 1), np.take_along_axis(costs, keep, 1)
    return codes


def _many_probes(x: np.ndarray, table: int, rotations: int, probes: int) -> np.ndarray:
    """``probe_buckets`` in pieces, so that the combinations of a piece stay small."""
    step = max(16, (1 << 19) // (probes * 8))
    return np.concatenate([probe_buckets(x[i : i + step], table, rotations, probes) for i in range(0, len(x), step)])


def _blobs(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), dim)


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a digest of each vector."""
    both = np.frombuffer(b"".join(hashlib.blake2b(v, digest_size=16).digest() for v in column.to_pylist()), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def unit_rows(good: DataFrame, dim: int, every: int) -> DataFrame:
    """(vec_id, vector, asked): usable rows, scaled to length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, dim)
            norm = np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x))
            usable = np.isfinite(norm) & (norm > 0)
            x = (x[usable] / norm[usable][:, None]).astype(np.float32)
            ids = batch.column("vec_id").to_numpy()[usable]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), _blobs(x), pa.array(ids % every == 0)], names=["vec_id", "vector", "asked"])

    return good.where(F.size("embedding") == dim).mapInArrow(run, "vec_id bigint, vector binary, asked boolean")


def entries(units: DataFrame, k: int) -> DataFrame:
    """(vector, ids, asked): distinct vectors with their k + 1 least identifiers; copies fold in each task first."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list] = {}
            for i, v, a in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), batch.column("asked").to_pylist()):
                own = held.setdefault(v, [set(), False])
                own[0].add(i)
                own[1] |= a
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(i)[: k + 1] for i, _ in held.values()], pa.list_(pa.int64())), pa.array([a for _, a in held.values()])], names=["vector", "ids", "asked"])

    folded = units.mapInArrow(fold, "vector binary, ids array<bigint>, asked boolean")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return folded.groupBy("vector").agg(merged.alias("ids"), F.bool_or("asked").alias("asked"))


def true_neighbours(table: DataFrame, sample: np.ndarray, k: int) -> np.ndarray:
    """(rows of ``sample`` with a neighbour's vector behind each): the exact ``k`` nearest entries, by one scan."""
    dim = sample.shape[1]
    shared = table.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), dim)
            sims = shared.value @ x.T
            sims[sims > 1 - 1e-6] = -9  # itself
            most = min(k, len(x))
            at = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            query = np.repeat(np.arange(len(sims)), most)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(sims[query, at.ravel()].astype(np.float64)), batch.column("vector").take(pa.array(at.ravel()))], names=["query", "cosine", "vector"])

    near = table.select("vector").mapInArrow(run, "query bigint, cosine double, vector binary")
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "vector")
    rows = near.withColumn("_n", F.row_number().over(best)).where((F.col("_n") <= k) & (F.col("cosine") > -5)).select("query", "vector").collect()
    if not rows:
        return np.zeros((0, 2, dim), np.float32)
    return np.stack([np.stack([sample[r["query"]], np.frombuffer(r["vector"], np.float32)]) for r in rows])


def fit_probes(pairs: np.ndarray, rows: int, dim: int, tables: int, target: float = FIT_RECALL) -> tuple[int, int]:
    """(rotations, probes) with the fewest expected comparisons that finds ``target`` of the pairs.

    One rotation with all its buckets finds everything, so there always is a setting.
    """
    width, best = axes(dim), None
    for rotations in range(1, MOST_ROTATIONS + 1):
        if rotations > 1 and width ** (rotations - 1) > max(rows, 1):
            break
        most = min(MOST_PROBES, width**rotations)
        rank = np.full(len(pairs), most)
        for table in range(tables):
            if len(pairs):
                codes = _many_probes(pairs[:, 0], table, rotations, most)
                hit = codes == probe_buckets(pairs[:, 1], table, rotations, 1)
                rank = np.minimum(rank, np.where(hit.any(1), hit.argmax(1), most))
        place = max(0, int(np.ceil(target * len(rank))) - 1)
        probes = int(np.sort(rank)[place]) + 1 if len(rank) else 1
        if probes > most and rotations > 1:
            continue
        cost = min(probes, most) * (rows / width**rotations + _LOOKUP_COST)
        if best is None or cost < best[0]:
            best = (cost, rotations, min(probes, most))
    return best[1], best[2]


def hot_buckets(sample: np.ndarray, rows: int, tables: int, rotations: int, hot_rows: int = HOT_ROWS) -> dict[tuple[int, int], int]:
    """(table, code): number of cuts, of the buckets that a sample of ``rows`` shows to be hot."""
    found = {}
    for table in range(tables if len(sample) else 0):
        codes, counts = np.unique(probe_buckets(sample, table, rotations, 1)[:, 0], return_counts=True)
        for code, n in zip(codes.tolist(), counts.tolist()):
            cuts = -(-int(n * rows / len(sample)) // hot_rows)
            if n > 1 and cuts > 1:
                found[table, code] = cuts
    return found


def _placed(table: DataFrame, dim: int, tables: int, rotations: int, probes: int, shards: int, hot: dict[tuple[int, int], int]) -> DataFrame:
    """Stored rows (one a table) and lookups (one a shard), each with the shard it belongs to."""

    def shard_of(t: int, code: np.ndarray) -> np.ndarray:
        return t * shards + (mix(code.view(U64) * U64(2 * t + 1)) % U64(shards)).astype(np.int64)

    def cut(t: int, codes: np.ndarray, which: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) with the cuts of hot buckets: one of them for each stored row, else all."""
        row, codes = np.arange(codes.size) // (codes.shape[1] if codes.ndim > 1 else 1), codes.ravel()
        own = {code: n for (other, code), n in hot.items() if other == t}
        if own:
            times = np.array([own.get(c, 1) for c in codes.tolist()])
            if which is not None:
                return row, codes + (which % times.astype(U64)).astype(np.int64) * (1 << 40)
            again = np.repeat(np.arange(len(codes)), times)
            row, codes = row[again], codes[again] + (np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)) * (1 << 40)
        return row, codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "stored", "bucket", "buckets", "h1", "h2", "ids", "vector"]
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x, vectors, ids = _matrix(part.column("vector"), dim), part.column("vector"), part.column("ids")
                h1, h2 = _keys(vectors)
                asked = np.flatnonzero(part.column("asked").to_numpy(zero_copy_only=False))
                for t in range(tables):
                    _, code = cut(t, probe_buckets(x, t, rotations, 1)[:, 0], h1.view(U64))
                    n = len(code)
                    yield pa.RecordBatch.from_arrays([pa.array(shard_of(t, code).astype(np.int32)), pa.array(np.ones(n, bool)), pa.array(code), pa.nulls(n, pa.list_(pa.int64())), pa.array(h1), pa.array(h2), ids, vectors], names=names)
                    if not len(asked):
                        continue
                    row, code = cut(t, _many_probes(x[asked], t, rotations, probes), None)
                    shard = shard_of(t, code)
                    order = np.lexsort((code, shard, row))
                    row, code, shard = row[order], code[order], shard[order]
                    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])))
                    who, n = pa.array(asked[row[first]]), len(first)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(code))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int64)), lists, pa.array(h1).take(who), pa.array(h2).take(who), pa.nulls(n, pa.list_(pa.int64())), vectors.take(who)], names=names)

    return table.mapInArrow(run, "shard int, stored boolean, bucket bigint, buckets array<bigint>, h1 bigint, h2 bigint, ids array<bigint>, vector binary")


class _Shard:
    """The lookups of a shard, and what has been found for them."""

    def __init__(self, number: int, dim: int, k: int):
        self.number, self.dim, self.k = number, dim, k
        self.lookups: list[tuple] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.ready = False

    def look_up(self, part: pa.RecordBatch) -> None:
        lists = part.column("buckets")
        self.lookups.append((part.column("h1").to_numpy(), part.column("h2").to_numpy(), _matrix(part.column("vector"), self.dim), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()))

    def _prepare(self) -> None:
        self.ready = True
        if not self.lookups:
            return
        self.h1, self.h2, self.x, lengths, buckets = (np.concatenate(v) for v in zip(*self.lookups))
        who = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(buckets, kind="stable")
        self.buckets, self.who = buckets[order], who[order]
        self.lookups = [()]

    def compare(self, bucket: int, part: pa.RecordBatch) -> None:
        """Stored rows of one bucket (or some of them) against the queries that look it up."""
        if not self.ready:
            self._prepare()
        if not self.lookups:
            return
        own = self.who[np.searchsorted(self.buckets, bucket) : np.searchsorted(self.buckets, bucket, side="right")]
        if not len(own):
            return
        x, lists = _matrix(part.column("vector"), self.dim), part.column("ids")
        offsets, ids = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        plain = len(np.unique(ids)) == len(ids)
        step = max(1, _CELLS // max(1, len(x)))
        for at in range(0, len(own), step):
            who = own[at : at + step]
            sims = self.x[who] @ x.T
            most = min(self.k + 1, sims.shape[1])
            while True:
                # all ties of the last one count; the end settles them
                bound = np.partition(sims, sims.shape[1] - most, axis=1)[:, sims.shape[1] - most]
                row, column = np.nonzero(sims >= bound[:, None])
                times = np.diff(offsets)[column]
                again = np.repeat(np.arange(len(row)), times)
                other = ids[np.repeat(offsets[column] - (np.cumsum(times) - times), times) + np.arange(len(again))]
                # rows that repeat an identifier must not use up the places of others
                if plain or most == sims.shape[1] or min(len(np.unique(other[row[again] == r])) for r in range(len(who))) > self.k:
                    break
                most = min(2 * most, sims.shape[1])
            self.found.append((who[row[again]], other, sims[row, column][again]))
            self.held += len(other)
        if self.held > 2_000_000:
            self._fold()

    def _fold(self) -> None:
        """The k + 1 best identifiers of each query so far."""
        who, other, cosine = (np.concatenate(v) for v in zip(*self.found))
        order = np.lexsort((-cosine, other, who))
        who, other, cosine = who[order], other[order], cosine[order]
        once = np.append(True, (who[1:] != who[:-1]) | (other[1:] != other[:-1]))
        who, other, cosine = who[once], other[once], cosine[once]
        order = np.lexsort((other, -cosine, who))
        who, other, cosine = who[order], other[order], cosine[order]
        start = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
        keep = rank <= self.k
        self.found = [(who[keep], other[keep], cosine[keep])]
        self.held = int(keep.sum())

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.found and self.held:
            self._fold()
            who, other, cosine = self.found[0]
            yield pa.RecordBatch.from_arrays([pa.array(self.h1[who]), pa.array(self.h2[who]), pa.array(other), pa.array(cosine.astype(np.float64))], names=["h1", "h2", "neighbor_id", "cosine"])


def _searched(placed: DataFrame, dim: int, parts: int, k: int) -> DataFrame:
    """(h1, h2, neighbor_id, cosine): the best of each shard for each query."""
    ordered = placed.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "stored", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "stored", "bucket")]
            change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            cuts = np.flatnonzero(np.append(True, change)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                number, stored, bucket = (int(c[a]) for c in columns)
                if shard is None or shard.number != number:
                    if shard is not None:
                        yield from shard.close()
                    shard = _Shard(number, dim, k)
                # a bucket may come in several batches; its rows simply meet its lookups again
                part = batch.slice(a, b - a)
                shard.compare(bucket, part) if stored else shard.look_up(part)
        if shard is not None:
            yield from shard.close()

    return ordered.mapInArrow(run, "h1 bigint, h2 bigint, neighbor_id bigint, cosine double")


def _asked_keys(units: DataFrame) -> DataFrame:
    """(vec_id, h1, h2) of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *map(pa.array, _keys(batch.column("vector")))], names=["vec_id", "h1", "h2"])

    return units.where("asked").select("vec_id", "vector").mapInArrow(run, "vec_id bigint, h1 bigint, h2 bigint")


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, tables: int = TABLES, rotations: int | None = None, probes: int | None = None, shard_rows: int = SHARD_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(vec_id, rank, neighbor_id, cosine): the ``k`` nearest found for every row whose ``vec_id`` ``every`` divides."""
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>")).where("vec_id is not null and size(embedding) > 0")
    shape = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], RESULT)
    dim = shape["dim"]
    units = unit_rows(good, dim, every)
    table = checkpointed(entries(units, k))
    rows = table.count()
    order = F.xxhash64("vector")
    asked = [np.frombuffer(r["vector"], np.float32) for r in table.where("asked").orderBy(order).select("vector").limit(FIT_QUERIES).collect()]
    if not asked:
        return spark.createDataFrame([], RESULT)
    if rotations is None or probes is None:
        rotations, probes = fit_probes(true_neighbours(table, np.stack(asked), k), rows, dim, tables)
    sample = [np.frombuffer(r["vector"], np.float32) for r in table.orderBy(order).select("vector").limit(FIT_ROWS).collect()] if rows > hot_rows else []
    hot = hot_buckets(np.stack(sample), rows, tables, rotations, hot_rows) if sample else {}
    # as many shards a table as keep each near shard_rows, and no core idle
    shards = max(-(-rows // shard_rows), -(-2 * spark.sparkContext.defaultParallelism // tables))
    found = _searched(_placed(table, dim, tables, rotations, probes, shards, hot), dim, tables * shards, k)
    # queries with one vector share its answers; a query leaves itself out
    each = _asked_keys(units).join(found, ["h1", "h2"]).where("vec_id <> neighbor_id")
    best = each.groupBy("vec_id", "neighbor_id").agg(F.max("cosine").alias("cosine"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbor_id")))
    return ranked.where(F.col("rank") <= k).select("vec_id", F.col("rank").cast("int"), "neighbor_id", F.round("cosine", 5).alias("cosine"))
