"""Exact counts of k-mers of any number of sequences, with few bytes shuffled and bounded memory.

Each task keeps its k-mers as sorted arrays with their counts and passes these on as blobs, one
for each partition of the k-mers, at the end or when they reach ``HELD`` rows. A partition is a
range of k-mers that have been spread by an odd factor; blobs hold the steps between them
in two or three bytes and counts in one, with larger ones aside. One task for a partition adds up its
blobs. Rows of a k-mer exist only in what that task gives.

Which sequences a k-mer is in can be told apart by groups: a group is a tuple of values of the
result's key columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kmerspark.functions.sequences import COUNT_LIMIT
from kmerspark.operators.kmers import by_size, check_k, code_kmers, letter_codes

#: Rows of k-mers held by a task, windows added to them at once, rows given at once.
HELD, ADDED, GIVEN = 5_000_000, 1 << 21, 100_000
#: Bytes of input for a partition.
PARTITION_BYTES = 4 << 20
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)

Groups = dict[tuple, tuple[np.ndarray, np.ndarray]]


def _times(kmers: np.ndarray, factor: int, k: int) -> np.ndarray:
    return (kmers.view(np.uint64) * np.uint64(factor) & np.uint64((1 << 2 * k) - 1)).view(np.int64)


def spread(kmers: np.ndarray, k: int) -> np.ndarray:
    """Other numbers of the same width, one for each k-mer, that fill their range evenly."""
    return _times(kmers, _ODD, k)


def gathered(numbers: np.ndarray, k: int) -> np.ndarray:
    """The k-mers that ``spread`` gave ``numbers`` for."""
    return _times(numbers, _BACK, k)


def summed(numbers: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct numbers, sums of ``n``), or how often each occurs."""
    if n is None:
        numbers = np.sort(numbers)
    else:
        order = np.argsort(numbers, kind="stable")
        numbers, n = numbers[order], n[order]
    first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(numbers))) if n is None else np.add.reduceat(n, first) if len(first) else n
    return numbers[first], sums


class Tally:
    """Sorted distinct numbers and how often each was added."""

    def __init__(self):
        self.numbers, self.n, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, numbers: np.ndarray) -> None:
        self.waiting.append(numbers)
        self.size += len(numbers)

    def settle(self) -> None:
        if not self.size:
            return
        numbers, n = summed(np.concatenate(self.waiting))
        self.waiting, self.size = [], 0
        if not len(self.numbers):
            self.numbers, self.n = numbers, n
            return
        at = np.searchsorted(self.numbers, numbers)
        known = self.numbers[np.minimum(at, len(self.numbers) - 1)] == numbers
        self.n[at[known]] += n[known]
        fresh = ~known
        place = at[fresh] + np.arange(np.count_nonzero(fresh))
        old = np.ones(len(self.numbers) + len(place), dtype=bool)
        old[place] = False
        for name, more in (("numbers", numbers[fresh]), ("n", n[fresh])):
            both = np.empty(len(old), dtype=np.int64)
            both[place], both[old] = more, getattr(self, name)
            setattr(self, name, both)


def packed(numbers: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(index, blob) of each part of sorted ``numbers`` between ``bounds`` that holds any."""
    cuts = np.searchsorted(numbers, bounds)
    step = np.diff(numbers, prepend=numbers[:1])
    # a third byte where few numbers are held, so that steps are long
    top = 0xFFFFFF if len(step) and step.mean() > 0x5000 else 0xFFFF
    small, few = np.minimum(step, top), np.minimum(n, 0xFF).astype("u1")
    low, high = small.astype("<u2"), (small >> 16).astype("u1")
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = int(cuts[i]), int(cuts[i + 1])
        wide = step[a + 1 : b]
        wide, many = wide[wide >= top], n[a:b][few[a:b] == 0xFF]
        head = np.array([numbers[a], b - a, len(wide), len(many), top], "<i8")
        yield i, b"".join(x.tobytes() for x in (head, low[a + 1 : b], high[a + 1 : b if top > 0xFFFF else a + 1], few[a:b], wide.astype("<i8"), many.astype("<i8")))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, rows, wide, many, top = np.frombuffer(blob, "<i8", 5).tolist()
    step = np.empty(rows, np.int64)
    step[0], at = first, 40
    step[1:] = np.frombuffer(blob, "<u2", rows - 1, at)
    at += 2 * (rows - 1)
    if top > 0xFFFF:
        step[1:] |= np.frombuffer(blob, "u1", rows - 1, at).astype(np.int64) << 16
        at += rows - 1
    n = np.frombuffer(blob, "u1", rows, at).astype(np.int64)
    at += rows
    if wide:
        step[1:][step[1:] == top] = np.frombuffer(blob, "<i8", wide, at)
    if many:
        n[n == 0xFF] = np.frombuffer(blob, "<i8", many, at + 8 * wide)
    return np.cumsum(step), n


def partitions(frame: DataFrame) -> int:
    """A power of two: partitions of about ``PARTITION_BYTES`` of the files that are read, a few at least."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 50:  # not known
        size = PARTITION_BYTES * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(2, min(13, (-(-size // PARTITION_BYTES) - 1).bit_length()))


def column_groups(keys: tuple[str, ...]) -> Callable:
    """The groups of ``counted`` for columns of the rows."""

    def groups(part: pa.RecordBatch, row: np.ndarray, _) -> tuple[list[tuple], np.ndarray]:
        codes = [part.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in keys]
        _, first, own = np.unique(np.stack(codes), axis=1, return_index=True, return_inverse=True)
        return [tuple(part.column(c)[int(f)].as_py() for c in keys) for f in first], own.ravel()[row]

    return groups


def counted(frame: DataFrame, k: int, keys: str = "", groups: Callable | None = None, codes: Callable = letter_codes, only: Callable | None = None, finish: Callable | None = None, schema: str | None = None) -> DataFrame:
    """(keys, kmer, n): the canonical k-mers of ``seq`` with their counts, held at 2**32 - 1, by group.

    ``keys`` declares the columns of a group, and ``groups(rows, row, position)`` gives a list of
    groups and each window's index into it, from its row and its place in its sequence. ``codes``
    gives the bases of a column, ``only(kmers)`` says which k-mers are wanted at all.
    ``finish(groups)`` turns what a task has found, sorted numbers and counts by group, into
    batches of ``schema``; no other task has found any of the same k-mers.
    """
    check_k(k)
    parts = partitions(frame)
    names = [c.split()[0] for c in keys.split(", ")] if keys else []
    bounds = np.array([i << (2 * k - parts.bit_length() + 1) if 2 * k >= parts.bit_length() - 1 else i for i in range(parts)] + [1 << 2 * k], dtype=np.uint64).clip(max=(1 << 63) - 1).astype(np.int64)
    types = pa.schema(_fields(frame, keys)) if keys else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Tally] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for group, tally in held.items():
                tally.settle()
                found = list(packed(tally.numbers, tally.n, bounds))
                tally.numbers = tally.n = np.zeros(0, np.int64)
                for a in range(0, len(found), 64):
                    some = found[a : a + 64]
                    own = [pa.array([value] * len(some), types.field(c).type) for c, value in zip(names, group)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([i for i, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())], names=[*names, "part", "blob"])
            held.clear()

        waiting = 0
        for batch in batches:
            for rows in by_size(batch):
                bases, offsets = codes(rows.column("seq"))
                each = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) if groups else None
                for at, values in code_kmers(bases, offsets, k):
                    if only:
                        kept = only(values)
                        at, values = at[kept], values[kept]
                    numbers = spread(values, k)
                    if groups:
                        row = each[at]
                        listed, code = groups(rows, row, at - offsets[row])
                        for i, group in enumerate(listed):
                            held.setdefault(group, Tally()).add(numbers[code == i])
                    else:
                        held.setdefault((), Tally()).add(numbers)
                    waiting += len(values)
                    if waiting >= ADDED:
                        for tally in held.values():
                            tally.settle()
                        waiting = 0
                        if sum(len(t.numbers) for t in held.values()) >= HELD:
                            yield from emptied()
        yield from emptied()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        fresh = 0

        def settle() -> int:
            for group, found in held.items():
                if len(found) > 1:
                    numbers, n = (np.concatenate(c) for c in zip(*found))
                    held[group] = [summed(numbers, n)]
            return sum(len(found[0][0]) for found in held.values())

        most = HELD
        for batch in batches:
            own = [batch.column(c).to_pylist() for c in names]
            for i, blob in enumerate(batch.column("blob")):
                found = unpacked(blob.as_py())
                held.setdefault(tuple(c[i] for c in own), []).append(found)
                fresh += len(found[0])
                if fresh >= most:
                    most, fresh = max(HELD, settle()), 0
        settle()
        yield from (finish or given)({group: found[0] for group, found in held.items()})

    def given(found: Groups) -> Iterator[pa.RecordBatch]:
        for group, (numbers, n) in found.items():
            for a in range(0, len(n), GIVEN):
                some = np.minimum(n[a : a + GIVEN], COUNT_LIMIT)
                own = [pa.array([value] * len(some), types.field(c).type) for c, value in zip(names, group)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(gathered(numbers[a : a + GIVEN], k)), pa.array(some)], names=[*names, "kmer", "n"])

    lead = f"{keys}, " if keys else ""
    blobs = frame.mapInArrow(count, f"{lead}part int, blob binary")
    return blobs.repartitionById(parts, "part").mapInArrow(merge, schema or f"{lead}kmer bigint, n bigint")


def _fields(frame: DataFrame, keys: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(keys)))


def by_key(frame: DataFrame, k: int, key: str, codes: Callable = letter_codes, slice_bytes: int = 4 << 20) -> DataFrame:
    """(key, n, n_distinct, least, greatest) of the canonical k-mers of all sequences (key, seq) of a key, as text.

    The sequences of a key meet in one task, which holds the k-mers of one slice of rows and
    the distinct ones of the key that it ends with. Only sequences are shuffled.
    """
    check_k(k)
    kind = dict(frame.dtypes)[key]
    # a slice has fewer keys than there is room for beside the k-mer
    room = 1 << min(20, 63 - 2 * k)

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows in by_size(batch, "seq", slice_bytes):
            for a in range(0, rows.num_rows, room):
                yield rows.slice(a, room)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_n, open_kmers, field = None, 0, None, None

        def rows_of(keys: list, n: np.ndarray, distinct: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, field), pa.array(n, pa.int64()), pa.array(distinct, pa.int64()), strings(spread(least, k), k), strings(spread(greatest, k), k)], names=[key, "n", "n_distinct", "least", "greatest"])

        def last() -> Iterator[pa.RecordBatch]:
            if open_kmers is not None and len(open_kmers):
                yield rows_of([open_key], np.array([open_n]), np.array([len(open_kmers)]), open_kmers[:1], open_kmers[-1:])

        for batch in batches:
            for rows in slices(batch):
                column = rows.column(key)
                field = column.type
                number = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                group = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1
                firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                keys = column.take(pa.array(firsts)).to_pylist()
                bases, offsets = codes(rows.column("seq"))
                each = np.repeat(group, np.diff(offsets))
                found = [(each[at] << 2 * k) | values for at, values in code_kmers(bases, offsets, k)]
                both, times = summed(np.concatenate(found) if found else np.zeros(0, np.int64))
                cuts = np.append(np.searchsorted(both, np.arange(len(keys)) << 2 * k), len(both))
                kmers = both & ((1 << 2 * k) - 1)
                upto = np.append(0, np.cumsum(times))
                begin = 0
                if open_kmers is not None and open_key == keys[0]:
                    open_n += int(upto[cuts[1]])
                    open_kmers = np.union1d(open_kmers, kmers[: cuts[1]])
                    begin = 1
                if begin < len(keys):
                    yield from last()
                    done = np.arange(begin, len(keys) - 1)
                    done = done[cuts[done + 1] > cuts[done]]
                    if len(done):
                        a, b = cuts[done], cuts[done + 1]
                        yield rows_of([keys[i] for i in done], upto[b] - upto[a], b - a, kmers[a], kmers[b - 1])
                    a = cuts[-2]
                    open_key, open_n, open_kmers = keys[-1], int(upto[-1] - upto[a]), kmers[a:].copy()
        yield from last()

    together = frame.select(key, "seq").repartition(key).sortWithinPartitions(key)
    return together.mapInArrow(run, f"{key} {kind}, n bigint, n_distinct bigint, least string, greatest string")


class Sieve:
    """A test that passes all of some k-mers (or parts of them) and few others; made once, sent to each worker once."""

    def __init__(self, spark: SparkSession, numbers: np.ndarray):
        self.bits = max(10, min(30, (16 * len(numbers)).bit_length()))
        table = np.zeros(1 << self.bits, dtype=bool)
        table[self._places(np.asarray(numbers, dtype=np.int64))] = True
        self._table = spark.sparkContext.broadcast(np.packbits(table, bitorder="little"))

    def _places(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers.view(np.uint64) * np.uint64(_ODD) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        """Whether each number may be one of those sought."""
        place = self._places(numbers)
        return (self._table.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).view(bool)


def sieve(wanted: DataFrame, column: str, most: int = 4_000_000) -> Sieve | None:
    """A sieve of the values of a column; none where they are more than ``most``."""
    found = wanted.select(column).where(f"{column} is not null").distinct().limit(most + 1).toPandas()[column].to_numpy(dtype=np.int64)
    return Sieve(wanted.sparkSession, found) if len(found) <= most else None


def windows(frame: DataFrame, k: int, codes: Callable = letter_codes) -> DataFrame:
    """(n): how many windows free of N the sequences have, a row or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(len(values) for rows in by_size(batch) for _, values in code_kmers(*codes(rows.column("seq")), k))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return frame.select("seq").mapInArrow(run, "n bigint")


def strings(numbers: np.ndarray, k: int) -> pa.Array:
    """K-mers given by ``spread`` numbers, as text."""
    kmers = gathered(numbers, k)
    body = np.empty((len(kmers), k), np.uint8)
    letters = np.frombuffer(b"ACGT", np.uint8)
    for i in range(k):
        body[:, i] = letters[kmers >> 2 * (k - 1 - i) & 3]
    offsets = np.arange(0, (len(kmers) + 1) * k, k, dtype=np.int32)
    return pa.StringArray.from_buffers(len(kmers), pa.py_buffer(offsets), pa.py_buffer(body))
