"""K-mer extraction: a NumPy kernel over Arrow buffers, and the same in built-in SQL.

The kernel handles a whole batch of reads at once. The number of the k-mer at every position
comes from those of half the length (log k steps), for both strands; positions whose window
holds an N or runs over the end of a read are masked out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerspark.functions.sequences import canonical

DEFAULT_K = 19
_CODE = np.full(256, 255, dtype=np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i
_CODE[ord("N")] = 4
#: Windows whose numbers are made at once, and bytes of sequences whose codes are.
_WINDOWS, _BYTES = 1 << 19, 4 << 20


def check_k(k: int) -> None:
    """Counting needs an odd k below 32, so that no k-mer is its own reverse complement."""
    if not 1 <= k <= 31 or k % 2 == 0:
        raise ValueError(f"k must be odd and from 1 to 31, not {k}")


def _string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def _window_values(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and reverse-complement numbers of the window at each position."""
    forward, backward, width = codes.astype(np.int64), 3 - codes.astype(np.int64), 1
    for bit in bin(k)[3:]:
        n = len(forward) - width
        forward, backward = (forward[:n] << (2 * width)) | forward[width:], backward[:n] | (backward[width:] << (2 * width))
        width *= 2
        if bit == "1":
            single, pair = codes[width:].astype(np.int64), 3 - codes[width:].astype(np.int64)
            n = min(len(forward), len(single))
            forward, backward = (forward[:n] << 2) | single[:n], backward[:n] | (pair[:n] << (2 * width))
            width += 1
    return forward, backward


def letter_codes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of sequences as text: 0 to 3 for A, C, G, T and 4 for N."""
    body, offsets = _string_buffers(array)
    codes = _CODE[body]
    if (codes == 255).any():
        bad = chr(body[int(np.argmax(codes == 255))])
        raise ValueError(f"sequence holds {bad!r}; only A, C, G, T and N are allowed")
    return codes, offsets


def _any_within(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """Whether any of ``width`` flags from each of the first ``n`` positions is set."""
    reach, found = 1, flags
    while reach < width:
        step = min(reach, width - reach)
        found = found[: len(found) - step] | found[step:]
        reach += step
    return found[:n]


def code_kmers(codes: np.ndarray, offsets: np.ndarray, k: int, strand: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position among all codes, k-mer) of the windows free of N that stay in one sequence, some at a time."""
    starts = np.zeros(len(codes) + 1, dtype=bool)
    starts[offsets[1:-1]] = True
    for a in range(0, len(codes) - k + 1, _WINDOWS):
        part = codes[a : a + _WINDOWS + k - 1]
        n = len(part) - k + 1
        bad = _any_within(part == 4, k, n)
        if k > 1:
            bad = bad | _any_within(starts[a + 1 : a + len(part)], k - 1, n)
        good = np.flatnonzero(~bad)
        forward, backward = _window_values(part & 3, k)
        values = np.minimum(forward, backward) if strand else forward
        yield good + a, values[good]


def batch_kmers(array: pa.Array, k: int, strand: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, k-mer) of all windows free of N; canonical unless ``strand`` is false."""
    codes, offsets = letter_codes(array)
    found = list(code_kmers(codes, offsets, k, strand))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, values = (np.concatenate(c) for c in zip(*found))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at]
    return row, at - offsets[row], values


def sequence_kmers(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and canonical k-mers of one sequence."""
    _, positions, values = batch_kmers(pa.array([seq]), k)
    return positions, values


def _pieces(batch: pa.RecordBatch, most: int = 40_000) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, most):
        yield batch.slice(start, most)


def by_size(batch: pa.RecordBatch, column: str = "seq", most: int = _BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes in ``column``, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, base = 0, 0
    while start < batch.num_rows:
        end = max(int(np.searchsorted(upto, base + most, side="right")), start + 1)
        yield batch.slice(start, end - start)
        start, base = end, int(upto[end - 1])


def extract(reads: DataFrame, k: int = DEFAULT_K, keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """(*keys, pos, kmer): every canonical k-mer of every read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 8_000):
                row, position, values = batch_kmers(part.column("seq"), k)
                own = pa.array(row)
                columns = [part.column(c).take(own) for c in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(position.astype(np.int32)), pa.array(values)], names=[*keys, "pos", "kmer"])

    types = dict(reads.dtypes)
    return reads.select(*keys, "seq").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keys), "pos int", "kmer bigint"]))


def extract_sql(reads: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The same windows from built-in functions: (read_id, pos, kmer) with ``kmer`` a string."""
    positions = F.sequence(F.lit(1), F.length("seq") - (k - 1))
    windows = F.transform(positions, lambda i: F.struct((i - 1).alias("pos"), F.col("seq").substr(i, F.lit(k)).alias("s")))
    each = reads.where(F.length("seq") >= k).select("read_id", F.explode(windows).alias("w")).where(F.instr("w.s", "N") == 0)
    return each.select("read_id", F.col("w.pos").alias("pos"), canonical("w.s").alias("kmer"))
