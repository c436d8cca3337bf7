"""Packing documents into bins of a fixed capacity: best fit and bin completion.

A document longer than the capacity is cut into pieces of the capacity, each a bin of its
own, and one rest. Rests and whole documents are items; they are spread over cells by a
hash, ``CELL_ITEMS`` a cell on average, and each cell is packed on its own, so no item ever
meets more than its cell and nothing but lengths is shuffled.

A cell is first packed by best fit in decreasing order; that is the incumbent. Where it
uses more bins than the lower bound, bin completion searches for fewer: the largest item
left opens a bin, the undominated sets of further items that fit are tried in the order of
their waste, and a branch is given up where the waste so far exceeds what fewer bins than
the incumbent's would allow. A filling is dominated where an item left out could take the
place of one or several taken at no more than the room. Wherever the search stands, best
fit of what is left completes it, and replaces the incumbent if it is better. The search
ends after ``most_nodes`` fillings; the incumbent stands then.

Items go to cells by their row, not by their identifier, so that no identifier, or its lack,
makes a cell larger.

Defined results: a null length is 0. Items of length 0 are placed too. Each row is an item,
so rows that repeat an identifier, or have none, are packed as often as they come. Equal
items are interchangeable: which of them shares a bin is settled by identifier. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
CELL_ITEMS = 2048
MOST_NODES, NODE_STEPS = 400, 600
CELLS_A_TASK = 8


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indexes; ``sizes`` must decrease. Each item takes the least room it fits."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(rooms, (room - size, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins needed by volume, and by the items over half the capacity with what fits beside none of them."""
    if not sizes:
        return 0
    values = np.sort(np.array(sizes, dtype=np.int64))
    sums = np.concatenate([[0], np.cumsum(values)])
    half = int(np.searchsorted(values, capacity // 2, side="right"))  # items up to half the capacity
    best = max(-(-int(sums[-1]) // capacity), len(values) - half, 1)
    # for every least size k: the small items from k on need the room that the middle ones leave
    k = np.unique(values[:half])
    k = k[k > 0]
    if len(k):
        big = len(values) - np.searchsorted(values, capacity - k, side="right")
        middle = len(values) - half - big
        spare = middle * capacity - (sums[len(values) - big] - sums[half])
        small = sums[half] - sums[np.searchsorted(values, k)]
        best = max(best, int((len(values) - half + np.maximum(-(-(small - spare) // capacity), 0)).max()))
    return best


def _dominated(taken: list[int], left: list[int], room: int) -> bool:
    """Whether an item left out could replace taken ones (one or two) within the room."""
    for i, a in enumerate(taken):
        at = bisect_right(left, a)
        if at < len(left) and left[at] <= a + room:
            return True
        for b in taken[i + 1 :]:
            at = bisect_left(left, a + b)
            if at < len(left) and left[at] <= a + b + room:
                return True
    return False


def fillings(largest: int, others: list[int], capacity: int, most_waste: int, budget: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, sizes taken) of undominated fillings beside ``largest``, least waste first.

    ``others`` increases. Sizes are tried from the largest that fits; a branch ends where
    even all smaller items cannot bring the waste down to ``most_waste``. ``budget`` counts
    down the steps.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    prefix = np.concatenate([[0], np.cumsum(others)]).tolist()

    def extend(room: int, upto: int, taken: list[int]) -> None:
        budget[0] -= 1
        if budget[0] < 0:
            return
        fits = min(bisect_right(others, room), upto)
        if room <= most_waste:
            left = others.copy()
            for t in taken:
                left.pop(bisect_left(left, t))
            if not _dominated(taken, left, room):
                found.append((room, tuple(taken)))
        at = fits
        while at > 0 and budget[0] >= 0:
            if room - prefix[at] > most_waste:
                return  # too little is left to fill the bin
            size = others[at - 1]
            extend(room - size, at - 1, [*taken, size])
            at = bisect_left(others, size, 0, at)  # an equal size would repeat the branch

    extend(capacity - largest, len(others), [])
    return sorted(set(found))


def complete_bins(sizes: list[int], capacity: int, most_nodes: int = MOST_NODES, node_steps: int = NODE_STEPS) -> list[list[int]]:
    """Bins of item indexes by branch and bound; ``sizes`` must decrease."""
    bins = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(bins) <= bound or not sizes:
        return bins
    total = sum(sizes)
    best: list[list[int]] = [[sizes[i] for i in b] for b in bins]
    nodes = [most_nodes]

    def search(left: list[int], done: list[list[int]], waste: int) -> bool:
        """Whether to stop: the bound is reached, or the budget spent. ``left`` increases."""
        nonlocal best
        if not left:
            if len(done) < len(best):
                best = list(done)
            return len(best) <= bound
        nodes[0] -= 1
        if nodes[0] < 0:
            return True
        greedy = best_fit(left[::-1], capacity)
        if len(done) + len(greedy) < len(best):
            down = left[::-1]
            best = [*done, *([down[i] for i in b] for b in greedy)]
            if len(best) <= bound:
                return True
        largest, rest = left[-1], left[:-1]
        most = (len(best) - 1) * capacity - total - waste
        if most < 0:
            return False
        # an eighth of the slack first, so that tight fillings are found among many items
        for limit in dict.fromkeys((min(most, capacity) // 8, min(most, capacity))):
            for room, taken in fillings(largest, rest, capacity, limit, [node_steps]):
                if waste + room > (len(best) - 1) * capacity - total:
                    break
                after = rest.copy()
                for t in taken:
                    after.pop(bisect_left(after, t))
                if search(after, [*done, [largest, *taken]], waste + room):
                    return True
                if nodes[0] < 0:
                    return True
        return False

    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(max(depth, 4 * len(sizes) + 1000))
    try:
        search(sizes[::-1], [], 0)
    finally:
        sys.setrecursionlimit(depth)
    if len(best) >= len(bins):
        return bins
    stock: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stock.setdefault(sizes[i], []).append(i)
    return [[stock[s].pop() for s in b] for b in best]


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, cell_items: int = CELL_ITEMS, most_nodes: int = MOST_NODES, node_steps: int = NODE_STEPS) -> DataFrame:
    """(bin, slot, doc_id, start, length): every piece of every row, in one bin each.

    ``bin`` is unique; pieces of a bin are numbered by ``slot`` and never exceed the capacity
    together. ``length`` defaults to the characters of ``text``.
    """
    length = F.length("text") if length is None else length
    items = docs.select(F.col("doc_id").cast("bigint"), F.greatest(F.coalesce(length.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    cells = max(1, -(-docs.count() // cell_items))
    # a row's number is its place in its partition, so a repeated task gives it the same cell
    placed = items.withColumn("cell", F.pmod(F.xxhash64(F.lit(29), "doc_id", F.monotonically_increasing_id()), F.lit(cells)))
    # a number of tasks, as cells are work, not bytes: small tables must not end up in one task
    grouped = placed.repartition(-(-cells // CELLS_A_TASK), "cell").sortWithinPartitions("cell", F.desc("size"), "doc_id")

    def solve(cell: int, ids: list, sizes: list[int]) -> pa.RecordBatch:
        out: list[tuple] = []
        items, used = [], 0

        def add(slots: list[tuple]) -> None:
            nonlocal used
            # a bin's number: the cell in the high bits
            number = (cell << 32) | used
            used += 1
            out.extend((number, slot, *piece) for slot, piece in enumerate(slots))

        for doc, size in zip(ids, sizes):
            start = 0
            while size - start > capacity:
                add([(doc, start, capacity)])
                start += capacity
            items.append((size - start, doc, start))
        items.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0, x[2]))
        for b in complete_bins([x[0] for x in items], capacity, most_nodes, node_steps):
            add([(items[i][1], items[i][2], items[i][0]) for i in b])
        columns = list(zip(*out)) or [()] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bin", "slot", "doc_id", "start", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, sizes = None, [], []
        for batch in batches:
            for cell, doc, size in zip(batch.column("cell").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("size").to_pylist()):
                if cell != current and current is not None:
                    yield solve(current, ids, sizes)
                    ids, sizes = [], []
                current = cell
                ids.append(doc)
                sizes.append(size)
        if current is not None:
            yield solve(current, ids, sizes)

    return grouped.select("cell", "doc_id", "size").mapInArrow(run, "bin bigint, slot int, doc_id bigint, start bigint, length bigint")
