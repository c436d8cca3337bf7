"""Exact-verified set-similarity self-join of documents on word n-gram Jaccard.

A document's set holds the hashes of its distinct runs of ``n`` lower-cased words (fewer
words make one run). Documents with the same set are one *node*, so exact copies cost one
node whatever their number. The result is a row for each document: the class it belongs to
(documents linked by pairs, directly or through others) and its number of links.

1. Tokens that many documents hold are found and put last in the global token order; the
   others stand in the order of their hash. The table of frequent tokens is bounded: a
   token must be in at least 1/5000 of the documents to be in it.
2. Tokens that a single node holds link nothing. Each node sends its rare tokens (32 bits of
   each, to tasks by the others), and gets back those that another node holds too; frequent
   ones count as such. A node whose tokens so shared are fewer than any partner must have in
   common with it has none. Every other node posts the prefix of its shared tokens that the
   threshold demands, so no pair is missed: if a set of ``size`` tokens leaves ``left`` =
   ceil(threshold * size) - 1 shared ones unposted, two sets at the threshold meet in at
   least the overlap required less the greater ``left``, and pairs that meet less often are
   no candidates. Tokens and nodes are compared by 48 bits; nothing else is approximate.
   Sets over ``SHORT`` tokens that agree in one of ``BANDS`` bands of least tokens (rare ones,
   unless most of the set is frequent) are joined beforehand: the index then skips pairs
   inside such a group, which step 4 verifies whole, so that its size enters the index
   lists' result no more than once a node.
3. Index lists (the postings of one token) are sorted by set size and cut into blocks. A
   block pair is skipped where its sizes differ too much for the threshold, or where the
   positions in it leave too few tokens for the overlap required. Lists of more than
   ``LIST_SPLIT`` documents are cut by a hash of the node, and each pair of cuts is a list
   of its own, so that no task meets a hot token's whole list with itself.
4. Candidates of two short sets are verified one by one, as their sets are small. The others
   are joined into components, each of which is verified with whole sets: inside one, a
   set's overlaps with all others are derived from those of a highly similar set just
   computed, so that only the lists of the tokens in which the two differ are read.
   Components over ``BLOCK_NODES`` are verified by pairs of blocks. What leaves a group is
   not its pairs but its nodes: how many links each has, and the least node it is joined to.

Defined results: a null or empty text, or one without a word, has no set and no partner; it
is a class of its own. A null ``doc_id`` stays null; the class of such a row is the least
identifier of those it is linked to, null if there is none. Rows that repeat a ``doc_id``
are rows of their own, each with the class and links of its text. Ties do not matter, as
all pairs count. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kmerspark.llm.text import U64, gram_hashes, mix, slices, span_hashes, string_buffers, trimmed, word_spans
from kmerspark.session import checkpointed

NGRAM = 3
#: The valley between edited copies and documents that merely share a passage.
THRESHOLD = 0.4
SHORT = 80
#: Bands of least rare tokens, and tokens a band, by which sets are joined before the index is read.
BANDS, BAND_TOKENS = 6, 3
BLOCK_NODES = 8192
LIST_BLOCK = 256
FREQUENT_SHARE = 5000
FREQUENT_LEAST = 50
TASK_EDGES = 500_000
TASK_POSTINGS = 250_000
#: Bytes of text whose tokens one task compares, and tokens of the rows that are sent together.
TASK_TEXT = 16_000_000
CHUNK_TOKENS = 1_000_000
#: The number that stands before the frequent tokens in the order; rare ones have that of their task.
LAST = 65_535
#: Pairs of a task that are held at once.
HELD_PAIRS = 300_000
LIST_SPLIT = 50_000
#: Up to so many nodes, those in components are known to the scan by a Bloom filter of 16 MB.
BLOOM_MEMBERS = 8_000_000
#: Up to so many copies, the rows to drop (or the groups of sets) are broadcast instead of shuffling the documents.
COPIES_BROADCAST = 1_000_000
#: Up to so many members of components, the map from a set to its groups is broadcast.
MEMBERS_BROADCAST = 4_000_000


def text_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text that has a word."""
    data, offsets = string_buffers(pc.utf8_lower(texts))
    for a, b in slices(offsets):
        base = int(offsets[a])
        piece = data[base : int(offsets[b])]
        starts, ends = word_spans(piece)
        # words never cross texts: cut the spans that do
        inner = offsets[a + 1 : b] - base
        at = np.searchsorted(starts, inner, side="right") - 1
        cut = np.unique(inner[(at >= 0) & (starts[np.maximum(at, 0)] < inner) & (ends[np.maximum(at, 0)] > inner)]) if len(starts) else inner[:0]
        if len(cut):
            starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
        words = span_hashes(piece, starts, ends)
        first = np.searchsorted(starts, offsets[a : b + 1] - base)
        for row in range(a, b):
            own = words[first[row - a] : first[row - a + 1]]
            if len(own):
                yield row, np.unique(gram_hashes(own, min(n, len(own))))


def pack_tokens(tokens: np.ndarray) -> bytes:
    """The high 48 bits of each token: distinct within a group but for a chance of about 1e-3 in its millions."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpack_tokens(data: bytes) -> np.ndarray:
    """Tokens with their low 16 bits zero, so that packing them again changes nothing."""
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, 2:] = six
    return out.view("<u8").ravel().astype(U64)


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit key of a whole set."""
    with np.errstate(over="ignore"):
        key = mix(np.array([np.sum(mix(tokens + U64(0x2545F4914F6CDD1D))) + U64(len(tokens))], dtype=U64))
    return int(key.view(np.int64)[0])


def frequent_tokens(docs: DataFrame, n: int, share: int = FREQUENT_SHARE, least: int = FREQUENT_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the tokens in at least max(least, rows / share) documents, and their counts.

    Counts leave out tokens seen fewer than three times in ten thousand texts of a task;
    this only moves a token's place in the order, never the result. At most the mean number
    of tokens of a text times ``share`` can qualify.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 3
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])

        for batch in batches:
            for _, tokens in text_sets(batch.column(0), n):
                held.append(tokens)
                size += len(tokens)
                if len(held) >= 10_000 or size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    # the number of rows comes from the file footers, or a narrow scan
    rows = docs.count()
    bound = max(least, rows // share)
    counted = docs.select("text").mapInArrow(trimmed(run), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= bound).toPandas()
    tokens, counts = found["token"].to_numpy(dtype=np.int64).view(U64), found["n"].to_numpy(dtype=np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


class _Frequent:
    """Membership in the frequent tokens, with a bitmap in front of the binary search."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(tokens >> U64(44)).astype(np.int64)] = True

    def mask(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), dtype=bool)
        if len(self.tokens):
            maybe = np.flatnonzero(self.seen[(tokens >> U64(44)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
                out[maybe] = self.tokens[at] == tokens[maybe]
        return out

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Where each of some frequent tokens stands among them."""
        return np.searchsorted(self.tokens, tokens)


def frequent_names(places: np.ndarray) -> np.ndarray:
    """What frequent tokens are called in the index; these stand behind all rare ones."""
    return U64(LAST) << U64(48) | places.astype(U64) << U64(16)


def required_overlap(size_a, size_b, threshold: float):
    """Least overlap of two sets that reaches the threshold."""
    return np.ceil(np.round(threshold / (1 + threshold) * (size_a + size_b), 9)).astype(np.int64)


def least_own(size, threshold: float):
    """Least overlap of a set with any partner."""
    return np.ceil(np.round(threshold * np.asarray(size), 9)).astype(np.int64)


def least_met(size_a, size_b, threshold: float) -> np.ndarray:
    """How many posted tokens two sets at the threshold have in common at least.

    Of their common tokens, which stand in one order, a set leaves no more unposted than it
    leaves of all; those before are posted by both.
    """
    left = np.maximum(least_own(size_a, threshold), least_own(size_b, threshold)) - 1
    return np.maximum(required_overlap(size_a, size_b, threshold) - left, 1).astype(np.int32)


def bands_of(tokens: np.ndarray) -> list[int | None]:
    """A key for each band: the least of its share of the tokens in each of its places; null where a place is empty."""
    count = BANDS * BAND_TOKENS
    places, first = np.unique(mix(tokens) % U64(count), return_index=True)
    least = np.zeros(count, dtype=U64)
    filled = np.zeros(count, dtype=bool)
    least[places.astype(np.int64)], filled[places.astype(np.int64)] = tokens[first], True
    with np.errstate(over="ignore"):
        key = np.zeros(BANDS, dtype=U64)
        for i in range(BAND_TOKENS):
            key = mix(key * U64(31) + least[i::BAND_TOKENS] + np.arange(BANDS, dtype=U64))
    whole = filled.reshape(BANDS, BAND_TOKENS).all(1)
    return [k if good else None for k, good in zip(key.view(np.int64).tolist(), whole.tolist())]


def _planes(column: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, those of one place together."""
    return column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _run_blob(nodes: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> bytes:
    """Tokens (32 bits) in runs, one of each node (48 bits)."""
    return np.uint32(len(nodes)).tobytes() + _planes(nodes, 6) + _planes(counts, 4) + tokens.astype("<u4").tobytes()


def _run_unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    runs = int(np.frombuffer(blob, "<u4", 1)[0])
    wide = np.zeros((runs, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * runs, 4).reshape(6, runs).T
    counts = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * runs, 4 + 6 * runs).reshape(4, runs).T).view("<u4").ravel()
    return wide.view("<u8").ravel(), counts.astype(np.int64), np.frombuffer(blob, "<u4", -1, 4 + 10 * runs)


#: The node key by which runs name a set.
NODE_MASK = U64(2**48 - 1)
_SENT = "part int, bucket int, chunk bigint, data binary"


def _sent_tokens(docs: DataFrame, frequent: np.ndarray, n: int, buckets: int) -> DataFrame:
    """(part, bucket, chunk, data): runs of rare tokens by bucket, and at bucket -1 what else is known of the chunk's rows."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = _Frequent(shared.value)
        chunk = TaskContext.get().partitionId() << 32

        def send(ids: pa.Array, found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            keys, sizes, whole, common, bands = ([None] * len(ids) for _ in range(5))
            nodes, counts, rare = [], [], []
            seen: set[int] = set()
            for row, tokens in found:
                keys[row], sizes[row] = key, _ = set_key(tokens), len(tokens)
                if key in seen:
                    continue
                seen.add(key)
                mask = often.mask(tokens)
                few = tokens[~mask]
                common[row] = often.places(tokens[mask]).astype("<u4").tobytes()
                if len(tokens) <= SHORT:
                    whole[row] = pack_tokens(tokens)
                else:
                    # of a set of frequent tokens, all count: it is one of a large group of near copies
                    bands[row] = bands_of(tokens if 2 * len(few) < len(tokens) else few)
                nodes.append(key)
                counts.append(len(few))
                rare.append(few)
            about = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids, pa.array(sizes, pa.int32()), pa.array(whole, pa.binary()), pa.array(common, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["node", "doc_id", "size", "whole", "common", "bands"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, about.schema) as writer:
                writer.write_batch(about)
            parts, blobs = [-1], [sink.getvalue().to_pybytes()]
            if sum(counts):
                tokens = np.concatenate(rare)
                # the tokens of a set are in order, and so are their buckets
                bucket = ((tokens >> U64(32)) * U64(buckets) >> U64(32)).astype(np.uint16)
                order = np.argsort(bucket, kind="stable")
                bucket, tokens, own = bucket[order], tokens[order] & U64(2**32 - 1), np.repeat(np.arange(len(nodes)), counts)[order]
                runs = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1])))
                length = np.diff(np.append(runs, len(tokens)))
                of = np.array(nodes, dtype=np.int64).view(U64)[own[runs]] & NODE_MASK
                first = np.flatnonzero(np.append(True, bucket[runs][1:] != bucket[runs][:-1]))
                for a, b in zip(first.tolist(), np.append(first[1:], len(runs)).tolist()):
                    parts.append(int(bucket[runs[a]]))
                    blobs.append(_run_blob(of[a:b], length[a:b], tokens[runs[a] : runs[b - 1] + length[b - 1]]))
            return pa.RecordBatch.from_arrays([pa.array([p if p >= 0 else chunk % buckets for p in parts], pa.int32()), pa.array(parts, pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "bucket", "chunk", "data"])

        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                piece = batch.slice(start, 4000)
                ids, found, size, low = piece.column("doc_id"), [], 0, 0
                for row, tokens in text_sets(piece.column("text"), n):
                    if size > CHUNK_TOKENS:
                        yield send(ids.slice(low, row - low), found)
                        chunk, found, size, low = chunk + 1, [], 0, row
                    found.append((row - low, tokens))
                    size += len(tokens)
                yield send(ids.slice(low), found)
                chunk += 1

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(trimmed(run), _SENT)


def _tokens_held_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the runs of tokens, those tokens that two nodes hold; all else as it comes."""
    about, blobs = [], []
    for batch in batches:
        for bucket, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "data"))):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], names=["part", "bucket", "chunk", "data"])
            else:
                about.append((bucket, chunk))
                blobs.append(data)
    if not blobs:
        return
    nodes, counts, tokens = zip(*map(_run_unblob, blobs))
    blobs.clear()
    key = np.concatenate([t.astype(U64) | U64(b) << U64(32) for (b, _), t in zip(about, tokens)])
    node = np.concatenate([np.repeat(v, c) for v, c in zip(nodes, counts)])
    order = np.argsort(key)
    key, node = key[order], node[order]
    same = key[1:] == key[:-1]
    group = np.append(0, np.cumsum(~same))
    twice = np.zeros(group[-1] + 1, dtype=bool)
    twice[group[1:][same & (node[1:] != node[:-1])]] = True
    held = np.empty(len(key), dtype=bool)
    held[order] = twice[group]
    del key, node, order, same, group, twice
    at = 0
    for (bucket, chunk), v, c, t in zip(about, nodes, counts, tokens):
        good = held[at : at + len(t)]
        at += len(t)
        left = np.add.reduceat(good, np.cumsum(c) - c, dtype=np.int64)
        data = _run_blob(v[left > 0], left[left > 0], t[good])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], names=["part", "bucket", "chunk", "data"])


def _chunk_rows(about: pa.RecordBatch, answers: list[tuple[int, bytes]], threshold: float) -> pa.RecordBatch:
    """The rows of a chunk, with the prefixes of their shared tokens."""
    size = pc.fill_null(about.column("size"), 0).to_numpy().astype(np.int64)
    common = [(i, np.frombuffer(c, "<u4")) for i, c in enumerate(about.column("common").to_pylist()) if c is not None]
    sender = np.array([i for i, _ in common], dtype=np.int64)
    rows, names = [np.repeat(sender, [len(c) for _, c in common])], [frequent_names(np.concatenate([c for _, c in common]))] if common else [np.zeros(0, U64)]
    known = pc.fill_null(about.column("node"), 0).to_numpy()[sender].view(U64) & NODE_MASK
    by = np.argsort(known)
    for bucket, data in answers:
        node, count, tokens = _run_unblob(data)
        if len(node):
            at = by[np.minimum(np.searchsorted(known[by], node), len(by) - 1)]
            if (known[at] != node).any():
                raise RuntimeError("a chunk of documents was read twice with different rows")
            rows.append(np.repeat(sender[at], count))
            names.append(U64(bucket) << U64(48) | tokens.astype(U64) << U64(16))
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    name = name[order]
    held = np.bincount(row, minlength=len(size)).astype(np.int64)
    posted = np.where(held > 0, np.maximum(held - least_own(size, threshold) + 1, 0), 0)
    start = np.cumsum(held) - held
    heads = [pack_tokens(name[a : a + p]) if p else None for a, p in zip(start.tolist(), posted.tolist())]
    return pa.RecordBatch.from_arrays([about.column("node"), about.column("doc_id"), about.column("size"), *(pa.array(c.astype(np.int32)) for c in (held, posted)), pa.array(heads, pa.binary()), about.column("whole"), about.column("bands")], names=["node", "doc_id", "size", "held", "posted", "tokens", "whole", "bands"])


def row_sets(docs: DataFrame, frequent: np.ndarray, n: int, threshold: float) -> DataFrame:
    """(node, doc_id, size, held, posted, tokens, whole, bands): one row per row of ``docs``.

    ``node`` is null for a text without a set. ``held`` counts the tokens that other nodes
    hold too, ``tokens`` is the ``posted`` head of these, in the order of the index; of a
    set of at most ``SHORT`` tokens, ``whole`` has all. Of the copies of a set, not every one
    has more than its node and size.
    """
    amount = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(1, -(-amount // TASK_TEXT)), LAST)
    answers = _sent_tokens(docs, frequent, n, buckets).repartitionById(buckets, F.col("part")).mapInArrow(trimmed(_tokens_held_twice), _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, about = None, [], None
        for batch in batches:
            for bucket, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "data"))):
                if chunk != current:
                    if about is not None:
                        yield _chunk_rows(about, held, threshold)
                    current, held, about = chunk, [], None
                if bucket < 0:
                    about = pa.ipc.open_stream(data).read_next_batch()
                else:
                    held.append((bucket, data))
        if about is not None:
            yield _chunk_rows(about, held, threshold)

    grouped = answers.drop("part").repartition("chunk").sortWithinPartitions("chunk")
    return grouped.mapInArrow(trimmed(run), "node bigint, doc_id bigint, size int, held int, posted int, tokens binary, whole binary, bands array<bigint>")


def list_pairs(size: np.ndarray, position: np.ndarray, threshold: float, block: int = LIST_BLOCK, held: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one token's list (sorted by size) that pass the size and position filters.

    Two sets that share the token share at most the lesser number of tokens before it and
    the lesser number from it on. Blocks are skipped as wholes: by size, as the list is
    sorted, and by position, where that bound is below the least overlap required. ``held``:
    how many tokens of each set count, if not all.
    """
    rest = (size if held is None else held) - position
    starts = np.arange(0, len(size), block)
    low, high = size[starts], size[np.minimum(starts + block, len(size)) - 1]
    most, before = np.maximum.reduceat(rest, starts), np.maximum.reduceat(position, starts)
    for i, a in enumerate(starts):
        reach = np.searchsorted(low, high[i] / threshold + 1e-9, side="right")
        for j in range(i, reach):
            if min(most[i], most[j]) + min(before[i], before[j]) < required_overlap(low[i], low[j], threshold):
                continue
            b = starts[j]
            x, y = np.arange(a, min(a + block, len(size))), np.arange(b, min(b + block, len(size)))
            need = required_overlap(size[x][:, None], size[y][None, :], threshold)
            good = np.minimum(rest[x][:, None], rest[y][None, :]) + np.minimum(position[x][:, None], position[y][None, :]) >= need
            good &= size[y][None, :] * threshold <= size[x][:, None] + 1e-9
            if i == j:
                good &= x[:, None] < y[None, :]
            p, q = np.nonzero(good)
            if len(p):
                yield x[p], y[q]


def band_groups(rows: DataFrame) -> DataFrame:
    """(node, comp): the sets that share a band, directly or through others, by the least of them."""
    each = rows.where("bands is not null").select("node", F.explode("bands").alias("band")).where("band is not null")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a band's nodes come in order, the least first
        leader = band = None
        for batch in batches:
            bands, ids = batch.column("band").to_numpy(), batch.column("node").to_numpy()
            if not len(ids):
                continue
            first = np.append(bands[0] != band, bands[1:] != bands[:-1])
            at = np.maximum.accumulate(np.where(first, np.arange(len(ids)), -1))
            leaders = np.where(at >= 0, ids[at], leader if leader is not None else 0)
            band, leader = bands[-1], leaders[-1]
            other = ids != leaders
            yield pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(leaders[other])], names=["a", "b"])

    joined = each.repartition("band").sortWithinPartitions("band", "node").mapInArrow(trimmed(stars), "a bigint, b bigint")
    return connected_components(joined)


#: Columns of a posting: token (its high 48 bits), node, comp xor node, size, held, block, position.
POSTING = ("6", "<i8", "<i8", "<i4", "<i4", "<u2", "<u2")
#: Columns of a pair: a, b, what it needs, how often it was met.
PAIR = ("<i8", "<i8", "<i4", "<u2")


def _blobs(name: str, key: np.ndarray, columns: list[np.ndarray], kinds: tuple[str, ...]) -> pa.RecordBatch:
    """(name, data): the rows of each key (they stand together), column after column in one blob."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    stops = np.append(first[1:], len(key))
    # bytes of one place stand together, so that those that are mostly zero compress away
    packed = []
    for kind, column in zip(kinds, columns):
        if kind == "6":
            packed.append(np.frombuffer(pack_tokens(column), np.uint8).reshape(-1, 6))
        else:
            packed.append(np.ascontiguousarray(column.astype(kind)).view(np.uint8).reshape(len(key), -1))
    data = [b"".join(c[a:b].T.tobytes() for c in packed) for a, b in zip(first.tolist(), stops.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(key[first].astype(np.int32)), pa.array(data, pa.binary())], names=[name, "data"])


def _unblob(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of many blobs, one after another; a six-byte one as numbers."""
    widths = [6 if kind == "6" else np.dtype(kind).itemsize for kind in kinds]
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        rows, at = len(blob) // sum(widths), 0
        for column, kind, width in zip(parts, kinds, widths):
            piece = np.frombuffer(blob, np.uint8, rows * width, at).reshape(width, rows).T.tobytes()
            column.append(unpack_tokens(piece) if kind == "6" else np.frombuffer(piece, kind))
            at += rows * width
    return [np.concatenate(column) for column in parts]


def _postings(rows: DataFrame, tasks: int, long_lists: dict[int, int]) -> DataFrame:
    """(task, data): the heads of distinct sets by the task of their tokens, as blobs of ``POSTING``.

    A token of ``long_lists`` (token: cuts) has a list for each pair of its cuts, under a name
    of its own; ``block`` is the cut that a node is in. Copies of a set are posted once a
    task; where they are read, they fold into one. A posting costs the same bytes however
    many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = np.array(sorted(long_lists), dtype=np.int64).view(U64)
        cuts = np.array([long_lists[t] for t in split.view(np.int64).tolist()], dtype=np.int64)
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                fresh = []
                for i, key in enumerate(part.column("node").to_pylist()):
                    if key is not None and key not in seen:
                        seen.add(key)
                        fresh.append(i)
                if len(seen) > 2_000_000:
                    seen.clear()
                if not fresh:
                    continue
                part = part.take(pa.array(fresh))
                posted = part.column("posted").to_numpy().astype(np.int64)
                token = np.concatenate([unpack_tokens(t[: 6 * int(p)]) for t, p in zip(part.column("tokens").to_pylist(), posted)])
                row = np.repeat(np.arange(len(posted)), posted)
                position = np.arange(len(token)) - np.repeat(np.cumsum(posted) - posted, posted)
                node = part.column("node").to_numpy()
                block = np.zeros(len(token), dtype=np.int64)
                if len(split):
                    at = np.minimum(np.searchsorted(split, token), len(split) - 1)
                    long = split[at] == token
                    times = np.where(long, cuts[at], 1)
                    with np.errstate(over="ignore"):
                        own = np.where(long, (mix(node[row].view(U64)) % times.astype(U64)).astype(np.int64), 0)
                        again = np.repeat(np.arange(len(token)), times)
                        other = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                        low, high = np.minimum(own[again], other).astype(U64), np.maximum(own[again], other).astype(U64)
                        name = mix(token[again] + mix(low << U64(32) | high)) >> U64(16) << U64(16)
                    token = np.where(long[again], name, token[again])
                    row, position, block = row[again], position[again], own[again]
                task = (mix(token) % U64(tasks)).astype(np.int64)
                order = np.argsort(task, kind="stable")
                task, row = task[order], row[order]
                comp = part.column("comp").to_numpy()
                columns = [*(part.column(c).to_numpy()[row] for c in ("size", "held")), block[order], np.minimum(position[order], 65535)]
                yield _blobs("task", task, [token[order], node[row], comp[row] ^ node[row], *columns], POSTING)

    return rows.where("posted > 0").select("node", "size", "held", "posted", "tokens", "comp").mapInArrow(trimmed(run), "task int, data binary")


def with_groups(rows: DataFrame, groups: DataFrame, most: int = COPIES_BROADCAST) -> DataFrame:
    """``rows`` with the group of each node in ``comp``, the node itself where it has none.

    A join, not a Python function: the next step is one, and each keeps workers of its own.
    """
    named = groups.toDF("_node", "_comp")
    named = F.broadcast(named) if groups.count() <= most else named
    joined = rows.where("node is not null").join(named, F.col("node") == F.col("_node"), "left")
    return joined.withColumn("comp", F.coalesce("_comp", "node")).drop("_node", "_comp")


def candidates(rows: DataFrame, threshold: float, long_lists: dict[int, int] | None = None) -> DataFrame:
    """(a, b, small) with a < b: all node pairs that meet in enough posted tokens; small: both are short.

    Pairs of one ``comp`` are left out, as that is verified whole. Positions past 65,535 count as that, which only weakens their filter.
    """
    # few large tasks: a pair shares many tokens, and those of one task are counted in one row
    tasks = max(1, -(-int(rows.agg(F.sum("posted")).first()[0] or 0) // TASK_POSTINGS))
    buckets = 4 * tasks
    lists = _postings(rows, tasks, long_lists or {}).repartitionById(tasks, F.col("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_unblob(batch.column("data").to_pylist(), POSTING))
        if not held:
            return
        token, node, comp, size, own, block, position = (np.concatenate(c) for c in zip(*held))
        comp, position = comp ^ node, position.astype(np.int64)
        held.clear()
        order = np.lexsort((node, size, token))
        # copies of a set that several tasks posted
        once = np.append(True, (token[order][1:] != token[order][:-1]) | (node[order][1:] != node[order][:-1]))
        order = order[once]
        token, position, node, size, own, block, comp = (c[order] for c in (token, position, node, size, own, block, comp))
        edges = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        lengths = np.diff(np.append(edges, len(token)))
        # a list of two cuts gives the pairs across them; those inside a cut have their own
        crossing = np.maximum.reduceat(block, edges) != np.minimum.reduceat(block, edges)

        def pack(p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            """The pairs, each once with how often it is met here, by the bucket of the lesser node."""
            a, b = np.minimum(node[p], node[q]), np.maximum(node[p], node[q])
            bucket = (mix(a.view(U64)) % U64(buckets)).astype(np.int64)
            order = np.lexsort((b, a, bucket))
            a, b, p, q, bucket = (x[order] for x in (a, b, p, q, bucket))
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            counts = np.minimum(np.diff(np.append(first, len(a))), 65535)
            a, b, p, q, bucket = (x[first] for x in (a, b, p, q, bucket))
            need = least_met(size[p].astype(np.int64), size[q].astype(np.int64), threshold)
            fact = need * 2 + (np.maximum(size[p], size[q]) <= SHORT)
            return _blobs("bucket", bucket, [a, b, fact, counts], PAIR)

        left, right = [], []
        pairs = lengths == 2  # most lists that matter have two postings: all at once
        if pairs.any():
            i = edges[pairs]
            good = np.minimum(own[i] - position[i], own[i + 1] - position[i + 1]) + np.minimum(position[i], position[i + 1]) >= required_overlap(size[i], size[i + 1], threshold)
            good &= ((block[i] != block[i + 1]) | ~crossing[pairs]) & (comp[i] != comp[i + 1])
            left.append(i[good])
            right.append(i[good] + 1)
        pending = sum(map(len, left))
        for start, length, across in zip(edges[lengths > 2], lengths[lengths > 2], crossing[lengths > 2]):
            for p, q in list_pairs(size[start : start + length], position[start : start + length], threshold, held=own[start : start + length]):
                apart = comp[start + p] != comp[start + q]
                if across:
                    apart &= block[start + p] != block[start + q]
                p, q = p[apart], q[apart]
                left.append(p + start)
                right.append(q + start)
                pending += len(p)
                if pending > HELD_PAIRS:
                    yield pack(np.concatenate(left), np.concatenate(right))
                    left, right, pending = [], [], 0
        if pending:
            yield pack(np.concatenate(left), np.concatenate(right))

    found = lists.mapInArrow(trimmed(run), "bucket int, data binary").repartitionById(buckets, F.col("bucket"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = folded = 0

        def fold() -> list[np.ndarray]:
            a, b, fact, n = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((b, a))
            a, b, fact, n = a[order], b[order], fact[order], n[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            return [a[first], b[first], fact[first], np.add.reduceat(n.astype(np.int64), first)]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_unblob(batch.column("data").to_pylist(), PAIR))
            size += len(held[-1][0])
            if size > 2 * folded + HELD_PAIRS:
                held = [fold()]
                size = folded = len(held[0][0])
        if held:
            a, b, fact, total = fold()
            good = total >= fact // 2
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good]), pa.array(fact[good] % 2 == 1)], names=["a", "b", "small"])

    return found.mapInArrow(trimmed(count), "a bigint, b bigint, small boolean")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of a task's edges with the least node that those edges link it to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    rows = [(u, v) for u in list(root) if (v := find(u)) != u]
    for start in range(0, len(rows), 50_000):
        u, v = zip(*rows[start : start + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, most_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, comp): the least node of each node's component; ``edges`` has (a, b).

    Tasks of ``task_edges`` edges first reduce them to stars, again and again while that
    at least halves them; once one task holds them all, they are the components. What is
    too many for that is finished by alternating large-star and small-star steps, each a
    shuffle with a written table behind it, until a round changes nothing: a number of
    rounds that grows with the logarithm of the number of nodes.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    rows = edges.count()
    while True:
        tasks = max(1, -(-rows // task_edges))
        edges = checkpointed(edges.repartition(tasks, "v").mapInArrow(trimmed(_forest), "u bigint, v bigint"))
        if tasks == 1:
            return _labels(edges)
        left = edges.count()
        if 2 * left > rows:
            break
        rows = left
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return _labels(edges)


def _labels(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def group_hits(ids: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, threshold: float, short: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, later members j, Jaccard) of all pairs of the group that reach the threshold; i and j index ``ids``.

    Sets are taken by size and least token, so that near copies follow each other. The
    overlaps of a set with all others are those of the set before it, corrected by the
    lists of the tokens that only one of the two holds, wherever that reads less than the
    set's own lists. ``blocks``: the block of each set; where there are two, only pairs
    across them are returned. Pairs of sets of at most ``short`` tokens are left out.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((sizes, [int(s[0]) for s in sets]))
    sizes, blocks, sets = sizes[order], blocks[order], [sets[i] for i in order]
    tokens, local = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    rows = [local[bounds[i] : bounds[i + 1]] for i in range(len(sets))]
    listing = np.argsort(local, kind="stable")
    members = np.repeat(np.arange(len(sets)), sizes)[listing]
    heads = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(tokens)))])

    def totals(which: np.ndarray) -> np.ndarray:
        lengths = heads[which + 1] - heads[which]
        at = np.repeat(heads[which] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return np.bincount(members[at], minlength=len(sets))

    crossing = len(np.unique(blocks)) > 1
    before, answers = None, None
    for i, row in enumerate(rows):
        gone = np.setdiff1d(before, row, assume_unique=True) if before is not None else row
        fresh = np.setdiff1d(row, before, assume_unique=True) if before is not None else row
        if before is not None and len(gone) + len(fresh) < len(row):
            answers = answers + totals(fresh) - totals(gone)
        else:
            answers = totals(row)
        before = row
        later = answers[i + 1 :]
        union = sizes[i] + sizes[i + 1 :] - later
        jaccard = later / union
        hit = jaccard >= threshold - 1e-12
        hit &= np.maximum(sizes[i], sizes[i + 1 :]) > short
        if crossing:
            hit &= blocks[i + 1 :] != blocks[i]
        j = np.flatnonzero(hit)
        if len(j):
            yield int(order[i]), order[j + i + 1], jaccard[j]


def group_links(ids: np.ndarray, hits: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, links) of the linked nodes of a group; ``root`` is the least node joined to it."""
    # numbers in the order of the nodes, so that the least of a set of labels is its root
    by = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[by] = np.arange(len(ids))
    label, links = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    for i, others, _ in hits:
        links[i] += len(others)
        links[others] += 1
        own = np.unique(label[place[np.append(others, i)]])
        if len(own) > 1:
            seen = np.zeros(len(ids), dtype=bool)
            seen[own] = True
            label[seen[label]] = own[0]
    linked = np.flatnonzero(links)
    return ids[linked], ids[by][label[place[linked]]], links[linked]


class _Placing:
    """The groups of each member, in arrays sorted by node."""

    def __init__(self, members):
        order = np.argsort(members["node"].to_numpy(), kind="stable")
        self.node, self.group = (members[c].to_numpy(dtype=np.int64)[order] for c in ("node", "group"))
        self.block = members["block"].to_numpy(dtype=np.int32)[order]

    def groups(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into keys, group, block), a row for each group of each key."""
        low, high = np.searchsorted(self.node, keys), np.searchsorted(self.node, keys, side="right")
        times = high - low
        at = np.repeat(np.arange(len(keys)), times)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(keys) else np.zeros(0, np.int64)
        return at, self.group[rows], self.block[rows]


class _Bloom:
    """A Bloom filter of node keys (which are hashes already), 12 bits a key, 16 MB at most."""

    def __init__(self, keys: np.ndarray):
        self.bits = min(max(len(keys) * 12, 64).bit_length(), 27)
        self.table = np.zeros(1 << (self.bits - 3), dtype=np.uint8)
        for cell in self._cells(keys):
            np.bitwise_or.at(self.table, cell >> 3, (128 >> (cell & 7)).astype(np.uint8))

    def _cells(self, keys: np.ndarray) -> list[np.ndarray]:
        keys = keys.view(U64)
        return [(mix(keys * U64(2 * i + 1)) >> U64(64 - self.bits)).astype(np.int64) for i in (1, 2, 3)]

    def mask(self, keys: np.ndarray) -> np.ndarray:
        good = np.ones(len(keys), dtype=bool)
        for cell in self._cells(keys):
            good &= (self.table[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
        return good


def _verified(docs: DataFrame, components: DataFrame, n: int, threshold: float, block_nodes: int = BLOCK_NODES, broadcast_most: int = MEMBERS_BROADCAST) -> DataFrame:
    """(node, root, links): the links of nodes within components, a row for each group that a node is in."""
    spark = docs.sparkSession
    sizes = components.groupBy("comp").agg(F.ceil(F.count("*") / block_nodes).cast("int").alias("blocks"))
    placed = components.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # each pair of blocks is a group: (i, j) holds blocks i and j, (i, i) block i alone
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = checkpointed(placed.select("node", "comp", "block", other).select("node", "block", F.xxhash64("comp", F.least("block", "other"), F.greatest("block", "other")).alias("group")))
    rows = members.count()
    placing = _Placing(members.toPandas()) if rows <= broadcast_most else None
    # past that size only which sets are members is broadcast, as a Bloom filter of bounded size
    bloom = _Bloom(components.select("node").toPandas()["node"].to_numpy(dtype=np.int64)) if placing is None and rows <= BLOOM_MEMBERS else None
    shared = spark.sparkContext.broadcast(placing or bloom)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                found: dict[int, np.ndarray] = {}
                for _, tokens in text_sets(batch.column(0).slice(part, 1000), n):
                    found.setdefault(set_key(tokens), tokens)
                keys = np.fromiter(found, np.int64, len(found))
                values = list(found.values())
                if placing is not None:
                    at, group, block = shared.value.groups(keys)
                    columns = [pa.array(group), pa.array(keys[at]), pa.array(block)]
                else:
                    at = np.flatnonzero(shared.value.mask(keys)) if shared.value is not None else np.arange(len(keys))
                    columns = [pa.array(keys[at])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([pack_tokens(values[i]) for i in at], pa.binary())], names=[*names, "tokens"])

    names = ["group", "node", "block"] if placing is not None else ["node"]
    whole = docs.select("text").mapInArrow(trimmed(sets), ", ".join([*({"group": "group bigint", "node": "node bigint", "block": "block int"}[c] for c in names), "tokens binary"]))
    if placing is None:
        whole = whole.join(members, "node")
    grouped = whole.repartition("group").sortWithinPartitions("group", "node").select("group", "node", "block", "tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        current = None

        def emit() -> pa.RecordBatch:
            ids = np.fromiter(held, np.int64, len(held))
            found = group_links(ids, group_hits(ids, [v[1] for v in held.values()], np.array([v[0] for v in held.values()]), threshold, SHORT))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root", "links"])

        for batch in batches:
            for group, node, block, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if group != current and held:
                    yield emit()
                    held.clear()
                current = group
                if node not in held:
                    held[node] = (block, unpack_tokens(tokens.as_py()))
        if held:
            yield emit()

    return grouped.mapInArrow(trimmed(verify), "node bigint, root bigint, links bigint")


def _verified_small(rows: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) from the pairs of short sets, each set brought to each of its pairs."""
    # copies fold in each task before the shuffle
    short = rows.where(F.col("size") <= SHORT).groupBy("node").agg(F.first("whole", ignorenulls=True).alias("tokens"))
    both = pairs.join(short.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(short.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                own, other = unpack_tokens(x), unpack_tokens(y)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                good[i] = shared / (len(own) + len(other) - shared) >= threshold - 1e-12
            a, b = (batch.column(c).to_numpy()[good] for c in ("a", "b"))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            i, j = at[: len(a)], at[len(a) :]
            found = group_links(ids, ((int(x), np.array([y]), None) for x, y in zip(i, j)))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["node", "root", "links"])

    return both.select("a", "b", "x", "y").mapInArrow(trimmed(run), "node bigint, root bigint, links bigint")


def _linked(docs: DataFrame, n: int, threshold: float, list_split: int = LIST_SPLIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (node, doc_id), the nodes (node, least), and the links (node, comp, links) of those that have any."""
    tokens, counts = frequent_tokens(docs, n)
    rows = checkpointed(row_sets(docs, tokens, n, threshold))
    long = counts > list_split
    names = frequent_names(np.flatnonzero(long))
    groups = checkpointed(band_groups(rows))
    posting = rows.where("posted > 0").select("node", "size", "held", "posted", "tokens")
    pairs = checkpointed(candidates(with_groups(posting, groups), threshold, dict(zip(names.view(np.int64).tolist(), (-(-counts[long] // list_split)).tolist()))))
    small = _verified_small(rows, pairs.where("small"), threshold)
    joined = pairs.where("not small").select("a", "b").unionByName(groups.select(F.col("node").alias("a"), F.col("comp").alias("b")))
    large = _verified(docs, checkpointed(connected_components(joined)), n, threshold)
    found = checkpointed(small.unionByName(large))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links")).join(components, "node")
    table = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    return rows.select("node", "doc_id"), table, links


def similar_documents(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, list_split: int = LIST_SPLIT) -> DataFrame:
    """(doc_id, class_id, links): a row for each row of ``docs``.

    ``class_id`` is the least ``doc_id`` of the documents joined to it by copies and links,
    ``links`` the number of other distinct sets whose Jaccard with its own reaches the threshold.
    """
    rows, table, links = _linked(docs, n, threshold, list_split)
    named = table.join(links, "node", "left")
    whole = named.where("comp is not null").groupBy("comp").agg(F.min("least").alias("class"))
    classes = named.join(whole, "comp", "left").select(F.col("node").alias("_node"), F.coalesce("class", "least").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    # rows without a set meet nothing: their own hash keeps them from falling into one task
    joined = rows.withColumn("_key", F.coalesce("node", F.xxhash64("doc_id"))).join(classes, F.col("_key") == F.col("_node"), "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    links = F.when(F.col("node").isNotNull(), F.col("links"))
    return joined.select("doc_id", own.alias("class_id"), F.coalesce(links, F.lit(0)).cast("bigint").alias("links"))


def copies_to_drop(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node): all but one row of each class, the one with the least (doc_id, node)."""
    rows, table, links = _linked(docs, n, threshold)
    named = rows.where("node is not null and doc_id is not null").groupBy("node", "doc_id").count().join(links.select("node", "comp"), "node", "left")
    each = named.select(F.coalesce("comp", "node").alias("comp"), "doc_id", "node")
    kept = each.groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("kept"))
    return each.join(kept, "comp").where("doc_id <> kept.doc_id or node <> kept.node").select("doc_id", "node")


def with_node(docs: DataFrame, name: str, n: int = NGRAM) -> DataFrame:
    """``docs`` with the key of each text's set in column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int | None] = [None] * batch.num_rows
            for row, tokens in text_sets(batch.column(batch.schema.get_field_index("text")), n):
                keys[row] = set_key(tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class left: the one with the least ``doc_id``.

    Rows of one ``doc_id`` with the same set (or, without a set, identical ones) become one. A row without a ``doc_id`` always stays.
    Where a ``doc_id`` stands on several texts, each text is judged on its own.
    """
    gone = checkpointed(copies_to_drop(docs, n, threshold))
    repeated = checkpointed(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    light = lambda frame: F.broadcast(frame) if frame.count() <= COPIES_BROADCAST else frame
    if repeated.isEmpty():
        return docs.join(light(gone.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    twice = light(repeated)
    single = docs.join(light(gone.select("doc_id").distinct().join(repeated, "doc_id", "left_anti")), "doc_id", "left_anti").join(twice, "doc_id", "left_anti")
    name = "_node"
    while name in docs.columns:
        name += "_"
    several = with_node(docs.join(twice, "doc_id", "left_semi"), name, n)
    dropped = gone.join(repeated, "doc_id", "left_semi").toDF("doc_id", name)
    left = several.join(dropped, ["doc_id", name], "left_anti")
    once = left.where(F.col(name).isNotNull()).dropDuplicates(["doc_id", name]).unionByName(left.where(F.col(name).isNull()).dropDuplicates())
    return single.select(*docs.columns).unionByName(once.select(*docs.columns))
