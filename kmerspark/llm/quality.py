"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines.

Words are the runs without ASCII white space, lines the pieces between line feeds. For each
n-gram length, rolling hashes of all runs of n words are compared within the text; every
character of a word in any run that occurs more than once is covered, once. The same holds
for lines: all characters of lines that occur more than once are covered, blank lines
aside. The share of a length is the covered characters over all characters of words; that
of lines the covered characters over all characters of lines that are not blank.

A text is kept if no share is above its limit. The limits follow published rules for web
text, raised for long n-grams so that a text with a quoted line or two is left alone.

Defined results: a null or empty text, or one of white space, has shares of 0 and is kept
(emptiness is not repetition). Texts shorter than n words have a share of 0 at n. Repeated
rows are judged alike, and each on its own, so ties do not matter; a null identifier stays
null; texts of any length are read whole; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerspark.llm.text import U64, gram_hashes, mix, slices, span_hashes, string_buffers, word_spans

LENGTHS = (2, 3, 4, 5, 7, 10)
LIMITS = {2: 0.80, 3: 0.60, 4: 0.45, 5: 0.35, 7: 0.30, 10: 0.25}
LINE_LIMIT = 0.30


def _split_words(starts: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut the spans that run over a border between two texts."""
    if not len(starts) or not len(inner):
        return starts, ends
    at = np.searchsorted(starts, inner, side="right") - 1
    cut = inner[(at >= 0) & (starts[np.maximum(at, 0)] < inner) & (ends[np.maximum(at, 0)] > inner)]
    cut = np.unique(cut)
    return np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))


def _repeated(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which entries occur more than once with their owner."""
    key = mix(hashes ^ (owner.astype(U64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.append(ranked[1:] == ranked[:-1], False)
    out = np.zeros(len(key), dtype=bool)
    out[order] = same | np.append(False, same[:-1])
    return out


def repetition(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Characters of words, of them covered by repeats (by n), of lines, of repeated lines."""
    rows, base = len(offsets) - 1, int(offsets[0])
    body, edges = data[base : int(offsets[-1])], offsets - base
    # characters before each byte: bytes that continue a character do not count
    chars = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
    starts, ends = _split_words(*word_spans(body), edges[1:-1])
    owner = np.searchsorted(edges, starts, side="right") - 1
    weight = chars[ends] - chars[starts]
    words = span_hashes(body, starts, ends)
    total = np.bincount(owner, weights=weight, minlength=rows).astype(np.int64)
    covered = {}
    for n in lengths:
        hashes = gram_hashes(words, n)
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        if len(hashes):
            inside = owner[: len(hashes)] == owner[n - 1 :]
            at = np.flatnonzero(inside)
            at = at[_repeated(owner[at], hashes[at])]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + n, -1)
        mask = np.cumsum(hit[:-1]) > 0
        covered[n] = np.bincount(owner[mask], weights=weight[mask], minlength=rows).astype(np.int64)
    # lines: cut at line feeds and at the borders of texts
    feeds = np.flatnonzero(body == 10)
    line_starts = np.unique(np.concatenate([edges[:-1], feeds + 1]))
    line_starts = line_starts[line_starts < len(body)]
    line_ends = np.minimum(np.append(line_starts[1:], len(body)), len(body))
    line_ends = line_ends - ((line_ends > line_starts) & (body[np.maximum(line_ends - 1, 0)] == 10)) if len(line_starts) else line_ends
    line_owner = np.searchsorted(edges, line_starts, side="right") - 1
    # a line is blank where no word begins in it
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[filled], line_ends[filled], line_owner[filled]
    line_weight = chars[line_ends] - chars[line_starts]
    twice = _repeated(line_owner, span_hashes(body, line_starts, line_ends)) if len(line_starts) else np.zeros(0, bool)
    lines = np.bincount(line_owner, weights=line_weight, minlength=rows).astype(np.int64)
    again = np.bincount(line_owner[twice], weights=line_weight[twice], minlength=rows).astype(np.int64)
    return total, covered, lines, again


def _columns() -> list[str]:
    return [*(f"dup_{n}gram" for n in LENGTHS), "dup_line"]


def repetition_rules(docs: DataFrame, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """(doc_id, dup_2gram, ..., dup_10gram, dup_line, keep) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            parts = []
            for a, b in slices(offsets):
                total, covered, lines, again = repetition(data, offsets[a : b + 1])
                shares = [covered[n] / np.maximum(total, 1) for n in LENGTHS]
                parts.append(np.stack([*shares, again / np.maximum(lines, 1)]))
            shares = np.concatenate(parts, axis=1) if parts else np.zeros((len(LENGTHS) + 1, 0))
            keep = (shares <= np.array([*(limits[n] for n in LENGTHS), line_limit])[:, None]).all(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, shares), pa.array(keep)], names=["doc_id", *_columns(), "keep"])

    ddl = ", ".join(["doc_id bigint", *(f"{c} double" for c in _columns()), "keep boolean"])
    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ddl)
    return found.select("doc_id", *[F.round(c, 9).alias(c) for c in _columns()], "keep")


def _oracle() -> str:
    grams = " UNION ALL ".join(
        f"""SELECT doc_id, {n} AS n, p, w[p:p + {n - 1}] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS p FROM words WHERE len(w) >= {n})"""
        for n in LENGTHS
    )
    shares = ", ".join(f"coalesce(max(s) FILTER (n = {n}), 0.0) AS dup_{n}gram" for n in LENGTHS)
    keep = " AND ".join([*(f"dup_{n}gram <= {LIMITS[n]}" for n in LENGTHS), f"dup_line <= {LINE_LIMIT}"])
    return f"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
totals AS (SELECT doc_id, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS total FROM words),
grams AS ({grams}),
again AS (SELECT doc_id, n, p FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1),
hit AS (SELECT DISTINCT doc_id, n, unnest(range(p, p + n)) AS p FROM again),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM words),
covered AS (SELECT h.doc_id, h.n, sum(length(e.x)) AS c FROM hit h JOIN each e ON h.doc_id = e.doc_id AND h.p = e.p GROUP BY h.doc_id, h.n),
shares AS (SELECT t.doc_id, c.n, c.c / greatest(t.total, 1) AS s FROM totals t LEFT JOIN covered c ON t.doc_id = c.doc_id),
gramshares AS (SELECT doc_id, {shares} FROM shares GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
filled AS (SELECT doc_id, l, count(*) OVER (PARTITION BY doc_id, l) AS k FROM lines WHERE regexp_matches(l, '[^ \\t\\r\\f\\v]')),
lineshares AS (SELECT doc_id, coalesce(sum(length(l)) FILTER (k > 1), 0) / sum(length(l)) AS s FROM filled GROUP BY doc_id),
joined AS (SELECT g.*, coalesce(l.s, 0.0) AS dup_line FROM gramshares g LEFT JOIN lineshares l ON g.doc_id = l.doc_id)
SELECT doc_id, {", ".join(f"round({c}, 9) AS {c}" for c in _columns())}, {keep} AS keep FROM joined
"""


ORACLE = _oracle()
