"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors.

Each text becomes a vector of hashed byte n-grams (orders 2 to 4 over the lower-cased
letters, all else a blank), weighted by log(1 + count) times an inverse document frequency
and scaled to length one. Each language has several centroids, found by spherical k-means.
A text belongs to the language of the centroid with the largest cosine; it is rejected
where that cosine is below the language's bound for texts of as many distinct n-grams. These,
not its letters, limit how near a text can come to a centroid: a text that repeats itself is
held to the bound of a short one, and long gibberish to that of a long one.

The classifier is fitted on a bounded sample of the labelled rows (``fit_rows`` per
language, chosen by a hash of the identifier); every text is scored, whole.

Defined results: a null or empty text, or one without a letter, has no language (``und``)
and is rejected, as is every text where no row carries a label. A null identifier is kept as
null. Repeated rows are scored alike. Equal cosines go to the language first in the
alphabet. Texts of any length are scored whole. An empty table gives an empty result.
``identify`` ignores other columns, ``keep_identified`` keeps them, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerspark.llm.text import U64, mix, slices, string_buffers, trimmed

DIM = 4096
ORDERS = (2, 3, 4)
#: Two bins for each doubling of the number of distinct n-grams, of which there are up to DIM.
BINS = 25
#: Pieces that a bin of a language must have for a bound of its own, and those looked at.
LEAST_PIECES, MOST_PIECES = 20, 200
UNKNOWN = "und"
#: Texts whose dense count vectors are held at once (8 MB).
SLICE_ROWS = 512
_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[np.arange(128, 256)] = np.arange(128, 256)
_LETTER[np.arange(97, 123)] = np.arange(97, 123)
_SALTS = {n: U64(0x51_7C_C1_B7_27_22_0A_95 * (2 * n + 1) % (1 << 64)) for n in ORDERS}


def _cells(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the vector cell of the n-gram at every byte; -1 where it is blank."""
    wide = data.astype(U64)
    gram = wide.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            return
        gram = (gram[: len(data) - n + 1] << U64(8)) | wide[n - 1 :]
        if n in ORDERS:
            yield n, ((gram * _SALTS[n]) >> U64(64 - 12)).astype(np.int64)


def count_vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-grams by text (rows x DIM) and the number of letters' bytes of each text."""
    rows = len(offsets) - 1
    base = int(offsets[0])
    lengths = np.diff(offsets)
    body = _LETTER[data[base : int(offsets[-1])]]
    letters = np.add.reduceat(np.append(body != 32, False), np.minimum(offsets[:-1] - base, len(body))) if rows else np.zeros(0, np.int64)
    letters = np.where(lengths > 0, letters, 0)
    # a blank on either side of each text, so that n-grams never cross texts unnoticed
    padded = np.full(len(body) + 2 * rows, 32, dtype=np.uint8)
    owner = np.repeat(np.arange(rows), lengths + 2)
    at = np.arange(len(body)) + 2 * np.repeat(np.arange(rows), lengths) + 1
    padded[at] = body
    blank = padded == 32
    counts = np.zeros(rows * DIM, dtype=np.float32)
    for n, cell in _cells(padded):
        last = len(padded) - n + 1
        good = owner[:last] == owner[n - 1 :]
        good &= ~(blank[:last] & blank[1 : last + 1])
        counts += np.bincount((owner[:last] * DIM + cell)[good], minlength=rows * DIM).astype(np.float32)
    return counts.reshape(rows, DIM), letters


def gram_bin(distinct: np.ndarray) -> np.ndarray:
    return (2 * np.log2(np.maximum(distinct, 1))).astype(np.int64)


@dataclass
class Model:
    """Centroids (rows of ``centroids``) of the languages ``owner`` points to, and the bounds
    of each language (rows of ``floors``) by bin."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.maximum(norm, 1e-12)[:, None]

    def score(self, counts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: none), cosine, and whether the text is rejected."""
        if not len(self.centroids):
            none = np.full(len(counts), -1)
            return none, np.zeros(len(counts)), np.ones(len(counts), dtype=bool)
        cosines = self.weigh(counts) @ self.centroids.T
        best = cosines.argmax(1)
        cosine = cosines[np.arange(len(best)), best].astype(np.float64)
        empty = letters == 0
        lang = np.where(empty, -1, self.owner[best])
        cosine = np.where(empty, 0.0, cosine)
        return lang, cosine, empty | (cosine < self.floors[self.owner[best], gram_bin((counts > 0).sum(1))])


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first starts; deterministic."""
    centre = x.mean(0)
    picks = [int((x @ centre).argmax())]
    nearest = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        pick = int(nearest.argmin())
        if nearest[pick] > 1 - 1e-6:
            break
        picks.append(pick)
        nearest = np.maximum(nearest, x @ x[pick])
    centroids = x[picks]
    for _ in range(rounds):
        member = (x @ centroids.T).argmax(1)
        fresh = np.stack([x[member == j].sum(0) if (member == j).any() else centroids[j] for j in range(len(centroids))])
        fresh /= np.maximum(np.linalg.norm(fresh, axis=1), 1e-12)[:, None]
        if np.allclose(fresh, centroids):
            break
        centroids = fresh
    return centroids.astype(np.float32)


def fit_model(counts: np.ndarray, labels: list[str], centroids: int = 3) -> Model:
    """Fit from count vectors of whole texts, without bounds."""
    languages = sorted(set(labels))
    floors = np.zeros((len(languages), BINS))
    if not languages:
        return Model([], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.zeros(DIM, np.float32), floors)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    model = Model(languages, np.zeros(0, int), np.zeros((0, DIM), np.float32), idf, floors)
    x, at = model.weigh(counts), np.array([languages.index(v) for v in labels])
    found = [_cluster(x[at == i], centroids) for i in range(len(languages))]
    model.owner = np.repeat(np.arange(len(languages)), [len(f) for f in found])
    model.centroids = np.concatenate(found)
    return model


def fit_floors(cosines: dict[tuple[str, int], np.ndarray], languages: list[str], share: float = 0.02, margin: float = 0.7) -> np.ndarray:
    """Bounds by language and bin from the cosines of pieces of texts that had no part in the
    centroids: what all but ``share`` of them reach, times ``margin``, never less than those of
    fewer n-grams. A bin with few pieces of a language goes by the pieces of all."""
    floors = np.zeros((len(languages), BINS))
    for b in range(BINS):
        parts = [cosines.get((v, b), np.zeros(0)) for v in languages]
        pooled = np.concatenate([np.zeros(0), *parts])
        for i, part in enumerate(parts):
            used = part if len(part) >= LEAST_PIECES else pooled
            if len(used) >= LEAST_PIECES:
                floors[i, b] = margin * float(np.quantile(used, share))
    return np.maximum.accumulate(floors, axis=1)


def _fit_rows(sample: DataFrame) -> DataFrame:
    """Sparse count vectors of the sample's whole texts and of pieces of doubling lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.utf8_lower(batch.column("text"))
            labels = batch.column("lang").to_pylist()
            data, offsets = string_buffers(texts)
            out: dict[str, list] = {"lang": [], "half": [], "piece": [], "cells": [], "counts": []}
            for row, label in enumerate(labels):
                a, b = int(offsets[row]), int(offsets[row + 1])
                half = zlib.crc32(data[a:b].tobytes()) & 1
                jobs, bit = [(-1, a, b), (0, a, b)], 2
                while (length := 3 << (bit - 1)) * 1.3 <= b - a:
                    start = a + int(mix(np.array([row * 64 + bit], dtype=U64))[0] % U64(b - a - length))
                    jobs.append((bit, start, start + length))
                    bit += 1
                for piece, lo, hi in jobs:
                    vector, letters = count_vectors(data, np.array([lo, hi]))
                    cells = np.flatnonzero(vector[0])
                    if letters[0]:
                        out["lang"].append(label)
                        out["half"].append(half)
                        out["piece"].append(piece if piece < 0 else int(gram_bin(len(cells))))
                        out["cells"].append(cells.astype(np.int16).tobytes())
                        out["counts"].append(vector[0][cells].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["half"], pa.int32()), pa.array(out["piece"], pa.int32()), pa.array(out["cells"], pa.binary()), pa.array(out["counts"], pa.binary())], names=list(out))

    return sample.mapInArrow(trimmed(run), "lang string, half int, piece int, cells binary, counts binary")


def _dense(rows: list) -> np.ndarray:
    out = np.zeros((len(rows), DIM), dtype=np.float32)
    for i, row in enumerate(rows):
        out[i, np.frombuffer(row["cells"], np.int16)] = np.frombuffer(row["counts"], np.float32)
    return out


def fit(docs: DataFrame, fit_rows: int = 300, centroids: int = 3) -> Model:
    """Fit on at most ``fit_rows`` labelled rows of each language."""
    ids = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).where("_lang is not null and _id is not null")
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = ids.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= fit_rows).select("_id").distinct()
    # bounded by fit_rows per language, hence the broadcast
    sample = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi").where("lang is not null and text is not null")
    rows = sorted(_fit_rows(sample.select("text", "lang")).collect(), key=lambda r: (r["lang"], r["piece"], bytes(r["cells"]), bytes(r["counts"])))
    whole = [r for r in rows if r["piece"] < 0]
    vectors, labels, half = _dense(whole), [r["lang"] for r in whole], np.array([r["half"] for r in whole], dtype=int)
    model = fit_model(vectors, labels, centroids)
    by_bin: dict[tuple[str, int], list] = {}
    for r in rows:
        if r["piece"] >= 0:
            by_bin.setdefault((r["lang"], r["piece"]), []).append(r)
    # the bounds are those of new texts: the pieces of either half meet the centroids of the other
    cosines: dict[tuple[str, int], list] = {}
    for side in (0, 1):
        trained = np.flatnonzero(half != side)
        other = fit_model(vectors[trained], [labels[i] for i in trained], centroids)
        for (label, b), pieces in by_bin.items():
            # thinned evenly: their number only has to carry the quantile
            tested = [r for r in pieces[:: -(-len(pieces) // MOST_PIECES)] if r["half"] == side]
            if tested and label in other.languages:
                cosines.setdefault((label, b), []).append((other.weigh(_dense(tested)) @ other.centroids.T).max(1))
    model.floors = fit_floors({key: np.concatenate(v) for key, v in cosines.items()}, model.languages)
    return model


def _score_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = string_buffers(pc.utf8_lower(texts))
    parts = [model.score(*count_vectors(data, offsets[a : b + 1])) for a, b in slices(offsets, 1 << 18, SLICE_ROWS)]
    if not parts:
        return np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _names(model: Model, lang: np.ndarray) -> pa.Array:
    return pa.array([*model.languages, UNKNOWN], pa.string()).take(pa.array(lang % (len(model.languages) + 1)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: (doc_id, lang_pred, cosine, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, cosine, rejected = _score_texts(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _names(shared.value, lang), pa.array(cosine), pa.array(rejected)], names=["doc_id", "lang_pred", "cosine", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id bigint, lang_pred string, cosine double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, all columns, with ``lang`` as identified."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, rejected = _score_texts(shared.value, batch.column("text"))
            at = batch.schema.get_field_index("lang")
            batch = batch.set_column(at, "lang", _names(shared.value, lang))
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(trimmed(run), docs.schema)
