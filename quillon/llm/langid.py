"""Language identification by the nearest of several centroids per language.

A text is the bag of its letters' 1-, 2- and 3-grams (lower case, word ends as spaces), hashed to a fixed width, weighted by
TF-IDF and normalised. Each language has a few centroids from spherical k-means, and a text goes to
the language of the centroid with the largest cosine. Texts that lie farther from it than nearly all
training texts of that centroid are marked as rejected.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices

WIDTH = 1 << 13
CENTROIDS = 4
#: Texts per language, about, that the centroids are fitted on.
LEARNED_ROWS = 400
#: Share of its training texts that a centroid may leave outside its reach.
OUTSIDE = 0.005
UNKNOWN = "und"
#: Steps in which the share of a language's texts that is learned from is told.
SHARES = 1 << 40

_LOWER: list = []


def _lower_letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for what is no letter."""
    if not _LOWER:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LOWER.append(table)
    return _LOWER[0]


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; None for a text without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letters = _lower_letters()[points]
    if not letters.any():
        return None
    # Runs of other characters are one gap, so that digits and symbols count for nothing.
    letters = np.concatenate(([0], letters, [0])).astype(np.uint32)
    letters = letters[(letters != 0) | np.concatenate(([True], letters[:-1] != 0))]
    one = letters * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ one[:-1] >> 15) * np.uint32(0x85EBCA77) + letters[1:]
    three = (two[:-1] ^ two[:-1] >> 13) * np.uint32(0xC2B2AE3D) + letters[2:]
    out = np.zeros(WIDTH, np.float32)
    for salt, hashed in ((1, one[letters != 0]), (2, two), (3, three)):
        mixed = (hashed ^ hashed >> 16) * np.uint32(0x27D4EB2F) + np.uint32(salt)
        out += np.bincount((mixed ^ mixed >> 15) & np.uint32(WIDTH - 1), minlength=WIDTH)
    return out


class Centroids:
    def __init__(self, labels: list[str], centres: np.ndarray, weights: np.ndarray, reach: np.ndarray):
        self.labels, self.centres, self.weights, self.reach = labels, centres, weights, reach

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _normal(np.log1p(counts) * self.weights)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        found = [grams(t) for t in texts]
        some = [i for i, g in enumerate(found) if g is not None]
        label, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if some and self.labels:
            cosines = self.vectors(np.stack([found[i] for i in some])) @ self.centres.T
            best = cosines.argmax(axis=1)
            for i, k, row in zip(some, best.tolist(), cosines):
                label[i], score[i], rejected[i] = self.labels[k], float(min(1.0, max(0.0, row[k]))), bool(row[k] < self.reach[k])
        return label, score, rejected


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart seeds; deterministic for the order of x."""
    centres = [_normal(x.sum(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.stack(centres).T).max(axis=1).argmin()])
    centres = np.stack(centres)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = _normal(np.stack([x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    return centres, (x @ centres.T).argmax(axis=1)


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that the query learns nothing from; a null doc_id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = LEARNED_ROWS) -> Centroids:
    """Learn from docs(doc_id, text, lang); null langs and texts without a letter take no part.

    The centroids and the weights are fitted on about `rows` texts of each language, chosen by a hash of doc_id
    (a doc_id that repeats counts as often). The sample follows the number of languages, not of documents; only counts that are not 0 are sent.
    """
    known = docs.where(F.col("lang").isNotNull())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return Centroids([], np.zeros((0, WIDTH), np.float32), np.ones(WIDTH, np.float32), np.zeros(0))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(max(1, int(min(1.0, rows / r["count"]) * SHARES))))])
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(6)), F.lit(SHARES))
    chosen = known.where(place < share[F.col("lang")]).select("text", "lang")

    def batches(it):
        for batch in slices(it, 64):
            made = [grams(t) for t in batch.column(0).to_pylist()]
            packed = [None if g is None else np.stack((at := np.flatnonzero(g), g[at])).astype("<f4").tobytes() for g in made]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1)], ["grams", "lang"])

    found = chosen.mapInArrow(batches, "grams binary, lang string").where("grams is not null").toPandas()
    sparse = sorted(zip(found.lang, found.grams))  # the fit doesn't hang on the order in which rows come
    seen = np.zeros(WIDTH)
    for _, packed in sparse:
        seen[np.frombuffer(packed, "<f4").reshape(2, -1)[0].astype(np.int64)] += 1
    weights = (np.log((1 + len(sparse)) / (1 + seen)) + 1).astype(np.float32)
    labels, centres, reach = [], [], []
    for name, group in groupby(sparse, key=lambda x: x[0]):
        own = np.zeros((len(group := list(group)), WIDTH), np.float32)
        for row, (_, packed) in zip(own, group):
            at, n = np.frombuffer(packed, "<f4").reshape(2, -1)
            row[at.astype(np.int64)] = np.log1p(n)
        own = _normal(own * weights)
        made, place_ = _clusters(own, CENTROIDS)
        for j, centre in enumerate(made):
            if (place_ == j).any():
                labels.append(name)
                centres.append(centre)
                reach.append(np.quantile(own[place_ == j] @ centre, OUTSIDE))
    return Centroids(labels, np.array(centres, np.float32).reshape(-1, WIDTH), weights, np.array(reach))


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """Add lang_pred, score (the cosine, 0 to 1) and rejected (outside the centroid's reach).

    A null text, or one without a letter, gets 'und', 0 and true; so does every text of a model without languages.
    The model is bounded by languages, centroids and width. All columns of docs are kept, but for those named like the
    new ones, which are replaced; rows repeat as given; an empty table gives an empty result.
    """
    new = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = [c for c in docs.columns if c not in new]

    def batches(it):
        for batch in slices(it):
            label, score, rejected = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [*batch.schema.names[:-1], *new])

    schema = docs.select(*given).schema
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return docs.select(*given, F.col("text").alias("lang_pred")).mapInArrow(batches, schema)
