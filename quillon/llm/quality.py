"""Quality rules: gradient-boosted trees over document statistics, scored in numpy.

The statistics are computed for every document in one pass over whole texts. The trees are fitted on a bounded
sample of labelled rows, and flattened into arrays: all documents of a batch step down all trees
at once. Chosen statistics are monotonic: more of them never raises the quality.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices

#: The most labelled rows that the trees are fitted on, chosen by a hash of doc_id.
LABELLED_ROWS = 20_000
#: Documents that score below this are rejected.
KEEP_SCORE = 0.5
#: Words of the window in which repeats are looked for.
WINDOW = 5

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: What the trees see, and the direction in which each may move the score (-1: never up, 0: free).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "repeat_share": -1,
    "dup_line_share": -1,
    "upper_share": -1,
    "digit_share": -1,
    "bang_per_word": -1,
    "symbol_word_share": -1,
    "distinct_word_share": 0,
}
_DIRECTIONS = np.array(list(FEATURES.values()))


@cache
def _upper_letters() -> np.ndarray:
    """By code point, whether it is a capital, in any script."""
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)


def repeat_words(ids: list[int], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    n = len(ids)
    if n <= width:
        return 0
    found = Counter(windows := list(zip(*(ids[i:] for i in range(width)))))
    if len(found) == len(windows):
        return 0
    covered, upto = 0, 0
    for start, window in enumerate(windows):
        if found[window] > 1:
            covered += start + width - max(start, upto)
            upto = start + width
    return covered


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the values of FEATURES."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    counts = [n, chars, symbols, dup_lines, repeated]
    distinct = set(words)
    upper = int(_upper_letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].sum())
    features = [
        np.log1p(n),
        chars / max(1, n),
        symbols / max(1, n),
        repeated / max(1, n),
        dup_lines / max(1, len(lines)),
        upper / max(1, chars),
        len(re.findall(r"[0-9]", text)) / max(1, chars),
        text.count("!") / max(1, n),
        sum(1 for w in distinct if w[-1] in _SYMBOLS or w[0] in _SYMBOLS) / max(1, len(distinct)),
        len(distinct) / max(1, n),
    ]
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


class Trees:
    """Boosted regression trees on the logistic loss, with second-order gains and monotonic bounds."""

    def __init__(self, depth: int = 3, rounds: int = 40, rate: float = 0.2, bins: int = 32, leaf: float = 4.0, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.leaf, self.ridge = depth, rounds, rate, bins, leaf, ridge
        self.start = 0.0
        n = (1 << (depth + 1)) - 1
        self.feature, self.cut, self.value = np.zeros((0, n), np.int16), np.zeros((0, n)), np.zeros((0, n))

    def _best(self, x, g, h, cuts, low, high):
        """The split with the largest gain whose children keep the order that a direction asks for."""
        clip = lambda gs, hs: np.clip(-gs / (hs + self.ridge), low, high)
        gain_of = lambda gs, hs, v: -(gs * v + 0.5 * (hs + self.ridge) * v * v)
        g_all, h_all = g.sum(), h.sum()
        base, best = gain_of(g_all, h_all, clip(g_all, h_all)), (1e-6, None)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            place = np.searchsorted(edges, x[:, f], side="left")
            gl = np.cumsum(np.bincount(place, g, len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(place, h, len(edges) + 1))[:-1]
            left, right = clip(gl, hl), clip(g_all - gl, h_all - hl)
            gain = gain_of(gl, hl, left) + gain_of(g_all - gl, h_all - hl, right) - base
            bad = (hl < self.leaf / 4) | (h_all - hl < self.leaf / 4) | ((right - left) * _DIRECTIONS[f] < 0)
            gain[bad] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (f, edges[at], left[at], right[at]))
        return best[1]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y):
            return self
        share = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        score, made = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            n = (1 << (self.depth + 1)) - 1
            feature, cut, value = np.full(n, -1, np.int16), np.zeros(n), np.zeros(n)
            node, bounds = np.zeros(len(y), np.int64), {0: (-np.inf, np.inf)}
            for i in range(n):
                rows = node == i
                if i not in bounds or not rows.any():
                    continue
                low, high = bounds[i]
                value[i] = np.clip(-g[rows].sum() / (h[rows].sum() + self.ridge), low, high)
                if 2 * i + 2 >= n or (found := self._best(x[rows], g[rows], h[rows], cuts, low, high)) is None:
                    continue
                f, at, left, right = found
                feature[i], cut[i] = f, at
                mid = (left + right) / 2
                bounds[2 * i + 1], bounds[2 * i + 2] = (low, high), (low, high)
                if _DIRECTIONS[f] < 0:
                    bounds[2 * i + 1], bounds[2 * i + 2] = (mid, high), (low, mid)
                elif _DIRECTIONS[f] > 0:
                    bounds[2 * i + 1], bounds[2 * i + 2] = (low, mid), (mid, high)
                node[rows] = np.where(x[rows, f] <= at, 2 * i + 1, 2 * i + 2)
            score = score + self.rate * value[node]
            made.append((feature, cut, self.rate * value))
        self.feature, self.cut, self.value = (np.stack(x) for x in zip(*made))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality; all rows go down all trees level by level."""
        total = np.full(len(x), self.start)
        if len(x) and len(self.feature):
            trees = np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                f = self.feature[trees, node]
                below = x[rows, np.maximum(f, 0)] > self.cut[trees, node]
                node = np.where(f >= 0, 2 * node + 1 + below, node)
            total = total + self.value[trees, node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Trees:
    """Fit on documents joined with labels(doc_id, quality); null labels and ids take no part.

    About `rows` labelled documents are used, chosen by a hash of doc_id; a doc_id that repeats counts as often
    as it does. Without labels the trees are empty and score one half.
    """
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), (F.col("quality") > 0).cast("double").alias("quality"))
    total = named.count()
    share = min(1.0, rows / max(1, total))
    chosen = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def batches(it):
        for batch in slices(it):
            made = [statistics(t)[1] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    found = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").select("text", "quality").mapInArrow(batches, "x array<double>, y double").toPandas()
    if not len(found):
        return Trees()
    x, y = np.array(found.x.tolist(), float).reshape(len(found), len(FEATURES)), found.y.to_numpy()
    order = np.lexsort((y, *x.T))  # the fit doesn't hang on the order in which rows come
    return Trees().fit(x[order], y[order])


def judge(docs: DataFrame, trees: Trees, keep_score: float = KEEP_SCORE) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score and kept.

    A null text has no words and fails the base rule. All columns of docs are kept, but for those named like
    the new ones, which are replaced; rows repeat as given; an empty table gives an empty result.
    """
    new = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("quality_score", "double"), ("kept", "boolean")]
    names = [n for n, _ in new]
    given = [c for c in docs.columns if c not in names]

    def batches(it):
        for batch in slices(it):
            made = [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts = np.array([m[0] for m in made], np.int64).reshape(-1, 5)
            score = trees.score(np.array([m[1] for m in made], float).reshape(-1, len(FEATURES)))
            failed = base_failed(counts)
            columns = [*batch.columns[:-1], *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_score))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *names])

    schema = docs.select(*given).schema
    for name, kind in new:
        schema = schema.add(name, kind)
    return docs.select(*given, F.col("text").alias("kept")).mapInArrow(batches, schema)
