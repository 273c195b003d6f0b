"""Mixing to target weights with soft memberships, in DataFrame operations only.

1. A Bernoulli naive-Bayes classifier is fitted on labelled documents (a table of doc_id and domain): its vocabulary is
   the words, and marks of a text's shape, that tell the domains apart best. The model is a few hundred numbers per domain.
2. Every document gets its posterior p_k over domains, and its number of tokens n.
3. Rates r >= 0 are fitted by projected gradient descent on the weighted squares of
   sum_d r_d n_d p_dk - target_k, in the metric of the documents with a rate, until all targets are met or no step helps.
   Each step is one sum over the documents; only a few numbers per pair of domains come back.

A rate is the expected number of copies of a document in the mixture.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, fresh

#: Labelled documents, about, that the classifier is fitted on, chosen by a hash of doc_id; and its vocabulary.
LABELLED_ROWS, VOCABULARY = 10_000, 256
#: Words count only from this chi-squared value on: about one in ten million for a word that tells nothing.
LEAST_GAIN = 28.4
#: Relative error at which the steps end, and the least share by which a plain gradient step has to lower the squares.
TOLERANCE, STALLED = 1e-3, 1e-9
#: Production weights of the domains that the labels table tells apart.
WEIGHTS = {"good": 0.90, "low": 0.08, "toxic": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels(doc_id, quality, toxic); rows without a usable label have a null domain."""
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").when(F.col("quality") <= 0, "low")
    return labels.select(F.col("doc_id").cast("long"), domain.alias("domain"))


def tokens(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def evidence(text: Column) -> Column:
    """The words of a text, stripped of outer punctuation, and marks of its shape."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(F.lower(text), r"[\s.,;:!?\"()]+")
    marks = F.array(
        F.when(text.rlike(r"([#*$%&|<>])\1"), "[symbol run]"),
        F.when(text.contains("!!"), "[bang run]"),
        F.when(text.contains(" | "), "[columns]"),
        F.when(text.rlike(r"\p{Lu}{4,}\P{L}+\p{Lu}{4,}"), "[capitals]"),
        F.when(F.char_length(text) < 100, "[short]"),
    )
    return F.array_distinct(F.concat(words, F.array_compact(marks)))


class Domains:
    """Names, log odds without any evidence, and what each word adds to each domain."""

    def __init__(self, names: list[str], start: list[float], words: dict[str, list[float]]):
        self.names, self.start, self.words = names, start, words

    def posteriors(self, text: Column) -> Column:
        """array<double> over names."""
        found = F.array_intersect(evidence(text), F.array(*[F.lit(w) for w in self.words]).cast("array<string>"))
        start = F.array(*[F.lit(x) for x in self.start])
        if self.words:
            added = F.create_map(*[x for w, v in self.words.items() for x in (F.lit(w), F.array(*[F.lit(y) for y in v]))])
            scores = F.aggregate(found, start, lambda a, w: F.zip_with(a, added[w], lambda x, y: x + y))
        else:
            scores = start
        odds = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
        return F.transform(F.array(odds), lambda s: F.transform(s, lambda x: x / F.aggregate(s, F.lit(0.0), lambda a, y: a + y)))[0]


def fit_domains(docs: DataFrame, labelled: DataFrame, rows: int = LABELLED_ROWS, vocabulary: int = VOCABULARY) -> Domains:
    """Fit on docs joined with labelled(doc_id, domain); null domains and ids take no part.

    About `rows` labelled documents are used. Without any there is the one domain 'all'.
    """
    named = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "domain")
    share = int(min(1.0, rows / max(1, named.count())) * 1_000_000)
    chosen = named.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) < share)
    seen = checkpoint(docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").select("domain", evidence(F.col("text")).alias("words")))
    sizes = {r["domain"]: r["count"] for r in seen.groupBy("domain").count().collect()}
    names = sorted(sizes)
    if not names:
        return Domains(["all"], [0.0], {})
    total = sum(sizes.values())
    counts = seen.select("domain", F.explode("words").alias("word")).where("word <> ''").groupBy("word").agg(*[F.sum(F.when(F.col("domain") == n, 1).otherwise(0)).alias(f"n{i}") for i, n in enumerate(names)])
    every = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    # Chi-squared distance of a word's presence from its presence overall, over the domains.
    gain = sum((F.pow(F.col(f"n{i}") - every * (sizes[n] / total), 2) / (every * (sizes[n] / total) * (1.0 - every / (total + 1.0))) for i, n in enumerate(names)), F.lit(0.0))
    top = counts.where((every > 1) & (gain > LEAST_GAIN)).orderBy(gain.desc(), "word").limit(vocabulary).collect()
    start, words = [], {r["word"]: [] for r in top}
    for i, n in enumerate(names):
        start.append(math.log(sizes[n] / total))
        for r in top:
            p = (r[f"n{i}"] + 0.5) / (sizes[n] + 1)
            start[-1] += math.log1p(-p)
            words[r["word"]].append(math.log(p) - math.log1p(-p))
    return Domains(names, start, words)


def rated(moves: list[np.ndarray], p: Column, max_rate: float | None = None) -> Column:
    """The rate of a document with posteriors p: 1, moved step by step and kept at 0 or more."""

    def moved(r: Column, d: Column) -> Column:
        to = F.greatest(F.lit(0.0), r - sum((d[i] * p[i] for i in range(len(moves[0]))), F.lit(0.0)))
        return to if max_rate is None else F.least(F.lit(float(max_rate)), to)

    return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in d]) for d in moves]), F.lit(1.0), moved) if moves else F.lit(1.0)


def fit_rates(members: DataFrame, targets: list[float], max_rate: float | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps of rated() over members(n, p), and by domain how much the mixture holds over its target.

    Projected steps from 1, one after the other. The residuals are scaled by the root of sum n p_k^2. A step solves for the documents whose
    rate is not 0; where that does not lower the squares, the plain gradient step does, whose curvature is that of all documents. There is no largest rate unless
    one is given. A domain that no document belongs to is left out; a target that no rates reach leaves a residual.
    """
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    goal = np.array(targets, float)

    def measured(moves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Residuals, and the sums of n p_i p_j over the documents with a rate."""
        r, n = F.col("r"), F.col("n")
        found = members.select("n", "p", rated(moves, F.col("p"), max_rate).alias("r")).agg(
            *[F.coalesce(F.sum(r * n * p[i]), F.lit(0.0)) for i in range(k)], *[F.coalesce(F.sum(F.when(r > 0, n * p[i] * p[j])), F.lit(0.0)) for i, j in pairs]
        ).first()
        m = np.zeros((k, k))
        for (i, j), x in zip(pairs, found[k:]):
            m[i, j] = m[j, i] = x
        return np.array(found[:k], float) - goal, m

    moves: list[np.ndarray] = []
    residual, active = measured(moves)
    diagonal = np.diag(active)  # all documents start with a rate
    scale = np.sqrt(np.where(diagonal > 0, diagonal, np.inf))
    step = 1 / max(1e-12, np.linalg.eigvalsh(active / np.outer(scale, scale)).max())
    while (np.abs(residual) > TOLERANCE * np.maximum(goal, 1))[diagonal > 0].any():
        x = residual / scale
        tries = (np.linalg.pinv(active / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ x / scale, step * x / scale)
        for least, move in zip((0.5, STALLED), tries):
            after = measured([*moves, move])
            if ((after[0] / scale) ** 2).sum() <= (1 - least) * (x**2).sum():
                moves, (residual, active) = [*moves, move], after
                break
        else:
            break
    return moves, residual


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0) -> DataFrame:
    """Add n_tokens, domain (the likeliest), posteriors (map<string, double>) and rate.

    The expected tokens of domain k in the mixture, the sum of rate * n_tokens * p_k, are to be its share of the weights
    times `budget` times all tokens; domains without a weight are to have none. Targets that no rates meet are told in a warning. A null or empty text has no tokens and takes no part in the
    sums; its rate follows from its posterior like any other. All columns of docs are kept, but for those named like the
    new ones, which are replaced; rows repeat as given; an empty table gives an empty result.
    """
    new = ["n_tokens", "domain", "posteriors", "rate"]
    model = fit_domains(docs, labelled)
    given = [c for c in docs.columns if c not in new]
    found = checkpoint(docs.select(*given, tokens(F.col("text")).alias("n_tokens"), model.posteriors(F.col("text")).alias("posteriors")))
    members = checkpoint(found.select(F.col("n_tokens").cast("double").alias("n"), F.col("posteriors").alias("p")))
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]
    whole = sum(weights.get(n, 0.0) for n in model.names) or 1.0
    targets = [budget * total * weights.get(n, 0.0) / whole for n in model.names]
    moves, residual = fit_rates(members, targets)
    missed = {n: float(x) for n, x, t in zip(model.names, residual, targets) if abs(x) > TOLERANCE * max(t, 1)}
    if missed:
        warnings.warn(f"no rates meet the targets; tokens over or under, by domain: {missed}", stacklevel=2)
    names = F.array(*[F.lit(n) for n in model.names])
    best = names[F.array_position("posteriors", F.array_max("posteriors")).cast("int") - 1]
    found = found.withColumn("rate", F.round(rated(moves, F.col("posteriors")), 6))
    return found.select(*given, "n_tokens", best.alias("domain"), F.map_from_arrays(names, "posteriors").alias("posteriors"), "rate")


def copies(mixed: DataFrame) -> DataFrame:
    """The mixture's rows: each of `mixed` as often as its rate says, the fraction decided by a hash of doc_id.

    A row without a rate is left out; all columns are kept; an empty table gives an empty result.
    """
    even = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(77)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.coalesce("rate", F.lit(0.0)) + even * (F.col("rate") > 0).cast("double")).cast("int")
    each = fresh(mixed.columns, "copy")
    return mixed.where(times > 0).withColumn(each, F.explode(F.sequence(F.lit(1), times))).drop(each)
