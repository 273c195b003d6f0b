"""Exact top-k inner-product search by distributed histogram selection.

Every pass scores all queries against all candidates, block by block, and keeps only counts: per query
a histogram of the scores in its current range. The first range spans all possible scores; the
bin in which the running count from the top reaches k is the next range, until a range is a single
score, the kth value. A last pass returns what scores at least that, with ties cut by vec_id.

A block reports only the bins that can matter to the global kth value: those from the top until
its own count reaches what is still needed. So a query has at most k rows from a block however many
candidates tie. Queries are copied to each block of candidates by a join on block numbers; nothing that grows
with the data is broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint

SCALE = 256
#: Most queries in a block; fewest and most candidates in one; bins of a histogram as a power of two.
QUERY_ROWS, CANDIDATE_ROWS, BIN_BITS = 4096, (1024, 16384), 10


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, ints): floor(256 x) for each component; rows without a usable vector or id are left out."""
    wide = F.col(embedding).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * SCALE).cast("long")).alias("ints"))


def _matrix(column: pd.Series, width: int, kind) -> np.ndarray:
    out = np.zeros((len(column), width), kind)
    for row, ints in zip(out, column):
        row[: len(ints)] = ints
    return out


def _scores(left: pd.DataFrame, right: pd.DataFrame, bound: int) -> np.ndarray:
    """Exact integer inner products; floating point only where every partial sum is exact."""
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    width = max(max(map(len, left.ints), default=0), max(map(len, right.theirs), default=0))
    out = (_matrix(left.ints, width, kind) @ _matrix(right.theirs, width, kind).T).astype(np.int64)
    out[left.vec_id.to_numpy()[:, None] == right.other.to_numpy()[None, :]] = np.iinfo(np.int64).min  # its own row
    return out


def _block(column: str, rows: int, total: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(max(1, -(-total // rows)))).cast("int")


def top_k(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors(vec_id, embedding) for the rows where `queries` holds.

    Fewer candidates than k give all of them; equal scores go to the smaller vec_id. Components are
    floor(256 x); shorter vectors count as padded with zeros, and null, NaN or infinite components or a null vec_id
    leave a row out. A row is no candidate for queries with its own vec_id; otherwise rows that repeat are as many
    candidates. Equal query rows ask once; different vectors under one vec_id each have k rows of their own. Scores have to fit a
    long: vectors whose squared length, in components of floor(256 x), passes 2^62 raise a ValueError. Empty tables give an empty result; other columns are ignored.
    """
    rows = checkpoint(quantised(vectors))
    measured = rows.agg(F.count("*"), F.coalesce(F.max(F.aggregate("ints", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(0.0))).first()
    total, bound = measured[0], int(measured[1] * (1 + 1e-9)) + 1  # of every |score|, by Cauchy and Schwarz
    if bound >= 1 << 62:
        raise ValueError("scores do not fit a 64-bit integer")
    asked = rows.where(queries).distinct().withColumn("query", F.xxhash64("vec_id", "ints"))
    block_rows = min(CANDIDATE_ROWS[1], max(CANDIDATE_ROWS[0], total // 64))
    n_blocks = max(1, -(-total // block_rows))
    candidates = rows.select(_block("vec_id", block_rows, total).alias("b"), F.col("vec_id").alias("other"), F.col("ints").alias("theirs"))
    asked = checkpoint(asked.select(_block("vec_id", QUERY_ROWS, asked.count()).alias("q"), "query", "vec_id", "ints"))

    bits = max(1, (2 * bound + 1).bit_length())
    state = asked.select("query", F.lit(-bound).cast("long").alias("low"), F.lit(k).cast("long").alias("needed"), F.lit(0).cast("long").alias("above"))

    def pairs(extra: DataFrame) -> DataFrame:
        return asked.join(extra, "query").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).groupBy("b", "q")

    # Each candidate block meets every block of queries once.
    n_queries = max(1, (asked.agg(F.max("q")).first()[0] or 0) + 1)
    placed = candidates.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).withColumnRenamed("b", "d").groupBy("d", "c")

    def histogram(width: int, shift: int):
        def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            parts = []
            if len(left) and len(right):
                scores = _scores(left, right, bound)
                for query, low, needed, own in zip(left["query"], left.low, left.needed, scores):
                    bins = own[(own >= low) & (own - low < 1 << width)] - low >> shift
                    value, n = np.unique(bins, return_counts=True)
                    value, n = value[::-1], n[::-1]
                    upto = np.searchsorted(np.cumsum(n), needed) + 1
                    parts.append(pd.DataFrame({"query": query, "bin": value[:upto], "n": n[:upto]}))
            return pd.concat(parts) if parts else pd.DataFrame({"query": [], "bin": [], "n": []}, dtype="int64")

        return count

    shift = bits
    while shift > 0:
        width, shift = shift, max(0, shift - BIN_BITS)
        counted = pairs(state).cogroup(placed).applyInPandas(histogram(width, shift), "query long, bin long, n long")
        summed = counted.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        # From the top: the first bin whose running count reaches what is needed, else the lowest there is.
        listed = summed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins")).join(state, "query")
        walk = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("sum")),
            lambda a, x: F.when(a["sum"] >= F.col("needed"), a).otherwise(F.struct(x["bin"].alias("bin"), a["sum"].alias("before"), (a["sum"] + x["n"]).alias("sum"))),
        )
        state = checkpoint(
            listed.withColumn("w", walk).select("query", (F.col("low") + F.expr(f"shiftleft(w.bin, {shift})")).alias("low"), F.greatest(F.lit(1).cast("long"), F.col("needed") - F.col("w.before")).alias("needed"), (F.col("above") + F.col("w.before")).alias("above"))
        )

    def winners(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            ids = right.other.to_numpy()
            for query, query_id, low, needed, own in zip(left["query"], left.vec_id, left.low, left.needed, _scores(left, right, bound)):
                tied = np.flatnonzero(own == low)
                tied = tied[np.argsort(ids[tied], kind="stable")[:needed]]
                best = np.concatenate((np.flatnonzero(own > low), tied))
                parts.append(pd.DataFrame({"query": query, "query_id": query_id, "vec_id": ids[best], "score": own[best]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = pairs(state).cogroup(placed).applyInPandas(winners, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
