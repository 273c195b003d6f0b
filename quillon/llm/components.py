"""Connected components of an edge table by alternating star contractions.

Every round is two grouped minima and two joins, so that the state is a table of edges, never
a driver-side union-find; a vertex with many edges is pre-aggregated before each shuffle. The state
is watched while it is written, so that no job of its own tells whether it has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a vertex is tied to the smallest one around that; edges have u > v, and may repeat afterwards."""
    ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("end")).select("end.*")
    low = ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    return edges.join(low, "v").select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of these; edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return edges.join(low, "u").select(F.explode(tied).alias("edge")).select("edge.*").where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, checkpointed, with their number and a hash of them all."""
    seen = Observation()
    made = checkpoint(edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("hash")))
    return made, (seen.get["n"], seen.get["hash"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every vertex that is not itself the smallest of its component.

    `a` and `b` name two columns of one type that can be ordered. Null ends and self loops are ignored; repeated and
    reversed edges count once; no edges give an empty table.
    """
    state, now = _state(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    mark = None
    while now != mark and now[0]:
        mark = now
        state, now = _state(_small_star(_large_star(state)))
        release(state)  # else the shuffles of all rounds stay on disk
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
