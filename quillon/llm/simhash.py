"""SimHash near-duplicates by meeting in the middle of Hamming balls.

Two fingerprints at distance three or less meet at a key that lies at most two flips from the one and at most one flip from
the other. Three facts keep the emitted balls small and still lossless:

* at an odd distance the fingerprints differ in parity, so that only those with an even number
  of bits need to emit flips of two bits;
* of any three bits two lie in the same half of the word, so that flips of two bits within one
  half are enough (992 of the 2016);
* at distance two both sides meet on flips of one bit.

Everything that meets at a key is within three bits of any fingerprint that reached it with at
most one flip. Linking all of it to one such fingerprint (the smallest) thus loses no
reachability, and no pairs within a group are emitted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, slices, small_batches, utf8
from quillon.llm.components import components

SEED = 42
WORDS = 3
RADIUS = 3


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer; 0 without a word."""
    tokens = text.lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 4096):
        octets = hashes[part : part + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches):
    for batch in slices(batches):
        out = [fingerprint(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of docs(doc_id, text); a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_MASKS = [0, *(_signed(1 << i) for i in range(64)), *(_signed(1 << i | 1 << j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2))]
#: Places in _MASKS: no flip, one flip, two flips within a half.
_NONE, _ONE, _TWO_IN_A_HALF = [0], list(range(1, 65)), list(range(65, len(_MASKS)))


def ball_links(prints: DataFrame) -> DataFrame:
    """(fp, hub) links between the distinct fingerprints of prints(fp), three bits or less apart.

    Following the links reaches exactly what following all pairs within the radius reaches.
    """

    masks = F.lit(_MASKS).cast("array<long>")

    def flipped(df: DataFrame, places: list[int]) -> DataFrame:
        # A row names its flips by their place in the list, which is shorter than the fingerprint itself.
        spread = df.select(F.explode(F.lit(places).cast("array<smallint>")).alias("flips"), "fp")
        return spread.select(F.col("fp").bitwiseXOR(F.get(masks, F.col("flips").cast("int"))).alias("key"), "flips")

    origin = F.col("key").bitwiseXOR(F.get(masks, F.col("flips").cast("int")))
    even = prints.where(F.bit_count("fp") % 2 == 0)
    near = flipped(prints, _ONE).union(flipped(even, _NONE))
    hubs = near.groupBy("key").agg(F.min(origin).alias("hub"))
    met = near.union(flipped(even, _TWO_IN_A_HALF)).join(hubs.hint("shuffle_hash"), "key").select(origin.alias("fp"), "hub")
    return met.where((F.col("fp") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS)).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable over fingerprints at most three bits apart.
    Null and word-less texts have fingerprint 0 and link like any other. Rows repeat as given; a row
    without a doc_id keeps its null, and gets its component's smallest doc_id (null if there is none).
    Other columns are ignored; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        prints = checkpoint(fingerprints(docs))
    first = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = checkpoint(ball_links(first.select("fp")))
    # Components are found over fingerprints, whose number of distinct values is what counts here.
    rooted = components(links, "fp", "hub").select(F.col("node").alias("fp"), "root")
    whole = first.join(rooted, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = whole.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id; docs must have unique doc_ids to keep one each.

    Rows without a doc_id cannot be named by a component and are kept.
    """
    found = near_duplicates(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()))
    drop = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
