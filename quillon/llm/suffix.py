"""Exact repeated passages by prefix doubling over a content-defined sample of positions.

Plain doubling ranks every byte position at lengths 1, 2, 4, ... and sorts all (position, rank) pairs
each time, which writes many times the corpus. Here the positions that are ranked grow with what
repeats, not with the corpus:

1. length 32: every 100-byte string names the leftmost smallest hash among its 32-byte substrings.
   Equal strings name the same offset, so that only these sampled positions (one in 35 bytes or so)
   are sorted by the rank of their 32-byte prefix; a position whose rank is unique is done. So is one whose whole stretch of
   bytes (the up to 168 that its strings reach over) was seen in an earlier place, where all of its strings repeat.
2. length 66: a position that is left is ranked by pairs of ranks at offset 34, one that ends at it and one
   that starts there. Each of its strings holds one of the two. The strings of a pair that is unique are done.
3. length 100, the threshold: the strings that are left are ranked one by one.

Ranks are names given by hashes (64 bits of the prefix with 64 of the stretch that holds it, or of the other rank of a pair; 64 bits of
a string with 32 of its prefix). Strings are dealt out by their own name, so that a prefix that many share is no hot key. Spark
sorts the (rank, document, offset) rows and finds each name's first place. Within a task a name is sent once, so that
a passage in a third of all documents does not put a third of all rows under one key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, slices, utf8

LENGTH = 100
PREFIX = 32
#: Between the ranks of a pair: strings hold the 66 bytes that end, or those that start, with a sampled prefix.
OFFSET = (LENGTH - PREFIX) // 2
#: Strings handled at once; longer texts are cut into overlapping chunks.
CHUNK = 1 << 20
_SPAN_BITS = 31
#: Of the prefix's name, what a string's name of 64 bits is extended by.
_PART_OF_NAME = (1 << 32) - 1
_NO_ID = (1 << 63) - 1
_SENT, _SENT_NAMES = "h long, c long, doc long, at long, seen boolean", ["h", "c", "doc", "at", "seen"]

_mask = (1 << 64) - 1


def _tables(seed: int = 20240229) -> tuple[np.ndarray, int, int]:
    values = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15 | 1
    return values, base, pow(base, -1, 1 << 64)


class Sampler:
    """Finds in a text the sampled positions and the strings that name them."""

    def __init__(self, length: int = LENGTH, prefix: int = PREFIX):
        assert 0 < prefix <= length
        self.length, self.prefix = length, prefix
        self.values, self.base, inverse = _tables()
        self.powers, self.inverses = (self._powers(x, 4096) for x in (self.base, inverse))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        return np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)

    def _prefix_hashes(self, octets: np.ndarray) -> np.ndarray:
        if len(octets) > len(self.powers):
            n = 1 << (len(octets) - 1).bit_length()
            self.powers, self.inverses = self._powers(self.base, n), self._powers(pow(self.base, -1, 1 << 64), n)
        sums = np.cumsum(self.values[octets] * self.powers[: len(octets)], dtype=np.uint64)
        sums[self.prefix :] -= sums[: -self.prefix].copy()
        out = sums[self.prefix - 1 :] * self.inverses[: len(octets) - self.prefix + 1]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return out

    def _chunk(self, octets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first and last string of each sampled position."""
        hashes = self._prefix_hashes(octets)
        width = self.length - self.prefix + 1
        low = np.uint64((1 << 21) - 1)
        keys = (hashes | low) ^ low | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(keys) // width) * width, _mask, np.uint64)
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        strings = len(octets) - self.length + 1
        named = np.minimum(behind[:strings], ahead[width - 1 : width - 1 + strings]) & low
        first = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
        last = np.concatenate((first[1:] - 1, [strings - 1]))
        return hashes[named[first].astype(np.int64)], first, last

    def stretches(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(prefix rank, stretch rank, first string, last string), in order."""
        octets, view, parts = np.frombuffer(text, np.uint8), memoryview(text), []
        digest = xxhash.xxh3_64_intdigest
        for start in range(0, max(0, len(text) - self.length + 1), CHUNK):
            hashes, first, last = self._chunk(octets[start : start + CHUNK + self.length - 1])
            first, last = first + start, last + start
            ranks = np.fromiter((digest(view[a : b + self.length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
            parts.append((hashes, ranks, first, last))
        if not parts:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        return tuple(np.concatenate(x) for x in zip(*parts))


    def pairs(self, octets: np.ndarray, first: int, last: int) -> list[tuple[int, int, int, int]]:
        """(prefix rank, other rank, first string, last string) of the pairs that a stretch's strings hold."""
        start = max(0, last - OFFSET)
        hashes = self._prefix_hashes(octets[start : first + self.length + OFFSET])
        # The sampled position is in all strings, and so among these.
        low = np.uint64((1 << 21) - 1)
        place = last - start + int(np.argmin((hashes[last - start : first + self.length - self.prefix + 1 - start] | low)))
        rank, split, out = int(hashes[place]), start + place - OFFSET, []
        if first <= split:
            out.append((rank, int(hashes[place - OFFSET]), first, min(last, split)))
        if last > split:
            out.append((rank, ~int(hashes[place + OFFSET]) & _mask, max(first, split + 1), last))
        return out


def _first_in_task(columns: list[np.ndarray], ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by ranks, then place; and whether an earlier place in the batch has the same ranks.

    columns: the ranks, then document and offset.
    """
    order = np.lexsort(columns[::-1])
    sorted_ = [c[order] for c in columns]
    same = np.ones(len(order), bool)
    same[:1] = False
    for c in sorted_[:ranks]:
        same[1:] &= c[1:] == c[:-1]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    seen = np.zeros(len(order), bool)
    for c in sorted_[ranks:]:  # a repeated row of one document does not precede itself
        seen |= c != c[start]
    return order, seen & same


def _sent(columns: list[np.ndarray], dealt_by: int) -> pa.RecordBatch:
    """The rows that meet others by their two ranks, in the order of place, which packs well; dealt_by: the rank (0 or 1) that deals them out."""
    order, seen = _first_in_task(columns, 2)
    known = np.empty(len(seen), bool)
    known[order] = seen
    h, c, doc, at = columns
    # Repeats that are known here need no meeting with others: their runs are joined, and dealt out evenly.
    known_doc, known_at = doc[known], at[known]
    first = known_at >> _SPAN_BITS
    last = first + (known_at & ((1 << _SPAN_BITS) - 1))
    begins = np.ones(len(first), bool)
    begins[1:] = (known_doc[1:] != known_doc[:-1]) | (first[1:] != last[:-1] + 1)
    begin = np.flatnonzero(begins)
    run_doc, run_first, run_last = known_doc[begin], first[begin], last[np.append(begin[1:], len(last))[: len(begin)] - 1]
    spread = (run_doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ run_first.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    own = (spread, np.zeros(len(begin), np.uint64))
    sent = [
        np.concatenate((h[~known], own[dealt_by])).view(np.int64),
        np.concatenate((c[~known], own[1 - dealt_by])).view(np.int64),
        np.concatenate((doc[~known], run_doc)),
        np.concatenate((at[~known], run_first << _SPAN_BITS | (run_last - run_first))),
        np.repeat([False, True], [len(known) - len(first), len(begin)]),
    ]
    return pa.RecordBatch.from_arrays(list(map(pa.array, sent)), _SENT_NAMES)


def _stretch_batches(batches):
    sampler = Sampler()
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        parts = []
        for i, doc in enumerate(docs):
            h, c, first, last = sampler.stretches(texts[i].as_py())
            parts.append((h, c, np.full(len(h), doc, np.int64), first.astype(np.int64) << _SPAN_BITS | (last - first)))
        if not parts:
            continue
        yield _sent([np.concatenate(x) for x in zip(*parts)], 0)


def _pair_batches(batches):
    """Pairs of ranks; one that the batch holds more than once is known to be shared, and sent once under its own name."""
    sampler = Sampler()
    for batch in slices(batches, 1024):
        docs, texts, stretches = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
        rows = []
        for i, doc in enumerate(docs):
            octets = np.frombuffer(texts[i].as_py(), np.uint8)
            for at in sorted({x["at"] for x in stretches[i].as_py()}):
                first = at >> _SPAN_BITS
                found = sampler.pairs(octets, first, first + (at & ((1 << _SPAN_BITS) - 1)))
                rows += [(rank, other, doc, a << _SPAN_BITS | (b - a)) for rank, other, a, b in found]
        if not rows:
            continue
        h, c = (np.array([r[k] for r in rows], np.uint64) for k in (0, 1))
        doc, at = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
        order = np.lexsort((at, doc, c, h))
        h, c, doc, at = (x[order] for x in (h, c, doc, at))
        same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        known, shared = np.append(False, same), np.append(False, same) | np.append(same, False)
        spread = (doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ at.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        sent = [h.view(np.int64), np.where(known, spread, c).view(np.int64), doc, at, shared]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, sent)), _SENT_NAMES)


def _string_batches(batches):
    digest = xxhash.xxh3_64_intdigest
    for batch in slices(batches, 1024):
        docs, texts, stretches = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
        parts = []
        for i, doc in enumerate(docs):
            view = memoryview(texts[i].as_py())
            for at, h in sorted({(x["at"], x["h"]) for x in stretches[i].as_py()}):
                first, more = at >> _SPAN_BITS, at & ((1 << _SPAN_BITS) - 1)
                strings = range(first, min(first + more, len(view) - LENGTH) + 1)
                names = np.fromiter((digest(view[p : p + LENGTH]) for p in strings), np.uint64, len(strings))
                parts.append((np.full(len(names), h & _PART_OF_NAME, np.uint64), names, np.full(len(names), doc, np.int64), np.arange(first, first + len(names), dtype=np.int64) << _SPAN_BITS))
        if parts:
            yield _sent([np.concatenate(x) for x in zip(*parts)], 1)


def removed_spans(n: int, places: list[int] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal [start, end) runs that the strings at these packed places cover in a text of n bytes."""
    out: list[tuple[int, int]] = []
    for at in sorted(places or ()):
        first = at >> _SPAN_BITS
        start, end = first, min(n, first + (at & ((1 << _SPAN_BITS) - 1)) + length)
        if start >= end:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut_batches(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for part in slices(batches):
        texts, places = part.column(2).to_pylist(), part.column(3).to_pylist()
        spans = [removed_spans(len(t), p) for t, p in zip(texts, places)]
        kept = []
        for text, own in zip(texts, spans):
            edges = [0, *(x for span in own for x in span), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        listed = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
        yield pa.RecordBatch.from_arrays([part.column(1), pa.array(map(len, texts), pa.int64()), listed, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def repeated_places(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """(doc, at): packed places of strings that start earlier too. docs: (doc, doc_id, text as bytes); dealt: the same by doc."""
    sent = docs.select("doc", "text").mapInArrow(_stretch_batches, _SENT).repartition("h")
    by_rank, by_prefix = Window.partitionBy("h", "c"), Window.partitionBy("h")
    later = F.col("doc") > F.min("doc").over(by_rank)
    ranked = sent.select("h", "doc", "at", (F.col("seen") | later).alias("repeats"), (F.min("c").over(by_prefix) != F.max("c").over(by_prefix)).alias("mixed"))
    ranked = checkpoint(ranked.where("repeats or mixed").select(F.when(~F.col("repeats"), F.col("h")).alias("h"), "doc", "at"))
    with_text = lambda places: dealt.join(places.groupBy("doc").agg(F.collect_list(F.struct("at", "h")).alias("stretches")), "doc").select("doc", "doc_id", "text", "stretches")
    pairs = with_text(ranked.where("h is not null")).mapInArrow(_pair_batches, _SENT).repartition("h", "c")
    shared = pairs.select("h", "doc", "at", (F.col("seen") | (F.count("*").over(by_rank) > 1)).alias("shared")).where("shared")
    strings = with_text(shared).mapInArrow(_string_batches, _SENT).repartition("c")
    found = strings.select("doc", "at", (F.col("seen") | later).alias("repeats")).where("repeats").select("doc", "at")
    return ranked.where("h is null").select("doc", "at").union(found)


def _numbered(keyed: DataFrame) -> DataFrame:
    """keyed(doc, doc_id, text), with doc a number of its own for each different text, in the order of doc_id, where an id has several.

    Numbers come from range partitions and one count per partition, never from one task that sorts the table.
    """
    if keyed.groupBy("doc").count().where("count > 1").isEmpty():
        return keyed
    digest = F.xxhash64("text")
    ranged = checkpoint(keyed.select("doc", digest.alias("digest")).distinct().repartitionByRange("doc", "digest").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("doc", "digest"))
    numbers = ranged.withColumn("n", within).join(offsets, "part").select("doc", "digest", (F.col("n") + F.col("offset")).cast("long").alias("number"))
    return keyed.withColumn("digest", digest).join(numbers, ["doc", "digest"]).select(F.col("number").alias("doc"), "doc_id", "text")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of docs(doc_id, text).

    spans are the maximal [start, end) runs of bytes covered by a 100-byte string that also starts in a
    document with a smaller doc_id or earlier in the same one; kept is what is left, as bytes.
    A null text counts as empty, a text under 100 bytes keeps everything. Null doc_ids come after all others. Rows with
    one doc_id and different texts are documents of their own, in an order of their texts' hashes; rows that repeat id and text are one
    document, and do not repeat each other at the same offset. Other columns are ignored; an empty table gives an empty result.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("doc_id").cast("long"), utf8().alias("text"))
    keyed = _numbered(keyed)
    dealt = keyed.repartition("doc")  # all joins with the texts read this one exchange
    places = repeated_places(keyed, dealt).groupBy("doc").agg(F.collect_list("at").alias("places"))
    joined = dealt.join(places, "doc", "left").select("doc", "doc_id", "text", "places")
    return joined.mapInArrow(_cut_batches, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
