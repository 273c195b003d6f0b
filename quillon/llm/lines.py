"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

A line is compared in lower case without outer white space; lines under MIN_CHARS are too short for similarity to tell them apart, and
only their exact copies can go (`short_copies`). Similarity is the Jaccard index of the sets of shingles of five characters
(UTF-16 units), and lines at 0.8 or more are linked.

* signature: all shingles of the whole line, hashed on a ring of 64-bit values. Each band starts at a
  fixed point of the ring and takes the next seven hashes: minima under one ordering, which
  two lines share with about the seventh power of their similarity. By calculation, lines at exactly 0.8 share one of the 16 bands
  with 0.977, lines at 0.85 with 0.998;
* banding: lines meet on a band's hash. A bucket's lines are paired with one of them, its hub, the same in all bands that
  a group shares; then, where lines of a bucket are not tied to each other, with FURTHER_HUBS more that are drawn for each
  band. What these leave untied is settled without loss: in a bucket of up to ALL_PAIRS lines every untied pair is looked at, in a
  larger one every untied pair that shares one of its rarest shingles, which lines at SIMILARITY cannot fail to do (prefix
  filter). So two similar lines of a bucket always end up in one component;
* verification: the exact Jaccard index of each pair's full shingle sets;
* distributed union-find over the verified pairs. Of each component the first line stays (smallest
  doc_id, then line number), all others go.

Bands name a line by a hash of 64 bits; what is linked and removed is named by 128 bits, so that unlike lines are not taken for copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, fresh, release
from quillon.llm.components import components

MIN_CHARS = 24
SHINGLE = 5
SIMILARITY = 0.8
#: Bands are a power of two, so that a hash's low bits are its place within its band's part of the ring.
BANDS, BAND_ROWS = 16, 7
#: Hubs that are drawn for a bucket whose lines the first one does not tie.
FURTHER_HUBS = 3
#: A bucket with more lines, and more untied pairs a line, is settled by shared rare shingles in place of all its pairs; both ways are exact.
ALL_PAIRS, PAIRS_PER_LINE = 32, 1024
#: Places that a line's shingles fall on, of which the parities are compared, and earlier shingles that tell whether a pair was found at one of them.
PLACES, BEFORE = 1024, 3


def split_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, line, id, more) of the lines with min_chars or more; id and more are 64 bits of hash each."""
    # In lower case before it is split: the filter on lengths is moved below and would do it again.
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", F.btrim("line", F.lit(" \t\r\x0b\x0c")).alias("line")).where(F.char_length("line") >= min_chars)
    return lines.withColumn("id", F.xxhash64("line")).withColumn("more", F.xxhash64(F.lit(1), "line"))


def shingle_hashes(line: Column) -> Column:
    """The hash of each window of SHINGLE characters; of the whole line, where it is shorter. Read from a fixed-width form, where a window is found at once."""
    width = 2 * SHINGLE
    windows = lambda u: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(u) - width + 1), F.lit(2)), lambda i: F.xxhash64(F.substring(u, i, F.lit(width))))
    return F.transform(F.array(F.encode(line, "UTF-16BE")), windows)[0]


def _bands(lines: DataFrame) -> DataFrame:
    """(id, band) for each line and band; copies of a line repeat its rows. Sets and orders stay outside of lambdas, where Spark compiles them."""
    starts = [-(1 << 63) + ((1 << 64) // BANDS) * k for k in range(BANDS)]
    made = lines.select("id", F.sort_array(F.array_distinct(shingle_hashes(F.col("line")))).alias("h"))
    # A start's place among the sorted hashes and starts, less the starts before it, is that of the first hash from there on.
    made = made.select("id", F.concat("h", F.slice("h", 1, BAND_ROWS)).alias("ring"), F.sort_array(F.concat("h", F.array(*[F.lit(s) for s in starts]))).alias("marked"))
    keys = [F.xxhash64(F.slice("ring", (F.array_position("marked", s) - k).cast("int"), BAND_ROWS), F.lit(k)) for k, s in enumerate(starts)]
    return made.select("id", F.explode(F.array(*keys)).alias("band"))


def buckets(lines: DataFrame) -> DataFrame:
    """(band, id, hub, n) of the different lines that share a band's hash with another; hub is the smallest of them, n counts the lines, copies included."""
    dealt = _bands(lines).repartition("band")
    hubs = dealt.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("high"), F.count("*").alias("n")).where("hub < high").select("band", "hub", "n")
    return dealt.join(hubs.hint("shuffle_hash"), "band").select("band", "id", "hub", "n").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of full ids whose similarity is SIMILARITY or more."""
    full = F.struct("id", "more")
    x, y = texts.select(F.col("id").alias("a"), full.alias("full_a"), F.col("line").alias("x")), texts.select(F.col("id").alias("b"), full.alias("full_b"), F.col("line").alias("y"))
    sets = pairs.join(x, "a").join(y, "b").select("full_a", "full_b", F.array_distinct(shingle_hashes(F.col("x"))).alias("x"), F.array_distinct(shingle_hashes(F.col("y"))).alias("y"))
    sizes = sets.select("full_a", "full_b", F.size("x").alias("x"), F.size("y").alias("y"), F.size(F.array_intersect("x", "y")).alias("both"))
    # Through explode, as a filter would be moved below the sets and compute them once more.
    alike = sizes.select("full_a", "full_b", F.explode(F.array(F.col("both") / (F.col("x") + F.col("y") - F.col("both")))).alias("jaccard"))
    return alike.where(F.col("jaccard") >= SIMILARITY).select(F.col("full_a").alias("a"), F.col("full_b").alias("b"))


def _pairs(df: DataFrame) -> DataFrame:
    """The different pairs (a, b) of id and other, the smaller first."""
    return df.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _placed(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(band, id, root, lines, untied, main) of the buckets whose lines, the hub aside, are of more than one class; `lines` counts them, `untied` the pairs of different classes, and `main` is the largest class."""
    roots = classes.select(F.col("node.id").alias("id"), F.col("root.id").alias("root"))
    placed = checkpoint(met.where("n > 2 AND id <> hub").select("band", "id").join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root")))
    held = placed.groupBy("band", "root").agg(F.count("*").alias("held")).groupBy("band")
    untied = (F.sum("held") * F.sum("held") - F.sum(F.col("held") * F.col("held"))) / 2
    mixed = held.agg(F.sum("held").alias("lines"), untied.alias("untied"), F.max_by("root", F.struct("held", "root")).alias("main")).where("untied > 0")
    return placed.join(mixed, "band").select("band", "id", "root", "lines", "untied", "main")


def _sketches(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n, odd) of the lines of placed: the number of a line's shingles and, for each of PLACES places, whether an odd number of them falls there, in longs."""
    shingles = placed.select("id").distinct().join(texts, "id").select("id", "more", F.explode(F.array_distinct(shingle_hashes(F.col("line")))).alias("h"))
    counted = shingles.groupBy("id", "more").agg(F.count("*").alias("n"), *[F.bit_xor(x).alias(f"odd{k}") for k, x in enumerate(_places(F.col("h")))])
    return counted.select("id", "n", F.array(*[f"odd{k}" for k in range(PLACES // 64)]).alias("odd"))


def _may_be_alike(n: Column, odd: Column, m: Column, other_odd: Column) -> Column:
    """False only for lines below SIMILARITY: sets of n and m shingles at 4/5 differ in (n + m) / 9 of them at most, and in at least as many as parities."""
    differ = sum(F.bit_count(F.get(odd, F.lit(k)).bitwiseXOR(F.get(other_odd, F.lit(k)))) for k in range(PLACES // 64))
    return (4 * m <= 5 * n) & (4 * n <= 5 * m) & (9 * differ <= n + m)


def _drawn(placed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of each line with the hubs that are drawn for its bucket, but for those it is tied to or cannot be like."""
    orders = [F.xxhash64("id", "band", F.lit(k)) for k in range(FURTHER_HUBS)]
    drawn = placed.groupBy("band").agg(*[F.min_by(F.struct(F.col("id").alias("other"), F.col("root").alias("other_root")), o).alias(f"hub{k}") for k, o in enumerate(orders)])
    hubs = drawn.select("band", F.explode(F.array_distinct(F.array(*[f"hub{k}" for k in range(FURTHER_HUBS)]))).alias("hub"))
    pairs = _pairs(placed.join(hubs, "band").select("id", "root", "hub.*").where("root <> other_root"))
    x, y = sketches.select(F.col("id").alias("a"), "n", "odd"), sketches.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("odd").alias("other_odd"))
    return pairs.join(x, "a").join(y, "b").where(_may_be_alike(*map(F.col, ("n", "odd", "m", "other_odd")))).select("a", "b")


def _all_untied(placed: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs (a, b) of lines of one bucket that are of different classes and may be alike. Lines of a bucket's main class meet the others only."""
    lines = placed.join(sketches, "id").withColumn("in_main", F.col("root") == F.col("main"))
    other = lines.select("band", F.col("id").alias("other"), F.col("root").alias("other_root"), F.col("in_main").alias("other_in_main"), F.col("n").alias("m"), F.col("odd").alias("other_odd"))
    met = lines.where("NOT in_main").join(other, "band").where("root <> other_root AND (other_in_main OR id < other)")
    return _pairs(met.where(_may_be_alike(*map(F.col, ("n", "odd", "m", "other_odd")))))


def _places(h: Column) -> list[Column]:
    """For each long of a sketch the bit that a hash sets in it, if any."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright(h, 6).bitwiseAND(F.lit(PLACES // 64 - 1))
    return [F.when(word == k, one).otherwise(F.lit(0).cast("long")) for k in range(PLACES // 64)]


def _parities(h: Column, order: WindowSpec) -> Column:
    """Of a line's set of hashes, one a row, how many fall on each of PLACES places, as even or odd, in longs. Two sets differ in at least as many hashes as places."""
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.array(*[F.bit_xor(x).over(whole) for x in _places(h)])


def _rare_shingles(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, h, root, n, odd, place, most, before0, ...) of each line's rarest shingles that lines of other classes hold as well, with those before them."""
    lines = placed.select("id", "root").distinct().join(texts, "id").select("id", "root", F.array_distinct(shingle_hashes(F.col("line"))).alias("h"))
    shingles = lines.select("id", "root", F.size("h").alias("n"), F.explode("h").alias("h"))
    held = shingles.groupBy("h", "root").agg(F.count("*").alias("held")).groupBy("h").agg(F.sum("held").alias("times"), F.max_by("root", "held").alias("most"), F.count("*").alias("classes"))
    order = Window.partitionBy("id").orderBy("times", "h")
    first = shingles.join(held, "h").withColumns({"place": F.row_number().over(order), "odd": _parities(F.col("h"), order)})
    first = first.where("place <= floor(n / 5) + 1 AND classes > 1")
    before = [F.lag("h", k + 1).over(order).alias(f"before{k}") for k in range(BEFORE)]
    return first.select("id", "h", "root", "n", "odd", "place", (F.col("root") == F.col("most")).alias("most"), *before)


def _rare_untied(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines of different classes, among them all at SIMILARITY, or 4/5, or more.

    Two sets of n <= m shingles at 4/5 share 4/9 of n + m of them: at least 8/9 of n, and 4/5 of m. In any one order they so share one of
    the first n/9 + 1 of the smaller and m/5 + 1 of the larger, rounded down. The order is from rare to frequent, so that what many lines hold is not met
    on. The largest class of a shingle is not paired with itself. Such sets differ in (n + m) / 9 shingles at most, and all that come before the first
    shared one are different. So a pair need be found at its first shared shingle only: it is left out where one of the BEFORE shingles
    before is shared already, or where the places, or the parities, tell more shingles apart. None of it loses a pair.
    """
    first = _rare_shingles(placed, texts)
    before, other_before = [f"before{k}" for k in range(BEFORE)], [f"other_before{k}" for k in range(BEFORE)]
    # One join: what is not of the largest class meets all, at side 0; what is of it meets the others only, at side 1.
    smaller = first.where("place <= floor(n / 9) + 1").withColumn("side", F.col("most").cast("int"))
    larger = first.withColumn("side", F.explode(F.when(F.col("most"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    larger = larger.select("h", "side", F.col("id").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("m"), F.col("odd").alias("other_odd"), F.col("place").alias("other_place"), *[F.col(b).alias(f"other_{b}") for b in before])
    met = smaller.join(larger, ["h", "side"]).where("root <> other_root AND n <= m AND 4 * m <= 5 * n AND 9 * (place + other_place - 2) <= n + m")
    for b in before:
        met = met.where(~F.coalesce(F.col(b).isin(*[F.col(o) for o in other_before]), F.lit(False)))
    return _pairs(met.where(_may_be_alike(*map(F.col, ("n", "odd", "m", "other_odd")))))


def _linked(lines: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Verified pairs (a, b) of full ids from hubs; the classes (node, root) that these make; verified pairs of what they leave untied in a bucket."""
    met = checkpoint(buckets(lines))
    release(lines)
    texts = checkpoint(lines.select("id", "more", "line").join(met.select("id").distinct().hint("shuffle_hash"), "id").dropDuplicates(["id", "more"]))
    release(lines)
    found = checkpoint(_verified(_pairs(met.where("id <> hub").withColumnRenamed("hub", "other")), texts))
    classes = components(found, "a", "b")
    release(lines)
    placed = _placed(met, classes)
    sketches = checkpoint(_sketches(placed, texts))
    further = checkpoint(_verified(_drawn(placed, sketches), texts))
    if further.first() is not None:
        classes = components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).union(further), "a", "b")
    release(lines)
    placed = checkpoint(_placed(met, classes))
    release(lines)
    few = (F.col("lines") <= ALL_PAIRS) | (F.col("untied") <= PAIRS_PER_LINE * F.col("lines"))
    small, large = placed.where(few), placed.where(~few)
    left = _all_untied(small, sketches)
    if large.first() is not None:
        left = left.union(_rare_untied(large, texts)).distinct()
    return [found, further], classes, checkpoint(_verified(left, texts))


def similar(lines: DataFrame) -> DataFrame:
    """Pairs (a, b) of full ids of similar lines that tie together all similar lines of each bucket."""
    (found, further), _, rest = _linked(lines)
    return found.union(further).union(rest)


def similar_classes(lines: DataFrame) -> DataFrame:
    """(node, root) of the components of similar(lines), by full id."""
    _, classes, rest = _linked(lines)
    release(lines)
    if rest.first() is None:
        return classes
    return components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest), "a", "b")


def removed_lines(docs: DataFrame, short_copies: bool = False) -> DataFrame:
    """(doc_id, line_no) of the lines that go; with `short_copies` also exact copies of lines under MIN_CHARS that are not blank."""
    given = docs.select(F.col("doc_id").cast("long"), "text")
    lines, placed = split_lines(given), split_lines(given, 1 if short_copies else MIN_CHARS)
    rooted = similar_classes(lines).select("node.id", "node.more", "root")
    places = placed.select("doc_id", "line_no", "id", "more").join(rooted, ["id", "more"], "left").select("doc_id", "line_no", F.coalesce("root", F.struct("id", "more")).alias("root"))
    first = places.groupBy("root").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return places.join(first, "root").where(F.struct("doc_id", "line_no") != F.col("first")).select("doc_id", "line_no")


def removed_by_document(docs: DataFrame, short_copies: bool = False) -> DataFrame:
    """(doc_id, removed_lines) of the documents that lose lines; a list is bounded by its document."""
    return removed_lines(docs, short_copies).groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed_lines"))


def dedup_lines(docs: DataFrame, short_copies: bool = False) -> DataFrame:
    """docs with the lines removed that repeat an earlier one, and a column `removed_lines` (array<int>, 0-based).

    A null text stays null; blank lines stay, and so do short lines unless `short_copies` is set. Rows with a null doc_id take no part and
    stay as they are. Rows that repeat a doc_id are one document: they do not repeat each other's lines of the same
    number, and lose the same line numbers. A document may end up with no line, and then has an empty text. All
    columns of docs are kept, but for one named `removed_lines`, which is replaced; an empty table gives an empty result.
    """
    given = [c for c in docs.columns if c != "removed_lines"]
    key = fresh(docs.columns, "removed_doc")
    gone = removed_by_document(docs, short_copies)
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("removed_lines", i))
    joined = docs.select(*given).join(gone.withColumnRenamed("doc_id", key), F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    text = F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in given], F.array_sort(F.coalesce("removed_lines", F.array().cast("array<int>"))).alias("removed_lines"))
