"""Secrets in texts, in DataFrame operations only: fixed patterns, then a battery of randomness tests.

The battery takes the long tokens that no fixed pattern covers, infers their encoding, and tests whether their
characters could be drawn evenly and independently from its alphabet: chi-squared uniformity, runs above and below the
alphabet's middle, and serial correlation. A token is ordinary text where randomness is rejected. Rejections are
controlled at a false discovery rate over all tokens of the corpus, with weights by length:
short tokens, on which the tests have little power, are rejected more readily. What is not rejected is a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed, and the fewest characters.
_ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = r"AKIA[A-Z0-9]+"
_HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
#: Runs of under 24 or 20 characters cannot pass, and what follows within such a run is shorter still.
_LONG_ACCESS, _LONG_HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"

#: Tokens that the battery takes, the length up to which rejection is made easier, and the rate.
_TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_PLAIN_LENGTH = 48
RATE = 0.05
_BINS = 2000
#: Alphabets of the encodings.
_HEX_LOWER, _HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SPANS = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, as array<struct<start, end, value>> in code points."""
    none = F.array().cast(_SPANS)
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    step = lambda a, x: F.when(
        x["value"].isNotNull(),
        F.struct(
            (a["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.char_length(x["gap"])).alias("start"), (a["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("end"), x["value"].alias("value")))).alias("out"),
        ),
    ).otherwise(a)
    found = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """About 1 - Phi(z), by the logistic fit 1.5976 z + 0.070566 z^3."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def randomness(token: Column) -> Column:
    """p-value of the battery for a token: small where it is not evenly and independently drawn."""
    bare = F.rtrim(token, F.lit("="))
    alphabet = (
        F.when(bare.rlike("^[0-9a-f]+$"), _HEX_LOWER)
        .when(bare.rlike("^[0-9A-F]+$"), _HEX_UPPER)
        .when(bare.rlike("^[A-Z2-7]+$"), _BASE32)
        .when(bare.rlike("^[A-Za-z0-9]+$"), _ALNUM)
        .when(bare.rlike("^[A-Za-z0-9+/]+$"), _ALNUM + "+/")
        .otherwise(_ALNUM + "-_+/")
    )
    # One-element arrays bind what the lambdas below use for every character.
    bind = lambda struct, f: F.transform(F.array(struct), f)[0]
    places = lambda s: F.transform(F.split(s["bare"], ""), lambda c: F.instr(s["alphabet"], c).cast("double"))
    mean = lambda s: F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + v) / s["n"]
    return bind(
        F.struct(bare.alias("bare"), alphabet.alias("alphabet")),
        lambda t: bind(
            F.struct(places(t).alias("x"), F.char_length(t["alphabet"]).cast("double").alias("m"), F.char_length(t["bare"]).cast("double").alias("n")),
            lambda s: bind(F.struct(s["x"].alias("x"), s["m"].alias("m"), s["n"].alias("n"), mean(s).alias("mean")), lambda u: _battery(u["x"], u["m"], u["n"], u["mean"])),
        ),
    )


def _battery(x: Column, m: Column, n: Column, centre: Column) -> Column:
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    squares = total(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda w: w == v)).cast("double"), F.lit(2.0)))
    k = m - 1
    chi = squares * m / n - n
    uniform = _normal_tail((F.pow(F.greatest(chi, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)))

    pairs = F.arrays_zip(F.slice(x, F.lit(1), (n - 1).cast("int")).alias("a"), F.slice(x, F.lit(2), (n - 1).cast("int")).alias("b"))
    high = F.size(F.filter(x, lambda v: v > m / 2)).cast("double")
    runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] > m / 2) != (p["b"] > m / 2))).cast("double")
    mean = 1 + 2 * high * (n - high) / n
    spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
    run = F.when(spread > 1e-6, 2 * _normal_tail(F.abs((runs - mean) / F.sqrt(spread)))).otherwise(F.lit(0.0))

    power = total(x, lambda v: (v - centre) * (v - centre))
    lagged = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - centre) * (p["b"] - centre))
    serial = F.when(power > 0, 2 * _normal_tail(F.abs((lagged / power + 1 / n) * F.sqrt(n)))).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), 3 * F.least(uniform, run, serial))


def _base(text: Column) -> Column:
    assign = F.filter(matches(text, _ASSIGN), lambda s: F.char_length(F.regexp_extract(s["value"], _ASSIGN, 2)) >= 6)
    kinds = [assign, matches(text, _LONG_ACCESS), matches(text, _LONG_HEX)]
    return F.struct(*[k.alias(name) for k, name in zip(kinds, KINDS)])


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Add `secrets`: array<struct<start, end, kind, value>> in code points, by start, then kind as listed in KINDS.

    A null or empty text has none. Kinds may overlap each other, but for 'random', which lies outside of the others.
    All columns of docs are kept; one named `secrets` is replaced; rows repeat as given; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    given = [c for c in docs.columns if c not in ("secrets", "text")]
    found = docs.select(F.struct(*given, "text").alias("row"), text.alias("t")) if given else docs.select(F.struct("text").alias("row"), text.alias("t"))
    found = found.withColumn("base", _base(F.col("t"))).withColumn("tokens", matches(F.col("t"), _TOKEN)).drop("t")
    covered = F.concat(*[F.transform(f"base.{k}", lambda s: F.struct(s["start"], s["end"])) for k in KINDS[:3]])
    free = F.filter("tokens", lambda s: ~F.exists(covered, lambda c: (c["start"] < s["end"]) & (s["start"] < c["end"])))
    weight = lambda s: F.greatest(F.lit(1.0), F.lit(float(_PLAIN_LENGTH)) / F.char_length(s["value"]))
    tested = F.transform(free, lambda s: F.struct(s["start"], s["end"], s["value"], (randomness(s["value"]) / weight(s)).alias("p")))
    found = found.withColumn("tokens", tested)

    # Benjamini and Hochberg over bins of the weighted p-values: one small row per bin, whatever the corpus.
    upper = F.ceil(F.least(F.lit(1.0), F.col("p")) * _BINS)
    tokens = found.select(F.explode("tokens").alias("x")).select("x.p", weight(F.col("x")).alias("w"))
    bins = tokens.groupBy(upper.cast("int").alias("bin")).agg(F.count("*").alias("count"), F.sum("w").alias("w")).orderBy("bin").collect()
    total, running, limit = sum(r["count"] for r in bins), 0, -1.0
    mean = sum(r["w"] for r in bins) / max(1, total)  # weights average 1 when divided by it, as the control of the rate asks
    for r in bins:
        running += r["count"]
        if r["bin"] / _BINS * mean <= rate * running / total:
            limit = r["bin"] / _BINS
    random = F.transform(F.filter("tokens", lambda s: s["p"] > limit), lambda s: F.struct(s["start"], s["end"], s["value"]))

    def tagged(spans: Column, order: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(KINDS[order]).alias("kind"), s["value"].alias("value")))

    every = [tagged(spans, i) for i, spans in enumerate([*(F.col(f"base.{k}") for k in KINDS[:3]), random])]
    secrets = F.transform(F.sort_array(F.concat(*every)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return found.select("row.*", secrets.alias("secrets"))
