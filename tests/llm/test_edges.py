"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, and given columns whose names the operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import bpe, chat, langid, lines, mixing, quality, queries, secrets, simhash, suffix, topk

SF = "/root/testdata/sf0.001"
INNER = "a b c d h m n p q r s t u v x at bin bits block body copy digest doc each end head hub hub0 id key line line_no low more n_lines name node number other own part piece places position query removed_doc rep root root0 row said seen spans start tokens base w words __doc __good __row".split()
NEW = "n_tokens domain posteriors rate removed_lines n_words kept quality_score base_failed given labelled_doc labelled_good".split()
PROSE = "the quick brown fox jumps over the lazy dog near the old river bank"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i % 997} runs" for i in range(30_000))
    texts = [None, "", " \n\t\n", PROSE, PROSE, f"{PROSE}\n{PROSE} again", "x" * 200_000, long, long + " end", "password: Zq8rT1vXw9LmN2", "naïve 漢字 \U0001f600 \x00 ok", "ÀÉ" * 60]
    rows = [(i + 1, "web" if i % 2 else None, "en" if i % 3 else None, t) for i, t in enumerate(texts)]
    rows += [(4, None, "en", PROSE), (None, None, None, None), (None, "web", "en", PROSE), (None, "web", "en", PROSE)]
    made = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    return made.withColumn("n_chars", F.char_length("text").cast("long")).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (8, None, 1), (8, 1, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "simhash": lambda d, _: simhash.near_duplicates(d),
    "suffix": lambda d, _: suffix.cut_repeats(d),
    "bpe": lambda d, _: bpe.encode_decode(d, queries.automaton()),
    "lines": lambda d, _: lines.dedup_lines(d, short_copies=True),
    "langid": lambda d, _: langid.identify(d, langid.fit(d)),
    "quality": lambda d, given: quality.judge(d, quality.fit(d, given)),
    "secrets": lambda d, _: secrets.scan(d),
    "mixing": lambda d, given: mixing.mix(d, mixing.label_domains(given), mixing.WEIGHTS),
    "copies": lambda d, _: mixing.copies(d.withColumn("rate", F.when(F.col("doc_id") > 4, 1.5))),
}


def rows_of(df, columns):
    return sorted(repr(r) for r in df.select(*columns).collect())


def with_inner(df):
    """df and the columns of INNER that it doesn't have, of different types."""
    lacking = [c for c in INNER if c not in df.columns]
    return df.select("*", *[(F.lit(k) if k % 2 else F.lit(f"given {k}")).alias(c) for k, c in enumerate(lacking)])


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_edge_rows_and_clashing_columns(spark, docs, labels, name):
    plain = OPERATORS[name](docs, labels)
    wide = OPERATORS[name](with_inner(docs), with_inner(labels))
    want = rows_of(plain, plain.columns)
    assert rows_of(wide, plain.columns) == want
    assert name == "copies" or len(want) == docs.count()
    if set(INNER) <= set(wide.columns):
        given = with_inner(docs).select(*INNER).first()
        assert {tuple(r) for r in wide.select(*INNER).collect()} == {tuple(given)}
    assert rows_of(OPERATORS[name](with_inner(docs).limit(0), labels.limit(0)), plain.columns) == []


def test_top_k_with_clashing_columns(spark):
    rows = [(50, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0]), (1, [1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan")]), (5, []), (None, [9.0]), (6, [3e5, 3e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0, 3), ["query_id", "rank", "vec_id", "score"])
    wide = with_inner(df).withColumns({"ints": F.lit(1), "theirs": F.lit(2), "score": F.lit(3), "rank": F.lit(4)})
    assert rows_of(topk.top_k(wide, F.col("vec_id") % 50 == 0, 3), ["query_id", "rank", "vec_id", "score"]) == want
    assert len(want) == 6 and any("vec_id=6" in r for r in want)


def test_chats_with_clashing_columns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "x" * 100_000), (1, 2, "bob", None), (1, 2, "bob", None), (None, None, None, ""), (2, 1, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    plain = chat.perspectives(df)
    want = rows_of(plain, plain.columns)
    assert rows_of(chat.perspectives(with_inner(df).withColumns({"speaker": F.lit(1), "content": F.lit(2)})), plain.columns) == want
    assert len(want) == 3


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows_and_clashing_columns(spark, docs, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    more = with_inner(docs).withColumns({c: F.lit(f"given {c}") for c in NEW})
    plain, wide = f(spark, docs, SF), f(spark, more, SF)
    assert rows_of(wide, plain.columns) == rows_of(plain, plain.columns)
    if stage != "tokenize":
        assert plain.columns == docs.columns and wide.columns == more.columns
        assert {tuple(r) for r in wide.select(*INNER, *NEW).collect()} == {tuple(more.select(*INNER, *NEW).first())}
    assert {r.doc_id for r in plain.collect()} <= {r.doc_id for r in docs.collect()}
