import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quillon.llm import lines, simhash
from quillon.llm.common import ROWS
from test_lines_chat import brute_pairs, brute_removed, words

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        given = {r.doc_id: r.text for r in now.collect()}
        done = stage(spark, now, SF)
        rows = done.collect()
        if name != "tokenize":
            assert done.columns == docs.columns
        ids = {r.doc_id for r in rows}
        assert ids <= set(given)
        clean = [i for i in given if labels.get(i) == (1, 0)]
        if name == "quality_rules":
            assert len([i for i in clean if i in ids]) > 0.9 * len(clean)
        elif name == "line_dedup":
            assert ids == set(given) and all(len(r.text) <= len(given[r.doc_id]) and r.n_chars == len(r.text) for r in rows)
        elif name == "mix_sources":
            assert len([i for i in clean if i in ids]) >= 0.98 * len(clean)
        else:
            assert name == "near_dedup" or all(r.round_trip for r in rows)
        now = spark.createDataFrame(rows, done.schema)
        seen.append(len(rows))
    assert seen[-1] == seen[-2] > 0


def test_registered():
    made = __spark_entry__.queries()
    assert made["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert len([k for k in made if k.startswith(f"op{n}_")]) == 1


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_empty_tables(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, SF).count() == 0


def test_line_dedup_loses_no_link_of_a_bucket(spark, monkeypatch):
    """Ten pairs of similar lines among 60 unlike ones, all in one bucket."""
    rng = random.Random(23)
    texts = [words(rng, 12) for _ in range(60)]
    for _ in range(10):
        own = words(rng, 16)
        texts += [own, f"{own} {words(rng, 1)}"]
    rows = [(k, x, "s", "en", len(x)) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    every = lambda made: made.select("id").distinct().crossJoin(made.agg(F.min("id").alias("hub"), F.count("*").alias("n"))).select(F.lit(7).cast("long").alias("band"), "id", "hub", "n")
    monkeypatch.setattr(lines, "buckets", every)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    gone = {doc for doc, _ in brute_removed(list(enumerate(texts)), brute_pairs(texts))}
    assert len(gone) == 10 and got == {k: "" if k in gone else x for k, x in enumerate(texts)}


def test_near_dedup_hands_python_small_batches(spark, monkeypatch):
    """Whole texts in batches of Spark's 10,000 rows took an executor beyond its memory."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([batch.num_rows] * batch.num_rows, pa.int64())], ["doc_id", "fp"])

    monkeypatch.setattr(simhash, "_fingerprint_batches", sizes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert simhash.near_duplicates(docs).agg(F.max("fp")).first()[0] <= ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
