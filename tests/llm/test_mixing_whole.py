import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import mixing

SF = "/root/testdata/sf0.001"


def test_rare_domain_reaches_its_target(spark):
    rows = [(i, "plain words of a text") for i in range(998)] + [(998, "odd strange curious new lines"), (999, "odd strange curious new lines")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", F.when(F.col("doc_id") < 998, "a").otherwise("b").alias("domain"))
    mixed = mixing.mix(df, labels, {"a": 0.95, "b": 0.05})
    got = mixed.agg(F.sum(F.col("rate") * F.col("n_tokens") * F.col("posteriors")["b"]), F.max("rate")).first()
    assert got[0] == pytest.approx(0.05 * 5000, rel=2e-3) and got[1] > 20


def test_residual_of_a_target_out_of_reach_is_told(spark):
    members = spark.createDataFrame([(10.0, [1.0, 0.0]), (10.0, [0.5, 0.5])], "n double, p array<double>")
    moves, residual = mixing.fit_rates(members, [2.0, 18.0])
    rate = mixing.rated(moves, F.col("p"))
    got = members.select("n", "p", rate.alias("r")).collect()
    held = [sum(r.n * r.p[i] * r.r for r in got) for i in (0, 1)]
    assert residual.tolist() == pytest.approx([held[0] - 2, held[1] - 18]) and residual.max() > 1
    moves, residual = mixing.fit_rates(members, [20.0, 4.0])
    rate = mixing.rated(moves, F.col("p"))
    assert abs(residual).max() < 0.1


def test_clean_documents_stay_whatever_the_classifier_says(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = F.map_from_arrays(F.array(F.lit("good"), F.lit("low")), F.array(F.when(F.col("doc_id") % 2 == 0, 0.2).otherwise(0.01), F.lit(0.8)))
    monkeypatch.setattr(mixing, "mix", lambda d, *_: d.withColumns({"domain": F.lit("low"), "posteriors": none, "rate": F.lit(0.0)}))
    domain = {r.doc_id: r.domain for r in mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    want = {r.doc_id for r in docs.collect() if domain.get(r.doc_id, "good" if r.doc_id % 2 == 0 else "low") == "good"}
    assert {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()} == want


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "a b c", 7, 8, "x"), (2, None, 7, 8, "y"), (None, "d", 7, 8, "z")], "doc_id long, text string, p int, copies int, copy string")
    labels = spark.createDataFrame([(1, "a")], "doc_id long, domain string")
    mixed = mixing.mix(df, labels, {"a": 1.0})
    assert {(r.p, r.copies) for r in mixed.collect()} == {(7, 8)}
    many = mixing.copies(mixed.withColumn("rate", F.when(F.col("doc_id") == 1, 3.0).when(F.col("doc_id") == 2, 0.0)))
    assert many.columns == mixed.columns and sorted((r.doc_id, r.copy) for r in many.collect()) == [(1, "x")] * 3
