"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, lines, mixing, quality, simhash
from quillon.llm.common import table
from quillon.llm.queries import automaton

#: What the mixture is to hold, by domain, and its size in tokens against what comes in. The size is over one, so that good
#: documents are wanted at least once and it is the others that are thinned out.
WEIGHTS, BUDGET = {"good": 0.97, "low": 0.01, "toxic": 0.02}, 1.1
#: Documents without a label stay whose posterior of 'good' is not clearly below that of the others.
MAY_BE_GOOD = 0.05


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, `given`, so that no column that an operator adds or uses meets a given one."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("given"))


def _unpacked(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from rows that came from _packed."""
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col("given")[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the trees reject."""
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _unpacked(quality.judge(_packed(docs), trees).where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that nearly repeat an earlier one, and exact copies at any length; documents keep their rows, and n_chars follows the text."""
    done = _unpacked(lines.dedup_lines(_packed(docs), short_copies=True), docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the fitted rates say; one that is labelled 'good', or may be good, stays at least once."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(_packed(docs), labelled, WEIGHTS, BUDGET)
    labels = labelled.where(F.col("domain").isNotNull()).groupBy(F.col("doc_id").alias("labelled_doc")).agg(F.max(F.col("domain") == "good").alias("labelled_good"))
    known = mixed.join(labels, F.col("doc_id") == F.col("labelled_doc"), "left")
    good = F.coalesce("labelled_good", F.col("posteriors")["good"] >= MAY_BE_GOOD, F.lit(False)) | (F.col("domain") == "good")
    return _unpacked(mixing.copies(known.withColumn("rate", F.when(good, F.greatest("rate", F.lit(1.0))).otherwise(F.col("rate")))), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each document, and whether they decode to its text."""
    done = bpe.encode_decode(docs, automaton())
    return done.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: Trees, MinHash, components, fitted rates and tokens are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    root = os.path.join(shared, f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}_{name}")
        docs = spark.read.parquet(f"{root}/{k}_{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
