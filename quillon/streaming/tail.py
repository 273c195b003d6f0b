"""A statement log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import first_word_upper


def verbs(spark: SparkSession, path: str) -> DataFrame:
    """(verb, n) counted over all lines that have arrived in files under path."""
    given = spark.readStream.text(path).where(F.btrim("value") != "")
    return given.groupBy(first_word_upper(F.col("value")).alias("verb")).agg(F.count("*").alias("n"))


def follow(spark: SparkSession, path: str, checkpoint: str, name: str):
    """Starts the count into a memory table until all present files are read."""
    return verbs(spark, path).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
