"""Statement logs: their lines as rows, and the tables that replaying them gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import first_word_upper, split_list


def lines(spark, path: str) -> DataFrame:
    """(line_no, statement) of a log; each file is numbered by itself, as logs are replayed file by file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n", -1)).alias("line_no", "statement")).where(F.btrim("statement") != "")


def parsed(statements: DataFrame) -> DataFrame:
    """Adds verb, target and items (the trimmed list in parentheses) to (line_no, statement)."""
    bare = F.regexp_replace("statement", r";\s*$", "")
    inner = F.regexp_extract(bare, r"\((.*)\)", 1)
    target = F.regexp_extract(bare, r"^\s*\S+\s+\S+\s+([^\s(]+)", 1)
    return statements.select("line_no", "statement", first_word_upper(bare).alias("verb"), target.alias("target"), split_list(inner).alias("items"))


def replayed(statements: DataFrame) -> DataFrame:
    """(target, line_no, items) of the rows that replaying the log inserts.

    A first CREATE makes a table; INSERTs into tables that were made before, with as many items as columns, add a row. All other lines
    have no effect. One window per table decides this; the log's order is that of line_no.
    """
    given = parsed(statements)
    made = given.where("verb = 'CREATE'").groupBy("target").agg(F.min("line_no").alias("made_at"), F.min_by(F.size("items"), "line_no").alias("n_columns"))
    return given.where("verb = 'INSERT'").join(made, "target").where((F.col("line_no") > F.col("made_at")) & (F.size("items") == F.col("n_columns"))).select("target", "line_no", "items")
