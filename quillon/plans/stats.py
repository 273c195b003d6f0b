"""Counts and sizes of tables, as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_size(df: DataFrame) -> DataFrame:
    """(n_rows, size_bytes): bytes of all cells as text and of the column names; 0 for a table without rows."""
    names = sum(len(c.encode()) for c in df.columns)
    cells = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0)).cast("long")
    made = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(cells), F.lit(0)).alias("cells"))
    return made.select("n_rows", F.when(F.col("n_rows") > 0, F.col("cells") + names).otherwise(0).cast("long").alias("size_bytes"))


def catalog_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, size_bytes, index_count) of each table."""
    each = [table_size(df).select(F.lit(name).alias("name"), "n_rows", "size_bytes", F.lit(0).cast("long").alias("index_count")) for name, df in tables.items()]
    return reduce(DataFrame.unionAll, each)


def files_needed(n_bytes, file_bytes: int):
    """Files of about file_bytes that hold so many bytes, one at least."""
    return F.greatest(F.lit(1), F.ceil(n_bytes / file_bytes)).cast("long")
