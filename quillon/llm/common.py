"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a Python task, so that its memory does not follow the Arrow batch size.
ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the session names in spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a temporary folder of our own is used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffles and checkpoints that nothing refers to any more; it does so only after its driver has collected garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """What runs meanwhile hands its Python tasks Arrow batches of `rows` rows; batches of whole texts else take much memory, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(column: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that no given column has, in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
