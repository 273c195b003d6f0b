"""The session that the library's defaults assume."""

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "quillon", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; further settings as keyword arguments with __ for dots."""
    made = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        made = made.config(key.replace("__", "."), value)
    return made.getOrCreate()


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names in spark.checkpoint.dir; only where it is unset (one machine, tests) to one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
