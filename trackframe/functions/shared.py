"""Storage of intermediate tables of iterative operators, and of values within array functions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder.

    The folder is that of ``spark.checkpoint.dir``; where neither it nor a
    checkpoint directory is set, a local session gets a temporary one and a
    cluster is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trackframe-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/trackframe/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` computed once, written to the shared checkpoint folder and read again, which cuts its lineage.

    A written table is computed once, where ``checkpoint()`` would compute it
    twice, and its files survive lost executors.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once within an array function."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
