"""Shared storage for intermediate tables, and helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``.  Where neither that nor a
    checkpoint directory is set, a local session gets a temporary one and a
    cluster is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trackframe-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/trackframe/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again.

    This cuts the lineage and survives lost executors; the files stay until
    the shared folder is cleared, as the result may be read at any time.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = 16, most: int = 2000, least_rows: int = 20_000) -> DataFrame:
    """``left`` joined with ``right``, which has each key once, with the hot keys of ``left`` dealt over ``salts`` tasks.

    A key is hot if more than one in ``most`` of the rows of ``left`` have it,
    so at most ``most`` keys are broadcast.  The rows of a hot key are dealt by
    a hash of the ``spread`` columns; its row of ``right`` goes to each.
    ``left`` is read twice and so should be a stored table.  Tables of few
    rows are joined as they are.
    """
    rows = left.count()
    if rows < least_rows:
        return left.join(right, keys, how)
    least = max(1000, rows // most)
    hot = F.broadcast(left.groupBy(*keys).count().filter(F.col("count") > least).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    own = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    other = right.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return own.join(other, [*keys, "_salt"], how).drop("_salt")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with ``names`` that ``df`` has not got (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame, columns: list[str]):
    """A 64-bit hash of the named columns, in which nulls count as values."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in columns))


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in runs of few rows, so that a task holds few texts as Python objects; memory goes back in the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
