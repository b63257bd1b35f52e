"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder does if driver and executors are one process (tests); on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return found or os.path.join(tempfile.gettempdir(), "logloom-shared")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back, so that it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/logloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fewer(df: DataFrame, rows: int, each: int) -> DataFrame:
    """Join partitions up (without a shuffle) where a table of so many rows has more of them than the cores and ``each`` rows ask for."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


#: Bytes of a batch that are Python's values at once.
SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of batches of some ``size`` bytes; what a worker's Arrow pool has kept goes back when its task ends, as workers live on."""
    try:
        for batch in batches:
            rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()


#: Rows of fixed width (some 60 bytes each) that are sent to every task.
BROADCAST = 100_000


def bounded(df: DataFrame) -> DataFrame:
    """A side of a join with thin rows: sent to every task if it has at most ``BROADCAST`` rows, else shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
