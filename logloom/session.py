"""Make the package importable on the executors."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()
_scratch: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once for each application, unless their PYTHONPATH has it already."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        if ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            folder = tempfile.mkdtemp()
            shutil.make_archive(os.path.join(folder, "logloom"), "zip", ROOT, "logloom")
            sc.addPyFile(os.path.join(folder, "logloom.zip"))
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the place that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder does if driver and executors are one process; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "logloom-shared")
    path = f"{base.rstrip('/')}/logloom-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Tasks that list folders at most: Spark would have one for each folder, up to 10,000.
LISTING = 64


def few_listing_tasks(spark: SparkSession) -> SparkSession:
    """Have folders listed by ``LISTING`` tasks at most, a setting of the session: a followed folder is listed as long as its query lives."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.set(name, str(min(LISTING, int(spark.conf.get(name)))))
    return spark


@contextmanager
def shuffle_partitions(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, shuffles have at most so many partitions; a streaming query that is started within keeps that."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def clear(spark: SparkSession) -> int:
    """Delete the folders that :func:`scratch` has named for this application, and what was read from them: their number.

    For programs that go on; DataFrames that numbering, detection, scans and XML events gave before can't be read afterwards.
    """
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        system, at = filesystem(path)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)
    return len(paths)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """A file system that pyarrow opens, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
