"""The first bytes of many files, for format detection: what is read grows with the number of files, not with their sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import few_listing_tasks, filesystem
from .lines import SAMPLE, decide_encoding, decode

#: Bytes of a file that are read, and files of a task.
HEAD, FILES = 1 << 20, 200
HEADS = "file string, path string, size long, n_read long, encoding string, line_no long, line string"


def _heads(most: int, lines: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                system, at = filesystem(path)
                with system.open_input_stream(at, buffer_size=0) as f:
                    data = f.read(min(most, size))
                label, mark = decide_encoding(data[:SAMPLE], size <= SAMPLE)
                text = decode(data[mark:], label)
                found = text.split("\n")
                if len(data) < size and len(found) > 1:
                    found.pop()  # cut in the middle
                name = path.rstrip("/").rsplit("/", 1)[-1]
                out += [(name, path, size, len(data), label, i, x.removesuffix("\r")) for i, x in enumerate(found[:lines], 1)]
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            names = ("file", "path", "size", "n_read", "encoding", "line_no", "line")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names)

    return work


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """path, length and modificationTime of files; no byte of them is read."""
    reader = few_listing_tasks(spark).read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "modificationTime")


def read_heads(spark: SparkSession, path: str | list[str], glob: str | None = None, most: int = HEAD, lines: int = 200, files: DataFrame | None = None) -> DataFrame:
    """The first ``lines`` lines within the first ``most`` bytes of each file: file, path, size, n_read (bytes), encoding, line_no, line.

    A line that is cut at the limit is left out, unless it is the only one; an empty file has none.  One
    task reads the heads of some hundreds of files.  The files' store is one that pyarrow opens (local or mounted folders, HDFS, S3, GCS).
    """
    found = list_files(spark, path, glob) if files is None else files
    n = found.count()
    return found.select("path", "length").repartition(max(1, -(-n // FILES))).mapInArrow(_heads(most, lines), HEADS)
