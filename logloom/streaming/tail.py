"""Following files that grow in place.

A streaming source polls a folder: its offset is, for each file, the epoch (one more with each rotation) and the size that was seen.  What was
added since is read as ranges of bytes, a large one by many tasks; a line belongs to the range that its end lies in, so a line that isn't finished
waits for its end.  Chunks of lines then pass a keyed state (lines and entries of each file so far, and where the next chunk has
to begin), which gives them their numbers; a chunk that comes before its predecessor is held back.  Nothing is rewritten in a batch but the
state of the files that grew.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.entries import COLUMNS
from ..operators.parsers import DEFAULT_TEMPLATE, parse_pattern
from ..session import few_listing_tasks, filesystem, shuffle_partitions
from ..sources.heads import list_files
from ..sources.lines import SUFFIXES, decode

#: A chunk of lines: where it begins, where the next one does, its lines, and those that aren't empty with their places in it.
CHUNK = "file string, path string, epoch long, at long, then long, n long, places array<int>, texts array<string>"
NUMBERED = "file string, path string, epoch long, lines long, entries long, places array<int>, texts array<string>"
#: Bytes of a task's range and of a chunk; bytes that are looked at at once to find where a line begins.
RANGE, CHUNK_BYTES, BACK = 64 << 20, 1 << 20, 1 << 16
#: Tasks that what was added is dealt to, as long as none of them has more than ``RANGE`` bytes.
TASKS = 64
#: A backlog is read in at most so many batches, each of at most so many files.
BATCHES, MOST_FILES = 4, 10_000
#: Shuffle partitions of a query, at most: each is a task, with a state of its own and a Python worker, of every batch, with input or without.
PARTITIONS = 16
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ranges(InputPartition):
    """Ranges (file, path, epoch, begin, end) that one task reads, one after the other."""

    def __init__(self, ranges: list[tuple[str, str, int, int, int]]):
        self.ranges = ranges


def polled(before: dict, sizes: dict[str, int]) -> dict:
    """The next offset: file -> (epoch, size).  A file that is smaller than it was seen was rotated; one that is gone keeps what it had."""
    now = dict(before)
    for file, size in sizes.items():
        epoch, seen = before.get(file, (0, 0))
        now[file] = (epoch + 1, size) if size < seen else (epoch, size)
    return now


def grown(before: dict, now: dict, size: int = RANGE) -> list[tuple[str, int, int, int]]:
    """Ranges (file, epoch, begin, end) of at most ``size`` bytes that were added between two offsets."""
    out = []
    for file, (epoch, end) in sorted(now.items()):
        old, seen = before.get(file, (0, 0))
        begin = seen if old == epoch else 0
        out += [(file, epoch, b, min(end, b + size)) for b in range(begin, end, size)]
    return out


def together(ranges: list[tuple[str, int, int, int]], size: int) -> list[list[tuple[str, int, int, int]]]:
    """The ranges in order, those of a task together: some ``TASKS`` lists, or more if these had over ``RANGE`` bytes, of ``size`` bytes at least."""
    most = max(size, min(RANGE, sum(end - begin for *_, begin, end in ranges) // TASKS))
    out, held = [], most
    for r in ranges:
        if held >= most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += r[3] - r[2]
    return out


def chunks(stream, begin: int, end: int, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, bytes) of the lines that end in a range of a file, some ``size`` bytes at a time, whole lines alone."""
    at = begin
    while at:  # back to where the first of those lines begins
        low = max(0, at - BACK)
        stream.seek(low)
        found = stream.read(at - low).rfind(b"\n")
        if found >= 0:
            at = low + found + 1
            break
        at = low
    stream.seek(at)
    held, read = b"", at
    while read < end:
        data = stream.read(min(size, end - read))
        if not data:
            break  # the file became smaller: the next poll sees it
        read += len(data)
        last = data.rfind(b"\n")
        if last < 0:
            held += data
            continue
        whole = held + data[: last + 1]
        yield at, at + len(whole), whole
        at, held = at + len(whole), data[last + 1 :]


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.state = options["path"], options["state"]
        self.encoding, self.size = options.get("encoding", "utf-8"), int(options.get("rangebytes", RANGE))
        system, path = filesystem(self.state)
        try:
            with system.open_input_stream(path) as f:
                self.seen = json.loads(f.read())
        except FileNotFoundError:
            self.seen = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, folder = filesystem(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        sizes = {f.base_name: f.size for f in found if f.is_file and f.extension.lower() in SUFFIXES}
        before, self.seen = self.seen, polled(self.seen, sizes)
        if self.seen != before:
            # so that a query which begins again knows what it has seen: Spark tells a source its offset only with a batch
            out, path = filesystem(self.state)
            out.create_dir(posixpath.dirname(path), recursive=True)
            with out.open_output_stream(path + ".new") as f:
                f.write(json.dumps(self.seen).encode())
            out.move(path + ".new", path)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return [Ranges([(file, posixpath.join(self.folder, file), *more) for file, *more in own]) for own in together(grown(start, end, self.size), self.size)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for own in partition.ranges:
            yield from self._read(*own)

    def _read(self, file: str, where: str, epoch: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(where)
        try:
            stream = system.open_input_file(path)
        except FileNotFoundError:
            return
        with stream:
            for begin, end, data in chunks(stream, low, high):
                text = decode(data[:-1], self.encoding)
                if not begin:
                    text = text.removeprefix(chr(0xFEFF))
                lines = [x.removesuffix("\r") for x in text.split("\n")]
                places = [i for i, x in enumerate(lines) if x]
                row = (file, where, epoch, begin, end, len(lines), places, [lines[i] for i in places])
                types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
                names = ["file", "path", "epoch", "at", "then", "n", "places", "texts"]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)


class GrowingFiles(DataSource):
    """Chunks of lines of the logs of a folder's top level, as they grow.

    Options: path, state (a file that keeps what was seen, beside the query's checkpoint), encoding (utf-8 or windows-1252), rangebytes.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return CHUNK

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader({k.lower(): v for k, v in self.options.items()})


class Numbers(StatefulProcessor):
    """State of a file: its epoch, where the next chunk begins, lines and entries before it, and chunks that came too early."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "epoch long, at long, lines long, entries long")
        self.early = handle.getMapState("early", "epoch long, at long", "path string, then long, n long, places array<int>, texts array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        epoch, at, lines, entries = self.place.get() if self.place.exists() else (0, 0, 0, 0)
        given = {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                given[r.epoch, r.at] = (r.path, r.then, r.n, list(r.places), list(r.texts))
        fresh = set(given)
        for k, v in self.early.iterator():
            given[k[0], k[1]] = tuple(v)
        out = []
        for k in sorted(given):
            # a chunk comes next if it begins where the last one ended, or begins a file that was rotated
            if not (k[0] >= epoch and k[1] == at or k[0] > epoch and k[1] == 0):
                continue
            path, then, n, places, texts = given.pop(k)
            if k not in fresh:
                self.early.removeKey(k)
            if k[0] > epoch:
                epoch, lines, entries = k[0], 0, 0
            out.append((key[0], path, epoch, lines, entries, list(places), list(texts)))
            at, lines, entries = then, lines + n, entries + len(texts)
        for k, v in given.items():
            if k in fresh and k > (epoch, at):  # what was numbered before isn't numbered again
                self.early.updateValue(k, v)
        self.place.update((epoch, at, lines, entries))
        if out:
            yield pd.DataFrame(out, columns=["file", "path", "epoch", "lines", "entries", "places", "texts"])

    def close(self) -> None:
        pass


def numbered(chunks_: DataFrame) -> DataFrame:
    """Lines of a stream of chunks (see :data:`CHUNK`): file, path, epoch, line_no, seq and line, numbered through all batches."""
    chunks_.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = chunks_.groupBy("file").transformWithStateInPandas(statefulProcessor=Numbers(), outputStructType=NUMBERED, outputMode="Append", timeMode="None")
    line = F.posexplode(F.arrays_zip("places", "texts")).alias("i", "x")
    return out.select("file", "path", "epoch", "lines", "entries", line).select("file", "path", "epoch", (F.col("lines") + F.col("x.places") + 1).alias("line_no"), (F.col("entries") + F.col("i")).alias("seq"), F.col("x.texts").alias("line"))


def growing_chunks(spark: SparkSession, folder: str, state: str, encoding: str = "utf-8", range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", folder).option("state", state).option("encoding", encoding).option("rangeBytes", str(range_bytes)).load()


def files_of_batch(spark: SparkSession, folder: str, least: int) -> int:
    """Files of a batch: ``least``, or more if there are so many files now that it would take more than ``BATCHES`` batches to read them.

    What a batch costs besides its rows is then paid a few times, however many files there are (beyond ``MOST_FILES`` a batch it grows with them).
    """
    if least >= MOST_FILES:
        return least
    return max(least, min(MOST_FILES, -(-list_files(spark, folder).count() // BATCHES)))


def segment_chunks(spark: SparkSession, folder: str, files_per_batch: int = 100, seen: DataFrame | None = None, name: Column | None = None) -> DataFrame:
    """Chunks of growth that someone else cuts into segments "name.N" (N from 0; ``name`` says where that stands if not in the file's name).

    A segment, which is what came between two polls, is one chunk.  ``files_per_batch`` is the least: see :func:`files_of_batch`.

    ``seen`` (file, poll_no, epoch) says which epoch a segment is of: see :func:`logloom.operators.alerts.epochs`.
    """
    rows = few_listing_tasks(spark).readStream.option("maxFilesPerTrigger", files_of_batch(spark, folder, files_per_batch)).text(folder, wholetext=True)
    name = F.col("_metadata.file_name") if name is None else name
    rows = rows.select(F.regexp_extract(name, r"^(.*)\.(\d+)\z", 1).alias("file"), F.col("_metadata.file_path").alias("path"), F.regexp_extract(name, r"\.(\d+)\z", 1).cast("long").alias("at"), F.regexp_replace("value", r"\n\z", "").alias("value"), (F.col("value") == "").alias("none"))
    if seen is None:
        rows = rows.withColumn("epoch", F.lit(0).cast("long"))
    else:
        seen = seen.select(F.col("file").alias("__f"), "poll_no", "epoch")
        rows = rows.join(seen, (F.col("file") == F.col("__f")) & (F.col("at") == F.col("poll_no")), "left").withColumn("epoch", F.coalesce("epoch", F.lit(0)).cast("long"))
    lines = F.when(F.col("none"), F.array().cast("array<string>")).otherwise(F.transform(F.split("value", "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", "")))
    rows = rows.withColumn("lines", lines)
    places = F.filter(F.transform("lines", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    return rows.select("file", "path", "epoch", "at", (F.col("at") + 1).alias("then"), F.size("lines").cast("long").alias("n"), places.cast("array<int>").alias("places"), F.filter("lines", lambda x: x != "").alias("texts"))


def begin(spark: SparkSession, writer: DataStreamWriter, checkpoint: str, every: str | None = None, partitions: int = PARTITIONS) -> StreamingQuery:
    """Start a query, of at most so many shuffle partitions (a checkpoint keeps those it began with), that stops when it has read what is there, or goes on."""
    writer = writer.option("checkpointLocation", checkpoint)
    with shuffle_partitions(spark, partitions):
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start(df: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return begin(df.sparkSession, df.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, every)


def follow_growing(spark: SparkSession, folder: str, out: str, checkpoint: str, template: str = DEFAULT_TEMPLATE, every: str | None = None, encoding: str = "utf-8", range_bytes: int = RANGE) -> StreamingQuery:
    """Parse what is added to the logs of a folder into the Parquet table ``out``: entries with their epoch.

    The view of a rotated file is its last epoch (:func:`logloom.operators.alerts.latest_epoch`).
    """
    lines = numbered(growing_chunks(spark, folder, f"{checkpoint.rstrip('/')}-seen/sizes.json", encoding, range_bytes))
    parsed = parse_pattern(lines.withColumn("file", F.struct("file", "epoch")), template)
    return start(parsed.select(*[c for c in COLUMNS if c != "file"], "file.file", "file.epoch"), out, checkpoint, every)
