"""Sources of log lines: text files, folders, archives, other encodings, tables.

Lines end with a line feed alone; one carriage return before it is dropped; empty lines are counted but left out.
"""

from __future__ import annotations

import codecs
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import few_listing_tasks, filesystem, scratch

SUFFIXES = ("log", "txt", "out", "json", "csv", "gc", "yml", "xml")
#: Fixed value: archives are read up to this many members.
MEMBERS = 200
#: Blocks of files (five numbers each, some 100 bytes in a task) whose counts are sent to all tasks.
BLOCKS = 1_000_000
#: Bytes of a file that decide on its encoding.
SAMPLE = 64 * 1024
#: Bytes of files or members that a task reads one after the other, and that it holds of one.
MEMBER_BYTES, PIECE = 64 << 20, 1 << 20


def _tidy(line):
    """The line without the one carriage return before its end."""
    return F.when(F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def number_rows(rows: DataFrame, key: str = "path", blank: bool = True, folder: str | None = None) -> DataFrame:
    """Number the lines of text rows (key, block, value, and others): line_no, seq and line in place of block and value.

    Rows of a block of a file come in order, so that a line's number is its place in the block plus the lines of the blocks
    before.  The rows are read once, at once, and written with their places to ``folder`` (else a new one in the shared folder); everything else, counts and
    result, comes from what was written.  So neither other splits nor other cores nor a file that changes between two reads can lose or repeat a line.
    Only counts of blocks are accumulated, of all lines and of those that become entries (not empty; with ``blank`` false, more than
    white space); up to ``BLOCKS`` of them are sent to all tasks, so that no line is shuffled (more are joined).
    """
    spark = rows.sparkSession
    value = F.col("value")
    counts = ((value != "") & (value != "\r")) if blank else ~is_blank(value)
    # places among the rows that a task reads, and among those that count: the second one is counted on only where it is asked for
    place, entry = F.monotonically_increasing_id(), F.when(counts, F.monotonically_increasing_id())
    path = folder or scratch(spark)
    hashed = {"__h": F.xxhash64(key), "__g": F.xxhash64(F.col(key), F.lit(1))}
    rows.withColumns(hashed | {"__id": place, "__e": entry}).write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/rows")
    rows = spark.read.schema(rows.withColumns(hashed | {"__id": place, "__e": entry}).schema).parquet(f"{path}/rows")
    each = rows.groupBy("__h", "__g", "block").agg(F.count("*").alias("n"), F.count("__e").alias("e"), F.min("__id").alias("first"), F.min("__e").alias("first_e"), F.max("__id").alias("last"), F.max("__e").alias("last_e"))
    of_file = W.partitionBy("__h", "__g").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    whole = (F.col("last") - F.col("first") + 1 == F.col("n")) & F.coalesce(F.col("last_e") - F.col("first_e") + 1 == F.col("e"), F.lit(True))
    starts = each.select(
        F.col("__h").alias("h"), F.col("__g").alias("g"), F.col("block").alias("b"), (F.coalesce(F.sum("n").over(of_file), zero) - F.col("first")).alias("__lines"),
        (F.coalesce(F.sum("e").over(of_file), zero) - F.col("first_e")).alias("__entries"), F.when(whole, F.lit(0)).otherwise(F.raise_error(F.lit("a block's rows don't stand side by side"))).alias("__whole"),
    )
    starts.write.mode("overwrite").parquet(f"{path}/starts")
    starts = spark.read.schema("h long, g long, b long, __lines long, __entries long").parquet(f"{path}/starts")
    side = F.broadcast(starts) if starts.count() <= BLOCKS else starts
    numbered = rows.filter("__e IS NOT NULL").join(side, (F.col("__h") == F.col("h")) & (F.col("__g") == F.col("g")) & (F.col("block") == F.col("b")))
    others = [F.col(f"`{c}`") for c in rows.columns if c not in ("block", "value", "__id", "__e", "__h", "__g")]
    return numbered.select(*others, (F.col("__lines") + F.col("__id") + 1).alias("line_no"), (F.col("__entries") + F.col("__e")).alias("seq"), _tidy(value).alias("line"))


def read_log_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, blank: bool = True) -> DataFrame:
    """file, path, line_no, seq and line of UTF-8 files, numbered per file however many tasks read it; see :func:`number_rows`."""
    reader = few_listing_tasks(spark).read.option("lineSep", "\n")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    rows = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    return number_rows(rows, "path", blank)


def accepted(name):
    """Whether a file name ends like a log's."""
    return F.lower(name).rlike(r"\.(" + "|".join(SUFFIXES) + r")\z")


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


def read_log_dir(spark: SparkSession, folder: str) -> DataFrame:
    """The logs of a folder's top level; files with other names are not read."""
    return read_log_lines(spark, folder, "*.{" + ",".join(map(_any_case, SUFFIXES)) + "}")


def lines_from_column(df: DataFrame, text_col: str, file: str | object) -> DataFrame:
    """A text column as lines: each text is a file of its own."""
    name = F.col(file) if isinstance(file, str) else file
    rows = df.select(name.cast("string").alias("file"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"))
    return rows.select("file", (F.col("pos") + 1).cast("long").alias("line_no"), _tidy(F.col("line")).alias("line")).filter("line <> ''")


def merge_files(*parts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Entries of several sources in one table; with ``files`` (file, status), those of the files that are ready alone."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if files is None else out.join(files.filter("status = 'ready'").select("file").distinct(), "file", "left_semi").select(*out.columns)


#: What a reader may choose; "auto" decides by the bytes.
ENCODINGS = ("auto", "utf-8", "utf-16le", "utf-16be", "windows-1252")
#: Bytes whose zeros are counted, and the least number of them; a side is UTF-16's high bytes if a quarter of all bytes are
#: zeros of that side, and more than this many times those of the other side and this many besides.
ZEROS, FEWEST, TIMES, BESIDES = 1024, 8, 4, 2


def _utf16_by_zeros(sample: bytes) -> str | None:
    """Text in ASCII letters as UTF-16 has a zero in each pair of bytes, always on the same side."""
    head = sample[:ZEROS]
    zeros = [head[side::2].count(0) for side in (0, 1)]
    for side, label in ((1, "utf-16le"), (0, "utf-16be")):
        if len(head) >= FEWEST and 4 * zeros[side] >= len(head) and zeros[side] > TIMES * zeros[1 - side] + BESIDES:
            return label
    return None


def decide_encoding(sample: bytes, whole: bool, encoding: str = "auto") -> tuple[str, int]:
    """Encoding and size of the byte order mark of a file that begins with ``sample``.

    A chosen ``encoding`` always counts; a mark is then skipped only if it is that encoding's own.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding: {encoding}")
    marked, size = None, 0
    for mark, label in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if sample.startswith(mark):
            marked, size = label, len(mark)
    if encoding != "auto":
        return encoding, size if marked == encoding else 0
    if marked:
        return marked, size
    if found := _utf16_by_zeros(sample):
        return found, 0
    try:  # a character that the sample cuts in two is no mistake
        codecs.getincrementaldecoder("utf-8")().decode(sample, final=whole)
        return "utf-8", 0
    except UnicodeDecodeError:
        return "windows-1252", 0


#: The five bytes that Python's table leaves open stand for themselves, as in browsers.
_CP1252 = "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(256))


def decode(data: bytes, label: str) -> str:
    if label == "windows-1252":
        return codecs.charmap_decode(data, "strict", _CP1252)[0]
    return data.decode({"utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}.get(label, label), "replace")


#: Lines and characters of a batch of decoded lines.
LINES, CHARS = 50_000, 4 << 20


def _decoded(encoding: str):
    """Lines of files, one of which is Python's values at a time; lines of many small files leave together."""
    names, types = ("path", "encoding", "bom_len", "line_no", "line"), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = tuple([] for _ in names), 0

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
            for c in rows:
                c.clear()
            return made

        for batch in batches:
            paths, contents = batch.column("path"), batch.column("content")
            for i in range(batch.num_rows):
                path, content = paths[i].as_py(), contents[i].as_py() or b""
                label, mark = decide_encoding(content[:SAMPLE], len(content) <= SAMPLE, encoding)
                text = decode(content[mark:], label)
                found = [x.removesuffix("\r") for x in text.split("\n")]
                for at in range(0, len(found), LINES):
                    own = found[at : at + LINES]
                    for c, values in zip(rows, ([path] * len(own), [label] * len(own), [mark] * len(own), range(at + 1, at + 1 + len(own)), own), strict=True):
                        c.extend(values)
                    size += sum(map(len, own))
                    if len(rows[0]) >= LINES or size >= CHARS:
                        yield batch_of()
                        size = 0
        if rows[0]:
            yield batch_of()

    return work


DECODED = "path string, encoding string, bom_len int, line_no long, line string"


def decode_logs(files: DataFrame, encoding: str = "auto") -> DataFrame:
    """Lines of files given as (path, content), each in its own encoding, or all in the one that is chosen; null content has no lines."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding: {encoding}")
    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(_decoded(encoding), DECODED).filter("line <> ''")


def _encoded(encoding: str):
    """Lines of files, read a piece at a time."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path in frame["path"]:
                system, at = filesystem(path)
                with system.open_input_stream(at) as f:
                    data, line_no = f.read(PIECE), 0
                    label, mark = decide_encoding(data[:SAMPLE], len(data) < PIECE, encoding)
                    splitter = Splitter(data, len(data) < PIECE, encoding)
                    while True:
                        after = f.read(PIECE)
                        lines = splitter.feed(data, not after)
                        if lines:
                            yield pd.DataFrame({"path": path, "encoding": label, "bom_len": mark, "line_no": range(line_no + 1, line_no + 1 + len(lines)), "line": [x.removesuffix("\r") for x in lines]})
                        line_no, data = line_no + len(lines), after
                        if not after:
                            break

    return work


def read_encoded_logs(spark: SparkSession, path: str, encoding: str = "auto") -> DataFrame:
    """Lines of files as :func:`decode_logs` gives them; no file is one value, each is read by one task a piece at a time."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding: {encoding}")
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    total, n = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(n, -(-total // MEMBER_BYTES)))
    return files.select("path").repartition(tasks).mapInPandas(_encoded(encoding), DECODED).filter("line <> ''")


def encoding_census(files: DataFrame) -> DataFrame:
    """Encodings of a set of files: how many files and lines have each."""
    return decode_logs(files).groupBy("encoding").agg(F.countDistinct("path").alias("files"), F.count("*").alias("lines"))


def _members(most: int):
    def error(path: str, name: str | None, what: str) -> pd.DataFrame:
        return pd.DataFrame({"path": [path], "file": [name], "line_no": [0], "line": [None], "error": [what]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(bytes(content or b"")))
                except (zipfile.BadZipFile, ValueError, OSError, EOFError) as e:
                    yield error(path, None, str(e))
                    continue
                with archive:
                    for i, info in enumerate(x for x in archive.infolist() if not x.is_dir()):
                        if i >= most:
                            yield error(path, info.filename, f"beyond the first {most} members")
                            continue
                        try:
                            data = archive.read(info)
                        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, ValueError, OSError, EOFError) as e:
                            yield error(path, info.filename, str(e) or type(e).__name__)
                            continue
                        label, mark = decide_encoding(data[:SAMPLE], len(data) <= SAMPLE)
                        lines = decode(data[mark:], label).split("\n")
                        for at in range(0, len(lines), 50_000):
                            own = lines[at : at + 50_000]
                            yield pd.DataFrame({"path": path, "file": info.filename, "line_no": range(at + 1, at + 1 + len(own)), "line": [x.removesuffix("\r") for x in own], "error": None})

    return work


def zip_members(files: DataFrame, most: int = MEMBERS) -> DataFrame:
    """Lines of the members of zip archives given as (path, content).

    An archive that can't be read gives one row with its error, as does each member that can't be, and each beyond the first
    ``most``; all other members are read.
    """
    rows = files.select("path", "content").mapInPandas(_members(most), "path string, file string, line_no long, line string, error string")
    return rows.filter("line <> '' OR error IS NOT NULL")


class Splitter:
    """Lines of bytes that come piece by piece; the encoding is decided by the first bytes."""

    def __init__(self, first: bytes, whole: bool, encoding: str = "auto"):
        label, mark = decide_encoding(first[:SAMPLE], whole, encoding)
        self.table = _CP1252 if label == "windows-1252" else None
        self.decoder = None if self.table else codecs.getincrementaldecoder({"utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}.get(label, label))("replace")
        self.skip, self.held = mark, ""

    def feed(self, data: bytes, final: bool = False) -> list[str]:
        """Lines that are finished; the last one with ``final``."""
        data, self.skip = data[self.skip :], 0
        text = codecs.charmap_decode(data, "strict", self.table)[0] if self.table else self.decoder.decode(data, final)
        *done, self.held = (self.held + text).split("\n")
        return [*done, self.held] if final else done


MEMBER = "path string, file string, number int, size long, error string"


def _directory(most: int):
    """The members that an archive's directory lists: its end is read, no member is."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for path in frame["path"]:
                system, at = filesystem(path)
                try:
                    with system.open_input_file(at) as f, zipfile.ZipFile(f) as archive:
                        files = [(i, x) for i, x in enumerate(archive.infolist()) if not x.is_dir()]
                        out += [(path, x.filename, i, x.file_size, None if k < most else f"beyond the first {most} members") for k, (i, x) in enumerate(files)]
                except (zipfile.BadZipFile, ValueError, OSError, EOFError) as e:
                    out.append((path, None, -1, 0, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "file", "number", "size", "error"])

    return work


def _member(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of single members, read from their own bytes, a piece at a time."""
    columns = ["path", "file", "line_no", "line", "error"]
    for frame in batches:
        for path, name, number in zip(frame["path"], frame["file"], frame["number"], strict=True):
            system, at = filesystem(path)
            line_no = 0
            try:
                with system.open_input_file(at) as f, zipfile.ZipFile(f) as archive, archive.open(archive.infolist()[number]) as member:
                    data = member.read(PIECE)
                    splitter = Splitter(data, len(data) < PIECE)
                    while True:
                        after = member.read(PIECE)
                        lines = splitter.feed(data, not after)
                        if lines:
                            yield pd.DataFrame({"path": path, "file": name, "line_no": range(line_no + 1, line_no + 1 + len(lines)), "line": [x.removesuffix("\r") for x in lines], "error": None}, columns=columns)
                        line_no, data = line_no + len(lines), after
                        if not after:
                            break
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, ValueError, OSError, EOFError) as e:
                yield pd.DataFrame({"path": [path], "file": [name], "line_no": [0], "line": [None], "error": [str(e) or type(e).__name__]})


def read_zip_logs(spark: SparkSession, path: str, most: int = MEMBERS) -> DataFrame:
    """Lines of the members of zip archives, as :func:`zip_members` gives them, without an archive or a member ever being one value.

    The archives' directories make a table of members; members are dealt in turn to as many tasks as their sizes ask for, and each is read from its own
    bytes, a piece at a time.  A member whose bytes turn out to be broken gives the lines before that, then an error row.
    """
    archives = spark.read.format("binaryFile").load(path).select("path")
    listed = archives.repartition(max(1, -(-archives.count() // 200))).mapInPandas(_directory(most), MEMBER)
    base = scratch(spark)
    listed.write.parquet(base)
    listed = spark.read.schema(MEMBER).parquet(base)
    total, n = listed.filter("error IS NULL").agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(n, -(-total // MEMBER_BYTES)))
    out = "path string, file string, line_no long, line string, error string"
    rows = listed.filter("error IS NULL").repartition(tasks).select("path", "file", "number").mapInPandas(_member, out)
    failed = listed.filter("error IS NOT NULL").select("path", "file", F.lit(0).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line"), "error")
    return rows.unionByName(failed).filter("line <> '' OR error IS NOT NULL")
