"""Cutting the lines of XML logs into events.

Whether text is part of an event depends on all that was read before: text without an event is held until one begins, and is given up,
as are events, when more than a limit is held.  So blocks of lines are read like a state machine whose state is the text that is held: every
block is read as if nothing were held before it, then again with what the block before it leaves, until no block's begin changes.  As a rule
what a block leaves doesn't depend on what came before (it ends in the middle of an event of its own), so that two rounds do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch

# How events of the two versions begin and end.
ENDS = {"<log4j:event": "</log4j:event>", "<LogRecord": "</LogRecord>"}
#: Lines of a block; rounds after which files that still change are read in order, each by one task (a block is held at a time).
LINES, ROUNDS = 4096, 8


def units(text: str) -> int:
    """Length in UTF-16, by which the limit goes."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2


def fold(held: str, lines: Iterator[tuple[int, str]], idle: int) -> tuple[list[tuple[int, str, bool]], str]:
    """Read lines with ``held`` before them: (line_no, text, whether it is an event) of what ends or is given up, and what is held then."""
    out, size = [], units(held)
    for number, line in lines:
        fresh = len(held)  # neither a beginning nor an end lies across lines: what was searched isn't searched again
        held += line + "\n"
        size += units(line) + 1
        if size > idle:
            out.append((number, held, False))
            held, size = "", 0
            continue
        while True:
            begin = next((b for b in ENDS if held.startswith(b)), None)
            if begin is None:
                at, begin = min(((i, b) for b in ENDS if (i := held.find(b, fresh)) >= 0), default=(-1, None))
                if at < 0:
                    break
                held, fresh = held[at:], 0
                size = units(held)
            tag = held.find(">")
            if tag < 0:
                break
            end = tag + 1
            if held[tag - 1] != "/":
                end = held.find(ENDS[begin], max(tag, fresh))
                if end < 0:
                    break
                end += len(ENDS[begin])
            out.append((number, held[:end], True))
            held, fresh = held[end:], 0
            size = units(held)
    return out, held


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """A batch's blocks, of which one at a time is Python's values."""
    columns = [batch.column(c) for c in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def _left(idle: int):
    """What each block leaves: rows are file, blk, numbers, texts, held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [fold(held, zip(numbers, texts, strict=True), idle)[1] for numbers, texts, held in _rows(batch, "numbers", "texts", "held")]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("blk"), batch.column("held"), pa.array(left, pa.string())], ["file", "blk", "held", "left"])

    return work


def _left_in_order(idle: int):
    """The same for whole files, whose blocks come in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, begun = None, "", False
        for batch in batches:
            before, left = [], []
            for own, numbers, texts in _rows(batch, "file", "numbers", "texts"):
                if not begun or own != file:
                    file, held, begun = own, "", True
                before.append(held)
                held = fold(held, zip(numbers, texts, strict=True), idle)[1]
                left.append(held)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("blk"), pa.array(before, pa.string()), pa.array(left, pa.string())], ["file", "blk", "held", "left"])

    return work


def _cut(idle: int):
    """Events, what is given up, and what a file's last block leaves: file, line_no, line, complete, given_up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, numbers, texts, held, last in _rows(batch, "file", "numbers", "texts", "held", "last"):
                found, rest = fold(held, zip(numbers, texts, strict=True), idle)
                out = [(file, number, text, event, not event) for number, text, event in found]
                if last:
                    out.append((file, numbers[-1], rest, False, False))
                if not out:
                    continue
                # a block's events go out before the next block is read
                types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["file", "line_no", "line", "complete", "given_up"])

    return work


def cut_events(lines: DataFrame, idle: int, size: int = LINES, rounds: int = ROUNDS) -> DataFrame:
    """file, line_no (on which it ends), line, complete (an event), given_up (over the limit) of lines (file, line_no, line).

    The rest of each file, which may be empty, is neither complete nor given up.
    """
    spark, base = lines.sparkSession, scratch(lines.sparkSession)
    blocks = lines.groupBy("file", F.floor((F.col("line_no") - 1) / size).cast("long").alias("blk")).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    blocks.select("file", "blk", F.col("l.line_no").alias("numbers"), F.col("l.line").alias("texts")).write.parquet(f"{base}/blocks")
    blocks = spark.read.schema("file string, blk long, numbers array<long>, texts array<string>").parquet(f"{base}/blocks")
    schema, known = "file string, blk long, held string, left string", ["file", "blk", "held", "left"]

    def written(df: DataFrame, name: str) -> DataFrame:
        df.select(*known).write.parquet(f"{base}/{name}")
        return spark.read.schema(schema).parquet(f"{base}/{name}")

    def of_blocks(df: DataFrame, how: str = "inner") -> DataFrame:
        side = df.select(F.col("file").alias("__f"), F.col("blk").alias("__b"), "held")
        return blocks.join(side, F.col("file").eqNullSafe(F.col("__f")) & (F.col("blk") == F.col("__b")), how).drop("__f", "__b")

    in_file = W.partitionBy("file").orderBy("blk")
    states = written(blocks.withColumn("held", F.lit("")).mapInArrow(_left(idle), schema), "round0")
    for i in range(1, rounds + 2):
        # a block begins with what the one before it leaves
        now = states.withColumn("__new", F.coalesce(F.lag("left").over(in_file), F.lit("")))
        moved = now.filter("__new <> held")
        if moved.isEmpty():
            break
        if i <= rounds:
            again = of_blocks(moved.select("file", "blk", F.col("__new").alias("held"))).mapInArrow(_left(idle), schema)
            states = written(again.unionByName(now.filter("__new = held").drop("__new")), f"round{i}")
        else:
            files = moved.select("file").distinct().select(F.col("file").alias("__f"))
            same = F.col("file").eqNullSafe(F.col("__f"))
            whole = blocks.join(files, same, "left_semi").repartition("file").sortWithinPartitions("file", "blk")
            states = written(whole.mapInArrow(_left_in_order(idle), schema).unionByName(states.join(files, same, "left_anti")), f"round{i}")
    ends = states.withColumn("last", F.lead("blk").over(in_file).isNull()).select(F.col("file").alias("__f"), F.col("blk").alias("__b"), "held", "last")
    both = blocks.join(ends, F.col("file").eqNullSafe(F.col("__f")) & (F.col("blk") == F.col("__b"))).drop("__f", "__b")
    return both.mapInArrow(_cut(idle), "file string, line_no long, line string, complete boolean, given_up boolean")
