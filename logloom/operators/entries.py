"""The one table that every format is parsed into, and running sums that hold for files of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.timestamps import to_iso
from ..session import scratch

COLUMNS = ["seq", "ts_ms", "ts_iso", "level", "message", "raw", "file", "line_no"]


#: ``order`` numbers of a block of a scan; summaries of blocks that are sent to all tasks.
BLOCK, SUMMARIES = 100_000, 500_000


def scan(df: DataFrame, inside: Callable[[WindowSpec], dict[str, Column]], summary: dict[str, Column], across: Callable[[WindowSpec], dict[str, Column]], key: str = "file", order: tuple[str, ...] = ("line_no",), block: int = BLOCK) -> DataFrame:
    """A scan along the rows of each key in two levels, so that a large file isn't one task.

    A key's rows are cut into blocks of ``block`` numbers of the first column of ``order``.  ``inside`` gives columns over the rows of a block up to
    the current one (the window it gets ends before the current row), ``summary`` aggregates a block's rows with them, and ``across``
    gives columns over the summaries of the blocks of a key (its window ends before the current block).  The input is read once, at once:
    rows are written with the columns of ``inside``, so that only summaries are read again and accumulated.
    """
    spark = df.sparkSession
    w = W.partitionBy(key, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    path = scratch(spark)
    rows = df.withColumn("__block", F.floor(F.col(order[0]) / block).cast("long"))
    for name, value in inside(w).items():  # one sort serves all: they have one window
        rows = rows.withColumn(name, value)
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    blocks = rows.groupBy(F.col(key).alias("__key"), F.col("__block").alias("__at")).agg(*[c.alias(n) for n, c in summary.items()])
    over = W.partitionBy("__key").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    for name, value in across(over).items():
        blocks = blocks.withColumn(name, value)
    blocks.drop(*summary).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(blocks.drop(*summary).schema).parquet(f"{path}/blocks")
    side = F.broadcast(blocks) if blocks.count() <= SUMMARIES else blocks
    return rows.join(side, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__at"))).drop("__block", "__key", "__at")


def running_sum(df: DataFrame, value: str, out: str, key: str = "file", order: str = "line_no", then: str | None = None, block: int = BLOCK) -> DataFrame:
    """``out``: sum of ``value`` over the rows of a key before the current one; a :func:`scan`."""
    zero = F.lit(0)
    found = scan(
        df, lambda w: {"__inside": F.coalesce(F.sum(value).over(w), zero)}, {"__sum": F.sum(value)}, lambda w: {"__before": F.coalesce(F.sum("__sum").over(w), zero)},
        key, (order, then) if then else (order,), block,
    )
    return found.withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def running_last(df: DataFrame, value: str, out: str, key: str = "file", order: str = "line_no", block: int = BLOCK) -> DataFrame:
    """``out``: the last value that isn't null in the rows of a key before the current one; a :func:`scan`."""
    found = scan(
        df, lambda w: {"__inside": F.last(value, ignorenulls=True).over(w)}, {"__last": F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))},
        lambda w: {"__before": F.last("__last", ignorenulls=True).over(w)}, key, (order,), block,
    )
    return found.withColumn(out, F.coalesce("__inside", "__before")).drop("__before", "__inside")


def entries(df: DataFrame, ts_ms: Column, level: Column, message: Column) -> DataFrame:
    """Entries of lines (file, line_no, line), with sequence numbers if the lines have them."""
    seq = ["seq"] if "seq" in df.columns else []
    return df.select(*seq, ts_ms.alias("ts_ms"), level.alias("level"), message.alias("message"), F.col("line").alias("raw"), "file", "line_no").select(*seq, "ts_ms", to_iso(F.col("ts_ms")).alias("ts_iso"), "level", "message", "raw", "file", "line_no")


def number_lines(lines: DataFrame, blank: bool = True) -> DataFrame:
    """Lines with the sequence number of the entry that each becomes: the place from 0 among a file's lines that aren't empty
    (with ``blank`` false, that aren't white space alone: parsers of JSON, W3C, access and delimited lines skip those).

    Numbering lines costs less than numbering entries: nothing is parsed twice.
    """
    counted = lines.filter("line <> ''") if blank else lines.filter(~is_blank(F.col("line")))
    return running_sum(counted.withColumn("__one", F.lit(1).cast("long")), "__one", "seq").drop("__one")


def with_seq(df: DataFrame) -> DataFrame:
    """Number the entries of each file from 0 in the order of their lines, unless they are numbered already.

    The entries are read twice (to count blocks, and to number); lines that give one entry each are better numbered before
    they are parsed (:func:`number_lines`, or the sources' own numbers).
    """
    return (df if "seq" in df.columns else running_sum(df.withColumn("__one", F.lit(1).cast("long")), "__one", "seq")).select(*COLUMNS)
