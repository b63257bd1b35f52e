"""Exports of entries as CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_line

CSV_COLUMNS = ["ts_iso", "ts_ms", "level", "message", "raw", "file", "line_no"]


def csv_rows(entries: DataFrame) -> DataFrame:
    """CSV lines with the place they came from."""
    return entries.select("file", "line_no", csv_line(*[F.col(c) for c in CSV_COLUMNS]).alias("line"))


def write_csv(entries: DataFrame, path: str) -> None:
    out = entries.select(*CSV_COLUMNS).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def json_rows(entries: DataFrame) -> DataFrame:
    shape = F.struct(F.col("ts_iso").alias("ts"), "level", "message", "raw", "file", F.col("line_no").alias("lineNo"))
    return entries.select("file", "line_no", F.to_json(shape, {"ignoreNullFields": "false"}).alias("line"))


def write_json(entries: DataFrame, path: str) -> None:
    entries.select(F.col("ts_iso").alias("ts"), "level", "message", "raw", "file", F.col("line_no").alias("lineNo")).write.option("ignoreNullFields", "false").json(path)
