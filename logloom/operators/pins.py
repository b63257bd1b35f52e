"""Pins: notes on single lines, by (file, line_no)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .entries import running_sum

KEY = ["file", "line_no"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.coalesce("file", F.lit("")))


def first_pins(pins: DataFrame) -> DataFrame:
    """One pin for each line: the first by position."""
    return _keyed(pins).withColumn("__n", F.row_number().over(W.partitionBy(*KEY).orderBy("pos"))).filter("__n = 1").drop("__n")


def annotate(entries: DataFrame, pins: DataFrame) -> DataFrame:
    own = first_pins(pins).select(*KEY, F.col("id").alias("pin_id"), "note")
    return _keyed(entries).join(own, KEY, "left").select(*entries.columns, "pin_id", "note")


def merge(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Local ids stay, incoming notes win, new pins are added."""
    a = first_pins(local).select(*KEY, F.col("id").alias("a_id"), F.col("note").alias("a_note"), F.lit(True).alias("a"))
    b = first_pins(incoming).select(*KEY, F.col("id").alias("b_id"), F.col("note").alias("b_note"), F.lit(True).alias("b"))
    both = a.join(b, KEY, "full")
    return both.select(F.when(F.col("a"), F.col("a_id")).otherwise(F.col("b_id")).alias("id"), *KEY, F.when(F.col("b"), F.col("b_note")).otherwise(F.col("a_note")).alias("note"))


def sanitize(pins: DataFrame) -> DataFrame:
    """Pins with an id, a file and a line of 1 or more (cut to a whole number)."""
    line = F.when(F.col("line_no") > 0, F.floor("line_no")).otherwise(F.ceil("line_no")).cast("long")
    return pins.filter("coalesce(id, '') <> '' AND file IS NOT NULL AND line_no >= 1").select("id", "file", line.alias("line_no"), F.coalesce("note", F.lit("")).alias("note"))


def locate(view: DataFrame, pins: DataFrame) -> DataFrame:
    """Where pinned lines stand in a view (from 0 in each file); those not in it are left out."""
    placed = running_sum(view.select(*KEY).withColumn("__one", F.lit(1).cast("long")), "__one", "position").select(*KEY, "position")
    return placed.join(first_pins(pins).select(*KEY, "id"), KEY).select("id", *KEY, "position")


def orphaned(pins: DataFrame, entries: DataFrame) -> DataFrame:
    """Pins whose file isn't there."""
    return pins.join(_keyed(entries).select("file").distinct(), "file", "left_anti")


def add(pins: DataFrame, new: DataFrame, removed_ids: list[str] | None = None) -> DataFrame:
    """Pin lines that aren't pinned, then take pins away by id."""
    out = pins.unionByName(first_pins(new).join(pins, KEY, "left_anti").select(*pins.columns))
    return out.filter(~F.col("id").isin(*removed_ids)) if removed_ids else out
