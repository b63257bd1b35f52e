"""Filters over entries, and the library of saved filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.levels import LEVELS
from .matching import with_matches


def holds(c: Column, text: Column | str) -> Column:
    """Literal substring in either case."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(text) if isinstance(text, str) else text))


def text_condition(text: str) -> Column:
    return holds(F.col("message"), text) | holds(F.col("raw"), text) if text else F.lit(True)


def level_condition(levels: list[str]) -> Column:
    """Any level, none included, if the list is empty; else only those listed."""
    return F.coalesce(F.col("level").isin(*levels), F.lit(False)) if levels else F.lit(True)


def file_condition(name: str) -> Column:
    return holds(F.col("file"), name) if name else F.lit(True)


def apply_filters(entries: DataFrame, text: str = "", levels: list[str] | None = None) -> DataFrame:
    return entries.filter(text_condition(text) & level_condition(levels or [])) if text or levels else entries


def filter_counts(entries: DataFrame, text: str = "", levels: list[str] | None = None) -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.count_if(text_condition(text) & level_condition(levels or [])).alias("visible"))


def log_view(entries: DataFrame) -> DataFrame:
    """What a reader sees: time, level (a dash for none), message and file."""
    return entries.select(F.col("ts_iso").alias("time"), F.coalesce("level", F.lit("–")).alias("level"), "message", "file", "line_no")


def saved_filter_hits(entries: DataFrame, saved: DataFrame) -> DataFrame:
    """How many entries each saved filter (name, text, levels, saved_at) finds."""
    none = F.lit("")
    f = saved.select(F.lit(0).alias("priority"), F.col("name").alias("id"), "text", "levels", none.alias("file"), none.alias("color"))
    hits = with_matches(entries, f).select(F.explode("__hits.id").alias("name")).groupBy("name").agg(F.count("*").alias("hits"))
    return saved.select("name", "saved_at").join(hits, "name", "left").select("name", "saved_at", F.coalesce("hits", F.lit(0)).alias("hits"))


def upsert_filters(saved: DataFrame, incoming: DataFrame, deleted: list[str] | None = None) -> DataFrame:
    """By name; of equal names the incoming one wins, and of those the latest."""
    both = saved.withColumn("__s", F.lit(0)).unionByName(incoming.withColumn("__s", F.lit(1)))
    first = F.row_number().over(W.partitionBy("name").orderBy(F.desc("__s"), F.desc("saved_at")))
    out = both.withColumn("__n", first).filter("__n = 1").drop("__n", "__s")
    return out.filter(~F.col("name").isin(*deleted)) if deleted else out


def known_levels(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x.isin(*LEVELS), F.lit(False)))


def sanitize_filters(saved: DataFrame) -> DataFrame:
    return saved.filter("coalesce(name, '') <> ''").select("name", F.coalesce("text", F.lit("")).alias("text"), known_levels(F.col("levels")).alias("levels"), F.greatest(F.coalesce("saved_at", F.lit(0)), F.lit(0)).alias("saved_at"))


def sanitize_alerts(configs: DataFrame) -> DataFrame:
    """Alert configurations (url, text, levels, file) with texts that aren't there empty and unknown levels left out; other columns are kept."""
    fixed = {"url": F.coalesce("url", F.lit("")), "text": F.coalesce("text", F.lit("")), "file": F.coalesce("file", F.lit("")), "levels": known_levels(F.col("levels"))}
    return configs.select(*[fixed[c].alias(c) if c in fixed else F.col(f"`{c}`") for c in configs.columns])
