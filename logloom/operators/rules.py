"""Colour rules: the first rule in priority order that an entry matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import known_levels
from .matching import with_matches

# Tints of the levels, and the colour of a rule whose own is no colour.
TINTS = {"TRACE": "rgba(158,158,158,0.10)", "DEBUG": "rgba(102,187,106,0.10)", "INFO": "", "WARN": "rgba(255,152,0,0.16)", "ERROR": "rgba(244,67,54,0.18)", "FATAL": "rgba(183,28,28,0.42)"}
DEFAULT_COLOR = "#f85149"


def classify(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries with rule_id and color of the first matching rule (priority, id, text, levels, file, color), else null.

    Of rules with one priority the one with the smaller id goes first.  Any number of rules is tried in the same way, in one pass; null files and
    line numbers are no obstacle.
    """
    return with_matches(entries, rules).withColumn("__hit", F.get("__hits", F.lit(0))).select(*entries.columns, F.col("__hit.id").alias("rule_id"), "__hit.color")


def with_level_fallback(classified: DataFrame) -> DataFrame:
    """The rule's colour, else the level's tint."""
    tint = F
    for level, color in TINTS.items():
        tint = tint.when(F.col("level") == level, color)
    return classified.withColumn("color", F.coalesce("color", tint))


def hit_counts(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """For each rule how many entries match it, and how many of them it wins."""
    found = with_matches(entries, rules).select(F.posexplode("__hits.id").alias("place", "rule_id"))
    counts = found.groupBy("rule_id").agg(F.count("*").alias("matched"), F.count_if(F.col("place") == 0).alias("won"))
    zero = F.lit(0).cast("long")
    return rules.select(F.col("id").alias("rule_id")).join(counts, "rule_id", "left").select("rule_id", F.coalesce("matched", zero).alias("matched"), F.coalesce("won", zero).alias("won"))


def reorder(rules: DataFrame, rule_id: str, to: int) -> DataFrame:
    """Move a rule to a place (from 0) in the list."""
    others = rules.filter(F.col("id") != rule_id).withColumn("priority", F.row_number().over(W.orderBy("priority")) - 1)
    others = others.withColumn("priority", F.when(F.col("priority") >= to, F.col("priority") + 1).otherwise(F.col("priority")))
    return others.unionByName(rules.filter(F.col("id") == rule_id).withColumn("priority", F.lit(to)))


def sanitize_rules(rules: DataFrame) -> DataFrame:
    blank = F.lit("")
    color = F.when(F.col("color").rlike(r"^#[0-9a-fA-F]{6}\z"), F.col("color")).otherwise(DEFAULT_COLOR)
    return rules.filter("coalesce(id, '') <> ''").select("priority", "id", F.coalesce("text", blank).alias("text"), known_levels(F.col("levels")).alias("levels"), F.coalesce("file", blank).alias("file"), color.alias("color"))
