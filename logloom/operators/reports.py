"""Reports over entries, tables and directory listings."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_cell


def level_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.coalesce("level", F.lit("(none)")).alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level")


def entries_per_minute(entries: DataFrame) -> DataFrame:
    minute = F.replace(F.substring("ts_iso", 1, 16), F.lit("T"), F.lit(" "))
    return entries.filter("ts_iso IS NOT NULL").groupBy(minute.alias("minute")).agg(F.count("*").alias("n")).orderBy("minute")


def top_messages(entries: DataFrame, k: int = 50) -> DataFrame:
    return entries.groupBy("message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(k)


def entries_per_file(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.coalesce("file", F.lit("(unknown)")).alias("file")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file")


def parse_quality(entries: DataFrame) -> DataFrame:
    """How many entries of each file are raw: no timestamp and no level."""
    raw = F.count_if(F.col("ts_ms").isNull() & F.col("level").isNull())
    return entries.groupBy("file").agg(F.count("*").alias("total"), raw.alias("raw_entries"))


def file_inventory(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Files (file, size, encoding, status) with their lines and entries; negative sizes are 0, unknown states "parsing"."""
    counts = entries.groupBy("file").agg(F.max("line_no").alias("lines"), F.count("*").alias("entries"))
    zero = F.lit(0).cast("long")
    status = F.when(F.col("status").isin("parsing", "ready", "error"), F.col("status")).otherwise("parsing")
    return files.join(counts, "file", "left").select("file", F.greatest(F.coalesce("size", zero), zero).alias("size"), F.coalesce("lines", zero).alias("lines"), F.coalesce("entries", zero).alias("entries"), "encoding", status.alias("status"))


def ad_hoc(entries: DataFrame, sql: str, view: str = "entries") -> DataFrame:
    """Free SQL over the view ``entries``; mistakes raise ValueError.  The session's own view of that name, if any, is put back."""
    spark = entries.sparkSession
    before = spark.table(view) if any(t.isTemporary and t.name.lower() == view.lower() for t in spark.catalog.listTables()) else None
    entries.createOrReplaceTempView(view)
    try:
        return spark.sql(sql)  # resolved here, so the view isn't needed any more
    except (ParseException, AnalysisException) as e:
        raise ValueError(str(e).split("\n")[0]) from e
    finally:
        if before is None:
            spark.catalog.dropTempView(view)
        else:
            before.createOrReplaceTempView(view)


def capped(df: DataFrame, most: int = 50_000) -> tuple[DataFrame, int, bool]:
    """The first rows with cells as a report shows them, the exact number of all rows, and whether some are missing."""
    total = df.count()
    shown = df.limit(most)
    return shown.select(*[normalize_cell(F.col(f"`{f.name}`"), f.dataType, preview=False).alias(f.name) for f in df.schema]), total, total > most


def preview(df: DataFrame, most: int = 50_000) -> tuple[DataFrame, int, bool]:
    """As :func:`capped`, with cells as a table preview shows them."""
    total = df.count()
    return df.limit(most).select(*[normalize_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]), total, total > most


def table_list(spark: SparkSession) -> DataFrame:
    """Names of the session's tables, without internal ones, each once in either case."""
    names = spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "name string")
    return list_names(names)


def list_names(names: DataFrame) -> DataFrame:
    own = names.filter(~F.lower("name").startswith("sqlite_")).withColumn("__k", F.lower("name"))
    return own.groupBy("__k").agg(F.min("name").alias("name")).orderBy("__k").select("name")


def dir_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (name, size) that came or went between two listings; a new size is no event."""
    added = after.join(before, "name", "left_anti").select(F.lit("added").alias("event"), "name", "size")
    return added.unionByName(before.join(after, "name", "left_anti").select(F.lit("removed").alias("event"), "name", "size"))
