"""Alerts on new entries: matching, batching, payloads; and what polls of growing files mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import truncate_message
from ..session import scratch
from .filters import file_condition, level_condition, text_condition

BATCH, BACKLOG = 50, 1000


def alert_matches(entries: DataFrame, url: str, text: str = "", levels: list[str] | None = None, file: str = "") -> DataFrame:
    """Live entries (column live) that meet the condition; none while there is no address."""
    if not url.strip():
        return entries.filter(F.lit(False))
    return entries.filter(F.col("live") & text_condition(text) & level_condition(levels or []) & file_condition(file))


def backlog(matched: DataFrame, delivery: str = "delivery", order: str = "arrival", most: int = BACKLOG) -> DataFrame:
    """The latest ``most`` of each delivery; older ones are dropped."""
    return matched.withColumn("__n", F.row_number().over(W.partitionBy(delivery).orderBy(F.desc(order)))).filter(F.col("__n") <= most).drop("__n")


def payload_items(matched: DataFrame) -> DataFrame:
    item = F.struct(F.coalesce("file", F.lit("")).alias("file"), F.col("line_no").alias("lineNo"), F.col("ts_iso").alias("timestamp"), "level", truncate_message(F.col("message")).alias("message"))
    return matched.withColumn("item", item)


def alert_batches(matched: DataFrame, delivery: str = "delivery", order: str = "arrival", size: int = BATCH, spread: bool = False) -> DataFrame:
    """Payloads of up to ``size`` items in order: delivery, batch and items.

    A delivery is numbered by one task; with ``spread`` by many, for which the rows are written at once: see :func:`_spread`.
    """
    rows = payload_items(matched).select(delivery, order, "item")
    if spread:
        rows = _spread(rows, delivery, order)
    else:
        rows = rows.withColumn("__n", F.row_number().over(W.partitionBy(delivery).orderBy(order)) - 1)
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__n").alias("n"), "item"))), lambda x: x["item"])
    return rows.groupBy(delivery, F.floor(F.col("__n") / size).alias("batch")).agg(items.alias("entries"))


def _spread(rows: DataFrame, delivery: str, order: str) -> DataFrame:
    """The rows with ``__n``, their place from 0 in the delivery's order.

    Rows are written (ranges are found by a look at them), dealt by ranges of delivery and order and written with their places in the range; only
    counts of a range's deliveries are accumulated.
    """
    spark, matches, path = rows.sparkSession, scratch(rows.sparkSession), scratch(rows.sparkSession)
    rows.write.parquet(matches)
    dealt = spark.read.schema(rows.schema).parquet(matches).repartitionByRange(delivery, order).sortWithinPartitions(delivery, order).withColumn("__id", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path).withColumn("__range", F.shiftright("__id", 33))
    each = rows.groupBy(F.col(delivery).alias("__d"), F.col("__range").alias("__r")).agg(F.count("*").alias("n"), F.min("__id").alias("first"))
    before = F.sum("n").over(W.partitionBy("__d").orderBy("__r").rowsBetween(W.unboundedPreceding, -1))
    starts = each.select("__d", "__r", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__start"))
    found = rows.join(starts, F.col(delivery).eqNullSafe(F.col("__d")) & (F.col("__range") == F.col("__r")))
    return found.withColumn("__n", F.col("__start") + F.col("__id")).drop("__d", "__r", "__start", "__id", "__range")


def payload_json(batches: DataFrame) -> DataFrame:
    return batches.withColumn("payload", F.to_json(F.struct("entries"), {"ignoreNullFields": "false"}))


def latest_epoch(rows: DataFrame) -> DataFrame:
    """Rows of each file's last epoch: a rotated file begins anew."""
    last = rows.groupBy(F.col("file").alias("__f")).agg(F.max("epoch").alias("__e"))
    return rows.join(last, (F.col("file") == F.col("__f")) & (F.col("epoch") == F.col("__e"))).drop("__f", "__e")


def poll_classify(polls: DataFrame) -> DataFrame:
    """What each poll (file, poll_no, size) of a followed file says: removed, rotate, none or bytes, with the bytes to read.

    A rotation forgets the size before, so that a second loss of size right after it isn't another rotation: in a run of
    shrinking sizes every other one is.
    """
    w = W.partitionBy("file").orderBy("poll_no")
    seen = polls.filter("size >= 0").withColumn("__before", F.lag("size").over(w)).withColumn("__less", F.coalesce(F.col("size") < F.col("__before"), F.lit(False)))
    seen = seen.withColumn("__run", F.sum((~F.col("__less")).cast("int")).over(w))
    place = F.row_number().over(W.partitionBy("file", "__run").orderBy("poll_no")) - 1  # 0 is where the run began
    seen = seen.withColumn("__rotate", F.col("__less") & (place % 2 == 1))
    zero = F.lit(0).cast("long")
    offset = F.when(F.coalesce(F.lag("__rotate").over(w), F.lit(False)), zero).otherwise(F.coalesce("__before", zero))
    seen = seen.withColumn("__offset", offset)
    event = F.when(F.col("__rotate"), "rotate").when(F.col("size") <= F.col("__offset"), "none").otherwise("bytes")
    out = seen.select("file", "poll_no", "size", event.alias("event"), F.when(event == "bytes", F.col("size") - F.col("__offset")).otherwise(zero).alias("n_bytes"))
    return out.unionByName(polls.filter("size < 0").select("file", "poll_no", "size", F.lit("removed").alias("event"), zero.alias("n_bytes")))


def epochs(polls: DataFrame) -> DataFrame:
    """The epoch that each poll (file, poll_no, size) of a followed file sees: 0, and one more with each rotation."""
    turned = poll_classify(polls).withColumn("__turn", (F.col("event") == "rotate").cast("long"))
    return turned.select("file", "poll_no", F.sum("__turn").over(W.partitionBy("file").orderBy("poll_no")).alias("epoch"))


def segment_line_numbers(segments: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """Lines (segment "name.N", line_no in it, line) numbered through all segments of a logical file: file, epoch, line_no, line.

    With ``polls`` (file, poll_no, size), of which segment N is what poll N brought, numbers begin anew with each rotation.
    """
    name = F.regexp_extract("segment", r"^(.*)\.(\d+)\z", 1)
    rows = segments.select(name.alias("file"), F.regexp_extract("segment", r"\.(\d+)\z", 1).cast("long").alias("n"), F.col("line_no").alias("at"), "line")
    sizes = rows.groupBy("file", "n").agg(F.max("at").alias("size"))
    if polls is None:
        sizes = sizes.withColumn("epoch", F.lit(0).cast("long"))
    else:
        seen = epochs(polls).select(F.col("file").alias("__p"), "poll_no", "epoch")
        sizes = sizes.join(seen, (F.col("file") == F.col("__p")) & (F.col("n") == F.col("poll_no")), "left").select("file", "n", "size", F.coalesce("epoch", F.lit(0)).cast("long").alias("epoch"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("file", "epoch").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("file").alias("__f"), F.col("n").alias("__n"), "epoch", before.alias("__start"))
    return rows.join(starts, (F.col("file") == F.col("__f")) & (F.col("n") == F.col("__n"))).select("file", "epoch", (F.col("__start") + F.col("at")).alias("line_no"), "line")
