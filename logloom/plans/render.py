"""Log lines rendered from the given tables, in every format that the library reads, as (file, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def token() -> Column:
    """A level name as a log would have it."""
    t = F.col("event_type")
    return F.when(t == "error", F.when(F.col("event_id") % 10 == 0, "CRITICAL").otherwise("SEVERE")).when(t == "purchase", "WARNING").when(t == "signup", "NOTICE").when(t == "view", "debug").otherwise("FINE")


def message() -> Column:
    return F.concat(F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" value="), F.floor("value").cast("string"))


#: Lines of a rendered file: the number of files grows with the table.
EACH = 1000


def placed(df: DataFrame, key: str, prefix: str, suffix: str, files: int) -> DataFrame:
    """Rows of consecutive keys (from 0) with the file and the line that each is written to: dealt in turn to so many files until
    each has ``EACH`` lines, then to as many new ones."""
    k = F.col(key)
    number = k % files + files * F.floor(k / (files * EACH))
    return df.withColumn("file", F.concat(F.lit(prefix), number.cast("string"), F.lit(f".{suffix}"))).withColumn("line_no", (F.floor((k % (files * EACH)) / files) + 1).cast("long"))


def events(spark: SparkSession, sf_dir: str, prefix: str = "app", suffix: str = "log", files: int = 8) -> DataFrame:
    """The events with the file and the line that each is written to."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return placed(df, "event_id", prefix, suffix, files)


def lines(df: DataFrame, line: Column) -> DataFrame:
    return df.select("file", "line_no", line.alias("line"))


def app(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"date level: message", and some lines without form."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), token(), F.lit(": "), message())
    return lines(events(spark, sf_dir), F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("no form here "), F.col("event_id").cast("string"))).otherwise(line))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(events(spark, sf_dir, "thr"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" [worker-"), (F.col("user_id") % 5).cast("string"), F.lit("] "), token(), F.lit(": "), message()))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(events(spark, sf_dir, "gc"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z "), message()))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis("ts")
    s = F.floor(ms / 1000).cast("string")
    stamp = F.when(F.col("event_id") % 3 == 0, s).when(F.col("event_id") % 3 == 1, ms.cast("string")).otherwise(F.concat(s, F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0")))
    return lines(events(spark, sf_dir, "ep"), F.concat(stamp, F.lit(" "), token(), F.lit(": "), message()))


#: Events of a syslog file, and the hours between two of them: two years and a quarter, so that the year has to be inferred twice.
SYSLOG_EACH, SYSLOG_HOURS = 2000, 10


def syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates without a year over two years and a quarter in each file, a leap day among them.

    In every other file the clock jumps five days ahead in line 1501, which the rule of 48 hours takes for a step back by a year.
    """
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    number, at = F.floor(k / SYSLOG_EACH), k % SYSLOG_EACH
    jump = F.when((number % 2 == 1) & (at >= 1500), 120).otherwise(0)
    day = F.timestamp_millis(F.unix_millis(F.expr("timestamp'2023-07-01 06:00:00'")) + (at * SYSLOG_HOURS + jump) * 3_600_000)
    df = df.withColumn("file", F.concat(F.lit("sys"), number.cast("string"), F.lit(".log"))).withColumn("line_no", (at + 1).cast("long")).withColumn("day", day)
    return lines(df, F.concat(F.date_format("day", "MMM dd HH:mm:ss"), F.lit(" host app["), F.col("user_id").cast("string"), F.lit("]: "), F.col("event_type")))


def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of three kinds by file; some broken, some arrays, some without a message."""
    df = events(spark, sf_dir, "json", "json", 3)
    ms, kind = F.unix_millis("ts"), F.col("event_id") % 3
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    severity = (F.col("user_id") % 9).cast("string")
    stamp = F.when(kind == 0, F.concat(F.lit('"@timestamp":"'), iso, F.lit('"'))).when(kind == 1, F.concat(F.lit('"ts":'), ms.cast("string"))).otherwise(F.concat(F.lit('"time":"'), F.floor(ms / 1000).cast("string"), F.lit('"')))
    level = F.when(kind == 1, F.concat(F.lit('"severity":'), severity)).otherwise(F.concat(F.lit('"level":"'), token(), F.lit('"')))
    text = F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit(',"msg":"'), message(), F.lit('"')))
    whole = F.concat(F.lit("{"), stamp, F.lit(","), level, text, F.lit("}"))
    line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"ts":'), F.col("event_id").cast("string"))).when(F.col("event_id") % 51 == 0, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    return lines(df, line)


STATUS = "element_at(array(200, 201, 301, 404, 500, 503), cast(event_id % 6 AS int) + 1)"
METHOD = "CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'GET' END"


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access logs; clocks of odd users are in +0530."""
    df = events(spark, sf_dir, "access", files=2)
    wall = F.when(F.col("user_id") % 2 == 1, F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL '05:30' HOUR TO MINUTE"), "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0530"))).otherwise(F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000")))
    tail = F.when(F.col("event_id") % 2 == 0, ' "-" "agent 1.0"').otherwise("")
    line = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" - - ["), wall, F.lit('] "'), F.expr(METHOD), F.lit(" /p/"), (F.col("event_id") % 40).cast("string"), F.when(F.col("event_id") % 7 == 0, "").otherwise(" HTTP/1.1"), F.lit('" '), F.expr(STATUS).cast("string"), F.lit(" 512"), tail)
    return lines(df, F.when(F.col("event_id") % 89 == 0, "no request").otherwise(line))


W3C_FIELDS = ["date", "time", "c-ip", "cs-method", "cs-uri-stem", "sc-status", "cs-agent"]


def w3c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3C logs with a header; agents with blanks in them, and rows cut short."""
    df = events(spark, sf_dir, "iis", files=2)
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" 10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" "), F.expr(METHOD), F.lit(" /p "), F.expr(STATUS).cast("string"), F.when(F.col("event_id") % 5 == 0, " agent 1.0").otherwise(" agent"))
    body = df.select("file", (F.col("line_no") + 2).alias("line_no"), F.when(F.col("event_id") % 71 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(line).alias("line"))
    head = df.select("file").distinct().select("file", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("line_no"), F.lit("#Version: 1.0").alias("line")), F.struct(F.lit(2).cast("long").alias("line_no"), F.lit("#Fields: " + " ".join(W3C_FIELDS)).alias("line")))).alias("h")).select("file", "h.*")
    return head.unionByName(body)


def dsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tab-separated lines."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    df = placed(df, "o_orderkey", "orders", "txt", 2)
    level = F.when(F.col("o_orderstatus") == "O", "info").when(F.col("o_orderstatus") == "F", "Error").otherwise("?")
    return lines(df, F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, "o_orderpriority", F.col("o_orderkey").cast("string")))


def log4j(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log4j events over three lines; each seventh closes itself, each eleventh is of version 2; entities in messages."""
    df = events(spark, sf_dir, "l4j", "xml", 2)
    ms = F.unix_millis("ts").cast("string")
    e = F.col("event_id")
    one = F.array(F.concat(F.lit('<log4j:event logger="a" timestamp="'), ms, F.lit('" level="'), token(), F.lit('"/>')))
    two = F.array(F.concat(F.lit('<LogRecord level="'), token(), F.lit('" timeMillis="'), ms, F.lit('">')), F.concat(F.lit("<Message>"), message(), F.lit(" &lt;&amp;amp;&gt;</Message>")), F.lit("</LogRecord>"))
    three = F.array(F.concat(F.lit('<log4j:event logger="a" timestamp="'), ms, F.lit('" level="'), token(), F.lit('" thread="main">')), F.concat(F.lit("  <log4j:message>"), message()), F.lit("\tmore &amp; more</log4j:message></log4j:event>"))
    # lines before an event's are counted over events, so that no line is sorted
    before = F.sum(F.when(e % 7 == 0, 1).otherwise(3)).over(W.partitionBy("file").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("before", F.coalesce(before, F.lit(0)))
    rows = df.select("file", "before", F.posexplode(F.when(e % 7 == 0, one).when(e % 11 == 0, two).otherwise(three)).alias("pos", "line"))
    return rows.select("file", (F.col("before") + F.col("pos") + 1).cast("long").alias("line_no"), "line")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = app(spark, sf_dir)
    for part in (json, access, w3c, dsv, log4j):
        out = out.unionByName(part(spark, sf_dir))
    return out
