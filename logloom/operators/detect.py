"""Format detection: the first lines of each file decide on its parser."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.levels import normalize_level
from ..functions.text import is_blank
from ..functions.timestamps import is_timestamp, parse_syslog
from ..session import scratch
from ..sources.heads import read_heads
from . import parsers
from .parsers import ACCESS, AUTO_TEMPLATES, DEFAULT_TEMPLATE, fields, json_object

SAMPLE = 200
# Names of JSON keys, the preferred first; delimiters in the order they are tried.
TS_KEYS = ("@timestamp", "ts", "time", "timestamp", "datetime", "date", "t", "_time")
LEVEL_KEYS = ("level", "severity", "lvl", "loglevel", "syslogseverity")
MSG_KEYS = ("msg", "message", "text", "body")
DELIMITERS = ("\t", "|", ";", ",")


def sample(lines: DataFrame) -> DataFrame:
    """The lines that detection looks at."""
    return lines.filter((F.col("line_no") <= SAMPLE) & ~is_blank(F.col("line")))


def resolve_json_keys(lines: DataFrame) -> DataFrame:
    """file, ts_key, level_key, msg_key: the first known name that any object of the file has."""
    parsers.last_key_wins(lines.sparkSession)
    v = json_object(F.col("line"))
    text = F.when(v.isNotNull(), F.col("line"))
    keys = lines.select("file", F.explode(F.json_object_keys(text)).alias("key"))

    def best(names: tuple[str, ...]) -> Column:
        rank = F
        for i, n in enumerate(names):
            rank = rank.when(F.col("key") == n, i)
        return F.get(F.array(*map(F.lit, names)), F.min(rank))

    return keys.groupBy("file").agg(best(TS_KEYS).alias("ts_key"), best(LEVEL_KEYS).alias("level_key"), best(MSG_KEYS).alias("msg_key"))


def template_scores(lines: DataFrame) -> DataFrame:
    """file and, for each template, the share of lines in which it finds a timestamp or a level."""
    line, found = F.col("line"), []
    for t in AUTO_TEMPLATES:
        ok = fields(line, t, lambda fits, f: fits & ((is_timestamp(f["%d"]) if "%d" in f else parse_syslog(f["%S"], F.lit(2001)).isNotNull()) | (normalize_level(f["%l"]).isNotNull() if "%l" in f else F.lit(False))))
        found.append(F.coalesce(ok, F.lit(False)).cast("int"))
    return lines.groupBy("file").agg(*[F.avg(c).alias(f"s{i}") for i, c in enumerate(found)])


def detect_template(lines: DataFrame) -> DataFrame:
    """file and the template with the best score; the earlier one wins ties."""
    scores = template_scores(lines)
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(AUTO_TEMPLATES))])
    pick = F
    for i, t in enumerate(AUTO_TEMPLATES):
        pick = pick.when(F.col(f"s{i}") == top, t)
    return scores.select("file", pick.alias("template"))


def detect_dsv(lines: DataFrame) -> DataFrame:
    """file, delimiter, ts_col, level_col of the files with one consistent delimiter."""
    cut = [F.split("line", re.escape(d), -1) for d in DELIMITERS]
    # numbers of cells alone are counted; lines are cut into cells by the delimiter that is chosen
    counts = lines.select("file", F.posexplode(F.array(*map(F.size, cut))).alias("rank", "n")).groupBy("file", "rank", "n").agg(F.count("*").alias("c"))
    good = counts.groupBy("file", "rank").agg(F.max("n").alias("most"), F.max_by("c", "n").alias("full"), F.sum("c").alias("rows")).filter("most >= 2 AND full / rows >= 0.95")
    chosen = good.groupBy("file").agg(F.min("rank").alias("rank"), F.first("rows").alias("rows"))
    chosen = chosen.withColumn("delimiter", F.get(F.array(*map(F.lit, DELIMITERS)), F.col("rank")))
    cells = F
    for i, c in enumerate(cut):
        cells = cells.when(F.col("rank") == i, c)
    each = lines.select("file", "line").join(chosen.select("file", "rank", "rows"), "file").select("file", "rows", F.posexplode(cells).alias("pos", "cell"))
    hits = each.groupBy("file", "pos").agg((F.count_if(is_timestamp(F.col("cell"))) / F.first("rows") >= 0.5).alias("ts"), (F.count(normalize_level(F.col("cell"))) / F.first("rows") >= 0.5).alias("level"))
    ts = hits.filter("ts").groupBy("file").agg(F.min("pos").alias("ts_col"))
    level = hits.filter("level").join(ts, "file", "left").filter("ts_col IS NULL OR pos <> ts_col").groupBy("file").agg(F.min("pos").alias("level_col"))
    return chosen.select("file", "delimiter").join(ts, "file", "left").join(level, "file", "left")


def detect_format(lines: DataFrame) -> DataFrame:
    """One row for each file: kind (json, w3c, combined, log4j-xml, dsv or pattern) and what its parser needs.

    Of lines that are a table already, all are looked at for the files that there are; :func:`detect_files` reads the heads of files alone.
    """
    return _detect(lines.filter(F.col("line_no") <= SAMPLE), lines.select("file").distinct())


def detect_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """As :func:`detect_format`, of files, of which the first MiB alone is read: see :func:`logloom.sources.heads.read_heads`."""
    return detect_heads(read_heads(spark, path, glob, lines=SAMPLE))


def detect_heads(first: DataFrame) -> DataFrame:
    """As :func:`detect_format`, of the heads of files (file, line_no, line), which are read once: a file that has no line in them is left out."""
    return _detect(first.filter(F.col("line_no") <= SAMPLE), None)


def _detect(first: DataFrame, files: DataFrame | None) -> DataFrame:
    spark, path = first.sparkSession, scratch(first.sparkSession)
    parsers.last_key_wins(spark)
    first = first.select("file", "line_no", "line")
    first.write.parquet(f"{path}/lines")  # a few hundred lines of each file, which several counts look at
    some = spark.read.schema(first.schema).parquet(f"{path}/lines")
    files, some = some.select("file").distinct() if files is None else files, sample(some)
    line = F.col("line")
    first_fields = F.first(F.when(line.startswith("#Fields:"), line), ignorenulls=True).over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    some = some.withColumn("fields", F.filter(F.split(F.trim(F.substr(first_fields, F.lit(9))), r"\s+"), lambda x: x != ""))
    parts = F.split("line", " ", -1)
    data = ~line.startswith("#")
    row_ok = data & (F.size(parts) >= F.size("fields")) & is_timestamp(F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    stats = some.groupBy("file").agg(
        F.count("*").alias("n"),
        F.count_if(json_object(line).isNotNull()).alias("objects"),
        F.first("fields").alias("fields"),
        F.count_if(data).alias("data"),
        F.count_if(F.coalesce(row_ok, F.lit(False))).alias("wide"),
        F.count_if(line.rlike(ACCESS)).alias("requests"),
        F.count_if(line.contains("<log4j:event") | line.contains("<LogRecord")).alias("events"),
    )
    all_ = files.join(stats, "file", "left").join(detect_dsv(some), "file", "left")
    n = F.col("n")
    # The order in which formats are tried, and the share or number of lines that each asks for.
    kind = (
        F.when(n.isNull(), "pattern")
        .when(F.col("objects") >= F.greatest(F.lit(1), F.ceil(n * 0.9)), "json")
        .when((F.col("data") > 0) & (F.col("wide") / F.col("data") >= 0.8), "w3c")
        .when((F.col("requests") >= 2) & (F.col("requests") / n >= 0.8), "combined")
        .when((F.col("events") > 0) & (F.col("events") >= F.ceil(n * 0.1)), "log4j-xml")
        .when(F.col("delimiter").isNotNull(), "dsv")
        .otherwise("pattern")
    )
    kinds = all_.withColumn("kind", kind).select("file", "kind", "fields", "delimiter", "ts_col", "level_col")
    kinds.write.parquet(f"{path}/kinds")
    kinds = spark.read.schema(kinds.schema).parquet(f"{path}/kinds")
    # templates are tried on the lines of pattern files alone, and keys are looked for in those of JSON files
    own = lambda k: some.select("file", "line").join(kinds.filter(F.col("kind") == k).select("file"), "file", "left_semi")
    kinds = kinds.join(detect_template(own("pattern")), "file", "left").join(resolve_json_keys(own("json")), "file", "left")
    of = lambda k, c: F.when(F.col("kind") == k, F.col(c)).alias(c)
    return kinds.select(
        "file", "kind", F.when(F.col("kind") == "pattern", F.coalesce("template", F.lit(DEFAULT_TEMPLATE))).alias("template"), of("w3c", "fields"),
        of("json", "ts_key"), of("json", "level_key"), of("json", "msg_key"), of("dsv", "delimiter"), of("dsv", "ts_col"), of("dsv", "level_col"),
    )


def parse_logs(lines: DataFrame, specs: DataFrame | None = None, start_year: int = 2024, tz: str = "UTC") -> DataFrame:
    """Entries of files of any format.

    The lines are read once and written by distinct spec (there are a few, however many files); each spec's parser then reads its own
    lines.  Log4j events have no sequence number yet, so none has.
    """
    spark = lines.sparkSession
    specs = detect_format(lines) if specs is None else specs
    columns = [c for c in specs.columns if c != "file"]
    path, kinds = scratch(spark), scratch(spark)
    named = specs.withColumn("__spec", F.sha2(F.to_json(F.struct(*columns)), 256))
    named.write.parquet(kinds)
    named = spark.read.parquet(kinds)
    of_file = named.select(F.col("file").alias("__f"), "__spec")
    part = ["file", "line_no", "line"]
    lines.join(of_file, F.col("file").eqNullSafe(F.col("__f"))).select(*part, F.col("__spec").alias("spec")).write.partitionBy("spec").parquet(path)
    out = None
    for r in named.select("__spec", *columns).dropDuplicates(["__spec"]).orderBy("__spec").collect():
        own = spark.read.schema(lines.select(*part).schema).parquet(f"{path}/spec={r['__spec']}")
        if r["kind"] == "json":
            got = parsers.parse_json_lines(own, r["ts_key"], r["level_key"], r["msg_key"], tz)
        elif r["kind"] == "w3c":
            got = parsers.parse_w3c(own, r["fields"], tz)
        elif r["kind"] == "combined":
            got = parsers.parse_access_log(own, tz)
        elif r["kind"] == "log4j-xml":
            got = parsers.parse_log4j_xml(own, tz)
        elif r["kind"] == "dsv":
            got = parsers.parse_dsv(own, r["delimiter"], r["ts_col"], r["level_col"], tz)
        elif "%S" in r["template"]:
            got = parsers.parse_syslog_lines(own, start_year, r["template"], tz)
        else:
            got = parsers.parse_pattern(own, r["template"], tz)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else parsers.parse_pattern(lines.select(*part))
