"""The library's registered queries over log lines rendered from the given tables, and SQL that derives the same rows from the columns."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import levels, text, timestamps
from ..operators import alerts, detect, export, filters, parsers, pins, reports, rules
from ..operators.entries import number_lines, with_seq
from ..session import filesystem, scratch
from ..sources import heads
from ..sources import lines as sources
from ..streaming import deliver, follow, tail
from . import render

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# ---- SQL of the rendered lines

LEVEL = "CASE event_type WHEN 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'FATAL' ELSE 'ERROR' END WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'TRACE' END"
TOKEN = "CASE event_type WHEN 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'CRITICAL' ELSE 'SEVERE' END WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'NOTICE' WHEN 'view' THEN 'debug' ELSE 'FINE' END"
MSG = "(event_type || ' user=' || user_id || ' value=' || CAST(floor(value) AS BIGINT))"
STATUS = "list_extract([200, 201, 301, 404, 500, 503], CAST(event_id % 6 AS INT) + 1)"
METHOD = render.METHOD
STATUS_LEVEL = f"CASE WHEN {STATUS} >= 500 THEN 'ERROR' WHEN {STATUS} >= 400 THEN 'WARN' END"
SEC = "(epoch_us(ts) // 1000000 * 1000)"


def iso(ms: str) -> str:
    return f"(strftime(make_timestamp(CAST({ms} AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z')"


def place(key: str, prefix: str, suffix: str, files: int) -> str:
    """As :func:`render.placed`."""
    return f"'{prefix}' || ({key} % {files} + {files} * ({key} // {files * render.EACH})) || '.{suffix}' AS file, CAST({key} % {files * render.EACH} // {files} + 1 AS BIGINT) AS line_no"


def ev(prefix: str = "app", suffix: str = "log", files: int = 8) -> str:
    return f"(SELECT *, {place('event_id', prefix, suffix, files)} FROM events)"


def parsed(source: str, ts_ms: str, level: str, message: str, raw: str, where: str = "true") -> str:
    return f"(SELECT line_no - 1 AS seq, ts_ms, {iso('ts_ms')} AS ts_iso, level, message, raw, file, line_no FROM (SELECT file, line_no, CAST({ts_ms} AS BIGINT) AS ts_ms, {level} AS level, {message} AS message, {raw} AS raw FROM {source} WHERE {where}))"


BAD = "event_id % 97 = 0"
APP_RAW = f"CASE WHEN {BAD} THEN 'no form here ' || event_id ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || {TOKEN} || ': ' || {MSG} END"
APP = parsed(ev(), f"CASE WHEN {BAD} THEN NULL ELSE {SEC} END", f"CASE WHEN {BAD} THEN NULL ELSE {LEVEL} END", f"CASE WHEN {BAD} THEN 'no form here ' || event_id ELSE {MSG} END", APP_RAW)
THREADS = parsed(ev("thr"), SEC, LEVEL, MSG, f"strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [worker-' || (user_id % 5) || '] ' || {TOKEN} || ': ' || {MSG}")
ENTRY = "seq, ts_ms, ts_iso, level, message, raw, file, line_no"


def app_entries(spark: SparkSession, sf_dir: str, seq: bool = True) -> DataFrame:
    """Entries of the app logs; what doesn't look at sequence numbers goes without them."""
    lines = render.app(spark, sf_dir)
    return with_seq(parsers.parse_pattern(number_lines(lines))) if seq else parsers.parse_pattern(lines)


def thread_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_seq(parsers.parse_pattern(number_lines(render.threads(spark, sf_dir)), "%d [%t] %l: %m"))


# ---- sources


def _files(spark: SparkSession, lines: DataFrame, folder: str | None = None) -> str:
    """Write lines (file, line_no, line) to one text file for each file name, in order, in one folder; a task writes its files one after the other."""
    path = folder or scratch(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(path)
        system.create_dir(root, recursive=True)
        now, out, n = None, None, 0
        try:
            for batch in batches:
                rows = zip(batch.column("file").to_pylist(), batch.column("line").to_pylist(), strict=True)
                for name, own in itertools.groupby(rows, key=lambda r: r[0]):
                    if name != now:
                        if out:
                            out.close()
                        now, out, n = name, system.open_output_stream(f"{root}/{name}"), n + 1
                    out.write("".join(f"{line or ''}\n" for _, line in own).encode())
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    sorted_ = lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "line")
    sorted_.mapInArrow(work, "files long").agg(F.sum("files")).collect()
    return path


@query("src_text_lines", f"SELECT file, line_no, {APP_RAW} AS line FROM {ev()}")
def src_text_lines(spark, sf_dir):
    return sources.read_log_lines(spark, _files(spark, render.app(spark, sf_dir))).select("file", "line_no", "line")


@query("src_line_numbers", f"SELECT file, line_no FROM {ev()} WHERE line_no % 3 > 0")
def src_line_numbers(spark, sf_dir):
    """Every third line is empty: it counts, but isn't there; every other one ends in a carriage return."""
    lines = render.app(spark, sf_dir)
    line = F.when(F.col("line_no") % 3 == 0, "").when(F.col("line_no") % 2 == 0, F.concat("line", F.lit("\r"))).otherwise(F.col("line"))
    got = sources.read_log_lines(spark, _files(spark, lines.withColumn("line", line)))
    return got.filter("NOT endswith(line, '\\r')").select("file", "line_no")


@query("seq_per_file", f"SELECT file, line_no, line_no - 1 AS seq FROM {ev()}")
def seq_per_file(spark, sf_dir):
    return app_entries(spark, sf_dir).select("file", "line_no", "seq")


_EXT = "list_extract(['log', 'TXT', 'csv', 'bin', 'xml', 'out', 'yml', 'exe'], CAST(event_id % 8 AS INT) + 1)"


@query("src_dir_accept", f"SELECT {_EXT} AS ext, count(*) AS lines, sum(event_id)::BIGINT AS ids FROM events WHERE {_EXT} NOT IN ('bin', 'exe') GROUP BY 1")
def src_dir_accept(spark, sf_dir):
    """A folder of files with eight endings, one file in a subfolder; the lines of those that are logs."""
    folder = scratch(spark)
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_id").cast("string").alias("line"))
    for i, ext in enumerate(("log", "TXT", "csv", "bin", "xml", "out", "yml", "exe")):
        ids.filter(F.col("event_id") % 8 == i).select("line").write.mode("append").option("extension", ext).csv(folder)
    ids.select("line").write.option("extension", "log").csv(f"{folder}/below")
    got = sources.read_log_dir(spark, folder)
    return got.groupBy(F.regexp_extract("file", r"\.(\w+)\z", 1).alias("ext")).agg(F.count("*").alias("lines"), F.sum(F.col("line").cast("long")).alias("ids"))


def _zipped(key, frame: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("sub/", "")
        for name, own in frame.sort_values("line_no").groupby("file"):
            z.writestr(f"sub/{name}", "\r\n".join(own["line"]))
    return pd.DataFrame({"path": [f"{key[0]}.zip"], "content": [out.getvalue()]})


@query("src_zip_members", f"SELECT 'a' || (line_no // 500) || file || '.zip' AS path, 'sub/' || file AS file, line_no % 500 + 1 AS line_no, {APP_RAW} AS line FROM {ev()}")
def src_zip_members(spark, sf_dir):
    lines = render.app(spark, sf_dir).withColumn("archive", F.concat(F.lit("a"), F.floor(F.col("line_no") / 500).cast("string"), "file"))
    got = sources.zip_members(lines.groupBy("archive").applyInPandas(_zipped, "path string, content binary"))
    first = lines.groupBy(F.concat("archive", F.lit(".zip")).alias("path")).agg(F.min("line_no").alias("first"))
    return got.join(first, "path").select("path", "file", ((F.col("first") + F.col("line_no") - 1) % 500 + 1).alias("line_no"), "line")


_DOC_LINES = "(SELECT 'doc' || doc_id AS file, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


@query("src_lines_from_column", f"SELECT file, line_no, CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END AS line FROM {_DOC_LINES} WHERE line NOT IN ('', chr(13))")
def src_lines_from_column(spark, sf_dir):
    return sources.lines_from_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))


@query("merge_files", f"SELECT {ENTRY} FROM {APP} UNION ALL SELECT {ENTRY} FROM {THREADS} WHERE file <> 'thr3.log'")
def merge_files(spark, sf_dir):
    both = app_entries(spark, sf_dir), thread_entries(spark, sf_dir)
    files = render.app(spark, sf_dir).select("file").union(render.threads(spark, sf_dir).select("file")).distinct()
    return sources.merge_files(*both, files=files.withColumn("status", F.when(F.col("file") == "thr3.log", "parsing").otherwise("ready")))


_ENC = "CASE doc_id % 4 WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'utf-16be' WHEN 3 THEN CASE WHEN strlen(text) > length(text) THEN 'windows-1252' ELSE 'utf-8' END ELSE 'utf-8' END"


@query("encoding_census", f"SELECT encoding, count(DISTINCT doc_id) AS files, sum(n)::BIGINT AS lines FROM (SELECT doc_id, {_ENC} AS encoding, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')) AS n FROM documents) WHERE n > 0 GROUP BY encoding")
def encoding_census(spark, sf_dir):
    """Files without content, or with nothing but a mark, are read and have no lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = lambda charset: F.encode("text", charset)
    marked = F.when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), own("UTF-16LE"))).when(F.col("doc_id") % 4 == 2, own("UTF-16BE"))
    marked = F.when(F.col("doc_id") % 4 == 2, F.concat(F.unhex(F.lit("FEFF")), own("UTF-16BE"))).otherwise(marked)
    latin = F.encode(F.regexp_replace("text", "[^\\x00-\\xFF]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 4 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 4 == 3, latin).otherwise(marked)
    return sources.encoding_census(docs.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))


@query("decode_chosen", "SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN 'ï»¿' ELSE '' END || regexp_replace(coalesce(text, ''), '[^\x20-\x7E\x0A\u00A0-\u00FF]', '?', 'g'), chr(10)) AS l FROM documents)) WHERE line <> ''")
def decode_chosen(spark, sf_dir):
    """Windows-1252 is chosen, whatever the bytes say: a mark of UTF-8 before every other text isn't its own, so it is read as letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    latin = F.encode(F.regexp_replace("text", "[^\\x20-\\x7E\\x0A\\u00A0-\\u00FF]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), latin)).otherwise(latin)
    got = sources.decode_logs(docs.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")), "windows-1252")
    return got.select(F.col("path").cast("long").alias("doc_id"), "line_no", "line")


@query("table_preview", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS o_orderdate, o_orderpriority, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 1000 AS truncated FROM orders ORDER BY orders.o_orderkey LIMIT 1000")
def table_preview(spark, sf_dir):
    shown, total, truncated = reports.preview(spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey"), 1000)
    return shown.withColumns({"total": F.lit(total).cast("long"), "truncated": F.lit(truncated)})


@query("table_list", "SELECT DISTINCT upper('part_' || p_partkey % 100) AS name FROM part")
def table_list(spark, sf_dir):
    name = F.concat(F.lit("part_"), (F.col("p_partkey") % 100).cast("string"))
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.array(name, F.upper(name), F.concat(F.lit("sqlite_"), name))).alias("name"))
    return reports.list_names(names)


# ---- parsers


@query("parse_pattern_dlm", f"SELECT {ENTRY} FROM {APP}")
def parse_pattern_dlm(spark, sf_dir):
    return app_entries(spark, sf_dir)


@query("parse_pattern_thread", f"SELECT {ENTRY} FROM {THREADS}")
def parse_pattern_thread(spark, sf_dir):
    return thread_entries(spark, sf_dir)


PLAIN = parsed(ev("gc"), "(epoch_us(ts) // 1000)", "NULL", MSG, f"strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ ') || {MSG}")


@query("parse_pattern_dm", f"SELECT {ENTRY.replace('level', 'CAST(level AS VARCHAR) AS level')} FROM {PLAIN}")
def parse_pattern_dm(spark, sf_dir):
    return with_seq(parsers.parse_pattern(number_lines(render.plain(spark, sf_dir)), "%d %m"))


EPOCH = "CASE event_id % 3 WHEN 0 THEN CAST((epoch_us(ts) // 1000) // 1000 AS VARCHAR) WHEN 1 THEN CAST((epoch_us(ts) // 1000) AS VARCHAR) ELSE ((epoch_us(ts) // 1000) // 1000) || '.' || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') END"


@query("parse_pattern_epoch", f"SELECT {ENTRY} FROM {parsed(ev('ep'), f'CASE WHEN event_id % 3 = 0 THEN {SEC} ELSE (epoch_us(ts) // 1000) END', LEVEL, MSG, f'''{EPOCH} || ' ' || {TOKEN} || ': ' || {MSG}''')}")
def parse_pattern_epoch(spark, sf_dir):
    return with_seq(parsers.parse_pattern(number_lines(render.epochs(spark, sf_dir)), "%s %l: %m"))


_SYSFILE, _SYSAT = f"(event_id // {render.SYSLOG_EACH})", f"(event_id % {render.SYSLOG_EACH})"
_JUMPED = f"({_SYSFILE} % 2 = 1 AND {_SYSAT} >= 1500)"
_SYS = f"(SELECT *, CASE WHEN jumped THEN day - INTERVAL 1 YEAR ELSE day END AS inferred FROM (SELECT *, 'sys' || {_SYSFILE} || '.log' AS file, {_SYSAT} + 1 AS line_no, {_JUMPED} AS jumped, TIMESTAMP '2023-07-01 06:00:00' + to_hours({_SYSAT} * {render.SYSLOG_HOURS} + CASE WHEN {_JUMPED} THEN 120 ELSE 0 END) AS day FROM events))"


@query("detect_template", f"SELECT DISTINCT file, '%d %l: %m' AS template FROM {ev()} UNION ALL SELECT DISTINCT file, '%d [%t] %l: %m' FROM {ev('thr')} UNION ALL SELECT DISTINCT file, '%d %m' FROM {ev('gc')} UNION ALL SELECT DISTINCT file, '%S %m' FROM {_SYS}")
def detect_template(spark, sf_dir):
    parts = [f(spark, sf_dir) for f in (render.app, render.threads, render.plain, render.syslog)]
    return detect.detect_template(detect.sample(parts[0].union(parts[1]).union(parts[2]).union(parts[3])))


@query("parse_syslog", f"SELECT line_no - 1 AS seq, epoch_ms(inferred) AS ts_ms, {iso('epoch_ms(inferred)')} AS ts_iso, CAST(NULL AS VARCHAR) AS level, 'host app[' || user_id || ']: ' || event_type AS message, strftime(day, '%b %d %H:%M:%S') || ' host app[' || user_id || ']: ' || event_type AS raw, file, line_no FROM {_SYS}")
def parse_syslog(spark, sf_dir):
    return with_seq(parsers.parse_syslog_lines(number_lines(render.syslog(spark, sf_dir)), 2023))


_WHOLE = f"""'{{' || CASE event_id % 3 WHEN 0 THEN '"@timestamp":"' || {iso('(epoch_us(ts) // 1000)')} || '"' WHEN 1 THEN '"ts":' || (epoch_us(ts) // 1000) ELSE '"time":"' || ((epoch_us(ts) // 1000) // 1000) || '"' END || ',' || CASE WHEN event_id % 3 = 1 THEN '"severity":' || (user_id % 9) ELSE '"level":"' || {TOKEN} || '"' END || CASE WHEN event_id % 13 = 0 THEN '' ELSE ',"msg":"' || {MSG} || '"' END || '}}'"""
_JBAD = "(event_id % 50 = 0 OR event_id % 51 = 0)"
_JRAW = f"""CASE WHEN event_id % 50 = 0 THEN '{{"ts":' || event_id WHEN event_id % 51 = 0 THEN '[' || {_WHOLE} || ']' ELSE {_WHOLE} END"""
_SEVERITY = "CASE user_id % 9 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'FATAL' WHEN 2 THEN 'FATAL' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARN' WHEN 5 THEN 'INFO' WHEN 6 THEN 'INFO' WHEN 7 THEN 'DEBUG' END"
JSON = parsed(ev("json", "json", 3), f"CASE WHEN {_JBAD} THEN NULL WHEN event_id % 3 = 2 THEN {SEC} ELSE (epoch_us(ts) // 1000) END", f"CASE WHEN {_JBAD} THEN NULL WHEN event_id % 3 = 1 THEN {_SEVERITY} ELSE {LEVEL} END", f"CASE WHEN {_JBAD} OR event_id % 13 = 0 THEN {_JRAW} ELSE {MSG} END", _JRAW)


@query("parse_json_lines", f"SELECT {ENTRY} FROM {JSON}")
def parse_json_lines(spark, sf_dir):
    lines, out = number_lines(render.json(spark, sf_dir), blank=False), None
    for i, (ts, level) in enumerate((("@timestamp", "level"), ("ts", "severity"), ("time", "level"))):
        own = parsers.parse_json_lines(lines.filter(F.regexp_extract("file", r"(\d+)", 1).cast("long") % 3 == i), ts, level, "msg")
        out = own if out is None else out.union(own)
    return with_seq(out)


@query("json_key_resolution", f"SELECT file, list_extract(['@timestamp', 'ts', 'time'], CAST(k AS INT) + 1) AS ts_key, CASE WHEN k = 1 THEN 'severity' ELSE 'level' END AS level_key, 'msg' AS msg_key FROM (SELECT DISTINCT file, event_id % 3 AS k FROM {ev('json', 'json', 3)})")
def json_key_resolution(spark, sf_dir):
    return detect.resolve_json_keys(render.json(spark, sf_dir))


_WBAD = "event_id % 71 = 0"
_WTIME = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_WBODY = f"(SELECT * REPLACE (line_no + 2 AS line_no) FROM {ev('iis', files=2)})"
_WRAW = f"CASE WHEN {_WBAD} THEN {_WTIME} ELSE {_WTIME} || ' 10.0.0.' || (user_id % 250) || ' ' || {METHOD} || ' /p ' || {STATUS} || CASE WHEN event_id % 5 = 0 THEN ' agent 1.0' ELSE ' agent' END END"
W3C = f"""(SELECT {ENTRY} FROM {parsed(_WBODY, f"CASE WHEN {_WBAD} THEN NULL ELSE {SEC} END", f"CASE WHEN {_WBAD} THEN NULL ELSE {STATUS_LEVEL} END", f"CASE WHEN {_WBAD} THEN {_WTIME} ELSE '10.0.0.' || (user_id % 250) || ' ' || {METHOD} || ' /p ' || {STATUS} END", _WRAW)}
UNION ALL SELECT DISTINCT 0, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), '#Version: 1.0', '#Version: 1.0', file, 1 FROM {ev('iis', files=2)}
UNION ALL SELECT DISTINCT 1, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), '#Fields: {" ".join(render.W3C_FIELDS)}', '#Fields: {" ".join(render.W3C_FIELDS)}', file, 2 FROM {ev('iis', files=2)})"""


@query("parse_w3c", f"SELECT {ENTRY} FROM {W3C}")
def parse_w3c(spark, sf_dir):
    return with_seq(parsers.parse_w3c(number_lines(render.w3c(spark, sf_dir), blank=False), render.W3C_FIELDS))


_AWALL = "CASE WHEN user_id % 2 = 1 THEN strftime(ts + INTERVAL '5 hours 30 minutes', '%d/%b/%Y:%H:%M:%S') || ' +0530' ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' END"
_ABAD = "event_id % 89 = 0"
_AREQ = f"{METHOD} || ' /p/' || (event_id % 40) || CASE WHEN event_id % 7 = 0 THEN '' ELSE ' HTTP/1.1' END"
_ARAW = f"""CASE WHEN {_ABAD} THEN 'no request' ELSE '10.0.0.' || (user_id % 250) || ' - - [' || {_AWALL} || '] "' || {_AREQ} || '" ' || {STATUS} || ' 512' || CASE WHEN event_id % 2 = 0 THEN ' "-" "agent 1.0"' ELSE '' END END"""
ACCESS = parsed(ev("access", files=2), f"CASE WHEN {_ABAD} THEN NULL ELSE {SEC} END", f"CASE WHEN {_ABAD} THEN NULL ELSE {STATUS_LEVEL} END", f"CASE WHEN {_ABAD} THEN 'no request' ELSE {_AREQ} || ' ' || {STATUS} END", _ARAW)


@query("parse_access_log", f"SELECT {ENTRY} FROM {ACCESS}")
def parse_access_log(spark, sf_dir):
    return with_seq(parsers.parse_access_log(number_lines(render.access(spark, sf_dir), blank=False)))


_ORD = f"(SELECT *, {place('o_orderkey', 'orders', 'txt', 2)}, o_orderdate AS ts FROM orders)"
DSV = parsed(_ORD, SEC, "CASE o_orderstatus WHEN 'O' THEN 'INFO' WHEN 'F' THEN 'ERROR' END", "o_orderpriority || ' | ' || o_orderkey", "strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(9) || CASE o_orderstatus WHEN 'O' THEN 'info' WHEN 'F' THEN 'Error' ELSE '?' END || chr(9) || o_orderpriority || chr(9) || o_orderkey")


@query("parse_dsv", f"SELECT {ENTRY} FROM {DSV}")
def parse_dsv(spark, sf_dir):
    return with_seq(parsers.parse_dsv(number_lines(render.dsv(spark, sf_dir), blank=False), "\t", 0, 1))


_XKIND = "CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 11 = 0 THEN 2 ELSE 3 END"
_XTEXT = f"CASE {_XKIND} WHEN 1 THEN '' WHEN 2 THEN {MSG} || ' <&amp;>' ELSE {MSG} || ' more & more' END"
_XRAW = f"""CASE {_XKIND} WHEN 1 THEN '<log4j:event logger="a" timestamp="' || (epoch_us(ts) // 1000) || '" level="' || {TOKEN} || '"/>' WHEN 2 THEN '<LogRecord level="' || {TOKEN} || '" timeMillis="' || (epoch_us(ts) // 1000) || '">' || chr(10) || '<Message>' || {MSG} || ' &lt;&amp;amp;&gt;</Message>' || chr(10) || '</LogRecord>' ELSE '<log4j:event logger="a" timestamp="' || (epoch_us(ts) // 1000) || '" level="' || {TOKEN} || '" thread="main">' || chr(10) || '  <log4j:message>' || {MSG} || chr(10) || chr(9) || 'more &amp; more</log4j:message></log4j:event>' END"""
_XEND = f"CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 3 END) OVER (PARTITION BY file ORDER BY event_id) AS BIGINT)"
LOG4J = f"(SELECT row_number() OVER (PARTITION BY file ORDER BY event_id) - 1 AS seq, (epoch_us(ts) // 1000) AS ts_ms, {iso('(epoch_us(ts) // 1000)')} AS ts_iso, {LEVEL} AS level, {_XTEXT} AS message, {_XRAW} AS raw, file, {_XEND} AS line_no FROM {ev('l4j', 'xml', 2)})"


@query("parse_log4j_xml", f"SELECT {ENTRY} FROM {LOG4J}")
def parse_log4j_xml(spark, sf_dir):
    return with_seq(parsers.parse_log4j_xml(render.log4j(spark, sf_dir)))


_SPLIT = f"(SELECT *, {place('event_id', 'pipe', 'txt', 4)}, event_id % 4 AS k, list_extract(['|', ';', ',', chr(9)], CAST(event_id % 4 AS INT) + 1) AS delimiter FROM events)"


@query("detect_dsv", f"SELECT DISTINCT file, delimiter, CAST(k % 3 AS INT) AS ts_col, CASE WHEN k < 3 THEN CAST((k + 1) % 3 AS INT) END AS level_col FROM {_SPLIT}")
def detect_dsv(spark, sf_dir):
    """Files with four delimiters; the timestamp and the level change places, and some have no level."""
    e, k = render.placed(_events(spark, sf_dir), "event_id", "pipe", "txt", 4), F.col("event_id") % 4
    stamp, level, text_ = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(k == 3, "none").otherwise(render.token()), F.col("event_type")
    cells = F.when(k % 3 == 0, F.array(stamp, level, text_)).when(k == 1, F.array(text_, stamp, level)).otherwise(F.array(level, text_, stamp))
    mark = F.element_at(F.array(*map(F.lit, ("|", ";", ",", "\t"))), (k + 1).cast("int"))
    lines = e.withColumns({"cells": cells, "mark": mark}).select("file", "line_no", F.expr("array_join(cells, mark)").alias("line"))
    return detect.detect_dsv(detect.sample(lines))


@query("detect_format", f"""SELECT DISTINCT file, 'pattern' AS kind, '%d %l: %m' AS detail FROM {ev()} UNION ALL SELECT file, 'json', list_extract(['@timestamp', 'ts', 'time'], CAST(k AS INT) + 1) || CASE WHEN k = 1 THEN ' severity' ELSE ' level' END || ' msg' FROM (SELECT DISTINCT file, event_id % 3 AS k FROM {ev('json', 'json', 3)})
UNION ALL SELECT DISTINCT file, 'combined', '' FROM {ev('access', files=2)} UNION ALL SELECT DISTINCT file, 'w3c', '{" ".join(render.W3C_FIELDS)}' FROM {ev('iis', files=2)} UNION ALL SELECT DISTINCT file, 'dsv', chr(9) || ' 0 1' FROM {_ORD} UNION ALL SELECT DISTINCT file, 'log4j-xml', '' FROM {ev('l4j', 'xml', 2)}""")
def detect_format(spark, sf_dir):
    got = detect.detect_format(render.mixed(spark, sf_dir))
    return got.select("file", "kind", F.concat_ws(" ", "template", "ts_key", "level_key", "msg_key", F.array_join("fields", " "), "delimiter", F.col("ts_col").cast("string"), F.col("level_col").cast("string")).alias("detail"))


@query("parse_mixed_corpus", " UNION ALL ".join(f"SELECT {ENTRY} FROM {x}" for x in (APP, JSON, ACCESS, W3C, DSV, LOG4J)))
def parse_mixed_corpus(spark, sf_dir):
    lines, parsed_ = scratch(spark), scratch(spark)
    render.mixed(spark, sf_dir).write.parquet(lines)
    detect.parse_logs(spark.read.parquet(lines)).write.parquet(parsed_)
    return with_seq(spark.read.parquet(parsed_))


@query("parse_quality", f"SELECT file, count(*) AS total, count(*) FILTER (ts_ms IS NULL AND level IS NULL) AS raw_entries FROM {APP} GROUP BY file")
def parse_quality(spark, sf_dir):
    return reports.parse_quality(app_entries(spark, sf_dir, False))


# ---- functions


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("level_normalize", f"SELECT event_id, {LEVEL} AS level, CAST(NULL AS VARCHAR) AS none FROM events")
def level_normalize(spark, sf_dir):
    padded = F.concat(F.lit("\t "), F.lower(render.token()), F.lit(" "))
    return _events(spark, sf_dir).select("event_id", levels.normalize_level(padded).alias("level"), levels.normalize_level(F.concat(render.token(), F.lit("x"))).alias("none"))


@query("level_from_status", "SELECT event_id, CASE WHEN s >= 500 AND s <= 999 THEN 'ERROR' WHEN s >= 400 AND s < 500 THEN 'WARN' END AS level FROM (SELECT event_id, event_id % 1100 AS s FROM events)")
def level_from_status(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", levels.level_from_status((F.col("event_id") % 1100).cast("string")).alias("level"))


@query("level_from_severity", f"SELECT event_id, {_SEVERITY} AS level FROM events")
def level_from_severity(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", levels.level_from_severity(F.col("user_id") % 9).alias("level"))


@query("ts_iso_parse", "SELECT event_id, (epoch_us(ts) // 1000) AS utc, (epoch_us(ts) // 1000) - 19800000 AS offset_ms, epoch_ms(date_trunc('day', ts) + INTERVAL '1 day 2 hours') AS rolled, epoch_ms(make_date(CAST(year(ts) AS BIGINT) + 1, 1, 1)::TIMESTAMP + INTERVAL 44 DAY) AS month13 FROM events")
def ts_iso_parse(spark, sf_dir):
    full = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return _events(spark, sf_dir).select(
        "event_id", timestamps.parse_timestamp(F.concat(full, F.lit("Z"))).alias("utc"), timestamps.parse_timestamp(F.concat(F.replace(F.replace(full, F.lit("T"), F.lit(" ")), F.lit("."), F.lit(",")), F.lit("+05:30"))).alias("offset_ms"),
        timestamps.parse_timestamp(F.date_format("ts", "yyyy-MM-dd 26:00:00")).alias("rolled"), timestamps.parse_timestamp(F.date_format("ts", "yyyy'-13-45 00:00:00'")).alias("month13"),
    )


@query("ts_ordinal_parse", "SELECT event_id, epoch_ms(date_trunc('day', ts)) AS day, epoch_ms(date_trunc('second', ts)) AS timed, CAST(NULL AS BIGINT) AS none FROM events")
def ts_ordinal_parse(spark, sf_dir):
    p = timestamps.parse_timestamp
    return _events(spark, sf_dir).select("event_id", p(F.date_format("ts", "yyyy-DDD")).alias("day"), p(F.date_format("ts", "yyyy-DDD'T'HH:mm:ss'Z'")).alias("timed"), p(F.date_format("ts", "yyyy'-367'")).alias("none"))


@query("ts_clf_parse", "SELECT event_id, epoch_ms(date_trunc('second', ts)) AS bare, epoch_ms(date_trunc('second', ts)) + 9000000 AS zoned, CAST(NULL AS BIGINT) AS short FROM events")
def ts_clf_parse(spark, sf_dir):
    p, clf = timestamps.parse_timestamp, F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    return _events(spark, sf_dir).select("event_id", p(clf).alias("bare"), p(F.concat(clf, F.lit(" -0230"))).alias("zoned"), p(F.date_format("ts", "M/d/yy HH:mm:ss")).alias("short"))


@query("ts_naive_modes", "SELECT event_id, epoch_ms(date_trunc('second', ts)) AS utc, epoch_ms(date_trunc('second', ts)) - 32400000 AS tokyo, epoch_ms(date_trunc('second', ts)) AS named FROM events")
def ts_naive_modes(spark, sf_dir):
    v = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return _events(spark, sf_dir).select("event_id", timestamps.parse_timestamp(v).alias("utc"), timestamps.parse_timestamp(v, "Asia/Tokyo").alias("tokyo"), timestamps.parse_timestamp(F.concat(v, F.lit("Z")), "Asia/Tokyo").alias("named"))


@query("ts_json_value", "SELECT event_id, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) // 1000 * 1000 AS s, (epoch_us(ts) // 1000) // 1000 * 1000 AS digits, (epoch_us(ts) // 1000) AS iso FROM events")
def ts_json_value(spark, sf_dir):
    ms = F.unix_millis("ts")
    s, p = F.floor(ms / 1000).cast("string"), timestamps.parse_json_timestamp
    return _events(spark, sf_dir).select("event_id", p(ms.cast("string"), F.lit(True)).alias("ms"), p(s, F.lit(True)).alias("s"), p(s, F.lit(False)).alias("digits"), p(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(False)).alias("iso"))


@query("ts_epoch_parse", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (epoch_us(ts) // 1000) // 1000 * 1000 ELSE (epoch_us(ts) // 1000) END AS ms, CAST(NULL AS BIGINT) AS short FROM events")
def ts_epoch_parse(spark, sf_dir):
    ms = F.unix_millis("ts")
    s = F.floor(ms / 1000).cast("string")
    token = F.when(F.col("event_id") % 3 == 0, s).when(F.col("event_id") % 3 == 1, ms.cast("string")).otherwise(F.concat(s, F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0")))
    return _events(spark, sf_dir).select("event_id", timestamps.parse_epoch(token).alias("ms"), timestamps.parse_epoch(F.left(s, F.lit(8))).alias("short"))


@query("ts_syslog_year", f"SELECT file, year(inferred) AS year, count(*) AS n FROM {_SYS} GROUP BY ALL")
def ts_syslog_year(spark, sf_dir):
    got = parse_syslog(spark, sf_dir)
    return got.groupBy("file", F.year(F.timestamp_millis("ts_ms")).cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("ts_to_iso", f"SELECT event_id, {iso('(epoch_us(ts) // 1000)')} AS iso, CAST(NULL AS VARCHAR) AS none FROM events")
def ts_to_iso(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", timestamps.to_iso(F.unix_millis("ts")).alias("iso"), timestamps.to_iso(F.lit(None).cast("long")).alias("none"))


@query("xml_unescape", f"SELECT event_id, '<' || {MSG} || '> \"&lt;\" ''' AS message FROM events")
def xml_unescape(spark, sf_dir):
    raw = F.concat(F.lit(" &lt;"), F.replace(render.message(), F.lit(" "), F.lit("\n\t ")), F.lit("&gt;\n&quot;&amp;lt;&quot; &apos; "))
    return _events(spark, sf_dir).select("event_id", text.xml_unescape(text.collapse_space(raw)).alias("message"))


@query("truncate_message", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '…' ELSE text END AS message FROM documents")
def truncate_message(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.truncate_message(F.col("text")).alias("message"))


@query("cell_normalize", "SELECT event_id, '<binary ' || strlen(props) || ' bytes>' AS blob, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, CAST(user_id AS VARCHAR) AS big, '[\"' || event_type || '\",null]' AS nested FROM events")
def cell_normalize(spark, sf_dir):
    df = _events(spark, sf_dir).select("event_id", F.col("props").cast("binary").alias("blob"), "ts", F.col("user_id").alias("big"), F.array("event_type", F.lit(None)).alias("nested"))
    return df.select("event_id", *[text.normalize_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields[1:]])


def _csv(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[\",\\n\\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@query("csv_line", f"SELECT doc_id, {_csv('_T')} || ',' || {_csv('_S')} AS line FROM documents".replace("_T", "coalesce(text, '')").replace("_S", "coalesce(source, '')"))
def csv_line(spark, sf_dir):
    """Null texts and sources are empty cells."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.csv_line(F.col("text"), F.col("source")).alias("line"))


# ---- filters

_TEXT = "(contains(lower(message), '{0}') OR contains(lower(raw), '{0}'))"


@query("filter_text", f"SELECT {ENTRY} FROM {APP} WHERE {_TEXT.format('purchase user=1')}")
def filter_text(spark, sf_dir):
    return filters.apply_filters(app_entries(spark, sf_dir), "PURCHASE user=1")


@query("filter_levels", f"SELECT {ENTRY} FROM {APP} WHERE level IN ('WARN', 'FATAL')")
def filter_levels(spark, sf_dir):
    return filters.apply_filters(app_entries(spark, sf_dir), levels=["WARN", "FATAL"])


@query("filter_combined", f"SELECT {ENTRY} FROM {APP} WHERE {_TEXT.format('value=1')} AND level IN ('ERROR', 'WARN')")
def filter_combined(spark, sf_dir):
    return filters.apply_filters(app_entries(spark, sf_dir), "value=1", ["ERROR", "WARN"])


@query("filter_file", f"SELECT {ENTRY} FROM {APP} WHERE contains(lower(coalesce(file, '')), 'app3')")
def filter_file(spark, sf_dir):
    return app_entries(spark, sf_dir).filter(filters.file_condition("APP3"))


def _saved(spark) -> DataFrame:
    return spark.createDataFrame([("errors", "", ["ERROR", "FATAL"], 3), ("user 7", "user=7", [], 2), ("none", "%", [], 1), ("all", "", [], 4)], "name string, text string, levels array<string>, saved_at long")


@query("saved_filter_hits", f"SELECT 'errors' AS name, 3 AS saved_at, count(*) AS hits FROM {APP} WHERE level IN ('ERROR', 'FATAL') UNION ALL SELECT 'user 7', 2, count(*) FROM {APP} WHERE {_TEXT.format('user=7')} UNION ALL SELECT 'none', 1, count(*) FROM {APP} WHERE {_TEXT.format('%')} UNION ALL SELECT 'all', 4, count(*) FROM {APP}")
def saved_filter_hits(spark, sf_dir):
    return filters.saved_filter_hits(app_entries(spark, sf_dir, False), _saved(spark)).orderBy(F.desc("saved_at"))


def _customers(spark, sf_dir, where) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter(where)
    return c.select(F.concat(F.lit("f"), (F.col("c_custkey") % 50).cast("string")).alias("name"), F.col("c_mktsegment").alias("text"), F.array(F.lit("WARN")).alias("levels"), F.col("c_custkey").alias("saved_at"))


@query("saved_filter_upsert", "SELECT name, c_mktsegment AS text, c_custkey AS saved_at FROM (SELECT *, 'f' || (c_custkey % 50) AS name, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey % 3 = 0 DESC, c_custkey DESC) AS n FROM customer) WHERE n = 1 AND name <> 'f7'")
def saved_filter_upsert(spark, sf_dir):
    return filters.upsert_filters(_customers(spark, sf_dir, "c_custkey % 3 <> 0"), _customers(spark, sf_dir, "c_custkey % 3 = 0"), ["f7"]).drop("levels")


@query("filter_counts", f"SELECT count(*) AS total, count(*) FILTER ({_TEXT.format('signup')} AND level IN ('INFO')) AS visible FROM {APP}")
def filter_counts(spark, sf_dir):
    return filters.filter_counts(app_entries(spark, sf_dir, False), "signup", ["INFO"])


@query("scope_file", f"SELECT {ENTRY} FROM {APP} WHERE file <> 'app2.log'")
def scope_file(spark, sf_dir):
    return app_entries(spark, sf_dir).filter("file <> 'app2.log'")


@query("log_view", f"SELECT ts_iso AS time, coalesce(level, '–') AS level, message, file, line_no FROM {APP}")
def log_view(spark, sf_dir):
    return filters.log_view(app_entries(spark, sf_dir, False))


# ---- rules and pins


def _rules(spark) -> DataFrame:
    rows = [(0, "r0", "purchase user=1", [], "", "#111111"), (1, "r1", "", ["ERROR"], "app1", "#222222"), (2, "r2", "user=1", [], "", "#333333"), (3, "r3", "value=5", ["WARN", "INFO"], "", "#444444"), (4, "r4", "", ["FATAL"], "", "#555555")]
    return spark.createDataFrame(rows, "priority int, id string, text string, levels array<string>, file string, color string")


_CONDITIONS = {"r0": _TEXT.format("purchase user=1"), "r1": "level IN ('ERROR') AND contains(lower(file), 'app1')", "r2": _TEXT.format("user=1"), "r3": f"{_TEXT.format('value=5')} AND level IN ('WARN', 'INFO')", "r4": "level IN ('FATAL')"}
_WON = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _CONDITIONS.items()) + " END"
_COLOR = "CASE rule_id " + " ".join(f"WHEN 'r{i}' THEN '#{str(i + 1) * 6}'" for i in range(5)) + " END"
_CLASSED = f"(SELECT file, line_no, level, {_WON} AS rule_id FROM {APP})"


@query("rule_first_match", f"SELECT file, line_no, rule_id, {_COLOR} AS color FROM {_CLASSED}")
def rule_first_match(spark, sf_dir):
    return rules.classify(app_entries(spark, sf_dir, False), _rules(spark)).select("file", "line_no", "rule_id", "color")


@query("rule_with_level_fallback", f"SELECT file, line_no, coalesce({_COLOR}, CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.TINTS.items()) + f" END) AS color FROM {_CLASSED}")
def rule_with_level_fallback(spark, sf_dir):
    return rules.with_level_fallback(rules.classify(app_entries(spark, sf_dir, False), _rules(spark))).select("file", "line_no", "color")


@query("rule_hit_counts", " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) FILTER ({c}) AS matched, count(*) FILTER (({_WON}) = '{k}') AS won FROM {APP}" for k, c in _CONDITIONS.items()))
def rule_hit_counts(spark, sf_dir):
    return rules.hit_counts(app_entries(spark, sf_dir, False), _rules(spark))


_LAST_FIRST = "CASE " + " ".join(f"WHEN {_CONDITIONS[k]} THEN '{k}'" for k in ("r4", "r0", "r1", "r2", "r3")) + " END"


@query("rule_reorder", f"SELECT file, line_no, {_LAST_FIRST} AS rule_id FROM {APP}")
def rule_reorder(spark, sf_dir):
    """The last rule is moved to the top: it now wins where others did."""
    return rules.classify(app_entries(spark, sf_dir, False), rules.reorder(_rules(spark), "r4", 0)).select("file", "line_no", "rule_id")


@query("rules_sanitize", f"SELECT CAST(c_custkey AS INT) AS priority, c_name AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS text, CASE WHEN c_custkey % 2 = 0 THEN 'WARN' ELSE '' END AS levels, '' AS file, CASE WHEN c_custkey % 5 = 0 THEN '#AAbb01' ELSE '{rules.DEFAULT_COLOR}' END AS color FROM customer WHERE c_custkey % 7 <> 0")
def rules_sanitize(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    raw = c.select(
        k.cast("int").alias("priority"), F.when(k % 14 == 0, "").when(k % 7 != 0, F.col("c_name")).alias("id"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("text"), F.when(k % 2 == 0, F.array(F.lit("WARN"), F.lit("warn"), F.lit(None))).otherwise(F.array(F.lit("LOUD"))).alias("levels"),
        F.lit(None).cast("string").alias("file"), F.when(k % 5 == 0, "#AAbb01").when(k % 5 == 1, "red").when(k % 5 == 2, "#12345").alias("color"),
    )
    return rules.sanitize_rules(raw).withColumn("levels", F.array_join("levels", ","))


@query("saved_filters_sanitize", "SELECT c_name AS name, '' AS text, 'ERROR' AS levels, greatest(c_custkey - 100, 0) AS saved_at FROM customer WHERE c_custkey % 6 <> 0")
def saved_filters_sanitize(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = c.select(F.when(F.col("c_custkey") % 6 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("text"), F.array(F.lit("ERROR"), F.lit("x")).alias("levels"), (F.col("c_custkey") - 100).alias("saved_at"))
    return filters.sanitize_filters(raw).withColumn("levels", F.array_join("levels", ","))


@query("alert_config_sanitize", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'http://h/' || c_custkey ELSE '' END AS url, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS text, 'WARN,FATAL' AS levels, '' AS file FROM customer")
def alert_config_sanitize(spark, sf_dir):
    k = F.col("c_custkey")
    raw = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("http://h/"), k.cast("string"))).alias("url"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("text"), F.array(F.lit("WARN"), F.lit("loud"), F.lit(None), F.lit("FATAL")).alias("levels"), F.lit(None).cast("string").alias("file")
    )
    return filters.sanitize_alerts(raw).withColumn("levels", F.array_join("levels", ","))


def _pins(spark, sf_dir, every: int, word: str) -> DataFrame:
    """Pins on every so many events, each twice: the first counts."""
    e = render.events(spark, sf_dir).filter(F.col("event_id") % every == 0)
    return e.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), "*").select((F.col("event_id") * 2 + F.col("n")).alias("pos"), F.concat(F.lit(word), F.col("event_id").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("id"), "file", "line_no", F.concat(F.lit(f"{word} note "), F.col("n").cast("string")).alias("note"))


@query("pins_annotate", f"SELECT a.file, a.line_no, CASE WHEN e.event_id % 20 = 0 THEN 'p' || e.event_id || '-0' END AS pin_id, CASE WHEN e.event_id % 20 = 0 THEN 'p note 0' END AS note FROM {APP} a JOIN {ev()} e ON a.file = e.file AND a.line_no = e.line_no")
def pins_annotate(spark, sf_dir):
    return pins.annotate(app_entries(spark, sf_dir, False), _pins(spark, sf_dir, 20, "p")).select("file", "line_no", "pin_id", "note")


@query("pins_merge", f"SELECT CASE WHEN event_id % 20 = 0 THEN 'p' ELSE 'q' END || event_id || '-0' AS id, file, line_no, CASE WHEN event_id % 30 = 0 THEN 'q note 0' ELSE 'p note 0' END AS note FROM {ev()} WHERE event_id % 20 = 0 OR event_id % 30 = 0")
def pins_merge(spark, sf_dir):
    return pins.merge(_pins(spark, sf_dir, 20, "p"), _pins(spark, sf_dir, 30, "q"))


@query("pins_sanitize", f"SELECT 'p' || event_id AS id, file, line_no, '' AS note FROM {ev()} WHERE event_id % 3 = 1")
def pins_sanitize(spark, sf_dir):
    e, k = render.events(spark, sf_dir), F.col("event_id")
    raw = e.select(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("id"), "file", F.when(k % 3 == 2, 0.9).otherwise(F.col("line_no") + 0.5).alias("line_no"), F.lit(None).cast("string").alias("note"))
    return pins.sanitize(raw)


@query("pins_locate", f"SELECT 'p' || event_id || '-0' AS id, v.file, v.line_no, position FROM (SELECT file, line_no, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS position FROM {APP} WHERE level IN ('WARN', 'ERROR')) v JOIN {ev()} e ON v.file = e.file AND v.line_no = e.line_no WHERE event_id % 20 = 0")
def pins_locate(spark, sf_dir):
    view = filters.apply_filters(app_entries(spark, sf_dir, False), levels=["WARN", "ERROR"])
    return pins.locate(view, _pins(spark, sf_dir, 20, "p")).withColumn("position", F.col("position").cast("long"))


@query("pins_orphaned", f"SELECT 'p' || event_id || '-' || n AS id, file, line_no FROM {ev()}, (SELECT unnest([0, 1]) AS n) WHERE event_id % 20 = 0 AND file IN ('app0.log', 'app4.log')")
def pins_orphaned(spark, sf_dir):
    left = app_entries(spark, sf_dir, False).filter("file NOT IN ('app0.log', 'app4.log')")
    return pins.orphaned(_pins(spark, sf_dir, 20, "p"), left).select("id", "file", "line_no")


@query("pins_add", f"SELECT CASE WHEN event_id % 20 = 0 THEN 'p' ELSE 'q' END || event_id || '-0' AS id, file, line_no FROM {ev()} WHERE (event_id % 20 = 0 AND event_id <> 40) OR (event_id % 30 = 0 AND event_id % 20 <> 0)")
def pins_add(spark, sf_dir):
    own = pins.first_pins(_pins(spark, sf_dir, 20, "p"))
    return pins.add(own, _pins(spark, sf_dir, 30, "q").select(*own.columns), ["p40-0"]).select("id", "file", "line_no")


# ---- reports


@query("report_level_counts", f"SELECT coalesce(level, '(none)') AS level, count(*) AS n FROM {APP} GROUP BY 1")
def report_level_counts(spark, sf_dir):
    return reports.level_counts(app_entries(spark, sf_dir, False))


@query("report_entries_per_minute", f"SELECT replace(left(ts_iso, 16), 'T', ' ') AS minute, count(*) AS n FROM {APP} WHERE ts_iso IS NOT NULL GROUP BY 1")
def report_entries_per_minute(spark, sf_dir):
    return reports.entries_per_minute(app_entries(spark, sf_dir, False))


@query("report_top_messages", f"SELECT message, count(*) AS n FROM {APP} GROUP BY 1 ORDER BY n DESC, message LIMIT 50")
def report_top_messages(spark, sf_dir):
    return reports.top_messages(app_entries(spark, sf_dir, False))


@query("report_entries_per_file", f"SELECT coalesce(file, '(unknown)') AS file, count(*) AS n FROM {APP} GROUP BY 1")
def report_entries_per_file(spark, sf_dir):
    return reports.entries_per_file(app_entries(spark, sf_dir, False))


@query("file_inventory", f"SELECT file, greatest(min(user_id) - 5, 0) AS size, CASE WHEN file = 'app7.log' THEN 0 ELSE max(line_no) END AS lines, CASE WHEN file = 'app7.log' THEN 0 ELSE count(*) END AS entries, 'utf-8' AS encoding, CASE WHEN file < 'app4' THEN 'ready' ELSE 'parsing' END AS status FROM {ev()} GROUP BY file")
def file_inventory(spark, sf_dir):
    files = render.events(spark, sf_dir).groupBy("file").agg((F.min("user_id") - 5).alias("size"), F.lit("utf-8").alias("encoding"))
    files = files.withColumn("status", F.when(F.col("file") < "app4", "ready").otherwise("odd"))
    return reports.file_inventory(app_entries(spark, sf_dir, False).filter("file <> 'app7.log'"), files)


def _sql(name: str, text_: str, asked: str | None = None) -> None:
    """A query that is free SQL over the entries.

    ``asked`` asks Spark for the same rows in a form whose work grows with the entries alone.  The entries are then written first: else parsing
    moves into the conditions of semi and anti joins, where each row is parsed many times.
    """

    def work(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = app_entries(spark, sf_dir)
        if asked:
            path = scratch(spark)
            found.write.parquet(path)
            found = spark.read.schema(found.schema).parquet(path)
        return reports.ad_hoc(found, asked or text_)

    query(name, f"WITH entries AS (SELECT {ENTRY} FROM {APP}) {text_}")(work)


_sql("sql_count", "SELECT count(*) AS n FROM entries")
_sql("sql_where_level", "SELECT file, line_no, message FROM entries WHERE level = 'WARN'")
_sql("sql_group_having", "SELECT file, level, count(*) AS n FROM entries GROUP BY file, level HAVING count(*) > 20")
_sql("sql_self_join", "SELECT a.file, a.line_no, b.line_no AS next_no FROM entries a JOIN entries b ON a.file = b.file AND b.line_no = a.line_no + 1 WHERE a.level = 'FATAL' AND b.level = 'WARN'")
_sql("sql_distinct_agg", "SELECT level, count(DISTINCT file) AS files, count(DISTINCT message) AS messages FROM entries GROUP BY level")
_sql("sql_window_rank", "SELECT file, line_no, rank() OVER (PARTITION BY level ORDER BY ts_ms DESC, file, line_no) AS place FROM entries WHERE level IS NOT NULL")
_sql("sql_set_ops", "SELECT message FROM entries WHERE level = 'WARN' INTERSECT SELECT message FROM entries WHERE file <> 'app1.log' EXCEPT SELECT message FROM entries WHERE file = 'app2.log'")
_sql(
    "sql_semi_anti",
    "SELECT file, line_no FROM entries e WHERE EXISTS (SELECT 1 FROM entries w WHERE w.message = e.message AND w.line_no > e.line_no) AND e.level NOT IN (SELECT level FROM entries WHERE line_no = 1 AND level IS NOT NULL)",
    # one row for each message and each level: no row is compared with all that share its message, nor with each file's first line
    "SELECT file, line_no FROM entries e WHERE EXISTS (SELECT 1 FROM (SELECT message, max(line_no) AS last FROM entries GROUP BY message) w WHERE w.message = e.message AND w.last > e.line_no) AND e.level NOT IN (SELECT DISTINCT level FROM entries WHERE line_no = 1 AND level IS NOT NULL)",
)
_sql("sql_rollup", "SELECT file, level, count(*) AS n FROM entries GROUP BY ROLLUP (file, level)")


@query("result_capped", f"SELECT level, ts_ms, file, line_no, (SELECT count(*) FROM {APP} WHERE level = 'DEBUG') AS total, (SELECT count(*) FROM {APP} WHERE level = 'DEBUG') > 150 AS truncated FROM {APP} WHERE level = 'DEBUG' ORDER BY file, line_no LIMIT 150")
def result_capped(spark, sf_dir):
    found = app_entries(spark, sf_dir, False).filter("level = 'DEBUG'").select("level", "ts_ms", "file", "line_no").orderBy("file", "line_no")
    shown, total, truncated = reports.capped(found, 150)
    return shown.withColumns({"total": F.lit(total).cast("long"), "truncated": F.lit(truncated)})


# ---- exports and alerts


def _cell(c: str) -> str:
    return _csv(f"coalesce(CAST({c} AS VARCHAR), '')")


@query("export_csv_rows", f"SELECT file, line_no, {' || chr(44) || '.join(_cell(c) for c in export.CSV_COLUMNS)} AS line FROM {APP}")
def export_csv_rows(spark, sf_dir):
    return export.csv_rows(app_entries(spark, sf_dir, False))


def _js(c: str) -> str:
    return f"coalesce('\"' || {c} || '\"', 'null')"


@query("export_json_rows", f"""SELECT file, line_no, '{{"ts":' || {_js('ts_iso')} || ',"level":' || {_js('level')} || ',"message":' || {_js('message')} || ',"raw":' || {_js('raw')} || ',"file":' || {_js('file')} || ',"lineNo":' || line_no || '}}' AS line FROM {APP}""")
def export_json_rows(spark, sf_dir):
    return export.json_rows(app_entries(spark, sf_dir, False))


def _live(spark, sf_dir) -> DataFrame:
    """Entries with the delivery that brought them: a tenth of a file at a time; the first two are history."""
    e = app_entries(spark, sf_dir, False)
    e = e.withColumn("delivery", F.col("line_no") % 10).withColumn("arrival", F.concat(F.lpad(F.col("line_no").cast("string"), 12, "0"), "file"))
    return e.withColumn("live", F.col("delivery") >= 2)


_LIVE = f"(SELECT *, line_no % 10 AS delivery, lpad(CAST(line_no AS VARCHAR), 12, '0') || file AS arrival FROM {APP})"
_MATCHED = f"(SELECT * FROM {_LIVE} WHERE delivery >= 2 AND {_TEXT.format('user=')} AND level IN ('ERROR', 'WARN') AND contains(lower(file), 'app'))"


def _matched(spark, sf_dir) -> DataFrame:
    return alerts.alert_matches(_live(spark, sf_dir), "http://host/hook", "User=", ["ERROR", "WARN"], "APP")


@query("alert_matches", f"SELECT file, line_no, delivery FROM {_MATCHED}")
def alert_matches(spark, sf_dir):
    disarmed = alerts.alert_matches(_live(spark, sf_dir), "  ")
    return _matched(spark, sf_dir).unionByName(disarmed).select("file", "line_no", "delivery")


@query("alert_backlog_cap", f"SELECT file, line_no FROM (SELECT *, row_number() OVER (PARTITION BY delivery ORDER BY arrival DESC) AS n FROM {_MATCHED}) WHERE n <= 100")
def alert_backlog_cap(spark, sf_dir):
    return alerts.backlog(_matched(spark, sf_dir), most=100).select("file", "line_no")


@query("alert_batches", f"SELECT delivery, (n - 1) // 50 AS batch, count(*) AS items, arg_min(message, n) AS first_message, arg_max(message, n) AS last_message FROM (SELECT *, row_number() OVER (PARTITION BY delivery ORDER BY arrival) AS n FROM {_MATCHED}) GROUP BY 1, 2")
def alert_batches(spark, sf_dir):
    got = alerts.alert_batches(_matched(spark, sf_dir), spread=True)
    return got.select("delivery", F.col("batch").cast("long").alias("batch"), F.size("entries").cast("long").alias("items"), F.element_at("entries", 1)["message"].alias("first_message"), F.element_at("entries", -1)["message"].alias("last_message"))


@query("alert_payloads", f"SELECT file AS f, line_no AS lineno, ts_iso AS stamp, level, message FROM {_MATCHED}")
def alert_payloads(spark, sf_dir):
    got = alerts.payload_json(alerts.alert_batches(_matched(spark, sf_dir), spread=True))
    back = F.from_json("payload", "entries array<struct<file:string,lineNo:long,timestamp:string,level:string,message:string>>")
    return got.select(F.explode(back["entries"]).alias("i")).select(F.col("i.file").alias("f"), F.col("i.lineNo").alias("lineno"), F.col("i.timestamp").alias("stamp"), "i.level", "i.message")


# ---- streaming


@query("stream_dir_ingest", f"SELECT {ENTRY} FROM {APP}")
def stream_dir_ingest(spark, sf_dir):
    folder, out, check = _files(spark, render.app(spark, sf_dir)), scratch(spark), scratch(spark)
    follow.follow_dir(spark, folder, out, check, files_per_batch=3).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def _segments(spark, sf_dir) -> DataFrame:
    """Each file's lines as segments of 40."""
    app = render.app(spark, sf_dir)
    return app.select(F.concat("file", F.lit("."), F.floor((F.col("line_no") - 1) / 40).cast("string")).alias("segment"), ((F.col("line_no") - 1) % 40 + 1).alias("line_no"), "line")


@query("segment_line_numbers", f"SELECT file, line_no, raw AS line FROM {APP}")
def segment_line_numbers(spark, sf_dir):
    return alerts.segment_line_numbers(_segments(spark, sf_dir)).drop("epoch")


@query("stream_segments", f"SELECT file, max(line_no) AS lines, count(DISTINCT line_no) AS numbers FROM {APP} GROUP BY file")
def stream_segments(spark, sf_dir):
    """Files of a folder as segments: the first part file of each log, then its second half."""
    folder, out, check = scratch(spark), scratch(spark), scratch(spark)
    app = render.app(spark, sf_dir)
    for half in (0, 1):
        _files(spark, app.filter(F.col("line_no") % 2 == half).withColumn("file", F.concat("file", F.lit(f".{half}"))), folder)
    follow.follow_segments(spark, folder, out, check, 8).awaitTermination()
    return spark.read.parquet(out).groupBy("file").agg(F.max("line_no").alias("lines"), F.countDistinct("line_no").alias("numbers"))


_TURNS = f"(SELECT *, (line_no - 1) // 40 AS n, (line_no - 1) // 120 AS epoch FROM {APP})"


@query("stream_rotation", f"SELECT file, epoch, line_no - epoch * 120 AS line_no, raw AS line FROM {_TURNS} QUALIFY epoch = max(epoch) OVER (PARTITION BY file)")
def stream_rotation(spark, sf_dir):
    """Segments of 40 lines, and a log that is rotated with each third: sizes grow from 40 to 120 and fall to 40 again."""
    folder, out, check = scratch(spark), scratch(spark), scratch(spark)
    named = _segments(spark, sf_dir)
    n = F.regexp_extract("segment", r"\.(\d+)\z", 1).cast("long")
    # a rotation is a size that is less than the one before; the poll after it reads the new file from its begin
    seen = named.select(F.regexp_extract("segment", r"^(.*)\.\d+\z", 1).alias("file"), n.alias("n")).distinct()
    grown = seen.select("file", F.col("n").alias("poll_no"), (F.col("n") % 3 * 40 + 40).alias("size"))
    _files(spark, named.withColumnRenamed("segment", "file"), folder)
    follow.follow_segments(spark, folder, out, check, 10_000, grown).awaitTermination()
    return alerts.latest_epoch(spark.read.parquet(out)).select("file", "epoch", "line_no", "line")


@query("latest_epoch", f"SELECT file, line_no FROM {APP} WHERE line_no % 3 = CASE WHEN file = 'app0.log' THEN 1 ELSE 2 END")
def latest_epoch(spark, sf_dir):
    e = app_entries(spark, sf_dir, False).withColumn("epoch", F.col("line_no") % 3).filter("NOT (file = 'app0.log' AND epoch = 2)")
    return alerts.latest_epoch(e).select("file", "line_no")


@query("dir_diff", "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'added' END AS event, 'o' || o_orderkey || '.log' AS name, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE o_orderkey + 1 END AS size FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 3 = 0)")
def dir_diff(spark, sf_dir):
    """Before: all but each third file; after: all but each fifth, every file a byte longer."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".log")).alias("name"), F.col("o_orderkey").alias("size"))
    return reports.dir_diff(o.filter("size % 3 <> 0"), o.filter("size % 5 <> 0").withColumn("size", F.col("size") + 1))


_POLL = f"(SELECT *, CASE WHEN event_id % 11 = 0 THEN -1 ELSE user_id * (event_id % 4) END AS size FROM {ev()})"


@query("poll_classify", f"""WITH RECURSIVE p AS (SELECT file, line_no, size FROM {_POLL}),
s AS (SELECT file, line_no, size, CASE WHEN size < 0 THEN 'removed' WHEN size <= 0 THEN 'none' ELSE 'bytes' END AS event, CAST(greatest(size, 0) AS BIGINT) AS n_bytes, CAST(greatest(size, 0) AS BIGINT) AS pos, CASE WHEN size >= 0 THEN size END AS prev FROM p WHERE line_no = 1
UNION ALL SELECT p.file, p.line_no, p.size, CASE WHEN p.size < 0 THEN 'removed' WHEN p.size < s.prev THEN 'rotate' WHEN p.size <= s.pos THEN 'none' ELSE 'bytes' END, CASE WHEN p.size < 0 OR p.size < s.prev OR p.size <= s.pos THEN 0 ELSE p.size - s.pos END,
  CASE WHEN p.size < 0 THEN s.pos WHEN p.size < s.prev THEN 0 ELSE greatest(p.size, s.pos) END, CASE WHEN p.size < 0 THEN s.prev WHEN p.size < s.prev THEN NULL ELSE p.size END FROM s JOIN p ON p.file = s.file AND p.line_no = s.line_no + 1)
SELECT file, line_no AS poll_no, size, event, n_bytes FROM s""")
def poll_classify(spark, sf_dir):
    e = render.events(spark, sf_dir)
    size = F.when(F.col("event_id") % 11 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id") * (F.col("event_id") % 4))
    return alerts.poll_classify(e.select("file", F.col("line_no").alias("poll_no"), size.alias("size")))


@query("alert_sink", f"SELECT file AS f, level, message FROM {APP} WHERE level = 'FATAL'")
def alert_sink(spark, sf_dir):
    """Payloads of a followed folder, written batch by batch, and what is in them."""
    out = scratch(spark)
    rows = follow.stream_rows(spark, _files(spark, render.app(spark, sf_dir)), 2)
    entries = parsers.parse_pattern(rows.select("file", F.lit(None).cast("long").alias("line_no"), F.col("value").alias("line")))
    sink = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/of={batch}")
    follow.alert_sink(entries, sink, scratch(spark), "http://host/hook", levels=["FATAL"], history=0).awaitTermination()
    item = F.explode(F.from_json("payload", "entries array<struct<file:string,level:string,message:string>>")["entries"])
    return spark.read.parquet(out).select(item.alias("i")).select(F.col("i.file").alias("f"), "i.level", "i.message")


@query("stream_progress", f"SELECT count(*) AS lines, count(*) AS entries, sum(strlen(raw) + 1)::BIGINT AS bytes, 0.5::DOUBLE AS fraction FROM {APP}")
def stream_progress(spark, sf_dir):
    """What a query has read of twice as many bytes."""
    lines, progress = render.app(spark, sf_dir), scratch(spark)
    follow.follow_dir(spark, _files(spark, lines), scratch(spark), scratch(spark), files_per_batch=2, progress=progress).awaitTermination()
    total = lines.agg(F.sum(F.octet_length("line") + 1)).first()[0]
    return follow.progress_of(spark, progress, 2 * total).select("lines", "entries", "bytes", "fraction")


# ---- one file of many splits, blocks of scans, text between events, heads, growth


def _one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the app logs in the order of the events: k, from 0, and line."""
    lines = render.app(spark, sf_dir)
    n = F.regexp_extract("file", r"(\d+)\.log", 1).cast("long")
    return lines.select((8 * render.EACH * F.floor(n / 8) + (F.col("line_no") - 1) * 8 + n % 8).alias("k"), "line")


def _joined(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """Write sorted lines to one file: parts are written by all tasks, and one copies their bytes in order, a MiB at a time."""
    parts = scratch(spark)
    lines.write.text(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches
        system, folder = filesystem(parts)
        out, to = filesystem(path)
        out.create_dir(to.rsplit("/", 1)[0], recursive=True)
        with out.open_output_stream(to) as f:
            for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda x: x.base_name):
                if info.base_name.startswith("part-"):
                    with system.open_input_stream(info.path) as part:
                        while data := part.read(sources.PIECE):
                            f.write(data)

    spark.range(0, 1, 1, 1).mapInArrow(work, "id long").collect()


@query("src_one_file_splits", f"SELECT event_id + 1 AS line_no, event_id AS seq, {APP_RAW} AS line FROM {ev()}")
def src_one_file_splits(spark, sf_dir):
    """All events in one file, which is read in splits of 64 KiB; other splits hold when the result is read."""
    folder, size = scratch(spark), spark.conf.get("spark.sql.files.maxPartitionBytes")
    _joined(spark, _one_file(spark, sf_dir).orderBy("k").select("line"), f"{folder}/all.log")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        got = sources.read_log_lines(spark, folder)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return got.select("line_no", "seq", "line")


@query("parse_syslog_blocks", ORACLES["parse_syslog"])
def parse_syslog_blocks(spark, sf_dir):
    """Years over blocks of 300 lines."""
    return with_seq(parsers.parse_syslog_lines(number_lines(render.syslog(spark, sf_dir)), 2023, block=300))


@query("parse_log4j_between", f"SELECT {ENTRY.replace('line_no', '2 * line_no AS line_no')} FROM {LOG4J}")
def parse_log4j_between(spark, sf_dir):
    """Other text ahead of each event; more of it than the limit holds in all, less before any event."""
    lines = render.log4j(spark, sf_dir)
    begins = F.col("line").startswith("<log4j:event") | F.col("line").startswith("<LogRecord")
    noise = lines.filter(begins).select("file", (2 * F.col("line_no") - 1).alias("line_no"), F.lit("<!-- no event -->").alias("line"))
    return with_seq(parsers.parse_log4j_xml(lines.withColumn("line_no", 2 * F.col("line_no")).unionByName(noise), idle=600))


@query("detect_heads", f"SELECT DISTINCT file, 'pattern' AS kind FROM {ev()} UNION ALL SELECT DISTINCT file, 'json' FROM {ev('json', 'json', 3)} UNION ALL SELECT DISTINCT file, 'combined' FROM {ev('access', files=2)}")
def detect_heads(spark, sf_dir):
    """Formats of written files by their first 16 KiB."""
    lines = render.app(spark, sf_dir).unionByName(render.json(spark, sf_dir)).unionByName(render.access(spark, sf_dir))
    return detect.detect_heads(heads.read_heads(spark, _files(spark, lines), most=16_384)).select("file", "kind")


def _rewritten(spark: SparkSession, lines: DataFrame, folder: str) -> None:
    """Write each file of lines (file, line_no, line, ends) anew, under its own name, in a task of its own."""

    def work(key, frame: pd.DataFrame) -> pd.DataFrame:
        system, path = filesystem(f"{folder}/{key[0]}")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        frame = frame.sort_values("line_no")
        data = "".join(x + ("\n" if ends else "") for x, ends in zip(frame["line"], frame["ends"], strict=True)).encode()
        with system.open_output_stream(path) as f:
            f.write(data)
        return pd.DataFrame({"size": [len(data)]})

    lines.groupBy("file").applyInPandas(work, "size long").agg(F.sum("size")).collect()


@query("stream_growth", f"SELECT file, 0::BIGINT AS epoch, line_no, seq, level, message FROM {APP} UNION ALL SELECT file, 1, line_no, seq, level, message FROM {APP} WHERE line_no <= 100 AND file IN ('app1.log', 'app3.log', 'app5.log', 'app7.log')")
def stream_growth(spark, sf_dir):
    """Files that hold 60 lines and half of one, then all of them, of which four begin anew with 100 lines: three polls of one query."""
    folder, out, check = scratch(spark), scratch(spark), scratch(spark)
    lines = render.app(spark, sf_dir).withColumn("ends", F.lit(True))
    half = F.when(F.col("line_no") == 61, F.substring("line", 1, 9)).otherwise(F.col("line"))
    begun = lines.filter("line_no <= 61").withColumn("line", half).withColumn("ends", F.col("line_no") < 61)
    turned = lines.filter("line_no <= 100 AND file IN ('app1.log', 'app3.log', 'app5.log', 'app7.log')")
    for now in (begun, lines, turned):
        _rewritten(spark, now, folder)
        tail.follow_growing(spark, folder, out, check, range_bytes=8192).awaitTermination()
    return spark.read.parquet(out).select("file", "epoch", "line_no", "seq", "level", "message")


@query("alert_deliveries", f"SELECT file AS f, level, message FROM {APP} WHERE level = 'FATAL'")
def alert_deliveries(spark, sf_dir):
    """Alerts of a followed folder, seven to a payload, by count and, for those that are left, by time; each payload is a file, which its key names."""
    folder, check, ledger, got = _files(spark, render.app(spark, sf_dir)), scratch(spark), scratch(spark), scratch(spark)

    def send(target: str, key: str, payload: str) -> None:
        system, path = filesystem(got)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{key.encode().hex()}.json") as f:
            f.write(payload.encode())

    rows = follow.stream_rows(spark, folder, 4)
    entries = parsers.parse_pattern(rows.select("file", F.lit(None).cast("long").alias("line_no"), F.col("value").alias("line")))
    live = alerts.alert_matches(entries.withColumn("live", F.lit(True)), "http://host/hook", levels=["FATAL"])
    out = deliver.payloads(live, F.lit("http://host/hook"), 7, most=1_000_000, window=1)
    deliver.finish(deliver.deliver(out, send, ledger, check, every="200 milliseconds"))
    item = F.explode(F.from_json("value", "entries array<struct<file:string,level:string,message:string>>")["entries"])
    return spark.read.text(got, wholetext=True).select(item.alias("i")).select(F.col("i.file").alias("f"), "i.level", "i.message")


@query("parse_json_repeated_keys", f"SELECT file, line_no, CASE WHEN event_id % 3 = 2 THEN {SEC} ELSE (epoch_us(ts) // 1000) END AS ts_ms, CASE WHEN event_id % 3 = 1 THEN {_SEVERITY} ELSE {LEVEL} END AS level, CASE WHEN event_id % 13 = 0 THEN 'first' ELSE {MSG} END AS message FROM {ev('json', 'json', 3)} WHERE NOT {_JBAD}")
def parse_json_repeated_keys(spark, sf_dir):
    """Objects that have their level and message twice: the last ones count."""
    first = F.when(F.col("line").contains('"severity"'), '{"severity":9,"msg":"first",').otherwise('{"level":"TRACE","msg":"first",')
    lines = render.json(spark, sf_dir).filter("startswith(line, '{') AND endswith(line, '}')").withColumn("line", F.concat(first, F.substring("line", 2, 1_000_000)))
    return detect.parse_logs(lines).select("file", "line_no", "ts_ms", "level", "message")
