"""Parsers: lines (file, line_no, line) in, entries out.  A line that doesn't fit is kept as a raw entry, none is lost."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import level_from_severity, level_from_status, normalize_level
from ..functions.text import ANY, SPACE, collapse_space, is_blank, js_trim, let, xml_unescape
from ..functions.timestamps import parse_epoch, parse_json_timestamp, parse_syslog, parse_timestamp, with_timestamp
from .entries import BLOCK, entries, scan
from .log4j import cut_events

# What each specifier of a template matches.
SPECIFIERS = {
    "%d": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
    r"|\d{4}-\d{3}(?:[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?)?"
    r"|\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?"
    r"|\d{1,2}[/-]\d{1,2}[/-]\d{2,4} \d{2}:\d{2}:\d{2}",
    "%S": r"[A-Za-z]{3} {1,2}\d{1,2} \d{2}:\d{2}:\d{2}",
    "%s": r"\d{9,16}(?:\.\d{1,9})?",
    "%l": r"[A-Za-z]+",
    "%t": r"[A-Za-z0-9_\-.\[\]:]+",
    "%m": ANY + "*",
}
DEFAULT_TEMPLATE = "%d %l: %m"
AUTO_TEMPLATES = (DEFAULT_TEMPLATE, "%d [%t] %l: %m", "%d %m", "%S %m")
_CUT = "\u0001\u0002\u0001"


def compile_pattern(template: str) -> tuple[str, list[str]]:
    """An anchored regex for a template, and the specifier of each group."""
    pieces = re.split("(%[a-zA-Z])", template)
    groups = pieces[1::2]
    if not groups:
        raise ValueError("the template has no specifiers")
    for g in groups:
        if g not in SPECIFIERS:
            raise ValueError(f"unknown specifier: {g}")
    quoted = ["".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in p) for p in pieces[::2]]
    return "^" + quoted[0] + "".join(f"({SPECIFIERS[g]}){q}" for g, q in zip(groups, quoted[1:], strict=True)) + r"\z", groups


def cells(line: Column, template: str) -> tuple[Column, list[str]]:
    """The parts of a line that a template's groups match, behind an empty first part (the line alone if it doesn't fit), and the specifiers."""
    pattern, groups = compile_pattern(template)

    def cut(pattern: str, mark: str) -> Column:
        return F.split(F.regexp_replace(line, pattern, mark + mark.join(f"${i}" for i in range(1, len(groups) + 1))), mark, -1)

    # most lines have no odd line end and not the mark: for them a message is the rest, and splitting at one character needs no regex
    odd = [F.contains(line, F.lit(c)) for c in (_CUT[0], "\r", "\u2028", "\u2029")]
    return F.when(reduce(lambda x, y: x | y, odd), cut(pattern, _CUT)).otherwise(cut(pattern.replace(ANY + "*", "(?s:.*)"), _CUT[0])), groups


def fields(line: Column, template: str, f: Callable[[Column, dict[str, Column]], Column]) -> Column:
    """``f`` of whether a line fits a template and of its fields; the first of a specifier counts.  The regex runs once."""
    found, groups = cells(line, template)
    return let(found, lambda x: f(F.size(x) == len(groups) + 1, {g: F.get(x, F.lit(groups.index(g) + 1)) for g in groups}))


def parse_pattern(lines: DataFrame, template: str = DEFAULT_TEMPLATE, tz: str = "UTC") -> DataFrame:
    """Lines of a template; empty lines are left out, blank ones kept raw."""
    if "%S" in template and "%d" not in template and "%s" not in template:
        raise ValueError("dates without a year need parse_syslog_lines")

    found, groups = cells(F.col("line"), template)
    rows = lines.filter("line <> ''").withColumn("__c", found)
    fits = F.size("__c") == len(groups) + 1
    field = lambda g: F.when(fits, F.get("__c", F.lit(groups.index(g) + 1)))
    if "%d" in groups:
        rows = with_timestamp(rows, field("%d"), "__ts", tz)
    else:
        rows = rows.withColumn("__ts", parse_epoch(field("%s")) if "%s" in groups else F.lit(None).cast("long"))
    level = normalize_level(field("%l")) if "%l" in groups else F.lit(None).cast("string")
    message = F.when(fits, field("%m") if "%m" in groups else F.lit("")).otherwise(F.col("line"))
    return entries(rows, F.col("__ts"), level, message)


def parse_syslog_lines(lines: DataFrame, start_year: int, template: str = "%S %m", tz: str = "UTC", forward: int = 48 * 3_600_000, backward: int = 355 * 86_400_000, block: int = BLOCK) -> DataFrame:
    """Lines whose dates have no year: it is inferred in file order.

    A date more than ``forward`` ms after the one before belongs to the year before, one more than ``backward`` ms
    behind to the next year.  A step depends on two neighbouring dates alone, so the year is a sum of steps: one scan.
    """
    def entry(fits: Column, f: dict[str, Column]) -> Column:
        level = normalize_level(f["%l"]) if "%l" in f else F.lit(None).cast("string")
        return F.struct(F.when(fits, f["%S"]).alias("date"), F.when(fits, level).alias("level"), F.when(fits, f.get("%m", F.lit(""))).otherwise(F.col("line")).alias("message"))

    rows = lines.filter("line <> ''").withColumn("__e", fields(F.col("line"), template, entry))
    rows = rows.withColumn("__t", parse_syslog(F.col("__e.date"), F.lit(2001), tz))

    def step(before: Column, now: Column) -> Column:
        gap = now - before
        return F.when(gap > forward, -1).when(gap < -backward, 1).otherwise(0).cast("long")

    t, zero = F.col("__t"), F.lit(0).cast("long")
    # inside a block: the date before, this row's step from it, and the steps before; the first date's own step is the block's
    rows = scan(
        rows,
        lambda w: {"__last": F.last("__t", ignorenulls=True).over(w), "__step": F.when(F.col("__last").isNotNull(), step(F.col("__last"), t)).otherwise(zero), "__steps": F.coalesce(F.sum("__step").over(w), zero)},
        {"__first_t": F.min_by("__t", F.when(t.isNotNull(), F.col("line_no"))), "__last_t": F.max_by("__t", F.when(t.isNotNull(), F.col("line_no"))), "__sum": F.sum("__step")},
        lambda w: {"__own": F.coalesce(step(F.last("__last_t", ignorenulls=True).over(w), F.col("__first_t")), zero), "__years": F.coalesce(F.sum(F.col("__own") + F.col("__sum")).over(w), zero) + F.col("__own")},
        block=block,
    )
    return entries(rows, parse_syslog(F.col("__e.date"), F.lit(start_year) + F.col("__years") + F.col("__steps") + F.col("__step"), tz), F.col("__e.level"), F.col("__e.message"))


def last_key_wins(spark: SparkSession) -> None:
    """Of keys that a JSON object has twice the last one counts, as elsewhere; Spark takes such objects for broken unless the session says so."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def json_object(line: Column) -> Column:
    """The line as a variant (in an array of one), null unless it is exactly one JSON object."""
    v = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    one = F.schema_of_variant(v).startswith("ARRAY<OBJECT") & F.try_variant_get(v, "$[1]", "variant").isNull()
    return F.when(line.rlike(f"^[{SPACE}]*\\{{") & one, v)


def parse_json_lines(lines: DataFrame, ts_key: str | None = "ts", level_key: str | None = "level", msg_key: str | None = "msg", tz: str = "UTC") -> DataFrame:
    """One JSON object a line; levels may be names or syslog severities; without a message the whole line is it.

    Of keys that come twice the last one counts (a setting of the session, which this makes).
    """
    last_key_wins(lines.sparkSession)
    number = r"^(BIGINT|DECIMAL|DOUBLE)"
    nothing = F.lit(None).cast("string")

    def value(v: Column, key: str | None) -> Column:
        """As text, its JSON type, and as JSON; looked up once."""
        if key is None:
            return F.struct(nothing.alias("text"), nothing.alias("kind"), nothing.alias("json"))
        one = F.try_variant_get(v, f"$[0]['{key}']", "variant")
        return let(one, lambda x: F.struct(x.try_cast("string").alias("text"), F.schema_of_variant(x).alias("kind"), F.to_json(x).alias("json")))

    rows = lines.filter(~is_blank(F.col("line"))).withColumn("__v", json_object(F.col("line")))
    rows = rows.withColumn("__f", F.struct(value(F.col("__v"), ts_key).alias("t"), value(F.col("__v"), level_key).alias("l"), value(F.col("__v"), msg_key).alias("m")))
    text, kind = F.col("__f.t.text"), F.col("__f.t.kind")
    ts = F.when(kind.rlike(number) | (kind == "STRING"), parse_json_timestamp(text, kind.rlike(number), tz))
    text, kind = F.col("__f.l.text"), F.col("__f.l.kind")
    level = F.when(kind == "STRING", normalize_level(text)).when(kind == "BIGINT", level_from_severity(text.try_cast("long")))
    own = F.coalesce(F.when(F.col("__f.m.kind") == "STRING", F.col("__f.m.text")).when(F.col("__f.m.kind") != "VOID", F.col("__f.m.json")), F.lit(""))
    message = F.when(F.col("__v").isNull(), F.col("line")).when(own != "", own).otherwise(js_trim(F.col("line")))
    return entries(rows, ts, level, message)


def parse_w3c(lines: DataFrame, fields: list[str], tz: str = "UTC") -> DataFrame:
    """W3C extended logs: cells by the names of the header; what is left over goes to the last cell."""
    line, n = F.col("line"), len(fields)
    at = {name: i for i, name in enumerate(fields)}
    rows = lines.filter(~is_blank(line)).withColumn("__p", F.split("line", " ", -1))
    parts = F.col("__p")
    rest = F.concat(F.slice(parts, 1, n - 1), F.array(F.array_join(F.slice(parts, n, F.size(parts)), " ")))
    rows = rows.withColumn("__p", F.when(F.size(parts) > n, rest).otherwise(parts))
    fits = ~line.startswith("#") & (F.size("__p") >= n - 1)

    def cell(name: str) -> Column:
        return F.get("__p", F.lit(at[name])) if name in at else F.lit(None).cast("string")

    ts = parse_timestamp(F.concat(cell("date"), F.lit(" "), cell("time")), tz)
    skipped = [at[k] for k in ("date", "time") if k in at]
    others = F.array_join(F.filter("__p", lambda _, i: ~i.isin(*skipped) if skipped else F.lit(True)), " ")
    request = F.concat_ws(" ", F.nullif(cell("c-ip"), F.lit("")), F.concat(cell("cs-method"), F.lit(" "), cell("cs-uri-stem")), F.nullif(cell("sc-status"), F.lit("")))
    message = F.when(cell("cs-method").isNotNull() & cell("cs-uri-stem").isNotNull(), request).otherwise(others)
    return entries(rows, F.when(fits, ts), F.when(fits, level_from_status(cell("sc-status"))), F.when(fits, message).otherwise(line))


_S = f"[^{SPACE}]+"
#: Fixed value: the common and combined formats; groups are date, method, path, protocol and status.
ACCESS = f'^{_S} {_S} {_S} \\[([^\\]]+)\\] "([A-Z]+) ({_S})(?: ([^"]*))?" (\\d{{3}}) (?:\\d+|-)'


def parse_access_log(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """Access logs in common or combined format."""
    line = F.col("line")
    head = F.regexp_extract(line, ACCESS + "(?: \"[^\"]*\" \"[^\"]*\")?", 0)
    cells = F.split(F.regexp_replace(head, ACCESS + ".*", _CUT.join(("", "$1", "$2", "$3", "$4", "$5"))), _CUT, -1)
    rows = lines.filter(~is_blank(line)).withColumn("__c", F.when(head != "", cells))
    date, method, path, protocol, status = (F.get("__c", F.lit(i)) for i in range(1, 6))
    message = F.concat(method, F.lit(" "), path, F.when(F.coalesce(protocol, F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), protocol)), F.lit(" "), status)
    return entries(rows, parse_timestamp(date, tz), level_from_status(status), F.coalesce(message, line))


def parse_dsv(lines: DataFrame, delimiter: str, ts_col: int | None = None, level_col: int | None = None, tz: str = "UTC") -> DataFrame:
    """Delimited lines without quoting; the message is made of the other cells."""
    line = F.col("line")
    rows = lines.filter(~is_blank(line)).withColumn("__c", F.split("line", re.escape(delimiter), -1))
    ts = parse_timestamp(F.get("__c", F.lit(ts_col)), tz) if ts_col is not None else F.lit(None).cast("long")
    level = normalize_level(F.get("__c", F.lit(level_col))) if level_col is not None else F.lit(None).cast("string")
    skipped = [i for i in (ts_col, level_col) if i is not None]
    message = F.array_join(F.filter("__c", lambda _, i: ~i.isin(*skipped) if skipped else F.lit(True)), " | ")
    return entries(rows, ts, level, message)


_EVENT = r"<(?:log4j:event|LogRecord)"

#: Fixed value: characters after which an event that doesn't close is given up.
IDLE = 200_000


def parse_log4j_xml(lines: DataFrame, tz: str = "UTC", idle: int = IDLE) -> DataFrame:
    """Events of Log4j 1 and 2 over any number of lines; line_no is the line on which an event ends.

    Text ahead of an event is dropped; what is left at the end of a file becomes an event if it holds the beginning of one, else a raw
    entry.  If more than ``idle`` characters are held, of text without an event or of one that doesn't end, they become a raw entry, and
    the next line begins anew: see :mod:`logloom.operators.log4j`.
    """
    if "seq" in lines.columns:
        lines = lines.drop("seq")  # events are numbered, not lines
    rows = cut_events(lines.select("file", "line_no", "line"), idle)
    rest = js_trim(F.col("line"))
    rows = rows.withColumn("line", F.when(F.col("complete"), F.col("line")).when(F.col("given_up"), F.regexp_replace("line", f"[{SPACE}]+\\z", "")).otherwise(rest)).filter("complete OR given_up OR line <> ''")
    line = F.col("line")
    begun = F.when(F.col("given_up"), "").otherwise(F.regexp_extract(line, _EVENT + r"\b[^>]*", 0))
    rows = rows.withColumn("__tag", F.when(F.col("complete"), F.regexp_extract(line, _EVENT + "[^>]*>", 0)).when(begun != "", F.concat(begun, F.lit(">"))))
    first = F.col("__tag").startswith("<log4j")

    def attribute(name: str) -> Column:
        return F.nullif(F.regexp_extract("__tag", rf'(?:^|[^\w.-]){name}="([^"]*)"', 1), F.lit(""))

    number = lambda c: F.round(c.try_cast("double")).cast("long")
    ts = F.when(first, F.coalesce(number(attribute("timestamp")), F.when(attribute("timestamp").isNull(), parse_timestamp(attribute("Date"), tz))))
    ts = ts.otherwise(F.coalesce(number(attribute("timeMillis")), parse_timestamp(F.coalesce(attribute("instant"), attribute("time")), tz)))
    text = F.when(first, F.regexp_extract(line, r"(?s)<log4j:message[^>]*>(.*?)(?:</log4j:message>|\z)", 1)).otherwise(F.regexp_extract(line, r"(?s)<Message[^>]*>(.*?)(?:</Message>|\z)", 1))
    known = F.col("__tag").isNotNull()
    message = F.when(known, xml_unescape(collapse_space(text))).otherwise(line)
    raw = F.when(F.col("complete") | ~known, line).otherwise(F.concat("__tag", line, F.when(first, "</log4j:event>").otherwise("</LogRecord>")))
    rows = rows.select("file", "line_no", raw.alias("line"), F.when(known, ts).alias("__ts"), F.when(known, normalize_level(attribute("level"))).alias("__l"), message.alias("__m"))
    return entries(rows, F.col("__ts"), F.col("__l"), F.col("__m"))
