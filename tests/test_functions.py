"""Scalar functions against literal facts."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import levels, text, timestamps
from logloom.operators.parsers import compile_pattern


def value(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(column(F.col("c"))).collect()]


def test_levels(spark):
    assert value(spark, levels.normalize_level, " warning ", "\tSEVERE", "fine", "crit", "Notice", "dbug", "x", "", None) == ["WARN", "ERROR", "TRACE", "FATAL", "INFO", "DEBUG", None, None, None]
    assert value(spark, levels.level_from_status, "500", "404", "200", "4040", "40", None) == ["ERROR", "WARN", None, None, None, None]


def test_timestamps(spark):
    day = 86_400_000
    base = 1_767_225_600_000  # 2026-01-01
    got = value(
        spark, timestamps.parse_timestamp, "2026-01-01T00:00:00Z", "2026-01-01 00:00:00,1239", "2026-01-01T05:30:00.5+05:30", "2026-13-45 00:00:00", "2026-001", "2026-366", "2024-366T01:00:00Z", "01/Jan/2026:00:00:01 -0100", "01/Foo/2026:00:00:01", "1/2/26 08:00:00", "  2026-01-02T00:00:00Z\n", "2026-01-01", None
    )
    assert got == [base, base + 123, base + 500, base + (31 + 28 + 31 + 30 + 31 + 30 + 31 + 31 + 30 + 31 + 30 + 31 + 44) * day, base, None, base - 366 * day + 3_600_000, base + 3_601_000, None, None, base + day, None, None]
    assert value(spark, timestamps.parse_epoch, "1788220801", "1788220801123", "1788220801.5", "12345678", "x") == [1788220801000, 1788220801123, 1788220801500, None, None]
    same = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-366",), ("2024-366",), ("31/Jan/2026:00:00:00",), ("31/Foo/2026:00:00:00",), ("x",), (None,)], "c string")
    assert all(a == b for a, b in same.select(timestamps.is_timestamp(F.col("c")), timestamps.parse_timestamp(F.col("c")).isNotNull()).collect())


def test_naive_zone_with_gap(spark):
    assert value(spark, lambda c: timestamps.to_iso(timestamps.parse_timestamp(c, "Europe/Berlin")), "2026-07-01 12:00:00", "2026-07-01T12:00:00Z") == ["2026-07-01T10:00:00.000Z", "2026-07-01T12:00:00.000Z"]


def test_text(spark):
    assert value(spark, lambda c: text.xml_unescape(text.collapse_space(c)), " a\n\t b &lt;&amp;lt;&gt; ") == ["a b <&lt;>"]
    assert value(spark, lambda c: text.truncate_message(c, 3), "abc", "abcd") == ["abc", "abc…"]
    assert value(spark, lambda c: text.csv_line(c, F.lit(1)), 'a"b', "a,b", "a\nb", "plain", None) == ['"a""b",1', '"a,b",1', '"a\nb",1', "plain,1", ",1"]
    assert value(spark, text.js_trim, " ﻿ x  ") == ["x"]


def test_patterns_are_checked():
    with pytest.raises(ValueError):
        compile_pattern("%x %m")
    with pytest.raises(ValueError):
        compile_pattern("nothing")
    assert compile_pattern("%l (%m)")[1] == ["%l", "%m"]
