"""Severity levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import js_trim

LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")

# The names of each level, as they stand in logs.
ALIASES = {
    "TRACE": ("TRACE", "FINE", "FINER", "FINEST"),
    "DEBUG": ("VERBOSE", "DEBUG", "DBUG"),
    "INFO": ("INFO", "INFORMATION", "NOTICE"),
    "WARN": ("WARN", "WARNING"),
    "ERROR": ("ERROR", "ERR", "SEVERE"),
    "FATAL": ("CRIT", "CRITICAL", "FATAL"),
}
# RFC 5424 severities.
SEVERITIES = {0: "FATAL", 1: "FATAL", 2: "FATAL", 3: "ERROR", 4: "WARN", 5: "INFO", 6: "INFO", 7: "DEBUG"}


def normalize_level(c: Column) -> Column:
    """The level that a token stands for, in either case and with white space around it; null for others."""
    names = F.create_map(*[F.lit(x) for level, aliases in ALIASES.items() for alias in aliases for x in (alias, level)])
    return F.try_element_at(names, F.upper(js_trim(c)))


def level_from_status(c: Column) -> Column:
    """5xx is ERROR, 4xx WARN; other three-digit codes and everything else have no level."""
    return F.when(c.rlike(r"^[5-9]\d\d\z"), "ERROR").when(c.rlike(r"^4\d\d\z"), "WARN")


def level_from_severity(c: Column) -> Column:
    """The level of a numeric syslog severity."""
    out = F
    for n, level in SEVERITIES.items():
        out = out.when(c == n, level)
    return out
