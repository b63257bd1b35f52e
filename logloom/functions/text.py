"""String functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as browsers see it: Spark's trim() knows the blank alone, and Java's \s only ASCII.
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Any character of a line.
ANY = r"[^\n\r\u2028\u2029]"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for each row, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: The characters of ``SPACE`` one by one.
_SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{SPACE}]")


def xml_unescape(c: Column) -> Column:
    """The five predefined entities, the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def collapse_space(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def truncate_message(c: Column, most: int = 2000) -> Column:
    """At most ``most`` code points, and an ellipsis where something was cut off."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def csv_escape(c: Column) -> Column:
    """RFC 4180: quoted only if needed; null is empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *[csv_escape(c) for c in columns])


def normalize_cell(c: Column, kind: T.DataType, preview: bool = True) -> Column:
    """A cell as text or number: dates as ISO text, nested values as JSON; a preview shows blobs by size and long integers as text."""
    if isinstance(kind, T.BinaryType):
        size = F.octet_length(c)
        return F.concat(F.lit("<binary "), size.cast("string"), F.when(size == 1, " byte>").otherwise(" bytes>")) if preview else F.base64(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd'T00:00:00.000Z'")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(kind, T.LongType) and preview:
        return c.cast("string")
    if isinstance(kind, T.DecimalType):
        return c.cast("string") if preview else c.cast("double")
    return c
