"""Which of many rules (text, levels, file) an entry matches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Rules up to which each is tried on each entry; characters of texts that one automaton may hold (some 100 bytes each in every worker).
MANY, CHARACTERS = 64, 2_000_000


def _fits(r: Column, e: Column) -> Column:
    level = (F.size(r["levels"]) == 0) | F.coalesce(F.array_contains(r["levels"], e["level"]), F.lit(False))
    return level & ((r["file"] == "") | F.contains(e["file"], r["file"]))


def _found(texts: list[str]):
    """For each pair of texts the numbers of the rules whose texts one of them holds, in order: one pass, however many rules."""

    @F.pandas_udf("array<int>")
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import ahocorasick

        numbers: dict[str, list[int]] = {}
        for i, text in enumerate(texts):
            numbers.setdefault(text, []).append(i)
        always, automaton = numbers.pop("", []), ahocorasick.Automaton()
        for text, own in numbers.items():
            automaton.add_word(text, own)
        automaton.make_automaton()

        def of(*parts: str) -> list[int]:
            found = set(always)
            for part in parts if numbers else ():
                for _, own in automaton.iter(part):
                    found.update(own)
            return sorted(found)

        for message, raw in batches:
            yield pd.Series([of(m, r) if m != r else of(m) for m, r in zip(message, raw, strict=True)])

    return search


def with_matches(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries with ``__hits``, the rules (priority, id, text, levels, file, color) that each matches: by priority, then id.

    The rules, which people write, stand beside each entry as a constant (a scalar subquery), so that entries are read in one pass.  A few
    are tried one by one.  The texts of many go into one automaton, which is sent to the tasks if they are at most
    ``CHARACTERS`` together (longer lists are tried one by one); level and file are asked of the rules that it finds alone.
    """
    rule = F.struct("priority", "id", F.lower("text").alias("text"), "levels", F.lower("file").alias("file"), "color")
    ordered = rules.agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    beside = entries.withColumn("__rules", ordered.scalar())
    low = F.struct(F.lower(F.coalesce("message", F.lit(""))).alias("message"), F.lower(F.coalesce("raw", F.lit(""))).alias("raw"), F.lower(F.coalesce("file", F.lit(""))).alias("file"), F.col("level").alias("level"))
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n <= MANY or size > CHARACTERS:
        text = lambda r, e: (r["text"] == "") | F.contains(e["message"], r["text"]) | F.contains(e["raw"], r["text"])
        return beside.withColumn("__hits", let(low, lambda e: F.filter("__rules", lambda r: _fits(r, e) & text(r, e)))).drop("__rules")
    texts = [t for (t,) in ordered.select(F.explode("rules.text")).collect()]
    found = beside.withColumn("__low", low).withColumn("__numbers", _found(texts)("__low.message", "__low.raw"))
    hits = F.filter(F.transform("__numbers", lambda i: F.get("__rules", i)), lambda r: _fits(r, F.col("__low")))
    return found.withColumn("__hits", hits).drop("__rules", "__low", "__numbers")
