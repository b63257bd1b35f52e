"""Secret scans with a trigram inverted index.

From each rule's parsed pattern a Boolean trigram query is derived: every text that matches holds all trigrams of one of
the pattern's mandatory literals (lower-cased, as the index is).  The index has one posting (trigram, text key) for each
indexed trigram that a distinct text holds, made where the text is read; intersecting the posting lists of an alternative
gives the candidates, and only those are verified with the regex.  A rule without mandatory literals (runs of hex
digits) scans every text.

The text key is the SHA-256 of the text: candidates and verified spans are found once for each distinct text, a hot
group of copies costs one key and one verification.  Only texts that hold the rarest-looking trigram of some alternative are
looked at again, and one of each candidate text is shuffled; all others stay where they were read.  Everything is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table


def _either(word: str) -> str:
    """The word with its letters in either case, spelt out, so that no engine's Unicode folding plays a part."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: What patterns are made of: a class, an escaped character, a group's begin, its end, an alternative, how often, a character.
_TOKEN = re.compile(r"(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<code>\\x[0-9A-Fa-f]{2}|\\.)|(?P<open>\((?:\?:)?)|(?P<close>\))|(?P<bar>\|)|(?P<times>[?*+]|\{\d+(?:,\d*)?\})|(?P<char>.)", re.DOTALL)


def _times(t: str) -> tuple[int, int]:
    if t in ("?", "*", "+"):
        return int(t == "+"), 1 if t == "?" else 1 << 30
    low, _, high = t[1:-1].partition(",")
    return int(low), int(high or 1 << 30) if "," in t else int(low)


def _character(code: str) -> str | None:
    """The character that an escape stands for; None for classes such as \\d and marks such as \\b."""
    return chr(int(code[2:], 16)) if code[1] == "x" and len(code) == 4 else None if code[1].isalnum() else code[1]


def _members(chars: str, most: int) -> set[str] | None:
    """The lower-cased characters of a class that lists them one by one."""
    codes = re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|.", chars[1:-1])
    if codes[:1] == ["^"] or "-" in codes[1:-1]:
        return None
    found = {_character(c) if len(c) > 1 else c for c in codes}
    return None if None in found or len(found) > most else {c.lower() for c in found}


class _Parts:
    """A pattern as branches of parts (texts the part stands for if they are few, or None; parts inside a group)."""

    def __init__(self, pattern: str, most: int = 16):
        self.tokens, self.at, self.most = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(pattern)], 0, most

    def branches(self) -> list[list[tuple]]:
        out: list[list[tuple]] = [[]]
        while self.at < len(self.tokens):
            kind, t = self.tokens[self.at]
            self.at += 1
            if kind == "close":
                break
            if kind == "bar":
                out.append([])
            elif kind == "times":
                low, high = _times(t)
                texts, inner = out[-1].pop()
                few = texts is not None and high <= 2
                each = [_product([texts] * n, self.most) for n in range(low, high + 1)] if few else [None]
                # what stands before and behind a repeated group isn't next to all of it
                out[-1].append((None if None in each else set().union(*each), inner if low == high == 1 else None))
            elif kind == "open":
                inner = self.branches()
                each = [_product([x for x, _ in b], self.most) for b in inner]
                out[-1].append((None if None in each else set().union(*each), inner[0] if len(inner) == 1 else None))
            elif kind == "set":
                out[-1].append((_members(t, self.most), None))
            else:
                c = _character(t) if kind == "code" else None if t in ".^$" else t
                out[-1].append((None if c is None else {c.lower()}, None))
        return out


def _product(parts: list[set[str] | None], most: int) -> set[str] | None:
    out = {""}
    for p in parts:
        if p is None or len(out) * len(p) > most:
            return None
        out = {a + b for a in out for b in p}
    return out


def mandatory(pattern: str) -> set[str]:
    """Texts of which every match of the pattern holds one (lower-cased); empty if there are none of three characters."""

    def flat(parts):
        for texts, inner in parts:
            if texts is None and inner is not None:
                yield from flat(inner)
            else:
                yield texts

    def best(parts) -> set[str]:
        runs, now = [], {""}
        for got in flat(parts):
            longer = None if got is None else _product([now, got], 64)
            if longer is None:
                runs.append(now)
                now = got or {""}
            else:
                now = longer
        return max([*runs, now], key=lambda r: (min(map(len, r)), -len(r)))

    # a match is one of a branch: each has to have texts of its own
    found = [best(parts) for parts in _Parts(pattern).branches()]
    return set().union(*found) if all(min(map(len, x)) >= 3 for x in found) else set()


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def clauses(self) -> list[frozenset[str]]:
        """The Boolean trigram query in disjunctive form: sets of trigrams of which one must be there as a whole."""
        sets = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in mandatory(self.pattern)}
        return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


_KEYWORD = f"({_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')})"
# The base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", _KEYWORD + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    Rule("hex", r"([0-9a-f]{32,})", 1, 32),
)
EXTRA_RULES = (
    Rule("pem", r"(-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----)", 1, 1),
    Rule("forge", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 1),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 1),
)

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as (start, rank, kind, end): code points, end exclusive.

    Splitting at the pattern and extracting it see the same matches; running sums of both lengths are the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["between"])
        end = start + F.length(x["whole"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    matches = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("between"), whole.alias("whole"), part.alias("part"))
    found = F.aggregate(matches, state, step, lambda s: s["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPAN))


def trigram_index(texts: DataFrame, grams: list[str], text_col: str = "text", key_col: str = "key") -> DataFrame:
    """The inverted index: distinct postings (gram, key) of the given trigrams over lower-cased texts."""
    low = F.lower(F.col(text_col))
    held = F.filter(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return texts.select(F.explode(held).alias("gram"), F.col(key_col)).distinct()


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """Intersect postings: key and the kinds of which it holds all trigrams of a clause."""
    terms = [(r.kind, f"{r.kind}{i}", g, len(c)) for r in rules for i, c in enumerate(r.clauses()) for g in sorted(c)]
    query = F.broadcast(index.sparkSession.createDataFrame(terms, "kind string, clause string, gram string, need int"))  # a row for each term of the rules
    met = index.join(query, "gram").groupBy("key", "kind", "clause").agg(F.count("*").alias("held"), F.first("need").alias("need")).filter("held = need")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Secrets of whole texts: id_col and ``spans``, an array of (start, rank, kind, end) ordered by start, then rule.

    A row for each row of ``docs``, repeated ones too; null texts are empty and have no spans; null ids are kept.
    Columns other than the id and the text are ignored.  Spans of one rule never overlap; those of different rules may.
    """
    # the longest clause member stands for a clause: a text without it can't hold the clause
    indexed = [r for r in rules if r.clauses()]
    scanned = [r for r in rules if not r.clauses()]
    rank = {r.kind: i for i, r in enumerate(rules)}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    gate = sorted({min(c, key=lambda g: (sum(x in "aeinorst" for x in g), g)) for r in indexed for c in r.clauses()})
    low = F.lower(F.col("text"))
    hopeful = reduce(lambda a, b: a | b, [F.contains(low, F.lit(g)) for g in gate]) if gate else F.lit(False)
    some = rows.filter(hopeful)
    always = F.concat(F.array().cast(SPAN), *[spans(F.col("text"), r, rank[r.kind]) for r in scanned])
    thin = rows.select("id", "text_sha", always.alias("found"))
    if not indexed:
        return thin.select(F.col("id").alias(id_col), F.array_sort("found").alias("spans"))
    grams = sorted({g for r in indexed for c in r.clauses() for g in c})
    keys = materialise(candidates(trigram_index(some.select(F.col("text_sha").alias("key"), "text"), grams), indexed))
    # one text of each key, taken where it is read; the cut keeps the regexes behind the aggregation
    few = materialise(some.join(keys, F.col("text_sha") == F.col("key")).groupBy("key").agg(F.first("text").alias("text"), F.first("kinds").alias("kinds")))
    verified = few.select("key", F.concat(*[F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r, rank[r.kind])).otherwise(F.array().cast(SPAN)) for r in indexed]).alias("more")).filter(F.size("more") > 0)
    out = thin.join(verified, F.col("text_sha") == F.col("key"), "left")
    return out.select(F.col("id").alias(id_col), F.array_sort(F.concat("found", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return got.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_spans(rule: Rule, rank: int) -> str:
    """Positions in DuckDB: texts are cut at each match in turn by a running list of pieces."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, start, start + length(whole) AS stop, part FROM (
  SELECT doc_id, whole[i] AS whole, part[i] AS part,
    list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda p: length(p))), 0) AS start
  FROM (SELECT doc_id, whole, part, pieces, unnest(range(1, len(whole) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(x, '{pattern}', 0) AS whole, regexp_extract_all(x, '{pattern}', {rule.group}) AS part, regexp_split_to_array(x, '{pattern}') AS pieces FROM t)))
WHERE length(part) >= {rule.least}"""


_ALL = BASE_RULES + EXTRA_RULES
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(_ALL))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
  string_agg(concat_ws(':', kind, CAST(start AS BIGINT), CAST(stop AS BIGINT)), ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}) AS base,
  string_agg(concat_ws(':', kind, CAST(start AS BIGINT), CAST(stop AS BIGINT)), ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""
