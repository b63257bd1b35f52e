"""Mixing sources to target weights by the cube method (balanced sampling).

Each source has a target number of words.  Its documents are all taken ``floor(target / size of the source)`` times, and
once more with the remaining fraction as inclusion probability.  Which ones is decided by the flight phase of the cube
method: the vector of probabilities moves through the null space of the balancing constraints until its entries are 0 or
1, so that both the number of documents and the number of words of the sample stay what the probabilities promise.

Only a few numbers of each document take part.  A source's *heavy* documents, of more than a ``HEAVY``-th of its words (so there are less than
``HEAVY`` of them), come first, in one task a source: they fly in strata of like size, the largest first, and what
rounding a stratum's last two leaves over or short is made up for by the probabilities of all that follow.  Then
all others, whose probabilities make up for the heavy ones in the same way, are dealt by hash into blocks of about
``block`` documents, so that a task holds one block's numbers and a hot source is many blocks.  A flight leaves at most two documents
undecided.  Those fly again, level by level, until one block a source is left; there the landing phase rounds the last two and the ``HELD``
smallest documents that waited for it, so that the words taken come as near as they can to what was promised.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Units that wait for the landing, which tries all roundings of them and two more; parts of a source's words above which a unit is
#: heavy; blocks that meet in one of the next level.
HELD, HEAVY, FAN = 12, 4096, 256
UNIT = "unit_id long, h long, source string, size long, n long, source_size long, target double, base int, phi double, blocks long, shard long"


def water_fill(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Shares of ``total`` by weight; none is above ``cap`` times its size, the excess goes to the others by weight."""
    share, open_, rest = {}, {k for k in sizes if weights[k] > 0}, total
    share.update(dict.fromkeys(sizes, 0.0))
    while open_:
        weight = sum(weights[k] for k in sorted(open_, key=repr))
        above = {k for k in open_ if rest * weights[k] / weight > cap * sizes[k]}
        if not above:
            share.update({k: rest * weights[k] / weight for k in open_})
            break
        share.update({k: float(cap * sizes[k]) for k in above})
        rest -= sum(cap * sizes[k] for k in sorted(above, key=repr))
        open_ -= above
    return share


class Flight:
    """The cube method's flight phase over a stream of units; holds three at most."""

    def __init__(self, seed: int):
        self.rng, self.active = random.Random(seed), []

    def add(self, phi: float, size: float, tag) -> list:
        """Take in one unit; returns those that are decided by now as (tag, phi)."""
        if phi <= 0 or phi >= 1:
            return [(tag, phi)]
        self.active.append([phi, size, tag])
        return self._move() if len(self.active) == 3 else []

    @staticmethod
    def _balanced(units: list) -> tuple:
        """A direction that keeps the sum and the size-weighted sum of three probabilities."""
        (_, a, _), (_, b, _), (_, c, _) = units
        return (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)

    def _move(self) -> list:
        u = self._balanced(self.active)
        up = min(((1 - x[0]) / d if d > 0 else -x[0] / d) for x, d in zip(self.active, u, strict=True) if d)
        down = min((x[0] / d if d > 0 else (x[0] - 1) / d) for x, d in zip(self.active, u, strict=True) if d)
        step = up if self.rng.random() * (up + down) < down else -down
        out, rest = [], []
        for x, d in zip(self.active, u, strict=True):
            x[0] += step * d
            if x[0] < 1e-9 or x[0] > 1 - 1e-9:
                out.append((x[2], 0.0 if x[0] < 0.5 else 1.0))
            else:
                rest.append(x)
        self.active = rest
        return out

    def left(self) -> list:
        out = [(tag, phi) for phi, _, tag in self.active]
        self.active = []
        return out


def land(units: list, promised: float, room: float = 0.0, want: float | None = None) -> list:
    """Of all roundings of a few units (tag, phi, size) the best one, as (tag, 0 or 1).

    What is left of the promised words has to fit the ``room`` words of the units that follow; of the roundings that miss this least, the
    words taken come nearest to ``want``, then the number taken does to what the probabilities say.
    """
    if not units:
        return []
    phi, size = np.array([x[1] for x in units]), np.array([float(x[2]) for x in units])
    choice = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    words = choice @ size
    missed = np.round(np.maximum(0, words - promised) + np.maximum(0, promised - words - room), 6)
    best = np.lexsort((np.abs(choice.sum(1) - phi.sum()), np.round(np.abs(words - (promised if want is None else want)), 6), missed))[0]
    return [(tag, float(x)) for (tag, _, _), x in zip(units, choice[best], strict=True)]


def _weigh(row: tuple) -> int:
    return row[3] * row[4]


def _block(rows: list[tuple], flight: Flight, last: bool, waits: bool) -> list:
    """One flight over the rows of a block, the ``HELD`` smallest left out of it where they wait."""
    held = [(row, row[8], _weigh(row)) for row in rows[-HELD:] if 0 < row[8] < 1] if waits else []
    out = []
    for row in rows[: len(rows) - HELD] + [r for r in rows[-HELD:] if not 0 < r[8] < 1] if waits else rows:
        out += flight.add(row[8], float(_weigh(row)), row)
    rest = [(tag, phi, _weigh(tag)) for tag, phi in flight.left()]
    waiting = rest + held
    return out + (land(waiting, sum(phi * size for _, phi, size in waiting)) if last else [(tag, phi) for tag, phi, _ in waiting])


def _descend(rows: list[tuple], flight: Flight, last: bool, light: int) -> list:
    """A source's heavy rows, the largest first: strata of like size fly one after the other, and after each the probabilities
    of all that follow, ``light`` words of light rows among them, are set to what is still promised."""
    rows = [r for r in rows if 0 < r[8] < 1]
    promised = sum(r[8] * _weigh(r) for r in rows) + (rows[0][8] * light if rows else 0)
    left, at, out = sum(map(_weigh, rows)) + light, 0, []
    keep = len(rows) - (0 if light else HELD)  # with no light rows behind them, the smallest wait
    while at < keep:
        end = at + 1
        while end < keep and _weigh(rows[end]).bit_length() == _weigh(rows[at]).bit_length():
            end += 1
        phi = min(1.0, max(0.0, promised / left))
        decided = [x for row in rows[at:end] for x in flight.add(phi, float(_weigh(row)), row)]
        rest = [(tag, p, _weigh(tag)) for tag, p in flight.left()]
        taken = sum(x * _weigh(tag) for tag, x in decided)
        words = sum(map(_weigh, rows[at:end]))
        decided += land(rest, promised - taken, left - words, phi * words - taken)
        promised -= sum(x * _weigh(tag) for tag, x in decided)
        left -= words
        out += decided
        at = end
    held = rows[max(0, keep) :] if not light else []
    if held:
        out += land([(r, min(1.0, max(0.0, promised / left)), _weigh(r)) for r in held], promised)
    return out


def _fly(seed: int, level: int, one):
    """Units come by source, block and falling size; ``one`` decides a group of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema, block = None, None, []

        def close():
            if block:
                out = one(block, Flight(zlib.crc32(repr((seed, level, now)).encode())), now[2] == 1)
                for at in range(0, len(out), 10_000):
                    yield _batch(out[at : at + 10_000], schema)

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (row[2], row[10], row[9])
                if key != now:
                    yield from close()
                    now, block = key, []
                block.append(row)
        yield from close()

    def _batch(decided: list, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*[(*row[:8], phi, *row[9:]) for row, phi in decided], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return work


def _hash(df: DataFrame, id_col: str, source_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))


def shares(df: DataFrame, weights: tuple[float, ...] | dict, total: float, cap: float, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = 8192, seed: int = 42) -> DataFrame:
    """How often the mix takes each document: unit_id, h, source, size, n, source_size, target, copies.

    ``weights``: of the sources by name, or in turn in code point order (null last).  ``total``: words of the mix as a
    multiple of all words; ``cap``: most of a source's words as a multiple of its size.  Sizes are words; null and empty
    texts have none and, like sources without words or weight, are never taken.  Rows that repeat id, source and text are
    one unit of ``n`` rows, taken or left together.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    units = materialise(
        df.select(
            F.col(id_col).cast("long").alias("unit_id"),
            _hash(df, id_col, source_col, text_col).alias("h"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        )
        .groupBy("unit_id", "h", "source")
        .agg(F.first("size").alias("size"), F.count("*").alias("n"))
    )
    found = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("units")).collect()  # a row for each source
    order = sorted((r["source"] for r in found), key=lambda s: (s is None, s or ""))
    weight = weights if isinstance(weights, dict) else {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = {r["source"]: r["words"] for r in found}
    target = water_fill(size, {s: float(weight.get(s, 0)) for s in order}, total * sum(size.values()), cap)
    rows = []
    for r in found:
        s = r["source"]
        ratio = min(cap, target[s] / size[s]) if size[s] else 0.0
        base = int(ratio + 1e-12)
        rows.append((s, size[s], target[s], base, max(0.0, ratio - base), max(1, -(-r["units"] // block))))
    known = spark.createDataFrame(rows, "s string, source_size long, target double, base int, phi double, blocks long")
    known = F.broadcast(known) if len(rows) <= 10_000 else known
    flying = units.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    flying = flying.withColumn("phi", F.when(F.col("size") == 0, 0.0).otherwise(F.col("phi"))).withColumn("shard", F.pmod("h", "blocks"))
    named = [c.split()[0] for c in UNIT.split(", ")]
    done = flying.filter("phi <= 0 OR phi >= 1").select(*named)
    flying = flying.filter("phi > 0 AND phi < 1")
    heavy = F.col("size") * F.col("n") * HEAVY > F.col("source_size")
    n = shuffle_partitions(spark)
    rest = flying.groupBy("source").agg(F.sum(F.when(heavy, 0).otherwise(F.col("size") * F.col("n"))).alias("light")).select(F.col("source").alias("l"), "light")
    # one task holds a source's heavy units, less than HEAVY; the light words beside them travel in the column of the shard
    own = flying.filter(heavy).join(rest, F.col("source").eqNullSafe(F.col("l"))).withColumn("shard", F.col("light")).withColumn("blocks", F.lit(1).cast("long"))
    dealt = own.select(*named).repartition(n, "source").sortWithinPartitions("source", F.desc(F.col("size") * F.col("n")), "h", "unit_id")
    heavies = materialise(dealt.mapInArrow(_fly(seed, -1, lambda rows, flight, last: _descend(rows, flight, last, rows[0][10])), UNIT))
    done = done.unionByName(heavies)
    taken = heavies.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("phi") * F.col("size") * F.col("n")).alias("taken"), F.sum(F.col("size") * F.col("n")).alias("words"))
    flying = flying.filter(~heavy).join(taken, F.col("source").eqNullSafe(F.col("s")), "left")
    words, gone = F.coalesce("words", F.lit(0)), F.coalesce("taken", F.lit(0.0))
    still = F.col("phi") * F.col("source_size") - gone
    flying = flying.withColumn("phi", F.greatest(F.lit(0.0), F.least(F.lit(1.0), still / (F.col("source_size") - words)))).select(*named)
    blocks, level = max((r[5] for r in rows), default=1), 0
    while True:
        # a source's smallest wait in its first block alone
        step = lambda own, flight, last: _block(own, flight, last, own[0][10] == 0)
        dealt = flying.repartition(n, "source", "shard").sortWithinPartitions("source", "shard", F.desc(F.col("size") * F.col("n")), "h", "unit_id")
        flown = materialise(dealt.mapInArrow(_fly(seed, level, step), UNIT))
        done = done.unionByName(flown.filter("phi = 0 OR phi = 1"))
        if blocks == 1:
            break
        blocks, level = -(-blocks // FAN), level + 1
        flying = flown.filter("phi > 0 AND phi < 1").withColumn("shard", F.floor(F.col("shard") / FAN)).withColumn("blocks", F.ceil(F.col("blocks") / FAN))
    return done.select("unit_id", "h", "source", "size", "n", "source_size", "target", (F.col("base") * F.when(F.col("size") > 0, 1).otherwise(0) + F.col("phi").cast("int")).alias("copies"))


def mix(df: DataFrame, weights: tuple[float, ...] | dict = (3, 1, 2), total: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = 8192, seed: int = 42) -> DataFrame:
    """The mixed corpus: rows of ``df``, repeated or left out as :func:`shares` decides.  All columns are kept."""
    taken = shares(df, weights, total, cap, id_col, source_col, text_col, block, seed).filter("copies > 0").select(F.col("unit_id").alias("__unit"), F.col("h").alias("__h"), F.col("copies").alias("__copies"))
    names = [F.col(f"d.`{c}`") for c in df.columns]
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("d"), _hash(df, id_col, source_col, text_col).alias("__k"))
    both = keyed.join(taken, (F.col("__k") == F.col("__h")) & F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("__unit")))
    return both.select("d", F.explode(F.sequence(F.lit(1), "__copies"))).select(*names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shares(table(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2.0)
    return got.select(F.col("unit_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("row")).drop("row")
