"""Exact dedup: tree-merge of sorted digest runs.

Every partition of the corpus becomes one *run*: its distinct digests, sorted, each with the identifier that stays and
the number of rows.  Runs are cut by digest range, so that no task ever sees a whole run of the corpus, and exchanged in
rounds: in each round ``fan_in`` neighbouring runs of a range meet in one task, which merges them in one streaming
pass, keeps the better identifier of equal digests and adds up the counts.  After ``log(partitions)`` rounds one run a
range is left.  Digests are SHA-256 of the normalised text, verified together with its length in bytes.

A hot group of copies costs one entry for each run, however many rows it has; the marks go back to the rows by a
left join in which only one side can be hot, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_UPPER, materialise, shuffle_partitions, table

#: Rows of a digest range: a task merges a range's share of some runs, so ranges grow with the rows.
RANGE = 1_000_000
RUN = "rng int, node int, digest binary, n_bytes long, best long, part int, pos long, n long"


def _digests(normalise: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [(x or b"").lower() if normalise else x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(pos, pos + n, dtype=np.int64)),
                ],
                ["id", "digest", "n_bytes", "part", "pos"],
            )
            pos += n

    return work


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 4)


def _leaf_runs(ranges: int, largest: bool):
    """Of each partition one run, sorted by digest; of equal digests the identifier that stays comes first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, got = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        key, size = _words(t["digest"]), t["n_bytes"].to_numpy()
        known = ~t["id"].is_null().to_numpy()
        ids = t["id"].fill_null(0).to_numpy()
        order = np.lexsort((t["pos"].to_numpy(), t["part"].to_numpy(), ~ids if largest else ids, ~known, size, *key.T[::-1]))
        key, size = key[order], size[order]
        new = np.r_[True, (key[1:] != key[:-1]).any(1) | (size[1:] != size[:-1])]
        first = np.flatnonzero(new)
        take = pa.array(order[first])
        rng = ((key[first, 0].astype(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        yield from pa.Table.from_arrays(
            [pa.array(rng), pa.array(np.full(len(first), node, np.int32)), *(t[c].take(take) for c in ("digest", "n_bytes", "id", "part", "pos")), pa.array(np.diff(np.r_[first, len(order)]))],
            ["rng", "node", "digest", "n_bytes", "best", "part", "pos", "n"],
        ).to_batches(max_chunksize=20_000)

    return work


def _merge(fan_in: int):
    """Merge the runs that met here: rows come by range, node and digest, the better identifier first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the first row of the open group, its key and its count so far

        def close(key, row, n):
            row = row.set_column(row.schema.get_field_index("n"), "n", pa.array([n], pa.int64()))
            return row.set_column(1, "node", pa.array([key[1] // fan_in], pa.int32()))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_pylist() for i in range(4)]
            keys = list(zip(*keys, strict=True))
            counts = batch.column("n").to_numpy()
            new = np.array([True] + [a != b for a, b in zip(keys[1:], keys, strict=False)])
            first = np.flatnonzero(new)
            sums = np.add.reduceat(counts, first)
            if last and last[0] == keys[0]:
                last[2] += int(sums[0])
                first, sums = first[1:], sums[1:]
            if len(first):
                if last:
                    yield close(*last)
                if len(first) > 1:
                    out = batch.take(pa.array(first[:-1]))
                    out = out.set_column(out.schema.get_field_index("n"), "n", pa.array(sums[:-1]))
                    yield out.set_column(1, "node", pa.array(np.array(out.column("node").to_numpy() // fan_in, np.int32)))
                last = [keys[first[-1]], batch.slice(int(first[-1]), 1), int(sums[-1])]
        if last:
            yield close(*last)

    return work


def exact_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "min", normalise: bool = True, fan_in: int = 8) -> DataFrame:
    """Mark exact copies.  One row for each row of ``df``: id, keep_id, group_size, kept, text_sha256, n_bytes.

    ``keep`` ("min" or "max") picks the identifier that stays in each group; ``normalise`` lower-cases A-Z first.
    Null text is the empty text.  A null identifier stays only where a group has no other.  Rows that repeat both text
    and identifier are one group; the first of them in reading order is the one that is kept.  An empty table gives an
    empty result; other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    largest = keep == "max"
    spark = df.sparkSession
    rows = materialise(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_digests(normalise), "id long, digest binary, n_bytes long, part int, pos long")
    )
    ranges = max(shuffle_partitions(spark), -(-rows.count() // RANGE))
    runs = rows.mapInArrow(_leaf_runs(ranges, largest), RUN)
    nodes = rows.rdd.getNumPartitions()
    better = F.col("best").desc_nulls_last() if largest else F.col("best").asc_nulls_last()
    while nodes > 1:
        met = runs.withColumn("run", F.floor(F.col("node") / fan_in).cast("int")).repartition(ranges, "rng", "run")
        met = met.withColumn("node", F.col("run") * fan_in).drop("run")
        runs = met.sortWithinPartitions("rng", "node", "digest", "n_bytes", better, "part", "pos").mapInArrow(_merge(fan_in), RUN)
        nodes = -(-nodes // fan_in)
    groups = runs.filter("n > 1").select(F.col("digest").alias("g_digest"), F.col("n_bytes").alias("g_bytes"), "best", F.col("part").alias("g_part"), F.col("pos").alias("g_pos"), "n")
    out = rows.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("n_bytes") == F.col("g_bytes")), "left")
    alone = F.col("n").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("part") == F.col("g_part")) & (F.col("pos") == F.col("g_pos")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_bytes",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max").drop("n_bytes")


SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""
