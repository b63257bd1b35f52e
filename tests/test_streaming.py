"""Followed folders: queries that go on, rotation, progress, alerts and what was there before; written exports."""

import time

from pyspark.sql import functions as F

from logloom.operators import alerts, export
from logloom.streaming import follow


def until(condition, seconds=60):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end
        time.sleep(0.2)


def read(spark, path):
    try:
        return spark.read.parquet(path).collect()
    except Exception:
        return []


def test_following_goes_on_until_it_is_stopped(spark, tmp_path):
    """A file that comes later is read by the same query; line and sequence numbers count blank lines as they should."""
    folder, out, check, progress = (str(tmp_path / x) for x in ("logs", "out", "check", "progress"))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("2026-01-01 00:00:00 INFO: one\n\nno form")
    (tmp_path / "logs/skip.bin").write_text("2026-01-01 00:00:00 INFO: no log")
    query = follow.follow_dir(spark, folder, out, check, every="200 milliseconds", progress=progress)
    try:
        until(lambda: len(read(spark, out)) == 2)
        (tmp_path / "b.tmp").write_text("2026-01-01 00:00:01 WARN: two\n")
        (tmp_path / "b.tmp").rename(tmp_path / "logs/b.txt")
        until(lambda: len(read(spark, out)) == 3 and max((r.lines for r in read(spark, progress)), default=0) == 4)
        assert query.isActive
    finally:
        query.stop()
    got = sorted((r.file, r.seq, r.line_no, r.level, r.message) for r in read(spark, out))
    assert got == [("a.log", 0, 1, "INFO", "one"), ("a.log", 1, 3, None, "no form"), ("b.txt", 0, 1, "WARN", "two")]
    seen = follow.progress_of(spark, progress, 158).first()
    assert (seen.lines, seen.entries, seen.bytes) == (4, 3, 30 + 1 + 8 + 30) and 0 < seen.fraction <= 1 and seen.batches >= 2


def test_alerts_leave_history_alone(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("old")
    rows = follow.stream_rows(spark, str(folder), 1).select("file", F.col("value").alias("message"), F.col("value").alias("raw"), F.lit("WARN").alias("level"), F.lit(1).alias("line_no"), F.lit(None).cast("string").alias("ts_iso"))
    sent = []
    keep = lambda df, batch: sent.extend(r.payload for r in df.collect())
    follow.alert_sink(rows, keep, str(tmp_path / "check"), "http://h", most=3).awaitTermination()
    assert sent == []
    time.sleep(1.1)
    (folder / "b.log").write_text("new 1\nnew 2\nnew 3\nnew 4")
    follow.alert_sink(rows, keep, str(tmp_path / "check"), "http://h", most=3).awaitTermination()
    assert len(sent) == 1 and [f"new {i}" in sent[0] for i in range(1, 5)] == [False, True, True, True]


def test_epochs_of_polls(spark):
    sizes = {"a": [10, 20, 5, 9, 9, 3], "b": [4, 4, -1, 6]}
    polls = spark.createDataFrame([(f, i, s) for f, own in sizes.items() for i, s in enumerate(own)], "file string, poll_no long, size long")
    got = {(r.file, r.poll_no): r.epoch for r in alerts.epochs(polls).collect()}
    assert [got["a", i] for i in range(6)] == [0, 0, 1, 1, 1, 2] and [got["b", i] for i in range(4)] == [0, 0, 0, 0]


def test_written_exports(spark, tmp_path):
    import csv
    import glob
    import json

    rows = [("t", 1, "INFO", 'say "hi", you', "raw\nline", "a.log", 1), (None, None, None, "", " pad ", None, 2)]
    df = spark.createDataFrame(rows, "ts_iso string, ts_ms long, level string, message string, raw string, file string, line_no long").coalesce(1)
    export.write_csv(df, str(tmp_path / "c"))
    export.write_json(df, str(tmp_path / "j"))
    (part,) = glob.glob(str(tmp_path / "c/part-*"))
    with open(part, newline="") as f:
        assert list(csv.reader(f)) == [export.CSV_COLUMNS, ["t", "1", "INFO", 'say "hi", you', "raw\nline", "a.log", "1"], ["", "", "", "", " pad ", "", "2"]]
    (part,) = glob.glob(str(tmp_path / "j/part-*"))
    with open(part) as f:
        assert [json.loads(x) for x in f] == [{"ts": r[0], "level": r[2], "message": r[3], "raw": r[4], "file": r[5], "lineNo": r[6]} for r in rows]
