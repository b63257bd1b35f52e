"""Files that grow, are rotated and removed while they are followed; deliveries by count and time, each once; heads of files."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from logloom.operators import detect
from logloom.sources import heads
from logloom.streaming import deliver, follow, tail


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a state starts a worker of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def until(condition, seconds=90):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end
        time.sleep(0.3)


# ---- what was added


def test_offsets_of_polls():
    """Growth, no growth, rotation, removal, a file that begins empty."""
    seen = tail.polled({}, {"a": 9, "e": 0})
    assert tail.grown({}, seen) == [("a", 0, 0, 9)]
    same = tail.polled(seen, {"a": 9, "e": 0})
    assert tail.grown(seen, same) == []
    more = tail.polled(same, {"a": 18, "e": 6})
    assert tail.grown(same, more) == [("a", 0, 9, 18), ("e", 0, 0, 6)]
    turned = tail.polled(more, {"a": 3, "e": 6})
    assert turned["a"] == (1, 3) and tail.grown(more, turned) == [("a", 1, 0, 3)]
    gone = tail.polled(turned, {"e": 6})
    assert gone == turned and tail.grown(turned, gone) == []
    assert tail.grown({}, {"b": (0, 10)}, 4) == [("b", 0, 0, 4), ("b", 0, 4, 8), ("b", 0, 8, 10)]


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_ranges_give_every_line_once(tmp_path, size, monkeypatch):
    """However a file is cut into ranges, each finished line comes once and chunks join on; the last line waits for its end."""
    monkeypatch.setattr(tail, "BACK", 3)
    text = b"one\n\ntwo \xc3\xa9\r\nthree is long\n\n\nfour\nunfinished"
    (tmp_path / "f").write_bytes(text)
    with open(tmp_path / "f", "rb") as f:
        got = [c for _, _, b, e in tail.grown({}, {"f": (0, len(text))}, size) for c in tail.chunks(f, b, e, 3)]
    assert b"".join(c for _, _, c in got) == text[: text.rindex(b"\n") + 1]
    assert [b for b, _, _ in got] == [0, *[e for _, e, _ in got]][: len(got)]


def entry(i, text="m"):
    return f"2026-01-01 00:00:{i:02} INFO: {text} {i}\n"


def test_a_file_that_grows_is_rotated_and_removed(spark, tmp_path):
    """Lines are numbered through all polls of an epoch, over restarts of the query; ranges of a few bytes make several tasks of one poll."""
    folder, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()

    def poll():
        follow_ = tail.follow_growing(spark, str(folder), out, check, range_bytes=40)
        follow_.awaitTermination()
        return sorted((r.file, r.epoch, r.line_no, r.seq, r.message) for r in spark.read.parquet(out).collect())

    (folder / "a.log").write_text(entry(1) + "\n" + entry(2) + entry(3)[:10])
    (folder / "skip.bin").write_text(entry(1))
    first = [("a.log", 0, 1, 0, "m 1"), ("a.log", 0, 3, 1, "m 2")]
    assert poll() == first
    with open(folder / "a.log", "a") as f:  # the unfinished line comes to its end
        f.write(entry(3)[10:] + entry(4))
    (folder / "b.log").write_text("")
    second = [*first, ("a.log", 0, 4, 2, "m 3"), ("a.log", 0, 5, 3, "m 4")]
    assert poll() == second
    (folder / "a.log").write_text(entry(9, "new"))  # truncated in place
    (folder / "b.log").write_text(entry(5))
    third = sorted([*second, ("a.log", 1, 1, 0, "new 9"), ("b.log", 0, 1, 0, "m 5")])
    assert poll() == third
    os.remove(folder / "b.log")  # rows stay
    with open(folder / "a.log", "a") as f:
        f.write(entry(10, "new"))
    assert poll() == sorted([*third, ("a.log", 1, 2, 1, "new 10")])


def test_following_growth_goes_on(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.log").write_text(entry(1))
    query = tail.follow_growing(spark, str(folder), out, str(tmp_path / "check"), every="300 milliseconds")

    def messages():
        try:
            return sorted((r.line_no, r.message) for r in spark.read.parquet(out).collect())
        except Exception:
            return []

    try:
        until(lambda: messages() == [(1, "m 1")])
        with open(folder / "a.log", "a") as f:
            f.write(entry(2))
        until(lambda: messages() == [(1, "m 1"), (2, "m 2")])
    finally:
        query.stop()


def test_segments_that_come_out_of_order(spark, tmp_path):
    """A segment waits for the one before it, over batches and restarts."""
    folder, out, check = tmp_path / "seg", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()

    def poll():
        follow.follow_segments(spark, str(folder), out, check).awaitTermination()
        return sorted((r.file, r.line_no, r.line) for r in spark.read.parquet(out).collect())

    (folder / "a.log.1").write_text("third\nfourth\n")
    (folder / "b.log.0").write_text("only\n")
    assert poll() == [("b.log", 1, "only")]
    (folder / "a.log.0").write_text("first\n\nsecond\r\n")
    (folder / "a.log.3").write_text("seventh\n")
    assert poll() == [("a.log", 1, "first"), ("a.log", 3, "second"), ("a.log", 4, "third"), ("a.log", 5, "fourth"), ("b.log", 1, "only")]
    (folder / "a.log.2").write_text("\n")
    assert poll()[-2:] == [("a.log", 7, "seventh"), ("b.log", 1, "only")]


# ---- deliveries


def matches(spark, folder):
    rows = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))
    return rows.select(F.lit("a.log").alias("file"), F.lit(1).alias("line_no"), F.lit(None).cast("string").alias("ts_iso"), F.lit("WARN").alias("level"), F.col("value").alias("message"))


def sent_to(path):
    """A receiver that keeps what it gets in a file, as it runs in the driver's Python worker."""

    def send(target, key, payload):
        with open(path, "a") as f:
            f.write(json.dumps([target, key, [e["message"] for e in json.loads(payload)["entries"]]]) + "\n")

    return send


def received(path):
    return [json.loads(x) for x in open(path)] if os.path.exists(path) else []


def test_fifty_that_wait_go_at_once_three_after_a_second(spark, tmp_path):
    folder, got = tmp_path / "in", str(tmp_path / "got")
    folder.mkdir()
    (folder / "x1").write_text("\n".join(f"m{i}" for i in range(120)))
    out = deliver.payloads(matches(spark, folder), F.lit("http://h"))
    query = deliver.deliver(out, sent_to(got), str(tmp_path / "ledger"), str(tmp_path / "check"), every="200 milliseconds")
    try:
        until(lambda: len(received(got)) == 3)
        assert [(k, len(m)) for _, k, m in received(got)] == [("http://h#0.0", 50), ("http://h#0.1", 50), ("http://h#0.2", 20)]
        assert [x for _, _, m in received(got) for x in m] == [f"m{i}" for i in range(120)]
        (folder / "x2").write_text("late 1\nlate 2\nlate 3")
        until(lambda: len(received(got)) == 4)
        assert received(got)[3] == ["http://h", "http://h#1.0", ["late 1", "late 2", "late 3"]]
    finally:
        query.stop()


def test_a_sink_that_fails_sends_each_payload_once(spark, tmp_path):
    """The second batch fails after its first payload; the query that begins again sends the other one alone."""
    folder, got, broken = tmp_path / "in", str(tmp_path / "got"), str(tmp_path / "broken")
    folder.mkdir()
    (folder / "x1").write_text("\n".join(f"a{i}" for i in range(60)))
    keep = sent_to(got)

    def send(target, key, payload):
        if key.endswith("#1.1") and not os.path.exists(broken):
            open(broken, "w").close()
            raise OSError("the receiver is down")
        keep(target, key, payload)

    def run():
        out = deliver.payloads(matches(spark, folder), F.lit("t"), most=1000)
        return deliver.deliver(out, send, str(tmp_path / "ledger"), str(tmp_path / "check"), every="200 milliseconds")

    query = run()
    until(lambda: len(received(got)) == 2)
    (folder / "x2").write_text("\n".join(f"b{i}" for i in range(70)))
    with pytest.raises(Exception, match="receiver is down"):
        query.awaitTermination(60)
    query = run()
    until(lambda: len(received(got)) >= 4)
    deliver.finish(query)
    assert [(k, len(m)) for _, k, m in received(got)] == [("t#0.0", 50), ("t#0.1", 10), ("t#1.0", 50), ("t#1.1", 20)]


def test_the_oldest_of_too_many_are_dropped(spark, tmp_path):
    folder, got = tmp_path / "in", str(tmp_path / "got")
    folder.mkdir()
    (folder / "x1").write_text("\n".join(f"m{i}" for i in range(500)))
    out = deliver.payloads(matches(spark, folder), F.lit("t"), size=10, most=25)
    deliver.finish(deliver.deliver(out, sent_to(got), str(tmp_path / "ledger"), str(tmp_path / "check"), every="200 milliseconds"))
    assert [x for _, _, m in received(got) for x in m] == [f"m{i}" for i in range(475, 500)]


# ---- heads


def test_detection_reads_heads_alone(spark, tmp_path):
    """Bytes read don't grow with a file; formats are those that its first lines have."""
    (tmp_path / "a.log").write_text("".join(entry(i % 60) for i in range(40_000)))
    (tmp_path / "b.json").write_text('{"ts":1,"level":"info","msg":"x"}\n' * 5)
    (tmp_path / "c.txt").write_bytes(codecs_utf16("2026-01-01 00:00:01 WARN: wide\n" * 3))
    (tmp_path / "d.log").write_text("")
    got = heads.read_heads(spark, str(tmp_path), most=4096).select("file", "size", "n_read", "encoding", "line_no", "line").collect()
    read = {r.file: (r.n_read, r.encoding) for r in got}
    assert read["a.log"] == (4096, "utf-8") and read["c.txt"][1] == "utf-16le" and max(n for n, _ in read.values()) == 4096
    assert all(r.line == entry((r.line_no - 1) % 60).rstrip("\n") for r in got if r.file == "a.log")
    specs = {r.file: (r.kind, r.template) for r in detect.detect_files(spark, str(tmp_path)).collect()}
    assert specs == {"a.log": ("pattern", "%d %l: %m"), "b.json": ("json", None), "c.txt": ("pattern", "%d %l: %m")}  # an empty file has no lines


def codecs_utf16(text):
    return b"\xff\xfe" + text.encode("utf-16-le")
