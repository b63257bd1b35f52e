"""Parsers, detection and sources on small files."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from logloom.operators import detect, filters, parsers, pins, reports, rules
from logloom.operators.entries import number_lines, running_sum, with_seq
from logloom.sources import lines as sources


def lines(spark, **files):
    rows = [(name.replace("_", "."), i, x) for name, body in files.items() for i, x in enumerate(body.split("\n"), 1) if x]
    return spark.createDataFrame(rows, "file string, line_no long, line string")


APP = "2026-09-01 08:00:01 WARN: config: slow\n\nno form\n2026-09-01 08:01:02 SEVERE: x\n   "
JSON = '{"ts":"2026-09-01T08:00:00Z","level":"warn","msg":"hi"}\n{"ts":1788220801,"level":3,"msg":{"a":1}}\n{"ts":null,"level":99}\n{"a":1} x\n[1]'
W3C = "#Version: 1.0\n#Fields: date time c-ip cs-method cs-uri-stem sc-status cs-agent\n2026-09-01 08:00:00 1.2.3.4 GET /a 404 my agent 1\n2026-09-01 08:00:01 1.2.3.4 GET /b 500 x\n2026-09-01 08:00:02 1.2.3.4 GET /b 200 x\nshort row"
ACCESS = '1.2.3.4 - bob [01/Sep/2026:08:02:34 +0000] "GET /p HTTP/1.1" 404 10 "-" "ua"\n1.2.3.4 - - [01/Sep/2026:08:02:35 +0000] "POST /q" 503 -'
DSV = "timestamp,level,message\n" + "\n".join(f"2026-09-01 08:00:0{i},WARN,m{i}" for i in range(8))
XML = '<?xml version="1.0"?>\n<log4j:event logger="a" timestamp="1788220801000" level="INFO">\n<log4j:message>a\n  b &amp; c</log4j:message>\n</log4j:event><LogRecord level="ERROR" timeMillis="1788220802000"/>\n<log4j:event timestamp="1788220803000" level="FATAL"><log4j:message>open'


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("file", "line_no").collect()]


def test_every_format_is_detected_and_parsed(spark):
    df = lines(spark, app_log=APP, j_json=JSON.rsplit("\n", 2)[0], w_log=W3C.rsplit("\n", 1)[0], a_log=ACCESS, d_csv=DSV, x_xml=XML)
    specs = {r.file: r for r in detect.detect_format(df).collect()}
    assert {k: r.kind for k, r in specs.items()} == {"app.log": "pattern", "j.json": "json", "w.log": "w3c", "a.log": "combined", "d.csv": "dsv", "x.xml": "log4j-xml"}
    assert specs["d.csv"][-3:] == (",", 0, 1) and specs["j.json"].ts_key == "ts"
    got = with_seq(detect.parse_logs(df))
    assert {r.file: r.n for r in reports.entries_per_file(got).collect()} == {"app.log": 4, "j.json": 3, "w.log": 5, "a.log": 2, "d.csv": 9, "x.xml": 3}
    assert rows(got.filter("file = 'app.log'"), "seq", "level", "message") == [(0, "WARN", "config: slow"), (1, None, "no form"), (2, "ERROR", "x"), (3, None, "   ")]


def test_json_lines(spark):
    got = parsers.parse_json_lines(lines(spark, j_json=JSON))
    assert rows(got, "ts_ms", "level", "message") == [(1788249600000, "WARN", "hi"), (1788220801000, "ERROR", '{"a":1}'), (None, None, '{"ts":null,"level":99}'), (None, None, '{"a":1} x'), (None, None, "[1]")]


def test_w3c_and_access(spark):
    got = parsers.parse_w3c(lines(spark, w_log=W3C), "date time c-ip cs-method cs-uri-stem sc-status cs-agent".split())
    assert rows(got, "level", "message")[2:] == [("WARN", "1.2.3.4 GET /a 404"), ("ERROR", "1.2.3.4 GET /b 500"), (None, "1.2.3.4 GET /b 200"), (None, "short row")]
    got = parsers.parse_access_log(lines(spark, a_log=ACCESS + "\nx"))
    assert rows(got, "ts_ms", "level", "message") == [(1788249754000, "WARN", "GET /p HTTP/1.1 404"), (1788249755000, "ERROR", "POST /q 503"), (None, None, "x")]


def test_log4j(spark):
    got = rows(parsers.parse_log4j_xml(lines(spark, x_xml=XML)), "ts_ms", "level", "message", "line_no")
    assert sorted(got, key=str) == sorted([(1788220801000, "INFO", "a b & c", 5), (1788220802000, "ERROR", "", 5), (1788220803000, "FATAL", "open", 6)], key=str)


def test_syslog_years(spark):
    body = "Dec 30 08:00:00 a\nDec 31 23:00:00 b\nJan  1 01:00:00 c\nDec 31 23:30:00 d\nnot a date"
    got = parsers.parse_syslog_lines(lines(spark, s_log=body), 2025)
    assert [t and t[:10] for (t,) in rows(got, "ts_iso")] == ["2025-12-30", "2025-12-31", "2026-01-01", "2025-12-31", None]


def test_log4j_gives_up_on_what_never_closes(spark):
    """More than so many characters without an end are cut into raw entries; shorter events around them stay whole."""
    body = '<log4j:event timestamp="1" level="INFO"><log4j:message>a</log4j:message></log4j:event>\n' + "\n".join(f"noise {i:04}" for i in range(100))
    got = parsers.parse_log4j_xml(lines(spark, x_xml=body, y_xml="<log4j:event level=\"WARN\"/>\nshort"), idle=200)
    out = {f: rows(got.filter(F.col("file") == f), "level", "message", "line_no") for f in ("x.xml", "y.xml")}
    assert out["y.xml"] == [("WARN", "", 1), (None, "short", 2)]
    first, *raw = out["x.xml"]
    assert first == ("INFO", "a", 1) and all(level is None and len(m) <= 220 for level, m, _ in raw) and len(raw) >= 5
    assert "\n".join(m.strip("\n") for _, m, _ in raw).split("\n") == body.split("\n")[1:] and raw[-1][2] == 101


def test_syslog_years_over_blocks(spark):
    """Dates of several years, lines without a date between them, in blocks of a few lines: as one after the other."""
    import datetime

    from logloom.operators.entries import running_last

    stamps = [datetime.datetime(2022, 11, 1, 7) + datetime.timedelta(hours=20 * i) for i in range(1000)]
    body = "\n".join("no date" if i % 5 == 0 and i else f"{t:%b} {t.day:>2} {t:%H:%M:%S} m" for i, t in enumerate(stamps))
    got = parsers.parse_syslog_lines(lines(spark, s_log=body), 2022)
    assert [t and t[:19] for (t,) in rows(got, "ts_iso")] == [None if i % 5 == 0 and i else t.isoformat() for i, t in enumerate(stamps)]
    df = spark.range(100).select(F.lit("f").alias("file"), (F.col("id") + 1).alias("line_no"), F.when(F.col("id") % 23 == 4, F.col("id")).alias("v"))
    out = running_last(df, "v", "p", block=7).orderBy("line_no").collect()
    assert [r.p for r in out] == [max((j for j in range(i) if j % 23 == 4), default=None) for i in range(100)]


def test_running_sum_over_blocks(spark):
    df = spark.range(100).select(F.lit("f").alias("file"), (F.col("id") + 1).alias("line_no"), (F.col("id") % 3).alias("v"))
    got = running_sum(df, "v", "s", block=7).orderBy("line_no").collect()
    assert [r.s for r in got] == [sum(i % 3 for i in range(k)) for k in range(100)]


def test_archives_with_broken_members(spark):
    """A member that can't be inflated, and those beyond the limit, give an error row each; all others are read."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(5):
            z.writestr(f"m{i}.log", f"line of {i}\n" * 50)
    data = bytearray(out.getvalue())
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        at = z.infolist()[1].header_offset + 30 + len("m1.log")
    data[at : at + 6] = b"\xff" * 6
    got = sources.zip_members(spark.createDataFrame([("z", data), ("bad", bytearray(b"PK"))], "path string, content binary"), most=4).collect()
    assert {r.file for r in got if r.error is None} == {"m0.log", "m2.log", "m3.log"} and sum(r.file == "m0.log" for r in got) == 50
    assert sorted((r.path, r.file or "") for r in got if r.error is not None) == [("bad", ""), ("z", "m1.log"), ("z", "m4.log")]


def test_numbers_hold_over_files_and_blocks(spark, tmp_path):
    """Several files in one task, several blocks of a file in another; blank lines, and files that end without a line feed."""
    bodies = {}
    for f in range(7):
        bodies[f"f{f}.log"] = "\n".join("" if (i + f) % 6 == 0 else "  " if (i + f) % 11 == 0 else f"{f} {i}" for i in range(f * 300 + 1))
        (tmp_path / f"f{f}.log").write_text(bodies[f"f{f}.log"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("700", "4000", "100000"):
        for conf, v in (("spark.sql.files.maxPartitionBytes", size), ("spark.sql.files.openCostInBytes", "100")):
            spark.conf.set(conf, v)
        for blank in (True, False):
            got = sorted((r.file, r.line_no, r.seq, r.line) for r in sources.read_log_lines(spark, str(tmp_path), blank=blank).collect())
            want = []
            for f, body in bodies.items():
                kept = [(i, x) for i, x in enumerate(body.split("\n"), 1) if (x if blank else x.strip())]
                want += [(f, i, k, x) for k, (i, x) in enumerate(kept)]
            assert got == sorted(want)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_files_in_blocks_and_encodings(spark, tmp_path):
    os.makedirs(tmp_path / "logs")
    body = "".join(f"line {i}{chr(13) if i % 5 == 0 else ''}\n" + ("\n" if i % 7 == 0 else "") for i in range(5000))
    (tmp_path / "logs/big.log").write_text(body, newline="")
    (tmp_path / "logs/skip.bin").write_text("x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sources.read_log_dir(spark, str(tmp_path / "logs")).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.line_no, r.line) for r in got] == [(i, x.removesuffix("\r")) for i, x in enumerate(body.split("\n"), 1) if x] and {r.file for r in got} == {"big.log"}
    assert [r.seq for r in got] == list(range(len(got)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/", "")
        z.writestr("d/a.log", "é\r\nb\n\nc")
    files = [("a", "é€\nx".encode("cp1252")), ("b", b"\xff\xfe" + "é\nx".encode("utf-16-le")), ("c", "plain text\nx".encode("utf-16-be")), ("d", b"\xef\xbb\xbf" + "é\n".encode()), ("e", b"ascii"), ("f", b"")]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files], "path string, content binary")
    assert {(r.path, r.encoding, r.line_no, r.line) for r in sources.decode_logs(df).collect()} == {("a", "windows-1252", 1, "é€"), ("a", "windows-1252", 2, "x"), ("b", "utf-16le", 1, "é"), ("b", "utf-16le", 2, "x"), ("c", "utf-16be", 1, "plain text"), ("c", "utf-16be", 2, "x"), ("d", "utf-8", 1, "é"), ("e", "utf-8", 1, "ascii")}
    marked = spark.createDataFrame([("m", bytearray(b"\xef\xbb\xbf" + "é".encode("cp1252"))), ("n", bytearray(b"\xff\xfea\0"))], "path string, content binary")
    assert {(r.path, r.line, r.bom_len) for r in sources.decode_logs(marked, "windows-1252").collect()} == {("m", "ï»¿é", 0), ("n", "ÿþa\0", 0)}
    assert {(r.path, r.line, r.bom_len) for r in sources.decode_logs(marked, "utf-16le").filter("path = 'n'").collect()} == {("n", "a", 2)}
    with pytest.raises(ValueError):
        sources.decode_logs(marked, "latin-9")
    df = spark.createDataFrame([("z", bytearray(out.getvalue())), ("bad", bytearray(b"PK"))], "path string, content binary")
    got = sources.zip_members(df).collect()
    assert [(r.file, r.line_no, r.line) for r in got if r.path == "z"] == [("d/a.log", 1, "é"), ("d/a.log", 2, "b"), ("d/a.log", 4, "c")] and [r.error is not None for r in got if r.path == "bad"] == [True]


RULES = "priority int, id string, text string, levels array<string>, file string, color string"


def test_rules_of_any_number_behave_alike(spark):
    """Few rules and hundreds; entries without a file or a line number; equal priorities go by id."""
    e = with_seq(parsers.parse_pattern(number_lines(lines(spark, app_log=APP))))
    e = e.unionByName(e.withColumns({"file": F.lit(None).cast("string"), "line_no": F.lit(None).cast("long")}))
    some = [(0, "a", "CONFIG", [], "", "#111111"), (1, "b", "", ["ERROR"], "app", "#222222"), (2, "c", "%", [], "", "#333333"), (3, "e", "", [], "", "#555555"), (3, "d", "", [], "", "#444444")]
    more = [(1, f"z{i}", "nowhere", [], "", "#666666") for i in range(300)]
    for own in (some, some[::-1] + more):
        table = spark.createDataFrame(own, RULES)
        got = rules.classify(e, table).orderBy(F.col("file").desc_nulls_last(), "seq").collect()
        assert [r.rule_id for r in got] == ["a", "d", "b", "d", "a", "d", "d", "d"] and got[1].color == "#444444"
        counts = {r.rule_id: (r.matched, r.won) for r in rules.hit_counts(e, table).collect()}
        assert {k: v for k, v in counts.items() if k[0] != "z"} == {"a": (2, 2), "b": (1, 1), "c": (0, 0), "d": (8, 5), "e": (8, 0)} and len(counts) == len(own)
    assert {r.rule_id for r in rules.classify(e, spark.createDataFrame([], RULES)).collect()} == {None}
    moved = rules.reorder(spark.createDataFrame(some, RULES).filter("id <> 'e'"), "d", 0)
    assert {r.rule_id for r in rules.classify(e, moved).collect()} == {"d"} and sorted(r.priority for r in moved.collect()) == [0, 1, 2, 3]


def test_pins_and_filters(spark):
    e = with_seq(parsers.parse_pattern(lines(spark, app_log=APP)))
    p = spark.createDataFrame([(0, "p0", "app.log", 1, "n"), (1, "p1", "app.log", 1, "m"), (2, "p2", "gone.log", 1, "o")], "pos int, id string, file string, line_no long, note string")
    assert rows(pins.annotate(e, p), "pin_id", "note") == [("p0", "n"), (None, None), (None, None), (None, None)]
    assert [r.id for r in pins.orphaned(p, e).collect()] == ["p2"] and [r.position for r in pins.locate(e.filter("level IS NOT NULL"), p).collect()] == [0]
    assert filters.apply_filters(e).count() == 4 and filters.apply_filters(e, "CONFIG", ["WARN"]).count() == 1 and filters.apply_filters(e, "%").count() == 0
    assert reports.ad_hoc(e, "SELECT count(*) AS n FROM entries").first().n == 4
    with pytest.raises(ValueError):
        reports.ad_hoc(e, "SELEC nothing")
    assert not [t for t in spark.catalog.listTables() if t.name == "entries"]
    spark.range(3).createOrReplaceTempView("entries")
    assert reports.ad_hoc(e, "SELECT count(*) AS n FROM entries").first().n == 4 and spark.table("entries").count() == 3
    spark.range(1).createOrReplaceTempView("ENTRIES2")
    assert [r.name for r in reports.table_list(spark).collect() if r.name.lower().startswith("entries")] == ["entries", "ENTRIES2"] or [r.name.lower() for r in reports.table_list(spark).collect() if r.name.lower().startswith("entries")] == ["entries", "entries2"]
    for name in ("entries", "ENTRIES2"):
        spark.catalog.dropTempView(name)


def test_no_line_is_lost_when_splits_change(spark, tmp_path):
    """Counts and rows come from one read: other splits, fewer cores and a file that is cut meanwhile change nothing."""
    text = "".join(f"line {i}\n" + "\n" * (i % 7 == 0) for i in range(60_000))
    (tmp_path / "big.log").write_text(text)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n, None) for n in names]
    want = [(n, i, x) for i, (n, x) in enumerate((n, x) for n, x in enumerate(text.split("\n"), 1) if x)]
    try:
        for before, after in ((("40k", "4", "1k"), ("29k", "3", "1k")), (("1m", "4", "1k"), ("1m", "3", "1k"))):
            for n, v in zip(names, before):
                spark.conf.set(n, v)
            got = sources.read_log_lines(spark, str(tmp_path / "big.log"))
            for n, v in zip(names, after):
                spark.conf.set(n, v)
            assert sorted(map(tuple, got.select("line_no", "seq", "line").collect())) == want
        got = sources.read_log_lines(spark, str(tmp_path / "big.log"))
        (tmp_path / "big.log").write_text("rotated\n")
        assert got.count() == len(want)
    finally:
        for n, v in zip(names, old):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def held_line_by_line(text, idle):
    """The event parser as it reads: a buffer, line by line."""
    buffer, out = "", []
    for number, line in enumerate(text.split("\n"), 1):
        if not line:
            continue
        buffer += line + "\n"
        if len(buffer) > idle:
            out.append((number, buffer, "raw"))
            buffer = ""
            continue
        while True:
            begins = [(i, b, e) for b, e in (("<log4j:event", "</log4j:event>"), ("<LogRecord", "</LogRecord>")) if (i := buffer.find(b)) >= 0]
            if not begins:
                break
            i, _, end = min(begins)
            buffer = buffer[i:]
            tag = buffer.find(">")
            if tag < 0:
                break
            stop = tag + 1
            if not buffer[:tag].endswith("/"):
                if buffer.find(end, tag) < 0:
                    break
                stop = buffer.find(end, tag) + len(end)
            out.append((number, buffer[:stop], "event"))
            buffer = buffer[stop:]
    return out, buffer


@pytest.mark.parametrize("size,rounds", [(4096, 8), (3, 8), (1, 2)])
def test_events_and_other_text_around_the_limit(spark, size, rounds):
    """Blocks of any size, in rounds or in order, give what reading line by line gives; text ahead of an event doesn't count once it begins."""
    from logloom.operators.log4j import cut_events

    event = '<log4j:event timestamp="1788220801000" level="ERROR">\n<log4j:message>boom</log4j:message>\n</log4j:event>'
    r = random.Random(size)
    pieces = ["x" * 60, "x" * 40, event, '<LogRecord level="WARN"/>', "<LogRecord>\n<Message>é</Message></LogRecord> tail", event + event, "<log4j:event", 'level="INFO">', "</log4j:event>", "<log4j:eventSet>", "\U0001f600" * 30]
    texts = {f"f{i}": "\n".join(r.choice(pieces) for _ in range(r.randrange(0, 60))) for i in range(12)} | {"probe": "x" * 60 + "\n" + event, "noise": "\n".join(["no event here"] * 200)}
    rows = [(f, n, x) for f, t in texts.items() for n, x in enumerate(t.split("\n"), 1) if x]
    df = spark.createDataFrame(rows, "file string, line_no long, line string").repartition(3)
    got = cut_events(df, 130, size, rounds).collect()
    units = lambda x: len(x.encode("utf-16-le")) // 2
    assert all(units(x) == len(x) for x in texts["noise"])
    for f, t in texts.items():
        if any(ord(c) > 0xFFFF for c in t):
            t = t.replace("\U0001f600", "\ud83d\ude00")  # as it is counted
        want, rest = held_line_by_line(t, 130)
        whole = lambda x: x.encode("utf-16-le", "surrogatepass").decode("utf-16-le")
        found = sorted((x.line_no, x.line, "event" if x.complete else "raw") for x in got if x.file == f and (x.complete or x.given_up))
        assert found == sorted((n, whole(x), k) for n, x, k in want)
        assert [x.line for x in got if x.file == f and not (x.complete or x.given_up)] == ([whole(rest)] if any(x for x in t.split("\n")) else [])
    probe = rows_of(parsers.parse_log4j_xml(df.filter("file = 'probe'"), idle=130))
    assert probe == [("ERROR", "boom", 4)]


def rows_of(df):
    return [(r.level, r.message, r.line_no) for r in df.collect()]


def test_syslog_reads_its_input_once(spark, tmp_path):
    """Parsed dates are written once: what is planned reads no line again."""
    lines(spark, s_log="Jan  1 00:00:00 a\nJan  2 00:00:00 b").write.parquet(str(tmp_path / "lines"))
    got = parsers.parse_syslog_lines(spark.read.parquet(str(tmp_path / "lines")), 2024)
    assert "tmp_path" not in str(got.inputFiles()) and not any("/lines/" in f for f in got.inputFiles())
    assert [r.ts_iso[:10] for r in got.orderBy("line_no").collect()] == ["2024-01-01", "2024-01-02"]


def test_of_repeated_keys_the_last_counts(spark):
    got = parsers.parse_json_lines(lines(spark, j_log='{"ts":1,"level":"info","msg":"a","level":"error","msg":"b"}\n{"msg":"c"} {"msg":"d"}'))
    assert [(r.ts_ms, r.level, r.message) for r in got.orderBy("line_no").collect()] == [(1000, "ERROR", "b"), (None, None, '{"msg":"c"} {"msg":"d"}')]
