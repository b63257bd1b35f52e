"""Thousands of rules, archives by their members."""

import random
import zipfile

from pyspark.sql import functions as F

from logloom.operators import filters, matching, rules
from logloom.sources import lines as sources


def some_rules(n):
    r = random.Random(n)
    words = ["ERROR", "disk", "é", "", "user=1", "a.b", "%", "\\", "ÀB", "0", "zz"]
    return [(r.randrange(3), f"r{i:04}", r.choice(words) + (str(i % 97) if i % 3 else ""), r.choice([[], [], ["ERROR"], ["WARN", "INFO"]]), r.choice(["", "", "APP", "x.log"]), "#112233") for i in range(n)]


def test_many_rules_match_as_few_do(spark, monkeypatch):
    """One automaton finds what trying every rule finds: empty texts, repeated ones, either case, nulls, ties."""
    r = random.Random(5)
    parts = ["error", "Disk", "É", "user=17", "a.b", "%", "\\3", "àb55", "0", None]
    rows = [(f"{r.choice(['app', 'x'])}.log" if i % 9 else None, i, r.choice(["ERROR", "INFO", None]), r.choice(parts), " ".join(str(r.choice(parts)) for _ in range(3))) for i in range(150)]
    entries = spark.createDataFrame(rows, "file string, line_no long, level string, message string, raw string").repartition(3)
    df = spark.createDataFrame(some_rules(400), "priority int, id string, text string, levels array<string>, file string, color string")
    ids = lambda d: sorted((x.line_no, [h.id for h in x["__hits"]]) for x in matching.with_matches(entries, d).collect())
    many, first, counts = ids(df), rules.classify(entries, df).collect(), {x.rule_id: (x.matched, x.won) for x in rules.hit_counts(entries, df).collect()}
    monkeypatch.setattr(matching, "MANY", 1000)
    assert many == ids(df) and any(len(h) > 5 for _, h in many)
    assert sorted(map(str, first)) == sorted(map(str, rules.classify(entries, df).collect()))
    assert counts == {x.rule_id: (x.matched, x.won) for x in rules.hit_counts(entries, df).collect()} and len(counts) == 400
    saved = df.select(F.col("id").alias("name"), "text", "levels", F.lit(1).alias("saved_at"))
    few = {x.name: x.hits for x in filters.saved_filter_hits(entries, saved).collect()}
    monkeypatch.setattr(matching, "MANY", 3)
    assert few == {x.name: x.hits for x in filters.saved_filter_hits(entries, saved).collect()} and len(few) == 400
    monkeypatch.setattr(matching, "CHARACTERS", 3)  # too many for an automaton
    assert many == ids(df)


def test_members_are_read_one_by_one(spark, tmp_path, monkeypatch):
    """As whole archives give them: encodings, carriage returns, lines over pieces, folders, too many members, broken ones."""
    body = {"a.log": "one\r\n\ntwo é\nlast".encode(), "w.log": "﻿wide\nline\n".encode("utf-16"), "sub/c.txt": b"caf\xe9\n" * 3, "empty.log": b"", "long.log": ("x" * 70 + "\n").encode() * 40_000}
    with zipfile.ZipFile(tmp_path / "good.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("sub/", "")
        for name, data in body.items():
            z.writestr(name, data)
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(4):
            z.writestr(f"m{i}.log", f"member {i}")
    whole = sources.zip_members(spark.read.format("binaryFile").load(str(tmp_path)), most=5)
    got = sources.read_zip_logs(spark, str(tmp_path), most=5)
    plain = lambda df: sorted((r.path, r.file or "", r.line_no, r.line or "", r.error is None) for r in df.collect())
    assert plain(got) == plain(whole) and got.filter("file = 'long.log'").count() == 40_000
    assert {r.line for r in got.filter("file = 'sub/c.txt'").collect()} == {"café"}
    assert [(r.path.rsplit("/", 1)[1], r.file) for r in sources.read_zip_logs(spark, str(tmp_path), most=3).filter("error LIKE 'beyond%'").orderBy("path", "file").collect()] == [("good.zip", "empty.log"), ("good.zip", "long.log"), ("many.zip", "m3.log")]


def test_lines_come_whole_however_bytes_are_cut():
    for text, code in (("a\r\nbé\n\n\U0001f600\nend", "utf-8"), ("wide\nlines é\n", "utf-16-le"), ("café\nx", "cp1252")):
        data = text.encode(code)
        for size in (1, 2, 3, 5, 100):
            splitter = sources.Splitter(data, True)
            if code == "utf-16-le":
                splitter = sources.Splitter(b"\xff\xfe" + data, True)
                data_ = b"\xff\xfe" + data
            else:
                data_ = data
            first = max(size, 2)
            cut = [data_[:first], *[data_[i : i + size] for i in range(first, len(data_), size)]]
            got = [x for i, c in enumerate(cut) for x in splitter.feed(c, i == len(cut) - 1)]
            assert got == text.split("\n")


def test_encoded_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    texts = {"a.log": "one\r\n\ntwo é\nlast".encode(), "u.log": b"\xff\xfe" + "wide\nline é\n".encode("utf-16-le"), "w.log": b"caf\xe9\n" * 3, "e.log": b"", "l.log": ("é" * 50 + "\n").encode() * 30_000}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    whole = spark.read.format("binaryFile").load(str(tmp_path))
    for encoding in ("auto", "windows-1252"):
        want = sorted(map(tuple, sources.decode_logs(whole, encoding).collect()))
        assert sorted(map(tuple, sources.read_encoded_logs(spark, str(tmp_path), encoding).collect())) == want and len(want) > 30_000


def test_scratch_folders_are_cleared(spark):
    import os

    from logloom import session

    session.clear(spark)
    path = session.scratch(spark)
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path) and session.clear(spark) == 1 and not os.path.exists(path) and session.clear(spark) == 0


def test_files_without_content(spark):
    """Null and empty content has no lines; as an archive it is a row that says what is wrong."""
    files = spark.createDataFrame([("a", None), ("b", b""), ("c", b"\xef\xbb\xbf"), ("d", b"x\n\ny")], "path string, content binary")
    assert [(r.path, r.line_no, r.line) for r in sources.decode_logs(files).collect()] == [("d", 1, "x"), ("d", 3, "y")]
    assert [(r.encoding, r.files, r.lines) for r in sources.encoding_census(files).collect()] == [("utf-8", 1, 2)]
    assert sorted((r.path, r.line, bool(r.error)) for r in sources.zip_members(files).collect()) == [(p, None, True) for p in "abcd"]


def test_lines_of_many_small_files_leave_together():
    """A batch of lines for many files, not one for each; a large file's lines leave in several."""
    import pyarrow as pa

    given = pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in range(500)] + ["large"], "content": [b"a\r\n\x80", None] * 250 + [b"x\n" * 120_000]})
    out = list(sources._decoded("windows-1252")(iter([given])))
    assert len(out) <= 4 and max(b.num_rows for b in out) <= 2 * sources.LINES
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows[:3] == [("f0", "windows-1252", 0, 1, "a"), ("f0", "windows-1252", 0, 2, "€"), ("f1", "windows-1252", 0, 1, "")]
    assert [r[3] for r in rows if r[0] == "large"] == list(range(1, 120_002))
