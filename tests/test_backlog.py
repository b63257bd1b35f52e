"""Backlogs of many files: batches, deliveries and progress don't grow with their number, and nothing is left out."""

from pyspark.sql import functions as F

from logloom.streaming import follow, tail


def many(folder, n, suffix=".log"):
    folder.mkdir()
    for i in range(n):
        (folder / f"f{i:02}{suffix}").write_text("".join(f"2026-01-01 00:00:0{k} FATAL: m{i}.{k}\n" for k in range(4)))
    return str(folder)


def test_alerts_of_a_backlog(spark, tmp_path):
    """The latest matches of each file alert, however many files a batch has."""
    rows = follow.stream_rows(spark, many(tmp_path / "logs", 30), 1).select("file", F.col("value").alias("message"), F.lit("FATAL").alias("level"), F.lit(1).alias("line_no"), F.lit(None).cast("string").alias("ts_iso"))
    sent = []
    keep = lambda df, batch: sent.extend((batch, r.delivery, r.batch, r.payload) for r in df.collect())
    follow.alert_sink(rows, keep, str(tmp_path / "check"), "http://h", history=0, most=3).awaitTermination()
    assert len({b for b, *_ in sent}) <= tail.BATCHES and all(b == d for b, d, *_ in sent) and len({s[:3] for s in sent}) == len(sent)
    text = "".join(s[3] for s in sent)
    assert [text.count(f"m{i}.{k}\"") for i in range(30) for k in range(4)] == [0, 1, 1, 1] * 30


def test_progress_of_a_backlog(spark, tmp_path):
    progress, out = str(tmp_path / "progress"), str(tmp_path / "out")
    follow.follow_dir(spark, many(tmp_path / "logs", 26), out, str(tmp_path / "check"), files_per_batch=2, progress=progress).awaitTermination()
    seen = follow.progress_of(spark, progress).first()
    assert seen.batches <= tail.BATCHES and (seen.lines, seen.entries) == (104, 104)
    got = spark.read.parquet(out)
    assert got.count() == 104 and got.select("file", "seq").distinct().count() == 104


def test_segments_of_a_backlog(spark, tmp_path):
    out = str(tmp_path / "out")
    folder = many(tmp_path / "logs", 30, ".0")
    query = follow.follow_segments(spark, folder, out, str(tmp_path / "check"), 2)
    query.awaitTermination()
    got = {(r.file, r.line_no) for r in spark.read.parquet(out).select("file", "line_no").collect()}
    assert query.lastProgress.batchId < tail.BATCHES and got == {(f"f{i:02}", k) for i in range(30) for k in (1, 2, 3, 4)}


def test_small_ranges_are_read_together():
    """Many small files are some tasks, not one each; large ranges stay apart, and the order is kept."""
    small = [(f"f{i:04}", 0, 0, 50) for i in range(3000)]
    own = tail.together(small, 8)
    assert len(own) <= tail.TASKS + 1 and [r for x in own for r in x] == small
    large = [("a", 0, i * tail.RANGE, (i + 1) * tail.RANGE) for i in range(200)]
    assert tail.together(large, tail.RANGE) == [[r] for r in large] and tail.together([], 8) == []


def test_events_leave_block_by_block():
    """Events of a block go out before the next block is values, so that a task's memory doesn't grow with its blocks."""
    import pyarrow as pa

    from logloom.operators import log4j

    texts = [f'<log4j:event n="{i}"/>' for i in range(5)]
    columns = {"file": ["a"] * 4, "numbers": [[5 * b + i for i in range(5)] for b in range(4)], "texts": [texts] * 4, "held": [""] * 4, "last": [False] * 3 + [True]}
    out = list(log4j._cut(1_000_000)(iter([pa.RecordBatch.from_pydict(columns)])))
    assert max(b.num_rows for b in out) == 6 and sum(b.num_rows for b in out) == 21
    assert [x for b in out for x in b.column("line").to_pylist()][:20] == texts * 4


def test_a_batch_costs_few_tasks(spark, tmp_path):
    """A query has some state partitions, whatever the session's shuffles have, and folders are listed by some tasks."""
    parallelism, shuffle = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.shuffle.partitions"
    before = spark.conf.get(shuffle)
    spark.conf.unset(parallelism)
    spark.conf.set(shuffle, "40")
    try:
        query = follow.follow_segments(spark, many(tmp_path / "logs", 3, ".0"), str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
        assert spark.conf.get(shuffle) == "40"
    finally:
        spark.conf.set(shuffle, before)
    assert [op.numShufflePartitions for op in query.lastProgress.stateOperators] == [tail.PARTITIONS]
    assert int(spark.conf.get(parallelism)) <= 64 and spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_a_large_delivery_is_numbered_by_many_tasks(spark):
    """Payloads of one delivery are the same, whether one task numbers it or many do, and no window sorts it whole."""
    from logloom.operators import alerts

    rows = spark.range(3000).select((F.col("id") % 2).alias("delivery"), F.expr("lpad(cast(id * 7919 % 3000 as string), 5, '0')").alias("arrival"), F.lit("f").alias("file"), F.col("id").alias("line_no"), F.lit(None).cast("string").alias("ts_iso"), F.lit("WARN").alias("level"), F.col("id").cast("string").alias("message"))
    one, many_ = (sorted(alerts.alert_batches(rows, spread=s).collect(), key=lambda r: (r.delivery, r.batch)) for s in (False, True))
    assert one == many_ and len(one) == 60 and [len(r.entries) for r in one] == [50] * 60


def test_one_file_is_written_in_order_by_parts(spark, tmp_path):
    """Parts of sorted lines become one file: no task sorts all of them."""
    from logloom.plans import queries

    queries._joined(spark, spark.range(0, 5000, 1, 7).select((4999 - F.col("id")).alias("k")).orderBy("k").select(F.col("k").cast("string").alias("line")), f"{tmp_path}/one/all.log")
    assert (tmp_path / "one" / "all.log").read_text().split() == [str(i) for i in range(5000)]


def test_log4j_lines_are_numbered_over_events(spark):
    """The window that numbers rendered lines sorts events, not their lines."""
    from logloom.plans import render

    lines = render.log4j(spark, "/root/testdata/sf0.001")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")  # the plan is printed from its end
    seen = lines.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("line_no").alias("d"), F.max("line_no").alias("m"), F.min("line_no").alias("l")).collect()
    assert seen and all(r.n == r.d == r.m and r.l == 1 for r in seen)


def test_files_stand_in_one_folder(spark, tmp_path):
    """Each rendered log is a file of its own name, its lines in order, and no folder is listed for each of them."""
    from logloom.plans import queries

    rows = spark.range(0, 4000, 1, 5).select(F.concat(F.lit("f"), (F.col("id") % 7).cast("string"), F.lit(".log")).alias("file"), (4000 - F.col("id")).alias("line_no"), F.when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("line"))
    folder = queries._files(spark, rows, str(tmp_path / "logs"))
    assert sorted(x.name for x in (tmp_path / "logs").iterdir()) == [f"f{i}.log" for i in range(7)]
    for i in range(7):
        want = "".join(f"{n if n % 9 else ''}\n" for n in range(3999, -1, -1) if n % 7 == i)
        assert (tmp_path / "logs" / f"f{i}.log").read_text() == want
    assert spark.read.text(folder).count() == 4000


def test_a_backlog_is_a_few_batches(spark, tmp_path):
    query = follow.follow_segments(spark, many(tmp_path / "logs", 40, ".0"), str(tmp_path / "out"), str(tmp_path / "check"), 1)
    query.awaitTermination()
    assert query.lastProgress.batchId < 4 and spark.read.parquet(str(tmp_path / "out")).count() == 160


def test_semi_and_anti_joins_compare_plain_columns(spark):
    """Entries are parsed before they are joined, not in the conditions of joins; rows equal the SQL's."""
    import __spark_entry__ as entry
    import duckdb

    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = entry.queries()["sql_semi_anti"](spark, folder)
        assert "regexp" not in got._jdf.queryExecution().executedPlan().toString()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
        want = con.execute(f"SELECT file, line_no FROM ({entry.oracle_sql()['sql_semi_anti']})").fetchall()
        assert want and sorted((r.file, r.line_no) for r in got.collect()) == sorted(want)


def test_heads_are_read_once(spark):
    """Detection reads the heads once, and finds what it finds in all lines."""
    from logloom.operators import detect

    read = spark.sparkContext.accumulator(0)

    def work(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lines = [("a", i, f"2026-01-01 00:00:0{i} INFO: m{i}") for i in range(1, 6)] + [("j", i, f'{{"ts":{i},"msg":"m"}}') for i in range(1, 6)] + [("d", i, f"2026-01-01 00:00:0{i};info;m;{i}") for i in range(1, 6)]
    first = spark.createDataFrame(lines, "file string, line_no long, line string").mapInArrow(work, "file string, line_no long, line string")
    got = sorted(map(str, detect.detect_heads(first).collect()))
    assert read.value == 15 and got == sorted(map(str, detect.detect_format(first).collect()))
    assert [("dsv" in x, "json" in x, "%d %l: %m" in x) for x in sorted(got, key=lambda x: x[10:12])] == [(False, False, True), (True, False, False), (False, True, False)]
