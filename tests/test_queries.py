"""Registered queries against their SQL on the smallest tables; the entry works without the corpus operators."""

import os
import subprocess
import sys

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"
SOME = ["report_level_counts", "parse_pattern_dlm", "parse_json_lines", "parse_access_log", "parse_log4j_xml", "parse_syslog", "rule_hit_counts", "pins_merge", "alert_batches", "poll_classify", "src_zip_members", "stream_segments", "latest_epoch", "export_json_rows", "detect_dsv", "decode_chosen", "rule_reorder", "alert_sink", "stream_rotation", "stream_progress", "stream_dir_ingest", "src_dir_accept", "alert_config_sanitize", "result_capped", "table_preview", "parse_mixed_corpus", "src_one_file_splits", "parse_syslog_blocks", "parse_log4j_between", "detect_heads", "stream_growth", "alert_deliveries", "pins_locate", "parse_json_repeated_keys"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def plain(values):
    return str([None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in values])


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("events", "orders", "documents", "customer", "part", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got, want = entry.queries()[name](spark, DIR), con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(plain(r) for r in got.select(*columns).collect()) == sorted(plain(r) for r in want.fetchall())


def test_entry_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "logloom"):
        os.symlink(f"{root}/{name}", tmp_path / name)
    code = "import sys; sys.modules['logloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})
