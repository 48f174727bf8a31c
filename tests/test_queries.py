"""Registered queries against their SQL, on the smallest of the driver's tables (skipped where they are not there)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
#: A query of each kind; the rest share their parts.
NAMES = ["job_run_ids", "candidate_validation", "candidate_dlq", "light_curve_status", "model_inputs", "coarse_mode_selection", "classified", "result_validation", "save_outcomes", "current_classification", "consumer_lag", "latency_quantile", "error_ratio_alert", "light_curve_files", "stream_candidates", "stream_results", "stream_alerts", "stream_commands", "stream_replay", "result_dlq", "run_build_check", "executed_only", "bundle_misses", "funnel_from_candidates", "request_labels", "sample_rates", "sample_quantiles", "stream_current", "stream_crash", "stream_worker", "stream_resumed", "stream_new_series", "compatible_coarse_stored", "key_share", "result_rungs", "constraint_names", "output_errors", "string_rule"]


def canonical(df):
    import pandas as pd

    df = df[sorted(df.columns)].astype(object)
    text = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    path = f"{DIR}/events.parquet"
    con.execute("SET timezone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = entry.queries()[name](spark, DIR).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and canonical(got) == canonical(want)


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_candidate_stream_writes_the_rows_of_the_sql(spark):
    import duckdb

    from lumispark.plans import derive, stream_twins
    from lumispark.sources.messages import header

    con = duckdb.connect()
    path = f"{DIR}/events.parquet"
    con.execute("SET timezone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    commands, dead = stream_twins.candidate_rows(spark, DIR)
    got = sorted(tuple(r) for r in commands.select("job_id", "object_id", "light_curve_revision").collect())
    want = con.execute(f"WITH {derive.SQL_COMMANDS} SELECT job_id, object_id, light_curve_revision FROM cmd").fetchall()
    assert got and got == sorted(want)
    got = sorted(tuple(r) for r in dead.select(header("original-partition").cast("int"), header("original-offset").cast("long"), F.col("key").cast("string")).collect())
    want = con.execute(f'WITH {derive.SQL_COMMANDS} SELECT "partition", "offset", key FROM judged WHERE error_code IS NOT NULL').fetchall()
    assert got and got == sorted(want)
