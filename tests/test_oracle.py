"""Queries against their SQL twins at the smallest scale.

A quick selection by default; FLOWSENTRY_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "rule_table",
    "per_class_report",
    "clean_flows",
    "split_coarse_time",
    "parse_alerts",
    "sig_match_band",
    "sig_alert_hits",
    "live_verdict",
    "window_mining",
    "evidence_fusion",
    "upload_dedup",
    "upload_routing",
    "alert_records",
    "operating_points",
    "cascade",
    "seq_windows",
    "scale_stats",
    "stream_busy_sources",
    "file_verdict",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("FLOWSENTRY_ALL") else QUICK)
def test_equals_sql(spark, con, name):
    verdict = check.compare(spark, con, FOLDER, name)
    assert verdict.startswith("ok"), verdict


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["class", "support", "metric", "rate", "fires"] and df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
