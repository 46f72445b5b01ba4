"""Registered queries against their SQL on the smallest tables. All of them with KERBLINE_ALL=1, else a cross-section."""

import os

import pytest

from compare import compare, database
from kerbline.plans.catalog import CATALOG

FOLDER = "/root/testdata/sf0.001"
SOME = ["audit_splits", "near_duplicates", "quota_sample", "source_stem", "zoom_window", "semantic_override", "water_decision", "astm_grade", "min_cost_decision", "asof_drive",
        "best_match", "capture_sessions", "settle_labels", "cohen_kappa", "out_of_range", "percentile_of_score", "two_half_crossfit", "trust_gate", "leave_one_group_out",
        "segment_summary", "bowl_depth", "grid_components", "wheel_drops", "curvature", "grade_2d", "stream_sessions", "read_outlines"]
NAMES = [n for n in CATALOG if CATALOG[n][1]] if os.environ.get("KERBLINE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, _, _, detail = compare(spark, con, FOLDER, name)
    assert status in ("ok", "EMPTY"), detail


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).columns == ["scheme", "split_a", "split_b", "shared", "share_of_b"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
