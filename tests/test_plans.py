"""How often plans read their source tables."""

import pytest

from kerbline.plans.catalog import CATALOG
from kerbline.plans.registry import Tables


@pytest.mark.parametrize("name", ["two_half_crossfit", "bootstrap_median", "fraction_split", "audit_splits", "cumulative_assignment", "grouped_split", "random_pairs", "out_of_range", "recover_bowl"])
def test_planned_scans(spark, name):
    """At most six scans of the tables; what several steps read is written once."""
    df = CATALOG[name][0](Tables(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan parquet" in line and "/root/testdata" in line for line in plan.split("\n")) <= 6
