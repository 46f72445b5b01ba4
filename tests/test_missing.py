"""A missing input never becomes the worst class, and never a harmless one either."""

from pyspark.sql import functions as F

from kerbline.functions import grading as D
from kerbline.operators import annotation, hazard, joins, quality, splits



def cases():
    """(expression, value): a column function needs a session, so they are made inside a test."""
    null, one = F.lit(None).cast("double"), F.lit(1.0)
    abstains = [
        D.depth_band(null), D.band(null), D.score_label(null), D.astm_row(null),
        D.astm_grade(null, F.lit(300.0))["grade"], D.astm_grade(F.lit(30.0), null)["grade"], D.astm_grade(null, null)["rule"], D.astm_grade(F.lit(5.0), null)["rule"],
        *[D.pothole_age(*[null if i == k else one for i in range(6)], one)[part] for k in range(5) for part in ("category", "score")],
        D.response_for(null, F.lit("county"))["category"], D.response_for(null, F.lit("county"))["response"], D.served_depth(null, null, one, one), D.age_factor(null)]
    return [(x, None) for x in abstains] + [
        (D.rule_severity(F.lit(100.0), F.lit(0.03), null, null), "Shallow"), (D.rule_severity(F.lit(100.0), null, null, null), "Shallow"),
        (D.rule_severity(F.lit(900.0), null, null, null), "Moderate"), (D.rule_severity(null, one, one, one), "No pothole"),
        (quality.plausible(null, F.lit(900), one), "implausible"), (quality.plausible(one, null, one), "no_ring"),
        (D.outline_verdict(one, null, one), "failed"), (D.outline_verdict(one, one, null), "failed"),
        (D.settle(F.array(*map(F.lit, "334")), F.lit(True)), "3.33333"), (D.settle(F.array(F.lit("3"), F.lit("4")), F.lit(True)), "3.5"), (D.settle(F.array(F.lit("4"), F.lit("4")), F.lit(True)), "4")]


def test_missing_inputs(spark):
    made = cases()
    got = spark.range(1).select(*[x.alias(f"x{i}") for i, (x, _) in enumerate(made)]).first()
    assert [(i, got[i]) for i in range(len(made))] == [(i, want) for i, (_, want) in enumerate(made)]


def test_no_scale_no_drop(spark):
    relief = spark.createDataFrame([(k, y, x, 60.0) for k in (1, 2) for y in range(9) for x in range(9)], "k int, y int, x int, r double")
    got = hazard.wheel_drops(relief, ["k"], spark.createDataFrame([(1, 20.0)], "k int, mm_per_px double"), (9, 9)).collect()
    assert {r["k"] for r in got} == {1, 2}
    assert all((r["drop_mm"] is None) == (r["k"] == 2) and r["drop_bound_mm"] is not None for r in got)


def test_ties_in_time(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00")], "k int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    starts = spark.createDataFrame([(1, "2024-01-01 09:00:00", v) for v in ("a", "c", "b")], "k int, at string, drive string").withColumn("at", F.col("at").cast("timestamp"))
    assert joins.asof(rows, starts, ["k"], "ts", "at", "drive", "drive").first()["drive"] == "c"
    labels = spark.createDataFrame([("i", "ann", x, "2024-01-01", 1) for x in ("2", "3", "3")], "item_id string, annotator string, label string, labelled_at string, pack_version int")
    manifest = spark.createDataFrame([("i", "ann", "s")], "item_id string, assigned_to string, source string")
    valid = annotation.validate(labels, manifest, 1).where("state = 'valid'")
    assert {r["label"] for r in valid.collect()} == {"3"}
    final = annotation.settle(manifest, valid, spark.createDataFrame([], "item_id string, label string"), True).first()
    assert (final["status"], final["label"]) == ("agreed", "3")


def test_runner_up(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5)], "g string, n long")
    one = counts.where("g = 'b'")
    assert spark.range(1).select(splits.hold_out_runner_up(counts, "g", "n").alias("x"), splits.hold_out_runner_up(one, "g", "n").alias("y")).first() == ("a", None)
