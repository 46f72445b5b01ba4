"""Fixed values at the edges of every rule."""

import math

from pyspark.sql import functions as F

from kerbline.functions import geometry as G
from kerbline.functions import grading as D
from kerbline.functions import names as N
from kerbline.functions import numbers as M
from kerbline.operators import annotation as A
from kerbline.operators import evaluation as E
from kerbline.operators import hazard as H
from kerbline.operators import windows as W


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


def test_names(spark):
    paths = [("a/train/images/pic-1-_jpg.rf.49882cdb.jpg",), ("b/20240102_030405_rgb.png",), (".hidden",)]
    assert values(spark, paths, "p string", N.source_stem(F.col("p"))) == ["pic-1-", "20240102_030405_rgb", ".hidden"]
    assert values(spark, paths, "p string", N.split_of(F.col("p"))) == ["train", "-", "-"]
    assert values(spark, paths, "p string", N.timestamp_key(F.col("p"))) == [None, "20240102_030405", None]


def test_rounding_and_missing(spark):
    assert values(spark, [("0.125",), ("2.5",), ("nan",), ("x",), (None,)], "v string", M.safe_round(F.col("v"), 2)) == [0.12, 2.5, None, None, None]
    assert values(spark, [(None,), (3.0,), (-1.0,)], "v double", M.clip(F.col("v"), 0.0, 1.0)) == [None, 1.0, 0.0]


def test_bands(spark):
    mm = [(24.9,), (25.0,), (49.9,), (50.0,), (None,)]
    assert values(spark, mm, "v double", D.band(F.col("v"))) == ["Shallow", "Moderate", "Moderate", "Deep", None]
    depths = [(12.9,), (13.0,), (25.0,), (25.1,), (50.0,), (50.1,)]
    assert values(spark, depths, "v double", D.depth_band(F.col("v"))) == [0, 1, 1, 2, 2, 3]


def test_astm(spark):
    rows = [(12.9, 300.0), (20.0, 99.0), (25.0, 450.0), (30.0, 500.0), (20.0, 800.0), (60.0, 800.0)]
    got = values(spark, rows, "d double, w double", D.astm_grade(F.col("d"), F.col("w"))["grade"])
    assert got == [None, None, "L", "H", "M", "H"]


def test_risk_response(spark):
    rows = [(25, "local"), (20, "county"), (20, "local"), (16, "local"), (10, "local"), (9, "local")]
    got = values(spark, rows, "s int, r string", D.response_for(F.col("s"), F.col("r")))
    assert [tuple(g) for g in got] == [("D1", "2 hours"), ("D2", "2 working days"), ("D2", "5 working days"), ("D3A", "90 working days"),
                                       ("D3", "90 working days"), ("Observation", "next routine inspection")]


def test_vote_tie_goes_to_the_severe(spark):
    v = spark.createDataFrame([(1, "Shallow"), (1, "Deep")], "item int, label string")
    assert tuple(A.majority_vote(v, "item", "label").first()) == (1, "Deep", 1, 2)


def test_settle(spark):
    rows = [(["3", "4"],), (["2", "4"],), (["3", "3"],), (["water", "dry"],)]
    assert values(spark, rows, "v array<string>", D.settle(F.col("v"), F.lit(True))) == ["3.5", None, "3", None]


def test_kappa_degenerate(spark):
    p = spark.createDataFrame([("water", "water")] * 3, "label_a string, label_b string")
    assert A.kappa(p).first()["kappa"] == 1.0


def test_policy_scores_from_a_matrix(spark):
    m = [[21, 55, 192], [19, 74, 267], [4, 6, 104]]
    rows = [(y, x, m[y][x]) for y in range(3) for x in range(3)]
    s = E.policy_scores(spark.createDataFrame(rows, "y int, x int, n int"), "y", "x", n="n").first()
    assert (round(s["correct"], 4), s["under"], round(s["cost"], 4)) == (0.2682, 29, 1.0849)


def test_progression_equals_the_daily_loop(spark):
    for start, rate, days in ((0.165, 0.002, 30), (0.83, 0.06, 90), (0.495, 0.0312, 60)):
        score = start
        for _ in range(days):
            score = min(1.0, score + rate * (0.5 + score))
        label = {0.165: "Shallow", 0.495: "Moderate", 0.83: "Deep"}[start]
        got = values(spark, [(label, rate, days)], "s string, r double, d int", D.score_after(F.col("s"), F.col("r"), F.col("d")))[0]
        assert math.isclose(got, score, abs_tol=1e-9)


def test_session_gap_is_strict(spark):
    rows = [(1, s) for s in (0, 30, 90, 151, 212)]
    t = spark.createDataFrame(rows, "k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["s"]: r["session"] for r in W.capture_sessions(t, ["k"], "ts", 60, chunk_seconds=100).collect()}
    assert got == {0: 0, 30: 0, 90: 0, 151: 1, 212: 2}


def test_water_cues_abstain(spark):
    cues = {"edge_density": F.col("e"), "semantic": F.col("s")}
    got = values(spark, [(0.4, None), (0.4, 0.8)], "e double, s double", D.water_probability(cues, {"edge_density": 1.0, "semantic": 1.0}, 0.0))
    assert (got[0]["combination"], round(got[0]["probability"], 6)) == ("fallback_missing_cues", 0.4)
    assert got[1]["combination"] == "logistic"


def test_grade_probabilities_match_sampling(spark):
    import numpy as np
    q = np.sort(np.random.default_rng(1).normal(0, 12, 101))
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(q)], "p int, q double")
    d = spark.createDataFrame([(30.0,), (8.0,), (70.0,)], "depth double")
    got = [r["depth_probs"] for r in H.with_depth_probabilities(d, "depth", H.quantile_array(table)).coalesce(1).collect()]
    err = np.interp(np.random.default_rng(2).uniform(0, 100, 200000), np.arange(101), q)
    for depth, probs in zip((30.0, 8.0, 70.0), got):
        true = np.clip(depth - err, 0, None)
        want = [(true < 13).mean(), ((true >= 13) & (true <= 25)).mean(), ((true > 25) & (true <= 50)).mean(), (true > 50).mean()]
        assert np.allclose(probs, want, atol=0.01) and abs(sum(probs) - 1) < 1e-9


def test_wheel_on_flat_road_and_in_a_wide_hole(spark):
    flat = spark.createDataFrame([(1, y, x, 0.0) for y in range(5) for x in range(5)], "f int, y int, x int, r double")
    hole = spark.createDataFrame([(2, y, x, 30.0 + (y == x == 30) * 1e-6) for y in range(2, 60) for x in range(2, 60)], "f int, y int, x int, r double")
    scale = spark.createDataFrame([(1, 10.0), (2, 20.0)], "f int, mm_per_px double")
    got = {(r["f"], r["tyre"]): r["drop_mm"] for r in H.wheel_drops(flat.unionByName(hole), ["f"], scale, (80, 80)).collect()}
    assert got[1, "car"] == 0.0 and math.isclose(got[2, "car"], 30.0, abs_tol=1e-5)
    assert H.tyre_radius(15.0, 195.0, 65.0) == 317.2 and H.tyre_radius(None, 25.0, None) == 336.0


def test_polygon_area(spark):
    pts = [([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)],)]
    assert values(spark, pts, "p array<struct<x:double,y:double>>", G.polygon_area(F.col("p"))) == [6.0]
