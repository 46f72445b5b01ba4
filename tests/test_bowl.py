"""The bowl under water: a planted floor is found again through outliers, and the reasons to abstain."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.functions.linear import solved, solved_in_batches
from kerbline.operators.bowl import normal_equations, powers, recover_bowl, with_terms


def frame(number, floor, wet=lambda d: d < 0.5, noise=0.0):
    """Pixels of a 41 x 41 image with a round outline of radius 12, and the 90th percentile with the true floor under the water."""
    rng, rows, true = random.Random(number), [], []
    for y in range(41):
        for x in range(41):
            d = ((x - 20) ** 2 + (y - 20) ** 2) ** 0.5 / 12
            seen = floor(x, y, d)
            under = d < 1 and wet(d)
            value = floor(20 + 6 * wet(0), 20, 0.5) if under else seen + (rng.choice([-60.0, 70.0]) if rng.random() < noise else 0.0)
            if d < 1:
                true.append(floor(x, y, d) if under else value)
            rows.append((number, y, x, value, True if under else None))
    return rows, float(np.percentile(true, 90))


@pytest.fixture(scope="module")
def result(spark):
    bowl = lambda x, y, d: 60.0 * (1 - d * d)
    made = {1: frame(1, bowl), 2: frame(2, bowl, noise=0.15), 3: frame(3, bowl, wet=lambda d: False), 4: frame(4, bowl, wet=lambda d: d < 0.99), 5: frame(5, lambda x, y, d: 2.0 * x + 0.05 * (x - 20) ** 2)}
    rows = [r for f, _ in made.values() for r in f] + [(6, y, x, None, True) for y in range(41) for x in range(41)]
    px = spark.createDataFrame(rows, "frame int, y int, x int, relief double, wet boolean")
    mask = px.where((F.col("x") - 20) ** 2 + (F.col("y") - 20) ** 2 < 144).select("frame", F.lit(1).alias("outline"), "y", "x")
    got = recover_bowl(px, mask, ["frame"], "outline", "relief", "wet", hypotheses=40, cascade=(3, 2))
    return made, {r["frame"]: r for r in got.collect()}


def test_a_planted_floor_is_recovered(result):
    made, got = result
    for k in (1, 2):
        assert abs(got[k]["recovered_mm"] - made[k][1]) < 0.5 and got[k]["surface_mm"] < made[k][1] - 2 and got[k]["abstained"] is None
        assert got[k]["bowl"].startswith("consensus") and 0.2 < got[k]["water_share"] < 0.3


def test_reasons_to_abstain(result):
    _, got = result
    assert [got[k]["abstained"] for k in (3, 4, 5, 6)] == ["no water", "too little visible wall", "visible wall is not bowl-shaped", "too little visible wall"]
    assert all(got[k]["recovered_mm"] == got[k]["surface_mm"] and got[k]["bowl"] is None for k in (3, 4, 5))
    assert got[6]["surface_mm"] is None is got[6]["recovered_mm"]


def test_solver_and_normal_equations(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(6, 6)), rng.normal(size=6)
    rows = [[*map(float, r), float(v)] for r, v in zip(a, b, strict=True)]
    df = spark.createDataFrame([(rows,), ([[0.0] * 7] * 6,), (None,)], "m array<array<double>>")
    good, none, null = [r[0] for r in df.select(solved(F.col("m"), 6)).collect()]
    assert np.allclose(good, np.linalg.solve(a, b)) and none is None is null
    pts = [(1, float(u), float(v), float(z)) for u, v, z in rng.normal(size=(200, 3))]
    coef = normal_equations(with_terms(spark.createDataFrame(pts, "k int, u double, v double, z double"), 3), ["k"], 3).first()["coef"]
    design = np.array([[u ** i * v ** j for i, j in powers(3)] for _, u, v, _ in pts])
    assert np.allclose(coef, np.linalg.lstsq(design, np.array([p[3] for p in pts]), rcond=None)[0])


def test_systems_are_solved_in_batches(spark):
    """Batches give the same digits as the expression, null where there is no solution, and a fit evaluates no expression per number."""
    rows = np.random.default_rng(1).normal(size=(1200, 6, 7)).tolist()
    rows[3], rows[5][2], rows[9][0][0], rows[11][0][0] = [[0.0] * 7] * 6, rows[5][1], float("nan"), 0.0
    df = spark.createDataFrame([*enumerate(rows), (-1, None)], "i int, m array<array<double>>")
    got = df.select("i", solved(F.col("m"), 6).alias("a"), solved_in_batches(F.col("m"), 6).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sorted(r.i for r in got if r.b is None) == [-1, 3, 5, 9, 11]
    points = with_terms(df.select("i", F.lit(1.0).alias("u"), F.lit(2.0).alias("v"), F.lit(3.0).alias("z")), 4)
    plan = normal_equations(points, ["i"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "reduce(" not in plan
