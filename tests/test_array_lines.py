"""Image lines and contours are summed in batches: the same numbers as plain loops, nulls stay null, and no expression runs per number."""

import math

import numpy as np
from pyspark.sql import functions as F

from kerbline.operators import hazard as H
from kerbline.operators import raster as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_along_mirrors_and_keeps_nulls(spark):
    rng, weights, rows = np.random.default_rng(2), (0.25, 0.0, 0.5, 1.0, 0.75), []
    for y, n in ((0, 1), (1, 2), (2, 9), (3, 40)):
        rows += [(7, y, x + 3, None if (y, x) == (2, 4) else float(rng.normal())) for x in range(n)]
    df = R.along(spark.createDataFrame(rows, "f int, y int, x int, v double"), ["f"], "y", "x", {"s": ("v", weights)})
    assert df.schema["x"].dataType.simpleString() == "int" and "ArrowEvalPython" in plan(df)
    got, of = {(r["y"], r["x"] - 3): r["s"] for r in df.collect()}, {(y, x - 3): v for _, y, x, v in rows}
    assert set(got) == set(of)
    for (y, x), s in got.items():
        n, want = sum(k[0] == y for k in of), 0.0
        for k, w in enumerate(weights):
            if w:
                spot = (x + k - 2) % max(2 * (n - 1), 1)
                v = of[y, min(spot, 2 * (n - 1) - spot) if n > 1 else 0]
                want = None if v is None or want is None else want + w * v
        assert s == want or (s is not None and want is not None and math.isclose(s, want, rel_tol=1e-15))


def test_contours_are_smoothed_in_batches(spark):
    rng, rows = np.random.default_rng(3), []
    for f, n in ((1, 15), (2, 200), (3, 700), (4, 14)):
        rows += [(f, i, *map(float, rng.normal(size=2))) for i in range(n)]
    p = spark.createDataFrame(rows, "f int, o int, x double, y double").groupBy("f").agg(F.sort_array(F.collect_list(F.struct("o", "x", "y"))).alias("p"))
    p = p.withColumn("m", F.when(F.col("f") == 3, 25).otherwise(2))
    got = {r["f"]: r["s"] for r in p.select("f", H.smoothed("p", "m").alias("s")).collect()}
    for f, n in ((1, 15), (2, 200), (3, 700)):
        m, x = 25 if f == 3 else 2, np.array([r[2] for r in rows if r[0] == f])
        w = [3.0 * (3 * m * m + 3 * m - 1 - 5 * i * i) / ((2 * m - 1) * (2 * m + 1) * (2 * m + 3)) for i in range(-m, m + 1)]
        want = [sum(w[i + m] * x[(j + i) % n] for i in range(-m, m + 1)) for j in range(n)]
        assert np.allclose([s["sx"] for s in got[f]], want, rtol=1e-12, atol=1e-14)
    out = H.curvature(spark.createDataFrame(rows, "f int, o int, x double, y double"), ["f"], "o")
    assert "aggregate(sequence" not in plan(out) and sorted(r["f"] for r in out.collect()) == [1, 2, 3]
