"""Models compared on cells, the rows of equal features taken together: the same fits as on the rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from kerbline.operators import learning as L

SEEN = []


class Watched:
    def _fit(self, dataset):
        SEEN.append(dataset.count())
        return super()._fit(dataset)


class Ridge(Watched, LinearRegression):
    pass


class Forest(Watched, RandomForestRegressor):
    pass


class Boosting(Watched, GBTRegressor):
    pass


def table(spark, rows=12_000):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, rows) - 1.0, rng.integers(0, 4, rows) / 4
    y = 40 + 6 * a * a - 15 * b + rng.normal(size=rows) * 12
    df = spark.createDataFrame([(float(u), float(v), float(w), i % 3) for i, (u, v, w) in enumerate(zip(a, b, y))], "a double, b double, y double, fold int")
    return VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)


def scores(df, models):
    return {r["model"]: r.asDict() for r in L.compare_models(df, "fold", 3, models, "y").collect()}


def test_cells_give_the_fits_of_the_rows(spark, monkeypatch):
    df, base = table(spark).cache(), dict(featuresCol="x", labelCol="y")
    models = {"ridge": Ridge(regParam=1.0, **base), "for.est": Forest(numTrees=8, maxDepth=4, featureSubsetStrategy="all", seed=5, **base), "boosting": Boosting(maxIter=4, maxDepth=3, seed=5, **base)}
    SEEN.clear()
    got = scores(df, models)
    assert len(SEEN) == 3 + 3 * 8 + 3 and max(SEEN) <= 2 * 2 * 20                # two folds of twenty cells, twice for the ridge
    monkeypatch.setattr(L, "ROWS_PER_CELL", 10 ** 9)
    SEEN.clear()
    want = scores(df, models)
    assert SEEN == [8_000] * 9 and set(got) == set(want) == set(models)
    for name in models:
        assert list(got[name]) == list(want[name]) and got[name]["n"] == want[name]["n"] == 12_000
        for k in ("mae", "rmse", "r", "within10"):
            assert np.isclose(got[name][k], want[name][k], rtol=0.01 if name == "for.est" else 1e-9), (name, k)


def test_cells_count_every_row_and_draw_about_as_many(spark):
    df, forest = table(spark), RandomForestRegressor(numTrees=6, featuresCol="x", labelCol="y", seed=1)
    found = L.cells(df, "fold", {"f": forest}, "y").toPandas()
    want = df.groupBy("fold", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).toPandas()
    assert len(found) == len(want) == 60 and found["_n"].sum() == 12_000
    at = {(r["fold"], *r["_x_x"]): (r["_n"], r["_m"], r["_s"]) for r in found.to_dict("records")}
    assert all(np.allclose(at[r["fold"], r["a"], r["b"]], (r["n"], r["m"], r["s"])) for r in want.to_dict("records"))
    draws = np.array([found[f"_d0_{t}"].sum() for t in range(6)])
    assert (abs(draws - 12_000) < 6 * 12_000 ** 0.5).all() and len(set(draws)) > 1


def test_what_cells_cannot_tell_is_fitted_on_rows(spark):
    base = dict(featuresCol="x", labelCol="y")
    assert L.fits_cells(LinearRegression(**base)) and L.fits_cells(GBTRegressor(**base)) and L.fits_cells(RandomForestRegressor(**base))
    for other in (LinearRegression(loss="huber", **base), LinearRegression(solver="l-bfgs", **base), LinearRegression(weightCol="w", **base), GBTRegressor(lossType="absolute", **base), GBTRegressor(subsamplingRate=0.5, **base),
                  RandomForestRegressor(minInstancesPerNode=5, **base), RandomForestRegressor(bootstrap=False, **base)):
        assert not L.fits_cells(other)
    df = table(spark, 6_000)
    SEEN.clear()
    got = scores(df, {"ridge": Ridge(**base), "absolute": Boosting(lossType="absolute", maxIter=2, maxDepth=2, **base)})
    assert sorted(SEEN) == [80] * 3 + [4_000] * 3 and {r["n"] for r in got.values()} == {6_000}
    assert not L.rows_repeat(df.limit(500), "fold", 3, ["x"]) and L.rows_repeat(df, "fold", 3, ["x"])


def test_a_missing_label_stops_cells_too(spark):
    df = table(spark, 6_000).withColumn("y", F.when(F.col("a") + F.col("b") != 0, F.col("y")))
    with pytest.raises(Exception, match="(?i)null|nan"):
        scores(df, {"ridge": LinearRegression(featuresCol="x", labelCol="y")})
