"""The distributed forms give exactly what a plain computation gives, also where one key holds most rows."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kerbline.operators import evaluation as E
from kerbline.operators import ordered as O
from kerbline.operators import raster as R
from kerbline.operators import similarity as S
from kerbline.operators import splits as L
from kerbline.operators import windows as W
from kerbline.storage import materialise


def skewed(spark, n=4000):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 5, n).astype(str)), "v": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 10, n).round(1))})
    return pdf, spark.createDataFrame(pdf)


def test_percentiles(spark):
    pdf, df = skewed(spark)
    points = {"p05": 0.05, "p50": 0.5, "p90": 0.9}
    got = {r["g"]: r for r in O.percentiles(df, ["g"], "v", points, chunks=16).collect()}
    for g, part in pdf.groupby("g"):
        for name, p in points.items():
            assert np.isclose(got[g][name], np.percentile(part.v, p * 100))
    table = {r["p"]: r["q"] for r in E.quantile_table(df, [], "v").collect()}
    assert len(table) == 101 and all(np.isclose(table[i], np.percentile(pdf.v, i)) for i in range(101))


def test_ranks_and_correlation(spark):
    pdf, df = skewed(spark)
    got = {r["v"]: r["rank_pct"] for r in W.rank_pct(df, "v").collect()}
    want = pdf.assign(r=pdf.v.rank(pct=True)).groupby("v").r.first()
    assert all(np.isclose(got[v], want[v]) for v in want.index)


def test_row_numbers_are_whole(spark):
    _, df = skewed(spark)
    keyed = df.withColumn("id", F.monotonically_increasing_id()).withColumn("h", F.md5(F.col("id").cast("string")))
    got = O.row_numbers(keyed, ["h"], F.substring("h", 1, 2), "rn").select("h", "rn").toPandas().sort_values("h")
    assert got.rn.tolist() == list(range(1, len(got) + 1))


def near(spark, hashes):
    def signed(v):
        return int(v) - (1 << 64) if int(v) >= 1 << 63 else int(v)
    return spark.createDataFrame([(signed(h),) for h in hashes], "h bigint")


def test_hash_pairs_equal_brute_force_even_in_full_buckets(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    family = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(20)]
    crowd = [int(base[0]) ^ (int(v) << 3) for v in rng.integers(0, 1 << 12, 60)]                      # share most blocks
    values = sorted(set(family + crowd))
    want = {(a, b) for a in values for b in values if bin(a ^ b).count("1") <= 6}
    for hot in (4096, 5):
        rows = S.hash_pairs(near(spark, values), near(spark, values), 6, hot=hot).collect()
        got = [(r["ha"] % (1 << 64), r["hb"] % (1 << 64)) for r in rows]
        assert len(got) == len(set(got)) and set(got) == want


def test_splits_share_no_photo(spark):
    df = spark.createDataFrame([(i, f"photo{0 if i < 300 else i % 40}") for i in range(900)], "id int, photo string")
    out = L.grouped_split(df, ["photo"], 0.25).cache()
    assert out.count() == 900 and L.audit_splits(out, "split", "photo").count() == 0
    assert out.where("split = 'test'").select("photo").distinct().count() == 10


def test_plane_is_recovered(spark):
    px = spark.createDataFrame([(1, y, x, 0.5 * x - 0.25 * y + 900.0) for y in range(20) for x in range(30)], "f int, y int, x int, z double")
    r = R.plane_fit(px, ["f"], "z").first()
    assert np.allclose([r["a"], r["b"], r["c"]], [0.5, -0.25, 900.0], atol=1e-9) and r["rms"] < 1e-5


def test_bowl_depth_on_a_tilted_road(spark):
    rows, mask = [], []
    for y in range(90):
        for x in range(90):
            inside = (x - 45) ** 2 + (y - 45) ** 2 <= 15 ** 2
            rows.append((1, y, x, 0.4 * x + 900.0 + (40.0 if inside else 0.0)))
            if inside:
                mask.append((1, 1, y, x))
    px, m = spark.createDataFrame(rows, "f int, y int, x int, z double"), spark.createDataFrame(mask, "f int, o int, y int, x int")
    r = R.bowl_depth(px, m, ["f"], "o", "z").first()
    assert abs(r["p90_depth_mm"] - 40.0) < 1e-6 and r["inside_px"] == len(mask)


def test_quadratic_road_and_plane_3d(spark):
    rng = np.random.default_rng(5)
    X, Z = rng.uniform(-1500, 1500, 800), rng.uniform(2000, 9000, 800)
    Y = 1200 + 0.02 * X + 0.1 * Z + 3e-6 * X * X
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "X": X, "Y": Y + rng.normal(0, 0.5, 800), "Z": Z}))
    q = R.quadratic_road(df, ["g"], "X", "Z", "Y").first()
    assert abs(q["road_sd"] - 0.5) < 0.15
    flat = spark.createDataFrame(pd.DataFrame({"g": 1, "X": X, "Y": 0.1 * X, "Z": 500 + rng.normal(0, 1, 800)}).assign(Y=lambda d: rng.uniform(-900, 900, 800)))
    assert R.plane_3d(flat, ["g"], ["X", "Y", "Z"]).first()["tilt_deg"] < 0.5


def test_components(spark):
    cells = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 9, 9), (1, 9, 10), (2, 0, 0)] + [(3, 0, x) for x in range(40)]
    got = {(r["f"], r["rank"]): r["size"] for r in R.grid_components(spark.createDataFrame(cells, "f int, y int, x int"), ["f"]).collect()}
    assert got == {(1, 1): 3, (1, 2): 2, (2, 1): 1, (3, 1): 40}


def test_cut_offs_equal_a_full_grid_search(spark):
    rng = np.random.default_rng(7)
    mm = rng.uniform(0, 80, 400)
    y, pred = np.digitize(mm, [25, 50]), mm * 0.8 + rng.normal(0, 8, 400)
    best = None
    for t1 in np.arange(5.0, 45.0, 0.5):
        for t2 in np.arange(t1 + 5.0, 70.0, 0.5):
            d = np.where(pred < t1, 0, np.where(pred < t2, 1, 2)) - y
            cost = np.where(d < 0, -3.0 * d, d).sum()
            if best is None or cost < best[0]:
                best = (cost, t1, t2)
    r = E.choose_thresholds(spark.createDataFrame(pd.DataFrame({"y": y.astype(int), "p": pred})), "y", "p").first()
    assert (r["cost"], r["moderate_from"], r["deep_from"]) == best


def test_bootstrap_interval_is_plausible(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(2, 1, 300)
    r = E.bootstrap_mean(spark.createDataFrame(pd.DataFrame({"id": range(300), "x": x})), ["id"], F.col("x"), 400, 1).first()
    half = 1.96 * x.std() / np.sqrt(300)
    assert abs((r["high"] - r["low"]) / 2 - half) < 0.3 * half and r["low"] < x.mean() < r["high"]


def plans(spark, work):
    """Physical plans of the executions that ``work`` starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    now = store.executionsList()
    return [now.apply(i).physicalPlanDescription() for i in range(now.size()) if now.apply(i).executionId() not in before]


def test_cells_are_never_broadcast(spark):
    cells = spark.createDataFrame([(f, y, x) for f in range(3) for y in (-2, -1, 5) for x in range(-3, 4, 1 + y % 2)], "f int, y int, x int")
    done = plans(spark, lambda: R.grid_components(cells, ["f"]).collect())
    assert done and not any("BroadcastExchange" in p for p in done)


def test_cells_left_of_and_above_the_origin(spark):
    cells = [(1, -1, -1), (1, 0, 0), (1, -7, 3), (1, -7, 4), (1, -6, 5)]
    got = {(r["c"]["y"], r["c"]["x"]): r["size"] for r in R.grid_components(spark.createDataFrame(cells, "f int, y int, x int"), ["f"]).collect()}
    assert got == {(-1, -1): 2, (-7, 3): 3}


def test_hashes_with_their_block_pairs_are_never_broadcast(spark):
    written = materialise(near(spark, [1, 2, 3]), "hashes")
    plan = S.hash_pairs(written, written)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[p#\w+, v#\w+, s#\w+, sv#\w+\]", plan)


def test_readings_are_computed_once_for_the_road_and_its_limits(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(v):
        seen.add(1)
        return v

    px = spark.createDataFrame([(1, y, x, float(x + y)) for y in range(30) for x in range(30)], "f int, y int, x int, v double")
    mask = spark.createDataFrame([(1, 1, y, x) for y in range(10, 20) for x in range(10, 20)], "f int, o int, y int, x int")
    px = px.select("f", "y", "x", F.udf(read, "double")("v").alias("z"))
    assert R.bowl_depth(px, mask, ["f"], "o", "z", 4, 60, 20).first()["inside_px"] == 100 and seen.value == 900


def test_outlines_are_never_broadcast_as_positions(spark):
    px = materialise(spark.createDataFrame([(1, y, x, float(x + y)) for y in range(30) for x in range(30)], "f int, y int, x int, z double"), "pixels")
    mask = materialise(spark.createDataFrame([(1, 1, y, x) for y in range(10, 20) for x in range(10, 20)], "f int, o int, y int, x int"), "mask")
    plan = R.region(px, mask, ["f"], "o", 4)
    assert "BroadcastExchange" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 18 * 18
