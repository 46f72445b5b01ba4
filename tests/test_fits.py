"""Fits, blurs and cuts of depth maps against plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import detection as X
from kerbline.operators import raster as R


def table(spark, z, frame=1):
    rows = [(frame, y, x, None if v is None or np.isnan(v) else float(v)) for y, line in enumerate(z) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "frame int, y int, x int, z double")


def mirrored(a, weights, axis):
    half = len(weights) // 2
    padded = np.pad(a, [(half, half) if k == axis else (0, 0) for k in range(2)], mode="reflect")
    return sum(w * np.take(padded, range(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(weights))


def test_least_squares(spark):
    rng = np.random.default_rng(0)
    u, v, z = rng.normal(size=(3, 80))
    df = spark.createDataFrame([(1, *map(float, r)) for r in zip(u, v * 1000, z)] + [(2, float(i), 2.0 * i, 1.0) for i in range(9)] + [(1, 1.0, 1.0, None)], "k int, u double, v double, z double")
    got = {r["k"]: r for r in R.least_squares(df, ["k"], [F.col("u"), F.col("v"), F.lit(1.0), F.col("u") * F.col("u")], F.col("z")).collect()}
    want = np.linalg.lstsq(np.column_stack([u, v * 1000, np.ones(80), u * u]), z, rcond=None)[0]
    assert got[1]["n"] == 80 and np.allclose(got[1]["coef"], want) and got[2]["coef"] is None


@pytest.mark.parametrize("shape", [(12, 20), (9, 30)])
def test_smooth_gradient(spark, shape):
    rng = np.random.default_rng(1)
    z = rng.random(shape)
    blur = R.gaussian(5)
    assert abs(sum(blur) - 1) < 1e-12 and np.allclose(blur, blur[::-1])
    soft = mirrored(mirrored(z, blur, 1), blur, 0)
    gx, gy = mirrored(mirrored(soft, (1, 2, 1), 0), (-1, 0, 1), 1), mirrored(mirrored(soft, (-1, 0, 1), 0), (1, 2, 1), 1)
    got = R.smooth_gradient(table(spark, z), ["frame"], "z", 5).collect()
    assert len(got) == z.size and all(np.isclose(r["gx"], gx[r["y"], r["x"]]) and np.isclose(r["gy"], gy[r["y"], r["x"]]) for r in got)


def test_blur_leaves_out_missing_readings(spark):
    z = np.full((8, 8), 3.0)
    z[2:4, 2:5] = np.nan
    assert all(abs(r["gx"]) < 1e-9 and abs(r["gy"]) < 1e-9 for r in R.smooth_gradient(table(spark, z), ["frame"], "z", 5).collect())
    one = R.smooth_gradient(table(spark, [[1.0, 2.0]]), ["frame"], "z", 3).collect()
    assert len(one) == 2 and all(r["gy"] == 0 for r in one)


def test_normals_need_road_and_rim(spark):
    z = np.random.default_rng(2).random((10, 10))
    px = table(spark, z)
    mask = px.where("x between 3 and 5 and y between 3 and 5").select("frame", F.lit(1).alias("outline"), "y", "x")
    whole = px.select("frame", F.lit(2).alias("outline"), "y", "x")
    got = R.surface_normals(px, mask.unionByName(whole), ["frame"], "outline", "z", 2, 3).collect()
    assert [r["outline"] for r in got] == [1] and 0 <= got[0]["mean_normal_deviation"] <= got[0]["p90_normal_deviation"] <= got[0]["max_normal_deviation"] <= 180


def cut(depth, inside, wet=True, severity="Deep"):
    """The reference cut: numpy fits over one image row."""
    at = np.arange(len(depth), dtype=float)
    out = ~inside
    road = np.polyval(np.polyfit(at[out], depth[out], 2), at) if out.sum() >= 4 else np.full(len(depth), depth[out].mean())
    lo, hi = np.flatnonzero(inside)[[0, -1]]
    if not wet or inside.sum() <= 10:
        return road, depth
    margin = max(3, int((hi - lo) * 0.2))
    wall = [i for i in range(max(0, lo - 5), min(len(depth), lo + margin))] + [i for i in range(max(0, hi - margin), min(len(depth), hi + 5))]
    a, b, c = np.polyfit(at[wall], depth[wall], 2)
    drop = (hi - lo) * {"Shallow": 0.0002, "Deep": 0.0012}.get(severity, 0.0006)
    floor = np.polyval([a, b, c], at) if a >= 1e-5 else 4 * drop / (hi - lo) ** 2 * (at - (lo + hi) / 2) ** 2 + road - drop
    floor = np.minimum(floor, road)
    return road, np.where(inside, np.minimum(floor, depth), floor)


@pytest.mark.parametrize("bend", [1.0, -1.0])
def test_depth_slice(spark, bend):
    rng = np.random.default_rng(5)
    x = np.arange(60)
    z = np.tile(0.5 + 0.001 * x, (5, 1)) + rng.normal(size=(5, 60)) * 0.002
    z[:, 22:38] += bend * 0.004 * ((x[22:38] - 29.5) ** 2 - 64) / 10
    z[0, 0], z[4, 59] = 0.0, 1.0
    px = table(spark, z)
    mask = px.where("x between 22 and 37 and y between 1 and 3").select("frame", F.lit(1).alias("outline"), "y", "x")
    facts = spark.createDataFrame([(1, 1, True, "Deep")], "frame int, outline int, wet boolean, severity string")
    got = sorted(R.depth_slice(px, mask, ["frame"], "outline", "z", facts).collect(), key=lambda r: r["at"])
    start, depth = 22 - int(15 * 0.8), (z[2] - z.min()) / (z.max() - z.min())
    stop = 37 + int(15 * 0.8) + 1
    inside = (x >= 22) & (x <= 37)
    road, floor = cut(depth[start:stop], inside[start:stop])
    assert np.allclose([r["road"] for r in got], road) and np.allclose([r["predicted"] for r in got], floor)
    dry = sorted(R.depth_slice(px, mask, ["frame"], "outline", "z").collect(), key=lambda r: r["at"])
    assert [r["predicted"] for r in dry] == [r["depth"] for r in dry]
    wide = px.where("y between 1 and 3 and x between 1 and 58").select("frame", F.lit(1).alias("outline"), "y", "x")
    few = R.depth_slice(px, wide, ["frame"], "outline", "z", facts).collect()
    assert len(few) == 60 and len({round(r["road"], 9) for r in few}) == 1        # two samples of road: their mean
    both = R.slice_depths(R.depth_slice(px, mask, ["frame"], "outline", "z", facts), ["frame", "outline"]).first()
    assert np.isclose(both["predicted_bowl_depth"], np.abs(road - floor)[inside[start:stop]].max())


def test_patch_variance_is_drawn_to_size(spark):
    """A ring that is as even as the inside but larger keeps a ratio near one; a ring of one patch gives way to the scene."""
    rng = np.random.default_rng(9)
    rows = [(1, 1, y, x, 3 <= y <= 4 and 3 <= x <= 4, [float(v) for v in rng.normal(size=16)]) for y in range(8) for x in range(8)]
    rows += [(2, 1, 0, x, x < 7, [float(v) for v in rng.normal(size=16)]) for x in range(8)] + [(2, 1, 5, x, False, [float(v) for v in rng.normal(size=16)]) for x in range(8)]
    rows += [(3, 1, 0, 0, True, [1.0]), (3, 1, 0, 1, False, [2.0]), (1, 1, 9, 9, True, None)]
    df = spark.createDataFrame(rows, "frame int, outline int, y int, x int, inside boolean, v array<double>")
    got = {r["frame"]: r for r in R.embedding_ratio(df, ["frame"], "outline", "inside", "v").collect()}
    assert set(got) == {1, 2} and got[1]["patches"] == 4 and got[1]["ring_source"] == "ring" and got[2]["ring_source"] == "scene"
    inside = np.array([r[5] for r in rows if r[0] == 1 and r[4] and r[5]])
    assert np.isclose(got[1]["inside_variance"], inside.var(axis=0, ddof=1).mean()) and 0.5 < got[1]["ratio"] < 2


def test_box_recall_without_frames_of_a_kind(spark):
    preds = spark.createDataFrame([(1, 1, y, x) for y in range(4, 8) for x in range(4, 8)] + [(2, 5, 0, 0)], "frame int, pred int, y int, x int")
    boxes = spark.createDataFrame([(1, 1, 4, 4, 8, 8), (1, 2, 20, 20, 24, 24)], "frame int, box int, x0 int, y0 int, x1 int, y1 int")
    frames = spark.createDataFrame([(1, "box_test", 30, 30), (2, "neg_test", 30, 30), (3, "neg_test", 30, 30)], "frame int, role string, w int, h int")
    r = X.box_recall(preds, boxes, frames, ["frame"], "pred", "box").first()
    assert (r["box_recall"], r["n_boxes"], r["stray"], r["n_neg_frames"], r["neg_frames_hit"], r["neg_masks"], r["neg_masks_top_third"]) == (0.5, 2, 0, 2, 0.5, 1, 1)
    r = X.box_recall(preds, boxes.limit(0), frames.where("role = 'other'"), ["frame"], "pred", "box").first()
    assert tuple(r) == (0.0, 0, 0, 0.0, 0, 0.0, 0, 0.0, 0)
