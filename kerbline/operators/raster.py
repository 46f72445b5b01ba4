"""Measurements on long pixel tables.

A pixel table has one row per (frame, y, x), so a frame is bounded by the camera's image size: per-frame and
per-row windows below sort at most one image, or one image row, whatever the number of frames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from kerbline.functions.linear import products, scaled
from kerbline.functions.numbers import clip
from kerbline.functions.ranges import slices
from kerbline.storage import materialise

# fixed values: dilation radii in pixels (kernel half-width x iterations) and least pixel counts of the label protocol
RING_RADIUS, CONTEXT_RADIUS, EDGE_RADIUS, WALL_RADIUS = 24, 14, 4, 6
MIN_RING_PX, MIN_INSIDE_PX = 400, 150
# fixed values: width of the blur before slopes are taken, least positions of road and rim for normals
BLUR, MIN_ROAD_NORMALS, MIN_RIM_NORMALS = 15, 10, 5

# fixed values: least samples outside an outline for a road parabola, samples inside that a wall fit has to exceed, curvature below which a wall is flat
ROAD_SAMPLES, WALL_SAMPLES, FLAT_WALL = 4, 10, 1e-5
# fixed values: width of the ring of patches, draws of a size-matched variance
RING_PATCHES, MATCH_DRAWS = 2, 20
# fixed values: inputs of the depth model, in their order
FEATURES = ["mf_p50_mm", "mf_p75_mm", "mf_p90_mm", "mf_p95_mm", "mf_max_mm", "mf_mean_mm", "mf_frac_gt10", "mf_frac_gt25", "mf_plane_rms_mm", "mf_cam_dist_mm", "mf_area_cm2", "mf_log_area_cm2",
            "mf_diam_mm", "mf_p90_over_dist", "mf_p90_over_diam", "mf_normal_dev_mean", "mf_normal_dev_p90", "mf_valid_frac"]


def normalise(px: DataFrame, frame: Sequence[str], z: str, name: str = "zn") -> DataFrame:
    """Scale ``z`` to 0-1 within each frame (0 everywhere in a flat frame)."""
    lim = px.groupBy(*frame).agg(F.min(z).alias("_lo"), F.max(z).alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col(z) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return px.join(lim, list(frame)).withColumn(name, F.when(F.col(z).isNotNull(), scaled)).drop("_lo", "_hi")


def global_normalise(df: DataFrame, z: str, name: str = "zn") -> DataFrame:
    """Scale ``z`` by the range over everything; the range is one scalar subquery."""
    lim = df.agg(F.struct(F.min(z).alias("lo"), F.max(z).alias("hi"))).scalar()
    return df.withColumn(name, (F.col(z) - lim.getField("lo")) / (lim.getField("hi") - lim.getField("lo") + 1e-8))


def boxes(mask: DataFrame, outline: Sequence[str]) -> DataFrame:
    """Bounding box, area and the box area outside the outline."""
    b = mask.groupBy(*outline).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("area"))
    w, h = F.greatest(F.lit(1), F.col("x1") - F.col("x0")), F.greatest(F.lit(1), F.col("y1") - F.col("y0"))
    return b.withColumns({"width": w, "height": h, "box_area": w * h, "outside_area": F.greatest(F.lit(0).cast("bigint"), w * h - F.col("area"))})


def region(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, radius: int) -> DataFrame:
    """Every pixel of each outline (``inside``) and of the ring within ``radius`` of it (``ring``).

    The square dilation is two running maxima, along image rows and then along columns, over all positions of
    the widened bounding box: pixels without a reading must pass the dilation on too.
    """
    frame = list(frame)
    key = [*frame, outline]
    box = mask.groupBy(*key).agg(*[f(v).alias(f"_{v}{i}") for v in ("x", "y") for i, f in ((0, F.min), (1, F.max))])
    span = lambda v: F.explode(F.sequence(F.col(f"_{v}0") - radius, F.col(f"_{v}1") + radius))
    spots = box.withColumn("y", span("y")).withColumn("x", span("x")).select(*key, "y", "x", F.lit(None).cast("int").alias("_m"))
    near = spots.unionByName(mask.select(*key, F.col("y").cast(spots.schema["y"].dataType).alias("y"), F.col("x").cast(spots.schema["x"].dataType).alias("x"), F.lit(1).alias("_m")))
    near = near.repartition(*key).groupBy(*key, "y", "x").agg(F.max("_m").alias("_m"))       # one shuffle serves the aggregate and both windows
    across = Window.partitionBy(*key, "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy(*key, "x").orderBy("y").rangeBetween(-radius, radius)
    near = near.withColumn("_a", F.max("_m").over(across)).withColumn("_d", F.max("_a").over(down)).where("_d IS NOT NULL")
    near = near.select(*key, "y", "x", F.col("_m").isNotNull().alias("inside"), F.col("_m").isNull().alias("ring"))
    return px.join(near.hint("merge"), [*frame, "y", "x"])                      # the planner takes an outline and all its positions for one row: never a broadcast


def depth_stats(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, z: str, radius: int = CONTEXT_RADIUS, edge: int = EDGE_RADIUS) -> DataFrame:
    """Relative depth statistics of each outline, its contrast with the road ring of ``radius`` pixels and its step at the rim, against the ``edge`` pixels around it."""
    known = normalise(px, frame, z)
    r = region(known, mask, frame, outline, radius)
    rim = region(known, mask, frame, outline, edge).where("ring").groupBy(*frame, outline).agg(F.avg("zn").alias("_rim"))
    inner = F.when(F.col("inside"), F.col("zn"))
    stats = r.groupBy(*frame, outline).agg(
        F.count(inner).alias("area"), F.avg(inner).alias("mean_depth"), F.max(inner).alias("max_depth"), F.min(inner).alias("min_depth"), F.stddev_pop(inner).alias("depth_std"),
        F.percentile(inner, F.lit(0.9)).alias("p90_depth"), F.skewness(inner).alias("depth_skewness"), F.kurtosis(inner).alias("depth_kurtosis"),
        F.avg(F.when(F.col("ring"), F.col("zn"))).alias("_ring"))
    flat = lambda v: F.coalesce(F.nanvl(F.col(v), F.lit(0.0)), F.lit(0.0))
    return stats.join(rim, [*frame, outline], "left").withColumns({"depth_range": F.col("max_depth") - F.col("min_depth"), "local_depth_contrast": F.coalesce(F.abs(F.col("mean_depth") - F.col("_ring")), F.lit(0.0)),
                              "boundary_gradient": F.coalesce(F.col("mean_depth") - F.col("_rim"), F.lit(0.0)),
                              "depth_skewness": flat("depth_skewness"), "depth_kurtosis": flat("depth_kurtosis")}).drop("_ring", "_rim")


def weighted_mean_depth(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, z: str) -> DataFrame:
    """Mean depth weighed by the distance from the centroid, and the aspect ratio."""
    key = [*frame, outline]
    inside = mask.join(normalise(px, frame, z).select(*frame, "y", "x", "zn"), [*frame, "y", "x"])
    mid = mask.groupBy(*key).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    d = F.sqrt((F.col("x") - F.col("_cx")) ** 2 + (F.col("y") - F.col("_cy")) ** 2)
    out = inside.join(mid, key).withColumn("_d", d).groupBy(*key).agg((F.sum(F.col("zn") * F.col("_d")) / (F.sum("_d") + 1e-8)).alias("weighted_mean_depth"))
    return out.join(boxes(mask, key).select(*key, (F.col("width") / (F.col("height") + 1e-8)).alias("aspect_ratio")), key)


def plane_fit(df: DataFrame, group: Sequence[str], z: str, x: str = "x", y: str = "y") -> DataFrame:
    """Least-squares plane z = a x + b y + c per group with its RMS, from centred second moments in one aggregate.

    A group whose points lie on a line (no determinant) gets nulls.
    """
    cov = lambda u, v, n: F.covar_pop(u, v).alias(n)
    ok = df.where(F.col(z).isNotNull())
    m = ok.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.avg(z).alias("_z"), F.var_pop(x).alias("_xx"), F.var_pop(y).alias("_yy"),
                               F.var_pop(z).alias("_zz"), cov(x, y, "_xy"), cov(x, z, "_xz"), cov(y, z, "_yz"))
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") ** 2
    m = m.withColumn("_det", F.when(det > 1e-12 * F.greatest(F.col("_xx") * F.col("_yy"), F.lit(1e-300)), det))
    m = m.withColumns({"a": (F.col("_xz") * F.col("_yy") - F.col("_yz") * F.col("_xy")) / F.col("_det"), "b": (F.col("_yz") * F.col("_xx") - F.col("_xz") * F.col("_xy")) / F.col("_det")})
    rms = F.sqrt(F.greatest(F.col("_zz") - F.col("a") * F.col("_xz") - F.col("b") * F.col("_yz"), F.lit(0.0)))
    return m.select(*group, "n", "a", "b", (F.col("_z") - F.col("a") * F.col("_x") - F.col("b") * F.col("_y")).alias("c"), F.when(F.col("a").isNotNull(), rms).alias("rms"))


def road_plane(r: DataFrame, key: Sequence[str], z: str, min_ring: int = MIN_RING_PX) -> DataFrame:
    """Road plane of each outline from its ring, without the outer 5% of readings on either side."""
    ring = r.where(F.col("ring") & F.col(z).isNotNull())
    lim = ring.groupBy(*key).agg(F.percentile(z, F.array(F.lit(0.05), F.lit(0.95))).alias("_q"), F.count(F.lit(1)).alias("ring_px"))
    kept = ring.join(lim, list(key)).where(F.col(z).between(F.col("_q")[0], F.col("_q")[1]))
    fit = plane_fit(kept, key, z).where(F.col("n") >= min_ring // 2)
    return fit.join(lim.where(F.col("ring_px") >= min_ring).select(*key, "ring_px"), list(key))


def deviation(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, z: str, radius: int = RING_RADIUS, min_ring: int = MIN_RING_PX) -> DataFrame:
    """Region pixels with ``dev``, their depth below the road plane; outlines without enough road drop out.

    The region is written once: readings that are averages may end in another digit each time they are computed, and one that is itself a limit of the road would then drop out.
    """
    key = [*frame, outline]
    r = materialise(region(px, mask, frame, outline, radius), "region")
    plane = road_plane(r, key, z, min_ring).select(*key, "a", "b", "c", "rms", "ring_px").where(F.col("a").isNotNull())
    return r.join(plane, key).withColumn("dev", F.col(z) - (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c"))).drop("a", "b", "c")


def bowl_depth(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, z: str, radius: int = RING_RADIUS, min_ring: int = MIN_RING_PX,
               min_inside: int = MIN_INSIDE_PX) -> DataFrame:
    """90th percentile, mean and maximum depth below the road inside each outline, with the plane's RMS."""
    d = deviation(px, mask, frame, outline, z, radius, min_ring).where("inside")
    out = d.groupBy(*frame, outline).agg(F.count("dev").alias("inside_px"), F.first("ring_px").alias("ring_px"), F.first("rms").alias("plane_rms_mm"), F.avg("dev").alias("mean_depth_mm"),
                                         F.percentile("dev", F.lit(0.9)).alias("p90_depth_mm"), F.max("dev").alias("max_depth_mm"))
    return out.where(F.col("inside_px") >= min_inside)


def pixel_areas(px: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Surface area each pixel covers and its unit normal nx, ny, nz: cross product of the steps to its right and lower neighbour (point columns PX, PY, PZ)."""
    right, below = Window.partitionBy(*frame, "y").orderBy("x"), Window.partitionBy(*frame, "x").orderBy("y")

    def step(v, w, axis):
        near = F.lead(axis).over(w) == F.col(axis) + 1
        return F.when(near, F.lead(v).over(w) - F.col(v))

    s = px.withColumns({f"_{d}{v}": step(v, w, a) for d, w, a in (("r", right, "x"), ("d", below, "y")) for v in ("PX", "PY", "PZ")})
    cross = [F.col(f"_r{u}") * F.col(f"_d{v}") - F.col(f"_r{v}") * F.col(f"_d{u}") for u, v in (("PY", "PZ"), ("PZ", "PX"), ("PX", "PY"))]
    s = s.withColumn("area", F.sqrt(sum((k * k for k in cross[1:]), cross[0] * cross[0])))
    return s.withColumns({n: F.try_divide(k, F.col("area")) for n, k in zip(("nx", "ny", "nz"), cross, strict=True)}).drop(*[f"_{d}{v}" for d in "rd" for v in ("PX", "PY", "PZ")])


def surface_area(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str) -> DataFrame:
    """Area of each outline, corrected for the share of pixels whose area is known, and its equivalent diameter."""
    j = mask.join(pixel_areas(px, frame).select(*frame, "y", "x", "area"), [*frame, "y", "x"], "left")
    a = j.groupBy(*frame, outline).agg((F.sum("area") * F.count(F.lit(1)) / F.count("area")).alias("surface"), F.count("area").alias("known_px"), F.count(F.lit(1)).alias("px"))
    return a.withColumn("diameter", 2.0 * F.sqrt(F.col("surface") / F.pi()))


def metric_features(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, z: str, radius: int = RING_RADIUS, min_ring: int = MIN_RING_PX,
                    min_inside: int = MIN_INSIDE_PX) -> DataFrame:
    """The model's ``FEATURES`` of each outline, in their order, all from the depth map: percentiles below the road, shares past 10 and 25 mm, plane noise, camera distance, area,
    diameter, ratios, turn of the surface against the road, and the share of the outline that has readings.

    ``px`` holds the camera point of each reading in mm as PX, PY, PZ. Normals are cross products of the steps to the neighbours; those of the ring, averaged, are the road's, and the
    angles inside are taken against it (0 where either is unknown). The area is scaled up for pixels without a known one. Outlines without enough road or readings drop out.
    """
    key = [*frame, outline]
    d = deviation(pixel_areas(px, frame), mask, frame, outline, z, radius, min_ring)
    ring, dev = F.col("ring") & F.col(z).isNotNull(), F.when(F.col("inside"), F.col("dev"))
    area = F.when(dev.isNotNull(), F.col("area"))
    f = d.groupBy(*key).agg(F.percentile(dev, F.array(*[F.lit(p) for p in (0.5, 0.75, 0.9, 0.95, 0.99)])).alias("_q"), F.avg(dev).alias("mf_mean_mm"),
                            F.avg(F.when(dev > 10, 1.0).when(dev.isNotNull(), 0.0)).alias("mf_frac_gt10"), F.avg(F.when(dev > 25, 1.0).when(dev.isNotNull(), 0.0)).alias("mf_frac_gt25"),
                            F.first("rms").alias("mf_plane_rms_mm"), F.percentile(F.when(ring, F.col(z)), F.lit(0.5)).alias("mf_cam_dist_mm"), F.count(dev).alias("_n"),
                            (F.sum(area) / F.count(area)).alias("_area"), *[F.avg(F.when(ring, F.col(v))).alias(f"_{v}") for v in ("nx", "ny", "nz")])
    f = f.where(F.col("_n") >= min_inside).join(mask.groupBy(*key).agg(F.count(F.lit(1)).alias("_px")), key)
    size = F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + F.col("_nz") * F.col("_nz"))
    road = f.withColumn("_len", size).where("_len > 1e-9").select(*key, "_nx", "_ny", "_nz", "_len")
    turn = F.degrees(F.acos(clip((F.col("nx") * F.col("_nx") + F.col("ny") * F.col("_ny") + F.col("nz") * F.col("_nz")) / F.col("_len"), -1.0, 1.0)))
    turned = d.where("inside AND dev IS NOT NULL AND nx IS NOT NULL").join(road, key).withColumn("_a", turn).groupBy(*key).agg(F.avg("_a").alias("_turn"), F.percentile("_a", F.lit(0.9)).alias("_turn90"))
    f = f.join(turned, key, "left").withColumns({n: F.col("_q")[i] for i, n in enumerate(("mf_p50_mm", "mf_p75_mm", "mf_p90_mm", "mf_p95_mm", "mf_max_mm"))})
    f = f.withColumns({"mf_area_cm2": F.col("_area") * F.col("_px") / 100.0, "mf_normal_dev_mean": F.coalesce("_turn", F.lit(0.0)), "mf_normal_dev_p90": F.coalesce("_turn90", F.lit(0.0)),
                       "mf_valid_frac": F.col("_n") / F.greatest("_px", F.lit(1))})
    f = f.withColumns({"mf_log_area_cm2": F.log(F.greatest("mf_area_cm2", F.lit(1e-3))), "mf_diam_mm": 2.0 * F.sqrt(F.col("mf_area_cm2") * 100.0 / F.pi()),
                       "mf_p90_over_dist": F.col("mf_p90_mm") / F.greatest("mf_cam_dist_mm", F.lit(1.0))})
    return f.withColumn("mf_p90_over_diam", F.col("mf_p90_mm") / F.greatest("mf_diam_mm", F.lit(1.0))).select(*key, *FEATURES)


def least_squares(df: DataFrame, group: Sequence[str], terms: Sequence[Column], target: Column) -> DataFrame:
    """Coefficients of ``target`` on several terms per group and the number of rows: sums of products in one aggregate, then elimination. Null where terms depend on each other."""
    k = len(terms)
    t = df.withColumns({**{f"_t{i}": c.cast("double") for i, c in enumerate(terms)}, "_y": target.cast("double")}).where(F.col("_y").isNotNull())
    sums = t.groupBy(*group).agg(products([F.col(f"_t{i}") for i in range(k)], F.col("_y")).alias("_m"), F.count(F.lit(1)).alias("n"))
    return sums.select(*group, "n", scaled("_m", k).alias("coef"))


def _value(coef: str, terms: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for i, t in enumerate(terms):
        out = out + F.col(coef)[i] * t
    return out


def trimmed_fit(df: DataFrame, group: Sequence[str], terms: Sequence[Column], target: Column, residual, rounds: int, k: float = 2.5) -> DataFrame:
    """Fit, drop rows whose residual exceeds ``k`` deviations of those kept, and fit again.

    Between rounds only coefficients and one deviation per group are kept; every round filters the original rows.
    Returns coef and sd per group, both of the last fit.
    """
    group, kept, out = list(group), df, None
    for _ in range(rounds):
        coef = least_squares(kept, group, terms, target).where(F.col("coef").isNotNull()).select(*group, "coef")
        sd = kept.join(coef, group).groupBy(*group).agg(F.stddev_pop(residual("coef")).alias("sd"))
        out = materialise(coef.join(sd, group), "trimmed_fit")
        kept = df.join(out, group).where(F.abs(residual("coef")) < k * F.col("sd")).drop("coef", "sd")
    return out


def inverse_plane_fit(df: DataFrame, group: Sequence[str], z: str, rounds: int = 3) -> DataFrame:
    """Road plane fitted in 1/z, exact for a pinhole camera, trimmed on the depth residual."""
    terms = [F.col("x").cast("double"), F.col("y").cast("double"), F.lit(1.0)]
    return trimmed_fit(df, group, terms, 1.0 / F.col(z), lambda c: F.col(z) - 1.0 / _value(c, terms), rounds)


def quadratic_road(df: DataFrame, group: Sequence[str], X: str, Z: str, Y: str, rounds: int = 4) -> DataFrame:
    """Gently curved road Y = q(X, Z) (mm, fitted in metres), trimmed; with the cosine that turns a height into a perpendicular depth."""
    x, z = F.col(X) / 1000.0, F.col(Z) / 1000.0
    terms = [x, z, F.lit(1.0), x * x, x * z, z * z]
    fit = trimmed_fit(df, group, terms, F.col(Y), lambda c: F.col(Y) - _value(c, terms), rounds)
    cosine = 1.0 / F.sqrt(1 + (F.col("coef")[0] / 1000) ** 2 + (F.col("coef")[1] / 1000) ** 2)
    return fit.withColumn("cosine", cosine).withColumn("road_sd", F.col("sd") * F.col("cosine"))


@F.pandas_udf(ArrayType(DoubleType()))
def _normal(cov: pd.Series) -> pd.Series:
    """Unit direction of least spread of a 3x3 covariance, pointing away from the camera."""
    def one(c):
        v = np.asarray(c, dtype=np.float64)
        if not np.isfinite(v).all():
            return None
        n = np.linalg.eigh(v.reshape(3, 3))[1][:, 0]
        return (n if n[2] > 0 else -n).tolist()
    return cov.map(one)


def plane_3d(df: DataFrame, group: Sequence[str], xyz: Sequence[str], rounds: int = 3, k: float = 2.5) -> DataFrame:
    """Total-least-squares plane through points, trimmed: centre, normal, spread and tilt in degrees."""
    group, kept, out = list(group), df, None
    for _ in range(rounds):
        cov = F.array(*[F.covar_pop(a, b) for a in xyz for b in xyz])
        fit = kept.groupBy(*group).agg(cov.alias("_c"), F.array(*[F.avg(a) for a in xyz]).alias("centre")).select(*group, "centre", _normal("_c").alias("normal"))
        off = sum(((F.col(a) - F.col("centre")[i]) * F.col("normal")[i] for i, a in enumerate(xyz)), F.lit(0.0))
        sd = kept.join(fit, group).groupBy(*group).agg(F.stddev_pop(off).alias("rms"))
        out = materialise(fit.join(sd, group), "plane_3d")
        kept = df.join(out, group).where(F.abs(off) < k * F.col("rms")).drop("centre", "normal", "rms")
    return out.withColumn("tilt_deg", F.degrees(F.acos(clip(F.col("normal")[2], -1.0, 1.0))))


def block_pool(px: DataFrame, frame: Sequence[str], z: str, block: int = 4, deep_mm: float = 15.0) -> DataFrame:
    """Mean reading per block of pixels and whether it lies deeper than the limit."""
    return px.where(F.col(z).isNotNull()).groupBy(*frame, F.floor(F.col("y") / block).alias("y"), F.floor(F.col("x") / block).alias("x")).agg(
        F.avg(z).alias("mean"), F.count(F.lit(1)).alias("n")).withColumn("deep", F.col("mean") > deep_mm)


def grid_components(cells: DataFrame, frame: Sequence[str], min_size: int = 1, keep: int | None = None) -> DataFrame:
    """Connected regions of 8-neighbouring cells: frame..., component (its smallest cell), size, largest first.

    Labels spread to neighbours and then jump to the label of their label, so a region settles in a number of rounds
    that grows with the logarithm of its length. Each round is written to the shared folder.
    """
    frame = list(frame)
    at = [*frame, "y", "x"]
    code = F.shiftleft(F.col("y"), 32) + F.col("x") + (1 << 31)                 # one number in the order of (y, x), so that the least label needs no sort
    lab = materialise(cells.select(*frame, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct().withColumn("c", code), "components")
    around = F.array(*[F.struct(F.lit(j).alias("dy"), F.lit(i).alias("dx")) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    while True:
        own = F.when((F.col("_o.dy") == 0) & (F.col("_o.dx") == 0), F.col("c"))
        sent = lab.withColumn("_o", F.explode(around)).select(*frame, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), "c", own.alias("_own"))
        step = sent.groupBy(*at).agg(F.min("c").alias("_low"), F.max("_own").alias("c")).where("c IS NOT NULL")
        roots = step.select(*frame, code.alias("_low"), F.col("_low").alias("_jump"))
        new = materialise(step.join(roots.hint("merge"), [*frame, "_low"], "left").select(                # cells grow with the table, whatever the planner estimates: never a broadcast
            *at, F.col("c").alias("_old"), F.least("_low", F.coalesce("_jump", "_low")).alias("c")), "components")
        if new.where("c <> _old").isEmpty():
            break
        lab = new.drop("_old")
    lab = lab.withColumn("c", F.struct(F.shiftright("c", 32).alias("y"), (F.col("c").bitwiseAND((1 << 32) - 1) - (1 << 31)).alias("x")))
    sizes = lab.groupBy(*frame, "c").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    rank = F.row_number().over(Window.partitionBy(*frame).orderBy(F.desc("size"), "c"))
    ranked = sizes.withColumn("rank", rank)
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


def component_count(cells: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Number of connected regions and their cells per frame."""
    return grid_components(cells, frame).groupBy(*frame).agg(F.count(F.lit(1)).alias("regions"), F.sum("size").alias("cells"))


def clustering_score(bright_share: Column, regions: Column) -> Column:
    """Glint score: a few compact bright regions read as reflections, none or very many do not."""
    cluster = (F.when((bright_share > 0.6) & (regions <= 3), 0.2).when(regions > 20, 0.1).when((regions <= 8) & (bright_share < 0.5), 0.9).otherwise(0.5))
    return F.when(bright_share < 0.02, 0.0).otherwise(clip(0.4 * F.least(F.lit(1.0), bright_share * 3.0) + 0.6 * cluster, 0.0, 1.0))


def stencil(px: DataFrame, frame: Sequence[str], z: str, weights: Sequence[Sequence[float]], name: str) -> DataFrame:
    """Weighted sum over the 3x3 neighbourhood; null at the border of the readings."""
    row = Window.partitionBy(*frame, "y").orderBy("x")
    col = Window.partitionBy(*frame, "x").orderBy("y")

    def neighbour(w, axis, step, v):
        shift = F.lag if step < 0 else F.lead
        return F.when(shift(axis).over(w) == F.col(axis) + step, shift(v).over(w)) if step else F.col(v)

    lines = px.withColumns({f"_s{j}": sum((float(weights[j][i + 1]) * neighbour(row, "x", i, z) for i in (-1, 0, 1) if weights[j][i + 1]), F.lit(0.0)) for j in range(3)})
    total = sum((neighbour(col, "y", j - 1, f"_s{j}") for j in range(3)), F.lit(0.0))
    return lines.withColumn(name, total).drop("_s0", "_s1", "_s2")


LAPLACE = ((0, 1, 0), (1, -4, 1), (0, 1, 0))


def laplacian_stats(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, v: str) -> DataFrame:
    """Variance of the Laplacian and mean brightness inside each outline: a smooth dark interior looks like a stain."""
    lap = stencil(px, frame, v, LAPLACE, "_lap").select(*frame, "y", "x", "_lap", F.col(v).alias("_v"))
    return mask.join(lap, [*frame, "y", "x"]).groupBy(*frame, outline).agg(F.var_pop("_lap").alias("lap_var"), F.avg("_v").alias("brightness"))


def dense(px: DataFrame, frame: Sequence[str], z: str) -> DataFrame:
    """Every position between the least and largest row and column of each frame, with its reading or null."""
    frame = list(frame)
    lim = px.groupBy(*frame).agg(*[f(v).alias(f"_{v}{i}") for v in ("x", "y") for i, f in ((0, F.min), (1, F.max))])
    grid = lim.select(*frame, "_x0", "_x1", F.explode(F.sequence("_y0", "_y1")).alias("y")).select(*frame, "y", F.explode(F.sequence("_x0", "_x1")).alias("x"))
    return grid.join(px.select(*frame, "y", "x", F.col(z).cast("double").alias(z)), [*frame, "y", "x"], "left")


def along(px: DataFrame, frame: Sequence[str], line: str, axis: str, sums: dict[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """Weighted sums over the neighbours of each position of a dense frame along one image row or column.

    ``sums`` maps a new column to a column and its weights, the middle one on the position itself; beyond its ends a line is mirrored about its last position. An
    image line is one array, so nothing larger is held.
    """
    names = sorted({v for v, _ in sums.values()})
    lines = px.groupBy(*frame, line).agg(F.sort_array(F.collect_list(F.struct(axis, *names))).alias("_l"))
    shape = ", ".join([f"`{axis}` {px.schema[axis].dataType.simpleString()}", *[f"`{n}` double" for n in sums]])
    made = lines.select(*frame, line, line_sums(axis, sums, f"array<struct<{shape}>>")("_l").alias("_l"))
    return made.select(*frame, line, F.explode("_l").alias("_s")).select(*frame, line, "_s.*")


def few_at_a_time(lines: pa.Array, most: int = 200_000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole lines of about ``most`` positions, each as (lines, length of each line, first position and length of its line for every position)."""
    sizes = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in slices(sizes.tolist(), most):
        n = sizes[lo:hi]
        yield lines[lo:hi], n, np.repeat(np.cumsum(n) - n, n), np.repeat(n, n)


def as_lines(n: np.ndarray, columns: Mapping[str, pa.Array]) -> pa.Array:
    """Columns over all positions as one array of structs per line."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def line_sums(axis: str, sums: Mapping[str, tuple[str, Sequence[float]]], returns: str):
    """Column function of ``along``: the sums over the lines of an Arrow batch, in the order of the weights; null where a summand is null."""
    @F.arrow_udf(returns)
    def total(lines: pa.Array) -> pa.Array:
        out = []
        for part, n, start, length in few_at_a_time(lines):
            flat = part.flatten()
            fields = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
            i, turn, made = np.arange(len(flat)) - start, np.maximum(2 * (length - 1), 1), {axis: fields[axis]}
            for name, (v, weights) in sums.items():
                x, there = fields[v].to_numpy(zero_copy_only=False).astype(np.float64), fields[v].is_valid().to_numpy(zero_copy_only=False)
                value, known = None, np.ones(len(flat), dtype=bool)
                for k, w in enumerate(weights):
                    if w:
                        spot = (i + (k - len(weights) // 2)) % turn
                        at = start + np.minimum(spot, np.where(length > 1, turn - spot, 0))
                        value, known = float(w) * x[at] if value is None else value + float(w) * x[at], known & there[at]
                made[name] = pa.array(value, mask=~known)
            out.append(as_lines(n, made))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([(axis, lines.type.value_type.field(axis).type), *[(k, pa.float64()) for k in sums]])))

    return total


def gaussian(size: int) -> list[float]:
    """Weights of a Gaussian of so many pixels, with the deviation that goes with the size."""
    sd = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sd * sd)) for i in range(size)]
    return [w / sum(raw) for w in raw]


def smooth_gradient(px: DataFrame, frame: Sequence[str], z: str, size: int = BLUR) -> DataFrame:
    """frame..., y, x, gx, gy: Sobel slopes of the readings after a Gaussian blur of ``size`` pixels, at every position of the frame.

    Blur and slopes are separable: along rows, along columns, along rows again. Missing readings have no weight in the blur; a position without any reading in reach has no slope.
    """
    frame, blur = list(frame), gaussian(size)
    d = dense(px, frame, z).withColumns({"_v": F.coalesce(F.col(z), F.lit(0.0)), "_w": F.col(z).isNotNull().cast("double")})
    d = along(d, frame, "y", "x", {"_v1": ("_v", blur), "_w1": ("_w", blur)})
    d = along(d, frame, "x", "y", {"_v2": ("_v1", blur), "_w2": ("_w1", blur)}).select(*frame, "y", "x", F.when(F.col("_w2") > 1e-12, F.col("_v2") / F.col("_w2")).alias("_s"))
    d = along(d, frame, "x", "y", {"_soft": ("_s", (1, 2, 1)), "_step": ("_s", (-1, 0, 1))})
    return along(d, frame, "y", "x", {"gx": ("_soft", (-1, 0, 1)), "gy": ("_step", (1, 2, 1))})


def surface_normals(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, z: str, radius: int = WALL_RADIUS, size: int = BLUR, min_road: int = MIN_ROAD_NORMALS,
                    min_rim: int = MIN_RIM_NORMALS) -> DataFrame:
    """Angle between the surface along the rim of each outline and the mean road normal: mean, max, sd and p90 in degrees.

    Readings are scaled to 0-1 within the frame and blurred over ``size`` pixels, and borders are mirrored, so the rim at the edge of an image counts too. Outlines with less than
    ``min_road`` positions outside or ``min_rim`` on the rim, or without a mean normal, drop out.
    """
    key = [*frame, outline]
    known = materialise(normalise(px.select(*frame, "y", "x", z), frame, z, "_z").select(*frame, "y", "x", "_z"), "scaled")
    mask = materialise(mask.select(*key, "y", "x"), "outlines")
    g = smooth_gradient(known, frame, "_z", size).where("gx IS NOT NULL AND gy IS NOT NULL")
    length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1.0)
    n = g.select(*frame, "y", "x", (-F.col("gx") / length).alias("nx"), (-F.col("gy") / length).alias("ny"), (1.0 / length).alias("nz"))
    n = materialise(n, "normals")
    total = n.groupBy(*frame).agg(*[F.sum(v).alias(f"_{v}") for v in ("nx", "ny", "nz")], F.count(F.lit(1)).alias("_all"))
    own = n.join(mask, [*frame, "y", "x"]).groupBy(*key).agg(*[F.sum(v).alias(f"_o{v}") for v in ("nx", "ny", "nz")], F.count(F.lit(1)).alias("_own"))
    ref = own.join(total, list(frame)).where(F.col("_all") - F.col("_own") >= min_road)                # road = everything outside the outline
    parts = [(F.col(f"_{v}") - F.col(f"_o{v}")) / (F.col("_all") - F.col("_own")) for v in ("nx", "ny", "nz")]
    length = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    ref = ref.withColumn("_len", length).where("_len >= 1e-8").select(*key, *[(p / F.col("_len")).alias(f"r{i}") for i, p in enumerate(parts)])
    rim = region(n, mask, frame, outline, radius).where("ring").join(ref, key)
    angle = F.degrees(F.acos(clip(F.col("nx") * F.col("r0") + F.col("ny") * F.col("r1") + F.col("nz") * F.col("r2"), -1.0, 1.0)))
    out = rim.withColumn("_a", angle).groupBy(*key).agg(F.avg("_a").alias("mean_normal_deviation"), F.max("_a").alias("max_normal_deviation"),
                                                        F.stddev_pop("_a").alias("std_normal_deviation"), F.percentile("_a", F.lit(0.9)).alias("p90_normal_deviation"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") >= min_rim).drop("_n")


def inside_vs_ring(r: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Mean and deviation of a value inside each outline and on its ring."""
    inner, outer = F.when(F.col("inside"), F.col(value)), F.when(F.col("ring"), F.col(value))
    return r.groupBy(*key).agg(F.avg(inner).alias("inside_mean"), F.stddev_pop(inner).alias("inside_sd"), F.avg(outer).alias("ring_mean"),
                               F.count(inner).alias("inside_px"), F.count(outer).alias("ring_px"))


def falling(x: Column, full: float, none: float) -> Column:
    """1 at ``full``, 0 at ``none``, straight between."""
    return clip(1.0 - (x - full) / (none - full), 0.0, 1.0)


def edge_cue(inside: Column, ring: Column, ring_px: Column) -> Column:
    """Water shows few edges: share of edge pixels inside, absolute and against the road."""
    own = falling(inside, 0.0, 0.20)
    return 0.5 * own + 0.5 * F.when((ring_px > 10) & (ring > 0.001), falling(inside / ring, 0.3, 1.2)).otherwise(own)


def gradient_cue(inside: Column, ring: Column, ring_px: Column) -> Column:
    """Water has weak gradients, absolute and against the road."""
    own = falling(inside, 15.0, 120.0)
    return 0.5 * own + 0.5 * F.when((ring_px > 10) & (ring > 0.1), falling(inside / ring, 0.4, 1.5)).otherwise(own)


def color_cue(blue_ratio: Column, inside: Column, ring: Column) -> Column:
    """Bluish, or brighter than the road."""
    blue = clip((blue_ratio - 0.30) / 0.10, 0.0, 1.0)
    bright = F.coalesce(F.when(ring > 0, clip((inside / ring - 1.0) / 0.4, 0.0, 1.0)), F.lit(0.0))
    return clip(F.greatest(blue, bright) * 0.6 + F.least(blue, bright) * 0.4, 0.0, 1.0)


def saturation_cue(mean_sat: Column, sd_sat: Column, mean_val: Column) -> Column:
    """Low, even saturation on a surface that is not simply dark."""
    return clip((0.5 * falling(mean_sat, 0.0, 80.0) + 0.5 * falling(sd_sat, 0.0, 50.0)) * clip((mean_val - 80) / 100.0, 0.3, 1.0), 0.0, 1.0)


def prior_cue(inside: Column, ring: Column) -> Column:
    """A learned water map: its level inside and its step against the road."""
    own = clip(inside, 0.0, 1.0)
    return 0.5 * own + 0.5 * F.when(ring.isNotNull(), clip(0.5 + inside - ring, 0.0, 1.0)).otherwise(own)


def residual_cue(inside: Column, ring: Column) -> Column:
    """Non-diffuse energy against the road; the scale runs from 0.85 to 1.25."""
    return F.when(ring > 1e-6, clip((inside / ring - 0.85) / 0.40, 0.0, 1.0)).otherwise(0.0)


def inconsistency_cue(max_curv: Column, mean_curv: Column, high_share: Column, contrast: Column) -> Column:
    """The rim says crater while the depth inside says flat."""
    rim = F.least(F.lit(1.0), (max_curv * 0.4 + mean_curv * 5.0 + high_share) / 3.0)
    return clip(rim - F.least(F.lit(1.0), contrast / 0.2), 0.0, 1.0)


def depth_profile(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, z: str, slices: int = 8) -> DataFrame:
    """Bowl depth from cuts through the centroid: a parabola through the road outside is read off at the centre.

    Outlines whose centre has no reading have no bowl depth, those without a cut of six samples have nulls. The sample positions of all cuts are an exploded table that meets the pixels by position.
    """
    key = [*frame, outline]
    n = normalise(px, frame, z).select(*frame, "y", "x", "zn")
    mid = boxes(mask, key).join(mask.groupBy(*key).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy")), key)
    reach = (F.greatest("height", "width") * 1.5).cast("int")
    angles = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(math.cos(math.pi * i / slices)).alias("co"), F.lit(math.sin(math.pi * i / slices)).alias("si")) for i in range(slices)])
    pts = (mid.select(*key, "_cx", "_cy", F.explode(F.sequence(-reach, reach)).alias("t")).withColumn("g", F.explode(angles))
           .select(*key, "t", "g.cut", F.round(F.col("_cx") + F.col("t") * F.col("g.co"), 9).cast("int").alias("x"), F.round(F.col("_cy") + F.col("t") * F.col("g.si"), 9).cast("int").alias("y")))
    here = pts.join(n, [*frame, "y", "x"]).join(mask.select(*key, "y", "x", F.lit(True).alias("_in")), [*key, "y", "x"], "left").where("_in IS NULL")
    t = F.col("t").cast("double")
    fit = plane_fit(here.withColumns({"t": t, "t2": t * t}), [*key, "cut"], "zn", "t2", "t").where("n >= 6 AND a IS NOT NULL")
    centre = mid.select(*key, F.col("_cx").cast("int").alias("x"), F.col("_cy").cast("int").alias("y")).join(n, [*frame, "y", "x"]).select(*key, F.col("zn").alias("_c"))
    cut = fit.join(centre, key, "left").withColumn("_bowl", F.abs(F.col("c") - F.col("_c")))
    out = cut.groupBy(*key).agg(F.avg("_bowl").alias("mean_bowl_depth"), F.max("_bowl").alias("max_bowl_depth"), F.stddev_pop("_bowl").alias("std_bowl_depth"),
                                F.avg(F.abs("a")).alias("mean_road_curvature"), F.var_pop(F.abs(F.col("b"))).alias("slope_variance"))
    return mid.select(*key).join(out, key, "left")


def slice_lines(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, z: str) -> DataFrame:
    """The image row through each centroid, 0.8 widths beyond the outline on both sides: at (position from the left end), in_mask and depth (0-1 in the frame)."""
    key = [*frame, outline]
    n = normalise(px, frame, z).select(*frame, "y", "x", F.col("zn").alias("depth"))
    b = boxes(mask, key).join(mask.groupBy(*key).agg(F.avg("y").cast("int").alias("y")), key)
    margin = (F.col("width") * 0.8).cast("int")
    row = (b.select(*key, "y", F.greatest(F.lit(0), F.col("x0") - margin).alias("_from"), (F.col("x1") + margin).alias("_to")).join(n, [*frame, "y"])
           .where(F.col("x").between(F.col("_from"), F.col("_to"))))
    row = row.join(mask.select(*key, "y", "x", F.lit(True).alias("_in")), [*key, "y", "x"], "left")
    return row.select(*key, (F.col("x") - F.col("_from")).alias("at"), F.coalesce("_in", F.lit(False)).alias("in_mask"), "depth")


def parabola(df: DataFrame, key: Sequence[str], name: str, least: int) -> DataFrame:
    """key, <name>2, <name>1, <name>0: a parabola depth(at) per key; keys with fewer than ``least`` points, or without one, drop out."""
    at = F.col("at").cast("double")
    fit = plane_fit(df.withColumns({"_t1": at, "_t2": at * at}), key, "depth", "_t2", "_t1").where((F.col("n") >= least) & F.col("a").isNotNull())
    return fit.select(*key, F.col("a").alias(f"{name}2"), F.col("b").alias(f"{name}1"), F.col("c").alias(f"{name}0"))


def depth_slice(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, z: str, facts: DataFrame | None = None) -> DataFrame:
    """The cut through each outline, one row per sample: at, in_mask, depth, road (a parabola through the samples outside) and predicted.

    Where no parabola fits outside, the road is the mean of the samples there. ``facts`` holds wet and severity per outline. Under water the floor is predicted: a parabola through the
    wall, the outer fifth of the outline on either side with five samples of road, where it opens upwards; else one as deep as the severity allows for the width. Neither rises above the
    road nor, inside, above the reading. Dry outlines, those without facts, and those with ten samples or fewer inside keep the reading.
    """
    key = [*frame, outline]
    row = slice_lines(px, mask, frame, outline, z)
    at = F.col("at").cast("double")
    inner = F.when(F.col("in_mask"), F.col("at"))
    lim = row.groupBy(*key).agg(F.min(inner).alias("_a"), F.max(inner).alias("_b"), F.count(inner).alias("_n"), F.avg(F.when(~F.col("in_mask"), F.col("depth"))).alias("_mean"))
    row = row.join(lim, key).join(parabola(row.where("NOT in_mask AND depth IS NOT NULL"), key, "r", ROAD_SAMPLES), key, "left")
    row = row.withColumn("road", F.coalesce(F.col("r2") * at * at + F.col("r1") * at + F.col("r0"), F.col("_mean")))
    if facts is None:
        return row.select(*key, "at", "in_mask", "depth", "road", F.col("depth").alias("predicted"))
    row = row.join(facts.select(*key, F.coalesce("wet", F.lit(False)).alias("_wet"), F.col("severity").alias("_severity")), key, "left").withColumn("_under", F.coalesce("_wet", F.lit(False)) & (F.col("_n") > WALL_SAMPLES))
    width = F.col("_b") - F.col("_a")
    margin = F.greatest(F.lit(3), (width * 0.20).cast("int"))
    left, right = F.col("at").between(F.col("_a") - 5, F.col("_a") + margin - 1), F.col("at").between(F.col("_b") - margin, F.col("_b") + 4)
    wall = parabola(row.where(F.col("_under") & (left | right) & F.col("depth").isNotNull()), key, "w", 3)
    row = row.join(wall, key, "left")
    drop = width * F.when(F.col("_severity") == "Shallow", 0.0002).when(F.col("_severity") == "Deep", 0.0012).otherwise(0.0006)
    guess = 4 * drop / (width * width) * (at - (F.col("_a") + F.col("_b")) / 2.0) ** 2 + F.col("road") - drop
    floor = F.when(F.col("w2") >= FLAT_WALL, F.col("w2") * at * at + F.col("w1") * at + F.col("w0")).when(F.col("w2").isNotNull() & (width > 0), guess)
    floor = F.when(floor.isNotNull(), F.least(floor, "road", F.when(F.col("in_mask"), F.col("depth"))))
    return row.select(*key, "at", "in_mask", "depth", "road", F.coalesce(F.when(F.col("_under"), floor), "depth").alias("predicted"))


def slice_depths(slices: DataFrame, key: Sequence[str]) -> DataFrame:
    """bowl_depth and predicted_bowl_depth per outline: the largest gap to the road inside, of what is seen and of what is predicted."""
    gap = lambda v: F.coalesce(F.max(F.when(F.col("in_mask"), F.abs(F.col("road") - F.col(v)))), F.lit(0.0))
    return slices.groupBy(*key).agg(gap("depth").alias("bowl_depth"), gap("predicted").alias("predicted_bowl_depth"))


def submerge(dev: DataFrame, key: Sequence[str], fills: Sequence[float]) -> DataFrame:
    """Simulated water at several fill levels: deeper readings become the surface; depth reading, surface and wet share per fill."""
    p90 = dev.where("inside").groupBy(*key).agg(F.percentile("dev", F.lit(0.9)).alias("depth_mm"))
    j = dev.where("inside").join(p90, list(key)).withColumn("fill", F.explode(F.array(*[F.lit(f) for f in fills])))
    level = (1 - F.col("fill")) * F.col("depth_mm")
    return j.groupBy(*key, "fill").agg(F.max("depth_mm").alias("depth_mm"), F.max(level).alias("level_mm"), F.percentile(F.least("dev", level), F.lit(0.9)).alias("surface_reading_mm"),
                                       F.avg((F.col("dev") > level).cast("int")).alias("wet_share"))


def rasterise(outlines: DataFrame, frame: Sequence[str], outline: str, points: str) -> DataFrame:
    """Pixels whose centre lies inside each outline, by crossing parity.

    Every edge meets only the image rows it crosses; the sorted crossings of a row bound its inner runs. Centres
    exactly on an edge count on the left and top side only.
    """
    key = [*frame, outline]
    pts = F.col(points)
    edge = F.transform(pts, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.get(pts, (i + 1) % F.size(pts))["x"].alias("x1"), F.get(pts, (i + 1) % F.size(pts))["y"].alias("y1")))
    e = outlines.select(*key, F.explode(edge).alias("e")).select(*key, "e.*").where("y0 <> y1")
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = e.withColumns({"_a": F.ceil(lo).cast("int"), "_b": (F.ceil(hi) - 1).cast("int")}).where("_a <= _b").withColumn("y", F.explode(F.sequence("_a", "_b")))
    hits = rows.select(*key, "y", (F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    line = hits.groupBy(*key, "y").agg(F.sort_array(F.collect_list("x")).alias("xs"))     # a few crossings per image row
    runs = line.withColumn("_k", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2 - 1).cast("int")))).select(
        *key, "y", F.ceil(F.get("xs", F.col("_k") * 2)).cast("int").alias("_a"), (F.ceil(F.get("xs", F.col("_k") * 2 + 1)) - 1).cast("int").alias("_b"))
    return runs.where("_a <= _b").select(*key, "y", F.explode(F.sequence("_a", "_b")).alias("x"))


def mean_variance(dims: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Sample variance per dimension (d, v), averaged over the dimensions."""
    return dims.groupBy(*key, "d").agg(F.var_samp("v").alias("_var")).groupBy(*key).agg(F.avg("_var").alias(name))


def embedding_ratio(patches: DataFrame, frame: Sequence[str], outline: str, inside: str, vector: str, ring: int = RING_PATCHES, draws: int = MATCH_DRAWS) -> DataFrame:
    """Texture of each outline against the road around it: inside_variance, outside_variance (all other patches of the frame), ring_variance, ratio, dissimilarity (cosine distance of the
    means inside and outside), patches and ring_source.

    ``patches`` has one row per (frame, outline, y, x) with whether the patch lies inside. Variance over many patches is not comparable with variance over few, so ``ring_variance`` takes
    the patches within ``ring`` of the outline, drawn down to the number inside: the median over ``draws`` draws, each by the order of a hash. A ring of fewer than two patches gives way to
    the whole scene. Outlines with fewer than two patches inside or outside drop out, and a ring without variance has no ratio. Patches without a vector are left out.
    """
    key = [*frame, outline]
    p = patches.where(F.col(vector).isNotNull()).select(*key, "y", "x", F.coalesce(F.col(inside), F.lit(False)).alias("_in"), F.col(vector).alias("_v"))
    near = region(p.select(*key, "y", "x").withColumn("_o", F.col(outline)), p.where("_in").select(*key, "y", "x").withColumn("_o", F.col(outline)), key, "_o", ring).where("ring").select(*key, "y", "x", F.lit(True).alias("_ring"))
    p = p.join(near, [*key, "y", "x"], "left").withColumn("_ring", F.coalesce("_ring", F.lit(False)))
    n = p.groupBy(*key).agg(F.count_if("_in").alias("patches"), F.count_if(~F.col("_in")).alias("_out"), F.count_if("_ring").alias("_near")).where("patches >= 2 AND _out >= 2")
    n = n.withColumn("ring_source", F.when(F.col("_near") >= 2, "ring").otherwise("scene"))
    p = p.join(n, key).withColumn("_road", F.when(F.col("ring_source") == "ring", F.col("_ring")).otherwise(~F.col("_in")))
    p = materialise(p, "patches")
    dims = p.select(*key, "_in", F.posexplode("_v").alias("d", "v")).withColumn("v", F.col("v").cast("double"))
    side = dims.groupBy(*key, "d").agg(*[f(F.when(F.col("_in") == flag, F.col("v"))).alias(f"_{n}{s}") for s, flag in (("in", True), ("out", False)) for n, f in (("var", F.var_samp), ("mean", F.avg))])
    dot = F.try_divide(F.sum(F.col("_meanin") * F.col("_meanout")), F.sqrt(F.sum(F.col("_meanin") * F.col("_meanin")) * F.sum(F.col("_meanout") * F.col("_meanout"))))
    both = side.groupBy(*key).agg(F.avg("_varin").alias("inside_variance"), F.avg("_varout").alias("outside_variance"), (1.0 - dot).alias("dissimilarity"))
    road = p.where("_road").withColumn("_few", F.when(F.col("ring_source") == "ring", F.col("_near")).otherwise(F.col("_out")) <= F.col("patches"))
    road = road.withColumn("draw", F.explode(F.when(F.col("_few"), F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(draws)))))
    order = Window.partitionBy(*key, "draw").orderBy(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in (*key, "y", "x", "draw")])), "y", "x")
    drawn = road.withColumn("_rank", F.row_number().over(order)).where(F.col("_few") | (F.col("_rank") <= F.col("patches")))
    each = mean_variance(drawn.select(*key, "draw", F.posexplode("_v").alias("d", "v")).withColumn("v", F.col("v").cast("double")), [*key, "draw"], "_variance")
    matched = each.groupBy(*key).agg(F.percentile("_variance", F.lit(0.5)).alias("ring_variance"))
    out = n.select(*key, "patches", "ring_source").join(both, key).join(matched, key)
    return out.withColumn("ratio", F.when(F.col("ring_variance") > 1e-9, F.col("inside_variance") / F.col("ring_variance")))
