"""From a measured pothole to its danger: grade probabilities, wheel drop, rim curvature and the risk block."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from kerbline.functions import grading as D
from kerbline.operators.raster import as_lines, few_at_a_time
from kerbline.storage import materialise

# fixed values: tyre sizes as (id, rim in inches or null, section width mm, aspect ratio %); the bicycle rim is
# 622 mm at the bead seat.
TYRES = (("bicycle", None, 25.0, None), ("scooter", 10.0, 90.0, 90.0), ("auto_rickshaw", 8.0, 101.6, 100.0), ("motorcycle", 17.0, 120.0, 70.0),
         ("car", 15.0, 195.0, 65.0), ("suv", 17.0, 235.0, 65.0), ("truck", 22.5, 295.0, 80.0))
# fixed values: smoothing window of a contour as a share of its points, with its limits
CURVATURE_SHARE, CURVATURE_MIN, CURVATURE_MAX = 0.08, 5, 51


def tyre_radius(rim_in: float | None, width_mm: float, aspect: float | None) -> float:
    """Radius in mm from the size code."""
    diameter = 622.0 + 2.0 * width_mm if rim_in is None else rim_in * 25.4 + 2.0 * width_mm * aspect / 100.0
    return round(diameter / 2.0, 1)


def tyre_table(spark: SparkSession) -> DataFrame:
    """One row per tyre: its width and radius."""
    return spark.createDataFrame([(t, w, tyre_radius(rim, w, asp)) for t, rim, w, asp in TYRES], "tyre string, width_mm double, radius_mm double")


def cdf(value: Column, quantiles: Column) -> Column:
    """Share of a distribution below ``value``, from its evenly spaced quantiles by straight lines."""
    at = F.size(F.filter(quantiles, lambda q: q <= value)) - 1
    low, high = F.get(quantiles, at), F.get(quantiles, at + 1)
    inside = at + F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    return F.when(at < 0, 0.0).when(high.isNull(), 1.0).otherwise(inside / (F.size(quantiles) - 1))


def quantile_array(table: DataFrame, p: str = "p", q: str = "q") -> Column:
    """A quantile table (about a hundred rows) as one array, ready to grade any number of rows."""
    return table.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(p).alias("p"), F.col(q).alias("q")))), lambda s: s["q"])).scalar()


def with_depth_probabilities(df: DataFrame, depth: str, quantiles: Column) -> DataFrame:
    """Add ``depth_probs``: chance of each depth band (below 13, to 25, to 50, over 50 mm) given measured errors.

    A true depth is the prediction minus an error drawn from the measured distribution. The chance of a band follows
    exactly from the distribution function, so nothing is simulated.
    """
    q = df.withColumn("_q", quantiles)
    f = [cdf(F.col(depth) - edge, F.col("_q")) for edge in D.ASTM_DEPTH_MM]
    q = q.withColumns({f"_f{i}": e for i, e in enumerate(f)})
    probs = F.array(1.0 - F.col("_f0"), F.col("_f0") - F.col("_f1"), F.col("_f1") - F.col("_f2"), F.col("_f2"))
    return q.withColumn("depth_probs", probs).drop("_q", "_f0", "_f1", "_f2")


def with_width_probabilities(df: DataFrame, width: str, ratio_quantiles: Column) -> DataFrame:
    """Add ``width_probs``: chance of each width band (below 100, to 200, to 450, to 750, over 750 mm).

    A true width is the reading over a ratio drawn from the measured distribution.
    """
    q = df.withColumn("_q", ratio_quantiles)
    q = q.withColumns({f"_g{i}": 1.0 - cdf(F.col(width) / edge, F.col("_q")) for i, edge in enumerate(D.ASTM_WIDTH_MM)})
    g = [F.col(f"_g{i}") for i in range(4)]
    probs = F.array(g[0], g[1] - g[0], g[2] - g[1], g[3] - g[2], 1.0 - g[3])
    return q.withColumn("width_probs", probs).drop("_q", *[f"_g{i}" for i in range(4)])


def grade_2d(depth_probs: Column, width_probs: Column) -> Column:
    """Chance of (not rated, L, M, H) in the depth x width table; the two errors are independent, so the cells are products."""
    cells: dict[str, list[Column]] = {"L": [], "M": [], "H": []}
    for r in range(3):
        for k in range(3):
            cells[D.ASTM_TABLE[r][k]].append(depth_probs[r + 1] * width_probs[k + 1])
        cells["M" if r == 0 else "H"].append(depth_probs[r + 1] * width_probs[4])
    total = {g: sum(v[1:], v[0]) for g, v in cells.items()}
    return F.array(1.0 - total["L"] - total["M"] - total["H"], total["L"], total["M"], total["H"])


def investigatory_probability(depth_probs: Column, width_probs: Column | None = None) -> Column:
    """Chance of reaching the carriageway level: 50 mm deep and, where the width is known, 100 mm across."""
    return depth_probs[3] if width_probs is None else depth_probs[3] * F.coalesce(1.0 - width_probs[0], F.lit(1.0))


def wheel_drops(relief: DataFrame, key: Sequence[str], scale: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Worst fall of each tyre rolled through each outline, along the rows or the columns through its deepest point.

    ``relief``: key, y, x, r inside the outlines only (depth below the road, mm). ``scale``: key, mm_per_px. ``size``: frame
    width and height. An outline without a scale has a bound but no drop. The tyre rests on the highest surface across its width; beyond the outline the road is flat.
    A line is at most one image side long, so it travels as one array.
    """
    key = list(key)
    r = relief.withColumn("r", F.greatest("r", F.lit(0.0)))
    deep = r.groupBy(*key).agg(F.max(F.struct("r", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("d")).select(
        *key, F.col("d.r").alias("deepest_mm"), (-F.col("d.ny")).alias("_y"), (-F.col("d.nx")).alias("_x"))
    tyres = F.array(*[F.struct(F.lit(t).alias("tyre"), F.lit(w).alias("width_mm"), F.lit(tyre_radius(rim, w, asp)).alias("radius_mm")) for t, rim, w, asp in TYRES])
    rolls = (deep.join(scale, key, "left").withColumn("_t", F.explode(tyres)).select(*key, "deepest_mm", "_y", "_x", "mm_per_px", "_t.*")
             .withColumn("_half", F.floor(F.greatest(F.lit(1), F.bround(F.col("width_mm") / F.col("mm_per_px")).cast("int")) / 2).cast("int"))
             .withColumn("axis", F.explode(F.array(F.lit(0), F.lit(1)))))
    at, across, side = F.when(F.col("axis") == 0, F.col("y")), F.when(F.col("axis") == 0, F.col("x")), F.when(F.col("axis") == 0, F.lit(size[0])).otherwise(F.lit(size[1]))
    at, across = at.otherwise(F.col("x")), across.otherwise(F.col("y"))
    mid = F.when(F.col("axis") == 0, F.col("_x")).otherwise(F.col("_y"))
    band = r.join(rolls, key).withColumns({"_at": at, "_off": F.abs(across - mid)}).where(F.col("_off") <= F.col("_half"))
    wide = F.least(mid + F.col("_half"), side - 1) - F.greatest(mid - F.col("_half"), F.lit(0)) + 1
    per = [*key, "tyre", "radius_mm", "axis", "deepest_mm", "mm_per_px"]
    line = band.withColumn("_wide", wide).groupBy(*per, "_at").agg(F.when(F.count(F.lit(1)) == F.max("_wide"), F.min("r")).otherwise(0.0).alias("_d"))
    lines = line.groupBy(*per).agg(F.sort_array(F.collect_list(F.struct("_at", "_d"))).alias("_l"))
    lines = with_drop(lines.where("mm_per_px IS NOT NULL"), "_l", "mm_per_px", "radius_mm")
    best = F.max(F.struct("_drop", "axis")).alias("b")
    found = lines.groupBy(*key, "tyre").agg(best)
    base = rolls.where("axis = 0").select(*key, "tyre", F.col("mm_per_px").isNotNull().alias("_scaled"), F.least("deepest_mm", "radius_mm").alias("drop_bound_mm"))
    return base.join(found, [*key, "tyre"], "left").select(*key, "tyre", "drop_bound_mm", F.when(F.col("_scaled"), F.coalesce("b._drop", F.lit(0.0))).alias("drop_mm"), F.when(F.col("_scaled"), F.col("b.axis")).alias("profile_axis"))


def tyre_band(px: DataFrame, profile: Sequence[str], position: str, relief: str, half: int, name: str = "band") -> DataFrame:
    """Least depth within half a tyre's width of each position: the tyre rests on the highest surface under it."""
    w = Window.partitionBy(*profile).orderBy(position).rangeBetween(-half, half)
    return px.withColumn(name, F.min(relief).over(w))


def wheel_centre(px: DataFrame, profile: Sequence[str], position: str, height: str, step_mm: float, radius_mm: float) -> DataFrame:
    """Height of a wheel's centre over each point of a surface profile: as high as the surface under its circle requires.

    The road beyond the profile is flat. A profile is at most one image side long, so it travels as one array.
    """
    reach = -int(-radius_mm // step_mm)
    line = px.groupBy(*profile).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(height).alias("h")))).alias("l"),
                                    F.min(position).alias("_lo"), F.max(position).alias("_hi"))

    def lift(dx: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(radius_mm ** 2) - F.pow(dx * step_mm, F.lit(2.0)), F.lit(0.0)))

    def centre(p: Column, i: Column) -> Column:
        """Positions within reach are at most so many places away in the line."""
        first = F.greatest(i - reach, F.lit(0))
        near = F.filter(F.slice("l", first + 1, i + reach + 1 - first), lambda q: F.abs(q["p"] - p) <= reach)
        left, right = p - F.col("_lo") + 1, F.col("_hi") + 1 - p
        flat = F.greatest(F.when(left <= reach, lift(left)), F.when(right <= reach, lift(right)))
        return F.greatest(F.array_max(F.transform(near, lambda q: q["h"] + lift(q["p"] - p))), flat)

    out = line.withColumn("c", F.transform("l", lambda q, i: F.struct(q["p"].alias("p"), centre(q["p"], i).alias("c"))))
    return out.select(*profile, F.explode("c").alias("c")).select(*profile, F.col("c.p").alias(position), F.col("c.c").alias("centre_mm"))


def with_drop(lines: DataFrame, line: str, step: str, radius: str, name: str = "_drop") -> DataFrame:
    """Largest fall of a wheel centre over a line of (position, depth). Only positions below the road can lower it; gaps and both ends are flat road.

    The lift of the tyre at each distance is one table per line, and a position looks at what lies within the tyre's reach, so a line costs its length times the reach.
    """
    first = F.get(line, 0)["_at"]
    gaps = F.flatten(F.transform(line, lambda e, i: F.concat(F.array_repeat(F.lit(0.0), F.greatest(e["_at"] - F.coalesce(F.when(i > 0, F.get(line, i - 1)["_at"]), first - 1) - 1, F.lit(0)).cast("int")), F.array(e["_d"]))))
    reach = F.ceil(F.col(radius) / F.col(step)).cast("int")
    lifts = F.transform(F.sequence(F.lit(0), reach), lambda k: F.sqrt(F.greatest(F.col(radius) * F.col(radius) - F.pow(k * F.col(step), F.lit(2.0)), F.lit(0.0))))
    wide = lines.withColumns({"_dense": F.concat(F.array(F.lit(0.0)), gaps, F.array(F.lit(0.0))), "_lifts": lifts})

    def centre(p: Column) -> Column:
        low = F.greatest(p - F.size("_lifts") + 1, F.lit(0))
        near = F.slice("_dense", low + 1, F.least(p + F.size("_lifts"), F.size("_dense")) - low)
        return F.array_max(F.transform(near, lambda d, i: F.get("_lifts", F.abs(low + i - p)) - d))

    lowest = F.array_min(F.transform(F.sequence(F.lit(1), F.size("_dense") - 2), centre))
    return wide.withColumn(name, F.greatest(F.lit(0.0), F.col(radius) - lowest)).drop("_dense", "_lifts")


def hazard_block(df: DataFrame, drops: DataFrame, key: Sequence[str], depth: str, likelihood: Column, route: Column) -> DataFrame:
    """One nested record per pothole: wheel drops, chance of reaching the investigatory level, consequence, risk and response.

    ``df`` carries ``depth_probs`` of ``with_depth_probabilities``; its last entry is the chance of the 50 mm level.
    """
    key = list(key)
    tyres = drops.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("tyre", "drop_mm", "drop_bound_mm"))).alias("tyres"),
                                    F.max(F.when(F.col("tyre") == "car", F.col("drop_mm"))).alias("_car"))
    j = df.join(tyres, key, "left").withColumn("_p", investigatory_probability(F.col("depth_probs")))
    j = j.withColumn("_c", D.provisional_consequence(F.col("_p"), F.col("_car")))
    score = likelihood * F.col("_c")
    return j.select(*key, F.struct(F.bround(depth, 1).alias("depth_mm"), F.bround("_p", 3).alias("p_investigatory"), F.bround("_car", 1).alias("car_drop_mm"), F.col("_c").alias("consequence"),
                                   score.alias("score"), D.response_for(score, route).alias("response"), F.col("tyres").alias("tyres")).alias("hazard"))


@F.arrow_udf(ArrayType(StructType().add("sx", DoubleType()).add("sy", DoubleType())))
def smoothed(contours: pa.Array, halves: pa.Array) -> pa.Array:
    """Coordinates of closed contours under the weights of a local cubic over m points to either side; null where one of them is null."""
    out, done = [], 0
    for part, n, start, length in few_at_a_time(contours):
        each = halves[done:done + len(part)].to_numpy(zero_copy_only=False).astype(np.int64)
        done, m, flat = done + len(part), np.repeat(each, n), part.flatten()
        i, total, made = np.arange(len(flat)) - start, (2 * m - 1) * (2 * m + 1) * (2 * m + 3), {}
        for name in ("x", "y"):
            v = flat.flatten()[flat.type.get_field_index(name)]
            x, there = v.to_numpy(zero_copy_only=False).astype(np.float64), v.is_valid().to_numpy(zero_copy_only=False)
            value, known = np.zeros(len(flat)), np.ones(len(flat), dtype=bool)
            for step in range(-int(each.max()), int(each.max()) + 1):
                near = np.flatnonzero(m >= abs(step))
                at = start[near] + (i[near] + step) % length[near]
                value[near] += 3.0 * (3 * m[near] * m[near] + 3 * m[near] - 1 - 5 * step * step) / total[near] * x[at]
                known[near] &= there[at]
            made[f"s{name}"] = pa.array(value, mask=~known)
        out.append(as_lines(n, made))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("sx", pa.float64()), ("sy", pa.float64())])))


def curvature(contours: DataFrame, key: Sequence[str], order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Rim curvature of closed outlines: smoothed coordinates, signed curvature, its summary, sign changes and entropy; length of the closed line and elongation of its box.

    A contour is bounded by the image's perimeter and travels as one array. The smoothing window is a fixed share of
    its length (odd, 5 to 51), the weights are those of a local cubic.
    """
    key = list(key)
    p = contours.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    p = p.withColumn("n", F.size("p")).where("n >= 15")
    win = F.least(F.bround(F.col("n") * CURVATURE_SHARE).cast("int"), F.col("n") - 1, F.lit(CURVATURE_MAX))
    p = p.withColumn("m", F.floor((F.greatest(win - (win % 2 == 0).cast("int"), F.lit(CURVATURE_MIN)) - 1) / 2).cast("int"))
    p, n = materialise(p, "contours"), F.col("n")
    pts = F.col("p")
    steps = F.transform(pts, lambda a, i: F.sqrt((F.get(pts, (i + 1) % n)["x"] - a["x"]) ** 2 + (F.get(pts, (i + 1) % n)["y"] - a["y"]) ** 2))
    side = lambda v: F.array_max(F.transform(pts, lambda a: a[v])) - F.array_min(F.transform(pts, lambda a: a[v])) + 1
    box = p.select(*key, F.aggregate(steps, F.lit(0.0), lambda s, d: s + d).alias("contour_length"), (side("x") / F.greatest(side("y"), F.lit(1.0))).alias("contour_elongation"))
    rows = p.select(*key, "n", smoothed("p", "m").alias("_s")).select(*key, "n", F.posexplode("_s").alias("i", "_s")).select(*key, "n", "i", "_s.sx", "_s.sy")
    w = Window.partitionBy(*key).orderBy("i")

    def gradient(v):
        """Central difference, one-sided at both ends."""
        after, before = F.lead(v).over(w), F.lag(v).over(w)
        return F.coalesce((after - before) / 2, after - F.col(v), F.col(v) - before)

    rows = rows.withColumns({"dx": gradient("sx"), "dy": gradient("sy")})
    rows = rows.withColumns({"ax": gradient("dx"), "ay": gradient("dy")})
    kappa = (F.col("dx") * F.col("ay") - F.col("dy") * F.col("ax")) / F.greatest(F.pow(F.col("dx") ** 2 + F.col("dy") ** 2, F.lit(1.5)), F.lit(1e-10))
    rows = materialise(rows.select(*key, "n", "i", kappa.alias("s")).withColumns({"a": F.abs("s"), "prev": F.lag("s").over(w)}), "curvatures")
    s = rows.groupBy(*key).agg(F.max("n").alias("points"), F.max("a").alias("max_curvature"), F.avg("a").alias("mean_curvature"), F.stddev_pop("a").alias("std_curvature"),
                               F.percentile("a", F.lit(0.9)).alias("p90_curvature"), F.min("a").alias("_lo"), F.avg((F.col("s") < 0).cast("int")).alias("concave_fraction"),
                               F.count_if(F.signum("s") != F.signum("prev")).alias("curvature_sign_changes"))
    j = rows.select(*key, "a").join(s, key)
    span = F.col("max_curvature") - F.col("_lo")
    sharp = (F.col("a") > F.col("mean_curvature") + F.col("std_curvature")).cast("int")
    bins = j.withColumn("_b", F.coalesce(F.least(F.floor(F.try_divide(F.col("a") - F.col("_lo"), span) * 30), F.lit(29)), F.lit(0))).groupBy(*key, "_b").agg(
        (F.count(F.lit(1)) / F.max("points")).alias("_p"), F.sum(sharp).alias("_sharp"), F.count(sharp).alias("_known"))
    summed = bins.groupBy(*key).agg((F.sum("_sharp") / F.sum("_known")).alias("high_curvature_fraction"), (-F.sum(F.col("_p") * F.log(F.col("_p") + 1e-12))).alias("curvature_entropy"))
    return s.drop("_lo").join(summed, key).join(box, key)
