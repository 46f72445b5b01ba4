"""Depth of a defect whose floor is hidden under water: a bowl fitted by consensus to the dry wall and the rim, read off under the water.

Relief is depth below the road in mm, positive downwards. Everything is sums, joins and windows keyed by the outline: an outline's pixels are bounded by its
image, and no step collects them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.linear import products, solved_in_batches
from kerbline.operators.raster import region
from kerbline.storage import materialise

# fixed values: rim of road that anchors a fit (px), least dry wall (px), largest plausible relief (mm), degrees tried in turn, agreement with a fit (mm), samples, fits that are refined
ANCHOR_PX, MIN_WALL_PX, MAX_DEPTH_MM, CASCADE, INLIER_MM, HYPOTHESES, TOP = 5, 30, 300.0, (3, 4, 2), 8.0, 300, 10


def powers(degree: int) -> list[tuple[int, int]]:
    """Exponents of u and v of all terms of a surface, lowest degree first."""
    return [(n - j, j) for n in range(degree + 1) for j in range(n + 1)]


def with_terms(points: DataFrame, degree: int) -> DataFrame:
    """Points (u, v) with the terms of a surface as columns t0, t1, ..., so that each surface is a short sum."""
    out = {}
    for k, (i, j) in enumerate(powers(degree)):
        term = F.lit(1.0)
        for factor in ["u"] * i + ["v"] * j:
            term = term * F.col(factor)
        out[f"t{k}"] = term
    return points.withColumns(out)


def spread(fits: DataFrame, degree: int) -> DataFrame:
    """The coefficients as columns c0, c1, ..."""
    return fits.withColumns({f"c{i}": F.get("coef", F.lit(i)) for i in range(len(powers(degree)))}).drop("coef")


def surface(degree: int) -> Column:
    """Value of a surface at a point that has its terms."""
    total = F.lit(0.0)
    for i in range(len(powers(degree))):
        total = total + F.col(f"c{i}") * F.col(f"t{i}")
    return total


def normal_equations(points: DataFrame, key: Sequence[str], degree: int) -> DataFrame:
    """key, coef and n: least squares over the points (z and terms) of each key, from sums of products in one aggregate."""
    k = len(powers(degree))
    sums = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), products([F.col(f"t{i}") for i in range(k)], F.col("z")).alias("_m"))
    return sums.select(*key, "n", solved_in_batches(F.col("_m"), k).alias("coef"))


def samples(points: DataFrame, key: Sequence[str], degree: int, hypotheses: int) -> DataFrame:
    """key, sample, coef: surfaces through as many points as they have terms.

    The points of an outline are shuffled by a hash as often as needed and each shuffle is dealt into runs of that many points; so samples cost rows in proportion to their number, not to the
    outline's pixels times it.
    """
    k = len(powers(degree))
    many = points.where(F.col("n_points") >= 3 * k).withColumn("_round", F.explode(F.sequence(F.lit(1), F.ceil(F.lit(float(hypotheses)) / F.floor(F.col("n_points") / k)).cast("int"))))
    order = Window.partitionBy(*key, "_round").orderBy(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in (*key, "y", "x", "_round")])), "y", "x")
    dealt = many.withColumn("_at", F.row_number().over(order) - 1).withColumn("_run", F.floor(F.col("_at") / k))
    runs = F.floor(F.col("n_points") / k)
    dealt = dealt.where(F.col("_run") < runs).withColumn("sample", (F.col("_round") - 1) * runs + F.col("_run")).where(F.col("sample") < hypotheses)
    row = F.array(*[F.col(f"t{i}") for i in range(k)], F.col("z"))
    met = dealt.groupBy(*key, "sample").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", row.alias("row")))), lambda s: s["row"]).alias("_m"))
    return met.select(*key, "sample", solved_in_batches(F.col("_m"), k).alias("coef")).where("coef IS NOT NULL")


def consensus(points: DataFrame, wet: DataFrame, key: Sequence[str], degree: int, hypotheses: int, inlier_mm: float, top: int) -> DataFrame:
    """key, coef: of the ``top`` samples with most inliers, refitted twice on them, the one with most inliers that is a bowl under the water."""
    key, k = list(key), len(powers(degree))
    points = materialise(with_terms(points, degree), "bowl_terms")
    near = lambda fits: points.join(spread(fits, degree), key).where(F.abs(surface(degree) - F.col("z")) < inlier_mm)
    some = samples(points, key, degree, hypotheses)
    some = materialise(some.where(quadric_bowl("coef")) if degree == 2 else some, "bowl_samples")
    counts = near(some).groupBy(*key, "sample").agg(F.count(F.lit(1)).alias("_inliers"))
    best = Window.partitionBy(*key).orderBy(F.desc("_inliers"), "sample")
    fits = some.join(counts.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top), [*key, "sample"]).select(*key, "sample", "coef")
    for _ in range(2):
        fits = normal_equations(near(fits), [*key, "sample"], degree).where((F.col("n") >= 3 * k) & F.col("coef").isNotNull())
        fits = materialise(fits, "bowl_refits")
    good = fits.where(quadric_bowl("coef")) if degree == 2 else fits.join(bowls(fits, wet, key, degree), [*key, "sample"], "left_semi")
    first = Window.partitionBy(*key).orderBy(F.desc("n"), "sample")
    return good.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select(*key, "coef")


def quadric_bowl(coef: str) -> Column:
    """Relief grows downwards: the quadratic part must be negative definite."""
    at = powers(2)
    xx, xy, yy = (F.get(coef, F.lit(at.index(p))) for p in ((2, 0), (1, 1), (0, 2)))
    return (xx < 0) & (yy < 0) & (4 * xx * yy - xy * xy > 0)


def bowls(fits: DataFrame, wet: DataFrame, key: Sequence[str], degree: int) -> DataFrame:
    """The fits whose deepest point under the water is inside it, below the waterline, and curves down in every direction."""
    under = with_terms(wet, degree).join(spread(fits, degree), list(key)).withColumn("_f", surface(degree))
    at, coef = [*key, "sample"], [f"c{i}" for i in range(len(powers(degree)))]
    deepest = under.groupBy(*at, "scale", "level", *coef).agg(F.count(F.lit(1)).alias("_px"), F.max_by(F.struct("u", "v", "edge", "_f"), F.struct(F.col("_f"), -F.col("y"), -F.col("x"))).alias("_d"))
    deepest = deepest.where((F.col("_px") >= 5) & ~F.col("_d.edge") & (F.col("_d._f") > F.col("level") + 0.5))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = deepest.withColumn("_s", F.explode(steps)).select(*at, *coef, "_s.*", *[(F.col(f"_d.{c}") + F.col(f"_s.{k}") * 2.0 / F.col("scale")).alias(c) for c, k in (("u", "i"), ("v", "j"))])
    seen = with_terms(around, degree).select(*at, "i", "j", surface(degree).alias("_f")).groupBy(*at).agg(*[F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("_f"))).alias(n) for n, i, j in (
        ("m", 0, 0), ("r", 1, 0), ("l", -1, 0), ("t", 0, 1), ("b", 0, -1), ("rt", 1, 1), ("rb", 1, -1), ("lt", -1, 1), ("lb", -1, -1))])
    bent = seen.select(*at, F.expr("r - 2 * m + l").alias("xx"), F.expr("t - 2 * m + b").alias("yy"), F.expr("(rt - rb - lt + lb) / 4").alias("xy"))
    return bent.where("xx < 0 AND yy < 0 AND xx * yy - xy * xy > 0").select(*at)


def recover_bowl(px: DataFrame, mask: DataFrame, frame: Sequence[str], outline: str, relief: str, wet: str, hypotheses: int = HYPOTHESES, cascade: Sequence[int] = CASCADE,
                 inlier_mm: float = INLIER_MM, top: int = TOP, min_wall: int = MIN_WALL_PX) -> DataFrame:
    """One row per outline: water_share, surface_mm (90th percentile of what is seen), recovered_mm (with the floor under the water), bowl (the fit used) and abstained (why there is none).

    Pixels of an outline with ``wet`` show the water surface; its dry wall and ``ANCHOR_PX`` of road around it carry the fit. For each degree of the cascade, surfaces through
    hash-chosen minimal samples are counted for points within ``inlier_mm``; the ``top`` are refitted on their inliers, twice, and the best that is a bowl is kept. Outlines without one try
    the next degree, then a least-squares quadric. Under the water the deeper of reading and fit counts, held to 0 and ``MAX_DEPTH_MM``.

    A null ``wet`` is dry, a null relief is no reading. An outline without readings has a null surface; one without water, with too little wall or with a wall that is no bowl
    abstains and keeps the surface reading. Equal inlier counts go to the lower sample, equal depths to the upper left pixel.
    """
    key = [*frame, outline]
    spots = px.select(*frame, "y", "x", F.col(relief).cast("double").alias("z"), F.coalesce(F.col(wet), F.lit(False)).alias("wet"))
    near = region(spots, mask, frame, outline, ANCHOR_PX)
    across, down = Window.partitionBy(*key, "y").orderBy("x").rangeBetween(-2, 2), Window.partitionBy(*key, "x").orderBy("y").rangeBetween(-2, 2)
    near = near.withColumn("under", F.col("inside") & F.col("wet"))
    near = near.withColumn("_all", F.min(F.col("under").cast("int")).over(across)).withColumn("edge", F.min("_all").over(down) == 0).drop("_all")
    near = materialise(near, "bowl_region")
    point = ~F.col("under") & F.col("z").isNotNull()
    seen = F.when(F.col("inside"), F.col("z"))
    size = mask.groupBy(*key).agg(F.count(F.lit(1)).alias("mask_px"), F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    facts = near.groupBy(*key).agg(
        F.percentile(seen, F.lit(0.9)).alias("surface_mm"), F.count_if("under").alias("wet_px"), F.count_if(point & F.col("inside")).alias("wall_px"), F.count_if(point).alias("n_points"),
        F.percentile(F.when(F.col("under"), F.col("z")), F.lit(0.5)).alias("level"),
        F.greatest(*[F.max(F.when(point, F.col(a))) - F.min(F.when(point, F.col(a))) for a in "xy"], F.lit(1)).cast("double").alias("scale"))
    facts = materialise(size.join(facts, key, "left"), "bowl_facts")
    reason = F.when(F.coalesce("wet_px", F.lit(0)) == 0, "no water").when(F.col("wall_px") < min_wall, "too little visible wall")
    ready = facts.withColumn("_reason", reason)
    placed = near.join(ready.where("_reason IS NULL").select(*key, "_cx", "_cy", "scale", "level", "n_points"), key).withColumns(
        {"u": (F.col("x") - F.col("_cx")) / F.col("scale"), "v": (F.col("y") - F.col("_cy")) / F.col("scale")})
    placed = materialise(placed, "bowl_points")
    open_, found = ready.where("_reason IS NULL").select(*key), None
    for degree in cascade:
        now = placed.join(open_, key, "left_semi")
        fit = consensus(now.where(point), now.where("under"), key, degree, hypotheses, inlier_mm, top)
        fit = materialise(fit.select(*key, "coef", F.lit(degree).alias("degree"), F.lit(f"consensus degree {degree}").alias("bowl")), "bowl_fits")
        open_ = open_.join(fit, key, "left_anti")
        found = fit if found is None else found.unionByName(fit)
    wall = with_terms(placed.join(open_, key, "left_semi").where(point), 2)
    rest = normal_equations(wall, key, 2).where(F.col("coef").isNotNull() & quadric_bowl("coef"))
    rest = materialise(rest.select(*key, "coef", F.lit(2).alias("degree"), F.lit("least-squares quadric").alias("bowl")), "bowl_fits")
    found, parts = rest if found is None else found.unionByName(rest), None
    for degree in sorted({*cascade, 2}):
        fit = spread(found.where(F.col("degree") == degree), degree)
        filled = F.when(F.col("under"), F.least(F.greatest("z", surface(degree), F.lit(0.0)), F.lit(MAX_DEPTH_MM))).otherwise(F.col("z"))
        part = with_terms(placed.where("inside"), degree).join(fit, key).select(*key, "bowl", filled.alias("_z"))
        parts = part if parts is None else parts.unionByName(part)
    deep = parts.groupBy(*key, "bowl").agg(F.percentile("_z", F.lit(0.9)).alias("_deep"))
    out = ready.join(deep, key, "left")
    return out.select(*key, (F.coalesce("wet_px", F.lit(0)) / F.col("mask_px")).alias("water_share"), "surface_mm", F.coalesce("_deep", "surface_mm").alias("recovered_mm"), "bowl",
                      F.coalesce("_reason", F.when(F.col("bowl").isNull(), "visible wall is not bowl-shaped")).alias("abstained"))
