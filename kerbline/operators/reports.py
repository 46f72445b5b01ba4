"""Roll-ups for a road segment, an image or an evaluation page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.geometry import polygon_area
from kerbline.functions.grading import age_factor, band, severity_rank

# fixed values: cubic cm per cubic foot and repair cost per cubic foot, as the segment report uses them
CM3_PER_FT3, USD_PER_FT3 = 28316.8, 50.0


def repair_rows(px: DataFrame, outline: Sequence[str], depth: str, pixel_cm: float, depth_scale_cm: float = 50.0) -> DataFrame:
    """Area, depth and approximate volume of every outline from its pixels."""
    return px.groupBy(*outline).agg(F.count(F.lit(1)).alias("area_px"), F.max(depth).alias("max_depth"), F.avg(depth).alias("mean_depth"),
                                    (F.sum(depth) * F.lit(pixel_cm ** 2 * depth_scale_cm)).alias("volume_cm3"))


def priority_weight(severity: Column, area: Column, age_score: Column) -> Column:
    """Severity weight x area x age factor."""
    return severity_rank(severity) * area * age_factor(age_score)


def segment_summary(df: DataFrame, by: Sequence[str], image: str) -> DataFrame:
    """One row per segment: images, potholes, severities, mean size, volume, repair priority (0-100) and cost.

    Rows: image, severity, area_px, max_depth, volume_cm3, age_score; an image without potholes has one row with a null severity.
    Images are folded first, so a segment is the sum of its images and no distinct count is kept.
    """
    real = F.col("severity").isNotNull()
    n = lambda s: F.count_if(F.col("severity") == s)
    img = df.groupBy(*by, image).agg(
        F.count("severity").alias("_k"), *[n(s).alias(s.lower()) for s in ("Shallow", "Moderate", "Deep")], F.max(severity_rank(F.col("severity"))).alias("_worst"),
        F.sum(F.when(real, F.col("area_px"))).alias("_area"), F.sum(F.when(real, F.col("max_depth"))).alias("_depth"),
        F.sum(F.when(real, F.col("volume_cm3"))).alias("_vol"), F.sum(F.when(real, priority_weight(F.col("severity"), F.col("area_px"), F.col("age_score")))).alias("_w"))
    s = img.groupBy(*by).agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("_k") > 0).alias("images_with_potholes"), F.sum("_k").alias("potholes"),
        *[F.sum(s).alias(s) for s in ("shallow", "moderate", "deep")], F.max("_worst").alias("_worst"), F.sum("_area").alias("_area"),
        F.sum("_depth").alias("_depth"), F.sum("_vol").alias("_vol"), F.sum("_w").alias("_w"))
    some = F.greatest(F.col("potholes"), F.lit(1))
    score = F.when(F.col("_area") > 0, (F.col("_w") / (3 * F.col("_area")) + 1e-8) * 100).otherwise(0.0)
    return s.select(*by, "images", "images_with_potholes", "potholes", (F.col("potholes") / F.greatest("images", F.lit(1))).alias("per_image"), "shallow", "moderate", "deep",
                    F.element_at(F.array(*[F.lit(x) for x in ("None", "Shallow", "Moderate", "Deep")]), F.col("_worst") + 1).alias("worst"),
                    (F.col("_area") / some).alias("mean_area_px"), (F.col("_depth") / some).alias("mean_max_depth"), F.col("_vol").alias("volume_cm3"),
                    F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)).alias("priority"), (F.col("_vol") / CM3_PER_FT3 * USD_PER_FT3).alias("cost_usd"))


def per_image_summary(df: DataFrame, image: str, severity: str) -> DataFrame:
    """Potholes, worst severity and summed severity weights of every image."""
    rank = severity_rank(F.col(severity))
    return df.groupBy(image).agg(F.count(F.lit(1)).alias("potholes"), F.max_by(severity, rank).alias("worst"), F.sum(rank).alias("score"))


def representative(df: DataFrame, image: str, severity: str, area: str, key: str, water: Column) -> DataFrame:
    """The pothole that stands for each image: most severe, then largest, then first; with image-level flags."""
    best = F.max_by(F.struct(F.col(key).alias("pothole"), F.col(severity).alias("severity"), F.col(area).alias("area")),
                    F.struct(severity_rank(F.col(severity)), F.col(area), -F.col(key)))
    return df.groupBy(image).agg(best.alias("b"), F.bool_or(water).alias("any_water"), F.count(F.lit(1)).alias("potholes")).select(
        image, "b.pothole", "b.severity", "b.area", "any_water", "potholes")


def severity_matrix(df: DataFrame, measured: Column, predicted: Column, labels: Sequence[str] = ("Shallow", "Moderate", "Deep")) -> DataFrame:
    """Measured band by predicted band, every label as a column; items without a prediction are counted as missed."""
    m = df.groupBy(measured.alias("measured"))
    return m.agg(*[F.count_if(predicted == v).alias(v.lower()) for v in labels], F.count_if(predicted.isNull()).alias("missed"))


def grouped_report(df: DataFrame, grp: str, flagged: str, aggs: Sequence[Column]) -> DataFrame:
    """The same metrics over everything, over the rows not set aside, and per group, from one pass of grouping sets."""
    # rows set aside may not enter the middle line, so the flag is part of the set and only its false side is kept
    sets = df.groupingSets([[], [flagged], [grp]], grp, flagged).agg(*aggs, F.grouping(grp).alias("_g"), F.grouping(flagged).alias("_f"))
    name = (F.when((F.col("_g") == 1) & (F.col("_f") == 1), "all").when(F.col("_f") == 0, "not set aside").otherwise(F.col(grp)))
    return sets.where((F.col("_f") == 1) | ~F.col(flagged)).withColumn("subset", name).drop(grp, flagged, "_g", "_f")


def insight_rollup(df: DataFrame, method: str, truth: str, pred: str, moderate_from: float, deep_from: float) -> DataFrame:
    """Leaderboard of methods: items, mean error, shares correct and under-reported at the served cut-offs, rank by error."""
    y, p = band(F.col(truth)), band(F.col(pred), moderate_from, deep_from)
    board = df.groupBy(method).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(pred).isNull()).alias("missed"), F.avg(F.abs(F.col(pred) - F.col(truth))).alias("mae"),
        F.avg((p == y).cast("int")).alias("correct"), F.count_if(severity_rank(F.coalesce(p, F.lit(""))) < severity_rank(y)).alias("under"))
    return board.withColumn("place", F.row_number().over(Window.orderBy("mae", method)))


def outlines_per_image(images: DataFrame, outlines: DataFrame, image: str) -> DataFrame:
    """How many images have how many outlines; images without any count as 0."""
    n = outlines.groupBy(image).agg(F.count(F.lit(1)).alias("_n"))
    return images.select(image).distinct().join(n, image, "left").groupBy(F.coalesce("_n", F.lit(0)).alias("outlines")).agg(F.count(F.lit(1)).alias("images"))


def mean_area(outlines: DataFrame, source: str, points: str) -> DataFrame:
    """Outlines with three points or more of each source and their mean polygon area, in the units of the points."""
    return outlines.where(F.size(points) >= 3).groupBy(source).agg(F.count(F.lit(1)).alias("outlines"), F.avg(polygon_area(F.col(points))).alias("mean_area"))
