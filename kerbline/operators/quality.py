"""Label verification, plausibility gates, range checks and trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.ordered import percentiles
from kerbline.storage import materialise

# fixed values: fewest tokens of an outline line that each consumer accepts
MIN_TOKENS = {"summary": 6, "geometry": 7, "training": 3, "polygon": 6}
# fixed value: most groups whose limits, a few numbers each, are broadcast
BROADCAST_GROUPS = 100_000


def valid_outline(tokens: Column, use: str) -> Column:
    """Whether a token list is long enough for a use."""
    return F.size(tokens) >= MIN_TOKENS[use]


def line_problems(line: Column, number: Column) -> Column:
    """Every problem of one label line, as an array of texts."""
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    coords = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    bad = F.exists(coords, lambda v: v.try_cast("double").isNull())
    outside = F.exists(coords, lambda v: ~v.try_cast("double").between(0.0, 1.0))
    at = F.concat(F.lit(" on line "), number.cast("string"))
    found = F.array_compact(F.array(
        F.when(F.get(tokens, 0) != "0", F.concat(F.lit("Label class is not 0"), at)),
        F.when(F.size(coords) < 6, F.concat(F.lit("Not enough coordinates (min 6)"), at)),
        F.when(bad, F.concat(F.lit("Non-float coordinate"), at)),
        F.when(~bad & outside, F.concat(F.lit("Coordinate out of range [0.0, 1.0]"), at))))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(found)


def verify_labels(frames: DataFrame, lines: DataFrame, frame: str) -> DataFrame:
    """Reasons to quarantine each frame: label file missing or empty, bad lines, unreadable or tiny image.

    ``frames`` has width and height (null when unreadable) and has_label; ``lines`` has frame, line_no, line.
    """
    bad = (lines.withColumn("_p", F.explode(line_problems(F.col("line"), F.col("line_no"))))
           .groupBy(frame).agg(F.sort_array(F.collect_set("_p")).alias("_problems")))
    seen = lines.groupBy(frame).agg(F.count(F.lit(1)).alias("_lines"))
    joined = frames.join(seen, frame, "left").join(bad, frame, "left")
    own = F.array_compact(F.array(
        F.when(~F.col("has_label"), "Missing label file"),
        F.when(F.col("has_label") & F.col("_lines").isNull(), "Empty label file"),
        F.when(F.col("width").isNull(), "Image is corrupted or unreadable"),
        F.when((F.col("width") < 100) | (F.col("height") < 100), "Image smaller than 100x100")))
    reasons = F.concat(own, F.coalesce("_problems", F.array().cast("array<string>")))
    return joined.select(*frames.columns, reasons.alias("reasons"), (F.size(reasons) > 0).alias("quarantined"))


def plausible(depth: Column, ring: Column, rms: Column, low: float = -10.0, high: float = 250.0, min_ring: int = 400, max_rms: float = 15.0) -> Column:
    """First gate a measurement fails, or ``kept``; a missing depth is implausible."""
    return (F.when(ring.isNull() | (ring < min_ring), "no_ring").when(rms > max_rms, "bad_fit")
            .when(depth.isNull() | ~depth.between(low, high), "implausible").otherwise("kept"))


def out_of_range(df: DataFrame, key: Sequence[str], features: Sequence[str], ranges: DataFrame) -> DataFrame:
    """Per row: features outside the training range, whether one is far outside (over 10% of the width) and
    whether the row still counts as in distribution. ``ranges`` is one row: ``<feature>_lo`` and ``<feature>_hi``."""
    limits = ranges.select(F.struct(*[F.col(f"{f}_{end}") for f in features for end in ("lo", "hi")])).scalar()
    df, outside, far = df.withColumn("_limits", limits), [], F.lit(False)
    for f in features:
        lo, hi = F.col(f"_limits.{f}_lo"), F.col(f"_limits.{f}_hi")
        excess = F.when(hi > lo, F.greatest(lo - F.col(f), F.col(f) - hi) / (hi - lo))
        outside.append(F.when(excess > 0, f))
        far = far | F.coalesce(excess > 0.10, F.lit(False))
    names = F.array_compact(F.array(*outside))
    return df.select(*key, names.alias("outside"), far.alias("far"), (~far & (F.size(names) < 2)).alias("in_distribution"))


def feature_ranges(df: DataFrame, features: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """1st and 99th percentile of every feature, one row per feature."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("s")).select("s.*")
    return percentiles(stacked, ["feature"], "value", {"lo": low, "hi": high})


def one_row(ranges: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature_ranges`` as a single row of named limits."""
    return ranges.agg(*[F.max(F.when(F.col("feature") == f, F.col(s))).alias(f"{f}_{s}") for f in features for s in ("lo", "hi")])


def trim_percentile(df: DataFrame, group: Sequence[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Keep the rows of each group between two percentiles of its values."""
    limits = percentiles(df, group, value, {"_lo": low, "_hi": high})
    if not group:
        return df.where(F.col(value).between(limits.select("_lo").scalar(), limits.select("_hi").scalar()))
    return between_limits(df, materialise(limits, "limits"), group, value)


def between_limits(df: DataFrame, limits: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Rows between the limits of their group. Up to ``BROADCAST_GROUPS`` counted groups meet the rows where they are, so that no task takes a whole group; more are joined by shuffle."""
    few = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    return df.join(few, list(group)).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def sigma_trim(df: DataFrame, group: Sequence[str], value: str, k: float = 2.5, rounds: int = 3) -> DataFrame:
    """Repeatedly drop values further than ``k`` standard deviations from the group mean of those kept.

    Only per-group moments travel between rounds. The limits are bounds on the value, so each round filters the original rows.
    """
    group = list(group)
    limits = None
    for _ in range(rounds):
        kept = df if limits is None else between_limits(df, limits, group, value)
        m = kept.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
        limits = materialise(m.select(*group, (F.col("_m") - k * F.col("_s")).alias("_lo"), (F.col("_m") + k * F.col("_s")).alias("_hi")), "limits")
    return between_limits(df, limits, group, value)


def road_surround(px: DataFrame, outline: Sequence[str], half_height: Column, need: int = 100) -> DataFrame:
    """Ring pixels that look like road (no vegetation; no sky in the upper half), or the whole ring where too few are left."""
    green = F.col("h").between(36, 84) & (F.col("s") > 40)
    sky = (F.col("v") > 200) & (F.col("s") < 30) & (F.col("y") < half_height)
    marked = px.withColumn("_road", ~(green | sky))
    enough = marked.groupBy(*outline).agg(F.count_if("_road").alias("_n"))
    return (marked.join(enough, list(outline)).where(F.col("_road") | (F.col("_n") < need)).drop("_road", "_n"))


def min_area(masks: DataFrame, frame: Sequence[str], outline: str, n: int) -> DataFrame:
    """Outlines of at least ``n`` pixels, numbered from the largest in each frame."""
    size = masks.groupBy(*frame, outline).agg(F.count(F.lit(1)).alias("area")).where(F.col("area") >= n)
    return size.withColumn("rank", F.row_number().over(Window.partitionBy(*frame).orderBy(F.desc("area"), outline)))


def usable_frames(boxes: DataFrame, frame: str, reason: str) -> DataFrame:
    """A frame is usable only when every box in it was accepted."""
    return boxes.groupBy(frame).agg(F.bool_and(F.col(reason) == "").alias("usable"), F.count(F.lit(1)).alias("boxes"))


def rejections(df: DataFrame, reason: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows per reason."""
    return df.groupBy(*by, reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
