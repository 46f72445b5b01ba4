"""Joins: pairing files, longest prefix, as-of, label overrides, pixel overlap, band joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.ordered import carry_last


def pair_frames(images: DataFrame, depths: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Frames that have a photo, a depth map and labels under one key."""
    return images.join(depths, key).join(labels, key)


def unpaired(images: DataFrame, depths: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Keys counted by which of the three file sets hold them."""
    sides = None
    for name, df in (("image", images), ("depth", depths), ("label", labels)):
        part = df.select(key, F.lit(name).alias("side"))
        sides = part if sides is None else sides.unionByName(part)
    seen = sides.groupBy(key).agg(*[F.max(F.col("side") == s).alias(f"has_{s}") for s in ("image", "depth", "label")])
    return seen.groupBy("has_image", "has_depth", "has_label").agg(F.count(F.lit(1)).alias("frames"))


def identify_source(df: DataFrame, path: str, registry: Sequence[tuple[str, str]]) -> DataFrame:
    """Registered source whose root is the longest prefix of the path, else null.

    The registry is a short fixed list, so it becomes one CASE, longest root first: no join at all.
    """
    out = None
    for root, source in sorted(registry, key=lambda r: (-len(r[0]), r[0])):
        hit = F.col(path).startswith(root.rstrip("/") + "/")
        out = F.when(hit, source) if out is None else out.when(hit, source)
    return df.withColumn("source_id", out)


def label_override(features: DataFrame, real: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Measured label where one exists (the first by ``order``), else the pseudo label; with its provenance."""
    first = real.where(F.col(label).isNotNull()).groupBy(key).agg(F.min_by(label, order).alias("_real"))
    return features.join(first, key, "left").withColumns({
        label: F.coalesce("_real", label),
        "label_source": F.when(F.col("_real").isNotNull(), "measured").otherwise("pseudo")}).drop("_real")


def asof(df: DataFrame, starts: DataFrame, part: Sequence[str], ts: str, start_ts: str, value: str, name: str,
         chunk_seconds: int = 86400) -> DataFrame:
    """Latest ``starts`` value at or before each row's time, per ``part``; of several at one instant the largest.

    Starts are woven between the rows in time order and carried forward chunk by chunk, so a busy key is
    sorted one time slice at a time.
    """
    rows = df.withColumns({"_at": F.col(ts), "_start": F.lit(False), "_value": F.lit(None).cast(starts.schema[value].dataType)})
    marks = starts.select(*part, F.col(start_ts).alias("_at"), F.lit(True).alias("_start"), F.col(value).alias("_value"))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_order", F.struct("_at", (~F.col("_start")).alias("row"), "_value"))
    slot = F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / F.lit(chunk_seconds * 1_000_000))
    carried = carry_last(both, part, "_order", slot, "_value", name)
    return carried.where(~F.col("_start")).select(*df.columns, name)


def pairwise_raters(labels: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """(item, a, b, label_a, label_b) for raters a < b. A rater holds one label per item, so an item is only as wide as the team."""
    a = labels.select(item, F.col(rater).alias("a"), F.col(label).alias("label_a"))
    b = labels.select(item, F.col(rater).alias("b"), F.col(label).alias("label_b"))
    return a.join(b, item).where("a < b")


def overlap(a: DataFrame, b: DataFrame, frame: Sequence[str], a_id: str, b_id: str) -> DataFrame:
    """Intersection, union and IoU of every pair of pixel sets that touch (columns frame..., y, x, id)."""
    px = [*frame, "y", "x"]
    size_a = a.groupBy(*frame, a_id).agg(F.count(F.lit(1)).alias("area_a"))
    size_b = b.groupBy(*frame, b_id).agg(F.count(F.lit(1)).alias("area_b"))
    both = a.select(*px, a_id).join(b.select(*px, b_id), px).groupBy(*frame, a_id, b_id).agg(F.count(F.lit(1)).alias("shared"))
    return (both.join(size_a, [*frame, a_id]).join(size_b, [*frame, b_id])
            .withColumn("iou", F.col("shared") / (F.col("area_a") + F.col("area_b") - F.col("shared"))))


def best_match(truth: DataFrame, pairs: DataFrame, frame: Sequence[str], truth_id: str, pred_id: str, min_iou: float = 0.1) -> DataFrame:
    """Best prediction per truth (ties by id); a truth without one above ``min_iou`` stays with nulls."""
    best = pairs.groupBy(*frame, truth_id).agg(F.max(F.struct("iou", (-F.col(pred_id)).alias("neg"), F.col(pred_id).alias("p"))).alias("_b"))
    ok = F.col("_b.iou") >= min_iou
    return truth.join(best, [*frame, truth_id], "left").select(
        *truth.columns, F.coalesce("_b.iou", F.lit(0.0)).alias("best_iou"), F.when(ok, F.col("_b.p")).alias("matched"))


def coverage(mask: DataFrame, other: DataFrame, frame: Sequence[str], outline: str) -> DataFrame:
    """Share of each outline's pixels that a second mask covers."""
    px = [*frame, "y", "x"]
    hit = mask.join(other.select(*px).distinct().withColumn("_hit", F.lit(1.0)), px, "left")
    return hit.groupBy(*frame, outline).agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("coverage"), F.count(F.lit(1)).alias("px"))


def point_in_box(pred: DataFrame, boxes: DataFrame, frame: Sequence[str], pred_id: str, box_id: str) -> DataFrame:
    """Per box and prediction: pixels inside, the prediction's size, the box's size and whether that is a hit
    (half of the prediction inside, covering a tenth of the box). Boxes meet predictions by frame and image row."""
    size = pred.groupBy(*frame, pred_id).agg(F.count(F.lit(1)).alias("pred_px"))
    strips = boxes.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    runs = pred.groupBy(*frame, pred_id, "y").agg(F.collect_list("x").alias("xs"))   # at most one image row
    inside = (strips.join(runs, [*frame, "y"])
              .withColumn("n", F.size(F.filter("xs", lambda x: (x >= F.col("x0")) & (x < F.col("x1")))))
              .groupBy(*frame, box_id, pred_id).agg(F.sum("n").alias("inside"), F.first("x0").alias("x0"), F.first("x1").alias("x1"),
                                                     F.first("y0").alias("y0"), F.first("y1").alias("y1")))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1))
    return (inside.join(size, [*frame, pred_id]).withColumn("box_px", area)
            .withColumn("hit", (F.col("inside") >= 0.5 * F.col("pred_px")) & (F.col("inside") >= 0.1 * F.col("box_px")))
            .select(*frame, box_id, pred_id, "inside", "pred_px", "box_px", "hit"))


def resume(todo: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Items not processed yet."""
    return todo.join(done.select(*on), list(on), "left_anti")


def with_cache(df: DataFrame, cache: DataFrame, name: str, content: Column, value: str, compute: Column) -> DataFrame:
    """Reuse a cached measurement when name and outline are unchanged, else compute it.

    The cache key is the name plus the start of the outline's md5; rows without an outline use the name alone.
    """
    key = F.when(content.isNotNull(), F.concat(F.col(name).cast("string"), F.lit("|"), F.substring(F.md5(content), 1, 8))).otherwise(F.col(name).cast("string"))
    keyed = df.withColumn("cache_key", key)
    found = keyed.join(cache.select("cache_key", F.col(value).alias("_cached")), "cache_key", "left")
    return found.withColumns({value: F.coalesce("_cached", compute), "from_cache": F.col("_cached").isNotNull()}).drop("_cached")


def latest_per_key(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``; reduced before the shuffle."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("_r")).select(*key, "_r.*")


def running_min(df: DataFrame, part: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Minimum so far: P(grade > k) may not rise with k. Meant for short ordered lists such as grades."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.min(value).over(w))
