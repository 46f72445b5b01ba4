"""Scores of detected outlines against labelled outlines, boxes and frames without a defect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.joins import best_match, point_in_box

# fixed values: overlap of a strict and of a found match, growth of a labelled box, share of an outline below which it is outside a box
STRICT_IOU, FOUND_IOU, LOOSEN, STRAY = 0.5, 0.1, 0.10, 0.1


def detection_scores(truth: DataFrame, preds: DataFrame, pairs: DataFrame, frame: Sequence[str], truth_id: str, pred_id: str, strict: float = STRICT_IOU, found: float = FOUND_IOU) -> DataFrame:
    """One row: labelled outlines, shares of them found at the strict and the found overlap, their mean best overlap, and detected outlines that overlap none (``pairs`` of ``joins.overlap``)."""
    best = best_match(truth, pairs, frame, truth_id, pred_id, found)
    real = pairs.where(F.col("iou") >= found).select(*frame, pred_id)
    false = preds.join(real, [*frame, pred_id], "left_anti").agg(F.count(F.lit(1))).scalar()
    share = lambda limit: F.avg((F.col("best_iou") >= limit).cast("int"))
    return best.agg(F.count(F.lit(1)).alias("potholes"), share(strict).alias("found_strict"), share(found).alias("found"), F.avg("best_iou").alias("mean_iou")).withColumn("false_outlines", false)


def loosened(boxes: DataFrame, frames: DataFrame, frame: Sequence[str], by: float = LOOSEN) -> DataFrame:
    """Boxes grown by a share of their size, cut to the frame (w, h) and to whole pixels."""
    dx, dy = (F.col("x1") - F.col("x0")) * by / 2, (F.col("y1") - F.col("y0")) * by / 2
    cut = {"x0": F.greatest(F.lit(0.0), F.col("x0") - dx), "y0": F.greatest(F.lit(0.0), F.col("y0") - dy), "x1": F.least(F.col("w"), F.col("x1") + dx), "y1": F.least(F.col("h"), F.col("y1") + dy)}
    return boxes.join(frames.select(*frame, "w", "h"), list(frame)).withColumns({k: v.cast("int") for k, v in cut.items()}).drop("w", "h")


def box_recall(preds: DataFrame, boxes: DataFrame, frames: DataFrame, frame: Sequence[str], pred_id: str, box_id: str, positive: str = "box_test", negative: str = "neg_test") -> DataFrame:
    """One row of scores of detected outlines (pixels) where only boxes are known.

    In frames of role ``positive``: box_recall (loosened boxes that hold half of an outline which fills a tenth of them), n_boxes, stray (outlines with less than a tenth inside every box) and
    stray_per_img. In frames of role ``negative``: n_neg_frames, neg_frames_hit (share with an outline), neg_masks, neg_masks_per_img and neg_masks_top_third (their mean row is in the upper third).
    Frames without outlines count; shares of nothing are 0.
    """
    frame = list(frame)
    pos, neg = frames.where(F.col("role") == positive), frames.where(F.col("role") == negative)
    wide = loosened(boxes.join(pos.select(*frame), frame), pos, frame)
    seen = preds.join(pos.select(*frame), frame)
    inside = point_in_box(seen, wide.where("x1 > x0 AND y1 > y0"), frame, pred_id, box_id)
    hits = inside.groupBy(*frame, box_id).agg(F.bool_or("hit").alias("_hit"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    found = wide.join(hits, [*frame, box_id], "left").agg(F.count(F.lit(1)).alias("n_boxes"), F.count_if("_hit").alias("_found"))
    stray = seen.select(*frame, pred_id).distinct().join(inside.where(F.col("inside") >= STRAY * F.col("pred_px")), [*frame, pred_id], "left_anti")
    masks = preds.join(neg.select(*frame, "h"), frame).groupBy(*frame, pred_id).agg((F.avg("y") < F.first("h") / 3).alias("_top"))
    per = neg.select(*frame).join(masks.groupBy(*frame).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_top").alias("_t")), frame, "left").agg(
        F.struct(F.count(F.lit(1)).alias("frames"), F.count("_n").alias("hit"), F.coalesce(F.sum("_n"), F.lit(0)).alias("masks"), F.coalesce(F.sum("_t"), F.lit(0)).alias("top"))).scalar()
    out = found.withColumns({"_p": pos.agg(F.count(F.lit(1))).scalar(), "stray": stray.agg(F.count(F.lit(1))).scalar(), "_g": per})
    g = {k: F.col(f"_g.{k}") for k in ("frames", "hit", "masks", "top")}
    return out.select(share(F.col("_found"), F.col("n_boxes")).alias("box_recall"), "n_boxes", "stray", share(F.col("stray"), F.col("_p")).alias("stray_per_img"), g["frames"].alias("n_neg_frames"),
                      share(g["hit"], g["frames"]).alias("neg_frames_hit"), g["masks"].alias("neg_masks"), share(g["masks"], g["frames"]).alias("neg_masks_per_img"), g["top"].alias("neg_masks_top_third"))
