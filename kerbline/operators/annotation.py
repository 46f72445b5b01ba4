"""Merging human labels: validation, progress, agreement and final answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions.grading import severity_rank
from kerbline.functions.grading import settle as settled

EXCLUDED = ("unclear", "not_a_pothole")   # fixed values: final answers that are never scored


def validate(labels: DataFrame, manifest: DataFrame, version: int) -> DataFrame:
    """State of every returned label: wrong_version, unassigned, superseded (a later answer differs or repeats), or valid.
    Of two answers at one instant the one that sorts last holds.

    Labels: item_id, annotator, label, labelled_at, pack_version. Manifest: item_id, assigned_to (``a;b``).
    """
    asked = manifest.select("item_id", F.split("assigned_to", ";").alias("_team"))
    joined = labels.join(asked, "item_id", "left")
    first = (F.when(F.col("pack_version") != version, "wrong_version")
             .when(F.col("_team").isNull() | ~F.array_contains("_team", F.col("annotator")), "unassigned").otherwise("valid"))
    marked = joined.withColumn("state", first)
    last = (marked.where("state = 'valid'").groupBy("item_id", "annotator")
            .agg(F.max(F.struct("labelled_at", "label")).alias("_last"), F.count_distinct("label").alias("answers")))
    return (marked.join(last, ["item_id", "annotator"], "left")
            .withColumn("state", F.when((F.col("state") == "valid") & (F.struct("labelled_at", "label") < F.col("_last")), "superseded").otherwise(F.col("state")))
            .withColumn("conflicting", F.coalesce(F.col("answers") > 1, F.lit(False))).drop("_team", "_last", "answers"))


def progress(manifest: DataFrame, valid: DataFrame) -> DataFrame:
    """Assigned and returned items per annotator."""
    asked = manifest.select("item_id", F.explode(F.split("assigned_to", ";")).alias("annotator"))
    done = valid.select("item_id", "annotator").distinct().withColumn("_done", F.lit(1))
    return (asked.join(done, ["item_id", "annotator"], "left").groupBy("annotator")
            .agg(F.count(F.lit(1)).alias("assigned"), F.count("_done").alias("returned")))


def settle(manifest: DataFrame, valid: DataFrame, consensus: DataFrame, graded: bool) -> DataFrame:
    """(item_id, source, status, label): consensus overrides, then pending, agreed or disputed."""
    need = manifest.select("item_id", "source", F.split("assigned_to", ";").alias("team"))
    got = valid.groupBy("item_id", "annotator").agg(F.max("label").alias("label")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("annotator", "label"))).alias("answers"))
    ruled = consensus.select("item_id", F.col("label").alias("_ruled"))
    j = need.join(got, "item_id", "left").join(ruled, "item_id", "left")
    values = F.transform("team", lambda a: F.get(F.array(F.try_element_at("answers", a)), 0))
    complete = F.coalesce(F.forall("team", lambda a: F.map_contains_key("answers", a)), F.lit(False))
    answer = settled(values, F.lit(graded))
    status = (F.when(F.col("_ruled").isNotNull(), "consensus").when(~complete, "pending").when(answer.isNotNull(), "agreed").otherwise("disputed"))
    return j.select("item_id", "source", status.alias("status"),
                    F.when(F.col("_ruled").isNotNull(), F.col("_ruled")).when(complete, answer).alias("label"))


def agreed_by_source(final: DataFrame) -> DataFrame:
    """Per source: items settled without review, of those settled or disputed."""
    return (final.where("status <> 'pending'").groupBy("source")
            .agg(F.count_if(F.col("status") == "agreed").alias("agreed"), F.count(F.lit(1)).alias("decided")))


def final_labels(final: DataFrame) -> DataFrame:
    """Labels to train on: settled, and neither unclear nor a false detection."""
    return final.where(F.col("label").isNotNull() & ~F.col("label").isin(*EXCLUDED)).select("item_id", "source", "label")


def false_detection_share(final: DataFrame) -> DataFrame:
    done = final.where(F.col("label").isNotNull())
    return done.agg(F.count_if(F.col("label") == "not_a_pothole").alias("false_detections"), F.count(F.lit(1)).alias("settled")).withColumn(
        "share", F.round(F.try_divide("false_detections", "settled"), 6))


def kappa(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Agreement and Cohen's kappa of two raters per ``by``; 1 when both always gave one and the same answer.

    ``pairs`` has label_a and label_b. Only the counts of distinct answer pairs are kept after the first aggregate.
    """
    by = by or []
    cells = pairs.groupBy(*by, "label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))
    a = cells.groupBy(*by, F.col("label_a").alias("label")).agg(F.sum("n").alias("na"))
    b = cells.groupBy(*by, F.col("label_b").alias("label")).agg(F.sum("n").alias("nb"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("items"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("same"))
    by_chance = a.join(b, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    j = total.join(by_chance, by, "left") if by else total.withColumn("chance", by_chance.select("chance").scalar())
    po, pe = F.col("same") / F.col("items"), F.coalesce("chance", F.lit(0)) / (F.col("items") * F.col("items"))
    return j.select(*by, "items", po.alias("agree"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def weighted_kappa(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Quadratically weighted kappa of integer grades label_a, label_b, and the share within one point.

    The chance term only needs each rater's first two moments, so no grid of grades is formed.
    """
    by = by or []
    a, b = F.col("label_a").cast("double"), F.col("label_b").cast("double")
    m = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.sum((a - b) * (a - b)).alias("num"), F.sum(a).alias("sa"), F.sum(b).alias("sb"),
                               F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.avg((F.abs(a - b) <= 1).cast("double")).alias("within_one"))
    den = F.col("saa") + F.col("sbb") - 2 * F.col("sa") * F.col("sb") / F.col("items")
    return m.select(*by, "items", "within_one", F.when(den != 0, 1 - F.col("num") / den).otherwise(1.0).alias("weighted_kappa"))


def majority_vote(votes: DataFrame, item: str, label: str) -> DataFrame:
    """Winner per item, its votes and the total; ties go to the more severe label."""
    counts = votes.groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", severity_rank(F.col(label)).alias("rank"), F.col(label).alias("label"))).alias("b")
    return counts.groupBy(item).agg(best, F.sum("n").alias("total")).select(item, F.col("b.label").alias("winner"), F.col("b.n").alias("votes"), "total")
