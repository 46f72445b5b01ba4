"""The training corpus manifest, and colours read back to the numbers they were rendered from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.sampling import stratified_sample
from kerbline.operators.similarity import nearest_reference
from kerbline.operators.splits import hold_out_runner_up


def corpus_manifest(frames: DataFrame, key: str, country: str, positive: Column, other: Column, phash: str, reference: DataFrame, ref_hash: str, ref_name: str, ref_split: str,
                    per_stratum: int, neg_test: int, seed) -> DataFrame:
    """Role of every used frame: box_train, box_test (the held-out country), negative, neg_test, or dropped as a near
    copy of a reference photo. Negatives come evenly from each training country, with and without other damage."""
    marked = frames.withColumns({"_pos": positive, "_other": other})
    counts = marked.where("_pos").groupBy(country).agg(F.count(F.lit(1)).alias("n"))
    held = F.col(country) == hold_out_runner_up(counts, country, "n")
    marked = marked.withColumn("_held", held)
    boxes = marked.where("_pos").withColumn("role", F.when(F.col("_held"), "box_test").otherwise("box_train"))
    none = marked.where("NOT _pos")
    train = stratified_sample(none.where("NOT _held"), [country, "_other"], key, per_stratum, seed).withColumn("role", F.lit("negative")).drop("rn")
    test = stratified_sample(none.where("_held"), ["_held"], key, neg_test, seed).withColumn("role", F.lit("neg_test")).drop("rn")
    used = boxes.unionByName(train).unionByName(test).drop("_pos", "_other", "_held")
    out = nearest_reference(used, phash, reference, ref_hash, ref_name, ref_split)
    return out.withColumn("role", F.when(F.col("dup_of").isNotNull(), "dropped").otherwise(F.col("role")))


def jet_scale() -> Column:
    """The 256 colours of the JET scale by its rule: three ramps a quarter of the range apart."""
    def ramp(v, centre):
        return F.round(255.0 * F.least(F.greatest(1.5 - F.abs(4.0 * v - centre), F.lit(0.0)), F.lit(1.0))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.struct(i.alias("i"), ramp(i / 255.0, 1.0).alias("b"), ramp(i / 255.0, 2.0).alias("g"), ramp(i / 255.0, 3.0).alias("r")))


def jet_to_index(df: DataFrame, bgr: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """Nearest entry of the JET scale for each colour, and how far off it is. Only distinct colours are searched."""
    sq = lambda s: sum(((F.col(c) - s[k]) * (F.col(c) - s[k]) for c, k in zip(bgr, "bgr")), F.lit(0))
    colours = df.select(*bgr).distinct().withColumn("_scale", jet_scale())
    best = F.array_min(F.transform("_scale", lambda s: F.struct(sq(s).alias("d"), s["i"].alias("i"))))
    found = colours.select(*bgr, best.alias("_n")).select(*bgr, F.col("_n.i").alias("jet_index"), F.sqrt("_n.d").alias("jet_distance"))
    return df.join(found, list(bgr))
