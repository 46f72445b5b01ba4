"""Near duplicates by Hamming distance between 64-bit hashes, exact and without comparing all pairs.

Within distance d, two hashes split into d + 2 blocks agree in at least two blocks. Rows meet only when they
share a block pair. A bucket too full for that is split by the same argument on the remaining bits. Equal hashes are
folded into one row first, so copies of one photo cost nothing extra. Tables of hashes are merged, never broadcast: the
planner takes a hash and its many block pairs for one row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blocks(bits: list[int], count: int) -> list[int]:
    """Masks of ``count`` near-equal runs of the given bit positions."""
    edges = [len(bits) * i // count for i in range(count + 1)]
    return [sum(1 << k for k in bits[a:b]) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _longs(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def hash_pairs(a: DataFrame, b: DataFrame, max_distance: int = 6, hot: int = 4096) -> DataFrame:
    """(ha, hb, distance) for every hash of ``a`` and of ``b`` (columns ``h``) within ``max_distance``."""
    blocks = _blocks(list(range(64)), max_distance + 2)
    joint = [x | y for x, y in combinations(blocks, 2)]
    masks = _longs(joint)
    # at most max_distance bits differ outside the agreed pair, so one of max_distance + 1 runs of them is equal
    inner = F.array(*[_longs(_blocks([k for k in range(64) if not m >> k & 1], max_distance + 1)) for m in joint])

    def keyed(df: DataFrame) -> DataFrame:
        return (df.select("h", F.posexplode(masks).alias("p", "m"))
                .select("h", "p", F.col("h").bitwiseAND(F.col("m")).alias("v")))

    left, right = keyed(a.select("h").distinct()), keyed(b.select("h").distinct())
    full = (right.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > hot).select("p", "v", F.lit(True).alias("full")))

    def refined(df: DataFrame) -> DataFrame:
        """Buckets above ``hot`` hashes are split by one more agreeing run; others keep one entry."""
        marked = df.join(full, ["p", "v"], "left")
        own = F.when(F.col("full"), F.get(inner, F.col("p"))).otherwise(F.array(F.lit(0).cast("long")))
        return (marked.select("h", "p", "v", "full", F.posexplode(own).alias("s", "m"))
                .select("h", "p", "v", "s", F.col("h").bitwiseAND(F.col("m")).alias("sv"),
                        F.coalesce("full", F.lit(False)).alias("full")))

    met = (refined(left).withColumnRenamed("h", "ha")
           .join(refined(right).select(F.col("h").alias("hb"), "p", "v", "s", "sv").hint("merge"), ["p", "v", "s", "sv"])
           .withColumn("_x", F.col("ha").bitwiseXOR(F.col("hb")))
           .withColumn("distance", F.bit_count("_x"))
           .where(F.col("distance") <= max_distance))
    # a pair counts only in the first bucket where it meets, instead of a distinct over all meetings
    agree = lambda ms: F.array_position(F.transform(ms, lambda m: F.col("_x").bitwiseAND(m)), 0) - 1
    return (met.where((F.col("p") == agree(masks)) & (~F.col("full") | (F.col("s") == agree(F.get(inner, F.col("p"))))))
            .select("ha", "hb", "distance"))


def near_duplicates(df: DataFrame, source: str, name: str, phash: str, max_distance: int = 6) -> DataFrame:
    """Per pair of sources: files of the first with a near copy in the second, and one example."""
    folded = (df.where(F.col(phash).isNotNull()).groupBy(F.col(source).alias("src"), F.col(phash).alias("h"))
              .agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first")))
    pairs = hash_pairs(folded, folded, max_distance)
    right = folded.select(F.col("src").alias("source_b"), F.col("h").alias("hb"), F.col("first").alias("fb"))
    near = (folded.select(F.col("src").alias("source_a"), F.col("h").alias("ha"), "n", F.col("first").alias("fa"))
            .join(pairs.hint("merge"), "ha").join(right.hint("merge"), "hb").where("source_a < source_b"))
    hits = near.groupBy("source_a", "source_b", "ha").agg(F.max("n").alias("n"), F.min(F.struct("fa", "fb")).alias("example"))
    return hits.groupBy("source_a", "source_b").agg(
        F.sum("n").alias("files_a"), F.min("example").alias("e")).select(
        "source_a", "source_b", "files_a", F.col("e.fa").alias("example_a"), F.col("e.fb").alias("example_b"))


def nearest_reference(df: DataFrame, phash: str, ref: DataFrame, ref_hash: str, ref_name: str, ref_split: str,
                      max_distance: int = 6) -> DataFrame:
    """Add ``dup_of`` / ``dup_split`` / ``dup_distance`` of the closest reference hash, null beyond the limit."""
    known = (ref.where(F.col(ref_hash).isNotNull()).groupBy(F.col(ref_hash).alias("h"))
             .agg(F.min(F.struct(F.col(ref_name).alias("name"), F.col(ref_split).alias("split"))).alias("r")))
    probe = df.where(F.col(phash).isNotNull()).select(F.col(phash).alias("h"))
    best = (hash_pairs(probe, known, max_distance)
            .join(known.withColumnRenamed("h", "hb").hint("merge"), "hb")
            .groupBy("ha").agg(F.min(F.struct("distance", "r")).alias("b")))
    return (df.join(best.hint("merge"), df[phash] == best["ha"], "left")
            .select(*df.columns, F.col("b.r.name").alias("dup_of"), F.col("b.r.split").alias("dup_split"),
                    F.col("b.distance").alias("dup_distance")))
