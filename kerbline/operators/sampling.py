"""Top-k lists, quotas and seeded samples. Every group limit is applied before the shuffle by Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.hashing import hash_chunk, order_key
from kerbline.operators.ordered import hash_cut, prefix_sums, row_numbers
from kerbline.storage import materialise


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of the table in ``order``."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int | Column, name: str = "rn") -> DataFrame:
    """The first k rows of each group, numbered from 1."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rn).where(F.col(name) <= k)


def round_robin(df: DataFrame, group: str, order: str) -> DataFrame:
    """Interleave groups by position and stop when the shortest group runs out."""
    shortest = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    numbered = row_numbers(df, [order], hash_chunk(F.col(order)), "turn", part=[group])
    return numbered.where(F.col("turn") <= shortest)


def quota_sample(df: DataFrame, source: str, photo: str, item: str, quota: int, per_photo: int = 2, seed=20260929) -> DataFrame:
    """Photos in random order per source until the quota of items is met, at most ``per_photo`` from one photo,
    then all items in one shuffled order."""
    few = top_k_per_group(df, [source, photo], [item], per_photo, "_in_photo")
    taken = top_k_per_group(few.withColumn("_h", order_key(seed, photo)), [source], ["_h", item], quota, "_in_source")
    taken = taken.withColumn("_mix", order_key(seed, photo, item))
    return row_numbers(taken, ["_mix"], hash_chunk(F.col("_mix"), 1), "position").drop("_h", "_mix", "_in_photo", "_in_source")


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, per_stratum: int, seed) -> DataFrame:
    """The same number of random rows from every stratum (fewer where it is smaller)."""
    return top_k_per_group(df.withColumn("_h", order_key(seed, key)), strata, ["_h", key], per_stratum).drop("_h")


def enriched_sample(df: DataFrame, key: str, score: Column, limit: int, pool: int = 400, seed=42) -> DataFrame:
    """Half at random; the other half the lowest scores among the next ``pool`` random rows."""
    n_random = max(1, limit // 2)
    drawn = (df.withColumns({"_h": order_key(seed, key), "_score": score})
             .orderBy("_h").limit(n_random + pool))
    drawn = drawn.withColumn("_rn", F.row_number().over(Window.orderBy("_h")))
    lowest = F.row_number().over(Window.partitionBy("stratum").orderBy("_score", key))
    return (drawn.withColumn("stratum", F.when(F.col("_rn") <= n_random, "random").otherwise("enriched"))
            .withColumn("_low", lowest)
            .where((F.col("stratum") == "random") | (F.col("_low") <= limit - n_random))
            .drop("_h", "_rn", "_score", "_low"))


def distinct_photos(df: DataFrame, photo: Column, name: str) -> DataFrame:
    """One row per photo: the first by name."""
    return df.groupBy(photo.alias("photo")).agg(F.min_by(F.struct(*df.columns), F.col(name)).alias("_r")).select("photo", "_r.*")


def random_pairs(pool: DataFrame, key: str, photo: str, factor: int = 4, seed=20261013) -> DataFrame:
    """round(n * factor / 2) distinct unordered pairs of pool rows, never two of one photo.

    Each row draws partners by hashed position, so the work is linear in the pool; spare draws replace
    rejected ones and the lowest pair hashes are kept.
    """
    numbered = materialise(row_numbers(pool.select(key, photo).withColumn("_h", order_key(seed, key)), ["_h"], hash_chunk(F.col("_h")), "_pos"), "pool")
    size = numbered.agg(F.count(F.lit(1))).scalar()
    draws = (numbered.select(F.col(key).alias("_ka"), F.col(photo).alias("_pa"),
                             F.explode(F.sequence(F.lit(1), F.lit(factor + 2))).alias("_d"))
             .withColumn("_pos", F.conv(F.substring(order_key(seed, F.col("_ka"), F.col("_d")), 1, 8), 16, 10).cast("long") % size + 1))
    pairs = (draws.join(numbered.select("_pos", F.col(key).alias("_kb"), F.col(photo).alias("_pb")), "_pos")
             .where(F.col("_pa") != F.col("_pb"))
             .select(F.least("_ka", "_kb").alias("pool_a"), F.greatest("_ka", "_kb").alias("pool_b"))
             .where("pool_a <> pool_b").distinct()
             .withColumns({"h": order_key(seed, "pool_a", "pool_b"), "w": F.lit(1)}))
    pairs = materialise(pairs, "pairs")
    wanted = numbered.agg(F.bround(F.count(F.lit(1)) * F.lit(factor / 2)).cast("long")).scalar()
    return pairs.where(F.col("h") <= hash_cut(pairs, "h", "w", wanted)).select("pool_a", "pool_b")


def deal_in_rotation(items: DataFrame, item: str, stratum: str, annotators: Sequence[str], overlap: int, seed) -> DataFrame:
    """Deal shuffled items to annotator groups in rotation, one running count over the sorted strata."""
    from itertools import combinations
    teams = F.array(*[F.lit(";".join(c)) for c in combinations(annotators, overlap)])
    rows = items.withColumn("_h", order_key(seed, item))
    numbered = row_numbers(rows, [stratum, "_h"], F.struct(stratum, hash_chunk(F.col("_h"), 2)), "_k")
    return numbered.withColumn("assigned_to", F.get(teams, ((F.col("_k") - 1) % F.size(teams)).cast("int"))).drop("_h", "_k")


def running_share(df: DataFrame, part: Sequence[str], order: Sequence, chunk: Column, weight: Column) -> DataFrame:
    """Weight that precedes each row."""
    return prefix_sums(df, part, order, chunk, {"before": weight})
