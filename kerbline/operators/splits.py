"""Leakage-safe splits, folds, audits and exact de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.hashing import hash_chunk, order_key
from kerbline.operators.ordered import hash_cut, row_numbers
from kerbline.storage import materialise


def _weights(df: DataFrame, key: Column, per_row: bool) -> DataFrame:
    """One row per group hash, weighing its row count or 1. It is written once, as totals and cuts read it several times."""
    return materialise(df.groupBy(key.alias("h")).agg((F.count(F.lit(1)) if per_row else F.max(F.lit(1))).alias("w")), "hash_groups")


def grouped_split(df: DataFrame, group: Sequence[str], share: float, seed=20260909, name: str = "split") -> DataFrame:
    """Put whole groups (photos) on one side: the first max(1, round(groups * share)) in hash order are test."""
    key = order_key(seed, *group)
    groups = _weights(df, key, per_row=False)
    wanted = groups.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(share)).cast("long"))).scalar()
    cut = hash_cut(groups, "h", "w", wanted)
    return df.withColumn(name, F.when(key <= cut, "test").otherwise("train"))


def fraction_split(df: DataFrame, key: Sequence[str], fractions: Mapping[str, float], rest: str,
                   seed=42, name: str = "split") -> DataFrame:
    """Shuffle rows and cut at floor(n * cumulative fraction); the last part takes the rest."""
    h = order_key(seed, *key)
    rows = _weights(df, h, per_row=True)
    total = rows.agg(F.coalesce(F.sum("w"), F.lit(0))).scalar()
    out, upto = None, 0
    for part, share in fractions.items():
        upto = upto + F.floor(total * F.lit(share))
        hit = h <= hash_cut(rows, "h", "w", upto)
        out = F.when(hit, part) if out is None else out.when(hit, part)
    return df.withColumn(name, out.otherwise(rest))


def cumulative_assignment(df: DataFrame, group: Sequence[str], test: float = 0.2, val: float = 0.1,
                          seed=20260909, name: str = "split") -> DataFrame:
    """Assign whole groups in hash order until test holds its share of rows, then val, then train."""
    key = order_key(seed, *group)
    groups = _weights(df, key, per_row=True)
    total = groups.agg(F.coalesce(F.sum("w"), F.lit(0))).scalar()
    first = hash_cut(groups, "h", "w", total * F.lit(test))
    second = hash_cut(groups, "h", "w", total * F.lit(test + val))
    return df.withColumn(name, F.when(key <= first, "test").when(key <= second, "val").otherwise("train"))


def group_kfold(df: DataFrame, group: str, k: int = 5, repeats: int = 3, seed: int = 20260924) -> DataFrame:
    """Fold of every group per repeat: position in that repeat's shuffle modulo ``k``."""
    groups = (df.select(group).distinct()
              .withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
              .withColumn("_h", order_key(F.lit(seed) + F.col("repeat"), group)))
    numbered = row_numbers(groups, ["_h"], hash_chunk(F.col("_h")), "_rn", part=["repeat"])
    return numbered.select("repeat", group, ((F.col("_rn") - 1) % k).cast("int").alias("fold"))


def audit_splits(df: DataFrame, split: str, photo: str, by: Sequence[str] = ()) -> DataFrame:
    """Photos shared by each pair of splits, and their share of the second split.

    Each photo is reduced to its set of splits (a handful of names) and equal sets are counted, so a photo
    with any number of files costs one row.
    """
    by = list(by)
    sets = df.groupBy(*by, photo).agg(F.sort_array(F.collect_set(split)).alias("sides"))
    patterns = sets.groupBy(*by, "sides").agg(F.count(F.lit(1)).alias("photos"))
    size = patterns.select(*by, F.explode("sides").alias("split_b"), "photos").groupBy(*by, "split_b").agg(
        F.sum("photos").alias("photos_b"))
    pairs = (patterns.where(F.size("sides") > 1)
             .select(*by, "photos", "sides", F.explode("sides").alias("split_a"))
             .select(*by, "photos", "split_a", F.explode(F.filter("sides", lambda s: s > F.col("split_a"))).alias("split_b"))
             .groupBy(*by, "split_a", "split_b").agg(F.sum("photos").alias("shared")))
    return pairs.join(size, [*by, "split_b"]).select(
        *by, "split_a", "split_b", "shared", F.round(F.col("shared") / F.col("photos_b"), 6).alias("share_of_b"))


def pair_fold_exclusion(pairs: DataFrame, folds: DataFrame, a: str, b: str, member: str, fold: str) -> DataFrame:
    """Per pair and fold of either member: test when a member is in the fold; folds holding neither may train.

    ``test_folds`` lists the (one or two) folds a pair tests in; every other fold may train on it.
    """
    fa = folds.select(F.col(member).alias(a), F.col(fold).alias("_fa"))
    fb = folds.select(F.col(member).alias(b), F.col(fold).alias("_fb"))
    return (pairs.join(fa, a).join(fb, b)
            .withColumn("test_folds", F.array_sort(F.array_distinct(F.array("_fa", "_fb"))))
            .drop("_fa", "_fb"))


def exact_dedup(df: DataFrame, content: Column, priority: Column, name: str) -> DataFrame:
    """Mark one keeper per content hash: lowest ``priority``, then first ``name``."""
    marked = df.withColumns({"content_md5": F.md5(content), "_rank": F.struct(priority.alias("p"), F.col(name).alias("n"))})
    keepers = marked.groupBy("content_md5").agg(F.min("_rank").alias("_keep"), F.count(F.lit(1)).alias("copies"))
    return (marked.join(keepers, "content_md5")
            .withColumn("status", F.when(F.col("_rank") == F.col("_keep"), "kept").otherwise("removed_duplicate"))
            .drop("_rank", "_keep"))


def oversample(df: DataFrame, times: Column) -> DataFrame:
    """Repeat each row ``times`` times, numbered from 1 (training lists that weigh added photos)."""
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(1), times.cast("int"))))


def training_union(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Stack the training lists under the role each came from."""
    out = None
    for role, part in parts.items():
        part = part.withColumn("role", F.lit(role))
        out = part if out is None else out.unionByName(part)
    return out


def split_members(df: DataFrame, keys: DataFrame, on: Sequence[str], keep: bool = True) -> DataFrame:
    """Rows inside (or outside) a split's key list."""
    return df.join(keys, list(on), "left_semi" if keep else "left_anti")


def covers(cache: DataFrame, needed: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: how many needed keys the cache lacks and whether it covers all of them."""
    missing = needed.select(*on).distinct().join(cache.select(*on), list(on), "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("missing")).withColumn("covered", F.col("missing") == 0)


def hold_out_runner_up(counts: DataFrame, group: str, n: str) -> Column:
    """The group with the second-largest count (ties by name), as a scalar: it becomes the unseen test group."""
    top = counts.orderBy(F.col(n).desc(), F.col(group)).limit(2)
    return top.agg(F.when(F.count(F.lit(1)) == 2, F.max_by(group, F.struct(-F.col(n), F.col(group))))).scalar()
