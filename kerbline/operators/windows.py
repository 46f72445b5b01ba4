"""Ordered-series operators: capture sessions, ranks, rank correlation, sign changes, percentile of score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.ordered import value_chunk, value_counts, prefix_sums


def neighbours(df: DataFrame, part: Sequence[str], order: str, chunk: Column, value: str, name: str) -> DataFrame:
    """Previous row's ``value`` in ``order``: a lag that crosses chunk borders without sorting a whole key at once."""
    keys = [*part, "_chunk"]
    base = df.withColumn("_chunk", chunk)
    last = base.groupBy(*keys).agg(F.max_by(value, order).alias("_last"))
    carried = last.select(*keys, F.lag("_last").over(Window.partitionBy(*part).orderBy("_chunk")).alias("_carry"))
    inner = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return base.join(carried, keys, "left").select(*df.columns, F.coalesce(inner, F.col("_carry")).alias(name))


def capture_sessions(df: DataFrame, part: Sequence[str], ts: str, gap_seconds: float, chunk_seconds: int = 86400 * 7) -> DataFrame:
    """Session number per ``part`` (from 0): a new one starts when more than ``gap_seconds`` pass."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(at / F.lit(chunk_seconds * 1_000_000))
    stepped = neighbours(df.withColumn("_us", at), part, "_us", slot, "_us", "_prev")
    new = F.when(F.col("_us") - F.col("_prev") > F.lit(int(gap_seconds * 1_000_000)), 1).otherwise(0)
    counted = prefix_sums(stepped.withColumn("_new", new), part, ["_us"], slot, {"_before": F.col("_new")})
    return counted.withColumn("session", F.col("_before") + F.col("_new")).drop("_us", "_prev", "_new", "_before")


def sign_changes(df: DataFrame, part: Sequence[str], order: str, chunk: Column, value: str) -> DataFrame:
    """How often a series changes sign, per ``part``."""
    signed = neighbours(df.withColumn("_s", F.signum(value)), part, order, chunk, "_s", "_p")
    return signed.groupBy(*part).agg(F.sum(F.when(F.col("_s") != F.col("_p"), 1).otherwise(0)).alias("sign_changes"), F.count(F.lit(1)).alias("points"))


def rank_pct(df: DataFrame, value: str, name: str = "rank_pct", group: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value over the number of rows (ties share a rank), per distinct value."""
    ranks = value_counts(df, group, value)
    total = Window.partitionBy(*group) if group else None
    if total is None:
        n = df.where(F.col(value).isNotNull()).agg(F.count(F.lit(1))).scalar()
        return ranks.withColumn(name, (F.col("below") + (F.col("n") + 1) / 2) / n)
    sizes = ranks.groupBy(*group).agg(F.sum("n").alias("_total"))
    return ranks.join(sizes, list(group)).withColumn(name, (F.col("below") + (F.col("n") + 1) / 2) / F.col("_total")).drop("_total")


def spearman(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks.

    Pairs are counted first; the ranks of each side are joined to distinct pairs only, so hot values cost one row.
    """
    group = list(group)
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = both.groupBy(*group, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    mid = lambda d, v, name: value_counts(d, group, v).select(
        *group, F.col(v).alias(f"_{name}"), (F.col("below") + (F.col("n") + 1) / 2).alias(f"r{name}"))
    ranked = pairs.join(mid(both, a, "a"), [*group, "_a"]).join(mid(both, b, "b"), [*group, "_b"])
    return ranked.groupBy(*group).agg(*weighted_corr("ra", "rb", "_n", "rho"), F.sum("_n").alias("n"))


def weighted_corr(x: str, y: str, n: str, name: str) -> list[Column]:
    """Pearson correlation of counted pairs from centred-enough moment sums (ranks and small grids)."""
    s = lambda e: F.sum(e)
    w, cx, cy = F.col(n).cast("double"), F.col(x).cast("double"), F.col(y).cast("double")
    cov = s(w * cx * cy) - s(w * cx) * s(w * cy) / s(w)
    vx = s(w * cx * cx) - s(w * cx) * s(w * cx) / s(w)
    vy = s(w * cy * cy) - s(w * cy) * s(w * cy) / s(w)
    return [F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias(name)]


def percentile_of_score(df: DataFrame, value: str, pool: DataFrame, pool_value: str, name: str = "percentile") -> DataFrame:
    """Share of the pool strictly below each value, by weaving pool counts between the distinct values."""
    asked = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.lit(0).cast("long").alias("_n"))
    held = pool.where(F.col(pool_value).isNotNull()).groupBy(F.col(pool_value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    woven = asked.unionByName(held).groupBy("_v").agg(F.sum("_n").alias("_n"))
    size = pool.agg(F.count(pool_value)).scalar()
    chunked = value_chunk(woven, "_v", pool, pool_value, "_vc")
    below = prefix_sums(chunked, [], ["_v"], F.col("_vc"), {"_below": F.col("_n")})
    return df.join(below.select(F.col("_v").alias(value), (F.col("_below") / F.greatest(size, F.lit(1))).alias(name)), value, "left")
