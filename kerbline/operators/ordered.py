"""Order statistics and running sums without a single-task sort.

A plain ``Window.orderBy`` without partitions sorts the table in one task, and with
partitions it sorts a hot key in one task. Everything here works in two levels instead:
rows fall into chunks that follow the sort order, chunk totals (a small table) give each
chunk its offset, and only the rows of one chunk are sorted together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.hashing import hash_chunk

CHUNKS = 256


def value_chunk(df: DataFrame, value: str, sample: DataFrame, sampled: str, name: str, chunks: int = CHUNKS) -> DataFrame:
    """Add the chunk number (0..chunks-1) of ``value`` by approximate quantiles of ``sample[sampled]``.

    The bounds are one scalar subquery; each row finds its chunk by halving. Results never depend on
    how exact the bounds are, only balance does. ``chunks`` must be a power of two.
    """
    points = [i / chunks for i in range(1, chunks)]
    bounds = sample.agg(F.percentile_approx(F.col(sampled).cast("double"), points, 10 * chunks)).scalar()
    steps = []
    step = chunks // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    target = F.col(value).cast("double")
    chunk = F.aggregate(F.array(*steps), F.lit(0),
                        lambda at, s: F.when(F.get("_bounds", at + s - 1) <= target, at + s).otherwise(at))
    return df.withColumn("_bounds", bounds).withColumn(name, chunk).drop("_bounds")


def prefix_sums(df: DataFrame, part: Sequence[str], order: Sequence, chunk: Column,
                sums: Mapping[str, Column]) -> DataFrame:
    """Add, per name in ``sums``, the sum over all earlier rows of the same ``part`` (0 for the first).

    ``chunk`` must rise with ``order``; ``part`` keys must not be null.
    """
    part = list(part)
    base = df.withColumns({"_chunk": chunk, **{f"_m_{n}": e for n, e in sums.items()}})
    keys = [*part, "_chunk"]
    totals = base.groupBy(*keys).agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}")
                                     for n in sums])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = base.join(offsets, keys, "left")
    return out.select(*df.columns, *[
        (F.coalesce(F.sum(f"_m_{n}").over(within), F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in sums])


def row_numbers(df: DataFrame, order: Sequence, chunk: Column, name: str = "rn",
                part: Sequence[str] = ()) -> DataFrame:
    """1-based position in ``order`` over the whole table (or per ``part``)."""
    out = prefix_sums(df, part, order, chunk, {name: F.lit(1)})
    return out.withColumn(name, F.col(name) + 1)


def hash_cut(groups: DataFrame, key: str, weight: str, target: Column, digits: int = 3) -> Column:
    """Largest md5 ``key`` whose earlier keys weigh less than ``target``, as a scalar column.

    In hash order, ``key <= cut`` keeps adding whole groups until the weight reaches the target, so a row
    is assigned by comparing its own hash: no numbering of rows and no join back to hot groups.
    """
    chunked = groups.select(F.col(key).alias("_k"), F.col(weight).alias("_w"), hash_chunk(F.col(key), digits).alias("_chunk"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = (chunked.groupBy("_chunk").agg(F.sum("_w").alias("_w"))
              .select("_chunk", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_before")))
    last = (placed.where(F.col("_before") < target)
            .agg(F.max(F.struct("_chunk", "_before"))).scalar())
    within = Window.partitionBy("_chunk").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    rows = (chunked.where(F.col("_chunk") == last.getField("_chunk"))
            .withColumn("_before", F.coalesce(F.sum("_w").over(within), F.lit(0)) + last.getField("_before")))
    return rows.where(F.col("_before") < target).agg(F.max("_k")).scalar()


def value_counts(df: DataFrame, group: Sequence[str], value: str, chunks: int = CHUNKS) -> DataFrame:
    """Distinct values per group with ``n`` and ``below`` (rows of the group with a smaller value)."""
    present = df.where(F.col(value).isNotNull())
    counted = present.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    chunked = value_chunk(counted, value, present, value, "_vc", chunks)
    return prefix_sums(chunked, group, [value], F.col("_vc"), {"below": F.col("n")}).drop("_vc")


def percentiles(df: DataFrame, group: Sequence[str], value: str, points: Mapping[str, float],
                chunks: int = CHUNKS, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles per group, one output column per name in ``points``.

    ``weight`` is a column of whole repeat counts, for values that were counted before. Equal values are counted before the shuffle, and only the chunks that hold a wanted rank are sorted.
    """
    group = list(group)
    present = df.where(F.col(value).isNotNull())
    counted = (present.groupBy(*group, F.col(value).cast("double").alias("_v"))
               .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n")).where(F.col("_n") > 0))
    counted = value_chunk(counted, "_v", present, value, "_chunk", chunks)
    keys = [*group, "_chunk"]
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = (counted.groupBy(*keys).agg(F.sum("_n").alias("_cn"))
              .select(*keys, "_cn", F.coalesce(F.sum("_cn").over(earlier), F.lit(0)).alias("_start"),
                      F.sum("_cn").over(Window.partitionBy(*group)).alias("_total")))

    def at(p):
        return (F.col("_total") - 1) * F.lit(float(p))

    holds = F.lit(False)
    for p in points.values():
        for rank in (F.floor(at(p)), F.ceil(at(p))):
            holds = holds | ((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_cn")))
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = (counted.join(placed.where(holds), keys)
            .withColumn("_end", F.sum("_n").over(upto) + F.col("_start"))
            .withColumn("_begin", F.col("_end") - F.col("_n")))
    aggs = [F.max("_total").alias("_total")]
    for name, p in points.items():
        for side, rank in (("lo", F.floor(at(p))), ("hi", F.ceil(at(p)))):
            aggs.append(F.max(F.when((F.col("_begin") <= rank) & (rank < F.col("_end")), F.col("_v"))).alias(f"_{side}_{name}"))
    found = rows.groupBy(*group).agg(*aggs)
    return found.select(*group, *[
        (F.col(f"_lo_{n}") + (at(p) - F.floor(at(p))) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
        for n, p in points.items()])


def carry_last(df: DataFrame, part: Sequence[str], order: str, chunk: Column, value: str, name: str,
               include_current: bool = True) -> DataFrame:
    """Last non-null ``value`` at or before each row (as-of carry), sorted chunk by chunk."""
    part = list(part)
    keys = [*part, "_chunk"]
    base = df.withColumn("_chunk", chunk)
    latest = base.groupBy(*keys).agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_l"))
    earlier = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(*keys, F.last(F.col("_l.v"), ignorenulls=True).over(earlier).alias("_carried"))
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1)
    return base.join(carried, keys, "left").select(
        *df.columns, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("_carried")).alias(name))
