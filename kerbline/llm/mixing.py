"""Mixing sources to target weights: a splitting tree of exact block quotas, then disjoint draws of permuted blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import NOT_SPACE, materialise, pack

ADDED = ["size", "source_size", "target", "draws"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of the summed sizes by weight; what lies above ``cap`` times a size is shared again by weight until none is above."""
    total, fixed = float(sum(sizes)), {}
    while True:
        left = total - sum(fixed.values())
        base = sum(w for i, w in enumerate(weights) if i not in fixed)
        share = {i: left * w / base for i, w in enumerate(weights) if i not in fixed} if base else {}
        over = [i for i, t in share.items() if t > cap * sizes[i]]
        if not over:
            return [float(fixed.get(i, share.get(i, 0.0))) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def split_quotas(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks per (shard, source): every node of the tree draws its left half's blocks without replacement, so each
    source's quota is met exactly and shards differ in size by one block at most per level."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    nodes = [(0, shards, np.array(counts, dtype=np.int64))]
    while nodes:
        lo, hi, have = nodes.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        take = round(int(have.sum()) * (mid - lo) / (hi - lo))
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, take, method="marginals") if have.sum() else have
        nodes += [(lo, mid, left), (mid, hi, have - left)]
    return out


def mix_draws(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, block_words: int = 20_000, max_blocks: int = 1 << 18, shard_words: int = 20_000_000,
              max_shards: int = 1 << 14, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The input, one row each, with ``size`` (words), ``source_size``, ``target`` (words of its source) and ``draws``: an array of
    (shard, pass, words) with every time that the mix takes the document.

    Sources by code point, null last, take the weights in turn. A source is dealt into blocks by a hash of its rows; a target of k
    times the source is floor(k) passes over all blocks and one part pass, whose last block is cut at the exact word. A tree splits
    the number of blocks of each source among the shards, and each shard takes its quota from the source's permuted blocks, so no block is
    drawn twice in a pass. Only sums by source and by block (at most ``max_blocks`` and one more per source, a bound of the
    broadcast too) are gathered; the hot source is many blocks. Sources are names of a mixing table, whose number fits the driver.

    Null or empty texts have size 0 and are drawn with 0 words. Equal rows share a fate; when the cut falls on them they share its
    words evenly. An empty table gives an empty result. A rerun gives the same draws. Input columns named like an added one are replaced.
    """
    spark = docs.sparkSession
    work = pack(docs, ADDED, _id=id_col, _text=text_col, _source=source_col).select(
        "_row", F.col("_source").cast("string").alias("_source"), word_count(F.col("_text")).alias("_size"), F.xxhash64(F.lit(seed), "_id", "_text").alias("_h"))
    narrow = materialise(work.select("_source", "_size", "_h"), "mix_sizes")
    found = sorted(narrow.groupBy("_source").agg(F.sum("_size")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    names, sizes = [r[0] for r in found], [int(r[1]) for r in found]
    goal, total = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap), sum(sizes)
    most = min(max_blocks, math.ceil(total / block_words)) if total else 1
    n_blocks = [max(1, round(most * s / total)) if total else 1 for s in sizes]
    passes = [min(cap, int(g // s)) if s else 0 for g, s in zip(goal, sizes, strict=True)]
    rest = [round(g) - k * s for g, k, s in zip(goal, passes, sizes, strict=True)]
    plan_type = T.StructType([T.StructField("_i", T.IntegerType()), T.StructField("_s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
                              T.StructField("_n", T.IntegerType()), T.StructField("_passes", T.IntegerType()), T.StructField("_rest", T.LongType())])
    plan = spark.createDataFrame(list(zip(range(len(names)), names, sizes, goal, n_blocks, passes, rest, strict=True)), plan_type)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_block", F.pmod(F.col("_h"), F.col("_n")).cast("int"))

    blocks = materialise(placed(narrow).groupBy("_i", "_block").agg(F.sum("_size").alias("_words")).join(F.broadcast(plan), "_i"), "mix_blocks")
    # the part pass: permuted blocks up to the words that are left, and the block where they end
    order = Window.partitionBy("_i").orderBy(F.xxhash64(F.lit(seed), F.lit("part"), "_block"), "_block")
    part = (blocks.withColumn("_end", F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(order) - 1)
            .withColumn("_room", F.col("_rest") - (F.col("_end") - F.col("_words"))).where("_room > 0"))
    inside = placed(narrow).join(F.broadcast(part.where("_room < _words").select(F.col("_i").alias("_ci"), F.col("_block").alias("_cb"), "_room")),
                                 (F.col("_i") == F.col("_ci")) & (F.col("_block") == F.col("_cb")))
    by_hash = Window.partitionBy("_i").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    cut = (inside.groupBy("_i", "_block", "_room", "_h").agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_same"))
           .withColumn("_room", F.col("_room") - (F.sum("_sum").over(by_hash) - F.col("_sum"))).where("_room > 0 and _room <= _sum")
           .select("_i", "_block", F.col("_h").alias("_cut"), F.floor(F.col("_room") / F.col("_same")).alias("_last")))
    last = part.join(F.broadcast(cut), ["_i", "_block"], "left").select("_i", "_block", F.col("_passes").alias("_pass"), "_rank", "_cut", "_last")
    full = (blocks.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1))) if any(passes) else blocks.withColumn("_pass", F.lit(0))).where("_pass >= 0 and _pass < _passes")
    turn = Window.partitionBy("_i", "_pass").orderBy(F.xxhash64(F.lit(seed), "_pass", "_block"), "_block")
    full = full.withColumn("_rank", F.row_number().over(turn) - 1).select("_i", "_block", "_pass", "_rank", F.lit(None).cast("long").alias("_cut"), F.lit(None).cast("long").alias("_last"))
    drawn = materialise(full.unionByName(last), "mix_draws")
    held = {(r[0], r[1]): r[2] for r in drawn.groupBy("_i", "_pass").count().collect()}
    counts = [sum(held.get((i, p), 0) for p in range(cap + 1)) for i in range(len(names))]
    shards = max(1, min(max_shards, math.ceil(sum(goal) / shard_words)))
    bounds = np.cumsum(split_quotas(counts, shards, seed), axis=0).T if names else np.zeros((0, 0))
    first = [(i, p, sum(held.get((i, q), 0) for q in range(p)), [int(x) for x in bounds[i]]) for i in range(len(names)) for p in range(cap + 1)]
    offset = spark.createDataFrame(first, "_i int, _pass int, _first long, _bounds array<long>")
    place = drawn.join(F.broadcast(offset), ["_i", "_pass"]).withColumn("_shard", F.size(F.filter("_bounds", lambda b: b <= F.col("_rank") + F.col("_first"))))
    per_block = place.groupBy("_i", "_block").agg(F.sort_array(F.collect_list(F.struct("_shard", "_pass", "_cut", "_last"))).alias("_draws")).select(
        F.col("_i").alias("_di"), F.col("_block").alias("_db"), "_draws")
    joined = placed(work).join(F.broadcast(per_block), (F.col("_i") == F.col("_di")) & (F.col("_block") == F.col("_db")), "left")

    def taken(d: Column) -> Column:
        part_of = F.when(F.col("_h") < d["_cut"], F.col("_size")).when(F.col("_h") == d["_cut"], F.least(F.col("_size"), d["_last"])).otherwise(0)
        return F.struct(d["_shard"].alias("shard"), d["_pass"].alias("pass"), F.when(d["_cut"].isNull(), F.col("_size")).otherwise(part_of).cast("long").alias("words"),
                        (d["_cut"].isNull() | (F.col("_h") <= d["_cut"])).alias("_in"))

    draws = F.transform(F.filter(F.transform(F.coalesce("_draws", F.array().cast("array<struct<_shard:int,_pass:int,_cut:bigint,_last:bigint>>")), taken), lambda d: d["_in"]),
                        lambda d: F.struct(d["shard"].alias("shard"), d["pass"].alias("pass"), d["words"].alias("words")))
    return joined.select("_row.*", F.col("_size").alias("size"), "source_size", "target", draws.alias("draws"))


def mix(docs: DataFrame, text_col: str = "text", seed: int = 7, **options) -> DataFrame:
    """The mixed corpus: a row per draw with the input's columns, ``mix_shard``, ``mix_pass``, ``mix_words`` and ``mix_order``, by which each shard is
    shuffled. A text that the last block cuts keeps its first ``mix_words`` words. Draws without words are left out, but for texts that have none.
    """
    own = [c for c in docs.columns if c not in ADDED]
    rows = mix_draws(docs, text_col=text_col, seed=seed, **options).withColumn("_d", F.explode("draws"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + NOT_SPACE), 0), 1, F.col("_d.words").cast("int")), "")
    text = F.when(F.col("_d.words") < F.col("size"), head).otherwise(F.col(text_col))
    out = rows.where("_d.words > 0 or size = 0").select(*[F.col(f"`{c}`") if c != text_col else text.alias(text_col) for c in own],
                                                       F.col("_d.shard").alias("mix_shard"), F.col("_d.pass").alias("mix_pass"), F.col("_d.words").alias("mix_words"))
    return out.withColumn("mix_order", F.xxhash64(F.lit(seed), "mix_shard", "mix_pass", *[F.col(f"`{c}`") for c in own]))


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder per shard, each file in shuffled order; what a shard reads is its own."""
    mixed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)
