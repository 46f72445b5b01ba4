"""Benchmark decontamination: word windows of test items are looked up in every training document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import ascii_lower, materialise, pack, small

#: What lies between words of the contract once A-Z went to lower case, and a word with what lies before it in the text as it is.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$"
ADDED = ["n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated"]


def words(text: Column) -> Column:
    """Words of a text as an array, none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def with_windows(df: DataFrame, array: str, lengths: list[int]) -> DataFrame:
    """Add ``_h<length>``: hashes of all runs of so many words, in order. Hashes of runs of 1, 2, 4, ... words are made of two halves each, and a run of any
    length of at most one of each, so a word is read once."""
    df = df.withColumn("_g1", F.transform(array, lambda w: F.xxhash64(w)))

    def joined(left: str, right: str, by: int) -> Column:
        return F.zip_with(left, F.slice(right, F.lit(by + 1), F.size(right)), lambda x, y: F.xxhash64(x, y))

    step = 1
    while lengths and 2 * step <= max(lengths):
        df, step = df.withColumn(f"_g{2 * step}", joined(f"_g{step}", f"_g{step}", step)), 2 * step
    for k in lengths:
        have, left = 0, k
        while left:
            part = 1 << (left.bit_length() - 1)
            df = df.withColumn(f"_h{k}", joined(f"_h{k}", f"_g{part}", have) if have else F.col(f"_g{part}"))
            have, left = have + part, left - part
        df = df.withColumn(f"_h{k}", F.slice(f"_h{k}", F.lit(1), F.greatest(F.size(array) - k + 1, F.lit(0))))
    return df


def item_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """item, w (the words), len and h of every window of every item; an item of fewer than n words is one window."""
    work = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    size = F.least(F.size("_w"), F.lit(n))
    cut = F.transform(F.sequence(F.lit(0), F.size("_w") - size), lambda i: F.slice("_w", i + 1, size))
    wins = work.select("item", F.explode(cut).alias("w")).distinct()
    hashed = with_windows(wins, "w", list(range(1, n + 1)))
    return hashed.select("item", "w", F.size("w").alias("len"), F.coalesce(*[F.get(f"_h{k}", F.lit(0)) for k in range(n, 0, -1)]).alias("h"))


def contamination(docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """One row per distinct (_id, _th), the id and the hash of the text: n_words, and of those with verified hits n_hit, spans, item_ids and n_items."""
    key = ["_id", "_th"]
    work = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    wins = materialise(item_windows(items, n, item_id, item_text), "windows")
    sizes = {r[0]: r[1] for r in wins.groupBy("len").count().collect()}          # at most n rows
    total, lengths = sum(sizes.values()), sorted(sizes) or [n]
    names = small(wins.select(F.col("len").alias("_l"), F.col("h").alias("_m")).distinct(), total)
    hashed = with_windows(work.select(*key, words(F.col("_text")).alias("_words")), "_words", lengths).withColumn("n_words", F.size("_words"))

    def listed(k: int) -> Column:
        return F.transform(f"_h{k}", lambda h, i: F.struct(F.lit(k).alias("len"), i.alias("pos"), h.alias("h")))

    if len(lengths) == 1:                                                         # the usual case: plain numbers are exploded
        looked = hashed.select(*key, "n_words", F.lit(lengths[0]).alias("len"), F.posexplode(F.concat(F.array(F.lit(None).cast("long")), F.col(f"_h{lengths[0]}"))).alias("pos", "h"))
        looked = looked.withColumn("pos", F.col("pos") - 1)
    else:
        none = F.array(F.struct(F.lit(0).alias("len"), F.lit(0).alias("pos"), F.lit(None).cast("long").alias("h")))
        looked = hashed.select(*key, "n_words", F.explode(F.concat(none, *map(listed, lengths))).alias("_s")).select(*key, "n_words", "_s.*")
    met = looked.join(names, (F.col("len") == F.col("_l")) & (F.col("h") == F.col("_m")), "left").where("h is null or _m is not null")
    base = materialise(met.groupBy(*key, "n_words").agg(F.collect_set(F.when(F.col("_m").isNotNull(), F.struct("pos", "len", "h"))).alias("_found")), "lookups")
    hits = base.where(F.size("_found") > 0).select(F.col("_id").alias("_fid"), F.col("_th").alias("_fth"), "_found")
    on = F.col("_id").eqNullSafe(F.col("_fid")) & F.col("_th").eqNullSafe(F.col("_fth"))
    near = work.join(small(hits, hits.select(F.sum(F.size("_found"))).first()[0] or 0), on).select(*key, words(F.col("_text")).alias("_words"), "_found")
    said = F.transform("_found", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len"), x["h"].alias("h"), F.slice("_words", x["pos"] + 1, x["len"]).alias("w")))
    shown = near.select(*key, F.explode(said).alias("_s")).select(*key, "_s.*")
    true = materialise(shown.join(small(wins.select("len", "h", "w").distinct(), total), ["len", "h", "w"]).distinct(), "hits")
    before = Window.partitionBy(*key).orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("len")
    parts = true.withColumn("_a", F.greatest("pos", F.coalesce(F.max(end).over(before), F.lit(0)))).withColumn("_b", end)
    hit = parts.groupBy(*key).agg(F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("n_hit"),
                                  F.sort_array(F.collect_list(F.when(F.col("_b") > F.col("_a"), F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))))).alias("spans"))
    item = (true.select(*key, "len", "h", "w").distinct().join(small(wins, total), ["len", "h", "w"])
            .groupBy(*key).agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("item_ids"), F.count_distinct("item").alias("n_items")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    got = hit.alias("l").join(item.alias("r"), same).select(F.col("l._id").alias("_fid"), F.col("l._th").alias("_fth"), "n_hit", "spans", "item_ids", "n_items")
    return base.select(*key, "n_words").join(got, on, "left").drop("_fid", "_fth")


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The input with ``n_words``, ``n_hit``, ``n_items``, ``item_ids`` (as strings, sorted), ``spans`` (disjoint word
    ranges [a, b) that items cover) and ``contaminated``.

    The hashes of the items' windows are broadcast when their counted number allows it (otherwise the join shuffles), every window of
    every document is looked up, and each hit is verified word by word on the document's text. A word inside any verified window is hit;
    a document is contaminated when hits are at least ``share`` of its words.

    Null or empty texts have no words and are clean; items without words match nothing. Rows with the same id are told apart
    by their text, equal rows get equal results. Input columns named like an added one are replaced. Lookups, hits and the items' windows
    are written to the shared folder while the plan is built.
    """
    found = contamination(docs, items, n, id_col, text_col, item_id, item_text).select(F.col("_id").alias("_fid"), F.col("_th").alias("_fth"), *[c for c in ADDED if c != "contaminated"])
    work = pack(docs, ADDED, _id=id_col, _text=text_col).select("_row", "_id", F.xxhash64("_text").alias("_th"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return work.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & F.col("_th").eqNullSafe(F.col("_fth"))).select(
        "_row.*", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"),
        ((n_hit > 0) & (n_hit >= F.lit(share) * F.col("n_words"))).alias("contaminated"))


def without_spans(marked: DataFrame, text_col: str = "text") -> DataFrame:
    """The result of ``decontaminate`` with every hit word, and what separates it from the word before, cut from the text."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(PIECE), 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists("spans", lambda s: (i >= s["a"]) & (i < s["b"])))
    return marked.withColumn(text_col, F.when(F.size("spans") == 0, F.col(text_col)).otherwise(F.array_join(kept, "")))
