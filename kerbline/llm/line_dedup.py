"""Line dedup: lines that many documents share are dropped from all but one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import SPACE, ascii_lower, materialise, name128, pack, small

ADDED = ["n_lines", "n_dropped", "kept_text"]


def line_key(line: Column) -> Column:
    """The line as it is compared: white space stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines are exploded as names of their keys, once per document, and documents are counted per name. A key of at least
    ``min_chars`` code points in at least ``min_docs`` documents loses all its lines except in the document with the largest
    id holding it. Common names meet the lines again, by a broadcast where their number allows it, and a document gets the positions that it loses as one array of
    numbers, so texts are joined once and put together by position inside their row, in time proportional to their lines.

    A null or empty text is one empty line. Rows with a null id count as no document and hold no line back. Rows that share
    an id are one document; repeated rows lose the same lines. A text may have any number of lines. An empty table gives an empty result. Input columns named like an added one are
    replaced.
    """
    work = pack(docs, ADDED, _id=id_col, _text=text_col).withColumn("_th", F.xxhash64("_text")).withColumn("_lines", F.split(F.coalesce("_text", F.lit("")), "\n", -1)).drop("_text")

    def name(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, name128(key))

    named = work.select("_id", "_th", F.posexplode(F.transform("_lines", name)).alias("_pos", "_name")).where("_name IS NOT NULL")
    common = named.select("_id", "_name").distinct().groupBy("_name").agg(F.count("_id").alias("_docs"), F.max("_id").alias("_holder")).where(F.col("_docs") >= min_docs)
    common = materialise(common.select("_name", "_holder"), "common_lines")
    lost = (named.join(small(common, common.count()), "_name").where(~F.col("_id").eqNullSafe(F.col("_holder")))
            .groupBy(F.col("_id").alias("_of"), F.col("_th").alias("_oh")).agg(F.collect_set("_pos").alias("_lost")))
    joined = work.join(lost, F.col("_id").eqNullSafe(F.col("_of")) & F.col("_th").eqNullSafe(F.col("_oh")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    kept = F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(F.transform(left, lambda i: F.get("_lines", i)))
    return joined.withColumn("_kept", kept).select(
        "_row.*", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.array_join("_kept", "\n").alias("kept_text"))
