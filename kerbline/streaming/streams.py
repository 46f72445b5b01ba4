"""Streaming forms: new measurement files are graded, sessions and hourly counts kept up, re-uploads dropped.

Every function maps a streaming DataFrame to a streaming DataFrame; ``drain`` runs what has arrived into a table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from kerbline.storage import new_folder


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder)


def score(stream: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Grade each arriving row with the batch expressions; stateless."""
    return stream.withColumns(columns)


def sessions(stream: DataFrame, key: Sequence[str], ts: str, gap: str, late: str) -> DataFrame:
    """Capture sessions per key, closed once the watermark has passed their gap."""
    s = stream.withWatermark(ts, late).groupBy(*key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("frames"))
    return s.select(*key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "frames")


def counts(stream: DataFrame, by: Sequence[str], ts: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows per time window and key: tumbling, or sliding with ``slide``."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    c = stream.withWatermark(ts, late).groupBy(*by, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return c.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def drop_repeats(stream: DataFrame, content: Column, ts: str, late: str) -> DataFrame:
    """First upload of each content; state is kept for the watermark's span only."""
    return stream.withColumn("content_md5", F.md5(content)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_md5"])


def enrich(stream: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach a static table (registry, cut-offs)."""
    return stream.join(dimension, list(on), "left")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything that has arrived and read the result table back. Table and checkpoint live in the shared folder."""
    spark = stream.sparkSession
    out, mark = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def late_rows(stream: DataFrame, key: Sequence[str], ts: str, late: str, name: str) -> tuple[DataFrame, int]:
    """The rows that arrive in time, once each, and how many came after the watermark had passed them, as the query's progress reports.

    The watermark follows ``late`` behind the newest row of a micro-batch and drops rows from the second micro-batch after it on; a batch run over all rows has what was dropped here too.
    """
    spark = stream.sparkSession
    out, mark = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")
    timely = stream.withWatermark(ts, late).dropDuplicates([*key, ts])
    q = timely.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(out), dropped


#: Keys of asof_drive meet in this many groups of state, so calls and rows of state don't grow with the keys; a checkpoint holds for one number only.
GROUPS = 1 << 12


def _text(of: Column, kind: T.DataType) -> Column:
    """A key's value as text that ``_value`` turns back; equal values have equal texts."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError("a key is no plain value")
    if isinstance(kind, T.BinaryType):
        return F.hex(of)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(of).cast("string")
    return (of + F.lit(0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else of).cast("string")            # no zero keeps a sign


def _value(text: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    return F.timestamp_micros(F.col(text).cast("long")) if isinstance(kind, T.TimestampType) else F.col(text).cast(kind)


def asof_drive(frames: DataFrame, starts: DataFrame, key: Sequence[str], ts: str, frame_id: str, start_id: str, late: str, name: str, groups: int = GROUPS) -> DataFrame:
    """key..., ``ts``, ``frame_id``, ``name``: the latest drive start at or before every frame, of two streams with the columns key, ``ts`` and a whole-number id.

    Both streams meet by key in state: frames wait until the watermark, ``late`` behind the newest row of either, has passed them, so starts that arrive out of order within that span count as in
    a batch join; then they are given out. A key keeps its waiting frames, the starts the watermark has not passed, and the last one before. Rows older than the watermark are dropped. A
    frame before every start has a null; of starts at the same time the largest id counts. Rows without an id or a time take no part. Keys are plain values, nulls a key of their own. They share the
    state in ``groups`` parts by their hash: a part's rows are sorted by key and time and served at once, so a key alone costs no call.
    """
    texts = [f"_k{i}" for i in range(len(key))]
    kinds = [f.dataType for f in frames.select(*key).unionByName(starts.select(*key)).schema]

    def narrow(df, number, start):
        named = [_text(F.col(k).cast(kind), kind).alias(x) for k, kind, x in zip(key, kinds, texts, strict=True)]
        return df.select(*named, ts, F.unix_micros(ts).alias("_us"), F.col(number).cast("long").alias("_id"), F.lit(start).alias("_start"))

    rows = narrow(frames, frame_id, False).unionByName(narrow(starts, start_id, True)).where(F.col("_id").isNotNull() & F.col(ts).isNotNull())
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(*texts), F.lit(groups)))
    kept = pa.schema([*[(x, pa.string()) for x in texts], ("_us", pa.int64()), ("_id", pa.int64()), ("_start", pa.bool_())])

    def advance(_, chunks, state):
        parts = [pa.ipc.open_stream(state.get[0]).read_all()] if state.exists else []
        table = pa.concat_tables(parts + [pa.Table.from_pandas(c[kept.names], schema=kept, preserve_index=False) for c in chunks])
        if not len(table):
            return
        us, number, start = (table[x].to_numpy() for x in ("_us", "_id", "_start"))
        code = np.zeros(len(us), dtype=np.int64)
        for x in texts:
            own = table[x].combine_chunks().dictionary_encode()
            code = np.unique(code * (len(own.dictionary) + 1) + own.indices.fill_null(len(own.dictionary)).to_numpy(), return_inverse=True)[1]
        order = np.lexsort((number, ~start, us, code))                         # a key's starts come before the frames of the same time
        us, number, start, code = us[order], number[order], start[order], code[order]
        mark = state.getCurrentWatermarkMs() * 1000
        passed = us < mark
        ready = np.flatnonzero(passed & ~start)
        if len(ready):
            last = np.maximum.accumulate(np.where(start, np.arange(len(us)), -1))[ready]
            found = (last >= 0) & (code[last] == code[ready])
            given = table.select(texts).take(order[ready]).to_pandas()
            yield given.assign(**{"_us": us[ready], frame_id: number[ready], name: pd.arrays.IntegerArray(np.where(found, number[last], 0), ~found)})
        before = np.flatnonzero(passed & start)
        newest = before[np.append(code[before][1:] != code[before][:-1], True)] if len(before) else before
        left = np.union1d(np.flatnonzero(~passed), newest)
        if len(left):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_table(table.take(order[left]).combine_chunks())
            state.update((sink.getvalue().to_pybytes(),))
        elif state.exists:
            state.remove()
        waiting = us[~passed & ~start]
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting.min()) // 1000, state.getCurrentWatermarkMs() + 1))

    out = ", ".join([f"{x} string" for x in texts] + ["_us long", f"`{frame_id}` long", f"`{name}` long"])
    joined = rows.withWatermark(ts, late).groupBy("_group").applyInPandasWithState(advance, out, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    return joined.select(*[_value(x, kind).alias(k) for k, kind, x in zip(key, kinds, texts, strict=True)], F.timestamp_micros("_us").alias(ts), frame_id, name)
