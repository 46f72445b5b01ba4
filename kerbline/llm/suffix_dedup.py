"""Suffix dedup: bytes of long strings that occur earlier in the corpus are removed.

Only suffixes up to a fixed depth matter, so instead of a difference cover of residues (two thirds of all positions) the sample is a cover by content: of
the grams inside a string of full length the smallest is sampled, and two equal strings have it at the same place. Sampled places get names and are sorted;
places whose name is unique are settled; where a name repeats, it is refined by what surrounds it, and only names that stay ambiguous recurse to the byte level, where
the remaining suffixes are merged through (distance to the sampled place, name) and neighbours of the sorted order are compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import materialise, pack, small, spread
from kerbline.llm.flat import BYTE, between, prefix_hash, ragged, slices

ADDED = ["n_bytes", "n_removed", "n_spans", "kept"]
GRAM = 32                       # bytes of a sampled gram
#: A table of so many numbers may be broadcast.
BROADCAST_NUMBERS = 200_000


def sampled(codes: np.ndarray, stop: np.ndarray, length: int):
    """Doc number, sampled place, first and last start of the strings of ``length`` bytes it stands for, its name and the name of all these strings together.

    ``codes`` are the bytes of several documents, which end at ``stop``. Of equal grams the leftmost is taken.
    """
    prefix = prefix_hash(BYTE[codes])
    n, width = len(codes), length - GRAM + 1
    if n < length:
        return (np.zeros(0, dtype=np.int64),) * 6
    at = np.arange(n - GRAM + 1)
    gram = between(prefix, at, at + GRAM)
    low, place, span = gram, at, 1
    while span < width:                                                        # minima of ever longer stretches
        step = min(span, width - span)
        later = low[step:] < low[:len(low) - step]
        place = np.where(later, place[step:], place[:len(place) - step])
        low = np.where(later, low[step:], low[:len(low) - step])
        span += step
    doc = np.searchsorted(stop, np.arange(len(place)), side="right")
    good = np.arange(len(place)) + length <= stop[doc]                         # strings do not cross documents
    start = np.flatnonzero(good)
    if not len(start):
        return (np.zeros(0, dtype=np.int64),) * 6
    edge = np.flatnonzero((np.diff(place[start]) != 0) | (np.diff(doc[start]) != 0) | (np.diff(start) != 1)) + 1
    first, last = start[np.append(0, edge)], start[np.append(edge, len(start)) - 1]
    where = place[first]
    around = between(prefix, first, last + length) ^ (where - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return doc[first], where, first, last, gram[where], around


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (the remaining bytes, concatenated).

    A text is its UTF-8 bytes. A byte is removed when a string of ``length`` bytes that covers it also starts earlier: in a smaller id, or earlier in the same document. Overlaps count,
    strings are judged on the input.

    Exact copies of a text are settled first, whatever their number. Sampled places of the others (about two per ``length`` bytes) meet by name in sorted streams
    that hold one place; equal surroundings are settled there, all but their first occurrence going. Of the first occurrences whose name repeats with other surroundings, the bytes around
    are fetched, and their strings are sorted by name, distance and content, where neighbours are compared. A task holds the distinct surroundings of one name at a time. What
    comes back to documents is a list of intervals of their own.

    A null text is empty. A null id comes before all others; rows of one id are documents in the order of a hash of their texts, and equal rows get equal results. Input columns
    named like an added one are replaced. Copies, samples and intervals are written to the shared folder.
    """
    spark = docs.sparkSession
    work = pack(docs, ADDED, _id=id_col, _text=text_col).select("_row", F.col("_id").cast("long").alias("_id"), F.coalesce("_text", F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    ids = materialise(work.select("_id", "_th", F.xxhash64(F.lit("second"), "_text").alias("_tb"), F.octet_length("_text").alias("_size")), "ids").distinct()
    n, distinct, named = ids.agg(F.count(F.lit(1)), F.count_distinct("_id"), F.count("_id")).first()
    if n == distinct == named:
        ids = ids.withColumn("ord", F.col("_id"))
    else:                                                                      # a number that follows (id, hash)
        ids = materialise(ids.orderBy(F.col("_id").asc_nulls_first(), "_th", "_tb").withColumn("ord", F.monotonically_increasing_id()), "order")
    copies = materialise(ids.groupBy("_th", "_tb", "_size").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("copies"), F.min_by("_id", "ord").alias("first_id")), "copies")
    same = [F.col("_id").eqNullSafe(F.col("_oid")), F.col("_th") == F.col("_oth")]
    if n == distinct == named:
        ordered = work.select(F.col("_id").alias("ord"), "_id", "_th", "_text")
    else:
        ordered = work.join(ids.select(F.col("_id").alias("_oid"), F.col("_th").alias("_oth"), "ord"), same).select("ord", "_id", "_th", "_text").dropDuplicates(["ord"])
    again = ids.join(copies.where("copies > 1"), ["_th", "_tb", "_size"]).where("ord <> first").select(F.col("ord").alias("_again"), "_size")
    again = materialise(again, "again")
    n_again = again.count()
    alone = ordered.where(F.octet_length("_text") >= length).join(small(again.select("_again"), n_again), F.col("ord") == F.col("_again"), "left_anti")

    def sample(batches):
        for batch in batches:
            order, texts = batch.column("ord").to_numpy(), batch.column("_text").cast(pa.binary()).to_pylist()
            for lo, hi in slices([len(x) for x in texts], 500_000):
                stop = np.cumsum([len(x) for x in texts[lo:hi]])
                doc, at, first, last, name, around = sampled(np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8), stop, length)
                begin = np.append(0, stop[:-1])[doc]
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(around.view(np.int64)), pa.array(order[lo:hi][doc]), pa.array((at - begin) << 16 | (at - first) << 8 | (at - last))],
                                                 names=["name", "around", "ord", "place"])

    places = alone.select("ord", "_text").mapInArrow(sample, "name long, around long, ord long, place long")
    met = places.repartition(spread(spark), "name").sortWithinPartitions("name", "around", "ord", "place")

    def settle(batches):
        """Rows are settled when an equal surrounding came before, and kept for comparison when the name has several surroundings."""
        keys = ["name", "around", "ord", "place"]
        before, held = None, None                                             # the last row, and the last first occurrence with whether it is known to be one of several
        for batch in batches:
            if not batch.num_rows:
                continue
            name, around, order, place = (batch.column(k).to_numpy() for k in keys)
            new_name = np.append(before is None or name[0] != before[0], name[1:] != name[:-1])
            new = new_name | np.append(before is None or around[0] != before[1], around[1:] != around[:-1])
            before = (name[-1], around[-1])
            gone = np.flatnonzero(~new)
            first = np.flatnonzero(new)
            rows = np.stack([name[first], order[first], place[first], np.zeros(len(first), dtype=np.int64)])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            close = rows[0, 1:] == rows[0, :-1]
            rows[3, 1:] |= close
            rows[3, :-1] |= close
            held, rows = rows[:, -1:], rows[:, :-1]
            rows = rows[:, rows[3] == 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(name[gone], rows[0])), pa.array(np.append(order[gone], rows[1])), pa.array(np.append(place[gone], rows[2])),
                                              pa.array(np.append(np.zeros(len(gone), dtype=bool), np.ones(rows.shape[1], dtype=bool)))], names=["name", "ord", "place", "open"])
        if held is not None and held[3, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2]), pa.array([True])], names=["name", "ord", "place", "open"])

    settled = materialise(met.mapInArrow(settle, "name long, ord long, place long, open boolean"), "settled")
    asked = settled.where("open").groupBy("ord").agg(F.collect_list(F.struct("name", "place")).alias("asked"))
    n_open = settled.where("open").count()
    near = alone.select("ord", "_text").join(small(asked.withColumnRenamed("ord", "_of"), 2 * n_open, BROADCAST_NUMBERS), F.col("ord") == F.col("_of"))

    def fetch(batches):
        for batch in batches:
            for order, text, asked in zip(batch.column("ord").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("asked"), strict=True):
                name, place = asked.values.field("name").to_numpy(), asked.values.field("place").to_numpy()
                at = place >> 16
                first, last = at - (place >> 8 & 255), at - (place & 255)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.full(len(name), order)), pa.array(place), pa.array([text[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], pa.binary())],
                                                 names=["name", "ord", "place", "bytes"])

    def merge(batches):
        """Starts of strings that have an equal before them, as runs [a, b] of one document."""
        def compared(table: pa.Table) -> pa.RecordBatch:
            name, order, place = (table.column(k).to_numpy() for k in ("name", "ord", "place"))
            size = np.array([len(x) for x in table.column("bytes").to_pylist()], dtype=np.int64)
            codes = np.frombuffer(b"".join(table.column("bytes").to_pylist()), dtype=np.uint8)
            base = np.cumsum(size) - size
            prefix = prefix_hash(BYTE[codes])
            starts = size - length + 1                                         # strings of each row
            row = np.repeat(np.arange(len(name)), starts)
            at = ragged(base, starts)
            far = (place[row] >> 8 & 255) - (at - base[row])                   # distance to the sampled place
            content = between(prefix, at, at + length)
            begin = (place[row] >> 16) - far
            rank = np.lexsort((begin, order[row], content, far, name[row]))
            a, b = rank[:-1], rank[1:]
            equal = (name[row[a]] == name[row[b]]) & (far[a] == far[b]) & (content[a] == content[b])
            for lo in range(0, len(a), 8_000):                               # neighbours in the order, byte by byte
                some = np.flatnonzero(equal[lo:lo + 8_000]) + lo
                equal[some] = (codes[at[a[some]][:, None] + np.arange(length)] == codes[at[b[some]][:, None] + np.arange(length)]).all(axis=1)
            gone = np.sort(b[equal])
            cut = np.flatnonzero((np.diff(gone) != 1) | (np.diff(row[gone]) != 0)) + 1
            first, last = gone[np.append(0, cut)] if len(gone) else gone, gone[np.append(cut, len(gone)) - 1] if len(gone) else gone
            return pa.RecordBatch.from_arrays([pa.array(order[row[first]]), pa.array(begin[first]), pa.array(begin[last] + length)], names=["ord", "a", "b"])

        held = []
        for batch in batches:
            name = batch.column("name").to_numpy()
            if held and sum(x.num_rows for x in held) >= 5_000 or not len(name):
                last = held[-1].column("name").to_numpy()[-1] if held else None
                split = int(np.searchsorted(name != last, True)) if held and len(name) and (name != last).any() else None
                if held and split is not None:
                    yield compared(pa.Table.from_batches([*held, batch.slice(0, split)]))
                    held = []
                    batch = batch.slice(split)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield compared(pa.Table.from_batches(held))

    fetched = near.select("ord", "_text", "asked").mapInArrow(fetch, "name long, ord long, place long, bytes binary")
    merged = fetched.repartition(spread(spark), "name").sortWithinPartitions("name").mapInArrow(merge, "ord long, a long, b long")
    at = F.shiftright("place", 16)
    direct = settled.where("not open").select("ord", (at - F.shiftright("place", 8).bitwiseAND(F.lit(255))).alias("a"), (at - F.col("place").bitwiseAND(F.lit(255)) + length).alias("b"))
    whole = again.where(F.col("_size") >= length).select(F.col("_again").alias("ord"), F.lit(0).cast("long").alias("a"), F.col("_size").cast("long").alias("b"))
    cuts = materialise(direct.unionByName(merged).unionByName(whole).groupBy("ord").agg(F.collect_list(F.struct("a", "b")).alias("cuts")), "cuts")
    numbers = cuts.select(F.sum(F.size("cuts"))).first()[0] or 0
    if n == distinct == named:
        final = work.join(small(cuts, 2 * numbers, BROADCAST_NUMBERS), F.col("_id") == F.col("ord"), "left").select("_row", "cuts")
    else:
        keyed = ids.select(F.col("_id").alias("_oid"), F.col("_th").alias("_oth"), "ord").join(cuts, "ord")
        final = work.join(small(keyed, 2 * numbers, BROADCAST_NUMBERS), same, "left").select("_row", "cuts")

    def cut(batches):
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("_row").field(text_col).to_pylist(), batch.column("cuts"), strict=True):
                raw = (text or "").encode()
                if not cuts.is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                delta = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(delta, cuts.values.field("a").to_numpy(), 1)
                np.subtract.at(delta, cuts.values.field("b").to_numpy(), 1)
                stays = np.cumsum(delta[:-1]) == 0
                runs = int(np.count_nonzero(np.diff(np.append(True, stays).astype(np.int8)) == -1))
                out.append((len(raw), int(len(raw) - stays.sum()), runs, np.frombuffer(raw, dtype=np.uint8)[stays].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *[pa.array([x[i] for x in out], pa.int64()) for i in range(3)], pa.array([x[3] for x in out], pa.binary())], names=["_row", *ADDED])

    kinds = [T.StructField("_row", final.schema["_row"].dataType), *[T.StructField(a, T.LongType()) for a in ADDED[:3]], T.StructField("kept", T.BinaryType())]
    return final.mapInArrow(cut, T.StructType(kinds)).select("_row.*", *ADDED)
