"""Embedding near-dedup: an exact metric range join over cells around pivot vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import materialise, pack, spread
from kerbline.llm.components import components

ADDED = ["n_links", "component_id", "kept"]
SLACK = 1e-9                    # of distances, beyond rounding; it only adds replicas


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def joined_labels(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label reachable over the mask's links; rows with the same label on the left already belong together."""
    _, group = np.unique(left, return_inverse=True)
    big = np.iinfo(np.int64).max
    while True:
        low_r = np.minimum(right, np.where(mask, left[:, None], big).min(axis=0, initial=big))
        low_l = np.minimum(left, np.where(mask, low_r[None, :], big).min(axis=1, initial=big))
        low = np.full(group.max(initial=-1) + 1, big)
        np.minimum.at(low, group, low_l)
        if (low[group] == left).all() and (low_r == right).all():
            return left, right
        left, right = low[group], low_r


class Cell:
    """A block of a cell's own vectors, against which the others stream."""

    def __init__(self, rep, copies, vectors, least):
        self.rep, self.copies, self.unit, self.least = rep, copies, unit(vectors), least
        mask = self.unit @ self.unit.T >= least
        np.fill_diagonal(mask, False)
        self.links = mask @ copies
        self.label = joined_labels(mask, rep, rep)[0]

    def meet(self, rep, copies, vectors):
        mask = self.unit @ unit(vectors).T >= self.least
        hit, own = mask.any(axis=0), mask.any(axis=1)
        self.links = self.links + mask @ copies
        if not hit.any():
            return rep[:0], copies[:0], rep[:0]
        small = mask[np.ix_(own, hit)]
        new, other = joined_labels(small, self.label[own], rep[hit])
        before, first = np.unique(self.label[own], return_index=True)
        fell = new[first] < before                                             # rows already sent with the old label follow it to the new one
        at = np.minimum(np.searchsorted(before, self.label), len(before) - 1)
        self.label = np.where(before[at] == self.label, new[first][at], self.label)     # a label that fell falls for all rows that have it
        return np.append(rep[hit], before[fell]), np.append((self.copies @ mask)[hit], np.zeros(fell.sum(), dtype=np.int64)), np.append(other, new[first][fell])


def range_join(vectors: DataFrame, least: float = 0.9, cell_rows: int = 4096, most_pivots: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The input with ``n_links`` (other rows of cosine ``least`` or more), ``component_id`` (smallest id reachable over links) and ``kept`` (its id is that).

    Equal vectors are one class with a count. On the unit sphere the cosine's limit is a distance e. Every class lives in the cell of its nearest pivot; by the triangle
    inequality a partner in the cell of pivot c can only exist if (d(x, c)^2 - d(x, home)^2) / (2 d(c, home)) <= e, and only then x is copied there. A pair of
    two cells is compared in the first of them alone, cells join independently, and a cell of more than ``cell_rows`` classes is worked off in blocks against which the others
    stream, so no task holds more than a block and a batch. Cells return counts and a spanning set of links, never pairs: labels, and where a label falls, its link to the new one.

    Pivots are the classes with the smallest hashes, one per ``cell_rows`` of them and ``most_pivots`` at most: that bounds what is broadcast. Where vectors have
    no clusters, the inequality excludes little and a class is copied to many cells; nothing is lost.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, and vectors of different lengths don't link. Rows with a null id do not
    take part, have no links, a null component and are kept. Rows that share an id count one by one. Input columns named like an added one are replaced.
    """
    spark, reach = vectors.sparkSession, math.sqrt(max(0.0, 2.0 - 2.0 * least)) + SLACK
    name = F.struct(F.xxhash64("_v").alias("a"), F.xxhash64(F.lit("second"), "_v").alias("b"))
    fit = F.coalesce(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0), F.lit(False))
    work = pack(vectors, ADDED, _id=id_col, _v=vector_col).select("_row", F.col("_id").cast("long").alias("_id"), F.col("_v").cast("array<double>").alias("_v"))
    work = work.withColumn("_key", F.when(fit & F.col("_id").isNotNull(), name))
    classes = materialise(work.where("_key is not null").groupBy("_key").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("_v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    n, pivots = classes.count(), {}
    for dim, v in classes.select("dim", "v", "_key").orderBy(F.xxhash64("_key"), "_key").limit(min(most_pivots, -(-n // cell_rows))).select("dim", "v").collect():
        pivots.setdefault(dim, []).append(v)
    pivots = {d: unit(np.array(v)) for d, v in pivots.items()}

    def placed(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == d))
                p = pivots.get(d)
                if p is None:                                                  # a length without a pivot is one cell
                    row, cell, home = np.arange(some.num_rows), np.zeros(some.num_rows, dtype=np.int64), np.ones(some.num_rows, dtype=bool)
                else:
                    square = np.maximum(2.0 - 2.0 * (unit(matrix(some.column("v"))) @ p.T), 0.0)
                    first = square.argmin(axis=1)
                    apart = np.sqrt(np.maximum(2.0 - 2.0 * (p @ p.T), 0.0))[first]
                    near = (square - square[np.arange(len(first)), first][:, None]) <= 2.0 * reach * apart + SLACK
                    near &= np.arange(len(p))[None, :] < first[:, None]
                    near[np.arange(len(first)), first] = True
                    row, cell = np.nonzero(near)
                    home = cell == first[row]
                take = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home), take.column("rep"), take.column("copies"), take.column("v"), take.column("dim")],
                                                 names=["cell", "home", "rep", "copies", "v", "dim"])

    spots = classes.select("rep", "copies", "v", "dim").mapInArrow(placed, "cell int, home boolean, rep long, copies long, v array<double>, dim int")
    spots = materialise(spots, "cells")
    size = spots.where("home").groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int").alias("_blocks"))
    sent = spots.join(size, ["dim", "cell"]).withColumn("_own", F.when(F.col("home"), F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")).otherwise(F.col("_blocks") - 1))
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), "_own"))).withColumn("other", ~F.col("home") | (F.col("block") != F.col("_own")))
    key = ["dim", "cell", "block"]

    def compare(batches):
        at, own, cell = None, [], None

        def result(rep, n, label):
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.asarray(n, dtype=np.int64)), pa.array(label)], names=["rep", "n", "label"])

        def opened():
            both = pa.concat_batches(own)
            return Cell(both.column("rep").to_numpy(), both.column("copies").to_numpy(), matrix(both.column("v")), least)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in key] + [batch.column("other").to_numpy(zero_copy_only=False).astype(np.int32)], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                part = batch.slice(lo, hi - lo)
                if tuple(keys[lo][:3]) != at:
                    if own:
                        cell = cell or opened()
                        yield result(cell.rep, cell.links, cell.label)
                    at, own, cell = tuple(keys[lo][:3]), [], None
                if not keys[lo][3]:
                    own.append(part)
                elif own:
                    cell = cell or opened()
                    for k in range(0, part.num_rows, 2048):
                        piece = part.slice(k, 2048)
                        yield result(*cell.meet(piece.column("rep").to_numpy(), piece.column("copies").to_numpy(), matrix(piece.column("v"))))
        if own:
            cell = cell or opened()
            yield result(cell.rep, cell.links, cell.label)

    met = materialise(sent.select(*key, "other", "rep", "copies", "v").repartition(spread(spark), *key).sortWithinPartitions(*key, "other").mapInArrow(compare, "rep long, n long, label long"), "met")
    label = components(met.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    counts = met.groupBy(F.col("rep").alias("_r")).agg(F.sum("n").alias("_n"))
    known = (classes.join(counts, F.col("rep") == F.col("_r"), "left").join(label, F.col("rep") == F.col("id"), "left")
             .select(F.col("_key").alias("_k"), (F.col("copies") - 1 + F.coalesce("_n", F.lit(0))).alias("_links"), F.coalesce("component", "rep").alias("_c")))
    out = work.join(known, F.col("_key") == F.col("_k"), "left")
    c = F.coalesce("_c", "_id")
    return out.select("_row.*", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(c == F.col("_id"), F.lit(True)).alias("kept"))
