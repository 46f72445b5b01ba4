"""Exact top-k search by integer inner product over a bit-sliced index of quantised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import materialise

#: Quantised components are held to this size, so that differences, digits and the halves of a score fit into 64 bits.
WIDEST = 1 << 52
#: Most bytes of the 64-bit components of a block while it is sliced.
BLOCK_BYTES = 1 << 25
STORED = "kind int, block int, part int, attr int, base long, bits int, data binary"


def sliced(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least value of every attribute (column), and the slices of what exceeds it: one bitmap over the rows per bit, lowest bit first."""
    base = values.min(axis=0)
    over = values.astype(np.uint64) - base.astype(np.uint64)
    width = [int(m).bit_length() for m in over.max(axis=0)]
    words = -(-len(values) // 64)
    slices = []
    for d, n in enumerate(width):
        bits = (over[:, d][None, :] >> np.arange(n, dtype=np.uint64)[:, None]) & np.uint64(1)
        packed = np.zeros((n, words * 8), dtype=np.uint8)
        packed[:, :-(-len(values) // 8)] = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
        slices.append(packed.view(np.uint64))
    return base, slices


def digits(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the positive and of the negative digits of the shortest signed binary form of each weight."""
    size = np.abs(weight)
    half = size >> 1
    total = size + half
    changed = half ^ total
    up, down = total & changed, half & changed
    return np.where(weight < 0, down, up), np.where(weight < 0, up, down)


def add_up(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Slices of the sum of bitmaps given by weight: three bitmaps of a weight become one of it and a carry of the next."""
    out, carried, w = [], [], 0
    while w < len(columns) or carried:
        rows = np.concatenate([columns[w], *carried]) if w < len(columns) else np.concatenate(carried)
        carried = []
        while len(rows) > 2:
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m:2 * m], rows[2 * m:3 * m]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            rows = np.concatenate([odd ^ c, rows[3 * m:]])
        if len(rows) == 2:
            carried.append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        out.append(rows[0] if len(rows) else None)
        w += 1
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(sums: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the k rows with the largest sums: from the highest slice down, rows are certain, out, or equal so far; of those equal to the end the first are taken."""
    certain, equal = np.zeros_like(alive), alive.copy()
    for s in reversed(sums):
        with_bit = equal & s if s is not None else np.zeros_like(equal)
        n = count(certain) + count(with_bit)
        if n > k:
            equal = with_bit
        else:
            certain |= with_bit
            equal &= ~with_bit
            if n == k:
                return certain
    left = np.flatnonzero(np.unpackbits(equal.view(np.uint8), bitorder="little"))[:k - count(certain)]
    for r in left.tolist():
        certain[r >> 6] |= np.uint64(1 << (r & 63))
    return certain


class Block:
    """Slices of all attributes of a block of rows, which are in order of their ids."""

    def __init__(self, ids: np.ndarray, base: list[int], slices: list[np.ndarray]):
        self.ids, self.base = ids, base
        self.width = [len(s) for s in slices]
        self.attr = np.repeat(np.arange(len(slices)), self.width)
        self.bit = np.concatenate([np.arange(n) for n in self.width]) if slices else np.zeros(0, dtype=np.int64)
        words = -(-len(ids) // 64)
        planes = np.concatenate([*slices, np.zeros((0, words), dtype=np.uint64)])
        self.planes = np.concatenate([planes, ~planes])
        self.all = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)

    def search(self, query: np.ndarray, own: int | None, k: int) -> Iterator[tuple[int, int]]:
        """(id, score) of the k best rows but the query's own."""
        up, down = digits(query)
        constant = sum(int(q) * int(b) for q, b in zip(query, self.base, strict=True))
        constant -= sum(int(n) * ((1 << w) - 1) for n, w in zip(down, self.width, strict=True))
        which, weight = [], []
        for j in range(int((up | down).max(initial=0)).bit_length()):
            for sign, at in ((up, 0), (down, len(self.attr))):                       # a negative digit adds the complement
                hit = np.flatnonzero((sign[self.attr] >> j) & 1)
                which.append(hit + at)
                weight.append(self.bit[hit] + j)
        which, weight = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (which, weight))
        order = np.argsort(weight, kind="stable")
        cuts = np.searchsorted(weight[order], np.arange(1, int(weight.max(initial=-1)) + 1))
        sums = add_up([self.planes[rows] for rows in np.split(which[order], cuts)]) if len(which) else []
        alive = self.all.copy()
        if own is not None:
            alive[own >> 6] &= ~np.uint64(1 << (own & 63))
        for r in np.flatnonzero(np.unpackbits(top_rows(sums, alive, k).view(np.uint8), bitorder="little")).tolist():
            yield int(self.ids[r]), constant + sum(1 << w for w, s in enumerate(sums) if s is not None and (int(s[r >> 6]) >> (r & 63)) & 1)


def top_k(vectors: DataFrame, asked: Column, k: int = 5, scale: float = 256.0, block_rows: int = 4096, chunk_queries: int = 4096,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of every row for which ``asked`` holds, the k rows with the largest inner product, its own row left out.

    A component x counts as floor(scale * x). The index holds blocks of rows; in a block each attribute is a set of slices, bitmaps over its rows, one per bit of what exceeds the
    block's least value. A query adds the slices of all attributes, shifted by the digits of its own components, with bitmap arithmetic (a negative digit adds a complement), and walks
    the slices of the sum from the highest down: rows are certain, out, or equal so far. Rows equal to the last slice have equal scores; the smallest ids are taken. Each block
    gives each query k rows, of which the best k are kept, so results are exact.

    Queries meet blocks in a grid of ``block_rows`` rows by about ``chunk_queries`` queries, so a task holds one block and one chunk of queries whatever the sizes of the tables. Rows
    are dealt to blocks by the hash of id and vector; a block that has far more rows (equal rows) is cut into parts.

    Vectors that are null, empty or hold null or non-finite components, and rows with a null id, neither ask nor are found. Vectors of different lengths have no inner
    product and don't find each other; where ``asked`` is null the row does not ask. Equal scores go to the smaller id. Rows that share an id count one by one: each is found, and each that asks
    has results of its own under the same query_id. Fewer than k partners give fewer rows, an empty table none. Quantised components are held to 52 bits, and a score
    that exceeds 64 bits is ranked exactly and shown as the largest or least long. Vectors may be of any length: a block's rows are bounded in bytes.
    """
    if k < 1:
        raise ValueError("k is 1 or more")
    spark = vectors.sparkSession
    finite = F.coalesce(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("_v") > 0), F.lit(False))
    work = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("_id"), vectors[f"`{vector_col}`"].cast("array<double>").alias("_v"), F.coalesce(asked, F.lit(False)).alias("_asked"))
    work = work.where(F.col("_id").isNotNull() & finite)
    n, longest, queries = work.agg(F.count(F.lit(1)), F.max(F.size("_v")), F.count_if("_asked")).first()
    rows = max(64, min(block_rows, BLOCK_BYTES // (8 * (longest or 1))))
    blocks, chunks = max(1, -(-n // rows)), max(1, -(-queries // chunk_queries))

    def cut(batches):
        held, at, part = [], None, 0

        def block():
            both = pa.concat_batches(held)
            ids, flat = both.column("_id").to_numpy(), both.column("_v").flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):                                          # beyond the largest double it is held to WIDEST all the same
                values = np.clip(np.floor(flat * scale), -float(WIDEST), float(WIDEST)).astype(np.int64).reshape(len(ids), -1)
            base, slices = sliced(values)
            out = [(1, *at[:1], part, -1, 0, 0, ids.tobytes())]
            out += [(1, *at[:1], part, d, int(base[d]), len(s), s.tobytes()) for d, s in enumerate(slices)]
            out += [(0, *at[:1], part, r, int(ids[r]), 0, values[r].tobytes()) for r in np.flatnonzero(both.column("_asked").to_numpy(zero_copy_only=False)).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(),) * 4 + (pa.int64(), pa.int32(), pa.binary()), strict=True)],
                                              names=["kind", "block", "part", "attr", "base", "bits", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column("_block").to_numpy(), batch.column("_dim").to_numpy()], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                key = tuple(keys[lo].tolist())
                if held and (key != at or sum(b.num_rows for b in held) >= 2 * rows):
                    yield block()
                    held, part = [], part + 1 if key[0] == at[0] else 0
                at = key
                for s in range(lo, hi, 2 * rows):
                    if held and s > lo:
                        yield block()
                        held, part = [], part + 1
                    held.append(batch.slice(s, min(hi, s + 2 * rows) - s))
        if held:
            yield block()

    dealt = work.withColumn("_block", F.pmod(F.xxhash64("_id", "_v"), F.lit(blocks)).cast("int")).withColumn("_dim", F.size("_v"))
    index = materialise(dealt.repartition(blocks, "_block").sortWithinPartitions("_block", "_dim", "_id").mapInArrow(cut, STORED), "slices")
    of = [c.name for c in index.schema.fields]
    asking = index.where("kind = 0").select("kind", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to_block"), F.pmod(F.xxhash64("block", "part"), F.lit(chunks)).cast("int").alias("chunk"), *of[1:])
    asked_of = index.where("kind = 1").select("kind", F.col("block").alias("to_block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), *of[1:])

    def search(batches):
        at, queries, head, base, slices = None, [], None, [], []

        def found():
            block = Block(np.frombuffer(head[1], dtype=np.int64), base, slices)
            out = []
            for origin, query_id, query in queries:
                if len(query) == len(base):
                    out += [(*origin, query_id, i, max(-(1 << 63), min((1 << 63) - 1, s)), *divmod(s, 1 << 63)) for i, s in block.search(query, origin[2] if origin[:2] == head[0] else None, k)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, (pa.int32(),) * 3 + (pa.int64(),) * 5, strict=True)],
                                              names=["q_block", "q_part", "q_row", "query_id", "vec_id", "score", "high", "low"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["to_block"], row["chunk"]) != at or (row["kind"] and row["attr"] < 0):
                    if head:
                        yield found()
                    head, base, slices = None, [], []
                if (row["to_block"], row["chunk"]) != at:
                    at, queries = (row["to_block"], row["chunk"]), []
                if not row["kind"]:
                    queries.append(((row["block"], row["part"], row["attr"]), row["base"], np.frombuffer(row["data"], dtype=np.int64)))
                elif row["attr"] < 0:
                    head = ((row["block"], row["part"]), row["data"])
                else:
                    base.append(row["base"])
                    slices.append(np.frombuffer(row["data"], dtype=np.uint64).reshape(row["bits"], -1 if row["bits"] else 0) if row["bits"]
                                  else np.zeros((0, -(-len(head[1]) // 512)), dtype=np.uint64))
        if head:
            yield found()

    grid = asking.unionByName(asked_of).repartition(min(3 * blocks * chunks, 50_000), "to_block", "chunk").sortWithinPartitions("to_block", "chunk", "kind", "part", "attr")
    found = grid.mapInArrow(search, "q_block int, q_part int, q_row int, query_id long, vec_id long, score long, high long, low long")
    best = Window.partitionBy("q_block", "q_part", "q_row").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
