"""Ranked lexical search: bit-sliced Bloom signatures bound every document's score, and documents that the bounds don't exclude are scored exactly."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import materialise, small
from kerbline.llm.flat import BASE, BYTE, M1, between, mixed, prefix_hash, ragged

#: Bytes of terms in UTF-8, digits, ASCII letters and all of other characters.
TERM = np.isin(np.arange(256), [*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)])
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
PIECE_BYTES = 1 << 20
#: Signatures: a document holds a term, holds it at least so often; bits of a signature for each of these facts, bitmaps they set, most bitmaps of a block.
LEVELS = (1, 2, 4)
FACT_BITS, FACT_ROWS, MOST_BITMAPS = 16, 3, 1 << 18
#: Blocks: most documents, most distinct terms in sum, and what a task gathers before it sorts documents by size.
BLOCK_DOCS, BLOCK_TERMS, GATHER_TERMS = 2048, 1 << 16, 1 << 18
#: A row of the index may take megabytes, so its files are checked at every row, not at every hundredth, for a full page or row group: writers and readers hold one such group and one row more.
GROUP_BYTES = 4 << 20
STORED = "docs long, terms long, ids array<long>, n binary, ends binary, hash binary, tf binary, bitmaps int, signature binary"


def pieces(texts: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(number of the text, part of it); long texts are cut between terms."""
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            cut = BREAK.search(text, at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else None
            end = cut.start() if cut else len(text)
            yield i, text[at:end]
            at = end


def counted(owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of tf by owner and term, in order of both."""
    if not len(term):
        return owner, term, tf
    order = np.lexsort((term, owner))
    owner, term, tf = owner[order], term[order], tf[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])]))
    return owner[first], term[first], np.add.reduceat(tf, first)


def term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash of the term, occurrences), in order, of all texts."""
    found, held, size = [], [], 0

    def count_held():
        raw = b" " + b" ".join(p for _, p in held) + b" "
        codes = np.frombuffer(raw.lower(), dtype=np.uint8)
        edge = np.diff(TERM[codes].astype(np.int8))
        start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        begin = np.cumsum([1] + [len(p) + 1 for _, p in held])
        owner = np.array([i for i, _ in held])[np.searchsorted(begin, start, side="right") - 1]
        found.append(counted(owner, between(prefix_hash(BYTE[codes]), start, end), np.ones(len(start), dtype=np.int64)))

    for piece in pieces((t or "").encode() for t in texts):
        held.append(piece)
        size += len(piece[1])
        if size >= PIECE_BYTES:
            count_held()
            held, size = [], 0
    if held:
        count_held()
    none = np.zeros(0, dtype=np.int64)
    return counted(*(np.concatenate([none.astype(k), *x]) for k, x in zip(("i8", "u8", "i8"), zip(*found, strict=True) if found else [[]] * 3, strict=True)))


def places(term: np.ndarray, level: int, bitmaps: int) -> np.ndarray:
    """The bitmaps, FACT_ROWS for each term, that stand for the fact that a document holds it LEVELS[level] times."""
    salt = np.arange(1, FACT_ROWS + 1, dtype=np.uint64) * np.uint64(BASE) + np.array([level], dtype=np.uint64) * M1
    return (mixed(term[:, None] + salt[None, :]) % np.uint64(bitmaps)).astype(np.int64)


def signature(owner: np.ndarray, term: np.ndarray, tf: np.ndarray, docs: int) -> np.ndarray:
    """Bit-sliced signatures of a block: one bitmap over its documents per row."""
    facts = np.bincount(owner, weights=sum((tf >= x).astype(np.int64) for x in LEVELS), minlength=docs)
    bitmaps = int(min(max(64, FACT_BITS * facts.max(initial=0)), MOST_BITMAPS))
    bits = np.zeros((bitmaps, -(-docs // 64) * 64), dtype=np.uint8)
    for level, least in enumerate(LEVELS):
        some = tf >= least
        bits[places(term[some], level, bitmaps), owner[some][:, None]] = 1
    return np.packbits(bits, axis=1, bitorder="little")


def index_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per block of documents of like size: ids, lengths, counted terms and the signatures. Blocks are made inside the tasks that read the texts."""
    def blocks(ids, nulls, owner, term, tf):
        size = np.bincount(owner, minlength=len(ids))
        ends = np.cumsum(size)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        at = 0
        while at < len(order):
            room = np.searchsorted(np.cumsum(size[order[at:at + BLOCK_DOCS]]), BLOCK_TERMS, side="right")
            alike = np.searchsorted(size[order[at:at + BLOCK_DOCS]], 2 * size[order[at]] + 16, side="right")
            own = order[at:at + max(1, min(int(room), int(alike)))]
            at += len(own)
            where = ragged((ends - size)[own], size[own])
            who = np.repeat(np.arange(len(own)), size[own])
            n = np.bincount(who, weights=tf[where]).astype(np.int64)
            sig = signature(who, term[where], tf[where], len(own))
            yield pa.RecordBatch.from_pydict({
                "docs": pa.array([len(own)], pa.int64()), "terms": pa.array([int(n.sum())], pa.int64()),
                "ids": pa.array([[None if nulls[i] else int(ids[i]) for i in own.tolist()]], pa.list_(pa.int64())), "n": [n.tobytes()], "ends": [np.cumsum(size[own]).tobytes()],
                "hash": [term[where].tobytes()], "tf": [tf[where].astype(np.uint32).tobytes()], "bitmaps": pa.array([len(sig)], pa.int32()), "signature": [sig.tobytes()]})

    def read(batches):
        held, docs_held, terms_held = [], 0, 0

        def flush():
            base = np.cumsum([0] + [len(h[0]) for h in held])
            ids, nulls = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            yield from blocks(ids, nulls, np.concatenate([h[2] + b for h, b in zip(held, base, strict=False)]), *(np.concatenate([h[k] for h in held]) for k in (3, 4)))

        for batch in batches:
            text, ids = batch.column("_text"), batch.column("_id")
            size = np.frombuffer(pc.binary_length(text).fill_null(0).cast(pa.int64()).buffers()[1], dtype=np.int64)[:batch.num_rows]
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // PIECE_BYTES)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if hi > lo:
                    part = ids.slice(lo, hi - lo)
                    held.append((part.fill_null((1 << 63) - 1).to_numpy(), part.is_null().to_numpy(zero_copy_only=False), *term_counts(text.slice(lo, hi - lo).to_pylist())))
                    docs_held, terms_held = docs_held + hi - lo, terms_held + len(held[-1][2])
                if terms_held >= GATHER_TERMS or docs_held >= 8 * BLOCK_DOCS:
                    yield from flush()
                    held, docs_held, terms_held = [], 0, 0
        if held:
            yield from flush()

    work = docs.select(docs[f"`{id_col}`"].cast("long").alias("_id"), docs[f"`{text_col}`"].cast("string").alias("_text"))
    checked = {f"parquet.page.size.row.check.{which}": 1 for which in ("min", "max")}
    return materialise(work.mapInArrow(read, STORED), "signatures", **checked | {"parquet.block.size": GROUP_BYTES})


def exact(docs: np.ndarray, term: np.ndarray, weight: np.ndarray, ends: np.ndarray, hashes: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of documents of a block for an item's terms: all of its terms are looked up at once in the documents' sorted terms."""
    start = np.concatenate([[0], ends[:-1]])[docs]
    low, high = np.repeat(start[:, None], len(term), axis=1), np.repeat(ends[docs][:, None], len(term), axis=1)
    stop = high.copy()
    while (low < high).any():
        mid = (low + high) >> 1
        less = (hashes[np.minimum(mid, len(hashes) - 1)] < term[None, :]) & (low < high)
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    at = np.minimum(low, len(hashes) - 1)
    times = np.where((low < stop) & (hashes[at] == term[None, :]), tf[at], 0).astype(np.int64)
    return (weight * ((1_000_000_000 * times) // (1000 * times + 8 * m[docs][:, None]))).sum(axis=1)


class Best:
    """The k best documents of an item so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) >= self.k else 1

    def add(self, score, ids, nulls):
        some = score >= self.least()
        score, ids, nulls = (np.concatenate(x) for x in ((self.score, score[some]), (self.id, ids[some]), (self.null, nulls[some])))
        order = np.lexsort((ids, nulls, -score))[:self.k]
        self.score, self.id, self.null = score[order], ids[order], nulls[order]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, chunk_terms: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for every row of ``items`` the k documents with the largest scores above 0.

    Terms are runs of ASCII letters and digits and other characters beyond ASCII, A-Z in lower case. With N documents that have terms, L terms in all, n terms in a document, df documents that
    hold a term and tf its occurrences, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document has m = 10 + (90 n N) div L, and its score sums
    w ((10^9 tf) div (1000 tf + 8 m)) over an item's distinct terms.

    The index is made where texts are read: blocks of documents of like size, each with its documents' counted terms and a bit-sliced Bloom signature, bitmaps over the
    block's documents for the facts that a document holds a term once, twice, four times or more. A fact's bitmaps and-ed overestimate the documents it holds for. The
    sum of such bitmaps, each weighted with what its fact adds at most in a document as short as the block's shortest, bounds every score from above. Documents whose bound is below
    the item's k-th score so far are excluded; all others are scored exactly from their counted terms. Each task returns at most k documents an item, and the best of these are kept.

    Items are read in chunks of about ``chunk_terms`` terms, each one more pass over the index, so what goes to the driver and the tasks is bounded. Terms are told apart by 64-bit hashes of
    their bytes.

    Null and empty texts and texts without a term are no documents and find nothing. Equal scores go to the smaller id, null ids last. Documents that share an id count one by one, and
    so do repeated items. Very long texts are counted piece by piece, and one whose signature would pass 262,144 bitmaps merely gets a weaker bound. Fewer than k documents above 0 give fewer rows, an
    empty table none.
    """
    number = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("terms", T.ArrayType(T.LongType()))])

    def parsed(batches):
        for batch in batches:
            owner, term, _ = term_counts(batch.column("_text").to_pylist())
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(term.view(np.int64)))], names=["item_id", "terms"])

    asked = items.select(items[f"`{item_id}`"].alias("item_id"), items[f"`{item_text}`"].cast("string").alias("_text")).mapInArrow(parsed, number)
    asked = materialise(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    index = index_of(docs, id_col, text_col)
    total, many = index.agg(F.sum("docs"), F.sum("terms")).first()
    n_items, n_terms = asked.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    chunks = max(1, -(-(n_terms or 0) // chunk_terms))
    found = None
    for c in range(chunks):
        rows = asked.where((F.pmod(F.xxhash64("item"), F.lit(chunks)) == c) & (F.size("terms") > 0)).select("item", "terms").collect()
        part = best_of_chunk(index, {r["item"]: np.array(r["terms"], dtype=np.int64).view(np.uint64) for r in rows}, total or 0, many or 0, k)
        found = part if found is None else found.unionByName(part)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    return best.join(small(asked.select("item", "item_id"), n_items), "item").select("item_id", "rank", "doc_id", "score")


def best_of_chunk(index: DataFrame, items: dict[int, np.ndarray], total: int, many: int, k: int) -> DataFrame:
    """item, doc_id, score: at most k of each item from every task."""
    every = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *items.values()]))

    def holders(batches):
        df = np.zeros(len(every), dtype=np.int64)
        for batch in batches:
            for raw in batch.column("hash"):
                have = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                at = np.searchsorted(every, have)
                hit = at < len(every)
                hit[hit] = every[at[hit]] == have[hit]
                df += np.bincount(at[hit], minlength=len(every))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["at", "df"])

    df = np.zeros(len(every), dtype=np.int64)
    for r in index.select("hash").mapInArrow(holders, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():         # one number per term of the chunk
        df[r["at"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) if d else 0 for d in df], dtype=np.int64)
    every_of = {i: (at := np.searchsorted(every, t))[weight[at] > 0] for i, t in items.items()}

    def search(batches):
        best = {i: Best(k) for i in every_of}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                ids, nulls = row["ids"].values.fill_null((1 << 63) - 1).to_numpy(), row["ids"].values.is_null().to_numpy(zero_copy_only=False)
                n, ends, hashes, tf, sig = (np.frombuffer(row[c].as_buffer(), dtype=t) for c, t in (("n", "i8"), ("ends", "i8"), ("hash", "u8"), ("tf", "u4"), ("signature", "u1")))
                bitmaps = row["bitmaps"].as_py()
                sig, m = sig.reshape(bitmaps, -1), 10 + (90 * n * total) // many
                times = np.array([1, 3])
                caps = np.concatenate([[0], (1_000_000_000 * times) // (1000 * times + 8 * m.min()), [1_000_000]])
                facts = [np.bitwise_and.reduce([sig[p] for p in places(every, level, bitmaps).T]) for level in range(len(LEVELS))]
                for i, at in every_of.items():
                    if not len(at):
                        continue
                    bound = sum((weight[at] * gain).astype(np.float64) @ np.unpackbits(held[at], axis=1, count=len(ids), bitorder="little").astype(np.float64)
                                for held, gain in zip(facts, np.diff(caps).tolist(), strict=True)) * (1 + 1e-9)
                    open_docs = np.flatnonzero(bound >= best[i].least())
                    open_docs = open_docs[np.argsort(-bound[open_docs], kind="stable")]
                    done, step = 0, 4 * k
                    while done < len(open_docs) and bound[open_docs[done]] >= best[i].least():
                        some = open_docs[done:done + step]
                        best[i].add(exact(some, every[at], weight[at], ends, hashes, tf, m), ids[some], nulls[some])
                        done, step = done + step, min(4 * step, 1024)
        out = [(i, None if null else d, s) for i, b in best.items() for s, d, null in zip(b.score.tolist(), b.id.tolist(), b.null.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 3)], names=["item", "doc_id", "score"])

    return index.select("ids", "n", "ends", "hash", "tf", "bitmaps", "signature").mapInArrow(search, "item long, doc_id long, score long")
