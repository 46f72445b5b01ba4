"""Token files: documents as arrays of token ids, each compressed on its own with a dictionary that all share."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import materialise, new_folder, pack, spread
from kerbline.llm.flat import BYTE, between, prefix_hash, ragged, slices

SPECIAL = re.compile(r"<\|endoftext\|>|[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A word that the vocabulary's pattern never splits: a space at most, then letters.
ONE_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
FRAME = "shard int, dict_hash string, first_token long, doc_ids array<long>, offsets array<int>, n_tokens array<int>, payload binary"


def _cuts() -> np.ndarray:
    """Whether a text may be cut between a byte of class i and one of class j, so that both sides keep their tokens.

    Classes: letter, digit, other ASCII, apostrophe, space, other white space, byte of a longer character. The vocabulary's pattern never
    lets a token run from a character that is no white space into one, from a lone line end into what follows, or over a change between ASCII letters, digits and others; an
    apostrophe may bind the letters after it, a space what follows it, and longer characters are left together with their neighbours.
    """
    letter, digit, other, mark, space, white, high = range(7)
    cut = np.zeros((7, 7), dtype=bool)
    for before in (letter, digit, other, mark, high):
        cut[before, space] = cut[before, white] = True
    for after in (letter, digit, other, mark, high):
        cut[white, after] = True
    for a in (letter, digit, other):
        for b in (letter, digit, other, mark):
            cut[a, b] = (a if a < other else other) != (b if b < other else other)
    return cut


def _classes() -> np.ndarray:
    out = np.full(256, 2, dtype=np.int8)
    for c in range(256):
        ch = chr(c)
        out[c] = 6 if c >= 128 else 0 if ch.isalpha() else 1 if ch.isdigit() else 3 if ch == "'" else 4 if ch == " " else 5 if ch in "\t\n\v\f\r" else 2
    return out


CUT, CLASS = _cuts(), _classes()
#: The printable stand-ins of bytes in byte-level vocabularies.
STAND_IN = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255) for x in range(b))) for b in range(256)}


def is_odd(text: str) -> bool:
    """Whether a text holds what ``SPECIAL`` names; most ASCII texts are told by a few plain searches."""
    return bool(SPECIAL.search(text)) if not text.isascii() else any(x in text for x in ("<|endoftext|>", "\x1c", "\x1d", "\x1e", "\x1f"))


class Encoder:
    """Whole texts to token ids. Equal stretches of a batch are encoded once, and remembered up to a bounded number; then those met least often are forgotten."""

    def __init__(self, path: str, remember: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.ids, self.id_at, self.id_n = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.bytes, self.byte_at = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int32)

    def forget(self) -> None:
        """Keep the stretches met in several slices, half of the bound at most."""
        most = np.argsort(-self.met, kind="stable")[:self.remember // 2]
        kept = np.sort(most[self.met[most] > 1])
        size = np.diff(np.append(self.byte_at, len(self.bytes)))[kept]
        place = np.full(len(self.met), -1, dtype=np.int64)
        place[kept] = np.arange(len(kept))
        there = place[self.row] >= 0
        self.known, self.row = self.known[there], place[self.row[there]]
        self.ids, self.bytes = self.ids[ragged(self.id_at[kept], self.id_n[kept])], self.bytes[ragged(self.byte_at[kept], size)]
        self.id_n, self.met = self.id_n[kept], self.met[kept] // 2
        self.id_at, self.byte_at = np.cumsum(self.id_n) - self.id_n, np.cumsum(size) - size

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Encode stretches not met before."""
        model, out, rest = self.tokenizer.model, [None] * len(chunks), []
        for i, c in enumerate(chunks):
            if ONE_WORD.fullmatch(c):
                out[i] = [t.id for t in model.tokenize(c.decode("latin-1").translate(STAND_IN))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch([chunks[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        n = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        row = np.arange(len(self.id_n), len(self.id_n) + len(out))
        self.id_at = np.concatenate([self.id_at, len(self.ids) + np.cumsum(n) - n])
        self.id_n = np.concatenate([self.id_n, n])
        self.ids = np.concatenate([self.ids, np.fromiter((x for y in out for x in y), dtype=np.int32, count=int(n.sum()))])
        self.byte_at = np.concatenate([self.byte_at, len(self.bytes) + np.cumsum(size) - size])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(chunks), dtype=np.uint8)])
        at = np.searchsorted(self.known, hashes)
        self.known, self.row = np.insert(self.known, at, hashes), np.insert(self.row, at, row)
        self.met = np.append(self.met, np.zeros(len(out), dtype=np.int32))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizer itself gives them for it."""
        odd = [i for i, x in enumerate(texts) if is_odd(x)]
        out: list = [None] * len(texts)
        for i, ids in zip(odd, self.plain([texts[i] for i in odd]), strict=True):
            out[i] = ids
        even = [i for i in range(len(texts)) if out[i] is None]
        for lo, hi in slices([len(texts[i]) + 1 for i in even], 400_000):
            some = even[lo:hi]
            for i, ids in zip(some, self._flat([texts[i].encode() for i in some]), strict=True):
                out[i] = ids if ids is not None else self.plain([texts[i]])[0]
        return out

    def _flat(self, raw: list[bytes]) -> list[np.ndarray | None]:
        codes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        stop = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        if not len(codes):
            return [np.zeros(0, dtype=np.int32)] * len(raw)
        if len(self.known) > self.remember:
            self.forget()
        kind = CLASS[codes]
        begin = np.zeros(len(codes), dtype=bool)
        begin[1:] = CUT[kind[:-1], kind[1:]]
        blank = (kind == 4) | (kind == 5)
        begin[2:] &= ~(blank[1:-1] & blank[:-2])                                  # within and after longer white space nothing is cut
        begin[0] = True
        begin[stop[stop < len(codes)]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(codes))
        hashes, one, inverse = np.unique(between(prefix_hash(BYTE[codes]), start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            text = codes.tobytes()
            self.learn(hashes[new], [text[s:e] for s, e in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
        row = self.row[np.searchsorted(self.known, hashes)]
        self.met[row] += 1
        row = row[inverse]
        same = self.bytes[ragged(self.byte_at[row], end - start)] == codes        # an equal hash of other bytes is found out here
        n = self.id_n[row]
        ids = self.ids[ragged(self.id_at[row], n)]
        text_of = np.searchsorted(stop, start, side="right")
        upto = np.cumsum(np.bincount(text_of, n, len(raw))).astype(np.int64)
        bad = set(np.searchsorted(stop, np.flatnonzero(~same), side="right").tolist())
        return [None if i in bad else ids[(upto[i - 1] if i else 0):upto[i]] for i in range(len(raw))]


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python process: what one task has met serves the next."""
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer_path: str, sample: int, size: int, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary of id arrays from about ``sample`` texts chosen by hash; empty where too few can be had."""
    import zstandard
    n = docs.count()
    if not n:
        return b""
    chosen = docs.where(F.xxhash64(F.lit("dictionary"), id_col) / F.lit(2.0 ** 64) + 0.5 < min(1.0, sample / n)).select(F.coalesce(text_col, F.lit("")).alias("t"))

    def arrays(batches):
        encoder = worker_encoder(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"b": [x.astype("<u2" if x.max(initial=0) < 1 << 16 else "<u4").tobytes() for x in encoder.encode(batch.column("t").to_pylist())]})

    samples = [bytes(r[0]) for r in chosen.mapInArrow(arrays, "b binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def bounds_of(docs: DataFrame, id_col: str, shards: int) -> list[int]:
    """Ids that divide the rows into about equal shards; found from the ids alone."""
    if shards < 2:
        return []
    return sorted({int(x) for x in docs.approxQuantile(id_col, [i / shards for i in range(1, shards)], 0.2 / shards)})


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, dictionary_texts: int = 400, dictionary_bytes: int = 64_000, shards: int | None = None,
                 frame_tokens: int = 400_000, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document's ids and return the shard table (shard, tokens before it, tokens in it).

    Below ``path``: ``dictionary`` (one row: its hash and bytes), ``frames`` and ``index``. Rows of ``frames`` are blocks of consecutive documents in ascending
    id order: the first token's place in its shard, the documents' ids, lengths, offsets into the payload, and the payload, in which every document is a zstandard frame of its own made with the
    shared dictionary, whose hash the row names, so one short document is read by its offset. ``index`` has the first token of every shard.

    The dictionary is trained on about ``dictionary_texts`` texts; this bounded sample changes sizes, never contents. Documents are dealt to shards by id; the bounds come
    from the id column alone, and texts are encoded before the exchange, so only compressed arrays move. Null and empty texts are documents of the end id
    alone. A null id sorts first. Rows that share an id stand side by side, ordered by their ids' bytes.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path, dictionary_texts, dictionary_bytes, id_col, text_col)
    name = f"{zlib.crc32(dictionary):08x}"
    spark.createDataFrame([(name, dictionary)], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shards = shards or spread(spark)
    bounds = bounds_of(docs, id_col, shards)
    work = pack(docs, [], _id=id_col, _text=text_col).select(F.col("_id").cast("long").alias("_id"), "_text")

    def encoded(batches: Iterator[pa.RecordBatch]):
        import zstandard
        encoder = worker_encoder(tokenizer_path)
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            ids, texts = batch.column("_id").to_pylist(), [x or "" for x in batch.column("_text").to_pylist()]
            for lo, hi in slices([len(x) + 1 for x in texts], 400_000):
                frames, sizes = [], []
                for x in encoder.encode(texts[lo:hi]):
                    x = np.append(x, end_id)
                    wide = x.max() >= 1 << 16
                    frames.append(bytes([int(wide)]) + press.compress(x.astype("<u4" if wide else "<u2").tobytes()))
                    sizes.append(len(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, [-(1 << 63) if i is None else i for i in ids[lo:hi]], side="right"), pa.int32()), pa.array(ids[lo:hi], pa.int64()),
                                                  pa.array(sizes, pa.int32()), pa.array(frames, pa.binary())], names=["shard", "id", "n", "frame"])

    def block(held: list, first: int) -> pa.RecordBatch:
        sizes = np.cumsum([0] + [len(f) for *_, f in held])
        return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([name]), pa.array([first], pa.int64()), pa.array([[d for _, d, _, _ in held]], pa.list_(pa.int64())),
                                           pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([[n for _, _, n, _ in held]], pa.list_(pa.int32())),
                                           pa.array([b"".join(f for *_, f in held)], pa.binary())], names=["shard", "dict_hash", "first_token", "doc_ids", "offsets", "n_tokens", "payload"])

    def blocks(batches: Iterator[pa.RecordBatch]):
        held, tokens, first = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "n", "frame")), strict=True):
                if held and (row[0] != held[0][0] or tokens + row[2] > frame_tokens):
                    yield block(held, first)
                    first = first + tokens if row[0] == held[0][0] else 0
                    held, tokens = [], 0
                held.append(row)
                tokens += row[2]
        if held:
            yield block(held, first)

    dealt = work.mapInArrow(encoded, "shard int, id long, n int, frame binary").repartitionById(max(1, len(bounds) + 1), F.col("shard")).sortWithinPartitions("shard", "id", "frame")
    dealt.mapInArrow(blocks, FRAME).write.option("compression", "uncompressed").parquet(f"{path}/frames")
    sums = (spark.read.schema(FRAME).parquet(f"{path}/frames").select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
            .groupBy("shard").agg(F.sum("n").alias("tokens")))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)     # one row per shard
    sums.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("first"), "tokens").coalesce(1).write.parquet(f"{path}/index")
    return spark.read.schema("shard int, first long, tokens long").parquet(f"{path}/index")


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids, one row per document of the files, checked against the dictionary's hash."""
    index = spark.read.schema("shard int, first long, tokens long").parquet(f"{path}/index")
    frames = spark.read.schema(FRAME).parquet(f"{path}/frames")
    saved = spark.read.schema("dict_hash string, dictionary binary").parquet(f"{path}/dictionary").collect()[0]
    dictionary, name = bytes(saved[1]), saved[0]

    def opened(batches: Iterator[pa.RecordBatch]):
        import zstandard
        pull = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != name:
                    raise ValueError(f"frames were made with dictionary {row['dict_hash']}, the file has {name}")
                ids = []
                for k in range(len(row["doc_ids"])):
                    frame = row["payload"][row["offsets"][k]:row["offsets"][k + 1]]
                    ids.append(np.frombuffer(pull.decompress(frame[1:]), dtype="<u4" if frame[0] else "<u2").astype("<u4"))
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + row["first_token"] + np.cumsum(sizes) - sizes), pa.array(sizes),
                                                  pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return frames.join(F.broadcast(index), "shard").mapInArrow(opened, "doc_id long, start long, n_tokens long, ids binary")
