"""Language identification by unigram piece models that sum over all segmentations of a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import materialise, pack
from kerbline.llm.flat import BASE, between, inverse_powers, mixed, prefix_hash, slices

ADDED = ["lang_pred", "score"]
MARK = "▁"                 # a piece that begins a word begins with this
WORD = 64                       # letters up to which words are scored side by side; longer ones one by one, and the fit leaves them out
SLICE = 150_000                 # characters that a task takes at a time
SCALE = 64.0                    # probability per letter is multiplied by this, so that products keep to the range of a double
UNKNOWN = 1e-7                  # of a letter that is no piece


def pieces(path: str) -> list[str]:
    """Pieces of a public vocabulary that can occur in words: lower-case letters, with or without the mark of a beginning. Left out are control, byte and unknown pieces and those that
    hold capitals, digits, punctuation or signs, none of which a lower-cased run of letters can contain."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in found if p == p.lower() and p.removeprefix(MARK).isalpha())


def letters(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    for c in np.flatnonzero(seen).tolist():
        seen[c] = chr(c).isalpha()
    return seen[codes]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def scattered(codes: np.ndarray) -> np.ndarray:
    return mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


def word_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, and of each word its text's number, start and end."""
    joined = " ".join(x.lower() for x in texts)
    codes = codes_of(joined)
    sizes = np.fromiter((len(x.lower()) for x in texts), dtype=np.int64, count=len(texts))
    is_letter = np.zeros(len(codes) + 2, dtype=np.int8)
    is_letter[1:-1] = letters(codes)
    edge = np.diff(is_letter)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return codes, np.searchsorted(np.cumsum(sizes + 1), start, side="right"), start, end


def parts(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(number of the text of each part, parts) with about ``SLICE`` characters at a time; longer texts are cut after a character that is no letter."""
    number, held, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            end = min(len(text), at + SLICE)
            while end < len(text) and text[end - 1].isalpha():
                end += 1
            number.append(i)
            held.append(text[at:end])
            size, at = size + end - at + 1, end
            if size >= SLICE:
                yield np.array(number), held
                number, held, size = [], [], 0
            if not text:
                break
    if held:
        yield np.array(number), held


class Lattice:
    """All ways to cut words into pieces of a vocabulary."""

    def __init__(self, vocabulary: list[str]):
        self.size, self.longest = len(vocabulary), max(map(len, vocabulary), default=1)
        flat = scattered(codes_of("".join(vocabulary)))
        stop = np.cumsum([len(p) for p in vocabulary])
        own = between(prefix_hash(flat), np.concatenate([[0], stop[:-1]]), stop)
        self.order = np.argsort(own)
        self.sorted = own[self.order]

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets and lengths (with the mark) of the words in one flat array, and the piece that begins at each place by length;
        ``size`` is an unknown letter, ``size + 1`` no piece."""
        codes = codes_of(MARK + MARK.join(words))
        lens = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
        first = np.cumsum(lens) - lens
        return first, lens, self.places(codes, np.repeat(first + lens, lens) - np.arange(len(codes)))

    def places(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The piece that begins at each place by length; ``left`` is what is left of the word there."""
        prefix = prefix_hash(scattered(codes))
        inverse_powers(len(prefix))
        at = np.full((self.longest, len(codes)), self.size + 1, dtype=np.int32)
        for k in range(1, self.longest + 1):
            start = np.flatnonzero(left >= k)
            h = between(prefix, start, start + k)
            i = np.minimum(np.searchsorted(self.sorted, h), self.size - 1)
            at[k - 1, start] = np.where(self.sorted[i] == h, self.order[i], self.size + (k > 1))
        return at

    def long_score(self, word: str, p: np.ndarray, step: int = 50_000) -> np.ndarray:
        """Log probability of one word of any length: only the last places of the forward pass are held, brought to size one as they go, and pieces are looked up a slice at a time."""
        codes = codes_of(MARK + word)
        ahead, log = np.zeros((self.longest + 1, p.shape[1])), np.zeros(p.shape[1])
        ahead[0] = 1.0
        for lo in range(0, len(codes), step):
            n = min(step, len(codes) - lo)
            some = codes[lo:lo + n + self.longest - 1]
            at = self.places(some, len(some) - np.arange(len(some)))
            for s in range(n):
                ahead[1:] += ahead[0] * p[at[:, s]]
                ahead[:-1], ahead[-1] = ahead[1:].copy(), 0.0
                if (lo + s) % 8 == 7:
                    size = np.maximum(ahead.max(axis=0), 1e-300)
                    ahead /= size
                    log += np.log(size)
        return log + np.log(np.maximum(ahead[0], 1e-300))

    def forward(self, lat, p: np.ndarray) -> np.ndarray:
        """Scaled probability of each word's beginning up to each place, one column per language; a word has a place more than letters."""
        first, lens, at = lat
        off = first + np.arange(len(first))
        a = np.zeros((at.shape[1] + len(first), p.shape[1]))
        a[off] = 1.0
        order = np.argsort(-lens, kind="stable")
        for e in range(1, int(lens.max(initial=0)) + 1):
            live = order[:np.searchsorted(-lens[order], -e, side="right")]
            total = np.zeros((len(live), p.shape[1]))
            for k in range(1, min(self.longest, e) + 1):
                piece = at[k - 1, first[live] + e - k]
                has = np.flatnonzero(piece <= self.size)
                total[has] += a[off[live[has]] + e - k] * p[piece[has]] * SCALE ** k
            a[off[live] + e] = total
        return a

    def scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word, summed over its segmentations, per language."""
        out, short = np.zeros((len(words), p.shape[1])), [i for i, w in enumerate(words) if len(w) <= WORD]
        for lo, hi in slices([(len(words[i]) + 1) * p.shape[1] for i in short], 400_000):
            lat = self.of([words[i] for i in short[lo:hi]])
            end = lat[0] + np.arange(hi - lo) + lat[1]
            out[short[lo:hi]] = np.log(np.maximum(self.forward(lat, p)[end], 1e-300)) - lat[1][:, None] * np.log(SCALE)
        for i, w in enumerate(words):
            if len(w) > WORD:
                out[i] = self.long_score(w, p)
        return out

    def expected(self, words: list[str], n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of each piece in the words of one language, each word counted n times."""
        counts = np.zeros(self.size + 1)
        for lo, hi in slices([len(w) + 1 for w in words], 100_000):
            lat = first, lens, at = self.of(words[lo:hi])
            a, off = self.forward(lat, p)[:, 0], first + np.arange(hi - lo)
            b = np.zeros(len(a))
            b[off + lens] = 1.0
            weight = np.divide(n[lo:hi], a[off + lens], out=np.zeros(hi - lo), where=a[off + lens] > 0)
            for e in range(int(lens.max(initial=0)) - 1, -1, -1):
                for k in range(1, self.longest + 1):
                    live = np.flatnonzero(lens >= e + k)
                    piece = at[k - 1, first[live] + e]
                    live, piece = live[piece <= self.size], piece[piece <= self.size]
                    flow = p[piece, 0] * SCALE ** k * b[off[live] + e + k]
                    b[off[live] + e] += flow
                    counts += np.bincount(piece, a[off[live] + e] * flow * weight[live], self.size + 1)
        return counts


def word_counts(sample: DataFrame) -> DataFrame:
    """lang, word, n over rows of (_lang, _text)."""
    def count(batches):
        from collections import Counter
        for batch in batches:
            by = {}
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                codes, _, start, end = word_runs([text])
                low = text.lower()
                by.setdefault(lang, Counter()).update(low[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True) if e - s <= WORD)
            for lang, c in by.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "word": list(c), "n": list(c.values())})
    return sample.select("_lang", "_text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str, text_col: str, id_col: str, vocabulary: list[str], per_language: int, rounds: int) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, by expectation-maximisation on about ``per_language`` texts of each language, chosen by hash."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"), F.xxhash64(F.lit("lang"), id_col, text_col).alias("_h")).where("_lang is not null and _text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(vocabulary) + 2, 0))
    share = spark.createDataFrame([(k, float(per_language) / n) for k, n in sizes.items()], "_of string, _share double")
    chosen = rows.join(F.broadcast(share), F.col("_lang") == F.col("_of")).where(F.col("_h") / F.lit(2.0 ** 64) + 0.5 < F.col("_share"))
    counted = materialise(word_counts(chosen), "lang_words")
    lattice, v = Lattice(vocabulary), len(vocabulary)
    p = np.full((v + 2, len(langs)), 1.0 / v)
    p[v], p[v + 1] = UNKNOWN, 0.0
    for _ in range(rounds):
        def gathered(batches, p=p):
            total = np.zeros((v + 1, len(langs)))
            for batch in batches:
                word, lang, n = batch.column("word").to_pylist(), np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("n").to_numpy()
                for k, name in enumerate(langs):
                    at = np.flatnonzero(lang == name)
                    if len(at):
                        total[:, k] += lattice.expected([word[i] for i in at], n[at].astype(float), p[:, k:k + 1])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "piece": piece.astype(np.int32), "n": total[piece, k]})
        sums = counted.mapInArrow(gathered, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n"))
        got = np.full((v, len(langs)), 0.05)
        for k, piece, n in sums.where(F.col("piece") < v).collect():           # at most pieces x languages
            got[piece, k] += n
        p[:v] = got / got.sum(axis=0)
    return langs, p


def identify(docs: DataFrame, train: Column, vocabulary_path: str, per_language: int = 1500, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """The input with ``lang_pred`` and ``score``, the probability of that language among those learned.

    Each language has a probability for every piece of a fixed public vocabulary, fitted on the rows where ``train`` holds and a language is
    given: at most about ``per_language`` texts of each, a bound of the fit alone. A word's probability is the sum over all
    its segmentations, by a forward pass, however long the word; a text's is the product over its words, so every letter of a whole text counts. Words are scored
    once per slice of a batch and remembered up to a bounded number. Texts of any length are read a slice at a time. The fit leaves out words of more than ``WORD`` letters.

    A null text or one without a letter is ``und`` with score 0, and so is every text if nothing could be learned. Ties go to the language
    that sorts first. Repeated rows get equal results; input columns named like an added one are replaced.
    """
    vocabulary = pieces(vocabulary_path)
    langs, p = fit(docs.where(F.coalesce(train, F.lit(False))), lang_col, text_col, id_col, vocabulary, per_language, rounds)
    work = pack(docs, ADDED)
    row_type = work.schema["_row"].dataType
    lattice = Lattice(vocabulary)

    def score(batches):
        known, table = np.zeros(0, dtype=np.uint64), np.zeros((0, len(langs)))
        for batch in batches:
            texts = batch.column("_row").field(text_col)
            sizes = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices([int(n) + 1 for n in sizes], SLICE):
                some = [x or "" for x in texts.slice(lo, hi - lo).to_pylist()]
                total, has = np.zeros((len(some), len(langs))), np.zeros(len(some), dtype=bool)
                for doc, part in (parts(some) if langs else ()):
                    codes, nth, start, end = word_runs(part)
                    if not len(start):
                        continue
                    h, one, inverse = np.unique(between(prefix_hash(scattered(codes)), start, end), return_index=True, return_inverse=True)
                    if len(known) > 200_000:
                        known, table = known[:0], table[:0]
                    at = np.searchsorted(known, h)
                    new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != h) if len(known) else np.arange(len(h))
                    text = codes.tobytes().decode("utf-32-le", "surrogatepass")
                    more = lattice.scores([text[s:e] for s, e in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)], p)
                    known, table = np.insert(known, at[new], h[new]), np.insert(table, at[new], more, axis=0)
                    by_word, of = table[np.searchsorted(known, h)], doc[nth]
                    has[of] = True
                    for k in range(len(langs)):
                        total[:, k] += np.bincount(of, by_word[inverse, k], len(some))
                pred, sure = ["und"] * len(some), [0.0] * len(some)
                if langs:
                    best = total.argmax(axis=1)
                    top = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    pred = [langs[best[i]] if has[i] else "und" for i in range(len(some))]
                    sure = [float(top[i]) if has[i] else 0.0 for i in range(len(some))]
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=["_row", *ADDED])

    out = work.mapInArrow(score, T.StructType([T.StructField("_row", row_type), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.select("_row.*", *ADDED)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: a quarter by a checksum of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
