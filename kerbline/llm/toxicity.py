"""Toxicity: a chain of linear classifiers, each of which also sees the probabilities of the categories before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import pack, small
from kerbline.llm.flat import between, mixed, prefix_hash, slices
from kerbline.llm.language_id import scattered, word_runs


def word_features(texts: list[str], features: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed word of every distinct pair, in order of texts; words are letter runs in lower case."""
    codes, doc, start, end = word_runs(texts)
    hashed = between(prefix_hash(scattered(codes)), start, end) % np.uint64(features)
    pair = np.unique(doc.astype(np.int64) * features + hashed.astype(np.int64))
    return pair // features, pair % features


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


class Link:
    """One category: weights of words, of the probabilities before it, and a constant; or the plain rate where rows know one class only."""

    def __init__(self, doc: np.ndarray, word: np.ndarray, before: np.ndarray, y: np.ndarray, features: int, reg: float, rounds: int):
        n = len(y)
        self.w, self.v = np.zeros(features), np.zeros(before.shape[1] + 1)
        rate = y.mean() if n else 0.0
        self.fixed = None if 0 < rate < 1 else float(rate)
        if self.fixed is not None:
            return
        df = np.bincount(word, minlength=features)
        hits = np.bincount(word, y[doc], features)
        odd = np.abs(hits - df * rate) >= 3.0 * np.sqrt(df * rate * (1 - rate))
        use = ((df >= max(3, n / 2000)) & (df <= n / 2) & odd)[word]            # words of most texts, of few, or as common in both classes are left out
        doc, word = doc[use], word[use]
        side = np.column_stack([before, np.ones(n)])

        def forward(w, v):
            return np.bincount(doc, w[word], n) + side @ v

        def backward(r):
            return np.bincount(word, r[doc], features) / n, side.T @ r / n

        w, v = np.ones(features), np.ones(side.shape[1])
        for _ in range(12):                                                    # the largest curvature, by power iteration
            w, v = backward(forward(w, v))
            curve = np.sqrt(w @ w + v @ v)
            w, v = w / curve, v / curve
        step = 3.6 / curve
        self.v[-1] = np.log(rate / (1 - rate))
        w, v, at_w, at_v, t = self.w, self.v, self.w, self.v, 1.0
        for _ in range(rounds):                                                # proximal gradient with momentum
            gw, gv = backward(logistic(forward(at_w, at_v)) - y)
            new = at_w - step * gw
            new = np.sign(new) * np.maximum(np.abs(new) - step * reg, 0.0)
            new_v, t_new = at_v - step * gv, (1 + np.sqrt(1 + 4 * t * t)) / 2
            at_w, at_v = new + (t - 1) / t_new * (new - w), new_v + (t - 1) / t_new * (new_v - v)
            w, v, t = new, new_v, t_new
        self.w, self.v = w, v

    def predict(self, doc: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(before), self.fixed)
        return logistic(np.bincount(doc, self.w[word], len(before)) + np.column_stack([before, np.ones(len(before))]) @ self.v)


def rows_of(doc: np.ndarray, word: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the kept texts, numbered anew."""
    number = np.cumsum(keep) - 1
    own = keep[doc]
    return number[doc[own]], word[own]


def distinct_texts(doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Whether a text is the first of its near copies, by two triples of minwise words: copies would pass the words they share off as signs of their class."""
    keep = np.ones(n, dtype=bool)
    for band in range(2):
        low = np.full((n, 3), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(3):
            np.minimum.at(low[:, i], doc, mixed(word.astype(np.uint64) + np.uint64((3 * band + i + 1) << 32)))
        _, first = np.unique(low, axis=0, return_index=True)
        keep &= np.isin(np.arange(n), first)
    return keep


def fit_chain(doc: np.ndarray, word: np.ndarray, y: np.ndarray, fold: np.ndarray, features: int, reg: float, rounds: int) -> list[Link]:
    """Models in the order of the chain. A later model is trained on earlier probabilities from models that had not seen the row, so it learns how far they can be trusted."""
    chain, before = [], np.zeros((len(y), 0))
    for c in range(y.shape[1]):
        chain.append(Link(doc, word, before, y[:, c], features, reg, rounds))
        if c + 1 < y.shape[1]:
            p = np.zeros(len(y))
            for k in np.unique(fold):
                inside = fold == k
                link = Link(*rows_of(doc, word, ~inside), before[~inside], y[~inside, c], features, reg, rounds)
                p[inside] = link.predict(*rows_of(doc, word, inside), before[inside])
            before = np.column_stack([before, p])
    return chain


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = 20_000, folds: int = 3, features: int = 1 << 17, reg: float = 2e-5, rounds: int = 600, least: float = 0.5,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with ``p_<category>`` for each category of the chain in order and ``toxic``, whether the last one has probability ``least`` or more.

    ``categories`` names 0/1 expressions over ``labels``. A text is the set of its hashed words. The chain is fitted on about ``sample`` labelled documents chosen by a hash of
    the id: a bound of the fit alone, whose words the driver holds, one of each group of near copies; every document is scored on its whole text. Models have an L1 penalty, so few words count and long texts
    gather no noise.

    Null and empty texts are scored as texts without words. Labels that are null, or of documents not in the table, teach nothing; of several labels or rows of one id each
    counts. A category with one class only has that rate everywhere, without labels 0. Input columns named like an added one are replaced.
    """
    names = list(categories)
    added = [*[f"p_{c}" for c in names], "toxic"]
    told = labels.select(F.col(id_col).alias("_lid"), *[v.cast("double").alias(k) for k, v in categories.items()]).dropna()
    n = told.count()
    chosen = told.where(F.xxhash64(F.lit("fit"), "_lid") / F.lit(2.0 ** 64) + 0.5 < (sample / n if n else 1.0))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(small(chosen, min(n, sample)), F.col("_id") == F.col("_lid")).select(
        F.xxhash64("_id", "_text").alias("_h"), "_text", F.array(*[F.col(c) for c in names]).alias("_y"))

    def gathered(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            word = [word_features([x], features)[1].astype(np.int32) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("_y"), pa.array(word, pa.list_(pa.int32()))], names=["h", "y", "words"])

    rows = source.mapInArrow(gathered, "h long, y array<double>, words array<int>").toArrow().sort_by("h")
    sizes = np.array([len(x) for x in rows.column("words")], dtype=np.int64)
    y = np.array(rows.column("y").to_pylist()).reshape(-1, len(names))
    word = np.concatenate([np.zeros(0, dtype=np.int32), *[c.flatten().to_numpy() for c in rows.column("words").chunks]]).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    alone = distinct_texts(doc, word, len(sizes))
    chain = fit_chain(*rows_of(doc, word, alone), y[alone], rows.column("h").to_numpy()[alone] % folds, features, reg, rounds)
    weights = [(np.flatnonzero(x.w).astype(np.int32), x.w[x.w != 0]) for x in chain]
    rest = [(x.v, x.fixed) for x in chain]
    work = pack(docs, added)

    def score(batches):
        links = []
        for (at, w), (v, fixed) in zip(weights, rest, strict=True):
            link = Link.__new__(Link)
            link.w, link.v, link.fixed = np.zeros(features), v, fixed
            link.w[at] = w
            links.append(link)
        for batch in batches:
            texts, out = [x or "" for x in batch.column("_row").field(text_col).to_pylist()], []
            for lo, hi in slices([len(x) + 1 for x in texts], 2_000_000):
                doc, word = word_features(texts[lo:hi], features)
                before = np.zeros((hi - lo, 0))
                for link in links:
                    before = np.column_stack([before, link.predict(doc, word, before)])
                out.append(before)
            p = np.concatenate(out) if out else np.zeros((0, len(links)))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *[pa.array(p[:, i]) for i in range(len(links))], pa.array(p[:, -1] >= least)], names=["_row", *added])

    fields = [T.StructField("_row", work.schema["_row"].dataType), *[T.StructField(a, T.DoubleType()) for a in added[:-1]], T.StructField("toxic", T.BooleanType())]
    return work.mapInArrow(score, T.StructType(fields)).select("_row.*", *added)
