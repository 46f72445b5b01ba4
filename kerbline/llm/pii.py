"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides what is added to the base rules."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import pack

ADDED = ["pii"]
#: Kinds in the order of the contract, then those that only the labelers find.
KINDS = ["email", "ip", "card", "phone", "ssn", "name"]
BASE = 4
#: The contract's patterns. An address cannot begin inside a run of digits, so the pattern need not try.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Looser shapes that are candidates only, each with a pattern of what a text must hold for it to occur at all.
DIGIT, TITLE = re.compile("[0-9]"), re.compile("Mr|Ms|Dr|Prof")
LOOSE = [(3, re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"), DIGIT), (4, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), DIGIT),
         (0, re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,5}"), re.compile(r"at[)\]]")),
         (5, re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?\b"), TITLE)]
#: Gazetteers.
ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at be se no dk fi pl pt ie in jp cn br mx ru".split())
NAMES = frozenset("james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen anna peter paul maria laura julia hans "
                  "klaus petra sabine jean pierre marie claire luc sophie juan carlos jose carmen pilar luis".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "6011", "65", "35", "36", "38", "62")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "63", "64", "65", "66", "81", "82", "86", "90", "91")
CUES = {0: ("mail", "contact", "write", "reach"), 1: ("ip", "host", "server", "address", "login", "from"), 2: ("card", "visa", "credit", "payment", "debit", "account"),
        3: ("phone", "call", "tel", "mobile", "fax", "contact"), 4: ("ssn", "social security", "taxpayer"), 5: ("patient", "client", "employee", "dear", "signed", "contact")}
AGAINST = ("version", "release", "isbn", "issn", "order no", "invoice", "section", "figure", "serial", "sku", "model")


def luhn(digits: str) -> bool:
    """Whether the check digit of a number fits."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The contract's addresses, found from each @ outwards: a local part holds no @, so each is read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the contract, and of its shapes that failed the kind's own test."""
    good, failed = [], []
    if "@" in text:
        good += [(0, *x) for x in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                good.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                (good if len(digits) > 13 and luhn(digits) else failed).append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    good.append((3, m.start(), m.end()))
    return sorted(good, key=lambda s: (s[1], s[0])), failed


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """Base spans and other candidates that overlap none of them, in order."""
    good, failed = base_spans(text)
    loose = [(kind, m.start(), m.end()) for kind, shape, needed in LOOSE if needed.search(text) for m in shape.finditer(text)] + failed
    out = [(*s, True) for s in good]
    starts, reach = [s[1] for s in good], np.maximum.accumulate([s[2] for s in good]).tolist() if good else []
    for kind, a, b in sorted(set(loose), key=lambda s: (s[1], s[0])):
        i = bisect_left(starts, b)
        if not i or reach[i - 1] <= a:
            out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (s[1], s[0]))


def votes(text: str, kind: int, a: int, b: int, base: bool) -> tuple[int, ...]:
    """What each labeler says of a span, 1, 0 or 2 for nothing: pattern, gazetteer, context, counter-context, boundary."""
    span = text[a:b]
    low, digits = span.lower(), re.sub("[^0-9]", "", span)
    known = {0: low.rsplit(".", 1)[-1] in ENDINGS, 1: not span.startswith(("0", "127.", "255.")), 2: digits.startswith(ISSUERS), 3: digits.startswith(CALLING) if "+" in span else None,
             4: not digits.startswith(("000", "666", "9")), 5: any(w in NAMES for w in low.split()) or None}[kind]
    around = text[max(0, a - 48):a].lower()
    word = re.compile("|".join(rf"\b{c}" for c in CUES[kind]))
    inner = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    return (int(base), 2 if known is None else int(known), 1 if word.search(around) else 2, 0 if any(x in around for x in AGAINST) else 2, int(not inner))


def shape(text: str, kind: int, a: int, b: int, base: bool) -> tuple[int, ...]:
    """Kind, votes and a size class of a span: a small finite set, whatever the corpus."""
    return (kind, *votes(text, kind, a, b, base), min(7, (b - a) // 5))


def reliabilities(shapes: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Probability that a span of each shape is personal data, and each labeler's P(vote | truth), by expectation-maximisation over counted shapes."""
    said = shapes[:, 1:6]
    p = np.where(said == 1, 0.8, np.where(said == 0, 0.2, 0.5)).mean(axis=1)
    for _ in range(rounds):
        table = np.zeros((said.shape[1], 2, 3))
        for j in range(said.shape[1]):
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                prior = np.array([4.0, 1.0, 2.0]) if y == 0 else np.array([1.0, 4.0, 2.0])
                got = np.bincount(said[:, j], w, 3) + prior
                table[j, y] = got / got.sum()
        prior = np.array([(np.sum((n * p)[shapes[:, 0] == k]) + 1.0) / (np.sum(n[shapes[:, 0] == k]) + 2.0) for k in range(len(KINDS))])[shapes[:, 0]]
        odds = np.log(prior / (1 - prior))
        for j in range(said.shape[1]):
            odds += np.log(table[j, 1, said[:, j]] / table[j, 0, said[:, j]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, table


def design(shapes: np.ndarray) -> np.ndarray:
    """One column per kind, vote and size class."""
    parts = [np.eye(len(KINDS))[shapes[:, 0]]] + [np.eye(3)[shapes[:, j]] for j in range(1, 6)] + [np.eye(8)[shapes[:, 6]]]
    return np.concatenate(parts, axis=1)


def classifier(shapes: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model of the estimated truth, by Newton's method on counted shapes."""
    x = design(shapes)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (q - p)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def find_pii(docs: DataFrame, least: float = 0.9, text_col: str = "text") -> DataFrame:
    """The input with ``pii``: an array of (kind, start, end, base, score), by start and then by kind; offsets in code points, end exclusive.

    Patterns, gazetteers and words around a candidate vote on it. How often each combination of votes, kind and size occurs is counted over all texts: a table whose
    size does not depend on the corpus. Expectation-maximisation on it estimates how far each labeler can be trusted, and a logistic span classifier is trained
    on its estimates. Spans of the base rules always stay; other candidates are added where the classifier gives ``least`` or more and no base span overlaps.

    Null and empty texts have no spans. Repeated rows get equal results, an empty table gives an empty one, and an input column named ``pii`` is replaced.
    """
    def counted(batches):
        from collections import Counter
        for batch in batches:
            c = Counter(shape(t, *s) for t in batch.column("_text").to_pylist() if t for s in candidates(t))
            yield pa.RecordBatch.from_pydict({"shape": pa.array([list(k) for k in c], pa.list_(pa.int32())), "n": pa.array(list(c.values()), pa.int64())})

    work = pack(docs, ADDED, _text=text_col)
    table = work.select("_text").mapInArrow(counted, "shape array<int>, n long").groupBy("shape").agg(F.sum("n").alias("n")).orderBy("shape").collect()
    weights = None
    if table:
        shapes, n = np.array([r[0] for r in table]), np.array([r[1] for r in table], dtype=float)
        weights = classifier(shapes, n, reliabilities(shapes, n)[0])
    rest = pack(docs, ADDED)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])

    def marked(batches):
        for batch in batches:
            out = []
            for t in batch.column("_row").field(text_col).to_pylist():
                found = candidates(t) if t else []
                score = 1 / (1 + np.exp(-np.clip(design(np.array([shape(t, *s) for s in found])) @ weights, -30, 30))) if found else []
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": base, "score": float(p)} for (k, a, b, base), p in zip(found, score, strict=True) if base or p >= least])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.list_(item))], names=["_row", "pii"])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())])
    out = rest.mapInArrow(marked, T.StructType([T.StructField("_row", rest.schema["_row"].dataType), T.StructField("pii", T.ArrayType(span))]))
    return out.select("_row.*", "pii")
