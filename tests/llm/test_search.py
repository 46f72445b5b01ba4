"""Top-k search over bit slices and ranked search over signatures against plain computation."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F


def best_of(rows, asks, k):
    """Plain inner products: (query_id, rank, vec_id, score) in order."""
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(fit):
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for j, (i, w) in enumerate(fit) if j != at and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(seed, n, dim, copies=0):
    rng = np.random.default_rng(seed)
    out = [(i, [float(np.float32(x)) for x in rng.normal(size=dim) / math.sqrt(dim)]) for i in range(n)]
    return out + [(n + i, out[0][1]) for i in range(copies)]


SCHEMA = "vec_id long, embedding array<double>, score string, `a.b` string, RANK string"


@pytest.mark.parametrize("block_rows, chunk", [(4096, 4096), (64, 7)])
def test_top_k(spark, block_rows, chunk):
    from kerbline.llm.bit_sliced import top_k
    rows = vectors(1, 300, 9, copies=150)
    rows += [(450, None), (500, []), (550, [1.0, None] + [0.0] * 7), (600, [math.nan] * 9), (650, [math.inf] * 9), (700, [0.0] * 9), (None, [1.0] * 9), (750, [0.5, -0.25]), (751, [-4.0, 0.003]),
             (100, rows[100][1]), (100, rows[100][1]), (150, rows[3][1]), (800, [300.0, -77.0] + [0.0] * 7), (850, [-0.001] * 9)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    got = top_k(df, F.col("vec_id") % 50 == 0, 5, block_rows=block_rows, chunk_queries=chunk)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, got.collect()))
    assert got == best_of(rows, lambda q: q % 50 == 0, 5)
    assert len([g for g in got if g[0] == 750]) == 1                               # fewer partners than k


def test_top_k_takes_components_of_any_size(spark):
    from kerbline.llm.bit_sliced import WIDEST, top_k
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e308, 2.0]), (3, [0.5, 0.5]), (4, [float(2 ** 40), -3.0])]
    plain = [(i, [max(-WIDEST, min(WIDEST, math.floor(256 * x) if math.isfinite(256 * x) else int(math.copysign(WIDEST, x)))) for x in v]) for i, v in rows]
    want = []
    for q, v in plain:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in plain if i != q)
        want += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scored)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_of_an_empty_table_and_without_queries(spark):
    from kerbline.llm.bit_sliced import top_k
    df = spark.createDataFrame(vectors(2, 20, 3), "vec_id long, embedding array<double>")
    assert top_k(df.limit(0), F.lit(True)).count() == 0
    assert top_k(df, F.lit(None).cast("boolean")).count() == 0
    assert top_k(df, F.col("vec_id") < 2, k=50).count() == 38


def test_slices_add_up(spark):
    from kerbline.llm.bit_sliced import Block, add_up, digits, sliced
    rng = np.random.default_rng(5)
    values = rng.integers(-1000, 1000, size=(130, 7))
    base, slices = sliced(values)
    for d in range(7):
        total = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << b) for b, s in enumerate(slices[d]))
        assert (total + base[d] == values[:, d]).all()
    weights = rng.integers(-10 ** 6, 10 ** 6, size=200)
    up, down = digits(weights)
    assert (up - down == weights).all() and not (up & down).any()
    maps = rng.integers(0, 2, size=(37, 64)).astype(np.uint8)
    packed = np.packbits(maps, axis=1, bitorder="little").view(np.uint64)
    total = add_up([packed[:20], packed[20:]])
    assert (sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(int) << w for w, s in enumerate(total)) == maps[:20].sum(0) + 2 * maps[20:].sum(0)).all()
    block = Block(np.arange(130), base.tolist(), slices)
    q = values[17]
    assert [s for _, s in sorted(block.search(q, None, 130))] == (values @ q).tolist()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    counted = [(i, t) for i, t in ((i, terms(t)) for i, t in docs) if t]
    total, many = len(counted), sum(len(t) for _, t in counted)
    df = {}
    for _, t in counted:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        rows = []
        for i, t in counted:
            m, score = 10 + (90 * len(t) * total) // many, 0
            for x in set(terms(text)) & set(t):
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 8 * m))
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return out


def corpus(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if i % 3 else f"Ärt{i}É" for i in range(words)]
    return [" ".join(vocabulary[min(int(rng.expovariate(4 / words)), words - 1)] + rng.choice(["", ",", " -", "\n"]) for _ in range(rng.randint(1, 120))) for _ in range(n)]


DOCS = [(i, t) for i, t in enumerate(corpus(1, 300))]
DOCS += [(300, None), (301, ""), (302, " .,\n"), (None, DOCS[7][1]), (None, DOCS[8][1] + " W5 w5 w5"), (303, " ".join(corpus(2, 60))), (304, "x" * 3000), (305, "🎉 don't"), (7, DOCS[7][1]), (8, "other w1")]
DOCS += [(400 + i, DOCS[3][1].upper()) for i in range(150)]
ITEMS = [(i, DOCS[i * 7][1][:120]) for i in range(12)] + [(20, None), (21, "..."), (22, "nowhere"), (23, DOCS[3][1]), (23, DOCS[3][1]), (None, "w1 w2 w1 W2"), (24, " ".join(corpus(3, 20))), (25, "X" * 3000), (26, "🎉")]


@pytest.mark.parametrize("chunk", [200_000, 40])
def test_ranked_search(spark, monkeypatch, chunk):
    from kerbline.llm.signatures import ranked_search
    docs = spark.createDataFrame([(*r, "a", "b") for r in DOCS], "doc_id long, text string, Score string, `a.b` string").repartition(4)
    items = spark.createDataFrame([(*r, "a") for r in ITEMS], "item_id long, text string, doc_id string").repartition(2)
    got = ranked_search(docs, items, 10, chunk_terms=chunk)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, ranked(DOCS, ITEMS, 10)))


def test_ranked_search_of_empty_tables(spark):
    from kerbline.llm.signatures import ranked_search
    docs, items = spark.createDataFrame(DOCS[:5], "doc_id long, text string"), spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    assert ranked_search(docs.limit(0), items).count() == 0 == ranked_search(docs, items.limit(0)).count()


def test_long_texts_are_cut_between_terms(monkeypatch):
    from kerbline.llm import signatures as s
    texts = [" ".join(corpus(9, 40)), None, "", "y" * 500, "a b " + "z" * 90 + " b", "!" * 300]
    whole = s.term_counts(texts)
    monkeypatch.setattr(s, "PIECE_BYTES", 37)
    assert all((a == b).all() for a, b in zip(whole, s.term_counts(texts), strict=True))
    assert [int(whole[2][whole[0] == i].sum()) for i in range(6)] == [len(terms(t)) for t in texts]


def test_signatures_overestimate(monkeypatch):
    """Every fact is found in the bitmaps, also where their number is held down."""
    from kerbline.llm import signatures as s
    owner, term, tf = s.term_counts([t for _, t in DOCS])
    for most in (1 << 18, 64):
        monkeypatch.setattr(s, "MOST_BITMAPS", most)
        sig = s.signature(owner, term, tf, len(DOCS))
        for level, least in enumerate(s.LEVELS):
            some = tf >= least
            at = s.places(term[some], level, len(sig))
            assert all(((sig[at[:, j], owner[some] >> 3] >> (owner[some] & 7)) & 1).all() for j in range(s.FACT_ROWS))


def test_index_is_written_in_small_row_groups(spark, monkeypatch):
    """A group ends before it takes more than the bound and a row or two, however large the rows are; writers that look only at every hundredth row would put all blocks in one."""
    import pyarrow.parquet as pq

    from kerbline.llm import signatures as s
    monkeypatch.setattr(s, "BLOCK_TERMS", 1 << 11)
    monkeypatch.setattr(s, "GROUP_BYTES", 1 << 18)
    docs = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(100 + i % 7))) for i in range(900)], "doc_id long, text string")
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in s.index_of(docs.coalesce(1), "doc_id", "text").inputFiles()]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    rows = sum(g.num_rows for g in groups)
    assert len(files) == 1 and 40 < rows < 100                                      # all within the first hundred
    assert len(groups) > 5 and all(g.total_byte_size <= (1 << 18) + 2 * (1 << 17) for g in groups)
