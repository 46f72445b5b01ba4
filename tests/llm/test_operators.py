"""Every operator against plain computation on small tables that hold nulls, empty texts, ties, repeated rows and columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "s", "Ä"]) for _ in range(n))


LONG = prose(1, 4000)
PASSAGE = prose(2, 60)
LINE = "  This line of boilerplate stands in many documents of the table\t"
TEXTS = [None, "", " ", "One", "two words", PASSAGE, PASSAGE, prose(3, 80) + " " + PASSAGE + " " + prose(4, 70), PASSAGE.upper(), LONG, LONG + " tail", "x" * 250, "é" * 120, prose(5, 30) + "\n" + LINE + "\n" + prose(6, 20),
         *[prose(10 + i, 5) + "\n" + (LINE.upper() if i % 2 else LINE) + "\n\n" + LINE for i in range(5)], *[PASSAGE + " " + WORDS[i] for i in range(4)], "🎉 don't stop  \n\n now<|endoftext|>", "same"]
ROWS = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "c"][i % 4]) for i, t in enumerate(TEXTS)] + [(len(TEXTS) - 1, "same", "en", "a")]
CLASH = ["n_lines", "kept", "score", "n_words", "size", "pii", "_id", "_row", "component_id", "n_bytes", "toxic"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("input"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def test_suffix_dedup(spark, docs, empty):
    from kerbline.llm.suffix_dedup import suffix_dedup
    unique = docs.dropDuplicates(["doc_id"])
    got, seen = by_id(suffix_dedup(unique, 100)), set()
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        mark = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - 99):
            if raw[k:k + 100] in seen:
                mark[k:k + 100] = True
            seen.add(raw[k:k + 100])
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~mark])
        n_runs = int((np.diff(np.append(False, mark).astype(int)) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(raw), int(mark.sum()), n_runs, kept), i
    twice = suffix_dedup(docs.where("doc_id in (5, 6)").unionByName(docs.where("doc_id = 5")).withColumn("doc_id", F.lit(None).cast("long")), 100).collect()
    assert len(twice) == 3 and len({(r["n_removed"], r["n_spans"]) for r in twice}) == 1
    assert suffix_dedup(empty, 100).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(n, linked):
    root = list(range(n))
    for a, b in linked:
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root


def test_near_dedup(spark, docs, empty):
    from kerbline.llm.minhash import near_dedup
    got = by_id(near_dedup(docs))
    sets = [shingles(t) for t in TEXTS]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for i, c in enumerate(classes(len(sets), links)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), c, c == i), i
    assert near_dedup(docs).count() == len(ROWS)
    lost = near_dedup(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert all(r["component_id"] is None and r["kept"] for r in lost)
    assert near_dedup(empty).count() == 0


def test_near_dedup_of_large_groups(spark):
    """Nodes beyond the limit: near copies, and documents that share a long passage without being near."""
    from kerbline.llm.minhash import near_dedup
    base = prose(50, 200).split()
    rows = []
    for i in range(150):
        w = list(base)
        w[random.Random(i).randrange(200)] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:90]) + " " + prose(900 + i // 2, 60) + (" end" if i % 2 else "")) for i in range(120)]
    got = by_id(near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most=16))
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = classes(len(rows), links)
    assert [got[d]["component_id"] for d, _ in rows] == [rows[c][0] for c in want]


def test_near_dedup_links_to_members_of_large_nodes(spark):
    """The lead of a group of near copies, m's that link with it, and x's that link with an m of their own but not with the lead."""
    from kerbline.llm.minhash import near_dedup
    rng = random.Random(5)
    base, rows = [f"w{rng.randrange(10 ** 9)}" for _ in range(300)], []
    rows.append((0, " ".join(base)))
    for i in range(150):
        m = [*base[:278], *[f"m{i}_{j}" for j in range(22)]]
        rows.append((1 + i, " ".join(m)))
        rows.append((1001 + i, " ".join([*m[:3], *[f"x{i}_{j}" for j in range(12)], *m[15:]])))
    sets = {i: shingles(t) for i, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert all(near(0, 1 + i) and near(1 + i, 1001 + i) and not near(0, 1001 + i) and not near(1 + i, 1002 + i) for i in range(149))
    got = by_id(near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most=16))
    assert [i for i in got if got[i]["component_id"] != 0] == []


def test_near_dedup_trees_follow_the_depth():
    import math
    from kerbline.llm.minhash import n_trees, places
    for percent, depth in ((85, 2), (85, 4), (80, 4)):
        n, s = n_trees(percent, 0.9999, depth), percent / 100
        assert (1 - s ** depth) ** n <= 1e-4 < (1 - s ** depth) ** (n - 1)
        below = sum(math.comb(n * depth, k) * s ** k * (1 - s) ** (n * depth - k) for k in range(places(n * depth, s)))
        assert below < 1e-6


def test_pipeline_near_duplicates_from_four_fifths(spark):
    from corpus_pipeline import near_duplicates
    rows = []
    for i in range(40):
        w = [f"w{i}_{j}" for j in range(100)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:100 - 5 - i // 2], *[f"o{i}_{j}" for j in range(5 + i // 2)]]))]
    sets = {i: shingles(t) for i, t in rows}
    want = {i for i in sets if i % 2 == 0 or 100 * len(sets[i] & sets[i - 1]) < 80 * len(sets[i] | sets[i - 1])}
    assert any(80 <= 100 * len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) < 85 for i in sets if i % 2)
    assert {r["doc_id"] for r in near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()} == want


def test_language(spark):
    from kerbline.llm.language_id import held_out, identify
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = identify(docs, ~held_out(), path).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(got) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, docs, empty):
    from kerbline.llm.language_id import identify
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = identify(docs, F.lit(True), path, rounds=1).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de") and 0 < r["score"] <= 1
    assert {r["lang_pred"] for r in identify(docs, F.lit(False), path).collect()} == {"und"}
    assert identify(empty, F.lit(True), path).count() == 0


def test_forward_sums_all_segmentations():
    from kerbline.llm.language_id import MARK, Lattice
    vocabulary = sorted([MARK, MARK + "a", "a", "ab", "b", "ba", "c"])
    lattice, rng = Lattice(vocabulary), np.random.default_rng(0)
    p = np.vstack([rng.random((len(vocabulary), 2)), [[1e-7] * 2, [0.0] * 2]])
    at = {x: i for i, x in enumerate(vocabulary)}

    def total(s):
        if not s:
            return np.ones(2)
        return sum((p[at[s[:k]]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in at), np.zeros(2)) + (p[-2] * total(s[1:]) if s[0] not in at else 0)

    words = ["ab", "abba", "zab", "c", "bacab"]
    assert np.allclose(np.exp(lattice.scores(words, p)), [total(MARK + w) for w in words])
    one = p[:, :1]
    assert np.isclose(lattice.expected(["c"], np.array([3.0]), one)[at["c"]], 3.0)


def test_mix(spark, docs, empty):
    from kerbline.llm.mixing import mix, mix_draws, split_quotas, targets
    rows = spark.createDataFrame([(i, prose(i, 1 + i % 40), ["big", "big", "mid", "low"][i % 4] if i % 50 else None) for i in range(800)], "doc_id long, text string, source string")
    out = mix_draws(rows, block_words=50, shard_words=3000).collect()
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert r["size"] == len(r["text"].split()) and sum(d["words"] for d in r["draws"]) <= 3 * r["size"]
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert own[0]["source_size"] == sizes[s]
        assert abs(sum(d["words"] for r in own for d in r["draws"]) - own[0]["target"]) <= 1
    assert sum({r["source"]: r["target"] for r in out}.values()) == pytest.approx(sum(sizes.values()))
    again = mix_draws(rows.repartition(5), block_words=50, shard_words=3000).collect()
    assert sorted((r["doc_id"], r["draws"]) for r in out) == sorted((r["doc_id"], r["draws"]) for r in again)
    shards = mix(rows, block_words=50, shard_words=3000).collect()
    assert len({r["mix_shard"] for r in shards}) > 1 and all(len(r["text"].split()) == r["mix_words"] for r in shards)
    assert targets([10, 1000, 10], [5, 2, 1]) == [30.0, 960.0, 30.0]
    assert (split_quotas([7, 0, 100], 5, 1).sum(axis=0) == [7, 0, 100]).all()
    edge = mix_draws(docs).collect()
    assert len(edge) == len(ROWS) and all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in edge)
    assert mix_draws(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    from kerbline.llm.decontaminate import decontaminate, without_spans
    items = [(1, PASSAGE), (2, "One"), (3, "two, WORDS!"), (4, None), (5, ""), (6, " ".join(PASSAGE.split()[5:30])), (None, LONG)]
    table = spark.createDataFrame(items, "item_id long, text string")

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    wins = {}
    for i, t in items:
        w = cut(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add(i)
    rows = decontaminate(docs, table)
    got = by_id(rows)
    for d, t in enumerate(TEXTS):
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k:k + n])]
        assert (got[d]["n_words"], got[d]["n_hit"]) == (len(w), len(hit)), d
        assert got[d]["item_ids"] == sorted(str(i) for i in found if i is not None)
        assert got[d]["contaminated"] == (bool(hit) and 20 * len(hit) >= len(w))
    assert rows.count() == len(ROWS)
    clean = by_id(without_spans(rows))
    assert cut(clean[7]["text"]) == [w for k, w in enumerate(cut(TEXTS[7])) if not any(s["a"] <= k < s["b"] for s in got[7]["spans"])]
    assert not any(r["contaminated"] for r in decontaminate(docs, table.limit(0)).collect())
    assert decontaminate(empty, table).count() == 0


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    from kerbline.llm.token_files import Encoder, read_tokens, write_tokens
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    write_tokens(docs, f"{tmp_path}/t", path, shards=4)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in read_tokens(spark, f"{tmp_path}/t").collect())
    at = 0
    for (d, t, *_), row in zip(sorted(ROWS, key=lambda r: r[0]), got, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert row == (d, at, len(ids), ids.tobytes())
        at += len(ids)
    write_tokens(empty, f"{tmp_path}/e", path)
    assert read_tokens(spark, f"{tmp_path}/e").count() == 0
    rng, parts = random.Random(3), [" ", "  ", "\n", "\n\n", " \n", "\t", "a", "don't", "'s", "''", "12", "é", "ß", "—", "日本", "×", "!", " ", "\x1c", "Hello", "🎉"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    assert all(np.array_equal(a, b.ids) for a, b in zip(Encoder(path).encode(texts), plain.encode_batch(texts, add_special_tokens=False), strict=True))


def test_toxicity(spark, docs, empty):
    from kerbline.llm.toxicity import toxicity
    rng = random.Random(5)

    def own(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))

    rows = [(i, own(60) + (" vile scoundrel " if i % 5 == 0 else " Vile " if i % 5 == 1 else " ") + own(rng.randrange(300)), i % 5 == 0 or i % 5 == 1) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, bad boolean")
    labels = table.where("doc_id < 400").select("doc_id", F.lit(1).alias("quality"), F.col("bad").cast("int").alias("toxic"))
    chain = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    held = [r for r in toxicity(table, labels, chain).collect() if r["doc_id"] >= 400]
    assert len(held) == 200 and all(r["toxic"] == r["bad"] and r["p_low_quality"] == 0.0 for r in held)
    assert toxicity(docs, labels, chain).count() == len(ROWS)
    assert {(r["p_toxic"], r["toxic"]) for r in toxicity(docs, labels.limit(0), chain).collect()} == {(0.0, False)}
    assert toxicity(empty, labels, chain).count() == 0


def test_line_dedup(spark, docs, empty):
    from kerbline.llm.line_dedup import line_dedup
    rows = line_dedup(docs)
    got = by_id(rows)
    cut = {i: (t or "").split("\n") for i, t in enumerate(TEXTS)}

    def key(line):
        return lower(line.strip("\t\n\x0b\x0c\r "))

    held = {}
    for i, lines in cut.items():
        for x in lines:
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    for i, lines in cut.items():
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and i != max(held[key(x)]))]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept)), i
    assert rows.count() == len(ROWS) and line_dedup(empty).count() == 0
    assert line_dedup(docs.withColumn("doc_id", F.lit(None).cast("long"))).where("n_dropped > 0").count() == 0


def test_pii(spark, docs, empty):
    from kerbline.llm.pii import candidates, find_pii
    rng = random.Random(8)
    parts = ["a", "b.c", "@", "@x.org", ".", "-", "+", " ", "  ", "(", ")", "1", "22", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (523) 555-1055", "10.0.0.1", "%", "é", "🎉", "\n", "555-12-3456", "Dr Anna ", "+49", "0-0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["9" * 30_000, "a" * 30_000, "a@" * 10_000, "+1" + " " * 20_000, "1." * 10_000]
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def fits(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == 1:
            return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))
        if kind == 2:
            return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    for t in texts:
        if len(t) > 1000:
            candidates(t)
            continue
        want = sorted(((k, m.start(), m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t) if fits(k, m[0])), key=lambda s: (s[1], s[0]))
        assert [s[:3] for s in candidates(t) if s[3]] == want, t
    rows = find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts[:300])], "doc_id long, text string")).collect()
    assert all([(s["start"], s["end"]) for s in r["pii"] if s["base"]] == [s[1:3] for s in candidates(r["text"]) if s[3]] for r in rows)
    assert find_pii(docs).count() == len(ROWS) and find_pii(empty).count() == 0


def test_embedding_join(spark):
    from kerbline.llm.embedding_join import range_join
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 8))
    v = [*(centre[rng.integers(0, 12, 500)] + 0.25 * rng.normal(size=(500, 8))).astype(np.float32).tolist()]
    v += [v[0], v[0], [x * 2 for x in v[1]], None, [], [0.0] * 8, [float("nan")] * 8, [None, *v[2][1:]], [float("inf"), *v[2][1:]], [1.0, 0.0], [2.0, 0.0], [1.0, 0.1]]
    df = spark.createDataFrame([(i, x, "a", i) for i, x in enumerate(v)], "vec_id long, embedding array<float>, kept string, rep int").repartition(4)
    for rows in (40, 4096):
        got = {r["vec_id"]: r for r in range_join(df, cell_rows=rows).collect()}
        fine = [i for i, x in enumerate(v) if x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
        links = []
        for a in fine:
            for b in fine:
                if b < a and len(v[a]) == len(v[b]):
                    x, y = np.array(v[a], dtype=np.float32).astype(float), np.array(v[b], dtype=np.float32).astype(float)
                    if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                        links.append((a, b))
        degree = np.bincount([x for p in links for x in p], minlength=len(v))
        for i, c in enumerate(classes(len(v), links)):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (degree[i], c, c == i), (rows, i)
    assert range_join(df.limit(0)).count() == 0
    assert all(r["component_id"] is None and r["n_links"] == 0 for r in range_join(df.withColumn("vec_id", F.lit(None).cast("long"))).collect())


def test_embedding_join_links_labels_that_fall(spark):
    from kerbline.llm.embedding_join import Cell, range_join
    turn = np.deg2rad(25)
    cell = Cell(np.array([10]), np.array([1]), np.array([[1.0, 0.0]]), 0.9)
    sent = [cell.meet(np.array([i]), np.array([1]), np.array([[np.cos(turn), s * np.sin(turn)]])) for i, s in ((5, 1), (3, -1))]
    assert [tuple(map(int, x)) for part in sent for x in zip(*part, strict=True)] == [(5, 1, 5), (10, 0, 5), (3, 1, 3), (5, 0, 3)] and cell.label.tolist() == [3]

    rng = np.random.default_rng(4)                                             # a star: 5,000 rows that link with the centre alone, in pieces with ever smaller ids
    u = rng.normal(size=(5000, 256))
    v = np.concatenate([np.full((5000, 1), np.cos(turn)), np.sin(turn) * u / np.linalg.norm(u, axis=1, keepdims=True)], axis=1)
    v = np.concatenate([np.eye(1, 257), v])
    ids = np.arange(len(v))[::-1]
    links = (v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)) >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r["vec_id"]: r for r in range_join(df, cell_rows=400, most_pivots=1).select("vec_id", "n_links", "component_id", "kept").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(got[int(i)]["n_links"] == n and got[int(i)]["component_id"] == 0 and got[int(i)]["kept"] == (i == 0) for i, n in zip(ids, links, strict=True))


def test_components(spark):
    from kerbline.llm.components import components
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_hashes_of_the_queries(spark):
    """Digest columns of the registered queries agree with the operators' own outputs."""
    from kerbline.llm.queries import QUERIES
    rows = QUERIES["op9_pii"][0](spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        if r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == 0:
            assert r["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_words_of_any_length_are_summed_whole(monkeypatch):
    """A run of 1,000 letters has the sum over all its segmentations, also when its pieces are looked up a few letters at a time."""
    from kerbline.llm.language_id import MARK, Lattice
    vocabulary = sorted([MARK, MARK + "a", "a", "ab", "abbab", "b", "ba", "c"])
    lattice, rng = Lattice(vocabulary), np.random.default_rng(1)
    p = np.vstack([rng.random((len(vocabulary), 3)), [[1e-7] * 3, [0.0] * 3]])
    at = {x: i for i, x in enumerate(vocabulary)}
    word = "".join(rng.choice(list("abcz"), size=1000, p=[.5, .3, .15, .05]))
    s = MARK + word
    log, way = [np.zeros(3)], None
    for e in range(1, len(s) + 1):                                             # plain recursion in logarithms
        way = [log[e - k] + np.log(p[at[s[e - k:e]]] if s[e - k:e] in at else p[-2]) for k in range(1, min(e, 6) + 1) if s[e - k:e] in at or k == 1]
        log.append(np.logaddexp.reduce(way))
    for step in (50_000, 7):
        assert np.allclose(lattice.long_score(word, p, step), log[-1])
    assert np.allclose(lattice.scores([word, "ab"], p)[0], log[-1])
    assert np.allclose(lattice.long_score("ab" * 30, p), lattice.scores(["ab" * 30], p)[0])


def test_long_texts_are_read_in_slices(spark, monkeypatch):
    from kerbline.llm import language_id as m
    texts = [prose(3, 400), "", "x" * 500 + " end", "no1digits2here " * 30]
    whole = m.word_runs(texts)
    monkeypatch.setattr(m, "SLICE", 50)
    got = []
    for doc, part in m.parts(texts):
        codes, nth, start, end = m.word_runs(part)
        text = codes.tobytes().decode("utf-32-le")
        got += [(int(doc[n]), text[s:e]) for n, s, e in zip(nth, start, end, strict=True)]
    text = whole[0].tobytes().decode("utf-32-le")
    assert got == [(int(n), text[s:e]) for n, s, e in zip(*whole[1:], strict=True)]


def test_clashing_names_in_capitals(spark):
    from kerbline.llm.line_dedup import line_dedup
    from kerbline.llm.mixing import mix_draws
    df = spark.createDataFrame([(1, "a b", "x", "in", "in", "in")], "doc_id long, text string, source string, N_LINES string, SIZE string, `a.b` string")
    assert line_dedup(df).columns == ["doc_id", "text", "source", "SIZE", "a.b", "n_lines", "n_dropped", "kept_text"] and line_dedup(df).count() == 1
    assert "SIZE" not in mix_draws(df).columns and mix_draws(df).count() == 1


def test_line_dedup_of_a_text_of_200_000_lines(spark):
    import time

    from kerbline.llm.line_dedup import line_dedup
    text = "\n".join(f"line number {i:07d} of a very long document that is there six times" for i in range(200_000))
    df = spark.range(6).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    start = time.time()
    got = {r[0]: r[1:] for r in line_dedup(df).select("doc_id", "n_lines", "n_dropped", F.length("kept_text")).collect()}
    assert got == {i: (200_000, 200_000, 0) for i in range(5)} | {5: (200_000, 0, len(text))}
    assert time.time() - start < 90


def test_candidates_need_neither_dots_nor_hyphens():
    from kerbline.llm.pii import candidates
    for text, kind in (("john (at) example (dot) com", 0), ("call (555) 123 4567 now", 3), ("then Mr Smith called", 5), ("Prof Jones", 5), ("id 123-45-6789", 4)):
        for t in (text, text + " 1. and - more"):
            assert [c[0] for c in candidates(t) if not c[3]][:1] == [kind], t
    assert candidates("no such thing here") == [] == candidates("")


def test_reliabilities_of_planted_labelers():
    """Expectation-maximisation tells a good labeler from a coin and from one that says nothing."""
    from kerbline.llm.pii import reliabilities
    rng = np.random.default_rng(4)
    truth = rng.random(6000) < 0.4
    hit = {0: 0.95, 1: 0.9, 2: 0.85, 3: 0.5}
    said = np.stack([np.where(rng.random(6000) < hit[j], truth, ~truth).astype(int) for j in range(4)] + [np.full(6000, 2)], axis=1)
    shapes, n = np.unique(np.concatenate([np.zeros((6000, 1), dtype=int), said, np.zeros((6000, 1), dtype=int)], axis=1), axis=0, return_counts=True)
    p, table = reliabilities(shapes, n)
    assert all(abs(table[j, 1, 1] / (table[j, 1, 1] + table[j, 1, 0]) - hit[j]) < 0.05 and abs(table[j, 0, 0] / (table[j, 0, 0] + table[j, 0, 1]) - hit[j]) < 0.05 for j in range(4))
    assert np.allclose(table[4, 0, 2], table[4, 1, 2], atol=0.05) and abs(np.average(p, weights=n) - truth.mean()) < 0.03
