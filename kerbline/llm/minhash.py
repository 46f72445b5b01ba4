"""MinHash near-dedup: a chosen-path similarity join over sets of word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import materialise, pack, runs, small, spread
from kerbline.llm.components import components
from kerbline.llm.flat import BASE, BYTE, between, mixed, prefix_hash, slices

ADDED = ["n_shingles", "component_id", "kept"]
#: Minwise tokens of a sketch beside those of the trees.
SKETCH = 128
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the runs of k words of each text, A-Z in lower case; a text of fewer words is one run, one of none is empty."""
    odd = [np.uint64(pow(BASE, i + 1, 1 << 64)) for i in range(k)]
    for lo, hi in slices([len(x) + 1 for x in texts], 400_000):
        raw = [x.encode().lower() for x in texts[lo:hi]]
        codes = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
        edge = np.diff(BLANK[codes].astype(np.int8))
        start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        word = between(prefix_hash(BYTE[codes]), start, end)
        first = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in raw]) + 1)
        full = np.zeros(max(len(word) - k + 1, 0), dtype=np.uint64)
        for i in range(k):
            full += word[i:i + len(full)] * odd[i]
        full = mixed(full)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(full[a:b - k + 1])
            elif b > a:
                yield mixed(np.array([sum(int(w) * int(o) for w, o in zip(word[a:b], odd, strict=False)) + b - a & (1 << 64) - 1], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def sketches(docs: DataFrame, k: int, trees: int, depth: int) -> DataFrame:
    """_id, _th, n, fa, fb (a 128-bit name of the whole set), path (of each tree the node at every level, named by the minwise tokens on the way to it) and sig (a byte of each
    minwise token and of ``SKETCH`` more)."""
    factor = mixed(np.arange(1, trees * depth + SKETCH + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    tree = mixed(np.arange(1, trees + 1, dtype=np.uint64))

    def sketch(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            n, fa, fb, path, sig = [], [], [], [], []
            for h in shingle_sets(texts, k):
                digest = np.frombuffer(hashlib.md5(h.tobytes()).digest(), dtype=np.int64)
                n.append(len(h))
                fa.append(digest[0])
                fb.append(digest[1])
                if not len(h):
                    path.append(np.zeros(0, dtype=np.int64))
                    sig.append(b"")
                    continue
                least = np.min([(part[:, None] * factor).min(axis=0) for part in np.array_split(h, len(h) // 1024 + 1)], axis=0)
                node, way = tree, []
                for level in range(depth):
                    node = mixed(node + least[level:trees * depth:depth])
                    way.append(node)
                path.append(np.stack(way, axis=1).reshape(-1).view(np.int64))
                sig.append((mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes())
            sizes = np.cumsum([0] + [len(s) for s in path]).astype(np.int32)
            flat = np.concatenate(path) if path else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array(sig, pa.binary())], names=["_id", "_th", "n", "fa", "fb", "path", "sig"])

    return docs.select("_id", "_th", "_text").mapInArrow(sketch, "_id long, _th long, n long, fa long, fb long, path array<long>, sig binary")


def nodes(reps: DataFrame, trees: int, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(small, large): members (node, tree, rep) of the nodes where branching stops; large nodes with their size.

    A document follows in each tree the path of its minwise tokens; a node of at most ``most`` documents is a leaf, a larger one branches by the next token, and
    documents alone in a node have no partner in that tree. What is still larger at the last level is large. Only names travel, no sketches.
    """
    at = reps.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("path", t * depth + 1, depth))).alias("tree", "way"))
    leaves, level = [], 1
    while True:
        at = at.withColumn("node", F.element_at("way", level))
        size = at.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = materialise(at.join(size, "node"), "paths")
        leaves.append(met.where(F.col("size") <= most).select("node", "tree", "rep"))
        large = met.where(F.col("size") > most)
        if level == depth or large.isEmpty():
            break
        at = large.select("rep", "tree", "way")
        level += 1
    found = leaves[0]
    for x in leaves[1:]:
        found = found.unionByName(x)
    return found, large.select("node", "tree", "rep", "size")


def agreeing(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many places the sketches of two lists agree."""
    hits = np.zeros((len(sig), len(other)), dtype=np.uint16)
    for i in range(sig.shape[1]):
        hits += sig[:, i, None] == other[None, :, i]
    return hits


def likely(members: DataFrame, percent: int, agree: int) -> DataFrame:
    """g, rep, th: groups of members of a node whose sketches agree in ``agree`` places at least and whose sizes allow a link. Equal groups of several trees
    have one name and are kept once."""
    def compare(batches):
        for _, rows in runs(batches, ["node"]):
            rep, th = np.array([r["rep"] for r in rows]), np.array([r["th"] for r in rows])
            n = np.array([r["n"] for r in rows], dtype=float)
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
            near = (agreeing(sig, sig) >= agree) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
            root = np.arange(len(rep))
            for i in range(1, len(rep)):
                for r in set(root[:i][near[i, :i]].tolist()):
                    root[root == r] = i
            for r in set(root.tolist()):
                own, first = np.unique(rep[root == r], return_index=True)
                if len(own) > 1:
                    name = int.from_bytes(hashlib.md5(own.tobytes()).digest()[:8], "little", signed=True)
                    yield pa.RecordBatch.from_pydict({"g": [name] * len(own), "rep": own.tolist(), "th": th[root == r][first].tolist()})

    near = members.repartition(spread(members.sparkSession), "node").sortWithinPartitions("node")
    return near.mapInArrow(compare, "g long, rep long, th long").dropDuplicates(["g", "rep"])


class Members:
    """A block of a large node: what is compared, and the sets of words where their texts came along."""

    def __init__(self, parts: list[pa.RecordBatch], k: int):
        table = pa.Table.from_batches(parts).combine_chunks()
        self.rep, self.n, self.component = (table.column(c).to_numpy() for c in ("rep", "n", "component"))
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(len(self.rep), -1)
        self.last = table.column("last").combine_chunks().flatten().to_numpy().reshape(len(self.rep), -1)
        self.texts = table.column("_text").to_pylist() if "_text" in table.column_names else None
        self.k, self.held = k, None

    @property
    def sets(self) -> list[np.ndarray]:
        if self.held is None:
            self.held = list(shingle_sets([x or "" for x in self.texts], self.k))
        return self.held

    def candidates(self, other: Members, tree: int, percent: int, agree: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different components that sketches and sizes allow and that shared no node of an earlier tree, likeliest first."""
        common = np.bincount(np.unique(np.concatenate([self.component, other.component]), return_inverse=True)[1]).argmax()
        most = np.unique(np.concatenate([self.component, other.component]))[common]
        found = []
        for mine, theirs in ((np.flatnonzero(self.component != most), np.arange(len(other.rep))), (np.flatnonzero(self.component == most), np.flatnonzero(other.component != most))):
            for lo in range(0, len(mine), 256):
                i = mine[lo:lo + 256]
                hits = agreeing(self.sig[i], other.sig[theirs])
                n, m = self.n[i][:, None], other.n[theirs][None, :]
                good = (hits >= agree) & (self.component[i][:, None] != other.component[theirs][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                a, b = np.nonzero(good)
                if len(a):
                    a, b, h = i[a], theirs[b], hits[a, b]
                    fresh = self.rep[a] != other.rep[b] if other is not self else self.rep[a] < self.rep[b]
                    fresh &= ~(self.last[a, :tree] == other.last[b, :tree]).any(axis=1)
                    found.append((a[fresh], b[fresh], h[fresh]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        a, b, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-h.astype(np.int64), kind="stable")
        return a[order], b[order]


def blocks_met(members: DataFrame, k: int, block: int, visit, schema: str) -> DataFrame:
    """``visit(tree, block, other)`` for every pair of blocks of a large node, itself included: members are dealt into blocks by hash, and each pair of blocks is one group of a stream."""
    size = members.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_blocks"))
    sent = members.join(size, "node").withColumn("_own", F.pmod(F.xxhash64("rep", "node"), "_blocks").cast("int"))
    sent = sent.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sent = sent.withColumns({"low": F.least("_own", "_with"), "high": F.greatest("_own", "_with"), "side": (F.col("_own") > F.col("_with")).cast("int")}).drop("_blocks", "_with", "_own")

    def meet(batches):
        key, parts = None, {0: [], 1: []}

        def met():
            one = Members(parts[0], k)
            two = one if key[1] == key[2] else Members(parts[1], k) if parts[1] else None
            if two is not None:
                yield from visit(key[3], one, two)

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("node", "low", "high", "tree", "side")], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if hi > lo:
                    if tuple(keys[lo][:4].tolist()) != key:
                        if parts[0]:
                            yield from met()
                        key, parts = tuple(keys[lo][:4].tolist()), {0: [], 1: []}
                    parts[int(keys[lo][4])].append(batch.slice(lo, hi - lo))
        if parts[0]:
            yield from met()

    return sent.repartition(spread(members.sparkSession), "node", "low", "high").sortWithinPartitions("node", "low", "high", "side").mapInArrow(meet, schema)


def apart(large: DataFrame, classes: DataFrame, label: DataFrame, texts: DataFrame, k: int, percent: int, agree: int) -> DataFrame:
    """a, b: links between members of large nodes that are in different components so far; enough of them to join the components that are linked.

    A pair is met in the first tree in which both share a large node, once. Sketches name the members that have such a partner; those come with their texts, and the pairs are confirmed on
    the full sets where the blocks meet, likeliest first and not again once both sides are joined. No pair is written, only links.
    """
    cols = ["node", "tree", "rep", "n", "component", "sig", "last"]
    known = classes.select("rep", "th", "n", "sig", "last").join(label.select(F.col("id").alias("_l"), F.col("component").alias("_c")), F.col("rep") == F.col("_l"), "left")
    at = large.select("node", "tree", "rep").join(known.select("rep", "th", "n", "sig", "last", F.coalesce("_c", "rep").alias("component")), "rep")
    several = at.groupBy("node").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("node")
    at = materialise(at.join(several, "node"), "apart")

    def active(tree, one, two):
        a, b = one.candidates(two, tree, percent, agree)
        rep = np.union1d(one.rep[a], two.rep[b])
        if len(rep):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rep), 0) + tree), pa.array(rep)], names=["tree", "rep"])

    some = blocks_met(at.select(*cols), k, 2048, active, "tree long, rep long").distinct()
    some = materialise(at.join(some, ["tree", "rep"]), "active")
    read = texts.join(some.select(F.col("rep").alias("_id"), F.col("th").alias("_th")).distinct(), ["_id", "_th"]).dropDuplicates(["_id", "_th"])
    full = some.join(read, (F.col("rep") == F.col("_id")) & (F.col("th") == F.col("_th"))).select(*cols, "_text")

    def confirmed(tree, one, two):
        a, b = one.candidates(two, tree, percent, agree)
        if not len(a):
            return
        root: dict[int, int] = {}

        def top(c):
            while c in root:
                c = root[c]
            return c

        links = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            c, d = top(int(one.component[i])), top(int(two.component[j]))
            if c != d:
                x, y = one.sets[i], two.sets[j]
                at_x = np.searchsorted(x, y)
                both = int((x[np.minimum(at_x, len(x) - 1)] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[max(c, d)] = min(c, d)
                    links.append((int(one.rep[i]), int(two.rep[j])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    return blocks_met(full, k, 512, confirmed, "a long, b long").distinct()


def n_trees(percent: float, recall: float, depth: int) -> int:
    """Trees in one of which a pair of the limit's similarity shares all levels with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** depth))) if percent < 100 else 1


def places(n: int, s: float, miss: float = 1e-6) -> int:
    """The most of n places in which two sets of similarity s agree but for a probability of ``miss``."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * s ** k * (1 - s) ** (n - k)
        if below >= miss:
            return k
    return n


def confirm(groups: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: every member of a group that links confirmed on the full sets connect to others, and the smallest member it reaches so. Pairs that
    confirmed links already connect are not compared again."""
    named = small(groups.select(F.col("rep").alias("_rep"), "th", "g"), groups.count())
    read = texts.join(named, (F.col("_id") == F.col("_rep")) & (F.col("_th") == F.col("th"))).select("g", "_rep", "_text")

    def compare(batches):
        for _, rows in runs(batches, ["g"]):
            sets = list(shingle_sets([r["_text"] or "" for r in rows], k))
            order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
            root = list(range(len(rows)))
            for x, i in enumerate(order):
                for j in order[:x][::-1]:
                    if 100 * len(sets[j]) < percent * len(sets[i]):
                        break
                    if root[i] != root[j]:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                            root = [root[i] if r == root[j] else r for r in root]
            least = {}
            for i, r in enumerate(root):
                least[r] = min(least.get(r, rows[i]["_rep"]), rows[i]["_rep"])
            links = [(row["_rep"], least[r]) for row, r in zip(rows, root, strict=True) if row["_rep"] != least[r]]
            if links:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in links], "b": [b for _, b in links]})

    return read.repartition(spread(groups.sparkSession), "g").sortWithinPartitions("g").mapInArrow(compare, "a long, b long").distinct()


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 85, recall: float = 0.9999, depth: int = 4, most: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with ``n_shingles`` (size of its set of k-word shingles), ``component_id`` (smallest id reachable over links of at least ``percent``
    per cent Jaccard similarity, its own included) and ``kept`` (its id is that).

    Equal sets are one class from the start, however many copies there are. One document of each class then follows, in every tree, the path of its
    minwise tokens (see ``nodes``); two documents of similarity s share the first d levels with probability s^d, and the number of trees is
    such that a pair of the limit's similarity shares all ``depth`` levels in one of them with probability ``recall``. Small nodes are compared exhaustively, first
    on the sketches (a pair of the limit's similarity agrees in fewer than ``agree`` places with a probability below one in a million), then on the full sets.
    A node that stays large is a group of near copies or shares a long passage: it is dealt into buckets, its smallest member in each, which joins most near copies. Then
    its blocks meet, and pairs of different components are compared on the sketches and, where these allow it, on the full sets on the spot (see ``apart``). So no link is lost and no
    pair is written; comparisons of sketches grow with the square of what such a node has outside its largest component.

    Sketches, groups, links and labels are written to the shared folder; none is collected. Null and empty texts have empty sets, link with nothing and are kept. Rows
    with a null id link with nothing, have a null component and are kept. Rows that share an id are named as one. Input columns named like an added one are replaced.
    """
    trees = n_trees(percent, recall, depth)
    work = pack(docs, ADDED, _id=id_col, _text=text_col).withColumn("_th", F.xxhash64("_text")).withColumn("_id", F.col("_id").cast("long"))
    drawn = materialise(sketches(work, k, trees, depth), "sketches")
    named = drawn.where("n > 0 and _id is not null")
    last = F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.element_at("path", t * depth))
    classes = materialise(named.groupBy("n", "fa", "fb").agg(F.min_by(F.struct("_id", "_th", "path", "sig"), F.struct("_id", "_th")).alias("_m")).select(
        "n", "fa", "fb", F.col("_m._id").alias("rep"), F.col("_m._th").alias("th"), F.col("_m.sig").alias("sig"), F.col("_m.path").alias("path")).withColumn("last", last), "classes")
    texts = work.select("_id", "_th", "_text")
    agree = places(trees * depth + SKETCH, percent / 100)
    leaves, large = nodes(classes, trees, depth, most)
    seen = classes.select("rep", "th", "n", "sig")

    links = materialise(confirm(materialise(likely(leaves.join(seen, "rep"), percent, agree), "groups"), texts, k, percent), "links")
    if not large.isEmpty():
        first = large.groupBy("rep").agg(F.min_by(F.struct("node", "size"), "tree").alias("_m")).select("rep", "_m.*")      # one large node of each member is enough to join most of them
        led = first.join(first.groupBy("node").agg(F.min("rep").alias("lead")), "node").withColumn("_node", F.xxhash64("node", F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("size") / most))))
        inside = led.select(F.col("_node").alias("node"), "rep").unionByName(led.select(F.col("_node").alias("node"), F.col("lead").alias("rep"))).distinct()
        links = links.unionByName(materialise(confirm(materialise(likely(inside.join(seen, "rep"), percent, agree), "groups"), texts, k, percent), "links"))
        links = links.unionByName(materialise(apart(large, classes, components(links), texts, k, percent, agree), "links"))
    label = components(links).select(F.col("id").alias("_l"), "component")
    final = classes.join(label, F.col("rep") == F.col("_l"), "left").select(F.col("n").alias("_n"), F.col("fa").alias("_fa"), F.col("fb").alias("_fb"), F.coalesce("component", "rep").alias("_c"))
    placed = (drawn.select("_id", "_th", "n", "fa", "fb").dropDuplicates(["_id", "_th"]).join(final, (F.col("n") == F.col("_n")) & (F.col("fa") == F.col("_fa")) & (F.col("fb") == F.col("_fb")), "left")
              .select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), "n", F.when(F.col("n") > 0, F.col("_c")).otherwise(F.col("_id")).alias("_c")))
    placed = placed.withColumn("_c", F.when(F.col("_i").isNotNull(), F.col("_c")))
    out = work.drop("_text").join(placed, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")))
    return out.select("_row.*", F.col("n").alias("n_shingles"), F.col("_c").alias("component_id"), F.coalesce(F.col("_c") == F.col("_id"), F.lit(True)).alias("kept"))
