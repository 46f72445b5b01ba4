"""Corpus curation queries: provenance, splits, duplicates, samples. Documents stand in for photos,
their text for the photo's content."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions.hashing import order_key, unit_draw
from kerbline.operators import sampling as S
from kerbline.operators import similarity as N
from kerbline.operators import splits as L
from kerbline.operators.manifest import corpus_manifest, jet_to_index
from kerbline.plans.registry import query
from kerbline.storage import materialise


def photos(t):
    return t.documents.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("photo"))


PHOTOS = "photos AS (SELECT doc_id, lang, source, n_chars, md5(text) AS photo FROM documents)"

ROW_SPLIT = "CASE WHEN ('0x'||substr(md5('5|'||doc_id),1,8))::BIGINT/4294967296.0 < 0.25 THEN 'test' ELSE 'train' END"


def row_split(df):
    """A split drawn per file, the leaky way."""
    return df.withColumn("split", F.when(unit_draw(order_key(5, "doc_id")) < 0.25, "test").otherwise("train"))


@query("grouped_split", f"""
WITH {PHOTOS}, g AS (SELECT photo, row_number() OVER (ORDER BY md5('20260909|'||photo)) AS rn, count(*) OVER () AS n
                     FROM (SELECT DISTINCT photo FROM photos))
SELECT doc_id, CASE WHEN rn <= greatest(1, round_even(n*0.25, 0)) THEN 'test' ELSE 'train' END AS split
FROM photos JOIN g USING (photo)""")
def _(t):
    return L.grouped_split(photos(t), ["photo"], 0.25).select("doc_id", "split")


@query("audit_splits", f"""
WITH {PHOTOS}, g AS (SELECT photo, row_number() OVER (ORDER BY md5('20260909|'||photo)) AS rn, count(*) OVER () AS n
                     FROM (SELECT DISTINCT photo FROM photos)),
s AS (SELECT 'by_file' AS scheme, photo, {ROW_SPLIT} AS split FROM photos
      UNION ALL SELECT 'by_photo', photo, CASE WHEN rn <= greatest(1, round_even(n*0.25, 0)) THEN 'test' ELSE 'train' END
      FROM photos JOIN g USING (photo)),
d AS (SELECT DISTINCT scheme, photo, split FROM s),
size AS (SELECT scheme, split, count(*) AS n FROM d GROUP BY ALL)
SELECT a.scheme, a.split AS split_a, b.split AS split_b, count(*) AS shared, round(count(*)/any_value(size.n), 6) AS share_of_b
FROM d a JOIN d b ON a.scheme=b.scheme AND a.photo=b.photo AND a.split<b.split
JOIN size ON size.scheme=b.scheme AND size.split=b.split GROUP BY 1,2,3""")
def _(t):
    by_file = row_split(photos(t)).withColumn("scheme", F.lit("by_file"))
    by_photo = L.grouped_split(photos(t), ["photo"], 0.25).withColumn("scheme", F.lit("by_photo"))
    return L.audit_splits(by_file.unionByName(by_photo), "split", "photo", ["scheme"])


@query("source_summary", f"""
WITH {PHOTOS} SELECT source, count(*) AS files, count(DISTINCT photo) AS photos,
round(count(*)/greatest(count(DISTINCT photo),1), 6) AS augmentation FROM photos GROUP BY source""")
def _(t):
    per_photo = photos(t).groupBy("source", "photo").agg(F.count(F.lit(1)).alias("n"))
    return per_photo.groupBy("source").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("photos")).withColumn(
        "augmentation", F.round(F.col("files") / F.greatest("photos", F.lit(1)), 6))


@query("augmentation_groups", f"""
WITH {PHOTOS}, g AS (SELECT source, photo, count(*) AS n FROM photos GROUP BY ALL)
SELECT source, count(*) FILTER (n>1) AS photos_with_variants, max(n) AS largest FROM g GROUP BY source""")
def _(t):
    per_photo = photos(t).groupBy("source", "photo").agg(F.count(F.lit(1)).alias("n"))
    return per_photo.groupBy("source").agg(F.count_if(F.col("n") > 1).alias("photos_with_variants"), F.max("n").alias("largest"))


@query("split_pivot", f"""
WITH p AS (SELECT source, {ROW_SPLIT} AS split FROM documents)
SELECT coalesce(source,'TOTAL') AS source, count(*) FILTER (split='train') AS train, count(*) FILTER (split='test') AS test,
count(*) AS total FROM p GROUP BY ROLLUP(source)""")
def _(t):
    counts = row_split(photos(t)).rollup("source").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "test")], F.count(F.lit(1)).alias("total"))
    return counts.withColumn("source", F.coalesce("source", F.lit("TOTAL")))


@query("role_matrix", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus='F') AS f, count(*) FILTER (o_orderstatus='O') AS o,
count(*) FILTER (o_orderstatus='P') AS p FROM orders GROUP BY 1""")
def _(t):
    m = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return m.toDF("o_orderpriority", "f", "o", "p")


@query("distinct_photos", f"""
WITH {PHOTOS} SELECT photo, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM photos GROUP BY photo""")
def _(t):
    return S.distinct_photos(photos(t).select("doc_id", "source", "photo").withColumnRenamed("photo", "_p"), F.col("_p"), "doc_id").drop("_p")


@query("cumulative_assignment", """
WITH g AS (SELECT user_id, count(*) AS n, md5('20260909|'||user_id) AS h FROM events GROUP BY user_id),
b AS (SELECT user_id, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled FROM g),
t AS (SELECT count(*) AS n FROM events)
SELECT event_id, CASE WHEN filled < n*0.2 THEN 'test' WHEN filled < n*(0.2+0.1) THEN 'val' ELSE 'train' END AS split
FROM events JOIN b USING (user_id), t""")
def _(t):
    return L.cumulative_assignment(t.events.select("event_id", "user_id"), ["user_id"]).select("event_id", "split")


@query("fraction_split", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|'||o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= floor(n*0.8) THEN 'train' WHEN rn <= floor(n*0.8)+floor(n*0.1) THEN 'valid' ELSE 'test' END AS split FROM r""")
def _(t):
    return L.fraction_split(t.orders.select("o_orderkey"), ["o_orderkey"], {"train": 0.8, "valid": 0.1}, "test")


@query("group_kfold", """
WITH g AS (SELECT c_custkey, r AS repeat FROM (SELECT DISTINCT c_custkey FROM customer), (VALUES (0),(1),(2)) v(r))
SELECT repeat, c_custkey, CAST((row_number() OVER (PARTITION BY repeat ORDER BY md5((20260924+repeat)||'|'||c_custkey))-1) % 5 AS INT) AS fold FROM g""")
def _(t):
    return L.group_kfold(t.customer, "c_custkey")


@query("exact_dedup", """
WITH r AS (SELECT doc_id, md5(text) AS m, CASE WHEN source='src0' THEN 0 WHEN source='src1' THEN 1 WHEN source='src2' THEN 2 ELSE 3 END AS p FROM documents)
SELECT doc_id, m AS content_md5, count(*) OVER (PARTITION BY m) AS copies,
CASE WHEN row_number() OVER (PARTITION BY m ORDER BY p, doc_id)=1 THEN 'kept' ELSE 'removed_duplicate' END AS status FROM r""")
def _(t):
    priority = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).when(F.col("source") == "src2", 2).otherwise(3)
    return L.exact_dedup(t.documents, F.col("text"), priority, "doc_id").select("doc_id", "content_md5", "copies", "status")


@query("update_status", """
SELECT doc_id, source, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY md5(text)) THEN 'removed_duplicate' ELSE 'ok' END AS status FROM documents""")
def _(t):
    report = t.documents.select("doc_id", "source", F.lit("ok").alias("status"))
    marked = L.exact_dedup(t.documents, F.col("text"), F.lit(0), "doc_id")
    removed = marked.where("status = 'removed_duplicate'").select("doc_id", F.lit(True).alias("gone"))
    return report.join(removed, "doc_id", "left").select(
        "doc_id", "source", F.when(F.col("gone"), "removed_duplicate").otherwise(F.col("status")).alias("status"))


@query("pair_fold_exclusion", """
WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier),
n AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5('7|'||s_suppkey))-1 AS k, count(*) OVER () AS n FROM s),
f AS (SELECT s_suppkey, CAST((row_number() OVER (ORDER BY md5('11|'||s_suppkey))-1) % 5 AS INT) AS fold FROM s),
p AS (SELECT DISTINCT least(a.s_suppkey,b.s_suppkey) AS pool_a, greatest(a.s_suppkey,b.s_suppkey) AS pool_b
      FROM n a, generate_series(1,6) d(i), n b
      WHERE b.k = ('0x'||substr(md5('7|'||a.s_suppkey||'|'||d.i),1,8))::BIGINT % a.n
      AND (SELECT s_nationkey FROM s WHERE s_suppkey=a.s_suppkey) <> (SELECT s_nationkey FROM s WHERE s_suppkey=b.s_suppkey)),
q AS (SELECT *, row_number() OVER (ORDER BY md5('7|'||pool_a||'|'||pool_b)) AS rn FROM p)
SELECT pool_a, pool_b, list_sort(list_distinct([fa.fold, fb.fold])) AS test_folds
FROM q JOIN f fa ON fa.s_suppkey=pool_a JOIN f fb ON fb.s_suppkey=pool_b WHERE rn <= (SELECT round_even(count(*)*2.0, 0) FROM s)""")
def _(t):
    folds = L.group_kfold(t.supplier, "s_suppkey", 5, 1, 11)
    pairs = S.random_pairs(t.supplier, "s_suppkey", "s_nationkey", 4, 7)
    return L.pair_fold_exclusion(pairs, folds, "pool_a", "pool_b", "s_suppkey", "fold")


@query("random_pairs", """
WITH n AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY md5('20261013|'||s_suppkey))-1 AS k, count(*) OVER () AS n FROM supplier),
p AS (SELECT DISTINCT least(a.s_suppkey,b.s_suppkey) AS pool_a, greatest(a.s_suppkey,b.s_suppkey) AS pool_b
      FROM n a, generate_series(1,6) d(i), n b
      WHERE b.k = ('0x'||substr(md5('20261013|'||a.s_suppkey||'|'||d.i),1,8))::BIGINT % a.n AND a.s_nationkey <> b.s_nationkey),
q AS (SELECT *, row_number() OVER (ORDER BY md5('20261013|'||pool_a||'|'||pool_b)) AS rn FROM p)
SELECT pool_a, pool_b FROM q WHERE rn <= (SELECT round_even(count(*)*2.0, 0) FROM supplier)""")
def _(t):
    return S.random_pairs(t.supplier, "s_suppkey", "s_nationkey")


@query("training_union", """
SELECT doc_id, 'base' AS role FROM labels WHERE quality=1 UNION ALL SELECT doc_id, 'negative' FROM labels WHERE quality=0
UNION ALL SELECT doc_id, 'box' FROM labels WHERE toxic=1""")
def _(t):
    lab = t.labels
    return L.training_union({"base": lab.where("quality = 1").select("doc_id"), "negative": lab.where("quality = 0").select("doc_id"),
                             "box": lab.where("toxic = 1").select("doc_id")})


@query("except_consensus", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id")).distinct()


@query("covers", """
SELECT count(*) AS missing, count(*)=0 AS covered FROM (SELECT DISTINCT l_orderkey FROM lineitem) l
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey=l_orderkey AND o_orderstatus<>'P')""")
def _(t):
    cache = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return L.covers(cache, t.lineitem.select(F.col("l_orderkey").alias("k")), ["k"])


@query("train_list_repeat", """
SELECT doc_id, CAST(r AS INT) AS repeat FROM labels, LATERAL (SELECT unnest(generate_series(1, CASE WHEN toxic=1 THEN 4 ELSE 1 END)) AS r)""")
def _(t):
    return L.oversample(t.labels, F.when(F.col("toxic") == 1, 4).otherwise(1)).select("doc_id", "repeat")


@query("split_membership", """
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='R') AS in_test FROM orders""")
def _(t):
    keys = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = t.orders.select("o_orderkey")
    inside = L.split_members(orders, keys, ["o_orderkey"]).withColumn("in_test", F.lit(True))
    return inside.unionByName(L.split_members(orders, keys, ["o_orderkey"], keep=False).withColumn("in_test", F.lit(False)))


@query("hold_out_runner_up", """
SELECT doc_id, source = (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality=1 GROUP BY source ORDER BY count(*) DESC, source LIMIT 1 OFFSET 1) AS held_out
FROM documents""")
def _(t):
    n = (t.documents.select("doc_id", "source").join(t.labels.where("quality = 1").select("doc_id"), "doc_id")
         .groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    return t.documents.select("doc_id", (F.col("source") == L.hold_out_runner_up(n, "source", "n")).alias("held_out"))


@query("top_k_volumes", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5""")
def _(t):
    return S.top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
                   [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 5)


@query("top_k_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
WHERE rn <= 3""")
def _(t):
    return S.top_k_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"],
                             [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("round_robin", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('3|'||doc_id)) AS turn FROM documents)
SELECT doc_id, lang, turn FROM r WHERE turn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""")
def _(t):
    d = t.documents.select("doc_id", "lang").withColumn("h", order_key(3, "doc_id"))
    return S.round_robin(d, "lang", "h").select("doc_id", "lang", "turn")


@query("deal_in_rotation", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY lang, md5('13|'||doc_id)) - 1 AS k FROM documents)
SELECT doc_id, ['ana;ben','ana;cy','ben;cy'][CAST(k % 3 AS INT)+1] AS assigned_to FROM r""")
def _(t):
    return S.deal_in_rotation(t.documents.select("doc_id", "lang"), "doc_id", "lang", ["ana", "ben", "cy"], 2, 13).select("doc_id", "assigned_to")


@query("quota_sample", f"""
WITH {PHOTOS}, a AS (SELECT *, row_number() OVER (PARTITION BY source, photo ORDER BY doc_id) AS i FROM photos),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('20260929|'||photo), doc_id) AS s FROM a WHERE i<=2)
SELECT source, photo, doc_id, row_number() OVER (ORDER BY md5('20260929|'||photo||'|'||doc_id)) AS position FROM b WHERE s<=12""")
def _(t):
    return S.quota_sample(photos(t).select("source", "photo", "doc_id"), "source", "photo", "doc_id", 12)


@query("stratified_negatives", """
SELECT doc_id, lang, kind, CAST(rn AS INT) AS rn FROM (SELECT doc_id, lang, toxic AS kind, row_number() OVER (PARTITION BY lang, toxic ORDER BY md5('17|'||doc_id), doc_id) AS rn
FROM documents JOIN labels USING (doc_id)) WHERE rn <= 5""")
def _(t):
    d = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.col("toxic").alias("kind")), "doc_id")
    return S.stratified_sample(d, ["lang", "kind"], "doc_id", 5, 17)


@query("enriched_sample", """
WITH d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('42|'||doc_id)) AS rn FROM documents),
p AS (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS low FROM d WHERE rn>30 AND rn<=430)
SELECT doc_id, 'random' AS stratum FROM d WHERE rn<=30 UNION ALL SELECT doc_id, 'enriched' FROM p WHERE low<=30""")
def _(t):
    return S.enriched_sample(t.documents.select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 60).select("doc_id", "stratum")


WORDS = r"list_distinct(regexp_split_to_array(lower(text), '[ \t\n\r]+'))"
SIM = (f"w AS (SELECT doc_id, source, unnest({WORDS}) AS w FROM documents), "
       "b AS (SELECT doc_id, source, ('0x'||substr(md5(w),1,8))::BIGINT AS hi, ('0x'||substr(md5(w),9,8))::BIGINT AS lo FROM w), "
       "s AS (SELECT doc_id, any_value(source) AS source, "
       + " || ".join(f"CASE WHEN 2*sum(({'hi' if i < 32 else 'lo'} >> {31 - i % 32}) & 1) > count(*) THEN '1' ELSE '0' END" for i in range(64))
       + " AS h FROM b GROUP BY doc_id)")


def simhash(df, key, text):
    """Demo stand-in for a photo hash, over the whole text: each of 64 bits is the majority over the md5 of its distinct
    words. The library itself takes the hash as a column. Words are counted where they are read, so one row of sums per text moves."""
    lanes = 1 | 1 << 21 | 1 << 42                                               # three counters of 21 bits to a number: bits a, a + 21 and a + 42 of all words at once
    word = df.select(*key, F.explode(F.array_distinct(F.split(F.lower(text), "[ \t\n\r]+"))).alias("w")).withColumn("w", F.md5("w"))
    hi, lo = (F.conv(F.substring("w", at, 8), 16, 10).cast("long") for at in (1, 9))
    h = word.select(*key, F.shiftleft(hi, 32).bitwiseOR(lo).alias("h"))
    some = h.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned("h", a).bitwiseAND(lanes)).alias(f"s{a}") for a in range(21)], F.sum(F.shiftrightunsigned("h", 63)).alias("s63"))
    ones = {k: F.col("s63") if k == 63 else F.shiftright(F.col(f"s{k % 21}"), 21 * (k // 21)).bitwiseAND((1 << 21) - 1) for k in range(64)}
    bits = [F.when(2 * v > F.col("n"), F.lit((1 << k) - (1 << 64 if k == 63 else 0))).otherwise(F.lit(0)).cast("long") for k, v in ones.items()]
    return some.select(*key, sum(bits[1:], bits[0]).alias("phash"))


def hashed(t):
    # the index is read several times below, so it is written once, as a provenance index keeps its hash column
    return materialise(simhash(t.documents, ["doc_id", "source"], "text"), "photo_index")


@query("near_duplicates", f"""
WITH {SIM}, n AS (SELECT a.source AS source_a, b.source AS source_b, a.doc_id AS fa, b.doc_id AS fb FROM s a JOIN s b
ON a.source < b.source AND bit_count(xor(a.h::BIT, b.h::BIT)) <= 6)
SELECT source_a, source_b, count(DISTINCT fa) AS files_a, min(fa) AS example_a, arg_min(fb, (fa, fb)) AS example_b FROM n GROUP BY 1, 2""")
def _(t):
    return N.near_duplicates(hashed(t), "source", "doc_id", "phash")


@query("nearest_reference", f"""
WITH {SIM}, r AS (SELECT * FROM s WHERE source IN ('src0','src1','src2','src3','src4')), p AS (SELECT * FROM s WHERE source NOT IN ('src0','src1','src2','src3','src4')),
m AS (SELECT p.doc_id, bit_count(xor(p.h::BIT, r.h::BIT)) AS d, r.doc_id AS rid, r.source AS rs FROM p JOIN r ON bit_count(xor(p.h::BIT, r.h::BIT)) <= 6),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, rid) AS rn FROM m)
SELECT p.doc_id, k.rid AS dup_of, k.rs AS dup_split, CAST(k.d AS INT) AS dup_distance FROM p LEFT JOIN k ON k.doc_id=p.doc_id AND k.rn=1""")
def _(t):
    h = hashed(t)
    known = F.col("source").isin("src0", "src1", "src2", "src3", "src4")
    out = N.nearest_reference(h.where(~known), "phash", h.where(known), "phash", "doc_id", "source")
    return out.select("doc_id", "dup_of", "dup_split", "dup_distance")


@query("corpus_manifest", f"""
WITH {SIM}, f AS (SELECT d.doc_id, lang, quality=1 AS pos, toxic=1 AS oth, s.h FROM documents d JOIN labels USING (doc_id) JOIN s ON s.doc_id=d.doc_id),
held AS (SELECT lang AS hl FROM f WHERE pos GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1 OFFSET 1), m AS (SELECT f.*, lang=hl AS held FROM f, held),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, oth ORDER BY md5('23|'||doc_id), doc_id) AS a, row_number() OVER (PARTITION BY held ORDER BY md5('23|'||doc_id), doc_id) AS b FROM m WHERE NOT pos),
u AS (SELECT doc_id, h, CASE WHEN held THEN 'box_test' ELSE 'box_train' END AS role FROM m WHERE pos UNION ALL SELECT doc_id, h, 'negative' FROM n WHERE NOT held AND a<=4 UNION ALL SELECT doc_id, h, 'neg_test' FROM n WHERE held AND b<=6),
r AS (SELECT doc_id, h FROM s WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id=s.doc_id))
SELECT u.doc_id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE bit_count(xor(u.h::BIT, r.h::BIT))<=6) THEN 'dropped' ELSE role END AS role FROM u""")
def _(t):
    h = hashed(t)
    frames = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").join(h.select("doc_id", "phash"), "doc_id")
    reference = h.join(t.labels, "doc_id", "left_anti")
    m = corpus_manifest(frames, "doc_id", "lang", F.col("quality") == 1, F.col("toxic") == 1, "phash", reference, "phash", "doc_id", "source", 4, 6, 23)
    return m.select("doc_id", "role")


@query("jet_to_index", """
WITH k AS (SELECT i, CAST(round(255*least(greatest(1.5-abs(4.0*i/255-1),0),1)) AS INT) AS b, CAST(round(255*least(greatest(1.5-abs(4.0*i/255-2),0),1)) AS INT) AS g, CAST(round(255*least(greatest(1.5-abs(4.0*i/255-3),0),1)) AS INT) AS r FROM (SELECT i::DOUBLE AS i FROM generate_series(0,255) v(i))),
c AS (SELECT DISTINCT CAST(l_quantity*5 AS INT) AS b, CAST(round(l_discount*2550) AS INT) AS g, CAST(round(l_tax*3000) AS INT) AS r FROM lineitem),
n AS (SELECT c.b, c.g, c.r, min(((c.b-k.b)*(c.b-k.b)+(c.g-k.g)*(c.g-k.g)+(c.r-k.r)*(c.r-k.r), CAST(i AS INT))) AS m FROM c, k GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m[2] AS jet_index, round(sqrt(m[1]),6) AS jet_distance FROM lineitem JOIN n ON b=CAST(l_quantity*5 AS INT) AND g=CAST(round(l_discount*2550) AS INT) AND r=CAST(round(l_tax*3000) AS INT)""")
def _(t):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    px = t.lineitem.select(*key, (F.col("l_quantity") * 5).cast("int").alias("b"), F.round(F.col("l_discount") * 2550).cast("int").alias("g"), F.round(F.col("l_tax") * 3000).cast("int").alias("r"))
    return jet_to_index(px).select(*key, "jet_index", F.round("jet_distance", 6).alias("jet_distance"))
