"""Join, window, quality and annotation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import annotation as N
from kerbline.operators import detection as X
from kerbline.operators import joins as J
from kerbline.operators import quality as Q
from kerbline.operators import windows as W
from kerbline.plans.registry import query

c = F.col

# ── joins ──


def pixels(t, flag):
    """Pixel sets on a 50 x 11 grid per supplier: one outline per line number."""
    return t.lineitem.where(c("l_returnflag") == flag).select(
        c("l_suppkey").alias("frame"), c("l_linenumber").alias("outline"), F.round(c("l_discount") * 100).cast("int").alias("y"),
        c("l_quantity").cast("int").alias("x")).distinct()


def px_sql(flag, name):
    return (f"{name} AS (SELECT DISTINCT l_suppkey AS frame, l_linenumber AS outline, CAST(round(l_discount*100) AS INT) AS y, CAST(l_quantity AS INT) AS x "
            f"FROM lineitem WHERE l_returnflag='{flag}')")


OVERLAP = f"""{px_sql('A', 'a')}, {px_sql('N', 'b')}, sa AS (SELECT frame, outline, count(*) AS n FROM a GROUP BY ALL), sb AS (SELECT frame, outline, count(*) AS n FROM b GROUP BY ALL),
o AS (SELECT a.frame, a.outline, b.outline AS pred, count(*) AS shared FROM a JOIN b ON a.frame=b.frame AND a.y=b.y AND a.x=b.x GROUP BY ALL),
i AS (SELECT o.*, sa.n AS area_a, sb.n AS area_b, shared/(sa.n+sb.n-shared) AS iou FROM o JOIN sa ON sa.frame=o.frame AND sa.outline=o.outline JOIN sb ON sb.frame=o.frame AND sb.outline=o.pred)"""


def overlaps(t):
    return J.overlap(pixels(t, "A"), pixels(t, "N").withColumnRenamed("outline", "pred"), ["frame"], "outline", "pred")


@query("iou_pairs", f"WITH {OVERLAP} SELECT frame, outline, pred, shared, area_a, area_b, round(iou,6) AS iou FROM i")
def _(t):
    return overlaps(t).withColumn("iou", F.round("iou", 6)).select("frame", "outline", "pred", "shared", "area_a", "area_b", "iou")


BEST = f"""{OVERLAP}, m AS (SELECT frame, outline, max(iou) AS best, arg_min(pred, (-iou, pred)) AS p FROM i GROUP BY ALL),
f AS (SELECT sa.frame, sa.outline, coalesce(best,0) AS best_iou, CASE WHEN best>=0.05 THEN p END AS matched FROM sa LEFT JOIN m ON m.frame=sa.frame AND m.outline=sa.outline)"""


def matched(t):
    truth = pixels(t, "A").select("frame", "outline").distinct()
    return J.best_match(truth, overlaps(t), ["frame"], "outline", "pred", 0.05)


@query("best_match", f"WITH {BEST} SELECT frame, outline, round(best_iou,6) AS best_iou, matched FROM f")
def _(t):
    return matched(t).withColumn("best_iou", F.round("best_iou", 6))


@query("detection_scores", f"""WITH {BEST.replace("best>=0.05", "best>=0.1")}, fp AS (SELECT count(*) AS n FROM sb LEFT JOIN (SELECT frame, pred, max(iou) AS best FROM i GROUP BY ALL) m ON m.frame=sb.frame AND m.pred=sb.outline WHERE coalesce(best,0)<0.1)
SELECT count(*) AS potholes, round(avg((best_iou>=0.5)::INT),6) AS found_strict, round(avg((best_iou>=0.1)::INT),6) AS found, round(avg(best_iou),6) AS mean_iou, (SELECT n FROM fp) AS false_outlines FROM f""")
def _(t):
    truth, preds = pixels(t, "A").select("frame", "outline").distinct(), pixels(t, "N").select("frame", c("outline").alias("pred")).distinct()
    s = X.detection_scores(truth, preds, overlaps(t), ["frame"], "outline", "pred")
    return s.withColumns({n: F.round(n, 6) for n in ("found_strict", "found", "mean_iou")})


@query("coverage", f"WITH {px_sql('A', 'a')}, {px_sql('R', 'w')}, d AS (SELECT DISTINCT frame, y, x FROM w) SELECT a.frame, a.outline, round(avg((d.x IS NOT NULL)::INT),6) AS coverage, count(*) AS px FROM a LEFT JOIN d ON a.frame=d.frame AND a.y=d.y AND a.x=d.x GROUP BY ALL")
def _(t):
    return J.coverage(pixels(t, "A"), pixels(t, "R"), ["frame"], "outline").withColumn("coverage", F.round("coverage", 6))


BOXES = "bx AS (SELECT s_suppkey AS frame, s_suppkey%3 AS box, CAST(s_suppkey%20 AS INT) AS x0, CAST(s_suppkey%20+25 AS INT) AS x1, CAST(s_nationkey%4 AS INT) AS y0, CAST(s_nationkey%4+6 AS INT) AS y1 FROM supplier)"
INSIDE = f"""{px_sql('N', 'p')}, {BOXES}, sz AS (SELECT frame, outline, count(*) AS pred_px FROM p GROUP BY ALL),
ins AS (SELECT p.frame, box, p.outline, count(*) FILTER (x>=x0 AND x<x1) AS inside, any_value((x1-x0)*(y1-y0)) AS box_px FROM p JOIN bx ON bx.frame=p.frame AND y>=y0 AND y<y1 GROUP BY ALL)"""


def in_boxes(t):
    s = t.supplier
    k, n = c("s_suppkey"), c("s_nationkey")
    boxes = s.select(k.alias("frame"), (k % 3).alias("box"), (k % 20).cast("int").alias("x0"), (k % 20 + 25).cast("int").alias("x1"),
                     (n % 4).cast("int").alias("y0"), (n % 4 + 6).cast("int").alias("y1"))
    return boxes, J.point_in_box(pixels(t, "N"), boxes, ["frame"], "outline", "box")


@query("point_in_box", f"WITH {INSIDE} SELECT i.frame, box, i.outline, CAST(inside AS BIGINT) AS inside, pred_px, box_px, inside>=0.5*pred_px AND inside>=0.1*box_px AS hit FROM ins i JOIN sz ON sz.frame=i.frame AND sz.outline=i.outline")
def _(t):
    return in_boxes(t)[1]


@query("box_recall", f"""WITH fr AS (SELECT s_suppkey AS frame, CASE s_suppkey%4 WHEN 0 THEN 'neg_test' ELSE 'box_test' END AS role FROM supplier), {px_sql('N', 'p')}, {BOXES},
lo AS (SELECT frame, box, CAST(trunc(greatest(0,x0-(x1-x0)*0.1/2)) AS INT) AS x0, CAST(trunc(least(51,x1+(x1-x0)*0.1/2)) AS INT) AS x1, CAST(trunc(greatest(0,y0-(y1-y0)*0.1/2)) AS INT) AS y0, CAST(trunc(least(11,y1+(y1-y0)*0.1/2)) AS INT) AS y1 FROM bx JOIN fr USING (frame) WHERE role='box_test'),
pp AS (SELECT p.*, role FROM p JOIN fr USING (frame)), sz AS (SELECT frame, outline, role, count(*) AS n, avg(y) AS my FROM pp GROUP BY ALL),
h AS (SELECT lo.frame, box, sz.outline, any_value(sz.n) AS n, count(*) AS inside, any_value(greatest((x1-x0)*(y1-y0),1)) AS area FROM lo JOIN pp ON pp.frame=lo.frame AND x>=x0 AND x<x1 AND y>=y0 AND y<y1 JOIN sz ON sz.frame=pp.frame AND sz.outline=pp.outline GROUP BY 1,2,3),
r AS (SELECT count(*) AS n_boxes, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.frame=lo.frame AND h.box=lo.box AND inside>=0.5*n AND inside>=0.1*area)) AS found FROM lo),
st AS (SELECT count(*) AS stray FROM sz WHERE role='box_test' AND NOT EXISTS (SELECT 1 FROM h WHERE h.frame=sz.frame AND h.outline=sz.outline AND inside>=0.1*h.n)), ng AS (SELECT count(*) AS masks, count(*) FILTER (my<11/3) AS top, count(DISTINCT frame) AS hit FROM sz WHERE role='neg_test')
SELECT round(found/n_boxes,6) AS box_recall, n_boxes, stray, round(stray/(SELECT count(*) FROM fr WHERE role='box_test'),6) AS stray_per_img, (SELECT count(*) FROM fr WHERE role='neg_test') AS n_neg_frames, round(coalesce(hit/nullif((SELECT count(*) FROM fr WHERE role='neg_test'),0),0),6) AS neg_frames_hit,
masks AS neg_masks, round(coalesce(masks/nullif((SELECT count(*) FROM fr WHERE role='neg_test'),0),0),6) AS neg_masks_per_img, top AS neg_masks_top_third FROM r, st, ng""")
def _(t):
    frames = t.supplier.select(c("s_suppkey").alias("frame"), F.when(c("s_suppkey") % 4 == 0, "neg_test").otherwise("box_test").alias("role"), F.lit(51).alias("w"), F.lit(11).alias("h"))
    s = X.box_recall(pixels(t, "N"), in_boxes(t)[0], frames, ["frame"], "outline", "box")
    return s.withColumns({n: F.round(n, 6) for n in ("box_recall", "stray_per_img", "neg_frames_hit", "neg_masks_per_img")})


@query("pair_frames", """
SELECT o_orderkey, any_value(o_orderstatus) AS image, count(DISTINCT l.l_linenumber) AS depths FROM orders JOIN lineitem l ON l.l_orderkey=o_orderkey AND l_returnflag='A'
WHERE EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey=o_orderkey AND r.l_returnflag='R') GROUP BY o_orderkey""")
def _(t):
    depth = t.lineitem.where("l_returnflag = 'A'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_linenumber").alias("depths"))
    label = t.lineitem.where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey")).distinct()
    return J.pair_frames(t.orders.select("o_orderkey", c("o_orderstatus").alias("image")), depth, label, "o_orderkey")


@query("unpaired_frames", """
WITH k AS (SELECT o_orderkey AS k, 1 AS i, 0 AS d, 0 AS l FROM orders UNION ALL SELECT l_orderkey, 0, 1, 0 FROM lineitem WHERE l_returnflag='A' UNION ALL SELECT l_orderkey, 0, 0, 1 FROM lineitem WHERE l_returnflag='R'),
s AS (SELECT k, max(i)=1 AS has_image, max(d)=1 AS has_depth, max(l)=1 AS has_label FROM k GROUP BY k) SELECT has_image, has_depth, has_label, count(*) AS frames FROM s GROUP BY ALL""")
def _(t):
    key = c("l_orderkey").alias("k")
    return J.unpaired(t.orders.select(c("o_orderkey").alias("k")), t.lineitem.where("l_returnflag = 'A'").select(key), t.lineitem.where("l_returnflag = 'R'").select(key), "k")


REGISTRY = [("http:", "plain web"), ("https:", "secure web"), ("https://m.ththth.example.net", "mobile"), ("https://m.ththth.example.net/en", "mobile english")]


@query("identify_source", """
SELECT page_id, CASE WHEN url LIKE 'https://m.ththth.example.net/en/%' THEN 'mobile english' WHEN url LIKE 'https://m.ththth.example.net/%' THEN 'mobile'
WHEN url LIKE 'https:/%' THEN 'secure web' WHEN url LIKE 'http:/%' THEN 'plain web' END AS source_id FROM pages""")
def _(t):
    return J.identify_source(t.pages.select("page_id", "url"), "url", REGISTRY).select("page_id", "source_id")


@query("label_override", """
WITH r AS (SELECT md5(text) AS photo, arg_min(quality, doc_id) AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT doc_id, coalesce(q, CASE WHEN n_chars>800 THEN 1 ELSE 0 END) AS label, CASE WHEN q IS NULL THEN 'pseudo' ELSE 'measured' END AS label_source FROM documents LEFT JOIN r ON r.photo=md5(text)""")
def _(t):
    docs = t.documents.select("doc_id", F.md5("text").alias("photo"), F.when(c("n_chars") > 800, 1).otherwise(0).alias("label"))
    real = docs.select("doc_id", "photo").join(t.labels.select("doc_id", c("quality").alias("label")), "doc_id")
    return J.label_override(docs, real, "photo", "label", "doc_id").select("doc_id", "label", "label_source")


@query("asof_drive", """
SELECT e.event_id, e.user_id, d.event_id AS drive FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type='purchase') d ON e.user_id=d.user_id AND e.ts>=d.ts""")
def _(t):
    e = t.events.select("event_id", "user_id", "ts")
    starts = t.events.where("event_type = 'purchase'").select("user_id", c("ts").alias("start_ts"), c("event_id").alias("start_id"))
    return J.asof(e, starts, ["user_id"], "ts", "start_ts", "start_id", "drive").drop("ts")


@query("resume", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey)")
def _(t):
    return J.resume(t.orders.select("o_orderkey"), t.lineitem.select(c("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("feature_cache", """
WITH k AS (SELECT doc_id, CASE WHEN lang='de' THEN doc_id::VARCHAR ELSE doc_id||'|'||substr(md5(text),1,8) END AS cache_key, n_chars, source FROM documents)
SELECT doc_id, cache_key, CASE WHEN source IN ('src0','src1','src2') THEN -1 ELSE n_chars*2 END AS score, source IN ('src0','src1','src2') AS from_cache FROM k""")
def _(t):
    d = t.documents.select("doc_id", "lang", "n_chars", "source", F.when(c("lang") != "de", c("text")).alias("polygon"))
    key = F.when(c("polygon").isNotNull(), F.concat(c("doc_id").cast("string"), F.lit("|"), F.substring(F.md5("polygon"), 1, 8))).otherwise(c("doc_id").cast("string"))
    cache = d.where(c("source").isin("src0", "src1", "src2")).select(key.alias("cache_key"), F.lit(-1).cast("bigint").alias("score"))
    return J.with_cache(d, cache, "doc_id", c("polygon"), "score", c("n_chars") * 2).select("doc_id", "cache_key", "score", "from_cache")


# ── windows ──


@query("capture_sessions", """
WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events)
SELECT event_id, user_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM g""")
def _(t):
    return W.capture_sessions(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", 6 * 3600).select("event_id", "user_id", "session")


@query("rank_pct", """
WITH r AS (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_quantity) AS ties, count(*) OVER () AS n FROM lineitem)
SELECT DISTINCT l_quantity, round((r+(ties-1)/2)/n, 8) AS rank_pct FROM r""")
def _(t):
    return W.rank_pct(t.lineitem.select("l_quantity"), "l_quantity").select("l_quantity", F.round("rank_pct", 8).alias("rank_pct"))


@query("spearman", """
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)+(count(*) OVER (PARTITION BY l_returnflag, l_quantity)-1)/2 AS a,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)+(count(*) OVER (PARTITION BY l_returnflag, l_extendedprice)-1)/2 AS b FROM lineitem)
SELECT l_returnflag, round(corr(a,b),6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def _(t):
    return W.spearman(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("rho", F.round("rho", 6))


@query("sign_changes", """
WITH s AS (SELECT user_id, sign(value-60) AS s, lag(sign(value-60)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, CAST(sum(CASE WHEN s<>p THEN 1 ELSE 0 END) AS BIGINT) AS sign_changes, count(*) AS points FROM s GROUP BY user_id""")
def _(t):
    e = t.events.select("user_id", "event_id", (c("value") - 60).alias("v"))
    return W.sign_changes(e, ["user_id"], "event_id", F.floor(c("event_id") / 100000), "v")


@query("monotone_exceedance", """
WITH p AS (SELECT user_id, k, avg((value > k*40 - (user_id%3)*30*(k%2))::INT) AS p FROM events, (VALUES (1),(2),(3),(4)) v(k) GROUP BY ALL)
SELECT user_id, k, round(min(p) OVER (PARTITION BY user_id ORDER BY k),6) AS p FROM p""")
def _(t):
    e = t.events.select("user_id", "value", F.explode(F.array(*[F.lit(k) for k in range(1, 5)])).alias("k"))
    p = e.groupBy("user_id", "k").agg(F.avg((c("value") > c("k") * 40 - (c("user_id") % 3) * 30 * (c("k") % 2)).cast("int")).alias("p"))
    return J.running_min(p, ["user_id"], "k", "p", "p").withColumn("p", F.round("p", 6))


@query("percentile_of_score", """
WITH pool AS (SELECT l_extendedprice AS v FROM lineitem), n AS (SELECT count(*) AS n FROM pool), r AS (SELECT v, rank() OVER (ORDER BY v)-1 AS below FROM pool)
SELECT o_orderkey, round(coalesce((SELECT max(below+c) FROM (SELECT any_value(below) AS below, count(*) AS c FROM r WHERE v=(SELECT max(v) FROM pool WHERE v < o_totalprice) GROUP BY v)),0)/any_value(n.n),8) AS percentile
FROM orders, n GROUP BY o_orderkey, o_totalprice""".replace("""SELECT o_orderkey, round(coalesce((SELECT max(below+c) FROM (SELECT any_value(below) AS below, count(*) AS c FROM r WHERE v=(SELECT max(v) FROM pool WHERE v < o_totalprice) GROUP BY v)),0)/any_value(n.n),8) AS percentile
FROM orders, n GROUP BY o_orderkey, o_totalprice""", """, u AS (SELECT o_orderkey AS k, o_totalprice AS v, 0 AS w FROM orders UNION ALL SELECT NULL, v, 1 FROM pool),
x AS (SELECT k, sum(w) OVER (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) - w AS below FROM u)
SELECT k AS o_orderkey, round(coalesce(below,0)/(SELECT n FROM n),8) AS percentile FROM x WHERE k IS NOT NULL"""))
def _(t):
    out = W.percentile_of_score(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", t.lineitem, "l_extendedprice")
    return out.select("o_orderkey", F.round("percentile", 8).alias("percentile"))


# ── quality ──



@query("verify_labels", """
WITH d AS (SELECT doc_id, lang<>'de' AS has_label, n_chars, doc_id%9 AS k FROM documents),
r AS (SELECT doc_id, list_filter([CASE WHEN NOT has_label THEN 'Missing label file' END, CASE WHEN has_label AND doc_id%10=5 THEN 'Empty label file' END, CASE WHEN n_chars<100 THEN 'Image smaller than 100x100' END,
CASE WHEN has_label AND doc_id%10<>5 AND k=0 THEN 'Label class is not 0 on line 1' END, CASE WHEN has_label AND doc_id%10<>5 AND k=1 THEN 'Not enough coordinates (min 6) on line 1' END,
CASE WHEN has_label AND doc_id%10<>5 AND k=2 THEN 'Non-float coordinate on line 1' END, CASE WHEN has_label AND doc_id%10<>5 AND k=3 THEN 'Coordinate out of range [0.0, 1.0] on line 1' END], lambda x: x IS NOT NULL) AS r FROM d)
SELECT doc_id, array_to_string(r, '; ') AS reasons, len(r)>0 AS quarantined FROM r""")
def _(t):
    k = c("doc_id") % 9
    good = "0 0.1 0.2 0.3 0.4 0.5 0.6"
    line = (F.when(k == 0, "1" + good[1:]).when(k == 1, "0 0.1 0.2 0.3").when(k == 2, "0 0.1 0.2 0.3 0.4 0.5 x").when(k == 3, good.replace("0.2", "1.2")).otherwise(good))
    frames = t.documents.select("doc_id", (c("lang") != "de").alias("has_label"), c("n_chars").alias("width"), c("n_chars").alias("height"))
    lines = t.documents.where("lang <> 'de' AND doc_id % 10 <> 5").select("doc_id", F.lit(1).alias("line_no"), line.alias("line"))
    out = Q.verify_labels(frames, lines, "doc_id")
    return out.select("doc_id", F.concat_ws("; ", "reasons").alias("reasons"), "quarantined")


@query("valid_outline", """
WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w<>'')) AS n FROM documents)
SELECT doc_id, n>=6 AS summary, n>=7 AS geometry, n>=3 AS training FROM n""")
def _(t):
    tokens = F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "")
    return t.documents.select("doc_id", *[Q.valid_outline(tokens, u).alias(u) for u in ("summary", "geometry", "training")])


PLAUSIBLE = "CASE WHEN l_quantity*20<100 THEN 'no_ring' WHEN l_tax*250>18 THEN 'bad_fit' WHEN NOT (l_extendedprice/300-12 BETWEEN -10 AND 250) THEN 'implausible' ELSE 'kept' END"


@query("plausible", f"SELECT {PLAUSIBLE} AS reason, count(*) AS rows FROM lineitem GROUP BY 1")
def _(t):
    return Q.rejections(t.lineitem, Q.plausible(c("l_extendedprice") / 300 - 12, c("l_quantity") * 20, c("l_tax") * 250, min_ring=100, max_rms=18.0))


@query("min_area", f"WITH {px_sql('A', 'a')}, s AS (SELECT frame, outline, count(*) AS area FROM a GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY frame ORDER BY area DESC, outline) AS INT) AS rank FROM s WHERE area>=20")
def _(t):
    return Q.min_area(pixels(t, "A"), ["frame"], "outline", 20)


@query("all_or_nothing", "SELECT l_orderkey, bool_and(CASE WHEN l_discount>0.09 THEN 'rectangle' ELSE '' END = '') AS usable, count(*) AS boxes FROM lineitem GROUP BY 1")
def _(t):
    return Q.usable_frames(t.lineitem.select("l_orderkey", F.when(c("l_discount") > 0.09, "rectangle").otherwise("").alias("reason")), "l_orderkey", "reason")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("feature_ranges", " UNION ALL ".join(f"SELECT '{f}' AS feature, round(quantile_cont({f},0.01),6) AS lo, round(quantile_cont({f},0.99),6) AS hi FROM lineitem" for f in FEATURES))
def _(t):
    return Q.feature_ranges(t.lineitem, FEATURES).select("feature", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("out_of_range", f"""
WITH r AS (SELECT {', '.join(f"quantile_cont({f},0.1) AS {f}_lo, quantile_cont({f},0.9) AS {f}_hi" for f in FEATURES)} FROM lineitem WHERE l_returnflag='A'),
e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(f"greatest({f}_lo-{f}, {f}-{f}_hi)/({f}_hi-{f}_lo) AS {f}" for f in FEATURES)} FROM lineitem, r),
f AS (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {f}>0 THEN '{f}' END" for f in FEATURES)}) AS outside, {'+'.join(f"({f}>0)::INT" for f in FEATURES)} AS n, {' OR '.join(f"{f}>0.10" for f in FEATURES)} AS far FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, outside, far, NOT far AND n<2 AS in_distribution FROM f""")
def _(t):
    ranges = Q.one_row(Q.feature_ranges(t.lineitem.where("l_returnflag = 'A'"), FEATURES, 0.1, 0.9), FEATURES)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return Q.out_of_range(t.lineitem, key, FEATURES, ranges).withColumn("outside", F.concat_ws(",", "outside"))


@query("trim_percentile", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice,0.05) AS lo, quantile_cont(l_extendedprice,0.95) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS kept, round(min(l_extendedprice),2) AS lowest, round(max(l_extendedprice),2) AS highest FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1""")
def _(t):
    kept = Q.trim_percentile(t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("kept"), F.round(F.min("l_extendedprice"), 2).alias("lowest"), F.round(F.max("l_extendedprice"), 2).alias("highest"))


@query("sigma_trim", """
WITH a AS (SELECT l_returnflag AS g, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1),
b AS (SELECT g, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem JOIN a ON g=l_returnflag WHERE l_extendedprice BETWEEN m-1.5*s AND m+1.5*s GROUP BY 1),
k AS (SELECT l_returnflag, l_extendedprice FROM lineitem JOIN b ON g=l_returnflag WHERE l_extendedprice BETWEEN m-1.5*s AND m+1.5*s)
SELECT l_returnflag, count(*) AS kept, round(avg(l_extendedprice),4) AS mean FROM k GROUP BY 1""")
def _(t):
    kept = Q.sigma_trim(t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 1.5, 2)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("road_surround", """
WITH p AS (SELECT l_suppkey AS frame, l_linenumber AS outline, CAST(l_quantity AS INT) AS y, CAST(l_partkey%180 AS INT) AS h, CAST(l_discount*1000 AS INT) AS s, CAST(l_orderkey%256 AS INT) AS v FROM lineitem),
m AS (SELECT *, NOT ((h>35 AND h<85 AND s>40) OR (v>200 AND s<30 AND y<25)) AS road FROM p), n AS (SELECT frame, outline, count(*) FILTER (road) AS n FROM m GROUP BY ALL)
SELECT m.frame, m.outline, count(*) AS px, CAST(sum(v) AS BIGINT) AS brightness FROM m JOIN n USING (frame, outline) WHERE road OR n<60 GROUP BY ALL""")
def _(t):
    px = t.lineitem.select(c("l_suppkey").alias("frame"), c("l_linenumber").alias("outline"), c("l_quantity").cast("int").alias("y"), (c("l_partkey") % 180).cast("int").alias("h"),
                           F.round(c("l_discount") * 1000).cast("int").alias("s"), (c("l_orderkey") % 256).cast("int").alias("v"))
    kept = Q.road_surround(px, ["frame", "outline"], F.lit(25), 60)
    return kept.groupBy("frame", "outline").agg(F.count(F.lit(1)).alias("px"), F.sum("v").alias("brightness"))


# ── annotation: conversations stand in for returned labels ──

RATINGS = "r AS (SELECT conv_id AS item_id, ['ana','ben','cy'][CAST(turn%3 AS INT)+1] AS annotator, CAST(length(text)%5+1 AS VARCHAR) AS label, turn AS labelled_at, CASE WHEN conv_id%17=0 THEN 1 ELSE 2 END AS pack_version FROM conversations)"
MANIFEST = "m AS (SELECT DISTINCT conv_id AS item_id, 'src'||(conv_id%4) AS source, ['ana;ben','ana;cy','ben;cy'][CAST(conv_id%3 AS INT)+1] AS assigned_to FROM conversations)"
VALID = f"""{RATINGS}, {MANIFEST}, s AS (SELECT r.*, CASE WHEN pack_version<>2 THEN 'wrong_version' WHEN assigned_to IS NULL OR NOT list_contains(string_split(assigned_to,';'), annotator) THEN 'unassigned' ELSE 'valid' END AS st FROM r LEFT JOIN m USING (item_id)),
l AS (SELECT item_id, annotator, max(labelled_at) AS last, count(DISTINCT label) AS answers FROM s WHERE st='valid' GROUP BY ALL),
v AS (SELECT s.item_id, s.annotator, label, labelled_at, CASE WHEN st='valid' AND labelled_at<last THEN 'superseded' ELSE st END AS state, coalesce(answers>1,false) AS conflicting FROM s LEFT JOIN l USING (item_id, annotator)),
ok AS (SELECT * FROM v WHERE state='valid')"""


def ratings(t):
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    r = t.conversations.select(c("conv_id").alias("item_id"), pick(["ana", "ben", "cy"], c("turn") % 3).alias("annotator"), (F.length("text") % 5 + 1).cast("string").alias("label"),
                               c("turn").alias("labelled_at"), F.when(c("conv_id") % 17 == 0, 1).otherwise(2).alias("pack_version"))
    m = t.conversations.select(c("conv_id").alias("item_id"), F.concat(F.lit("src"), (c("conv_id") % 4).cast("string")).alias("source"),
                               pick(["ana;ben", "ana;cy", "ben;cy"], c("conv_id") % 3).alias("assigned_to")).distinct()
    return r, m


def valid(t):
    r, m = ratings(t)
    return N.validate(r, m, 2), m


@query("label_validation", f"WITH {VALID} SELECT item_id, annotator, labelled_at, state, conflicting FROM v")
def _(t):
    return valid(t)[0].select("item_id", "annotator", "labelled_at", "state", "conflicting")


@query("annotator_progress", f"""WITH {VALID}, a AS (SELECT item_id, unnest(string_split(assigned_to,';')) AS annotator FROM m)
SELECT a.annotator, count(*) AS assigned, count(ok.item_id) AS returned FROM a LEFT JOIN ok ON ok.item_id=a.item_id AND ok.annotator=a.annotator GROUP BY 1""")
def _(t):
    v, m = valid(t)
    return N.progress(m, v.where("state = 'valid'"))


FINAL = f"""{VALID}, n AS (SELECT m.item_id, m.source, ok.annotator, ok.label FROM m LEFT JOIN ok ON ok.item_id=m.item_id),
g AS (SELECT item_id, any_value(source) AS source, count(label) AS n, count(DISTINCT label) AS d, max(label::INT) AS hi, min(label::INT) AS lo, sum(label::INT) AS s FROM n GROUP BY item_id),
fin AS (SELECT item_id, source, CASE WHEN item_id%13=0 THEN 'consensus' WHEN n<2 THEN 'pending' WHEN d=1 OR hi-lo<=1 THEN 'agreed' ELSE 'disputed' END AS status,
CASE WHEN item_id%13=0 THEN 'not_a_pothole' WHEN n<2 THEN NULL WHEN d=1 THEN hi::VARCHAR WHEN hi-lo<=1 THEN replace((s/2.0)::DOUBLE::VARCHAR, '.0', '') END AS label FROM g)"""


def final(t):
    v, m = valid(t)
    consensus = m.where("item_id % 13 = 0").select("item_id", F.lit("not_a_pothole").alias("label"))
    return N.settle(m, v.where("state = 'valid'").select("item_id", "annotator", "label"), consensus, True)


@query("settle_labels", f"WITH {FINAL} SELECT item_id, source, status, label FROM fin")
def _(t):
    return final(t)


@query("final_labels", f"WITH {FINAL} SELECT item_id, source, label FROM fin WHERE label IS NOT NULL AND label NOT IN ('unclear','not_a_pothole')")
def _(t):
    return N.final_labels(final(t))


@query("agreed_by_source", f"WITH {FINAL} SELECT source, count(*) FILTER (status='agreed') AS agreed, count(*) AS decided FROM fin WHERE status<>'pending' GROUP BY 1")
def _(t):
    return N.agreed_by_source(final(t))


@query("false_detection_share", f"WITH {FINAL} SELECT count(*) FILTER (label='not_a_pothole') AS false_detections, count(*) AS settled, round(count(*) FILTER (label='not_a_pothole')/count(*),6) AS share FROM fin WHERE label IS NOT NULL")
def _(t):
    return N.false_detection_share(final(t))


@query("pairwise_raters", f"WITH {VALID} SELECT x.item_id, x.annotator AS a, y.annotator AS b, x.label AS label_a, y.label AS label_b FROM ok x JOIN ok y ON x.item_id=y.item_id AND x.annotator<y.annotator")
def _(t):
    return J.pairwise_raters(valid(t)[0].where("state = 'valid'"), "item_id", "annotator", "label")


@query("cohen_kappa", f"""WITH {VALID}, p AS (SELECT x.annotator||'&'||y.annotator AS pair, x.label AS la, y.label AS lb FROM ok x JOIN ok y ON x.item_id=y.item_id AND x.annotator<y.annotator),
n AS (SELECT pair, count(*) AS n, count(*) FILTER (la=lb) AS same FROM p GROUP BY 1), e AS (SELECT a.pair, sum(a.n*b.n) AS ch FROM (SELECT pair, la AS l, count(*) AS n FROM p GROUP BY ALL) a JOIN (SELECT pair, lb AS l, count(*) AS n FROM p GROUP BY ALL) b USING (pair, l) GROUP BY 1)
SELECT n.pair, n AS items, round(same/n,6) AS agree, round((same/n-coalesce(ch,0)/(n*n))/(1-coalesce(ch,0)/(n*n)),6) AS kappa FROM n LEFT JOIN e USING (pair)""")
def _(t):
    p = J.pairwise_raters(valid(t)[0].where("state = 'valid'"), "item_id", "annotator", "label").withColumn("pair", F.concat("a", F.lit("&"), "b"))
    return N.kappa(p, ["pair"]).select("pair", "items", F.round("agree", 6).alias("agree"), F.round("kappa", 6).alias("kappa"))


@query("weighted_kappa", """
WITH l AS (SELECT quality AS a, toxic AS b FROM labels), m AS (SELECT count(*) AS n FROM l),
x AS (SELECT a, count(*) AS c FROM l GROUP BY 1), y AS (SELECT b, count(*) AS c FROM l GROUP BY 1)
SELECT (SELECT n FROM m) AS items, round((SELECT avg((abs(a-b)<=1)::INT) FROM l),6) AS within_one, round(1-(SELECT sum((a-b)*(a-b)) FROM l)/(SELECT sum((a-b)*(a-b)*x.c*y.c)/any_value(m.n) FROM x, y, m),6) AS weighted_kappa""")
def _(t):
    k = N.weighted_kappa(t.labels.select(c("quality").alias("label_a"), c("toxic").alias("label_b")))
    return k.select("items", F.round("within_one", 6).alias("within_one"), F.round("weighted_kappa", 6).alias("weighted_kappa"))


VOTES = "v AS (SELECT conv_id, CASE length(text)%3 WHEN 0 THEN 'Shallow' WHEN 1 THEN 'Moderate' ELSE 'Deep' END AS label FROM conversations)"


def votes(t):
    k = F.length("text") % 3
    return t.conversations.select("conv_id", "turn", F.when(k == 0, "Shallow").when(k == 1, "Moderate").otherwise("Deep").alias("label"))


WINNER = f"""{VOTES}, n AS (SELECT conv_id, label, count(*) AS n, CASE label WHEN 'Deep' THEN 3 WHEN 'Moderate' THEN 2 ELSE 1 END AS r FROM v GROUP BY ALL)"""


@query("majority_vote", f"WITH {WINNER} SELECT conv_id, arg_max(label, (n, r)) AS winner, max(n) AS votes, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY 1")
def _(t):
    return N.majority_vote(votes(t), "conv_id", "label")


@query("agreement_recount", f"""WITH {VOTES} SELECT conv_id, CAST(count(*) FILTER (label = CASE WHEN conv_id%2=0 THEN 'Deep' ELSE 'Shallow' END) AS INT) AS agreeing, count(*) AS total FROM v GROUP BY 1""")
def _(t):
    from kerbline.functions.grading import agreement
    m = votes(t).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "label"))).alias("votes"), F.count(F.lit(1)).alias("total"))
    return m.select("conv_id", agreement(c("votes"), F.when(c("conv_id") % 2 == 0, "Deep").otherwise("Shallow")).alias("agreeing"), "total")
