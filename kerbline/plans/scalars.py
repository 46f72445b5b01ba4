"""Scalar-function queries: names, geometry, labels. Page addresses stand in for photo paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import geometry as G
from kerbline.functions import grading as D
from kerbline.functions import names as N
from kerbline.functions import numbers as M
from kerbline.plans.registry import query

# a file path made from a page address: split folder by page, augmented copies, mixed extensions
PATH_SQL = """(SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) || '/' ||
 CASE WHEN page_id%4=0 THEN 'train' WHEN page_id%4=1 THEN 'valid' WHEN page_id%4=2 THEN 'test' ELSE 'other' END
 || '/images/' || CASE WHEN page_id%3=0 THEN 'rdd_' WHEN page_id%3=1 THEN 'kaggle_' ELSE 'x_' END || replace(regexp_extract(url, '/([a-z]+)/', 1), '.', '') || page_id
 || CASE WHEN page_id%2=0 THEN '_JPG.rf.' || substr(md5(url),1,8) ELSE '' END || '.jpg' AS path FROM pages)"""


def paths(t):
    p = t.pages.select("page_id", "url")
    k = F.col("page_id")
    folder = F.when(k % 4 == 0, "train").when(k % 4 == 1, "valid").when(k % 4 == 2, "test").otherwise("other")
    prefix = F.when(k % 3 == 0, "rdd_").when(k % 3 == 1, "kaggle_").otherwise("x_")
    suffix = F.when(k % 2 == 0, F.concat(F.lit("_JPG.rf."), F.substring(F.md5("url"), 1, 8))).otherwise("")
    return p.select("page_id", F.concat(F.regexp_extract("url", r"^https?://([^/]+)", 1), F.lit("/"), folder, F.lit("/images/"), prefix,
                                        F.regexp_extract("url", "/([a-z]+)/", 1), k.cast("string"), suffix, F.lit(".jpg")).alias("path"))


@query("source_stem", f"""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]*$', ''),
'_(jpe?g|png|bmp)\\.rf\\.[0-9a-f]+$', '', 'i') AS stem FROM {PATH_SQL}""")
def _(t):
    return paths(t).select("page_id", N.source_stem(F.col("path")).alias("stem"))


@query("split_of", f"""SELECT page_id, CASE WHEN path LIKE '%/train/%' THEN 'train' WHEN path LIKE '%/valid/%' THEN 'valid'
WHEN path LIKE '%/test/%' THEN 'test' ELSE '-' END AS split FROM {PATH_SQL}""")
def _(t):
    return paths(t).select("page_id", N.split_of(F.col("path")).alias("split"))


PREFIXES = [("rdd_", "RDD2022"), ("kaggle_", "Kaggle"), ("p600_", "Pothole-600"), ("gps_", "GPS-tagged")]


@query("origin_from_prefix", f"""SELECT page_id, CASE WHEN b LIKE 'rdd\\_%' ESCAPE '\\' THEN 'RDD2022' WHEN b LIKE 'kaggle\\_%' ESCAPE '\\' THEN 'Kaggle' ELSE 'unknown' END AS origin
FROM (SELECT page_id, lower(regexp_extract(path, '[^/]+$')) AS b FROM {PATH_SQL})""")
def _(t):
    return paths(t).select("page_id", N.from_prefix(F.lower(N.base_name(F.col("path"))), PREFIXES, "unknown").alias("origin"))


@query("timestamp_key", """
SELECT event_id, nullif(regexp_extract(CASE WHEN event_type='error' THEN 'x' ELSE '' END || strftime(ts, '%Y%m%d_%H%M%S') || '_rgb.jpg', '^(\\d{8}_\\d{6})', 1), '') AS frame_key FROM events""")
def _(t):
    name = F.concat(F.when(F.col("event_type") == "error", "x").otherwise(""), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_rgb.jpg"))
    return t.events.select("event_id", N.timestamp_key(name).alias("frame_key"))


@query("parse_key_ts", "SELECT event_id, strptime(strftime(ts, '%Y%m%d_%H%M%S'), '%Y%m%d_%H%M%S') AS captured FROM events")
def _(t):
    return t.events.select("event_id", N.parse_key_ts(F.date_format("ts", "yyyyMMdd_HHmmss")).alias("captured"))


@query("dms_to_decimal", """
SELECT s_suppkey, round(CASE WHEN s_suppkey%10=0 THEN NULL ELSE (CASE WHEN s_nationkey%2=0 THEN -1 ELSE 1 END) *
(s_nationkey::DOUBLE + (s_suppkey%60)::DOUBLE/60.0 + (s_acctbal%60)/3600.0) END, 6) AS latitude FROM supplier""")
def _(t):
    s = F.col
    deg = F.when(s("s_suppkey") % 10 != 0, s("s_nationkey").cast("string")).otherwise("n/a")
    out = G.dms_to_decimal(deg, (s("s_suppkey") % 60).cast("string"), (s("s_acctbal") % 60).cast("string"),
                           F.when(s("s_nationkey") % 2 == 0, "S").otherwise("N"))
    return t.supplier.select("s_suppkey", F.round(out, 6).alias("latitude"))


BOX = "l_quantity/50 AS x, l_discount*10 AS y, l_tax*5+0.05 AS w, l_discount*5+0.05 AS h"


def boxes(t):
    c = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (c("l_quantity") / 50).alias("x"), (c("l_discount") * 10).alias("y"),
                             (c("l_tax") * 5 + 0.05).alias("w"), (c("l_discount") * 5 + 0.05).alias("h"))


@query("box_to_polygon", f"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, {BOX} FROM lineitem),
c AS (SELECT *, least(greatest(x-w/2,0.0),1.0) AS l, least(greatest(y-h/2,0.0),1.0) AS t, least(greatest(x+w/2,0.0),1.0) AS r, least(greatest(y+h/2,0.0),1.0) AS b FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, round(l,6) AS x1, round(t,6) AS y1, round(r,6) AS x3, round(b,6) AS y3, round((r-l)*(b-t),7) AS area FROM c""")
def _(t):
    b = boxes(t).withColumn("pts", G.centre_box(*[F.col(c) for c in "xywh"]))
    p = F.col("pts")
    return b.select("l_orderkey", "l_linenumber", "l_partkey", F.round(p[0]["x"], 6).alias("x1"), F.round(p[0]["y"], 6).alias("y1"),
                    F.round(p[2]["x"], 6).alias("x3"), F.round(p[2]["y"], 6).alias("y3"), F.round(G.polygon_area(p), 7).alias("area"))


@query("loosen_box", """
WITH b AS (SELECT p_partkey, p_size*10.0 AS x0, p_size*6.0 AS y0, p_size*10.0+120 AS x1, p_size*6.0+90 AS y1 FROM part)
SELECT p_partkey, round(greatest(0, x0-(x1-x0)*0.1/2),6) AS x0, round(greatest(0, y0-(y1-y0)*0.1/2),6) AS y0,
round(least(639, x1+(x1-x0)*0.1/2),6) AS x1, round(least(479, y1+(y1-y0)*0.1/2),6) AS y1 FROM b""")
def _(t):
    s = F.col("p_size")
    box = G.loosen_box(s * 10.0, s * 6.0, s * 10.0 + 120, s * 6.0 + 90, F.lit(640), F.lit(480))
    return t.part.select("p_partkey", box.alias("b")).select("p_partkey", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("polygon_area", """
WITH p AS (SELECT l_orderkey, x, y, row_number() OVER (PARTITION BY l_orderkey ORDER BY x, y) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM (SELECT DISTINCT l_orderkey, l_quantity AS x, l_discount*100 AS y FROM lineitem)),
e AS (SELECT a.l_orderkey, a.x*b.y - b.x*a.y AS c FROM p a JOIN p b ON a.l_orderkey=b.l_orderkey AND b.i = a.i%a.n+1)
SELECT l_orderkey, round(abs(sum(c))/2, 4) AS area, round(abs(sum(c))/2*0.25, 4) AS area_cm2 FROM e GROUP BY l_orderkey""")
def _(t):
    pts = (t.lineitem.select("l_orderkey", F.struct(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y")).alias("p"))
           .groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p")).alias("pts")))
    area = G.polygon_area(F.col("pts"))
    return pts.select("l_orderkey", F.round(area, 4).alias("area"), F.round(G.area_cm2(area), 4).alias("area_cm2"))


@query("labels_and_ranks", """
SELECT o_orderkey, CASE WHEN l='No pothole' THEN 'No Pothole' ELSE l END AS label, CASE l WHEN 'Shallow' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Deep' THEN 3 ELSE 0 END AS severity_rank
FROM (SELECT o_orderkey, CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Deep' WHEN '2' THEN 'Moderate' WHEN '3' THEN 'Shallow' WHEN '4' THEN 'No pothole' ELSE 'unclear' END AS l FROM orders)""")
def _(t):
    label = D.lookup(F.substring("o_orderpriority", 1, 1), {"1": "Deep", "2": "Moderate", "3": "Shallow", "4": "No pothole"}, "unclear")
    return t.orders.select("o_orderkey", D.normalise_label(label).alias("label"), D.severity_rank(label).alias("severity_rank"))


@query("json_boxes", """
SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS xmin, CAST(json_extract(props, '$.k') AS DOUBLE) + 10 AS xmax FROM events""")
def _(t):
    text = F.concat(F.lit("[["), F.get_json_object("props", "$.k"), F.lit(",0,"), (F.get_json_object("props", "$.k").cast("double") + 10).cast("string"), F.lit(",5]]"))
    return t.events.select("event_id", F.from_json(text, "array<array<double>>").alias("b")).select(
        "event_id", F.col("b")[0][0].alias("xmin"), F.col("b")[0][2].alias("xmax"))


@query("multi_value", """
SELECT doc_id, list_contains(a, 'ana') AS has_ana, unnest(a) AS annotator
FROM (SELECT doc_id, string_split(CASE WHEN doc_id%3=0 THEN 'ana;ben' WHEN doc_id%3=1 THEN 'ana;cy' ELSE 'ben;cy' END, ';') AS a FROM documents)""")
def _(t):
    k = F.col("doc_id") % 3
    assigned = F.when(k == 0, "ana;ben").when(k == 1, "ana;cy").otherwise("ben;cy")
    return t.documents.select("doc_id", N.has_item(assigned, "ana").alias("has_ana"), F.explode(F.split(assigned, ";")).alias("annotator"))


@query("feature_bundle", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props,'$.area') AS BIGINT), 0) AS pothole_area, coalesce(TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE), 0.0) AS max_depth,
coalesce(CASE WHEN event_type<>'error' THEN value END, 0.0) AS mean_depth FROM events""")
def _(t):
    b = F.struct(F.coalesce(F.get_json_object("props", "$.area").try_cast("bigint"), F.lit(0)).alias("pothole_area"),
                 F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("max_depth"),
                 F.coalesce(F.when(F.col("event_type") != "error", F.col("value")), F.lit(0.0)).alias("mean_depth"))
    return t.events.select("event_id", b.alias("b")).select("event_id", "b.*")


@query("feature_row", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS depth_mm, CASE WHEN l_discount=0 THEN NULL ELSE l_discount END AS water_coverage,
round(CASE WHEN l_quantity=1 THEN NULL ELSE ln(greatest(l_tax/10, 1e-6)) END, 6) AS log_area_frac FROM lineitem""")
def _(t):
    c = F.col
    f = D.hazard_features(c("l_extendedprice"), c("l_extendedprice") * 1.1, F.when(c("l_discount") != 0, c("l_discount")), c("l_tax"), c("l_tax"),
                          c("l_tax"), F.when(c("l_quantity") != 1, c("l_tax") / 10))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", f.alias("f")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "f.depth_mm", "f.water_coverage", F.round("f.log_area_frac", 6).alias("log_area_frac"))


@query("angular_scale", """
WITH b AS (SELECT p_partkey, 2*sqrt(p_size*100.0/pi()) AS eq_px, p_size/100.0 AS ang, CASE WHEN p_partkey%5=0 THEN NULL ELSE p_retailprice END AS cam FROM part)
SELECT p_partkey, round(eq_px,6) AS diameter_px, round(CASE WHEN ang<>0 AND cam<>0 THEN ang*cam/eq_px END, 6) AS mm_per_px FROM b""")
def _(t):
    d = G.equivalent_diameter(F.col("p_size") * 100.0)
    camera = F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice"))
    return t.part.select("p_partkey", F.round(d, 6).alias("diameter_px"), F.round(G.mm_per_px(F.col("p_size") / 100.0, camera, d), 6).alias("mm_per_px"))


@query("train_scale", """
WITH b AS (SELECT p_partkey, CAST(300+p_size*41 AS INT) AS w, CAST(240+(p_partkey%90)*20 AS INT) AS h FROM part)
SELECT p_partkey, CAST(CASE WHEN abs(640.0::DOUBLE/greatest(w,h)-1)<1e-3 THEN w ELSE greatest(1, round_even(w*(640.0::DOUBLE/greatest(w,h)),0)) END AS INT) AS train_w,
CAST(CASE WHEN abs(640.0::DOUBLE/greatest(w,h)-1)<1e-3 THEN h ELSE greatest(1, round_even(h*(640.0::DOUBLE/greatest(w,h)),0)) END AS INT) AS train_h,
CAST(greatest(14, round_even(w*(518.0::DOUBLE/greatest(w,h))/14,0)*14) AS INT) AS net_w, CAST(greatest(14, round_even(h*(518.0::DOUBLE/greatest(w,h))/14,0)*14) AS INT) AS net_h FROM b""")
def _(t):
    b = t.part.select("p_partkey", (300 + F.col("p_size") * 41).alias("w"), (240 + (F.col("p_partkey") % 90) * 20).cast("int").alias("h"))
    return b.select("p_partkey", G.train_scale(F.col("w"), F.col("h")).alias("s"), G.network_size(F.col("w"), F.col("h")).alias("n")).select(
        "p_partkey", F.col("s.w").alias("train_w"), F.col("s.h").alias("train_h"), F.col("n.w").alias("net_w"), F.col("n.h").alias("net_h"))


@query("zoom_window", """
WITH b AS (SELECT p_partkey, p_size*120.0 AS area, p_size*8.0 AS x0, p_size*5.0 AS y0, p_size*8.0+p_size*2 AS x1, p_size*5.0+p_size*1.5 AS y1 FROM part),
c AS (SELECT *, greatest(sqrt(area/0.20*518/392), (x1-x0)*1.6, (y1-y0)*1.6*518/392) AS ww FROM b), d AS (SELECT *, ww*392/518 AS wh FROM c)
SELECT p_partkey, CASE WHEN ok THEN round(least(greatest((x0+x1)/2-ww/2,0),640-ww)/640,6) END AS x0, CASE WHEN ok THEN round(least(greatest((y0+y1)/2-wh/2,0),480-wh)/480,6) END AS y0,
CASE WHEN ok THEN round((least(greatest((x0+x1)/2-ww/2,0),640-ww)+ww)/640,6) END AS x1 FROM (SELECT *, area/(640.0*480)<0.05 AND ww<640 AND wh<480 AS ok FROM d)""")
def _(t):
    s = F.col("p_size")
    z = G.zoom_window(s * 120.0, s * 8.0, s * 5.0, s * 8.0 + s * 2, s * 5.0 + s * 1.5, F.lit(640.0), F.lit(480.0))
    return t.part.select("p_partkey", z.alias("z")).select("p_partkey", *[F.round(f"z.{c}", 6).alias(c) for c in ("x0", "y0", "x1")])


CATEGORIES = [("small", "Accuracy"), ("large", "Ablation"), ("red", "Calibration"), ("blue", "Bootstrap")]


@query("graph_category", """
SELECT p_partkey, CASE WHEN n LIKE 'small%' THEN 'Accuracy' WHEN n LIKE 'large%' THEN 'Ablation' WHEN n LIKE 'red%' THEN 'Calibration' WHEN n LIKE 'blue%' THEN 'Bootstrap' ELSE 'Other' END AS category,
array_to_string(list_transform(string_split(n,' '), lambda w: upper(substr(w,1,1))||lower(substr(w,2))), ' ') AS title FROM (SELECT p_partkey, p_name AS n FROM part)""")
def _(t):
    file = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".png"))
    return t.part.select("p_partkey", N.from_prefix(F.lower(file), CATEGORIES, "Other").alias("category"), N.title_of(file).alias("title"))


@query("safe_round", """
SELECT event_id, CASE WHEN event_type='error' THEN NULL ELSE round_even(value, 1) END AS value FROM events""")
def _(t):
    text = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "NaN").otherwise("n/a")).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", M.safe_round(text, 1).alias("value"))


@query("outline_acceptance", """
SELECT p_partkey, CASE WHEN a IS NULL THEN 'failed' WHEN a/greatest(bx,1)>0.9 THEN 'rectangle' WHEN a/greatest(bx,1)<0.15 THEN 'too_small_in_box' WHEN a*(640.0/1280)*(640.0/1280)<100 THEN 'tiny' ELSE '' END AS reason
FROM (SELECT p_partkey, CASE WHEN p_partkey%7=0 THEN NULL ELSE p_size*20.0 END AS a, p_retailprice AS bx FROM part)""")
def _(t):
    area = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * 20.0)
    return t.part.select("p_partkey", D.outline_verdict(area, F.col("p_retailprice"), F.lit(1280.0)).alias("reason"))
