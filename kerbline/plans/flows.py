"""Source, sink, streaming and learning queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kerbline.functions import grading as D
from kerbline.functions.hashing import order_key, unit_draw
from kerbline.operators import learning as L
from kerbline.operators import sampling as S
from kerbline.plans.registry import query
from kerbline.sources import files as I
from kerbline.storage import new_folder
from kerbline.streaming import streams as K

c = F.col
# an XML file is read by one task, so files stay small however much a task writes; tags repeat in every row, so files are compressed and not indented
ROWS_PER_FILE = 100_000
XML_OPTIONS = {"rootTag": "annotations", "rowTag": "annotation", "compression": "gzip", "indent": ""}

# ── sources and sinks: files written to the shared folder, then read back ──


@query("read_table_csv", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(t):
    path = new_folder(t.spark, "part-csv")
    I.write_table(t.part.select("p_partkey", "p_name", "p_retailprice"), path, "csv")
    return I.read_table_csv(t.spark, path, "p_partkey bigint, p_name string, p_retailprice double")


@query("write_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(t):
    path = new_folder(t.spark, "orders")
    I.write_table(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, by=["o_orderstatus"])
    return t.spark.read.parquet(path)


@query("append_report", "SELECT doc_id, source FROM documents")
def _(t):
    path = new_folder(t.spark, "report")
    d = t.documents.select("doc_id", "source")
    I.append_report(d.where("lang = 'de'"), path)
    I.append_report(d.where("lang <> 'de'"), path)
    return t.spark.read.parquet(path)


@query("read_outlines", "SELECT count(*) AS outlines, round(sum(l_discount),2) AS x_total, CAST(sum(CASE WHEN l_quantity>25 THEN 4 ELSE 3 END) AS BIGINT) AS points FROM lineitem WHERE l_quantity>5")
def _(t):
    path = new_folder(t.spark, "outlines")
    pts = F.when(c("l_quantity") > 25, F.lit(" 0.2 0.1 0.3 0.4 0.5 0.6")).when(c("l_quantity") > 5, F.lit(" 0.2 0.1 0.3 0.4")).otherwise("")
    t.lineitem.select(F.concat(F.lit("0 "), c("l_discount").cast("string"), F.lit(" 0.5"), pts)).write.text(path)
    o = I.read_outlines(t.spark, path, 7)
    return o.agg(F.count(F.lit(1)).alias("outlines"), F.round(F.sum(c("pts")[0]["x"]), 2).alias("x_total"), F.sum(F.size("pts")).alias("points"))


@query("read_voc", """SELECT l_orderkey||'-'||l_linenumber||'.jpg' AS filename, 640 AS w, 480 AS h, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS boxes, CASE WHEN l_returnflag='R' THEN 0 ELSE 1 END AS n_other,
CASE WHEN l_returnflag='R' THEN round(l_quantity+50-l_quantity,6) END AS width FROM lineitem""")
def _(t):
    path = new_folder(t.spark, "voc")
    edge = lambda v: v.cast("double")
    box = F.struct(edge(c("l_quantity")).alias("xmin"), F.lit(2.0).alias("ymin"), edge(c("l_quantity") + 50).alias("xmax"), F.lit(40.0).alias("ymax"))
    item = F.struct(F.when(c("l_returnflag") == "R", "D40").otherwise("D00").alias("name"), box.alias("bndbox"))
    t.lineitem.select(F.concat_ws("", c("l_orderkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string"), F.lit(".jpg")).alias("filename"), F.struct(F.lit(640).alias("width"), F.lit(480).alias("height")).alias("size"),
                      F.array(item).alias("object")).write.format("xml").options(maxRecordsPerFile=ROWS_PER_FILE, **XML_OPTIONS).save(path)
    v = I.read_voc(t.spark, path, "D40")
    return v.select("filename", "w", "h", F.size("boxes").alias("boxes"), "n_other", F.round(F.get("boxes", F.lit(0))[2] - F.get("boxes", F.lit(0))[0], 6).alias("width"))


@query("parse_reports", "SELECT doc_id, round(n_chars/100000.0::DOUBLE,7) AS accuracy, CASE WHEN lang='en' THEN round(n_chars/200000.0::DOUBLE,7) END AS macro_f1 FROM documents")
def _(t):
    num = lambda e: F.format_string("%.7f", e)
    macro = F.when(c("lang") == "en", F.concat(F.lit("\nmacro avg  0.1 0.2  "), num(c("n_chars") / 200000.0))).otherwise("")
    text = F.concat(F.lit("report\naccuracy   "), num(c("n_chars") / 100000.0), macro)
    return t.documents.select("doc_id", I.parse_report(text).alias("r")).select("doc_id", "r.accuracy", "r.macro_f1")


@query("metric_json", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")
def _(t):
    path = new_folder(t.spark, "metrics-json")
    t.events.select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k").write.json(path)
    return I.read_json_or_empty(t.spark, path, "event_id bigint, k bigint", False)


@query("feature_rows", "SELECT event_id, CASE WHEN event_type='view' THEN 0.0 ELSE CAST(json_extract(props,'$.k') AS DOUBLE) END AS k FROM events")
def _(t):
    cell = F.when(c("event_type") == "view", "n/a").otherwise(F.get_json_object("props", "$.k"))
    path = new_folder(t.spark, "features-csv")
    I.write_table(t.events.select("event_id", cell.alias("k")), path, "csv")
    return I.read_feature_rows(t.spark, [f"{path}-missing", path], ["k"]).select(c("event_id").cast("long").alias("event_id"), "k")


# ── streaming: the events folder as arriving files ──


def events(t):
    return K.read_stream(t.spark, t.folder, t.events.schema, "events.parquet").withColumn("at", c("ts").cast("timestamp"))


@query("stream_score", "SELECT event_id, CASE WHEN value<25 THEN 'Shallow' WHEN value<50 THEN 'Moderate' ELSE 'Deep' END AS severity FROM events")
def _(t):
    return K.drain(K.score(events(t), {"severity": D.band(c("value"))}).select("event_id", "severity"), "stream_score")


# append mode gives out a window once the watermark (an hour behind the newest event) has passed its end
@query("stream_tumbling", """
WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM events GROUP BY 1,2), m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS wm FROM events)
SELECT event_type, strftime(s, '%Y-%m-%d %H:%M') AS window_start, n FROM w, m WHERE s + INTERVAL 1 HOUR <= wm""")
def _(t):
    out = K.drain(K.counts(events(t), ["event_type"], "at", "1 hour", "1 hour"), "stream_tumbling")
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@query("stream_sliding", """
WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS s, count(*) AS n FROM events, generate_series(0,3) v(k) GROUP BY 1), m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS wm FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, n FROM w, m WHERE s + INTERVAL 1 HOUR <= wm""")
def _(t):
    out = K.drain(K.counts(events(t), [], "at", "1 hour", "1 hour", "15 minutes"), "stream_sliding")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
w AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, count(*) AS n FROM s GROUP BY user_id, k), m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS wm FROM events)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, n AS frames FROM w, m WHERE b <= wm""")
def _(t):
    out = K.drain(K.sessions(events(t), ["user_id"], "at", "6 hours", "1 hour"), "stream_sessions")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "frames")


@query("stream_dedup", "SELECT DISTINCT md5(user_id||'|'||event_type) AS content_md5 FROM events")
def _(t):
    s = K.drop_repeats(events(t), F.concat_ws("|", c("user_id").cast("string"), "event_type"), "at", "60 days")
    return K.drain(s.select("content_md5"), "stream_dedup")


@query("stream_static_enrich", "SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey=user_id")
def _(t):
    dim = t.customer.select(c("c_custkey").alias("user_id"), "c_mktsegment")
    return K.drain(K.enrich(events(t).select("event_id", "user_id"), dim, ["user_id"]).select("event_id", "user_id", "c_mktsegment"), "stream_enrich")


@query("stream_asof_drive", """
SELECT e.event_id, e.user_id, d.event_id AS drive FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type='purchase') d ON e.user_id=d.user_id AND e.ts>=d.ts
WHERE e.ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def _(t):
    starts = events(t).where("event_type = 'purchase'").select("user_id", "at", c("event_id").alias("start_id"))
    out = K.asof_drive(events(t).select("user_id", "at", "event_id"), starts, ["user_id"], "at", "event_id", "start_id", "1 hour", "drive")
    return K.drain(out, "stream_asof_drive").select("event_id", "user_id", "drive")


ARRIVALS = """a AS (SELECT event_id, ts, CASE WHEN event_id%10=0 THEN 3 ELSE least(3, CAST(floor(4*epoch_us(ts-lo)/(epoch_us(hi-lo)+1)) AS INT)) END AS arrival FROM events, (SELECT min(ts) AS lo, max(ts) AS hi FROM events)),
m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS wm FROM a WHERE arrival<2)"""


@query("stream_late_rows", f"WITH {ARRIVALS} SELECT count(*) AS arrived, count(*) FILTER (arrival<3 OR ts>wm) AS kept, count(*) FILTER (arrival=3 AND ts<=wm) AS dropped FROM a, m")
def _(t):
    """Events arrive in four parts by time, every tenth only in the last one; what the watermark drops is read from the stream's progress. Rows are held against the watermark of the part before the last."""
    lim = t.events.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"))).scalar()
    us = lambda v: F.unix_micros(v.cast("timestamp"))
    quarter = F.floor(4 * (us(c("ts")) - us(lim.getField("lo"))) / (us(lim.getField("hi")) - us(lim.getField("lo")) + 1))
    parts = t.events.select("event_id", c("ts").cast("timestamp").alias("at"), F.when(c("event_id") % 10 == 0, 3).otherwise(F.least(quarter.cast("int"), F.lit(3))).alias("arrival"))
    folder = new_folder(t.spark, "arrivals")
    for k in range(4):                                                          # files of a part are older than those of the next
        parts.where(c("arrival") == k).select("event_id", "at").repartition(4).write.mode("append").parquet(folder)
    arriving = K.read_stream(t.spark, folder, parts.select("event_id", "at").schema, per_trigger=4)
    kept, dropped = K.late_rows(arriving, ["event_id"], "at", "1 hour", "late_rows")
    return t.events.agg(F.count(F.lit(1)).alias("arrived")).select("arrived", F.lit(kept.count()).cast("long").alias("kept"), F.lit(dropped).cast("long").alias("dropped"))


# ── learning: closed forms with SQL, the rest rows only ──

FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("scaler_table", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(quantile_cont({f},0.5),6) AS median, round(avg({f}),6) AS mean, round(stddev_pop({f}),6) AS scale FROM lineitem" for f in FEATURES))
def _(t):
    s = L.scaler_table(t.lineitem, FEATURES)
    return s.select("feature", *[F.round(x, 6).alias(x) for x in ("median", "mean", "scale")])


def vectors(t):
    return t.embeddings.select("vec_id", "label", array_to_vector(c("embedding").cast("array<double>")).alias("features"))


def width(t):
    """Length of the vectors, the same in every row."""
    return t.embeddings.select(F.max(F.size("embedding"))).first()[0]


def measured(t):
    cols = ["l_quantity", "l_discount", "l_tax"]
    d = t.lineitem.select("l_orderkey", *cols, (c("l_extendedprice") / 1000).alias("gt"), (unit_draw(order_key(3, "l_orderkey")) * 3).cast("int").alias("fold"))
    return VectorAssembler(inputCols=cols, outputCol="features").transform(d)


@query("pseudo_labels")
def _(t):
    return L.pseudo_labels(vectors(t), "features")[0].groupBy("pseudo_label").agg(F.count(F.lit(1)).alias("n"))


@query("soft_vote")
def _(t):
    v = vectors(t).withColumn("test", unit_draw(order_key(4, "vec_id")) < 0.3)
    line = L.classifiers("features", "label", 10, width(t))
    fitted = {n: line[n].fit(v.where("NOT test")) for n in ("logistic", "random_forest", "naive_bayes", "mlp")}
    return L.soft_vote(v.where("test"), fitted, ["vec_id"], ["label"])


@query("compare_regressors")
def _(t):
    return L.compare_models(measured(t), "fold", 3, L.regressors("features", "gt"), "gt")


def _ridge(alpha: float) -> str:
    """Ridge per fold from the training rows themselves, standardised, by elimination."""
    k, f = len(FEATURES), FEATURES
    stats = ", ".join(f"avg({v}) AS m{i}, stddev_pop({v}) AS d{i}" for i, v in enumerate(f))
    z = ", ".join(f"({v}-m{i})/d{i} AS z{i}" for i, v in enumerate(f))
    rows = ",".join("[" + ",".join(f"sum(z{i}*z{j})" + (f"+{alpha}" if i == j else "") for j in range(k)) + f",sum(z{i}*(gt-my))]" for i in range(k))
    m = f"SELECT q, [{rows}] AS m FROM zs GROUP BY q"
    for i in range(1, k + 1):
        m = f"SELECT q, list_transform(m, lambda row, r: CASE WHEN r={i} THEN row ELSE list_transform(row, lambda a, n: a-row[{i}]/m[{i}][{i}]*m[{i}][n]) END) AS m FROM ({m})"
    w = ", ".join(f"m[{i + 1}][{k + 1}]/m[{i + 1}][{i + 1}]/d{i} AS w{i}" for i in range(k))
    return f"""me AS MATERIALIZED (SELECT l_orderkey, l_linenumber, {", ".join(f)}, l_extendedprice/1000 AS gt, l_orderkey%3 AS fold, l_suppkey%2 AS half FROM lineitem),
tr AS (SELECT q.half AS qh, q.fold AS qf, me.* FROM me JOIN (SELECT DISTINCT half, fold FROM me) q ON q.half=me.half AND q.fold<>me.fold), zq AS (SELECT (qh, qf) AS q, * FROM tr), st AS (SELECT q, count(*) AS n, avg(gt) AS my, {stats} FROM zq GROUP BY q),
zs AS (SELECT q, gt, my, {z} FROM zq JOIN st USING (q)), fit AS MATERIALIZED (SELECT q, n, my-{"-".join(f"w{i}*m{i}" for i in range(k))} AS b, {", ".join(f"w{i}" for i in range(k))} FROM (SELECT st.*, {w} FROM ({m}) JOIN st USING (q)))"""


def grouped(t):
    """Line items with a fold and a repeat: two halves of the suppliers, three folds of orders each."""
    return t.lineitem.select("l_orderkey", "l_linenumber", *FEATURES, (c("l_extendedprice") / 1000).alias("gt"), (c("l_orderkey") % 3).alias("fold"), (c("l_suppkey") % 2).alias("half"))


@query("ridge_folds", f"WITH {_ridge(1.0)} SELECT q[1] AS half, q[2] AS fold, n, round(b,6) AS intercept, round(w0,6) AS w0, round(w1,6) AS w1, round(w2,6) AS w2 FROM fit")
def _(t):
    r = L.ridge_folds(grouped(t), ["half", "fold"], FEATURES, "gt")
    return r.select("half", "fold", "n", F.round("intercept", 6).alias("intercept"), *[F.round(c("coef")[i], 6).alias(f"w{i}") for i in range(len(FEATURES))])


@query("ridge_out_of_fold", f"""WITH {_ridge(1.0)}, p AS (SELECT half, abs(least(greatest(b+w0*l_quantity+w1*l_discount+w2*l_tax,0),250)-gt) AS e FROM me JOIN fit ON fit.q=(me.half, me.fold))
SELECT half, count(*) AS n, round(avg(e),6) AS mae, round(avg((e<=10)::INT),6) AS within10, round(avg((e<=25)::INT),6) AS within25 FROM p GROUP BY 1""")
def _(t):
    p = L.ridge_out_of_fold(grouped(t), ["half", "fold"], FEATURES, "gt").withColumn("e", F.abs(F.least(F.greatest("prediction", F.lit(0.0)), F.lit(250.0)) - c("gt")))
    return p.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mae"), F.round(F.avg((c("e") <= 10).cast("int")), 6).alias("within10"), F.round(F.avg((c("e") <= 25).cast("int")), 6).alias("within25"))


@query("ordinal_grades")
def _(t):
    e = t.events.select("event_id", "value", c("user_id").cast("double").alias("u"), F.least(F.floor(c("value") / 40) + 1, F.lit(5)).cast("int").alias("y"))
    v = VectorAssembler(inputCols=["value", "u"], outputCol="features").transform(e)
    return L.expected_grade(v, "features", L.ordinal_logistic(v, "features", "y")).groupBy("y", "grade").agg(F.count(F.lit(1)).alias("n"))


@query("bradley_terry")
def _(t):
    pool = t.supplier.select("s_suppkey", (c("s_acctbal") / 10000).alias("bal"), (c("s_nationkey") / 25.0).alias("nat"))
    asked = S.random_pairs(t.supplier, "s_suppkey", "s_nationkey")
    val = t.supplier.select(c("s_suppkey").alias("k"), (c("s_acctbal") + (c("s_suppkey") % 7) * 500).alias("v"))
    j = asked.join(val.withColumnsRenamed({"k": "pool_a", "v": "va"}), "pool_a").join(val.withColumnsRenamed({"k": "pool_b", "v": "vb"}), "pool_b")
    j = j.withColumn("label", F.when(F.abs(c("va") - c("vb")) < 300, "equal").when(c("va") > c("vb"), "a").otherwise("b"))
    w = L.bradley_terry(j, pool, "s_suppkey", ["bal", "nat"])
    side = lambda k: pool.select(c("s_suppkey").alias(k), (c("bal") * w[0] + c("nat") * w[1]).alias(f"m_{k}"))
    return L.pair_agreement(j.join(side("pool_a"), "pool_a").join(side("pool_b"), "pool_b"), c("m_pool_a") - c("m_pool_b"))


@query("cue_logistic")
def _(t):
    d = t.documents.join(t.labels, "doc_id").select((c("quality") == 0).cast("int").alias("y"), (c("n_chars") / 1000).alias("edge"), c("toxic").cast("double").alias("semantic"))
    coef, intercept, weights = L.cue_logistic(d, ["edge", "semantic"], "y")
    rows = F.array(*[F.struct(F.lit(k).alias("cue"), F.lit(v).alias("coef"), F.lit(weights[k]).alias("weight"), F.lit(intercept).alias("intercept")) for k, v in coef.items()])
    return d.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(rows).alias("r")).select("rows", "r.*")


@query("cue_logistic_folds", """SELECT CAST(doc_id%5 AS INT) AS fold, count(*) AS rows, true AS scored FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def _(t):
    """Both engines can state how many rows each fold has and that each was scored between 0 and 1; the scores themselves are the model's."""
    d = t.documents.join(t.labels, "doc_id").select((c("quality") == 0).cast("int").alias("y"), (c("n_chars") / 1000).alias("edge"), c("toxic").cast("double").alias("semantic"), (c("doc_id") % 5).cast("int").alias("fold"))
    s = L.cue_logistic_f1(d, ["edge", "semantic"], "y", "fold")
    return s.select("fold", "rows", (c("f1").between(0, 1) & c("precision").between(0, 1) & c("recall").between(0, 1)).alias("scored"))


@query("learned_selector")
def _(t):
    m = measured(t).withColumns({"plain": c("l_quantity") * 0.9, "zoomed": F.when(c("l_tax") > 0.02, c("l_quantity") + c("l_discount") * 40)})
    return L.learned_selector(m, {"plain": "plain", "zoomed": "zoomed"}, "gt", "features").groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(c("served") - c("gt"))), 4).alias("mae"))


@query("feature_ablation")
def _(t):
    n = width(t)
    e = t.embeddings.select("vec_id", "label", *[c("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])
    test = unit_draw(order_key(4, "vec_id")) < 0.3
    make = lambda: L.RandomForestClassifier(numTrees=10, seed=L.SEED, labelCol="label")
    rows = L.subset_scores(e, {"first": ["e0", "e1"], "all": [f"e{i}" for i in range(n)]}, "label", test, make)
    return t.spark.createDataFrame(rows, "subset string, features int, accuracy double")


@query("learning_curve")
def _(t):
    v, key = vectors(t), order_key(4, "vec_id")
    make = lambda: L.RandomForestClassifier(numTrees=10, seed=L.SEED, labelCol="label")
    rows = L.learning_curve(v, unit_draw(order_key(5, "vec_id")), [0.5, 1.0], "label", unit_draw(key) < 0.3, make)
    return t.spark.createDataFrame(rows, "share double, accuracy double")
