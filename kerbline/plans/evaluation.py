"""Evaluation queries. Line items stand in for (measured, predicted) pairs, labels for binary answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import evaluation as E
from kerbline.operators import reports as R
from kerbline.operators import windows as W
from kerbline.operators.ordered import percentiles
from kerbline.plans.registry import query

c = F.col

# measured depth 1.5-75 mm and a prediction that follows it loosely
TRUTH, PRED = "l_quantity*1.5", "(l_quantity*1.2 + (l_partkey%23) - 6)"
PAIR = f"p AS (SELECT l_orderkey AS grp, l_returnflag AS camera, l_linestatus AS mask, l_linenumber AS method, l_partkey AS part, l_suppkey AS supp, {TRUTH} AS gt, {PRED} AS pred, CASE WHEN {TRUTH}<25 THEN 0 WHEN {TRUTH}<50 THEN 1 ELSE 2 END AS y FROM lineitem)"


def pairs(t):
    gt = c("l_quantity") * 1.5
    return t.lineitem.select(c("l_orderkey").alias("grp"), c("l_returnflag").alias("camera"), c("l_linestatus").alias("mask"), c("l_linenumber").alias("method"), c("l_partkey").alias("part"),
                             c("l_suppkey").alias("supp"), gt.alias("gt"), (c("l_quantity") * 1.2 + (c("l_partkey") % 23) - 6).alias("pred"), E.band_index(gt, 25.0, 50.0).alias("y"))


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


SCORES = "count(*) AS n, round(avg(abs(pred-gt)),6) AS mae, round(avg(pred-gt),6) AS bias, round(sqrt(avg((pred-gt)*(pred-gt))),6) AS rmse, round(corr(pred,gt),6) AS r, round(avg((round(abs(pred-gt),9)<=10)::INT),6) AS within10, round(avg((round(abs(pred-gt),9)<=25)::INT),6) AS within25"


@query("regression_scores", f"WITH {PAIR} SELECT camera, {SCORES} FROM p GROUP BY 1")
def _(t):
    s = E.regression_scores(pairs(t), "gt", "pred", ["camera"])
    return rounded(s, "mae", "bias", "rmse", "r", "within10", "within25")


BIN = "SELECT count(*) FILTER (q AND x) AS tp, count(*) FILTER (NOT q AND x) AS fp, count(*) FILTER (q AND NOT x) AS fn, count(*) FILTER (NOT q AND NOT x) AS tn"


@query("classification_scores", f"""
WITH b AS (SELECT quality=1 AS q, toxic=0 AS x FROM labels), k AS ({BIN} FROM b)
SELECT *, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/(tp/(tp+fp)+tp/(tp+fn)),6) AS f1, round((tp+tn)/(tp+fp+fn+tn),6) AS accuracy FROM k""")
def _(t):
    return rounded(E.classification_scores(t.labels, c("quality") == 1, c("toxic") == 0), "precision", "recall", "f1", "accuracy")


@query("macro_f1", f"""
WITH {PAIR}, b AS (SELECT camera, y, CASE WHEN pred<25 THEN 0 WHEN pred<50 THEN 1 ELSE 2 END AS x FROM p),
f AS (SELECT camera, k, coalesce(2*count(*) FILTER (y=k AND x=k)/nullif(count(*) FILTER (y=k)+count(*) FILTER (x=k),0),0) AS f1 FROM b, (VALUES (0),(1),(2)) v(k) GROUP BY ALL)
SELECT camera, (SELECT round(avg((y=x)::INT),6) FROM b WHERE b.camera=f.camera) AS accuracy, round(avg(f1),6) AS macro_f1, (SELECT count(*) FROM b WHERE b.camera=f.camera) AS n FROM f GROUP BY camera""")
def _(t):
    cells = E.confusion(pairs(t).withColumn("x", E.band_index(c("pred"), 25.0, 50.0)), "y", "x", ["camera"])
    return rounded(E.macro_f1(cells, "y", "x", ["camera"]), "accuracy", "macro_f1")


@query("confusion_pivot", f"""
WITH {PAIR}, b AS (SELECT y, CASE WHEN method=1 THEN NULL WHEN pred<22.5 THEN 0 WHEN pred<48 THEN 1 ELSE 2 END AS x FROM p)
SELECT ['Shallow','Moderate','Deep'][y+1] AS measured, count(*) FILTER (x=0) AS shallow, count(*) FILTER (x=1) AS moderate, count(*) FILTER (x=2) AS deep, count(*) FILTER (x IS NULL) AS missed FROM b GROUP BY 1""")
def _(t):
    from kerbline.functions.grading import band
    return R.severity_matrix(pairs(t), band(c("gt")), band(F.when(c("method") != 1, c("pred")), 22.5, 48.0))


POLICY = "count(*) AS n, round(avg(CASE WHEN coalesce(x,0)<y THEN 3.0*(y-coalesce(x,0)) ELSE coalesce(x,0)-y END),6) AS cost, round(sum((x IS NOT DISTINCT FROM y)::INT)/count(*),6) AS correct, CAST(sum((coalesce(x,-1)<y)::INT) AS BIGINT) AS under, CAST(sum((x IS NOT DISTINCT FROM 2 AND y=2)::INT) AS BIGINT) AS deep_found, CAST(sum((y=2)::INT) AS BIGINT) AS n_deep"


@query("policy_cost", f"WITH {PAIR}, b AS (SELECT camera, y, CASE WHEN method=1 THEN NULL WHEN pred<22.5 THEN 0 WHEN pred<48 THEN 1 ELSE 2 END AS x FROM p) SELECT camera, {POLICY} FROM b GROUP BY 1")
def _(t):
    b = pairs(t).withColumn("x", E.band_index(F.when(c("method") != 1, c("pred")), 22.5, 48.0))
    return rounded(E.policy_scores(b, "y", "x", ["camera"]), "cost", "correct")


# cost of every (t1, t2) from counts per whole-number prediction, by plain cross join
CELLS = "h AS (SELECT {by} y, floor(pred*2)/2 AS f, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT i*0.5 AS t1, j*0.5 AS t2 FROM generate_series(10,89) a(i), generate_series(20,139) b(j) WHERE j>=i+10)"
COST = "sum(n*CASE WHEN (CASE WHEN f<t1 THEN 0 WHEN f<t2 THEN 1 ELSE 2 END)<y THEN 3.0*(y-(CASE WHEN f<t1 THEN 0 WHEN f<t2 THEN 1 ELSE 2 END)) ELSE (CASE WHEN f<t1 THEN 0 WHEN f<t2 THEN 1 ELSE 2 END)-y END)"


@query("choose_thresholds", f"""
WITH {PAIR}, {CELLS.format(by='camera,')}, k AS (SELECT camera, t1, t2, {COST} AS cost FROM h, g GROUP BY ALL)
SELECT camera, CAST(arg_min(t1, (cost,t1,t2)) AS DOUBLE) AS moderate_from, CAST(arg_min(t2, (cost,t1,t2)) AS DOUBLE) AS deep_from, CAST(min(cost) AS DOUBLE) AS cost FROM k GROUP BY 1""")
def _(t):
    return E.choose_thresholds(pairs(t), "y", "pred", ["camera"])


@query("two_half_crossfit", f"""
WITH {PAIR}, gg AS (SELECT grp, row_number() OVER (ORDER BY md5('20260924|'||grp)) <= floor(count(*) OVER ()/2) AS half FROM (SELECT DISTINCT grp FROM p)),
ph AS (SELECT p.*, half FROM p JOIN gg USING (grp)), {CELLS.format(by='half,').replace('FROM p ', 'FROM ph ')}, k AS (SELECT half, t1, t2, {COST} AS cost FROM h, g GROUP BY ALL),
cut AS (SELECT NOT half AS half, arg_min(t1,(cost,t1,t2)) AS t1, arg_min(t2,(cost,t1,t2)) AS t2 FROM k GROUP BY half),
b AS (SELECT y, CASE WHEN pred<t1 THEN 0 WHEN pred<t2 THEN 1 ELSE 2 END AS x FROM ph JOIN cut USING (half)) SELECT {POLICY} FROM b""")
def _(t):
    return rounded(E.policy_scores(E.two_half_crossfit(pairs(t), "y", "pred", "grp"), "y", "band"), "cost", "correct")


# scores for threshold sweeps: text length of each labelled document, brought into [0, 1)
SCORED = "s AS (SELECT doc_id, n_chars/(n_chars+2000)::DOUBLE AS score, quality=0 AS pos, toxic FROM documents JOIN labels USING (doc_id))"
GRID = [i / 400 for i in range(20, 381)]
GRID_SQL = "(SELECT score AS t FROM s UNION SELECT i/400::DOUBLE FROM generate_series(20,380) v(i))"
SWEEP = f"{SCORED}, k AS (SELECT t, count(*) FILTER (score<t AND pos) AS tp, count(*) FILTER (score<t AND NOT pos) AS fp, count(*) FILTER (score>=t AND pos) AS fn, count(*) FILTER (score>=t AND NOT pos) AS tn FROM {GRID_SQL} g, s GROUP BY t)"


def scored(t):
    return t.documents.join(t.labels, "doc_id").select("doc_id", (c("n_chars") / (c("n_chars") + 2000)).alias("score"), (c("quality") == 0).alias("pos"), "toxic")


def swept(t):
    return E.sweep(scored(t), "score", c("pos"), GRID)


@query("threshold_sweep", f"WITH {SWEEP} SELECT round(t,6) AS t, tp, fp, fn, tn, round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 1 END,6) AS precision, round(tp/(tp+fn),6) AS recall, round(fp/(fp+tn),6) AS fpr, CAST(fp*3+fn AS DOUBLE) AS cost FROM k")
def _(t):
    return rounded(E.below_threshold_rates(swept(t)).drop("pos_at", "neg_at"), "t", "precision", "recall", "fpr")


@query("trapezoid_auc", f"WITH {SWEEP}, o AS (SELECT t, fp/(fp+tn) AS x, tp/(tp+fn) AS y FROM k), l AS (SELECT x, y, lag(x) OVER (ORDER BY t) AS px, lag(y) OVER (ORDER BY t) AS py FROM o) SELECT round(sum((x-px)*(y+py)/2),6) AS auc FROM l")
def _(t):
    return rounded(E.sweep_auc(swept(t)), "auc")


@query("operating_point", f"WITH {SWEEP} SELECT round(t,6) AS t, tp, fp, round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 1 END,6) AS precision, round(tp/(tp+fn),6) AS recall, CAST(fp*3+fn AS DOUBLE) AS cost FROM k ORDER BY fp*3+fn, -tp, k.t LIMIT 1")
def _(t):
    return rounded(E.operating_point(E.below_threshold_rates(swept(t))), "t", "precision", "recall")


@query("trust_gate", f"WITH {SWEEP}, o AS (SELECT t, fp/(fp+tn) AS x, tp/(tp+fn) AS y FROM k), l AS (SELECT x, y, lag(x) OVER (ORDER BY t) AS px, lag(y) OVER (ORDER BY t) AS py FROM o), a AS (SELECT sum((x-px)*(y+py)/2) AS auc FROM l) SELECT max(tp+fn) AS positives, max(fp+tn) AS negatives, round(any_value(auc),6) AS auc, max(tp+fn)>=15 AND max(fp+tn)>=15 AND any_value(auc)>=0.6 AS trusted FROM k, a")
def _(t):
    return rounded(E.trusted(E.below_threshold_rates(swept(t)), E.sweep_auc(swept(t))), "auc")


F1_GRID = [0.05 + 0.01 * i for i in range(91)]


@query("best_f1_threshold", f"""
WITH {SCORED}, g AS (SELECT 0.05::DOUBLE+0.01::DOUBLE*i AS t FROM generate_series(0,90) v(i)), k AS (SELECT t, count(*) FILTER (score>t AND pos) AS tp, count(*) FILTER (score>t AND NOT pos) AS fp, count(*) FILTER (score<=t AND pos) AS fn, count(*) FILTER (score<=t AND NOT pos) AS tn FROM g, s GROUP BY t),
f AS (SELECT *, 2*tp/(2*tp+fp+fn) AS f1 FROM k WHERE tp>0) SELECT round(t,6) AS t, tp, fp, fn, tn, round(f1,6) AS f1 FROM f ORDER BY round(f1,12) DESC, f.t LIMIT 1""")
def _(t):
    return rounded(E.best_f1(E.sweep(scored(t), "score", c("pos"), F1_GRID), F1_GRID), "t", "f1")


@query("fixed_thresholds", f"""
WITH {SCORED} SELECT t, count(*) FILTER (score>t AND pos) AS tp, count(*) FILTER (score>t AND NOT pos) AS fp, count(*) FILTER (score<=t AND pos) AS fn, count(*) FILTER (score<=t AND NOT pos) AS tn
FROM s, (VALUES (0.1::DOUBLE),(0.3),(0.5)) v(t) GROUP BY t""")
def _(t):
    s = scored(t).withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5)])))
    return E.classification_scores(s, c("pos"), c("score") > c("t"), ["t"]).select("t", "tp", "fp", "fn", "tn")


W_SQL = " ".join(f"WHEN u<{p} THEN {k}" for k, p in enumerate(E.POISSON_1))


@query("bootstrap_ci", f"""
WITH d AS (SELECT doc_id, quality - toxic AS x FROM labels), u AS (SELECT r, x, ('0x'||substr(md5('9|'||r||'|'||doc_id),1,8))::BIGINT/4294967296.0 AS u FROM d, generate_series(1,200) v(r)),
w AS (SELECT r, x, CASE {W_SQL} ELSE 9 END AS w FROM u), m AS (SELECT r, sum(x*w)/sum(w) AS m FROM w GROUP BY r)
SELECT round(quantile_cont(m,0.025),6) AS low, round(quantile_cont(m,0.975),6) AS high, (SELECT round(avg(x),6) FROM d) AS mean FROM m""")
def _(t):
    return rounded(E.bootstrap_mean(t.labels, ["doc_id"], c("quality") - c("toxic"), 200, 9), "low", "high", "mean")


@query("switch_rule", f"""
WITH {SCORED}, k AS (SELECT count(*) FILTER (pos AND score<=0.5) AS missed_new, count(*) FILTER (NOT pos AND score>0.5) AS false_new, count(*) FILTER (pos AND toxic=0) AS missed_old, count(*) FILTER (NOT pos AND toxic=1) AS false_old FROM s)
SELECT *, missed_new<missed_old AND false_new<=2*greatest(false_old,1) AS switch FROM k""")
def _(t):
    s, n = scored(t), F.count_if
    k = s.agg(n(c("pos") & (c("score") <= 0.5)).alias("missed_new"), n(~c("pos") & (c("score") > 0.5)).alias("false_new"),
              n(c("pos") & (c("toxic") == 0)).alias("missed_old"), n(~c("pos") & (c("toxic") == 1)).alias("false_old"))
    return k.withColumn("switch", (c("missed_new") < c("missed_old")) & (c("false_new") <= 2 * F.greatest("false_old", F.lit(1))))


@query("partial_corr", "WITH r AS (SELECT corr(l_extendedprice,l_discount) AS xy, corr(l_extendedprice,l_quantity) AS xz, corr(l_discount,l_quantity) AS yz FROM lineitem) SELECT round(xy,6) AS raw, round((xy-xz*yz)/sqrt((1-xz*xz)*(1-yz*yz)),6) AS partial FROM r")
def _(t):
    return rounded(E.partial_corr(t.lineitem, "l_extendedprice", "l_discount", "l_quantity"), "raw", "partial")


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r, abs(corr({a},{b}))>0.9 AS redundant FROM lineitem" for i, a in enumerate(COLS) for b in COLS[i + 1:]))
def _(t):
    return rounded(E.corr_matrix(t.lineitem, COLS), "r")


@query("ratio_summary", f"""
WITH {PAIR}, r AS (SELECT camera, pred/gt AS r FROM p UNION ALL SELECT 'ALL', pred/gt FROM p)
SELECT camera, round(quantile_cont(r,0.5),6) AS median, round(quantile_cont(r,0.1),6) AS p10, round(quantile_cont(r,0.9),6) AS p90, count(*) AS n, round(avg((abs(r-1)<=0.25)::INT),4) AS within25, round(avg((abs(r-1)<=0.5)::INT),4) AS within50 FROM r GROUP BY 1""")
def _(t):
    return rounded(rounded(E.ratio_summary(pairs(t), "pred", "gt", ["camera"]), "median", "p10", "p90"), "within25", "within50", digits=4)


@query("leave_one_group_out", f"WITH {PAIR}, g AS (SELECT DISTINCT camera FROM p) SELECT g.camera, round(quantile_cont(pred/gt,0.5),6) AS correction FROM g JOIN p ON p.camera<>g.camera GROUP BY 1")
def _(t):
    return rounded(E.leave_one_group_out(pairs(t), "camera", "pred", "gt"), "correction")


@query("map_similarity", f"""
WITH {PAIR}, l AS (SELECT supp, min(gt) AS a0, max(gt) AS a1, min(pred) AS b0, max(pred) AS b1 FROM p GROUP BY 1), s AS (SELECT supp, (gt-a0)/(a1-a0) AS x, (pred-b0)/(b1-b0) AS y FROM p JOIN l USING (supp)),
m AS (SELECT supp, corr(x,y) AS r, avg((x-y)*(x-y)) AS mse, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x,y) AS cv FROM s GROUP BY 1)
SELECT supp, round(r,6) AS correlation, round(mse,6) AS mse, round(((2*mx*my+0.0001)*(2*cv+0.0009))/((mx*mx+my*my+0.0001)*(vx+vy+0.0009)),6) AS ssim FROM m""")
def _(t):
    return rounded(E.similarity(pairs(t), "gt", "pred", ["supp"]), "correlation", "mse", "ssim")


@query("calibration_curve", f"WITH {SCORED}, q AS (SELECT pos, score AS p FROM s) SELECT CAST(least(floor(p*10),9) AS BIGINT) AS bin, round(avg(p),6) AS predicted, round(avg(pos::INT),6) AS observed, count(*) AS n FROM q GROUP BY 1")
def _(t):
    return rounded(E.calibration_curve(scored(t), "score", c("pos")), "predicted", "observed")


@query("baseline_predictors", f"""
WITH {PAIR}, t AS (SELECT *, ln(part+1) AS x FROM p WHERE camera<>'R')
SELECT round(regr_slope(gt,x),6) AS slope, round(regr_intercept(gt,x),6) AS intercept, round(quantile_cont(gt,0.5),6) AS median, (SELECT y FROM t GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) AS majority FROM t""")
def _(t):
    p = pairs(t).withColumn("area", c("part") + 1)
    return rounded(E.baseline_predictors(p, c("camera") != "R", "gt", "area", "y"), "slope", "intercept", "median")


METHODS = {"network": "pred", "area": "part", "flat": "(gt*0+supp)"}


@query("rank_agreement", f"""WITH {PAIR}, m AS ({' UNION ALL '.join(f"SELECT '{k}' AS method, CAST({v} AS DOUBLE) AS v, gt FROM p" for k, v in METHODS.items())}),
r AS (SELECT method, v, gt, rank() OVER (PARTITION BY method ORDER BY v)+(count(*) OVER (PARTITION BY method, v)-1)/2 AS a, rank() OVER (PARTITION BY method ORDER BY gt)+(count(*) OVER (PARTITION BY method, gt)-1)/2 AS b FROM m)
SELECT method, round(corr(a,b),6) AS rho, count(*) AS n, round(avg(abs(v-gt)),4) AS mae FROM r GROUP BY 1""")
def _(t):
    s = E.stack(pairs(t), ["gt"], {"network": c("pred"), "area": c("part"), "flat": c("supp")}, "method", "v")
    mae = s.groupBy("method").agg(F.round(F.avg(F.abs(c("v") - c("gt"))), 4).alias("mae"))
    return rounded(W.spearman(s, "v", "gt", ["method"]), "rho").join(mae, "method")


@query("rank_models", f"WITH {PAIR}, s AS (SELECT method, avg(abs(pred-gt)) AS mae FROM p GROUP BY 1) SELECT method, round(mae,6) AS mae, CAST(row_number() OVER (ORDER BY mae, method) AS INT) AS place FROM s")
def _(t):
    from pyspark.sql import Window
    s = E.regression_scores(pairs(t), "gt", "pred", ["method"]).select("method", "mae")
    return s.select("method", F.round("mae", 6).alias("mae"), F.row_number().over(Window.orderBy("mae", "method")).alias("place"))


@query("counterexamples", f"""WITH {PAIR}, m AS ({' UNION ALL '.join(f"SELECT '{k}' AS method, CAST({v} AS DOUBLE) AS v, gt, grp, supp FROM p" for k, v in METHODS.items())}), q AS (SELECT method, quantile_cont(v,0.75) AS hi FROM m GROUP BY 1),
x AS (SELECT m.method, v, gt, grp, supp, row_number() OVER (PARTITION BY m.method ORDER BY gt, grp, supp, v) AS rn FROM m JOIN q USING (method) WHERE v>=hi AND gt<15)
SELECT method, gt, grp, supp, round(v,4) AS v FROM x WHERE rn=1""")
def _(t):
    s = E.stack(pairs(t), ["gt", "grp", "supp"], {"network": c("pred"), "area": c("part"), "flat": c("supp")}, "method", "v")
    high = percentiles(s, ["method"], "v", {"hi": 0.75})
    rows = s.join(high, "method").where("v >= hi AND gt < 15")
    return rows.groupBy("method").agg(F.min(F.struct("gt", "grp", "supp", "v")).alias("b")).select("method", "b.gt", "b.grp", "b.supp", F.round("b.v", 4).alias("v"))


ROB = "r AS (SELECT event_type AS condition, user_id%3 AS clf, (value>60)::INT AS a, (value>80)::INT AS b, (event_id%3=0)::INT AS o FROM events)"


@query("robustness", f"WITH {ROB} SELECT condition, clf, round(avg((a=b)::INT)*100,6) AS consistency, round(avg((a=o)::INT)*100,6) AS orig_acc, round(avg((b=o)::INT)*100,6) AS adv_acc, round(avg((a=o)::INT)*100-avg((b=o)::INT)*100,6) AS drop FROM r GROUP BY 1,2")
def _(t):
    a, b, o = (c("value") > 60), (c("value") > 80), (c("event_id") % 3 == 0)
    r = t.events.select(c("event_type").alias("condition"), (c("user_id") % 3).alias("clf"), (a == b).cast("int").alias("prediction_consistent"),
                        (a == o).cast("int").alias("original_correct"), (b == o).cast("int").alias("adverse_correct"))
    return rounded(E.robustness(r, ["condition", "clf"]), "consistency", "orig_acc", "adv_acc", "drop")


@query("semantic_ablation", f"""
WITH {SCORED}, f AS (SELECT v.cfg, pos, CASE WHEN v.need>0 AND doc_id%20<v.need THEN NULL WHEN v.cfg='calibrated' AND toxic=1 THEN NULL ELSE score<v.cut END AS fire FROM s, (VALUES ('off','-Infinity'::DOUBLE,0),('one-way',0.9,0),('calibrated',0.7,8)) v(cfg,cut,need)),
k AS (SELECT cfg AS config, count(*) FILTER (fire AND pos) AS tp, count(*) FILTER (fire AND NOT pos) AS fp, count(*) FILTER (NOT fire AND pos) AS fn, count(*) FILTER (NOT fire AND NOT pos) AS tn, count(*) FILTER (fire IS NULL) AS abstain FROM f GROUP BY 1)
SELECT *, round(tp/nullif(tp+fp,0),6) AS precision, round(tp/nullif(tp+fn,0),6) AS recall, round(2*tp/nullif(2*tp+fp+fn,0)*CASE WHEN tp+fp=0 THEN NULL ELSE 1 END,6) AS f1 FROM k""")
def _(t):
    s = scored(t).withColumns({"patches": (c("doc_id") % 20).cast("int"), "ring": F.when(c("toxic") == 0, c("score"))})
    out = E.threshold_ablation(s, c("pos"), [("off", "score", float("-inf"), 0), ("one-way", "score", 0.9, 0), ("calibrated", "ring", 0.7, 8)], "patches")
    return rounded(out, "precision", "recall", "f1")


@query("fold_summary", f"""WITH {PAIR}, f AS (SELECT camera, grp%5 AS fold, avg(abs(pred-gt)) AS mae, avg(pred-gt) AS bias FROM p GROUP BY 1,2)
SELECT camera, 'mae' AS metric, round(avg(mae),6) AS mean, round(stddev_pop(mae),6) AS sd FROM f GROUP BY 1 UNION ALL SELECT camera, 'bias', round(avg(bias),6), round(stddev_pop(bias),6) FROM f GROUP BY 1""")
def _(t):
    f = E.regression_scores(pairs(t).withColumn("fold", c("grp") % 5), "gt", "pred", ["camera", "fold"])
    return rounded(E.fold_summary(f, ["mae", "bias"], ["camera"]), "mean", "sd")


@query("quantile_table", f"WITH {PAIR} SELECT camera, CAST(i AS INT) AS p, round((SELECT quantile_cont(pred-gt, i/100.0::DOUBLE) FROM p q WHERE q.camera=k.camera),5) AS q FROM (SELECT DISTINCT camera FROM p) k, generate_series(0,100) v(i)".replace(
    "(SELECT quantile_cont(pred-gt, i/100.0::DOUBLE) FROM p q WHERE q.camera=k.camera)", "qs[CAST(i AS INT)+1]").replace("FROM (SELECT DISTINCT camera FROM p) k", f"FROM (SELECT camera, quantile_cont(pred-gt, [{','.join(str(i / 100) for i in range(101))}]) AS qs FROM p GROUP BY camera) k"))
def _(t):
    return rounded(E.quantile_table(pairs(t).withColumn("e", c("pred") - c("gt")), ["camera"], "e"), "q", digits=5)


@query("inspect_source", f"""WITH {PAIR} SELECT camera, count(*) AS n, count(*) FILTER (gt<25) AS shallow, count(*) FILTER (gt>=25 AND gt<50) AS moderate, count(*) FILTER (gt>=50) AS deep, count(*) FILTER (gt>15) AS over_limit,
round(quantile_cont(gt,0.1),6) AS p10, round(quantile_cont(gt,0.5),6) AS p50, round(quantile_cont(gt,0.9),6) AS p90, round(quantile_cont(pred,0.5),6) AS noise_median, round(quantile_cont(pred,0.9),6) AS noise_p90 FROM p GROUP BY 1""")
def _(t):
    return rounded(E.inspect_source(pairs(t), ["camera"], "gt", "pred", 15.0), "p10", "p50", "p90", "noise_median", "noise_p90")


@query("by_source_and_all", f"WITH {PAIR} SELECT coalesce(camera,'ALL') AS camera, count(*) AS n, round(avg(abs(pred-gt)),6) AS mae FROM p GROUP BY ROLLUP(camera)")
def _(t):
    r = pairs(t).rollup("camera").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(c("pred") - c("gt"))), 6).alias("mae"))
    return r.withColumn("camera", F.coalesce("camera", F.lit("ALL")))


@query("subset_report", f"""WITH {PAIR} SELECT 'all' AS subset, count(*) AS n, round(avg(abs(pred-gt)),6) AS mae FROM p UNION ALL SELECT 'not set aside', count(*), round(avg(abs(pred-gt)),6) FROM p WHERE mask='O'
UNION ALL SELECT camera, count(*), round(avg(abs(pred-gt)),6) FROM p GROUP BY camera""")
def _(t):
    p = pairs(t).withColumn("flagged", c("mask") == "F")
    return R.grouped_report(p, "camera", "flagged", [F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(c("pred") - c("gt"))), 6).alias("mae")])


@query("share_within_zoomed", f"""WITH {PAIR}, z AS (SELECT camera, gt, pred AS plain, CASE WHEN part%3=0 THEN (pred+gt)/2 END AS zoomed FROM p), s AS (SELECT *, coalesce(zoomed,plain) AS served FROM z),
x AS (SELECT 'all' AS subset, * FROM s UNION ALL SELECT CASE WHEN zoomed IS NULL THEN 'no zoom' ELSE 'zoom applies' END, * FROM s)
SELECT subset, count(*) AS n, round(avg(abs(plain-gt)),6) AS plain_mae, round(avg(plain-gt),6) AS plain_bias, round(avg((round(abs(plain-gt),9)<=10)::INT),6) AS plain_within10, round(avg((round(abs(plain-gt),9)<=25)::INT),6) AS plain_within25,
round(avg(abs(served-gt)),6) AS zoomed_mae, round(avg(served-gt),6) AS zoomed_bias, round(avg((round(abs(served-gt),9)<=10)::INT),6) AS zoomed_within10, round(avg((round(abs(served-gt),9)<=25)::INT),6) AS zoomed_within25 FROM x GROUP BY 1""")
def _(t):
    s = E.share_within(pairs(t).withColumn("zoomed", F.when(c("part") % 3 == 0, (c("pred") + c("gt")) / 2)), "gt", "pred", "zoomed")
    return rounded(s, *[n for n in s.columns if n not in ("subset", "n")])


@query("shape_agreement", f"""
WITH {PAIR}, r AS (SELECT supp, rank() OVER (PARTITION BY supp ORDER BY pred)+(count(*) OVER (PARTITION BY supp, pred)-1)/2 AS a, rank() OVER (PARTITION BY supp ORDER BY gt)+(count(*) OVER (PARTITION BY supp, gt)-1)/2 AS b FROM p),
s AS (SELECT supp, corr(a,b) AS rho FROM r GROUP BY 1) SELECT round(quantile_cont(rho,0.5),6) AS median, count(*) AS n, round(avg((rho>0.5)::INT),6) AS above_half FROM s""")
def _(t):
    s = W.spearman(pairs(t), "pred", "gt", ["supp"])
    med = percentiles(s, [], "rho", {"m": 0.5}).select("m").scalar()
    return s.agg(F.count("rho").alias("n"), F.round(E.one_hot_mean(c("rho") > 0.5), 6).alias("above_half")).withColumn("median", F.round(med, 6))


@query("bootstrap_median")
def _(t):
    s = W.spearman(pairs(t), "pred", "gt", ["supp"])
    return E.bootstrap_median(s, ["supp"], "rho", 200, 21)


@query("wheel_drop_eval", f"""WITH {PAIR} SELECT camera, method AS tyre, round(quantile_cont(gt,0.5),6) AS true_median, round(quantile_cont(gt,0.9),6) AS true_p90, round(avg(abs(pred-gt)),6) AS mae, round(avg(pred-gt),6) AS bias, round(corr(pred,gt),6) AS r,
round(avg((gt*1.1>=gt-0.5 AND pred*1.3>=gt-0.5)::INT),6) AS bound_covers FROM p GROUP BY 1,2""")
def _(t):
    p, by = pairs(t), ["camera", "method"]
    s = E.regression_scores(p, "gt", "pred", by).select(*by, "mae", "bias", "r")
    cover = p.groupBy(*by).agg(E.one_hot_mean((c("gt") * 1.1 >= c("gt") - 0.5) & (c("pred") * 1.3 >= c("gt") - 0.5)).alias("bound_covers"))
    out = percentiles(p, by, "gt", {"true_median": 0.5, "true_p90": 0.9}).join(s, by).join(cover, by).withColumnRenamed("method", "tyre")
    return rounded(out, "true_median", "true_p90", "mae", "bias", "r", "bound_covers")


# ── roll-ups ──

SEG = """s AS (SELECT l_shipdate, l_suppkey AS segment, l_orderkey AS image, l_linenumber AS pothole, CASE WHEN l_quantity<6 THEN NULL WHEN l_returnflag='A' THEN 'Deep' WHEN l_returnflag='N' THEN 'Moderate' ELSE 'Shallow' END AS severity,
l_quantity*30 AS area_px, l_discount*10 AS max_depth, l_extendedprice/100 AS volume_cm3, l_tax*12 AS age_score FROM lineitem)"""


def segment(t):
    sev = F.when(c("l_quantity") < 6, None).when(c("l_returnflag") == "A", "Deep").when(c("l_returnflag") == "N", "Moderate").otherwise("Shallow")
    return t.lineitem.select(c("l_suppkey").alias("segment"), c("l_orderkey").alias("image"), c("l_linenumber").alias("pothole"), sev.alias("severity"), (c("l_quantity") * 30).alias("area_px"),
                             (c("l_discount") * 10).alias("max_depth"), (c("l_extendedprice") / 100).alias("volume_cm3"), (c("l_tax") * 12).alias("age_score"))


RANK = "CASE severity WHEN 'Deep' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Shallow' THEN 1 ELSE 0 END"


@query("segment_summary", f"""
WITH {SEG}, g AS (SELECT segment, count(DISTINCT image) AS images, count(DISTINCT image) FILTER (severity IS NOT NULL) AS wp, count(severity) AS n, count(*) FILTER (severity='Shallow') AS shallow, count(*) FILTER (severity='Moderate') AS moderate,
count(*) FILTER (severity='Deep') AS deep, max({RANK}) AS w, sum(area_px) FILTER (severity IS NOT NULL) AS a, sum(max_depth) FILTER (severity IS NOT NULL) AS d, sum(volume_cm3) FILTER (severity IS NOT NULL) AS v,
sum({RANK}*area_px*least(greatest(0.5+age_score*1.33,0.5),2)) AS sc FROM s GROUP BY 1)
SELECT segment, images, wp AS images_with_potholes, n AS potholes, round(n/images,6) AS per_image, shallow, moderate, deep, ['None','Shallow','Moderate','Deep'][w+1] AS worst, round(a/greatest(n,1),4) AS mean_area_px, round(d/greatest(n,1),6) AS mean_max_depth,
round(v,5) AS volume_cm3, round(least(100,greatest(0,(sc/(3*a)+1e-8)*100)),4) AS priority, round(v/28316.8*50,4) AS cost_usd FROM g""")
def _(t):
    s = R.segment_summary(segment(t), ["segment"], "image")
    s = s.withColumns({k: F.col(k).cast("bigint") for k in ("images", "potholes", "shallow", "moderate", "deep")})
    return rounded(rounded(rounded(s, "per_image", "mean_max_depth"), "mean_area_px", "priority", "cost_usd", digits=4), "volume_cm3", digits=5)


@query("per_image_summary", f"WITH {SEG} SELECT image, count(*) AS potholes, arg_max(severity, {RANK}) AS worst, CAST(sum({RANK}) AS BIGINT) AS score FROM s WHERE severity IS NOT NULL GROUP BY 1")
def _(t):
    return R.per_image_summary(segment(t).where("severity IS NOT NULL"), "image", "severity")


@query("representative", f"""WITH {SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY {RANK} DESC, area_px DESC, pothole) AS rn FROM s)
SELECT image, any_value(pothole) FILTER (rn=1) AS pothole, any_value(severity) FILTER (rn=1) AS severity, any_value(area_px) FILTER (rn=1) AS area, bool_or(age_score>0.8) AS any_water, count(*) AS potholes FROM r GROUP BY 1""")
def _(t):
    return R.representative(segment(t), "image", "severity", "area_px", "pothole", c("age_score") > 0.8)


@query("outlines_per_image", "WITH n AS (SELECT o_orderkey, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1) SELECT k AS outlines, count(*) AS images FROM n GROUP BY 1")
def _(t):
    return R.outlines_per_image(t.orders.select("o_orderkey"), t.lineitem.select(c("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("mean_area_by_source", """WITH b AS (SELECT l_returnflag AS source, (l_quantity+l_discount*50)/200 AS w, (5+l_tax*100)/100 AS h FROM lineitem)
SELECT source, count(*) AS outlines, round(avg(w*h),7) AS mean_area FROM b GROUP BY 1""")
def _(t):
    w, h = (c("l_quantity") + c("l_discount") * 50) / 200, (5 + c("l_tax") * 100) / 100
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    o = t.lineitem.select(c("l_returnflag").alias("source"), F.array(pt(F.lit(0.1), F.lit(0.2)), pt(0.1 + w, F.lit(0.2)), pt(0.1 + w, 0.2 + h), pt(F.lit(0.1), 0.2 + h)).alias("pts"))
    return R.mean_area(o, "source", "pts").select("source", "outlines", F.round("mean_area", 7).alias("mean_area"))


@query("repair_rows", "SELECT l_suppkey, l_linenumber, count(*) AS area_px, round(max(l_discount),6) AS max_depth, round(avg(l_discount),6) AS mean_depth, round(sum(l_discount)*0.25*50,4) AS volume_cm3 FROM lineitem GROUP BY 1,2")
def _(t):
    return rounded(rounded(R.repair_rows(t.lineitem, ["l_suppkey", "l_linenumber"], "l_discount", 0.5), "max_depth", "mean_depth"), "volume_cm3", digits=4)


@query("insight_rollup", f"""WITH {PAIR}, m AS (SELECT method, gt, CASE WHEN part%11=0 THEN NULL ELSE pred+method*2 END AS v FROM p), b AS (SELECT *, CASE WHEN gt<25 THEN 1 WHEN gt<50 THEN 2 ELSE 3 END AS y, CASE WHEN v IS NULL THEN NULL WHEN v<22.5 THEN 1 WHEN v<48 THEN 2 ELSE 3 END AS x FROM m),
g AS (SELECT method, count(*) AS n, count(*) FILTER (v IS NULL) AS missed, avg(abs(v-gt)) AS mae, avg((x=y)::INT) AS correct, count(*) FILTER (coalesce(x,0)<y) AS under FROM b GROUP BY 1)
SELECT method, n, missed, round(mae,6) AS mae, round(correct,6) AS correct, under, CAST(row_number() OVER (ORDER BY mae, method) AS INT) AS place FROM g""")
def _(t):
    m = pairs(t).select("method", "gt", F.when(c("part") % 11 != 0, c("pred") + c("method") * 2).alias("v"))
    return rounded(R.insight_rollup(m, "method", "gt", "v", 22.5, 48.0), "mae", "correct")
