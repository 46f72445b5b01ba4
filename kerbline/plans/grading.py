"""Grading queries: severities, water, age, standards and risk. Line items stand in for measured outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import grading as D
from kerbline.plans.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
c = F.col


def mm(col="l_quantity"):
    """Depth in mm from a 1-50 column, 0-150."""
    return c(col) * 3


@query("rule_severity", f"""
SELECT {K}, CASE WHEN l_quantity<=2 THEN 'No pothole' WHEN l_discount>0.02 THEN (CASE WHEN l_discount<0.05 AND l_tax<0.05 THEN 'Shallow' WHEN l_discount*2>0.15 OR l_tax*2>0.15 THEN 'Deep' ELSE 'Moderate' END)
WHEN l_extendedprice/100000<0.3 AND l_quantity*20-40<500 THEN 'Shallow' WHEN l_extendedprice/100000<0.6 THEN 'Moderate' ELSE 'Deep' END AS severity FROM
(SELECT {K}, l_quantity, l_extendedprice, l_tax, l_discount FROM lineitem)""".replace("l_discount<0.05 AND l_tax<0.05", "l_discount*2<0.05 AND l_tax*2<0.05"))
def _(t):
    contrast = F.when(c("l_discount") > 0.02, c("l_discount") * 2)
    return t.lineitem.select(*KEY, D.rule_severity(c("l_quantity") * 20 - 40, contrast, c("l_tax") * 2, c("l_extendedprice") / 100000).alias("severity"))


@query("depth_bands", f"""
SELECT {K}, CASE WHEN q<25 THEN 'Shallow' WHEN q<50 THEN 'Moderate' ELSE 'Deep' END AS measured, CASE WHEN q<22.5 THEN 'Shallow' WHEN q<48 THEN 'Moderate' ELSE 'Deep' END AS served
FROM (SELECT {K}, l_quantity*1.5 AS q FROM lineitem)""")
def _(t):
    q = c("l_quantity") * 1.5
    return t.lineitem.select(*KEY, D.band(q).alias("measured"), D.band(q, 22.5, 48.0).alias("served"))


@query("served_interval", f"""
WITH s AS (SELECT {K}, CASE WHEN l_returnflag='A' THEN l_quantity*6 END AS rel, CASE WHEN l_returnflag='A' AND l_linestatus='F' AND l_linenumber>3 OR l_linenumber=7 THEN l_quantity*5 END AS zo, CASE WHEN l_returnflag<>'R' THEN l_quantity*5.5 END AS reg FROM lineitem),
m AS (SELECT *, coalesce(zo, rel) IS NOT NULL AS r, CASE WHEN coalesce(zo, rel, reg) IS NULL THEN NULL ELSE least(greatest(coalesce(zo,rel,reg),0),250) END AS mm FROM s), q AS (SELECT *, CASE WHEN r THEN 13.25 ELSE 18.5 END AS q80 FROM m WHERE mm IS NOT NULL)
SELECT {K}, round_even(mm,1) AS depth_mm, CASE WHEN mm IS NOT NULL THEN round_even(q80,1) END AS interval_mm, round_even(greatest(mm-q80,0),1) AS low_mm, round_even(mm+q80,1) AS high_mm, CASE WHEN r THEN CASE WHEN mm<22.5 THEN 'Shallow' WHEN mm<48 THEN 'Moderate' ELSE 'Deep' END
WHEN mm<19 THEN 'Shallow' WHEN mm<41 THEN 'Moderate' ELSE 'Deep' END AS severity, CASE WHEN mm<25 THEN 'Shallow' WHEN mm<50 THEN 'Moderate' ELSE 'Deep' END AS band, CASE WHEN r THEN 'relief' ELSE 'regressor' END AS source, CASE WHEN zo IS NOT NULL THEN 'close-up' WHEN r THEN 'frame' END AS read_from FROM q
UNION ALL SELECT {K}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM m WHERE mm IS NULL""")
def _(t):
    rel, reg = F.when(c("l_returnflag") == "A", c("l_quantity") * 6), F.when(c("l_returnflag") != "R", c("l_quantity") * 5.5)
    zoomed = F.when((c("l_returnflag") == "A") & (c("l_linestatus") == "F") & (c("l_linenumber") > 3) | (c("l_linenumber") == 7), c("l_quantity") * 5)
    out = D.served_depth(rel, reg, F.lit(13.25), F.lit(18.5), zoomed, (22.5, 48.0), (19.0, 41.0))
    return t.lineitem.select(*KEY, out.alias("s")).select(*KEY, "s.*")


SEV = "CASE l_returnflag WHEN 'A' THEN 'Deep' WHEN 'N' THEN 'Moderate' ELSE 'Shallow' END"


def sev(col="l_returnflag"):
    return D.lookup(c(col), {"A": "Deep", "N": "Moderate"}, "Shallow")


@query("semantic_override", f"""
WITH s AS (SELECT {K}, {SEV} AS cons, CASE WHEN l_linestatus='F' THEN 'Deep' ELSE 'Moderate' END AS rule, CASE WHEN l_discount=0 THEN NULL ELSE 0.5+l_discount*12 END AS ratio, CAST(l_quantity AS INT) AS n FROM lineitem)
SELECT {K}, CASE WHEN ratio IS NULL OR n<8 THEN cons WHEN ratio<0.9 AND (cons='Deep' OR rule='Deep') THEN 'Shallow' WHEN ratio>1.35 AND cons='Shallow' THEN 'Moderate' ELSE cons END AS severity,
CASE WHEN ratio IS NULL THEN 'unavailable' WHEN n<8 THEN 'abstained_sparse_patches' WHEN ratio<0.9 THEN (CASE WHEN cons='Deep' OR rule='Deep' THEN 'downgraded_texture_illusion' ELSE 'smooth_interior_no_action' END)
WHEN ratio>1.35 THEN (CASE WHEN cons='Shallow' THEN 'raised_heterogeneous_interior' ELSE 'heterogeneous_interior_confirms' END) ELSE 'inconclusive' END AS verdict,
coalesce(ratio IS NOT NULL AND n>=8 AND ratio<0.9 AND (cons='Deep' OR rule='Deep'), false) AS warning FROM s""")
def _(t):
    rule = F.when(c("l_linestatus") == "F", "Deep").otherwise("Moderate")
    ratio = F.when(c("l_discount") != 0, 0.5 + c("l_discount") * 12)
    out = D.semantic_override(sev(), rule, ratio, c("l_quantity").cast("int"))
    return t.lineitem.select(*KEY, out.alias("o")).select(*KEY, "o.severity", "o.verdict", "o.warning")


@query("failure_modes", f"""
WITH s AS (SELECT {K}, {SEV} AS b, CASE WHEN l_discount*3>0.18 THEN 1 ELSE 0 END + CASE WHEN l_tax*5>0.30 THEN 1 ELSE 0 END + CASE WHEN l_quantity>25 THEN 1 ELSE 0 END + CASE WHEN l_extendedprice/400000>0.10 THEN 1 ELSE 0 END AS sc,
 l_discount>=0.095 AS w, l_tax AS iv, 0.05 AS ov, l_discount AS ldc FROM lineitem), g AS (SELECT *, CASE WHEN sc>=3 THEN 'Deep' WHEN sc>=1 THEN 'Moderate' ELSE 'Shallow' END AS geo FROM s)
SELECT {K}, geo, CASE WHEN w THEN (CASE WHEN geo='Shallow' THEN 'Moderate' ELSE geo END) WHEN b='Deep' AND iv>0 AND iv<ov*0.9 THEN 'Shallow' WHEN b='Shallow' AND ldc<0.055 AND geo<>'Shallow' THEN geo ELSE b END AS verdict,
CASE WHEN w THEN 'WATER REFLECTION' WHEN b='Deep' AND iv>0 AND iv<ov*0.9 THEN 'TEXTURE / SHADOW ILLUSION' WHEN b='Shallow' AND ldc<0.055 AND geo<>'Shallow' THEN 'DRY / SHADOWLESS FLATTENING' ELSE 'AGREEMENT (no failure)' END AS mode FROM g""")
def _(t):
    geo = D.geometry_severity(c("l_discount") * 3, c("l_tax") * 5, c("l_quantity"), c("l_extendedprice") / 400000)
    out = D.failure_mode(sev(), geo, c("l_discount") >= 0.095, c("l_tax"), F.lit(0.05), F.round(c("l_discount") + 0.005, 3))
    return t.lineitem.select(*KEY, geo.alias("geo"), out.alias("o")).select(*KEY, "geo", "o.verdict", "o.mode")


# cue scores as expressions that both engines read
CUES = {"edge_density": "value/500", "gradient": "CAST(event_id%100 AS DOUBLE)/100", "specular": "CAST(event_id%37 AS DOUBLE)/37",
        "color": "CAST(user_id%10 AS DOUBLE)/10", "saturation": "CAST(user_id%7 AS DOUBLE)/7",
        "semantic": "CASE WHEN event_type IN ('click','view') THEN CAST(event_id%19 AS DOUBLE)/19 END",
        "residual": "CASE WHEN event_type='click' THEN CAST(event_id%11 AS DOUBLE)/11 END"}
CUE_SQL = "SELECT event_id, " + ", ".join(f"CAST({s} AS DOUBLE) AS {k}" for k, s in CUES.items()) + " FROM events"
NUM = " + ".join(f"coalesce({k}*{D.WATER_WEIGHTS[k]},0)" for k in CUES)
DEN = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {D.WATER_WEIGHTS[k]} END" for k in CUES)
LOGISTIC = {"edge_density": 1.2, "gradient": 0.8, "semantic": 2.5}


def cues(t):
    return t.events.select("event_id", *[F.expr(e).alias(k) for k, e in CUES.items()])


@query("water_ensemble", f"""
SELECT event_id, round(CASE WHEN semantic IS NOT NULL THEN 1/(1+exp(-(-2.0+1.2*edge_density+0.8*gradient+2.5*semantic))) ELSE ({NUM})/({DEN}) END, 6) AS probability,
CASE WHEN semantic IS NOT NULL THEN 'logistic' ELSE 'fallback_missing_cues' END AS combination FROM ({CUE_SQL})""")
def _(t):
    p = D.water_probability({k: c(k) for k in CUES}, LOGISTIC, -2.0)
    return cues(t).select("event_id", p.alias("p")).select("event_id", F.round("p.probability", 6).alias("probability"), "p.combination")


@query("water_corrections", f"""
WITH p AS (SELECT *, ({NUM})/({DEN}) AS p0 FROM ({CUE_SQL})), q AS (SELECT *, CASE WHEN edge_density>0.6 AND gradient>0.6 THEN p0*0.65+0.35 ELSE p0 END AS p1 FROM p),
r AS (SELECT *, CASE WHEN edge_density<0.15 THEN least(p1,0.25) WHEN edge_density<0.30 THEN least(p1,0.40) ELSE p1 END AS p2 FROM q)
SELECT event_id, round(least(greatest(CASE WHEN gradient<0.15 THEN p2*0.6 ELSE p2 END,0),1),6) AS probability FROM r""")
def _(t):
    p = D.water_probability({k: c(k) for k in CUES})["probability"]
    return cues(t).select("event_id", F.round(D.water_corrections(p, c("edge_density"), c("gradient")), 6).alias("probability"))


@query("water_decision", """
WITH s AS (SELECT event_id, value/500 AS p, CASE WHEN event_type='view' THEN (event_id%100)/100.0::DOUBLE END AS cov FROM events)
SELECT event_id, CASE WHEN cov IS NOT NULL THEN cov>0.1 ELSE p>0.35 END AS is_water, CASE WHEN cov IS NOT NULL THEN (CASE WHEN cov>0.5 THEN 'high' WHEN cov>0.3 THEN 'medium' WHEN cov>0.1 THEN 'low' ELSE 'none' END)
ELSE (CASE WHEN p>0.65 THEN 'high' WHEN p>0.45 THEN 'medium' WHEN p>0.35 THEN 'low' ELSE 'none' END) END AS confidence, CASE WHEN cov IS NULL THEN 'ensemble' ELSE 'segmenter' END AS decided_by FROM s""")
def _(t):
    cov = F.when(c("event_type") == "view", (c("event_id") % 100) / 100.0)
    return t.events.select("event_id", D.water_decision(c("value") / 500, cov).alias("w")).select("event_id", "w.is_water", "w.confidence", "w.decided_by")


@query("witness_status", """
SELECT event_id, CASE WHEN event_type='error' THEN 'unavailable' WHEN user_id%3=0 THEN 'disabled' WHEN value>100 THEN 'ran' ELSE 'abstained' END AS semantic, CASE WHEN value>50 THEN 'ran' ELSE 'abstained' END AS segmenter FROM events""")
def _(t):
    ran = lambda x: F.when(c("value") > x, c("value"))
    m = F.create_map(F.lit("semantic"), D.witness_status(c("event_type") != "error", c("user_id") % 3 != 0, ran(100)),
                     F.lit("segmenter"), D.witness_status(F.lit(True), F.lit(True), ran(50)))
    return t.events.select("event_id", m.alias("m")).select("event_id", c("m")["semantic"].alias("semantic"), c("m")["segmenter"].alias("segmenter"))


AGE = """least(greatest(0.4*(1-least(greatest((l_discount*3*3+l_tax*3*2)/2,0),1)) + 0.3*least(greatest(l_quantity/greatest(200,1)*5*0.8,0),1) + 0.2*l_tax*10 + 0.1*least(1, l_extendedprice/greatest(3072000*0.1,1)),0),1)"""


def age():
    return D.pothole_age(c("l_discount") * 3, c("l_tax") * 3, c("l_quantity") * 0.8, F.lit(200.0), c("l_tax") * 10, c("l_extendedprice"), F.lit(3072000.0))


@query("pothole_age", f"""
SELECT {K}, CASE WHEN s<0.25 THEN 'Fresh' WHEN s<0.5 THEN 'Developing' WHEN s<0.75 THEN 'Established' ELSE 'Chronic' END AS category, round_even(s,4) AS score FROM (SELECT {K}, {AGE} AS s FROM lineitem)""")
def _(t):
    return t.lineitem.select(*KEY, age().alias("a")).select(*KEY, "a.category", "a.score")


@query("severity_progression", """
WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.83 WHEN 'O' THEN 0.495 ELSE 0.165 END AS s0,
 (CASE o_orderstatus WHEN 'F' THEN 0.06 WHEN 'O' THEN 0.03 ELSE 0.01 END) * (CASE substr(o_orderpriority,1,1) WHEN '1' THEN 1.5 WHEN '2' THEN 1.3 WHEN '3' THEN 1.0 ELSE 0.8 END) * least(greatest(0.5+o_totalprice/600000*1.33,0.5),2.0) AS r FROM orders),
p AS (SELECT o_orderkey, d AS days, r, least(1.0, (s0+0.5)*pow(1+r, d)-0.5) AS sc FROM s, (VALUES (30),(60),(90)) v(d))
SELECT o_orderkey, days, round(r,6) AS rate, round(sc,4) AS score, CASE WHEN sc<0.33 THEN 'Shallow' WHEN sc<0.66 THEN 'Moderate' ELSE 'Deep' END AS severity, round_even(greatest(0.2,1.0-days/120.0),2) AS confidence FROM p""")
def _(t):
    s = D.lookup(c("o_orderstatus"), {"F": "Deep", "O": "Moderate"}, "Shallow")
    climate = D.lookup(F.substring("o_orderpriority", 1, 1), {"1": "freeze_thaw", "2": "tropical_rain", "3": "temperate"}, "dry_arid")
    o = t.orders.select("o_orderkey", s.alias("s"), D.daily_rate(s, c("o_totalprice") / 600000, climate).alias("r"))
    o = o.withColumn("days", F.explode(F.array(F.lit(30), F.lit(60), F.lit(90)))).withColumn("sc", D.score_after(c("s"), c("r"), c("days")))
    return o.select("o_orderkey", "days", F.round("r", 6).alias("rate"), F.round("sc", 4).alias("score"), D.score_label(c("sc")).alias("severity"),
                    D.forecast_confidence(c("days")).alias("confidence"))


@query("astm_grade", f"""
WITH s AS (SELECT {K}, l_quantity*1.5 AS d, l_extendedprice/100 AS w FROM lineitem)
SELECT {K}, CASE WHEN d<13 OR w<100 THEN NULL WHEN w>750 THEN (CASE WHEN d<=25 THEN 'M' ELSE 'H' END) WHEN d<=25 THEN (CASE WHEN w<=450 THEN 'L' ELSE 'M' END)
WHEN d<=50 THEN (CASE WHEN w<=200 THEN 'L' WHEN w<=450 THEN 'M' ELSE 'H' END) ELSE (CASE WHEN w<=450 THEN 'M' ELSE 'H' END) END AS grade,
CASE WHEN d<13 OR w<100 THEN 'below table' WHEN w>750 THEN 'X1.17.1.2' ELSE 'Table X1.1' END AS rule, CASE WHEN d>=13 AND w>750 THEN round_even(pi()*pow(w/2,2)/500000,1) END AS equivalent_count FROM s""")
def _(t):
    return t.lineitem.select(*KEY, D.astm_grade(c("l_quantity") * 1.5, c("l_extendedprice") / 100).alias("g")).select(*KEY, "g.grade", "g.rule", "g.equivalent_count")


@query("min_cost_decision", f"""
WITH p AS (SELECT {K}, l_discount*4 AS p0, l_tax*5 AS p1, (1-l_discount*4-l_tax*5)*0.6 AS p2, (1-l_discount*4-l_tax*5)*0.4 AS p3 FROM lineitem),
x AS (SELECT {K}, round(p1+2*p2+3*p3,9)*1 AS a, p0,p1,p2,p3 FROM p),
k AS (SELECT {K}, round(3*p1+6*p2+9*p3,9) AS c0, round(p0+3*p2+6*p3,9) AS c1, round(2*p0+p1+3*p3,9) AS c2, round(3*p0+2*p1+p2,9) AS c3 FROM x)
SELECT {K}, CASE least(c0,c1,c2,c3) WHEN c0 THEN 0 WHEN c1 THEN 1 WHEN c2 THEN 2 ELSE 3 END AS grade FROM k""")
def _(t):
    p0, p1 = c("l_discount") * 4, c("l_tax") * 5
    rest = 1 - c("l_discount") * 4 - c("l_tax") * 5
    return t.lineitem.select(*KEY, D.min_cost_grade(F.array(p0, p1, rest * 0.6, rest * 0.4)).alias("grade"))


@query("risk_response", """
WITH s AS (SELECT o_orderkey, (o_orderkey%5+1)*CAST(substr(o_orderpriority,1,1) AS INT) AS score, CASE WHEN o_orderstatus='F' THEN 'county' ELSE 'local' END AS route FROM orders)
SELECT o_orderkey, score, CASE WHEN score>=25 THEN 'D1' WHEN score>=20 THEN 'D2' WHEN score IN (15,16) THEN 'D3A' WHEN score>=10 THEN 'D3' ELSE 'Observation' END AS category,
CASE WHEN score>=25 THEN '2 hours' WHEN score>=20 THEN (CASE WHEN route='county' THEN '2 working days' ELSE '5 working days' END) WHEN score>=10 THEN '90 working days' ELSE 'next routine inspection' END AS response FROM s""")
def _(t):
    score = (c("o_orderkey") % 5 + 1) * F.substring("o_orderpriority", 1, 1).cast("int")
    route = F.when(c("o_orderstatus") == "F", "county").otherwise("local")
    return t.orders.select("o_orderkey", score.alias("score"), D.response_for(score, route).alias("r")).select("o_orderkey", "score", "r.category", "r.response")


@query("provisional_consequence", f"""
SELECT {K}, CAST(CASE WHEN l_quantity>=40 THEN least(5, 1+round_even(4*least(greatest(l_discount*12,0),1),0)+1) ELSE 1+round_even(4*least(greatest(l_discount*12,0),1),0) END AS INT) AS consequence FROM lineitem""")
def _(t):
    return t.lineitem.select(*KEY, D.provisional_consequence(c("l_discount") * 12, c("l_quantity")).alias("consequence"))


MODEL = {"depth_mm": (25.0, 25.5, 14.4, 0.8), "edge": (0.05, 0.05, 0.03, -0.4), "crack": (0.04, 0.04, 0.025, 0.3)}


@query("linear_model_score", f"""
SELECT {K}, round(1/(1+exp(-((l_quantity-25.5)/14.4*0.8 + (coalesce(CASE WHEN l_discount<>0 THEN l_discount END,0.05)-0.05)/0.03*-0.4 + (l_tax-0.04)/0.025*0.3))),6) AS p FROM lineitem""")
def _(t):
    z = D.linear_score({"depth_mm": c("l_quantity"), "edge": F.when(c("l_discount") != 0, c("l_discount")), "crack": c("l_tax")}, MODEL)
    return t.lineitem.select(*KEY, F.round(1.0 / (1.0 + F.exp(-z)), 6).alias("p"))


@query("mask_refinement_gate", f"""
WITH s AS (SELECT {K}, l_quantity*40 AS a, l_quantity*40*(0.2+l_discount*30) AS r, l_quantity*40*least(0.2+l_discount*30,1)*0.9 AS b FROM lineitem)
SELECT {K}, CASE WHEN r>=100 AND a>0 AND r/a BETWEEN 0.4 AND 2.5 AND b/(a+r-b)>=0.5 THEN 'refined' ELSE 'coarse' END AS outline FROM s""")
def _(t):
    a = c("l_quantity") * 40
    r, b = a * (0.2 + c("l_discount") * 30), a * F.least(0.2 + c("l_discount") * 30, F.lit(1)) * 0.9
    return t.lineitem.select(*KEY, D.refinement_gate(a, r, b).alias("outline"))


@query("probe_flags", f"""
WITH s AS (SELECT {K}, {SEV} AS b, 0.5+l_discount*9 AS ratio, CAST(l_quantity AS INT) AS n FROM lineitem)
SELECT {K}, concat_ws(',', CASE WHEN ratio BETWEEN 0.8 AND 1.0 THEN 'BORDERLINE' END, CASE WHEN n<8 THEN 'SPARSE-PATCH' END, CASE WHEN b='Deep' AND ratio<0.9 THEN 'OVERRIDE-FIRES' END,
CASE WHEN b<>'Deep' AND ratio<0.9 THEN 'ONE-WAY-MISS' END) AS flags FROM s""")
def _(t):
    ratio, b = 0.5 + c("l_discount") * 9, sev()
    flags = F.array_compact(F.array(F.when(ratio.between(0.8, 1.0), "BORDERLINE"), F.when(c("l_quantity").cast("int") < D.MIN_PATCHES, "SPARSE-PATCH"),
                                    F.when((b == "Deep") & (ratio < D.DOWNGRADE_RATIO), "OVERRIDE-FIRES"),
                                    F.when((b != "Deep") & (ratio < D.DOWNGRADE_RATIO), "ONE-WAY-MISS")))
    return t.lineitem.select(*KEY, F.concat_ws(",", flags).alias("flags"))
