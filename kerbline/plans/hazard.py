"""Hazard queries: grade probabilities, wheel drops, rim curvature, the composed risk block."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import grading as D
from kerbline.operators import evaluation as E
from kerbline.operators import hazard as H
from kerbline.operators import raster as R
from kerbline.plans.evaluation import PAIR, pairs
from kerbline.plans.raster import MASK, NORM, PX, mask, pixels, rounded
from kerbline.plans.registry import query

c = F.col

# measured error quantiles of the A camera grade every other item
QA = f"qa AS (SELECT quantile_cont(pred-gt, [{','.join(str(i / 100) for i in range(101))}]) AS q FROM p WHERE camera='A')"
RATIOS = f"ra AS (SELECT quantile_cont(0.7+l_tax*6+l_discount, [{','.join(str(i / 100) for i in range(101))}]) AS g FROM lineitem WHERE l_returnflag='A')"


def cdf_sql(v, q, name):
    """Piecewise-linear distribution function in the other engine."""
    at = f"(len(list_filter({q}, lambda z: z <= {v})))"
    return f"CASE WHEN {at}=0 THEN 0.0 WHEN {at}>=101 THEN 1.0 ELSE ({at}-1+coalesce(({v}-{q}[{at}])/nullif({q}[{at}+1]-{q}[{at}],0),0))/100 END AS {name}"


def errors(t):
    e = pairs(t).where("camera = 'A'").withColumn("e", c("pred") - c("gt"))
    return H.quantile_array(E.quantile_table(e, [], "e"))


def ratios(t):
    r = t.lineitem.where("l_returnflag = 'A'").select((0.7 + c("l_tax") * 6 + c("l_discount")).alias("r"))
    return H.quantile_array(E.quantile_table(r, [], "r"))


DEPTHS = f"d AS (SELECT DISTINCT p_partkey, p_size*2.37 AS depth, 40+p_size*21.3 AS width FROM part)"
FS = f"""{PAIR}, {QA}, {RATIOS}, {DEPTHS}, f AS (SELECT d.*, {cdf_sql('depth-13', 'q', 'f0')}, {cdf_sql('depth-25', 'q', 'f1')}, {cdf_sql('depth-50', 'q', 'f2')},
{cdf_sql('width/100', 'g', 'h0')}, {cdf_sql('width/200', 'g', 'h1')}, {cdf_sql('width/450', 'g', 'h2')}, {cdf_sql('width/750', 'g', 'h3')} FROM d, qa, ra),
b AS (SELECT *, 1-f0 AS d0, f0-f1 AS d1, f1-f2 AS d2, f2 AS d3, 1-h0 AS w0, h0-h1 AS w1, h1-h2 AS w2, h2-h3 AS w3, h3 AS w4 FROM f)"""


def potholes(t):
    return t.part.select("p_partkey", (c("p_size") * 2.37).alias("depth"), (40 + c("p_size") * 21.3).alias("width"))


@query("grade_probabilities", f"WITH {FS} SELECT p_partkey, round(d0,6) AS below, round(d1,6) AS low, round(d2,6) AS medium, round(d3,6) AS high FROM b")
def _(t):
    g = H.with_depth_probabilities(potholes(t), "depth", errors(t))
    return g.select("p_partkey", *[F.round(c("depth_probs")[i], 6).alias(n) for i, n in enumerate(("below", "low", "medium", "high"))])


@query("grade_2d", f"""WITH {FS} SELECT p_partkey, round(d1*w1+d1*w2+d2*w1,6) AS low, round(d1*w3+d1*w4+d2*w2+d3*w1+d3*w2,6) AS medium, round(d2*w3+d3*w3+d2*w4+d3*w4,6) AS high, round(w4,6) AS share_wide FROM b""")
def _(t):
    g = H.with_width_probabilities(H.with_depth_probabilities(potholes(t), "depth", errors(t)), "width", ratios(t))
    g = g.withColumn("g", H.grade_2d(c("depth_probs"), c("width_probs")))
    return g.select("p_partkey", *[F.round(c("g")[i], 6).alias(n) for i, n in ((1, "low"), (2, "medium"), (3, "high"))], F.round(c("width_probs")[4], 6).alias("share_wide"))


@query("investigatory_probability", f"WITH {FS} SELECT p_partkey, round(d3*(1-w0),6) AS p_investigatory, CAST(1+round_even(4*round(d3*(1-w0),9),0) AS INT) AS consequence FROM b")
def _(t):
    g = H.with_width_probabilities(H.with_depth_probabilities(potholes(t), "depth", errors(t)), "width", ratios(t))
    g = g.withColumn("p", F.round(H.investigatory_probability(c("depth_probs"), c("width_probs")), 9))
    return g.select("p_partkey", F.round("p", 6).alias("p_investigatory"), D.provisional_consequence(c("p"), F.lit(None).cast("double")).alias("consequence"))


TYRES = ", ".join(f"('{n}',{w}::DOUBLE,{H.tyre_radius(r, w, a)}::DOUBLE)" for n, r, w, a in H.TYRES)
# relief inside the outline: depth above the frame's lowest reading, up to 120 mm
RELIEF = f"{PX}, {MASK}, {NORM}, rl AS (SELECT mk.frame, mk.y, mk.x, zn*120-10 AS r0 FROM mk JOIN nz ON nz.frame=mk.frame AND nz.y=mk.y AND nz.x=mk.x), rr AS (SELECT frame, y, x, greatest(r0,0) AS r FROM rl)"
DROPS = f"""{RELIEF}, ty(tyre, width_mm, radius_mm) AS (VALUES {TYRES}), dp AS (SELECT frame, arg_max(y, (r,-y,-x)) AS py, arg_max(x, (r,-y,-x)) AS px0, max(r) AS deepest FROM rr GROUP BY 1),
ro AS (SELECT dp.*, ty.*, axis, 15.0+frame%5 AS mm, CAST(floor(greatest(1,round_even(width_mm/(15.0+frame%5),0))/2) AS INT) AS half FROM dp, ty, (VALUES (0),(1)) v(axis)),
ln AS (SELECT ro.frame, tyre, radius_mm, axis, mm, CASE WHEN axis=0 THEN y ELSE x END AS k, CASE WHEN count(*) = any_value(least(CASE WHEN axis=0 THEN px0 ELSE py END+half, CASE WHEN axis=0 THEN 50 ELSE 10 END)-greatest(CASE WHEN axis=0 THEN px0 ELSE py END-half,0)+1) THEN min(r) ELSE 0 END AS d
 FROM ro JOIN rr ON rr.frame=ro.frame AND abs(CASE WHEN axis=0 THEN x-px0 ELSE y-py END)<=half GROUP BY ALL),
sp AS (SELECT frame, tyre, radius_mm, axis, mm, min(k)-1 AS a, max(k)+1 AS b FROM ln GROUP BY ALL), de AS (SELECT sp.*, q.q AS k, coalesce(d,0) AS d FROM sp JOIN LATERAL (SELECT unnest(generate_series(a,b)) AS q) q ON true LEFT JOIN ln ON ln.frame=sp.frame AND ln.tyre=sp.tyre AND ln.axis=sp.axis AND ln.k=q.q),
ce AS (SELECT p.frame, p.tyre, p.axis, p.k, any_value(p.radius_mm) AS rad, max(sqrt(greatest(p.radius_mm*p.radius_mm-pow((p.k-q.k)*p.mm,2),0))-q.d) AS cen FROM de p JOIN de q ON q.frame=p.frame AND q.tyre=p.tyre AND q.axis=p.axis AND abs(p.k-q.k)<=ceil(p.radius_mm/p.mm) WHERE p.k>p.a AND p.k<p.b GROUP BY 1,2,3,4),
dr AS (SELECT frame, tyre, axis, greatest(0, max(rad)-min(cen)) AS dropped FROM ce GROUP BY 1,2,3), bs AS (SELECT frame, tyre, max((dropped, axis)) AS b FROM dr GROUP BY 1,2)"""


def relief(t):
    n = R.normalise(pixels(t), ["frame"], "z").select("frame", "y", "x", (c("zn") * 120 - 10).alias("r"))
    return mask(t).select("frame", "y", "x").join(n, ["frame", "y", "x"])


def drops(t):
    scale = t.supplier.select(c("s_suppkey").alias("frame"), (15.0 + c("s_suppkey") % 5).alias("mm_per_px"))
    return H.wheel_drops(relief(t), ["frame"], scale, (51, 11))


@query("wheel_drops", f"WITH {DROPS} SELECT ro.frame, ro.tyre, round(least(deepest, radius_mm),4) AS drop_bound_mm, round(bs.b[1],4) AS drop_mm FROM ro JOIN bs ON bs.frame=ro.frame AND bs.tyre=ro.tyre WHERE axis=0")
def _(t):
    return rounded(drops(t).drop("profile_axis"), "drop_bound_mm", "drop_mm", digits=4)


@query("hazard_block", f"""WITH {DROPS.replace('WITH ', '')}, car AS (SELECT frame, b[1] AS car FROM bs WHERE tyre='car'), {FS.split(DEPTHS)[0]} d AS (SELECT frame, deepest AS depth FROM dp), f AS (SELECT d.*, {cdf_sql('depth-50', 'q', 'f2')} FROM d, qa),
k AS (SELECT f.frame, depth, f2, car, 1+round_even(4*f2,0) AS c0 FROM f JOIN car USING (frame)), s AS (SELECT *, CASE WHEN car>=40 THEN least(5,c0+1) ELSE c0 END AS cq FROM k)
SELECT frame, round(depth,1) AS depth_mm, CAST(cq AS INT) AS consequence, CAST((frame%5+1)*cq AS BIGINT) AS score, CASE WHEN (frame%5+1)*cq>=25 THEN 'D1' WHEN (frame%5+1)*cq>=20 THEN 'D2' WHEN (frame%5+1)*cq IN (15,16) THEN 'D3A' WHEN (frame%5+1)*cq>=10 THEN 'D3' ELSE 'Observation' END AS category FROM s""")
def _(t):
    deepest = relief(t).groupBy("frame").agg(F.greatest(F.max("r"), F.lit(0.0)).alias("depth"))
    graded = H.with_depth_probabilities(deepest, "depth", errors(t))
    b = H.hazard_block(graded, drops(t), ["frame"], "depth", c("frame") % 5 + 1, F.lit("local"))
    return b.select("frame", "hazard.depth_mm", "hazard.consequence", "hazard.score", c("hazard.response.category").alias("category"))


@query("tyre_band", f"WITH {PX} SELECT frame, y, x, round((SELECT min(q.z) FROM px q WHERE q.frame=p.frame AND q.y=p.y AND abs(q.x-p.x)<=2),5) AS band FROM px p")
def _(t):
    return H.tyre_band(pixels(t), ["frame", "y"], "x", "z", 2).select("frame", "y", "x", F.round("band", 5).alias("band"))


@query("wheel_centre", f"""WITH {PX}, pf AS (SELECT frame, y, x, -z/10 AS h FROM px), e AS (SELECT frame, y, min(x)-1 AS lo, max(x)+1 AS hi FROM pf GROUP BY 1,2), al AS (SELECT * FROM pf UNION ALL SELECT frame, y, lo, 0 FROM e UNION ALL SELECT frame, y, hi, 0 FROM e)
SELECT p.frame, p.y, p.x, round(max(q.h+sqrt(greatest(317.3*317.3-pow((q.x-p.x)*40.0,2),0))),4) AS centre_mm FROM pf p JOIN al q ON q.frame=p.frame AND q.y=p.y AND abs(q.x-p.x)<=8 GROUP BY 1,2,3""")
def _(t):
    px = pixels(t).withColumn("h", -c("z") / 10)
    return rounded(H.wheel_centre(px, ["frame", "y"], "x", "h", 40.0, 317.3), "centre_mm", digits=4)


# even frames have a point per quantity and a smoothing window of 5, odd ones a point per quantity and discount and a window of about 43
SPOT = "CASE WHEN l_suppkey%2=0 THEN CAST(l_quantity AS INT) ELSE CAST(l_quantity AS INT)*11+CAST(round(l_discount*100) AS INT) END"
CURV = f"""ct AS (SELECT frame, o, (200+p/3000)*cos(2*pi()*o/CASE WHEN frame%2=0 THEN 50 ELSE 561 END) AS x, (200+p/3000)*sin(2*pi()*o/CASE WHEN frame%2=0 THEN 50 ELSE 561 END) AS y FROM (SELECT l_suppkey AS frame, {SPOT} AS o, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1,2)),
n0 AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY o)-1 AS i, count(*) OVER (PARTITION BY frame) AS n, x, y FROM ct), n1 AS (SELECT *, least(CAST(round_even(n*0.08,0) AS INT), n-1, 51) AS win FROM n0 WHERE n>=15),
n AS MATERIALIZED (SELECT frame, i, n, x, y, CAST((greatest(win-(win%2=0)::INT, 5)-1)//2 AS INT) AS m FROM n1), nw AS (SELECT *, unnest(range(-m, m+1)) AS k FROM n),
s AS MATERIALIZED (SELECT a.frame, a.i, a.n, sum(3.0*(3*a.m*a.m+3*a.m-1-5*k*k)/((2*a.m-1)*(2*a.m+1)*(2*a.m+3))*b.x) AS x, sum(3.0*(3*a.m*a.m+3*a.m-1-5*k*k)/((2*a.m-1)*(2*a.m+1)*(2*a.m+3))*b.y) AS y FROM nw a JOIN n b ON b.frame=a.frame AND b.i=(a.i+k+a.n)%a.n GROUP BY 1,2,3),
d AS MATERIALIZED (SELECT a.frame, a.i, a.n, (b.x-c.x)/(b.i-c.i) AS dx, (b.y-c.y)/(b.i-c.i) AS dy FROM s a JOIN s b ON b.frame=a.frame AND b.i=least(a.i+1,a.n-1) JOIN s c ON c.frame=a.frame AND c.i=greatest(a.i-1,0)),
e AS (SELECT a.*, (b.dx-c.dx)/(b.i-c.i) AS ax, (b.dy-c.dy)/(b.i-c.i) AS ay FROM d a JOIN d b ON b.frame=a.frame AND b.i=least(a.i+1,a.n-1) JOIN d c ON c.frame=a.frame AND c.i=greatest(a.i-1,0)),
k AS MATERIALIZED (SELECT frame, i, n, (dx*ay-dy*ax)/greatest(pow(dx*dx+dy*dy,1.5),1e-10) AS s FROM e), g AS (SELECT *, lag(s) OVER (PARTITION BY frame ORDER BY i) AS ps FROM k), m AS (SELECT frame, avg(abs(s)) AS mu, stddev_pop(abs(s)) AS sd, min(abs(s)) AS lo, max(abs(s)) AS hi FROM k GROUP BY 1),
h AS (SELECT frame, -sum(q*ln(q+1e-12)) AS ent FROM (SELECT frame, count(*)/any_value(n) AS q FROM k JOIN m USING (frame) GROUP BY frame, least(floor((abs(s)-lo)/(hi-lo)*30),29)) GROUP BY 1),
l AS (SELECT a.frame, sum(sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))) AS len, (max(a.x)-min(a.x)+1)/greatest(max(a.y)-min(a.y)+1,1) AS elo FROM n a JOIN n b ON b.frame=a.frame AND b.i=(a.i+1)%a.n GROUP BY 1)"""


@query("curvature", f"""WITH {CURV} SELECT g.frame, CAST(max(n) AS INT) AS points, round(max(abs(s)),6) AS max_curvature, round(avg(abs(s)),6) AS mean_curvature, round(stddev_pop(abs(s)),6) AS std_curvature, round(quantile_cont(abs(s),0.9),6) AS p90_curvature,
round(avg((s<0)::INT),6) AS concave_fraction, count(*) FILTER (sign(s)<>sign(ps)) AS curvature_sign_changes, round(avg((abs(s)>mu+sd)::INT),6) AS high_curvature_fraction, round(any_value(ent),6) AS curvature_entropy, round(any_value(len),4) AS contour_length, round(any_value(elo),6) AS contour_elongation
FROM g JOIN m USING (frame) JOIN h USING (frame) JOIN l USING (frame) GROUP BY 1""")
def _(t):
    q = c("l_quantity").cast("int")
    spot = F.when(c("l_suppkey") % 2 == 0, q).otherwise(q * 11 + F.round(c("l_discount") * 100).cast("int"))
    ct = t.lineitem.groupBy(c("l_suppkey").alias("frame"), spot.alias("o")).agg(F.avg("l_extendedprice").alias("p"))
    r, a = 200 + c("p") / 3000, 2 * F.pi() * c("o") / F.when(c("frame") % 2 == 0, 50).otherwise(561)
    k = H.curvature(ct.select("frame", "o", (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y")), ["frame"], "o")
    return rounded(rounded(k, "max_curvature", "mean_curvature", "std_curvature", "p90_curvature", "concave_fraction", "high_curvature_fraction", "curvature_entropy", "contour_elongation"), "contour_length", digits=4)
