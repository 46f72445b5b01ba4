"""Raster queries. Each supplier is a frame of 50 x 11 pixels: quantity across, discount down, mean price as depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import raster as R
from kerbline.plans.registry import query

c = F.col
KEY = ["frame", "outline"]


def pixels(t):
    return t.lineitem.groupBy(c("l_suppkey").alias("frame"), F.round(c("l_discount") * 100).cast("int").alias("y"), c("l_quantity").cast("int").alias("x")).agg(
        (F.avg("l_extendedprice") / 97).alias("z"), F.avg("l_tax").alias("tax"), (F.avg(c("l_partkey").cast("double")) % 256).alias("v"))


def mask(t):
    inside = (c("x") - 25) * (c("x") - 25) / 100 + (c("y") - 5) * (c("y") - 5) / 9 < 1 + c("frame") % 3 / 4
    return pixels(t).where(inside).select("frame", F.lit(1).alias("outline"), "y", "x")


PX = "px AS (SELECT l_suppkey AS frame, CAST(round(l_discount*100) AS INT) AS y, CAST(l_quantity AS INT) AS x, avg(l_extendedprice)/97 AS z, avg(l_tax) AS tax, fmod(avg(l_partkey::DOUBLE),256) AS v FROM lineitem GROUP BY ALL)"
MASK = "mk AS (SELECT frame, 1 AS outline, y, x FROM px WHERE (x-25)*(x-25)/100 + (y-5)*(y-5)/9 < 1 + frame%3/4)"
NORM = "lim AS (SELECT frame, min(z) AS lo, max(z) AS hi FROM px GROUP BY 1), nz AS (SELECT px.*, (z-lo)/(hi-lo) AS zn FROM px JOIN lim USING (frame))"


def reg(radius, src="px", name="rg"):
    return (f"{name} AS (SELECT p.*, EXISTS (SELECT 1 FROM mk m WHERE m.frame=p.frame AND m.x=p.x AND m.y=p.y) AS inside FROM {src} p "
            f"WHERE EXISTS (SELECT 1 FROM mk m WHERE m.frame=p.frame AND abs(m.x-p.x)<={radius} AND abs(m.y-p.y)<={radius}))")


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("bounding_boxes", f"WITH {PX}, {MASK} SELECT frame, outline, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS area, greatest(1,max(x)-min(x)) AS width, greatest(1,max(y)-min(y)) AS height, greatest(1,max(x)-min(x))*greatest(1,max(y)-min(y)) AS box_area, greatest(0, greatest(1,max(x)-min(x))*greatest(1,max(y)-min(y))-count(*)) AS outside_area FROM mk GROUP BY 1,2")
def _(t):
    return R.boxes(mask(t), KEY)


@query("ring_dilation", f"WITH {PX}, {MASK}, {reg(3)} SELECT frame, 1 AS outline, y, x, inside FROM rg")
def _(t):
    return R.region(pixels(t).select("frame", "y", "x"), mask(t), ["frame"], "outline", 3).select("frame", "outline", "y", "x", "inside")


@query("depth_stats", f"""WITH {PX}, {MASK}, {NORM}, {reg(3, 'nz')}, {reg(4, 'nz', 'eg')}, i AS (SELECT * FROM rg WHERE inside), m AS (SELECT frame, avg(zn) AS mu, stddev_pop(zn) AS sd FROM i GROUP BY 1),
a AS (SELECT i.frame, count(*) AS area, avg(zn) AS mean, max(zn) AS mx, min(zn) AS mn, any_value(sd) AS sd, quantile_cont(zn,0.9) AS p90, avg(pow((zn-mu)/sd,3)) AS sk, avg(pow((zn-mu)/sd,4))-3 AS ku FROM i JOIN m USING (frame) GROUP BY 1),
r AS (SELECT frame, avg(zn) AS ring FROM rg WHERE NOT inside GROUP BY 1), e AS (SELECT frame, avg(zn) AS rim FROM eg WHERE NOT inside GROUP BY 1)
SELECT a.frame, 1 AS outline, area, round(mean,6) AS mean_depth, round(mx,6) AS max_depth, round(mn,6) AS min_depth, round(sd,6) AS depth_std, round(p90,6) AS p90_depth, round(sk,6) AS depth_skewness, round(ku,6) AS depth_kurtosis, round(mx-mn,6) AS depth_range,
round(abs(mean-ring),6) AS local_depth_contrast, round(mean-rim,6) AS boundary_gradient FROM a JOIN r USING (frame) JOIN e USING (frame)""")
def _(t):
    s = R.depth_stats(pixels(t), mask(t), ["frame"], "outline", "z", 3)
    return rounded(s, "mean_depth", "max_depth", "min_depth", "depth_std", "p90_depth", "depth_skewness", "depth_kurtosis", "depth_range", "local_depth_contrast", "boundary_gradient")


@query("weighted_mean_depth", f"""WITH {PX}, {MASK}, {NORM}, ct AS (SELECT frame, avg(x) AS cx, avg(y) AS cy, greatest(1,max(x)-min(x))/(greatest(1,max(y)-min(y))+1e-8) AS ar FROM mk GROUP BY 1),
d AS (SELECT mk.frame, zn, sqrt((mk.x-cx)*(mk.x-cx)+(mk.y-cy)*(mk.y-cy)) AS d, ar FROM mk JOIN nz ON nz.frame=mk.frame AND nz.x=mk.x AND nz.y=mk.y JOIN ct ON ct.frame=mk.frame)
SELECT frame, 1 AS outline, round(sum(zn*d)/(sum(d)+1e-8),6) AS weighted_mean_depth, round(any_value(ar),6) AS aspect_ratio FROM d GROUP BY 1""")
def _(t):
    return rounded(R.weighted_mean_depth(pixels(t), mask(t), ["frame"], "outline", "z"), "weighted_mean_depth", "aspect_ratio")


@query("global_normalise", "WITH g AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, round((value-lo)/(hi-lo+1e-8),6) AS scaled FROM events, g")
def _(t):
    return R.global_normalise(t.events.select("event_id", "value"), "value", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


FIT = "n, (xz*yy-yz*xy)/(xx*yy-xy*xy) AS a, (yz*xx-xz*xy)/(xx*yy-xy*xy) AS b"
MOM = "count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x,y) AS xy, covar_pop(x,z) AS xz, covar_pop(y,z) AS yz"


@query("plane_fit", f"WITH {PX}, m AS (SELECT frame, {MOM} FROM px GROUP BY 1), f AS (SELECT *, (xz*yy-yz*xy)/(xx*yy-xy*xy) AS a, (yz*xx-xz*xy)/(xx*yy-xy*xy) AS b FROM m) SELECT frame, n, round(a,6) AS a, round(b,6) AS b, round(mz-a*mx-b*my,5) AS c, round(sqrt(zz-a*xz-b*yz),5) AS rms FROM f")
def _(t):
    return rounded(rounded(R.plane_fit(pixels(t), ["frame"], "z"), "a", "b"), "c", "rms", digits=5)


BOWL = f"""{PX}, {MASK}, {reg(4)}, lm AS (SELECT frame, quantile_cont(z,0.05) AS lo, quantile_cont(z,0.95) AS hi, count(*) AS ring_px FROM rg WHERE NOT inside GROUP BY 1),
m AS (SELECT frame, {MOM} FROM rg JOIN lm USING (frame) WHERE NOT inside AND z BETWEEN lo AND hi GROUP BY 1), f AS (SELECT *, (xz*yy-yz*xy)/(xx*yy-xy*xy) AS a, (yz*xx-xz*xy)/(xx*yy-xy*xy) AS b FROM m),
pl AS (SELECT f.frame, a, b, mz-a*mx-b*my AS c, sqrt(zz-a*xz-b*yz) AS rms, ring_px FROM f JOIN lm USING (frame) WHERE ring_px>=60 AND n>=30), dv AS (SELECT rg.*, z-(a*x+b*y+c) AS dev, rms, ring_px FROM rg JOIN pl USING (frame))"""


@query("bowl_depth", f"WITH {BOWL} SELECT frame, 1 AS outline, count(dev) AS inside_px, any_value(ring_px) AS ring_px, round(any_value(rms),4) AS plane_rms_mm, round(avg(dev),4) AS mean_depth_mm, round(quantile_cont(dev,0.9),4) AS p90_depth_mm, round(max(dev),4) AS max_depth_mm FROM dv WHERE inside GROUP BY 1 HAVING count(dev)>=20")
def _(t):
    b = R.bowl_depth(pixels(t), mask(t), ["frame"], "outline", "z", 4, 60, 20)
    return rounded(b, "plane_rms_mm", "mean_depth_mm", "p90_depth_mm", "max_depth_mm", digits=4)


XYZ = "xyz AS (SELECT frame, y, x, (x-25)*z/500 AS X3, (y-5)*z/500 AS Y3, z AS Z3 FROM px)"
STEPS = """s AS (SELECT p.frame, p.y, p.x, r.X3-p.X3 AS rx, r.Y3-p.Y3 AS ry, r.Z3-p.Z3 AS rz, d.X3-p.X3 AS dx, d.Y3-p.Y3 AS dy, d.Z3-p.Z3 AS dz FROM xyz p LEFT JOIN xyz r ON r.frame=p.frame AND r.y=p.y AND r.x=p.x+1 LEFT JOIN xyz d ON d.frame=p.frame AND d.x=p.x AND d.y=p.y+1),
cr AS (SELECT frame, y, x, ry*dz-rz*dy AS c1, rz*dx-rx*dz AS c2, rx*dy-ry*dx AS c3 FROM s), ar AS (SELECT *, sqrt(c1*c1+c2*c2+c3*c3) AS area FROM cr)"""


def points(t):
    return pixels(t).withColumns({"PX": (c("x") - 25) * c("z") / 500, "PY": (c("y") - 5) * c("z") / 500, "PZ": c("z")})


@query("metric_features", f"""WITH {BOWL}, {XYZ}, {STEPS}, dn AS (SELECT dv.*, area, c1/nullif(area,0) AS nx, c2/nullif(area,0) AS ny, c3/nullif(area,0) AS nz FROM dv LEFT JOIN ar USING (frame, y, x)),
i AS (SELECT frame, quantile_cont(dev,[0.5,0.75,0.9,0.95,0.99]) AS q, avg(dev) AS mean, avg((dev>10)::INT) AS g10, avg((dev>25)::INT) AS g25, any_value(rms) AS rms, count(*) AS n, sum(area)/count(area)*(SELECT count(*) FROM mk WHERE mk.frame=dn.frame)/100 AS cm2, (SELECT count(*) FROM mk WHERE mk.frame=dn.frame) AS px FROM dn WHERE inside GROUP BY 1),
r AS (SELECT frame, quantile_cont(z,0.5) AS cam, avg(nx) AS a, avg(ny) AS b, avg(nz) AS e FROM dn WHERE NOT inside GROUP BY 1),
tn AS (SELECT frame, avg(t) AS t, quantile_cont(t,0.9) AS t9 FROM (SELECT frame, degrees(acos(least(greatest((nx*a+ny*b+nz*e)/sqrt(a*a+b*b+e*e),-1),1))) AS t FROM dn JOIN r USING (frame) WHERE inside AND nx IS NOT NULL) GROUP BY 1)
SELECT frame, 1 AS outline, round(q[1],4) AS mf_p50_mm, round(q[2],4) AS mf_p75_mm, round(q[3],4) AS mf_p90_mm, round(q[4],4) AS mf_p95_mm, round(q[5],4) AS mf_max_mm, round(mean,4) AS mf_mean_mm, round(g10,6) AS mf_frac_gt10, round(g25,6) AS mf_frac_gt25, round(rms,4) AS mf_plane_rms_mm, round(cam,4) AS mf_cam_dist_mm,
round(cm2,4) AS mf_area_cm2, round(ln(greatest(cm2,1e-3)),6) AS mf_log_area_cm2, round(2*sqrt(cm2*100/pi()),4) AS mf_diam_mm, round(q[3]/greatest(cam,1),6) AS mf_p90_over_dist, round(q[3]/greatest(2*sqrt(cm2*100/pi()),1),6) AS mf_p90_over_diam, round(coalesce(t,0),4) AS mf_normal_dev_mean,
round(coalesce(t9,0),4) AS mf_normal_dev_p90, round(n/px,6) AS mf_valid_frac FROM i JOIN r USING (frame) LEFT JOIN tn USING (frame) WHERE n>=20""")
def _(t):
    f = R.metric_features(points(t), mask(t), ["frame"], "outline", "z", 4, 60, 20)
    fine = ["mf_frac_gt10", "mf_frac_gt25", "mf_log_area_cm2", "mf_p90_over_dist", "mf_p90_over_diam", "mf_valid_frac"]
    return rounded(rounded(f, *fine), *[n for n in R.FEATURES if n not in fine], digits=4)


@query("submerge", f"""WITH {BOWL}, g AS (SELECT frame, quantile_cont(dev,0.9) AS d FROM dv WHERE inside GROUP BY 1), l AS (SELECT dv.frame, dev, d, fill, (1-fill)*d AS lev FROM dv JOIN g USING (frame), (VALUES (0.25::DOUBLE),(0.5),(0.75)) v(fill) WHERE inside)
SELECT frame, 1 AS outline, fill, round(max(d),4) AS depth_mm, round(max(lev),4) AS level_mm, round(quantile_cont(least(dev,lev),0.9),4) AS surface_reading_mm, round(avg((dev>lev)::INT),6) AS wet_share FROM l GROUP BY 1,3""")
def _(t):
    d = R.deviation(pixels(t), mask(t), ["frame"], "outline", "z", 4, 60)
    return rounded(rounded(R.submerge(d, KEY, [0.25, 0.5, 0.75]), "depth_mm", "level_mm", "surface_reading_mm", digits=4), "wet_share")


@query("dense_error", f"""WITH {PX}, e AS (SELECT frame, x, y, z-v AS z FROM px), m AS (SELECT frame, {MOM} FROM e GROUP BY 1), f AS (SELECT frame, mx, my, mz, (xz*yy-yz*xy)/(xx*yy-xy*xy) AS a, (yz*xx-xz*xy)/(xx*yy-xy*xy) AS b FROM m)
SELECT frame, round(quantile_cont(abs(z-(a*x+b*y+mz-a*mx-b*my)),0.5),4) AS median_error FROM e JOIN f USING (frame) GROUP BY 1""")
def _(t):
    e = pixels(t).withColumn("e", c("z") - c("v"))
    fit = R.plane_fit(e, ["frame"], "e")
    r = e.join(fit, "frame").withColumn("r", F.abs(c("e") - (c("a") * c("x") + c("b") * c("y") + c("c"))))
    return r.groupBy("frame").agg(F.round(F.percentile("r", F.lit(0.5)), 4).alias("median_error"))


@query("surface_area", f"""WITH {PX}, {MASK}, {XYZ}, {STEPS}
SELECT mk.frame, 1 AS outline, round(sum(area)*count(*)/count(area),3) AS surface, count(area) AS known_px, count(*) AS px, round(2*sqrt(sum(area)*count(*)/count(area)/pi()),4) AS diameter FROM mk LEFT JOIN ar ON ar.frame=mk.frame AND ar.x=mk.x AND ar.y=mk.y GROUP BY 1""")
def _(t):
    return rounded(rounded(R.surface_area(points(t), mask(t), ["frame"], "outline"), "surface", digits=3), "diameter", digits=4)


@query("laplacian_stats", f"""WITH {PX}, {MASK}, l AS (SELECT p.frame, p.y, p.x, p.v, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL AND d.v IS NOT NULL AND e.v IS NOT NULL THEN a.v+b.v+d.v+e.v-4*p.v END AS lap FROM px p LEFT JOIN px a ON a.frame=p.frame AND a.y=p.y AND a.x=p.x-1 LEFT JOIN px b ON b.frame=p.frame AND b.y=p.y AND b.x=p.x+1
LEFT JOIN px d ON d.frame=p.frame AND d.x=p.x AND d.y=p.y-1 LEFT JOIN px e ON e.frame=p.frame AND e.x=p.x AND e.y=p.y+1) SELECT mk.frame, 1 AS outline, round(var_pop(lap),4) AS lap_var, round(avg(v),6) AS brightness FROM mk JOIN l ON l.frame=mk.frame AND l.x=mk.x AND l.y=mk.y GROUP BY 1""")
def _(t):
    return rounded(rounded(R.laplacian_stats(pixels(t), mask(t), ["frame"], "outline", "v"), "lap_var", digits=4), "brightness")


def _mirrored(name: str, source: str, value: str, line: str, axis: str, weights: str) -> str:
    """Weighted sums along an axis of the grid: every position meets its neighbours by their mirrored places."""
    spot = f"((g.{axis}-g.{axis}0+g.ow.o)%(2*g.{axis}n)+2*g.{axis}n)%(2*g.{axis}n)"
    return f"""{name} AS MATERIALIZED (SELECT g.frame, g.y, g.x, g.x0, g.y0, g.xn, g.yn, {value} FROM (SELECT *, unnest([{weights}]) AS ow FROM {source}) g JOIN {source} s ON s.frame=g.frame AND s.{line}=g.{line} AND s.{axis}=g.{axis}0+least({spot}, 2*g.{axis}n-{spot}) GROUP BY ALL)"""


def _offsets(weights) -> str:
    return ",".join(f"{{'o': {i - len(weights) // 2}, 'w': {float(w)!r}::DOUBLE}}" for i, w in enumerate(weights) if w)


BLURS = _offsets(R.gaussian(R.BLUR))
NORMALS = f"""{NORM}, ex AS (SELECT frame, min(x) AS x0, max(x)-min(x) AS xn, min(y) AS y0, max(y)-min(y) AS yn FROM px GROUP BY 1),
g0 AS MATERIALIZED (SELECT ex.frame, CAST(b.y AS INT) AS y, CAST(a.x AS INT) AS x, x0, y0, xn, yn, coalesce(zn,0) AS v, (zn IS NOT NULL)::INT::DOUBLE AS c FROM ex, generate_series(0,60) a(x), generate_series(0,20) b(y) LEFT JOIN nz ON nz.frame=ex.frame AND nz.x=a.x AND nz.y=b.y WHERE a.x BETWEEN x0 AND x0+xn AND b.y BETWEEN y0 AND y0+yn),
{_mirrored("g1", "g0", "sum(g.ow.w*s.v) AS v, sum(g.ow.w*s.c) AS c", "y", "x", BLURS)}, {_mirrored("g2", "g1", "sum(g.ow.w*s.v)/nullif(sum(g.ow.w*s.c),0) AS v", "x", "y", BLURS)},
{_mirrored("g3", "g2", "sum(g.ow.w*s.v) AS soft", "x", "y", _offsets((1, 2, 1)))}, {_mirrored("g4", "g2", "sum(g.ow.w*s.v) AS step", "x", "y", _offsets((-1, 0, 1)))},
{_mirrored("g5", "g3", "sum(g.ow.w*s.soft) AS gx", "y", "x", _offsets((-1, 0, 1)))}, {_mirrored("g6", "g4", "sum(g.ow.w*s.step) AS gy", "y", "x", _offsets((1, 2, 1)))},
nm AS MATERIALIZED (SELECT frame, y, x, -gx/sqrt(gx*gx+gy*gy+1) AS nx, -gy/sqrt(gx*gx+gy*gy+1) AS ny, 1/sqrt(gx*gx+gy*gy+1) AS nz FROM g5 JOIN g6 USING (frame, y, x))"""


@query("surface_normals", f"""WITH {PX}, {MASK}, {NORMALS},
rf AS (SELECT frame, avg(nx) AS a, avg(ny) AS b, avg(nz) AS c FROM nm WHERE NOT EXISTS (SELECT 1 FROM mk m WHERE m.frame=nm.frame AND m.x=nm.x AND m.y=nm.y) GROUP BY 1 HAVING count(*)>=10), {reg(3, 'nm')},
an AS (SELECT rg.frame, degrees(acos(least(greatest((nx*a+ny*b+nz*c)/sqrt(a*a+b*b+c*c),-1),1))) AS d FROM rg JOIN rf USING (frame) WHERE NOT inside)
SELECT frame, 1 AS outline, round(avg(d),6) AS mean_normal_deviation, round(max(d),6) AS max_normal_deviation, round(stddev_pop(d),6) AS std_normal_deviation, round(quantile_cont(d,0.9),6) AS p90_normal_deviation FROM an GROUP BY 1 HAVING count(*)>=5""")
def _(t):
    n = R.surface_normals(pixels(t), mask(t), ["frame"], "outline", "z", 3)
    return rounded(n, "mean_normal_deviation", "max_normal_deviation", "std_normal_deviation", "p90_normal_deviation")


@query("water_cues", f"""WITH {PX}, {MASK}, {reg(4)}, s AS (SELECT frame, avg(v) FILTER (inside) AS vi, avg(v) FILTER (NOT inside) AS vr, stddev_pop(v) FILTER (inside) AS vs, avg(tax) FILTER (inside) AS ti, avg(tax) FILTER (NOT inside) AS tr, count(*) FILTER (NOT inside) AS rp FROM rg GROUP BY 1)
SELECT frame, 1 AS outline, round(0.5*least(greatest(1-ti/0.2,0),1)+0.5*CASE WHEN rp>10 AND tr>0.001 THEN least(greatest(1-(ti/tr-0.3)/0.9,0),1) ELSE least(greatest(1-ti/0.2,0),1) END,6) AS edge_density,
round(0.5*least(greatest(1-(vi-15)/105,0),1)+0.5*CASE WHEN rp>10 AND vr>0.1 THEN least(greatest(1-(vi/vr-0.4)/1.1,0),1) ELSE least(greatest(1-(vi-15)/105,0),1) END,6) AS gradient,
round(least(greatest((0.5*least(greatest(1-vi/80,0),1)+0.5*least(greatest(1-vs/50,0),1))*least(greatest((vi-80)/100,0.3),1),0),1),6) AS saturation,
round(0.5*least(greatest(ti*10,0),1)+0.5*least(greatest(0.5+ti*10-tr*10,0),1),6) AS semantic, round(CASE WHEN tr>1e-6 THEN least(greatest((ti/tr-0.85)/0.4,0),1) ELSE 0 END,6) AS residual,
round(least(greatest(greatest(least(greatest((ti*8-0.3)/0.1,0),1), least(greatest((vi/vr-1)/0.4,0),1))*0.6+least(least(greatest((ti*8-0.3)/0.1,0),1), least(greatest((vi/vr-1)/0.4,0),1))*0.4,0),1),6) AS color FROM s""")
def _(t):
    r = R.region(pixels(t), mask(t), ["frame"], "outline", 4)
    v = R.inside_vs_ring(r, KEY, "v").selectExpr("frame", "outline", "inside_mean vi", "inside_sd vs", "ring_mean vr", "ring_px rp")
    x = R.inside_vs_ring(r, KEY, "tax").selectExpr("frame", "outline", "inside_mean ti", "ring_mean tr").join(v, KEY)
    out = x.select(*KEY, R.edge_cue(c("ti"), c("tr"), c("rp")).alias("edge_density"), R.gradient_cue(c("vi"), c("vr"), c("rp")).alias("gradient"), R.saturation_cue(c("vi"), c("vs"), c("vi")).alias("saturation"),
                   R.prior_cue(c("ti") * 10, c("tr") * 10).alias("semantic"), R.residual_cue(c("ti"), c("tr")).alias("residual"), R.color_cue(c("ti") * 8, c("vi"), c("vr")).alias("color"))
    return rounded(out, "edge_density", "gradient", "saturation", "semantic", "residual", "color")


@query("inconsistency_cue", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest(least(1,(l_discount*5*0.4+l_tax*5+l_discount)/3)-least(1,l_tax/0.2),0),1),6) AS score FROM lineitem")
def _(t):
    s = R.inconsistency_cue(c("l_discount") * 5, c("l_tax"), c("l_discount"), c("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(s, 6).alias("score"))


@query("block_pool", f"WITH {PX} SELECT frame, CAST(floor(y/4) AS BIGINT) AS y, CAST(floor(x/4) AS BIGINT) AS x, round(avg(z),7) AS mean, count(*) AS n, avg(z)>400 AS deep FROM px GROUP BY 1,2,3")
def _(t):
    return rounded(R.block_pool(pixels(t), ["frame"], "z", 4, 400.0), "mean", digits=7)


COMPONENTS = f"""WITH RECURSIVE {PX}, cell AS (SELECT DISTINCT frame, CAST(floor(y/2) AS BIGINT) AS y, CAST(floor(x/2) AS BIGINT) AS x FROM px GROUP BY 1,2,3 HAVING avg(z)>340),
reach(frame, y, x, ly, lx) AS (SELECT frame, y, x, y, x FROM cell UNION SELECT c.frame, c.y, c.x, r.ly, r.lx FROM reach r JOIN cell c ON c.frame=r.frame AND abs(c.y-r.y)<=1 AND abs(c.x-r.x)<=1),
lab AS (SELECT frame, y, x, min((ly, lx)) AS c FROM reach GROUP BY 1,2,3)"""


@query("grid_components", COMPONENTS + ", s AS (SELECT frame, c, count(*) AS size FROM lab GROUP BY 1,2) SELECT frame, c[1] AS cy, c[2] AS cx, size, CAST(row_number() OVER (PARTITION BY frame ORDER BY size DESC, c) AS INT) AS rank FROM s WHERE size>=2 QUALIFY rank<=3")
def _(t):
    cells = R.block_pool(pixels(t), ["frame"], "z", 2, 340.0).where("deep")
    return R.grid_components(cells, ["frame"], 2, 3).select("frame", c("c.y").alias("cy"), c("c.x").alias("cx"), "size", "rank")


@query("bright_clustering", COMPONENTS + ", s AS (SELECT frame, count(DISTINCT c) AS regions, count(*)/150.0::DOUBLE AS share FROM lab GROUP BY 1) SELECT frame, regions, round(CASE WHEN share<0.02 THEN 0 ELSE least(greatest(0.4*least(1,share*3)+0.6*CASE WHEN share>0.6 AND regions<=3 THEN 0.2 WHEN regions>20 THEN 0.1 WHEN regions<=8 AND share<0.5 THEN 0.9 ELSE 0.5 END,0),1) END,6) AS score FROM s")
def _(t):
    cells = R.block_pool(pixels(t), ["frame"], "z", 2, 340.0).where("deep")
    n = R.component_count(cells, ["frame"])
    return n.select("frame", "regions", F.round(R.clustering_score(c("cells") / 150.0, c("regions")), 6).alias("score"))


def _plane(source: str, value: str, first: str, second: str, key: str) -> str:
    """A plane from centred moments: key, n, a, b, c, null where the points lie on a line."""
    m = f"SELECT {key}, count(*) AS n, avg({first}) AS mx, avg({second}) AS my, avg({value}) AS mz, var_pop({first}) AS xx, var_pop({second}) AS yy, covar_pop({first},{second}) AS xy, covar_pop({first},{value}) AS xz, covar_pop({second},{value}) AS yz FROM {source} GROUP BY {key}"
    f = f"SELECT *, CASE WHEN xx*yy-xy*xy>1e-12*greatest(xx*yy,1e-300) THEN xx*yy-xy*xy END AS det FROM ({m})"
    return f"SELECT {key}, n, a, b, mz-a*mx-b*my AS c FROM (SELECT *, (xz*yy-yz*xy)/det AS a, (yz*xx-xz*xy)/det AS b FROM ({f}))"


def _trimmed(points: str, fit, residual: str, rounds: int) -> str:
    """CTEs of a fit that drops rows beyond 2.5 deviations of those kept and starts again; the last is s<rounds>."""
    out, kept = [], points
    for k in range(1, rounds + 1):
        out += [f"f{k} AS MATERIALIZED ({fit(kept)})", f"s{k} AS MATERIALIZED (SELECT p.frame, stddev_pop({residual}) AS sd FROM {kept} p JOIN f{k} f USING (frame) GROUP BY 1)",
                f"k{k} AS (SELECT p.* FROM {points} p JOIN f{k} f USING (frame) JOIN s{k} s USING (frame) WHERE abs({residual})<2.5*s.sd)"]
        kept = f"k{k}"
    return ", ".join(out)


@query("inverse_plane_fit", f"WITH {PX}, pz AS (SELECT frame, x, y, z+1000 AS z, 1/(z+1000) AS iz FROM px), {_trimmed('pz', lambda src: _plane(src, 'iz', 'x', 'y', 'frame'), 'p.z-1/(f.a*p.x+f.b*p.y+f.c)', 3)} SELECT frame, round(c,9) AS c, round(sd,3) AS sd FROM f3 JOIN s3 USING (frame)")
def _(t):
    f = R.inverse_plane_fit(pixels(t).withColumn("z", c("z") + 1000), ["frame"], "z")
    return f.select("frame", F.round(c("coef")[2], 9).alias("c"), F.round("sd", 3).alias("sd"))


def _six(source: str) -> str:
    rows = ",".join("[" + ",".join(f"sum(t[{i}]*t[{j}])" for j in range(1, 7)) + f",sum(t[{i}]*z)]" for i in range(1, 7))
    m = f"SELECT frame, [{rows}] AS m FROM (SELECT *, [u,v,1.0::DOUBLE,u*u,u*v,v*v] AS t FROM {source}) GROUP BY frame"
    for i in range(1, 7):
        m = f"SELECT frame, list_transform(m, lambda row, r: CASE WHEN r={i} THEN row ELSE list_transform(row, lambda a, n: a-row[{i}]/m[{i}][{i}]*m[{i}][n]) END) AS m FROM ({m})"
    return f"SELECT frame, list_transform(m, lambda row, r: row[7]/row[r]) AS e FROM ({m})"


@query("quadratic_road", f"""WITH {PX}, pq AS (SELECT frame, x*20.0/1000 AS u, (y*100.0+2000)/1000 AS v, z FROM px), {_trimmed('pq', _six, 'p.z-(f.e[1]*p.u+f.e[2]*p.v+f.e[3]+f.e[4]*p.u*p.u+f.e[5]*p.u*p.v+f.e[6]*p.v*p.v)', 4)}
SELECT frame, round(1/sqrt(1+pow(e[1]/1000,2)+pow(e[2]/1000,2)),6) AS cosine, round(sd/sqrt(1+pow(e[1]/1000,2)+pow(e[2]/1000,2)),4) AS road_sd FROM f4 JOIN s4 USING (frame)""")
def _(t):
    px = pixels(t).select("frame", (c("x") * 20.0).alias("a"), (c("y") * 100.0 + 2000).alias("b"), "z")
    return R.quadratic_road(px, ["frame"], "a", "b", "z").select("frame", F.round("cosine", 6).alias("cosine"), F.round("road_sd", 4).alias("road_sd"))


@query("plane_3d")
def _(t):
    pts = pixels(t).select("frame", ((c("x") - 25) * c("z") / 500).alias("PX"), ((c("y") - 5) * c("z") / 500).alias("PY"), c("z").alias("PZ"))
    return R.plane_3d(pts, ["frame"], ["PX", "PY", "PZ"]).select("frame", F.round("rms", 6).alias("rms"), F.round("tilt_deg", 4).alias("tilt_deg"))


OUTLINE = "bx AS (SELECT frame, avg(x) AS cx, avg(y) AS cy, min(x) AS x0, max(x) AS x1, greatest(1,max(x)-min(x)) AS w, greatest(1,max(y)-min(y)) AS h FROM mk GROUP BY 1)"


@query("depth_profile", f"""WITH {PX}, {MASK}, {NORM}, {OUTLINE}, g AS (SELECT frame, cx, cy, unnest(range(-CAST(floor(greatest(w,h)*1.5) AS INT), CAST(floor(greatest(w,h)*1.5) AS INT)+1)) AS t FROM bx),
pt AS (SELECT frame, t, cut, CAST(trunc(round(cx+t*cos(pi()*cut/8),9)) AS INT) AS x, CAST(trunc(round(cy+t*sin(pi()*cut/8),9)) AS INT) AS y FROM g, (SELECT unnest(range(0,8)) AS cut)),
o AS (SELECT frame, cut, t::DOUBLE AS t, (t*t)::DOUBLE AS t2, zn FROM pt JOIN nz USING (frame, x, y) WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.frame=pt.frame AND mk.x=pt.x AND mk.y=pt.y)), f AS ({_plane('o', 'zn', 't2', 't', 'frame, cut')}),
ce AS (SELECT bx.frame, zn AS mid FROM bx JOIN nz ON nz.frame=bx.frame AND nz.x=CAST(trunc(cx) AS INT) AND nz.y=CAST(trunc(cy) AS INT)), cu AS (SELECT frame, abs(c-mid) AS bowl, abs(a) AS a, abs(b) AS b FROM f LEFT JOIN ce USING (frame) WHERE n>=6 AND a IS NOT NULL)
SELECT frame, 1 AS outline, round(avg(bowl),6) AS mean_bowl_depth, round(max(bowl),6) AS max_bowl_depth, round(stddev_pop(bowl),6) AS std_bowl_depth, round(avg(a),7) AS mean_road_curvature, round(var_pop(b),8) AS slope_variance FROM bx LEFT JOIN cu USING (frame) GROUP BY 1""")
def _(t):
    got = rounded(R.depth_profile(pixels(t), mask(t), ["frame"], "outline", "z"), "mean_bowl_depth", "max_bowl_depth", "std_bowl_depth")
    return rounded(rounded(got, "mean_road_curvature", digits=7), "slope_variance", digits=8)


SEVERITY = {0: "Shallow", 1: "Moderate", 2: "Deep"}
SLICE = f"""{PX}, {MASK}, {NORM}, {OUTLINE}, ln AS (SELECT bx.frame, nz.y, nz.x, nz.x-greatest(0,x0-CAST(floor(w*0.8) AS INT)) AS pos, zn AS d, EXISTS (SELECT 1 FROM mk WHERE mk.frame=nz.frame AND mk.x=nz.x AND mk.y=nz.y) AS i FROM bx JOIN nz ON nz.frame=bx.frame AND nz.y=CAST(trunc(cy) AS INT) AND nz.x BETWEEN greatest(0,x0-CAST(floor(w*0.8) AS INT)) AND x1+CAST(floor(w*0.8) AS INT)),
ou AS (SELECT frame, pos::DOUBLE AS t, (pos*pos)::DOUBLE AS t2, d FROM ln WHERE NOT i), fo AS ({_plane('ou', 'd', 't2', 't', 'frame')}), lm AS (SELECT frame, min(pos) FILTER (i) AS lo, max(pos) FILTER (i) AS hi, count(*) FILTER (i) AS n, avg(d) FILTER (NOT i) AS mean FROM ln GROUP BY 1),
rw AS MATERIALIZED (SELECT ln.frame, pos, i, d, lo, hi, frame%3<>0 AND lm.n>10 AS under, (frame//3)%3 AS sev, greatest(3,CAST(floor((hi-lo)*0.2) AS INT)) AS mg, CASE WHEN fo.n>=4 AND fo.a IS NOT NULL THEN fo.a*pos*pos+fo.b*pos+fo.c ELSE mean END AS road FROM ln JOIN lm USING (frame) LEFT JOIN fo USING (frame)),
wl AS (SELECT frame, pos::DOUBLE AS t, (pos*pos)::DOUBLE AS t2, d FROM rw WHERE under AND (pos BETWEEN lo-5 AND lo+mg-1 OR pos BETWEEN hi-mg AND hi+4)), fw AS (SELECT * FROM ({_plane('wl', 'd', 't2', 't', 'frame')}) WHERE n>=3),
pr AS (SELECT rw.*, fw.a, fw.b, fw.c, (hi-lo)*CASE sev WHEN 0 THEN 0.0002 WHEN 2 THEN 0.0012 ELSE 0.0006 END AS dm FROM rw LEFT JOIN fw USING (frame)),
sl AS (SELECT frame, pos, i, d, road, coalesce(CASE WHEN under AND a IS NOT NULL THEN least(CASE WHEN a>=1e-5 THEN a*pos*pos+b*pos+c ELSE 4*dm/((hi-lo)*(hi-lo))*pow(pos-(lo+hi)/2.0,2)+road-dm END, road, CASE WHEN i THEN d END) END, d) AS pred FROM pr)"""


def slices(t):
    level = F.when(F.floor(c("frame") / 3) % 3 == 0, SEVERITY[0]).when(F.floor(c("frame") / 3) % 3 == 2, SEVERITY[2]).otherwise(SEVERITY[1])
    facts = t.supplier.select(c("s_suppkey").alias("frame"), F.lit(1).alias("outline"), (c("s_suppkey") % 3 != 0).alias("wet")).withColumn("severity", level)
    return R.depth_slice(pixels(t), mask(t), ["frame"], "outline", "z", facts)


@query("depth_slice", f"WITH {SLICE} SELECT frame, 1 AS outline, pos AS \"at\", i AS in_mask, round(d,6) AS depth, round(road,6) AS road, round(pred,6) AS predicted FROM sl")
def _(t):
    return rounded(slices(t), "depth", "road", "predicted")


@query("slice_depths", f"WITH {SLICE} SELECT frame, 1 AS outline, round(coalesce(max(abs(road-d)) FILTER (i),0),6) AS bowl_depth, round(coalesce(max(abs(road-pred)) FILTER (i),0),6) AS predicted_bowl_depth FROM sl GROUP BY 1")
def _(t):
    return rounded(R.slice_depths(slices(t), KEY), "bowl_depth", "predicted_bowl_depth")


@query("rasterise_outlines", """
WITH o AS (SELECT p_partkey AS frame, 10.25+p_size/2.0::DOUBLE AS cx, 20.0::DOUBLE AS cy, 5+p_size%7+0.3 AS w, 4+p_size%5+0.4 AS h FROM part),
g AS (SELECT frame, cx, cy, w, h, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM o, generate_series(0,40) a(y), generate_series(0,60) b(x))
SELECT frame, 1 AS outline, y, x FROM g WHERE abs(x-cx)/w + abs(y-cy)/h < 1""")
def _(t):
    s = c("p_size")
    cx, cy, w, h = 10.25 + s / 2.0, F.lit(20.0), 5 + s % 7 + 0.3, 4 + s % 5 + 0.4
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    o = t.part.select(c("p_partkey").alias("frame"), F.lit(1).alias("outline"), F.array(pt(cx - w, cy), pt(cx, cy - h), pt(cx + w, cy), pt(cx, cy + h)).alias("pts"))
    return R.rasterise(o, ["frame"], "outline", "pts")


PATCH = "((x-4)*(x-4)+(y-4)*(y-4)<=CASE frame%3 WHEN 0 THEN 6 WHEN 1 THEN 30 ELSE 200 END AND vec_id%100<98)"


@query("embedding_ratio", f"""WITH p0 AS (SELECT vec_id//100 AS frame, vec_id%100//10 AS y, vec_id%10 AS x, vec_id, embedding FROM embeddings), p AS (SELECT *, {PATCH} AS i FROM p0),
p1 AS MATERIALIZED (SELECT p.*, NOT i AND EXISTS (SELECT 1 FROM p q WHERE q.frame=p.frame AND q.i AND abs(q.x-p.x)<=2 AND abs(q.y-p.y)<=2) AS ring FROM p),
n AS (SELECT frame, count(*) FILTER (i) AS k, count(*) FILTER (NOT i) AS o, count(*) FILTER (ring) AS r, CASE WHEN count(*) FILTER (ring)>=2 THEN 'ring' ELSE 'scene' END AS src FROM p1 GROUP BY 1 HAVING count(*) FILTER (i)>=2 AND count(*) FILTER (NOT i)>=2),
d AS (SELECT frame, i, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS j FROM p1 JOIN n USING (frame)),
s AS (SELECT frame, j, var_samp(v) FILTER (i) AS vi, var_samp(v) FILTER (NOT i) AS vo, avg(v) FILTER (i) AS mi, avg(v) FILTER (NOT i) AS mo FROM d GROUP BY 1,2),
b AS (SELECT frame, avg(vi) AS vi, avg(vo) AS vo, 1-sum(mi*mo)/sqrt(sum(mi*mi)*sum(mo*mo)) AS dis FROM s GROUP BY 1),
e AS (SELECT frame, embedding, k, draw, CASE WHEN src='ring' THEN r ELSE o END<=k AS few, row_number() OVER (PARTITION BY frame, draw ORDER BY md5(concat_ws(':', frame, 1, y, x, draw)), y, x) AS rk FROM p1 JOIN n USING (frame), (SELECT unnest(range(1,21)) AS draw) WHERE CASE WHEN src='ring' THEN ring ELSE NOT i END),
w AS (SELECT frame, draw, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS j FROM e WHERE few OR rk<=k), x AS (SELECT frame, draw, j, var_samp(v) AS v FROM w GROUP BY 1,2,3), y AS (SELECT frame, draw, avg(v) AS v FROM x GROUP BY 1,2), z AS (SELECT frame, quantile_cont(v,0.5) AS v FROM y GROUP BY 1)
SELECT frame, 1 AS outline, k AS patches, src AS ring_source, round(vi,6) AS inside_variance, round(vo,6) AS outside_variance, round(dis,6) AS dissimilarity, round(z.v,6) AS ring_variance, round(CASE WHEN z.v>1e-9 THEN vi/z.v END,6) AS ratio FROM n JOIN b USING (frame) JOIN z USING (frame)""")
def _(t):
    e = t.embeddings.select(F.floor(c("vec_id") / 100).alias("frame"), F.lit(1).alias("outline"), F.floor(c("vec_id") % 100 / 10).alias("y"), (c("vec_id") % 10).alias("x"), "vec_id", "embedding")
    size = F.when(c("frame") % 3 == 0, 6).when(c("frame") % 3 == 1, 30).otherwise(200)
    p = e.withColumn("inside", ((c("x") - 4) * (c("x") - 4) + (c("y") - 4) * (c("y") - 4) <= size) & (c("vec_id") % 100 < 98))
    return rounded(R.embedding_ratio(p, ["frame"], "outline", "inside", "embedding"), "inside_variance", "outside_variance", "ring_variance", "dissimilarity", "ratio")
