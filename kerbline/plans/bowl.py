"""The bowl under water over frames made of line items; its SQL repeats every sample, refit and test."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators.bowl import powers, recover_bowl
from kerbline.plans.raster import MASK, PX, c, mask, pixels, reg, rounded
from kerbline.plans.registry import query

SAMPLES = 24
OVAL = "((x-25)*(x-25)/100.0+(y-5)*(y-5)/9.0)"


def relief(t):
    """Pixels with a relief that is a bowl with noise (every fifth frame a slope), and the middle of most frames under water."""
    px = pixels(t)
    oval = (c("x") - 25) * (c("x") - 25) / F.lit(100.0) + (c("y") - 5) * (c("y") - 5) / F.lit(9.0)
    bowl = F.when(c("frame") % 5 == 0, c("x") * 2.0).otherwise(50.0 - 45.0 * oval)
    wet = (oval < 0.35) & (c("frame") % 7 != 0)
    return px.select("frame", "y", "x", F.when(wet, 30.0 + c("z") % 2.0).otherwise(bowl + c("z") % 9.0 - 4.5 + F.when(c("v") > 200, 40.0).otherwise(0.0)).alias("relief"), wet.alias("wet"))


def _value(degree: int, u: str = "u", v: str = "v") -> str:
    return "0.0::DOUBLE" + "".join(f"+coef[{k + 1}]*({'*'.join(['1.0::DOUBLE', *[u] * i, *[v] * j])})" for k, (i, j) in enumerate(powers(degree)))


def _terms(degree: int) -> str:
    return ",".join("*".join(["1.0::DOUBLE", *["u"] * i, *["v"] * j]) for i, j in powers(degree))


def _solved(source: str, k: int, keep: str) -> str:
    for i in range(1, k + 1):
        source = f"SELECT {keep}, list_transform(m, lambda row, r: CASE WHEN r={i} THEN row ELSE list_transform(row, lambda a, n: a-row[{i}]/nullif(m[{i}][{i}],0)*m[{i}][n]) END) AS m FROM ({source})"
    solution = f"SELECT {keep}, list_transform(m, lambda row, r: row[{k + 1}]/nullif(row[r],0)) AS coef FROM ({source})"
    return f"SELECT * FROM ({solution}) WHERE len(list_filter(coef, lambda a: a IS NULL OR isnan(a)))=0"


def _least_squares(source: str, degree: int, keep: str) -> str:
    k = len(powers(degree))
    rows = ",".join("[" + ",".join(f"sum(t[{i}]*t[{j}])" for j in range(1, k + 1)) + f",sum(t[{i}]*z)]" for i in range(1, k + 1))
    return _solved(f"SELECT {keep}, count(*) AS n, [{rows}] AS m FROM (SELECT *, [{_terms(degree)}] AS t FROM ({source})) GROUP BY {keep}", k, f"{keep}, n")


QUADRIC = "coef[4]<0 AND coef[6]<0 AND 4*coef[4]*coef[6]-coef[5]*coef[5]>0"


def _consensus(d: int, done: list[int]) -> str:
    k = len(powers(d))
    open_ = "".join(f" AND frame NOT IN (SELECT frame FROM f{o})" for o in done)
    runs = f"floor(n_points/{k})"
    hit = f"abs({_value(d)}-z)<8"
    if d == 2:
        good = f"g{d} AS MATERIALIZED (SELECT * FROM b{d} WHERE {QUADRIC})"
    else:
        x = {n: f"({_value(d, u, v)})" for n, u, v in (
            ("r", "(du+(2.0/scale))", "dv"), ("l", "(du-(2.0/scale))", "dv"), ("t", "du", "(dv+(2.0/scale))"), ("b", "du", "(dv-(2.0/scale))"), ("rt", "(du+(2.0/scale))", "(dv+(2.0/scale))"),
            ("rb", "(du+(2.0/scale))", "(dv-(2.0/scale))"), ("lt", "(du-(2.0/scale))", "(dv+(2.0/scale))"), ("lb", "(du-(2.0/scale))", "(dv-(2.0/scale))"))}
        good = f"""w{d} AS MATERIALIZED (SELECT b.frame, b.sample, b.n, b.coef, u AS du, v AS dv, edge, level, scale, {_value(d)} AS mid, count(*) OVER (PARTITION BY b.frame, b.sample) AS wpx FROM b{d} b JOIN pt USING (frame) WHERE under
        QUALIFY row_number() OVER (PARTITION BY b.frame, b.sample ORDER BY {_value(d)} DESC, y, x)=1),
        h{d} AS (SELECT *, {x['r']}-2*mid+{x['l']} AS xx, {x['t']}-2*mid+{x['b']} AS yy, ({x['rt']}-{x['rb']}-{x['lt']}+{x['lb']})/4 AS xy FROM w{d}),
        g{d} AS MATERIALIZED (SELECT * FROM h{d} WHERE wpx>=5 AND NOT edge AND mid>level+0.5 AND xx<0 AND yy<0 AND xx*yy-xy*xy>0)"""
    return f"""
p{d} AS MATERIALIZED (SELECT * FROM pt WHERE NOT under AND z IS NOT NULL{open_}),
r{d} AS (SELECT *, unnest(range(1, CAST(ceil({SAMPLES}/{runs}) AS INT)+1)) AS round FROM p{d} WHERE n_points>={3 * k}),
o{d} AS (SELECT *, row_number() OVER (PARTITION BY frame, round ORDER BY md5(concat_ws(':', frame, 1, y, x, round)), y, x)-1 AS pos FROM r{d}),
m{d} AS (SELECT frame, (round-1)*{runs}+floor(pos/{k}) AS sample, list([{_terms(d)}, z] ORDER BY pos) AS m FROM o{d} WHERE floor(pos/{k})<{runs} GROUP BY 1,2 HAVING sample<{SAMPLES}),
s{d} AS MATERIALIZED (SELECT * FROM ({_solved(f"SELECT * FROM m{d}", k, "frame, sample")}) {f"WHERE {QUADRIC}" if d == 2 else ""}),
t{d} AS MATERIALIZED (SELECT frame, sample, any_value(coef) AS coef FROM s{d} JOIN p{d} USING (frame) WHERE {hit} GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY count(*) DESC, sample)<=10),
a{d} AS MATERIALIZED (SELECT * FROM ({_least_squares(f"SELECT * FROM t{d} JOIN p{d} USING (frame) WHERE {hit}", d, "frame, sample")}) WHERE n>={3 * k}),
b{d} AS MATERIALIZED (SELECT * FROM ({_least_squares(f"SELECT * FROM a{d} JOIN p{d} USING (frame) WHERE {hit}", d, "frame, sample")}) WHERE n>={3 * k}),
{good},
f{d} AS MATERIALIZED (SELECT frame, coef, {d} AS degree, 'consensus degree {d}' AS bowl FROM g{d} QUALIFY row_number() OVER (PARTITION BY frame ORDER BY n DESC, sample)=1)"""


RECOVER = f"""WITH {PX}, {MASK},
s0 AS (SELECT frame, y, x, ({OVAL}<0.35 AND frame%7<>0) AS wet, CASE WHEN {OVAL}<0.35 AND frame%7<>0 THEN 30+fmod(z,2) ELSE CASE WHEN frame%5=0 THEN x*2.0 ELSE 50-45*{OVAL} END+fmod(z,9)-4.5+CASE WHEN v>200 THEN 40 ELSE 0 END END::DOUBLE AS z FROM px),
{reg(5, 's0')}, nu AS (SELECT *, inside AND wet AS under FROM rg),
n1 AS (SELECT *, min(under::INT) OVER (PARTITION BY frame, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m1 FROM nu), n2 AS (SELECT *, min(m1) OVER (PARTITION BY frame, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)=0 AS edge FROM n1),
fa AS MATERIALIZED (SELECT frame, quantile_cont(z,0.9) FILTER (inside) AS surface_mm, count(*) FILTER (under) AS wet_px, count(*) FILTER (inside AND NOT under) AS wall_px, count(*) FILTER (NOT under) AS n_points, quantile_cont(z,0.5) FILTER (under) AS level,
       greatest(max(x) FILTER (NOT under)-min(x) FILTER (NOT under), max(y) FILTER (NOT under)-min(y) FILTER (NOT under), 1)::DOUBLE AS scale FROM n2 GROUP BY 1),
sz AS (SELECT frame, count(*) AS mask_px, avg(x) AS cx, avg(y) AS cy FROM mk GROUP BY 1),
rd AS MATERIALIZED (SELECT *, CASE WHEN wet_px=0 THEN 'no water' WHEN wall_px<30 THEN 'too little visible wall' END AS reason FROM sz JOIN fa USING (frame)),
pt AS MATERIALIZED (SELECT n2.*, (x-cx)/scale AS u, (y-cy)/scale AS v, scale, level, n_points FROM n2 JOIN rd USING (frame) WHERE reason IS NULL),
{_consensus(3, [])},{_consensus(4, [3])},{_consensus(2, [3, 4])},
q AS (SELECT frame, coef, 2 AS degree, 'least-squares quadric' AS bowl FROM ({_least_squares("SELECT * FROM pt WHERE NOT under AND z IS NOT NULL AND frame NOT IN (SELECT frame FROM f3 UNION ALL SELECT frame FROM f4 UNION ALL SELECT frame FROM f2)", 2, "frame")}) WHERE {QUADRIC}),
al AS (SELECT * FROM f3 UNION ALL SELECT * FROM f4 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM q),
dp AS (SELECT frame, any_value(bowl) AS bowl, quantile_cont(CASE WHEN under THEN least(greatest(z, CASE degree WHEN 2 THEN {_value(2)} WHEN 3 THEN {_value(3)} ELSE {_value(4)} END, 0), 300) ELSE z END, 0.9) AS deep FROM pt JOIN al USING (frame) WHERE inside GROUP BY 1)
SELECT frame, 1 AS outline, round(wet_px/mask_px,6) AS water_share, round(surface_mm,3) AS surface_mm, round(coalesce(deep,surface_mm),3) AS recovered_mm, bowl,
       coalesce(reason, CASE WHEN bowl IS NULL THEN 'visible wall is not bowl-shaped' END) AS abstained FROM rd LEFT JOIN dp USING (frame)"""


@query("recover_bowl", RECOVER)
def _(t):
    got = recover_bowl(relief(t), mask(t), ["frame"], "outline", "relief", "wet", SAMPLES)
    return rounded(rounded(got, "surface_mm", "recovered_mm", digits=3), "water_share")
