"""Decisions about one pothole as column expressions: bands, votes, water, age, progression, standards, risk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.functions.numbers import clip

# fixed values: band edges in mm, caps, and the depth bands and table of the ASTM D6433 standard
SHALLOW_MAX_MM, MODERATE_MAX_MM, MAX_PLAUSIBLE_MM = 25.0, 50.0, 250.0
ASTM_DEPTH_MM = (13.0, 25.0, 50.0)
ASTM_WIDTH_MM = (100.0, 200.0, 450.0, 750.0)
ASTM_TABLE = (("L", "L", "M"), ("L", "M", "H"), ("M", "M", "H"))
ASTM_LARGE_UNIT_MM2 = 500000.0
# fixed values: what the water ensemble weighs, its corrections and bands
WATER_WEIGHTS = {"edge_density": 0.25, "gradient": 0.20, "specular": 0.15, "color": 0.15, "saturation": 0.10,
                 "inconsistency": 0.15, "semantic": 0.15, "residual": 0.10}
WATER_THRESHOLD = 0.35
ENSEMBLE_BANDS = (0.65, 0.45, 0.35)
COVERAGE_THRESHOLD, COVERAGE_BANDS = 0.1, (0.5, 0.3, 0.1)
# fixed values: texture-ratio override
DOWNGRADE_RATIO, UPGRADE_RATIO, MIN_PATCHES = 0.9, 1.35, 8
# fixed values: deterioration per day, climate factors, scores of the severities
DAILY_RATE = {"Shallow": 0.010, "Moderate": 0.030, "Deep": 0.060}
CLIMATE = {"freeze_thaw": 1.5, "tropical_rain": 1.3, "temperate": 1.0, "dry_arid": 0.8}
SEVERITY_SCORE = {"Shallow": 0.165, "Moderate": 0.495, "Deep": 0.83}


def lookup(key: Column, table: Mapping[str, float], default) -> Column:
    """Small dictionary as a CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def normalise_label(label: Column) -> Column:
    return F.when(label == "No pothole", "No Pothole").otherwise(label)


def severity_rank(label: Column) -> Column:
    """Ordinal 0 to 3; unknown labels rank 0."""
    return lookup(label, {"Shallow": 1, "Moderate": 2, "Deep": 3}, 0)


def rule_severity(area: Column, contrast: Column, std: Column, max_depth: Column) -> Column:
    """Rule verdict from relative depth, with the older absolute rule when the contrast is missing; a missing spread or depth reads as 0."""
    std, max_depth = F.coalesce(std, F.lit(0.0)), F.coalesce(max_depth, F.lit(0.0))
    return (F.when(area.isNull() | (area <= 0), "No pothole")
            .when(contrast.isNotNull(), F.when((contrast < 0.05) & (std < 0.05), "Shallow")
                  .when((contrast > 0.15) | (std > 0.15), "Deep").otherwise("Moderate"))
            .when((max_depth < 0.3) & (area < 500), "Shallow").when(max_depth < 0.6, "Moderate").otherwise("Deep"))


def band(mm: Column, moderate_from=SHALLOW_MAX_MM, deep_from=MODERATE_MAX_MM) -> Column:
    """Severity of a depth; pass an estimator's own cut-offs to grade a predicted depth."""
    return F.when(mm < moderate_from, "Shallow").when(mm < deep_from, "Moderate").when(mm.isNotNull(), "Deep")


def served_depth(relief: Column, regressor: Column, relief_q80: Column, regressor_q80: Column, zoomed: Column | None = None, relief_cuts: tuple[float, float] = (SHALLOW_MAX_MM, MODERATE_MAX_MM),
                 regressor_cuts: tuple[float, float] = (SHALLOW_MAX_MM, MODERATE_MAX_MM)) -> Column:
    """What is served for a depth: the relief reading (of the close-up where there is one), else the regressor's, else null.

    Fields: depth_mm, interval_mm (width to either side), low_mm and high_mm, severity (at the cut-offs of the estimator that is served), band (at those of a measured depth), source, and
    read_from (close-up or frame, null for the regressor). Without an error interval its three fields are null.
    """
    read = relief if zoomed is None else F.coalesce(zoomed, relief)
    mm = clip(F.coalesce(read, regressor), 0.0, MAX_PLAUSIBLE_MM)
    q80 = F.when(read.isNotNull(), relief_q80).otherwise(regressor_q80)
    close = F.lit(False) if zoomed is None else zoomed.isNotNull()
    return F.when(mm.isNotNull(), F.struct(
        F.bround(mm, 1).alias("depth_mm"), F.bround(q80, 1).alias("interval_mm"), F.bround(F.when(q80.isNotNull(), F.greatest(mm - q80, F.lit(0.0))), 1).alias("low_mm"),
        F.bround(mm + q80, 1).alias("high_mm"), F.when(read.isNotNull(), band(mm, *relief_cuts)).otherwise(band(mm, *regressor_cuts)).alias("severity"), band(mm).alias("band"),
        F.when(read.isNotNull(), "relief").otherwise("regressor").alias("source"), F.when(close, "close-up").when(read.isNotNull(), "frame").alias("read_from")))


def semantic_override(consensus: Column, rule: Column, ratio: Column, patches: Column) -> Column:
    """(severity, verdict, warning) after the texture check; abstains on a missing ratio or too few patches."""
    deep = (consensus == "Deep") | (rule == "Deep")
    low, high = ratio < DOWNGRADE_RATIO, ratio > UPGRADE_RATIO
    absent = ratio.isNull() | F.isnan(ratio)
    final = (F.when(absent | (patches < MIN_PATCHES), consensus).when(low & deep, "Shallow")
             .when(high & (consensus == "Shallow"), "Moderate").otherwise(consensus))
    verdict = (F.when(absent, "unavailable").when(patches < MIN_PATCHES, "abstained_sparse_patches")
               .when(low & deep, "downgraded_texture_illusion").when(low, "smooth_interior_no_action")
               .when(high & (consensus == "Shallow"), "raised_heterogeneous_interior")
               .when(high, "heterogeneous_interior_confirms").otherwise("inconclusive"))
    return F.struct(final.alias("severity"), verdict.alias("verdict"), (verdict == "downgraded_texture_illusion").alias("warning"))


def agreement(votes: Column, final: Column) -> Column:
    """How many votes in a map match the final verdict."""
    return F.size(F.filter(F.map_values(votes), lambda v: v == final))


def geometry_severity(high_curv: Column, max_curv: Column, normal_dev: Column, bowl: Column) -> Column:
    """Severity from shape alone: one point per sign of a crater."""
    point = lambda c: F.when(c, 1).otherwise(0)
    score = point(high_curv > 0.18) + point(max_curv > 0.30) + point(normal_dev > 25) + point(bowl > 0.10)
    return F.when(score >= 3, "Deep").when(score >= 1, "Moderate").otherwise("Shallow")


def failure_mode(before: Column, geo: Column, is_water: Column, inside_var: Column, outside_var: Column, contrast: Column) -> Column:
    """(verdict, mode): water, texture illusion, flattened depth, or agreement; the first that applies."""
    illusion = (before == "Deep") & (inside_var > 0) & (inside_var < outside_var * 0.9)
    flat = (before == "Shallow") & (contrast < 0.06) & (geo != "Shallow")
    after = (F.when(is_water, F.when(geo == "Shallow", "Moderate").otherwise(geo)).when(illusion, "Shallow").when(flat, geo).otherwise(before))
    mode = (F.when(is_water, "WATER REFLECTION").when(illusion, "TEXTURE / SHADOW ILLUSION")
            .when(flat, "DRY / SHADOWLESS FLATTENING").otherwise("AGREEMENT (no failure)"))
    return F.struct(after.alias("verdict"), mode.alias("mode"))


def water_probability(cues: Mapping[str, Column], logistic: Mapping[str, float] | None = None, intercept: float = 0.0) -> Column:
    """Logistic when every cue it was fitted on is present, else the weighted mean over the cues that are.

    A missing cue is null and abstains. ``combination`` names the path taken.
    """
    present = {k: c.isNotNull() for k, c in cues.items()}
    total = sum((F.when(present[k], WATER_WEIGHTS[k]).otherwise(0.0) for k in cues), F.lit(0.0))
    weighted = sum((F.when(present[k], c * WATER_WEIGHTS[k]).otherwise(0.0) for k, c in cues.items()), F.lit(0.0))
    mean = weighted / F.greatest(total, F.lit(1e-8))
    if not logistic:
        return F.struct(mean.alias("probability"), F.lit("weighted_mean").alias("combination"))
    z, complete = F.lit(float(intercept)), F.lit(True)
    for k, w in logistic.items():
        z, complete = z + cues[k] * w, complete & present[k]
    fitted = 1.0 / (1.0 + F.exp(-clip(z, -30.0, 30.0)))
    return F.struct(F.when(complete, fitted).otherwise(mean).alias("probability"),
                    F.when(complete, "logistic").otherwise("fallback_missing_cues").alias("combination"))


def water_corrections(p: Column, edge: Column, gradient: Column) -> Column:
    """Agreement boost, rough-surface caps and gradient penalty, in that order, clipped to [0, 1]."""
    p = F.when((edge > 0.6) & (gradient > 0.6), p * 0.65 + 0.35).otherwise(p)
    p = F.when(edge < 0.15, F.least(p, F.lit(0.25))).when(edge < 0.30, F.least(p, F.lit(0.40))).otherwise(p)
    p = F.when(gradient < 0.15, p * 0.6).otherwise(p)
    return clip(p, 0.0, 1.0)


def water_decision(probability: Column, coverage: Column) -> Column:
    """The segmenter's coverage decides when it is there, else the ensemble; with a confidence band."""
    seen = coverage.isNotNull()

    def level(x, cuts):
        return F.when(x > cuts[0], "high").when(x > cuts[1], "medium").when(x > cuts[2], "low").otherwise("none")

    return F.struct(F.when(seen, coverage > COVERAGE_THRESHOLD).otherwise(probability > WATER_THRESHOLD).alias("is_water"),
                    F.bround(F.coalesce(coverage, probability), 4).alias("probability"),
                    F.when(seen, level(coverage, COVERAGE_BANDS)).otherwise(level(probability, ENSEMBLE_BANDS)).alias("confidence"),
                    F.when(seen, "segmenter").otherwise("ensemble").alias("decided_by"))


def witness_status(importable: Column, enabled: Column, score: Column) -> Column:
    """State of an optional cue."""
    return (F.when(~importable, "unavailable").when(~enabled, "disabled").when(score.isNotNull(), "ran").otherwise("abstained"))


def pothole_age(max_curv: Column, p90_curv: Column, sign_changes: Column, contour: Column, crack: Column, area: Column, frame: Column) -> Column:
    """Age score and category from rim sharpness, irregularity, cracking and size."""
    sharp = clip((max_curv * 3.0 + p90_curv * 2.0) / 2.0, 0.0, 1.0)
    irregular = clip(sign_changes / F.when(contour.isNotNull(), F.greatest(contour, F.lit(1.0))) * 5.0, 0.0, 1.0)
    size = clip(area / F.when(frame.isNotNull(), F.greatest(frame * 0.1, F.lit(1.0))), 0.0, 1.0)
    score = clip(0.40 * (1.0 - sharp) + 0.30 * irregular + 0.20 * crack + 0.10 * size, 0.0, 1.0)
    name = F.when(score < 0.25, "Fresh").when(score < 0.50, "Developing").when(score < 0.75, "Established").when(score.isNotNull(), "Chronic")
    return F.struct(name.alias("category"), F.bround(score, 4).alias("score"))


def age_factor(score: Column) -> Column:
    """Older potholes weigh more: 0.5 to 2."""
    return clip(0.5 + score * 1.33, 0.5, 2.0)


def daily_rate(severity: Column, age_score: Column, climate: Column) -> Column:
    return lookup(severity, DAILY_RATE, 0.03) * lookup(climate, CLIMATE, 1.0) * F.coalesce(age_factor(age_score), F.lit(1.0))


def score_after(severity: Column, rate: Column, days: Column) -> Column:
    """Severity score after daily growth rate*(0.5 + score), capped at 1: the recurrence in closed form."""
    start = lookup(severity, SEVERITY_SCORE, 0.495)
    return F.least(F.lit(1.0), (start + 0.5) * F.pow(1.0 + rate, days) - 0.5)


def score_label(score: Column) -> Column:
    return F.when(score < 0.33, "Shallow").when(score < 0.66, "Moderate").when(score.isNotNull(), "Deep")


def forecast_confidence(days: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.2), 1.0 - days / 120.0), 2)


def astm_row(depth: Column) -> Column:
    return F.when(depth <= ASTM_DEPTH_MM[1], 0).when(depth <= ASTM_DEPTH_MM[2], 1).when(depth.isNotNull(), 2)


def astm_grade(depth: Column, diameter: Column) -> Column:
    """(grade, rule, equivalent_count) of the standard's depth x diameter table; null grade below its minimums, all null where a measure is missing."""
    known = depth.isNotNull() & diameter.isNotNull()
    row = astm_row(depth)
    col = F.when(diameter <= ASTM_WIDTH_MM[1], 0).when(diameter <= ASTM_WIDTH_MM[2], 1).otherwise(2)
    table = F.array(*[F.lit(g) for r in ASTM_TABLE for g in r])
    small = (depth < ASTM_DEPTH_MM[0]) | (diameter < ASTM_WIDTH_MM[0])
    wide = diameter > ASTM_WIDTH_MM[-1]
    grade = (F.when(small | ~known, F.lit(None)).when(wide, F.when(depth <= ASTM_DEPTH_MM[1], "M").otherwise("H")).otherwise(F.get(table, row * 3 + col)))
    rule = F.when(~known, F.lit(None)).when(small, "below table").when(wide, "X1.17.1.2").otherwise("Table X1.1")
    many = F.when(known & ~small & wide, F.bround(F.pi() * F.pow(diameter / 2.0, 2) / ASTM_LARGE_UNIT_MM2, 1))
    return F.struct(grade.alias("grade"), rule.alias("rule"), many.alias("equivalent_count"))


def depth_band(depth: Column) -> Column:
    """0 below the standard's minimum, then 1 to 3; null for a missing depth."""
    return F.when(depth < ASTM_DEPTH_MM[0], 0).otherwise(astm_row(depth) + 1)


def min_cost_grade(probs: Column, under: float = 3.0) -> Column:
    """Index of the grade with the least expected cost; a band too mild costs ``under``, too severe 1; first wins."""
    def cost(g):
        terms = F.transform(probs, lambda p, t: p * F.when(t > g, (t - g) * under).otherwise((g - t).cast("double")))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    costs = F.transform(probs, lambda _, g: F.round(cost(g), 9))
    return (F.array_position(costs, F.array_min(costs)) - 1).cast("int")


def response_for(score: Column, route: Column) -> Column:
    """(category, response) of a risk score."""
    category = (F.when(score >= 25, "D1").when(score >= 20, "D2").when(score.isin(15, 16), "D3A").when(score >= 10, "D3").otherwise("Observation"))
    time = (F.when(score >= 25, "2 hours").when(score >= 20, F.when(route == "county", "2 working days").otherwise("5 working days"))
            .when(score >= 10, "90 working days").otherwise("next routine inspection"))
    known = score.isNotNull()
    return F.struct(F.when(known, category).alias("category"), F.when(known, time).alias("response"))


def provisional_consequence(p_level: Column, car_drop: Column) -> Column:
    """1 to 5 from the probability of reaching the investigatory level; +1 when a car wheel drops 40 mm or more."""
    base = 1 + F.bround(4.0 * clip(p_level, 0.0, 1.0)).cast("int")
    return F.when(car_drop >= 40.0, F.least(F.lit(5), base + 1)).otherwise(base)


def hazard_features(depth, deepest, coverage, sharpness, crack, texture, area_share) -> Column:
    """The seven named inputs of the hazard models; unknown stays null, the area share is floored before its log."""
    logged = F.when(area_share.isNotNull(), F.log(F.greatest(area_share, F.lit(1e-6))))
    return F.struct(depth.alias("depth_mm"), deepest.alias("deepest_mm"), coverage.alias("water_coverage"), sharpness.alias("edge_sharpness"),
                    crack.alias("crack_texture"), texture.alias("dinov2_ratio"), logged.alias("log_area_frac"))


def linear_score(features: Mapping[str, Column], model: Mapping) -> Column:
    """Impute medians, standardise and weigh: ``model`` maps each feature to (median, mean, scale, weight)."""
    out = F.lit(0.0)
    for name, col in features.items():
        median, mean, scale, weight = model[name]
        out = out + (F.coalesce(col, F.lit(float(median))) - mean) / scale * weight
    return out


def settle(values: Column, graded: Column) -> Column:
    """Final label when raters agree, or the mean of 1-5 ratings within one point; else null."""
    numbers = F.transform(values, lambda v: v.try_cast("int"))
    close = graded & F.forall(values, lambda v: v.rlike("^[0-9]+$")) & (F.array_max(numbers) - F.array_min(numbers) <= 1)
    mean = F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v) / F.size(numbers)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", mean), "0+$", ""), r"\.$", "")     # six significant digits of a rating below 10
    return F.when(F.size(F.array_distinct(values)) == 1, F.get(values, 0)).when(close, text)


def outline_verdict(area: Column, box_area: Column, long_side: Column) -> Column:
    """Why a box-prompted outline is rejected, or empty when accepted."""
    fill = area / F.greatest(box_area, F.lit(1.0))
    small = area * F.pow(640.0 / long_side, 2)
    return (F.when(area.isNull() | box_area.isNull() | long_side.isNull(), "failed").when(fill > 0.90, "rectangle").when(fill < 0.15, "too_small_in_box").when(small < 100, "tiny").otherwise(""))


def refinement_gate(coarse: Column, refined: Column, both: Column) -> Column:
    """Keep the refined outline only when its area and overlap stay close to the coarse one."""
    iou = both / (coarse + refined - both)
    ratio = refined / coarse
    ok = (refined >= 100) & (coarse > 0) & ratio.between(0.4, 2.5) & (iou >= 0.5)
    return F.when(F.coalesce(ok, F.lit(False)), "refined").otherwise("coarse")
