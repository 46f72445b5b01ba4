"""Scoring estimators: errors, classes, costs, thresholds, bootstrap intervals and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.hashing import order_key, unit_draw
from kerbline.operators.ordered import hash_cut, percentiles, prefix_sums, value_chunk, value_counts
from kerbline.storage import materialise

# fixed values: cost of a band too mild and too severe; cumulative Poisson(1) probabilities
COST_UNDER, COST_OVER = 3.0, 1.0
POISSON_1 = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998980, 0.99999887)


def one_hot_mean(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).when(cond.isNotNull(), 0.0))


def stack(df: DataFrame, keep: Sequence[str], columns: Mapping[str, Column], name: str = "name", value: str = "value") -> DataFrame:
    """Named columns as rows; null values are dropped."""
    items = F.array(*[F.struct(F.lit(n).alias(name), c.cast("double").alias(value)) for n, c in columns.items()])
    return df.select(*keep, F.explode(items).alias("_s")).select(*keep, f"_s.{name}", f"_s.{value}").where(F.col(value).isNotNull())


def regression_scores(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), within: Sequence[float] = (10, 25)) -> DataFrame:
    """MAE, bias, RMSE, correlation and shares within a distance, per ``by``. Distances hold to nine digits, so an error of exactly the limit counts whatever its last bit."""
    e = F.col(pred) - F.col(truth)
    return df.where(e.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.corr(pred, truth).alias("r"), *[one_hot_mean(F.round(F.abs(e), 9) <= k).alias(f"within{k:g}") for k in within])


def share_within(df: DataFrame, truth: str, plain: str, zoomed: str, within: Sequence[float] = (10, 25), by: Sequence[str] = ()) -> DataFrame:
    """How much a close-up gains: scores of the plain reading and of what is served (the close-up where it applies), over all rows and for those where it applies and where it does not.

    One row per ``by`` and subset: n, and for either reading MAE, bias and the shares within each distance. Rows without truth or plain reading take no part.
    """
    served = F.coalesce(zoomed, plain)
    rows = df.where(F.col(truth).isNotNull() & F.col(plain).isNotNull()).withColumn("subset", F.explode(F.array(F.lit("all"), F.when(F.col(zoomed).isNull(), "no zoom").otherwise("zoom applies"))))
    out = []
    for name, reading in (("plain", F.col(plain)), ("zoomed", served)):
        e = reading - F.col(truth)
        out += [F.avg(F.abs(e)).alias(f"{name}_mae"), F.avg(e).alias(f"{name}_bias"), *[one_hot_mean(F.round(F.abs(e), 9) <= k).alias(f"{name}_within{k:g}") for k in within]]
    return rows.groupBy(*by, "subset").agg(F.count(F.lit(1)).alias("n"), *out)


def classification_scores(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """Binary counts, precision, recall, F1 and accuracy; null where undefined."""
    n = lambda c: F.count_if(c)
    cells = df.groupBy(*by).agg(n(truth & pred).alias("tp"), n(~truth & pred).alias("fp"), n(truth & ~pred).alias("fn"), n(~truth & ~pred).alias("tn"))
    return with_rates(cells)


def with_rates(cells: DataFrame) -> DataFrame:
    """Rates of a table with tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return cells.withColumns({"precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r),
                              "accuracy": (tp + tn) / F.greatest(tp + fp + fn + tn, F.lit(1))})


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of (truth, prediction)."""
    return df.groupBy(*by, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def macro_f1(cells: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro-averaged F1 from confusion counts; a class counts when it occurs on either side."""
    by = list(by)
    rows = cells.groupBy(*by, F.col(truth).alias("_c")).agg(F.sum("n").alias("_t"))
    cols = cells.groupBy(*by, F.col(pred).alias("_c")).agg(F.sum("n").alias("_p"))
    hits = cells.where(F.col(truth) == F.col(pred)).groupBy(*by, F.col(truth).alias("_c")).agg(F.sum("n").alias("_h"))
    j = rows.join(cols, [*by, "_c"], "full").join(hits, [*by, "_c"], "left").fillna(0, ["_t", "_p", "_h"])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("_h"), F.col("_t") + F.col("_p")), F.lit(0.0))
    return j.groupBy(*by).agg((F.sum("_h") / F.sum("_t")).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.sum("_t").alias("n"))


def policy_scores(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Cost per item, accuracy, under-reported or missed, and top-band finds. A null prediction is a miss: it costs
    as band 0 and counts as under-reported. ``n`` weighs rows that were counted before."""
    w = F.col(n) if n else F.lit(1)
    y, p = F.col(truth), F.col(pred)
    seen = F.coalesce(p, F.lit(0))
    cost = F.when(seen < y, COST_UNDER * (y - seen)).otherwise(COST_OVER * (seen - y))
    add = lambda c: F.sum(F.when(c, w).otherwise(0))
    return df.groupBy(*by).agg(
        F.sum(w).alias("n"), (F.sum(cost * w) / F.sum(w)).alias("cost"), (add(p == y) / F.sum(w)).alias("correct"),
        add(F.coalesce(p, F.lit(-1)) < y).alias("under"), add((p == 2) & (y == 2)).alias("deep_found"), add(y == 2).alias("n_deep"))


def band_index(mm: Column, t1, t2) -> Column:
    return F.when(mm < t1, 0).when(mm < t2, 1).when(mm.isNotNull(), 2)


def choose_thresholds(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), step: float = 0.5,
                      first: tuple[float, float] = (5.0, 45.0), gap: float = 5.0, last: float = 70.0) -> DataFrame:
    """Cheapest pair of cut-offs per ``by`` (first wins). Truth is band 0, 1 or 2.

    The cost of a pair is a part that depends on the first cut plus a part that depends on the second, and both
    follow from counts per grid cell. The rows are read once into that small histogram.
    """
    by = list(by)
    cells = (df.where(F.col(pred).isNotNull() & F.col(truth).isNotNull())
             .groupBy(*by, F.col(truth).alias("_y"), F.least(F.greatest(F.floor(F.col(pred) / step), F.lit(0)), F.lit(int(last / step))).alias("_cell"))
             .agg(F.count(F.lit(1)).alias("_n")))
    cost = lambda y, b: COST_UNDER * (y - b) if b < y else COST_OVER * (b - y)
    grade = lambda f: F.element_at(F.array(*[F.lit(float(f(y))) for y in range(3)]), (F.col("_y") + 1).cast("int")) * F.col("_n")
    cells = materialise(cells, "threshold_cells")                               # a few numbers per ``by``
    parts = cells.groupBy(*by, "_cell").agg(
        F.sum(grade(lambda y: cost(y, 0) - cost(y, 1))).alias("_f1"), F.sum(grade(lambda y: cost(y, 1) - cost(y, 2))).alias("_f2"),
        F.sum(grade(lambda y: cost(y, 2))).alias("_base"))
    grid = (cells.select(*by).distinct() if by else cells.agg(F.count(F.lit(1)).alias("_one")).drop("_one"))
    grid = grid.withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(int(last / step)).cast("bigint"))))
    zero = F.lit(0.0)
    w = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    filled = (grid.select(*by, "_cell", zero.alias("_f1"), zero.alias("_f2"), zero.alias("_base")).unionByName(parts)
              .groupBy(*by, "_cell").agg(F.sum("_f1").alias("_f1"), F.sum("_f2").alias("_f2"), F.sum("_base").alias("_base")))
    upto = filled.select(*by, "_cell", F.coalesce(F.sum("_f1").over(w), zero).alias("_g1"), F.coalesce(F.sum("_f2").over(w), zero).alias("_g2"),
                         F.sum("_base").over(Window.partitionBy(*by)).alias("_base"))
    cell = lambda v: int(round(v / step))
    ones = upto.where((F.col("_cell") >= cell(first[0])) & (F.col("_cell") < cell(first[1]))).withColumn(
        "_cell2", F.explode(F.sequence(F.col("_cell") + cell(gap), F.lit(cell(last) - 1).cast("bigint"))))
    twos = upto.select(*by, F.col("_cell").alias("_cell2"), F.col("_g2").alias("_h2"))
    pairs = ones.join(twos, [*by, "_cell2"]).withColumns({
        "_cost": F.round(F.col("_base") + F.col("_g1") + F.col("_h2"), 6), "_t": F.col("_cell") * step, "_t2": F.col("_cell2") * step})
    best = F.min(F.struct(F.col("_cost").alias("cost"), F.col("_t").alias("moderate_from"), F.col("_t2").alias("deep_from"))).alias("b")
    return pairs.groupBy(*by).agg(best).select(*by, "b.moderate_from", "b.deep_from", "b.cost")


def half_flag(df: DataFrame, group: str, seed) -> Column:
    """True for half of the groups (rounded down), in hash order."""
    key = order_key(seed, group)
    groups = materialise(df.groupBy(key.alias("h")).agg(F.max(F.lit(1)).alias("w")), "hash_groups")
    return key <= hash_cut(groups, "h", "w", F.floor(groups.agg(F.count(F.lit(1))).scalar() / 2))


def two_half_crossfit(df: DataFrame, truth: str, pred: str, group: str, seed=20260924) -> DataFrame:
    """Choose cut-offs on one half of the groups, grade the other half with them, and swap."""
    halves = df.withColumn("half", half_flag(df, group, seed))
    cuts = choose_thresholds(halves, truth, pred, ["half"]).withColumn("half", ~F.col("half")).drop("cost")
    return halves.join(F.broadcast(cuts), "half", "left").withColumn("band", band_index(F.col(pred), F.col("moderate_from"), F.col("deep_from")))


def sweep(df: DataFrame, score: str, positive: Column, grid: Sequence[float]) -> DataFrame:
    """Per threshold (grid and every distinct score): positives and negatives below it, at it, and in all."""
    rows = df.where(F.col(score).isNotNull())
    seen = rows.groupBy(F.col(score).alias("t")).agg(F.count_if(positive).alias("pos_at"), F.count_if(~positive).alias("neg_at"))
    none = F.lit(0).cast("bigint")
    marks = df.sparkSession.createDataFrame([(float(g),) for g in grid], "t double").select("t", none.alias("pos_at"), none.alias("neg_at"))
    all_t = seen.unionByName(marks).groupBy("t").agg(F.sum("pos_at").alias("pos_at"), F.sum("neg_at").alias("neg_at"))
    chunked = value_chunk(all_t, "t", rows, score, "_c")
    below = prefix_sums(chunked, [], ["t"], F.col("_c"), {"pos_below": F.col("pos_at"), "neg_below": F.col("neg_at")}).drop("_c")
    totals = rows.agg(F.struct(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))).scalar()
    return below.withColumns({"positives": totals.getField("p"), "negatives": totals.getField("n")})


def below_threshold_rates(swept: DataFrame, fp_cost: float = 3.0) -> DataFrame:
    """Predict positive when the score is below t: counts, rates and cost per threshold."""
    tp, fp = F.col("pos_below"), F.col("neg_below")
    fn, tn = F.col("positives") - tp, F.col("negatives") - fp
    return swept.select("t", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
                        F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
                        F.coalesce(F.try_divide(fp, fp + tn), F.lit(0.0)).alias("fpr"), (fp * fp_cost + fn).alias("cost"), "pos_at", "neg_at")


def sweep_auc(swept: DataFrame) -> DataFrame:
    """Area under the swept curve by the trapezoid rule. A step leaves t with what lies at t, so no neighbour is needed."""
    last = swept.agg(F.max("t")).scalar()
    step = F.col("neg_at") * (F.col("pos_below") + F.col("pos_at") / 2.0)
    return swept.where(F.col("t") < last).agg((F.sum(step) / F.max(F.col("positives") * F.col("negatives"))).alias("auc"))


def operating_point(rates: DataFrame) -> DataFrame:
    """Cheapest threshold; more recall, then the lower threshold, breaks ties."""
    return rates.agg(F.min_by(F.struct("t", "tp", "fp", "precision", "recall", "cost"), F.struct("cost", -F.col("recall"), "t")).alias("b")).select("b.*")


def trusted(rates: DataFrame, auc: DataFrame, minimum: int = 15) -> DataFrame:
    """Whether a fit may be used: enough examples of both kinds and an AUC of at least 0.6."""
    row = rates.agg(F.max(F.col("tp") + F.col("fn")).alias("positives"), F.max(F.col("fp") + F.col("tn")).alias("negatives"))
    return row.withColumn("auc", auc.select("auc").scalar()).withColumn(
        "trusted", (F.col("positives") >= minimum) & (F.col("negatives") >= minimum) & (F.col("auc") >= 0.6))


def best_f1(swept: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Threshold of the grid with the best F1 when positive means score > t; the first wins."""
    above = lambda s: F.col(f"{'positives' if s == 'pos' else 'negatives'}") - F.col(f"{s}_below") - F.col(f"{s}_at")
    tp, fp = above("pos"), above("neg")
    cells = swept.where(F.col("t").isin([float(g) for g in grid])).select(
        "t", tp.alias("tp"), fp.alias("fp"), (F.col("positives") - tp).alias("fn"), (F.col("negatives") - fp).alias("tn"))
    rated = with_rates(cells).where(F.col("f1").isNotNull())
    return rated.agg(F.min_by(F.struct("t", "tp", "fp", "fn", "tn", "f1"), F.struct(-F.col("f1"), "t")).alias("b")).select("b.*")


def poisson_weight(draw: Column) -> Column:
    """How often an item is drawn in one resample, from a uniform draw."""
    out = None
    for k, edge in enumerate(POISSON_1):
        out = F.when(draw < edge, k) if out is None else out.when(draw < edge, k)
    return out.otherwise(len(POISSON_1))


def resamples(df: DataFrame, key: Sequence[str], replicates: int, seed) -> DataFrame:
    """Rows repeated over replicates with a ``weight``. Each item draws its own Poisson(1) count, the distributed form
    of resampling n items with replacement: rows are never numbered, joined or shuffled."""
    out = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return out.withColumn("weight", poisson_weight(unit_draw(order_key(seed, "replicate", *key)))).where("weight > 0")


def bootstrap_mean(df: DataFrame, key: Sequence[str], value: Column, replicates: int, seed) -> DataFrame:
    """Mean (of a paired difference, a hit or a cost) with its 95% interval."""
    per = (resamples(df.withColumn("_x", value), key, replicates, seed).groupBy("replicate")
           .agg((F.sum(F.col("_x") * F.col("weight")) / F.sum("weight")).alias("m")))
    point = df.agg(F.avg(value)).scalar()
    return per.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).withColumn("mean", point)


def bootstrap_median(df: DataFrame, key: Sequence[str], value: str, replicates: int, seed) -> DataFrame:
    """Median with its 95% interval."""
    df = materialise(df.where(F.col(value).isNotNull()).select(*key, value), "bootstrap")
    drawn = resamples(df, key, replicates, seed)
    per = percentiles(drawn, ["replicate"], value, {"m": 0.5}, weight="weight")
    point = percentiles(df, [], value, {"median": 0.5}).select("median").scalar()
    return per.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).withColumn("median", point)


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Correlation of x and y, raw and after removing z linearly from both: closed form of three correlations."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    r = ok.agg(F.corr(x, y).alias("raw"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    return r.select("raw", ((F.col("raw") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("partial"))


def corr_matrix(df: DataFrame, columns: Sequence[str], flag: float = 0.9) -> DataFrame:
    """Correlation of every pair of columns in one pass, and whether it exceeds ``flag``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(items).alias("p")).select("p.a", "p.b", "p.r", (F.abs("p.r") > flag).alias("redundant"))


def ratio_summary(df: DataFrame, pred: str, truth: str, by: Sequence[str]) -> DataFrame:
    """Per camera and over all: median ratio with its 10th and 90th percentile and shares within 25% and 50%."""
    by = list(by)
    r = df.withColumn("_r", F.col(pred) / F.col(truth)).where(F.col("_r").isNotNull())
    both = r.select(*by, "_r").unionByName(r.select(*[F.lit("ALL").alias(b) for b in by], "_r"))
    shares = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), one_hot_mean(F.abs(F.col("_r") - 1) <= 0.25).alias("within25"),
                                   one_hot_mean(F.abs(F.col("_r") - 1) <= 0.5).alias("within50"))
    return percentiles(both, by, "_r", {"median": 0.5, "p10": 0.1, "p90": 0.9}).join(shares, by)


def leave_one_group_out(df: DataFrame, group: str, pred: str, truth: str) -> DataFrame:
    """Per group: the median pred/truth ratio of all *other* groups, the correction that group may use.

    Ratios are counted per group first; only those counts are handed to the other groups.
    """
    ratio = df.withColumn("_r", F.col(pred) / F.col(truth)).where(F.col("_r").isNotNull())
    counts = ratio.groupBy(group, "_r").agg(F.count(F.lit(1)).alias("_w"))
    names = df.agg(F.sort_array(F.collect_set(group))).scalar()
    spread = (counts.withColumn("_all", names).select(F.explode(F.filter("_all", lambda g: g != F.col(group))).alias("_g"), "_r", "_w"))
    return percentiles(spread.withColumnRenamed("_g", group), [group], "_r", {"correction": 0.5}, weight="_w")


def similarity(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Correlation, MSE and global SSIM of two maps after each is scaled to 0-1 within its frame."""
    by = list(by)
    lim = df.groupBy(*by).agg(F.min(a).alias("_a0"), F.max(a).alias("_a1"), F.min(b).alias("_b0"), F.max(b).alias("_b1"))
    unit = lambda v, lo, hi: F.coalesce(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))
    s = df.join(lim, by).withColumns({"_x": unit(a, "_a0", "_a1"), "_y": unit(b, "_b0", "_b1")})
    m = s.groupBy(*by).agg(F.coalesce(F.nanvl(F.corr("_x", "_y"), F.lit(0.0)), F.lit(0.0)).alias("correlation"), F.avg((F.col("_x") - F.col("_y")) ** 2).alias("mse"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"),
                           F.var_pop("_x").alias("_vx"), F.var_pop("_y").alias("_vy"), F.covar_pop("_x", "_y").alias("_c"))
    c1, c2 = 0.01 ** 2, 0.03 ** 2
    ssim = ((2 * F.col("_mx") * F.col("_my") + c1) * (2 * F.col("_c") + c2)) / ((F.col("_mx") ** 2 + F.col("_my") ** 2 + c1) * (F.col("_vx") + F.col("_vy") + c2))
    return m.select(*by, "correlation", "mse", ssim.alias("ssim"))


def calibration_curve(df: DataFrame, prob: str, truth: Column, bins: int = 10) -> DataFrame:
    """Mean prediction and observed share per equal-width bin."""
    slot = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(slot).agg(F.avg(prob).alias("predicted"), one_hot_mean(truth).alias("observed"), F.count(F.lit(1)).alias("n"))


def baseline_predictors(df: DataFrame, train: Column, truth: str, area: str, label: str) -> DataFrame:
    """What any model must beat: the training median, the commonest class and a line on log area."""
    t = df.where(train)
    line = t.withColumn("_x", F.log(area)).agg(F.regr_slope(truth, "_x").alias("slope"), F.regr_intercept(truth, "_x").alias("intercept"))
    common = t.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min_by(label, F.struct(-F.col("_n"), label)))
    return line.withColumns({"median": percentiles(t, [], truth, {"m": 0.5}).select("m").scalar(), "majority": common.scalar()})


def robustness(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per condition and classifier, in percent: same prediction as before, accuracy before and after, and the drop."""
    pct = lambda x: F.avg(x) * 100
    return df.groupBy(*by).agg(pct("prediction_consistent").alias("consistency"), pct("original_correct").alias("orig_acc"), pct("adverse_correct").alias("adv_acc")).withColumn(
        "drop", F.col("orig_acc") - F.col("adv_acc"))


def threshold_ablation(df: DataFrame, positive: Column, configs: Sequence[tuple[str, str, float, int]], patches: str) -> DataFrame:
    """One row per configuration (name, ratio column, threshold, least patches). Rows without a usable ratio abstain."""
    items = F.array(*[F.struct(F.lit(n).alias("config"), F.col(r).cast("double").alias("ratio"), F.lit(float(th)).alias("cut"), F.lit(k).alias("need")) for n, r, th, k in configs])
    rows = df.withColumn("_pos", positive).select("_pos", F.col(patches).alias("_n"), F.explode(items).alias("c")).select("_pos", "_n", "c.*")
    out = F.col("ratio").isNull() | F.isnan("ratio") | ((F.col("need") > 0) & (F.col("_n") < F.col("need")))
    fire, p = F.col("ratio") < F.col("cut"), F.col("_pos")
    n = lambda c: F.count_if(~out & c)
    cells = rows.groupBy("config").agg(n(fire & p).alias("tp"), n(fire & ~p).alias("fp"), n(~fire & p).alias("fn"), n(~fire & ~p).alias("tn"), F.count_if(out).alias("abstain"))
    return with_rates(cells).drop("accuracy")


def fold_summary(scores: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of every metric over the folds."""
    s = stack(scores, by, {m: F.col(m) for m in metrics}, "metric", "value")
    return s.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def quantile_table(df: DataFrame, by: Sequence[str], value: str, points: int = 101) -> DataFrame:
    """Inverse distribution function: evenly spaced quantiles of ``value`` as rows (p, q).

    A distinct value covers the ranks [below, below + n), and from those follow the quantile numbers it bounds.
    """
    by = list(by)
    ranks = value_counts(df, by, value)
    total = ranks.groupBy(*by).agg(F.sum("n").alias("_N"))
    rows = ranks.join(total, by) if by else ranks.withColumn("_N", total.select("_N").scalar())
    k, first, end = F.lit(points - 1), F.col("below"), F.col("below") + F.col("n")
    span = F.greatest(F.col("_N") - 1, F.lit(1))
    div = lambda a, b: F.floor(a / b).cast("int")
    up = lambda a, b: F.ceil(a / b).cast("int")
    some = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, F.least(hi, k))).otherwise(F.array().cast("array<int>"))
    low = some(up(first * k, span), up(end * k, span) - 1)
    high = some(F.greatest(div((first - 1) * k, span) + 1, F.lit(0)), div((end - 1) * k, span))
    tag = lambda ids, side: F.transform(ids, lambda i: F.struct(i.alias("p"), F.lit(side).alias("side")))
    marks = rows.select(*by, F.col(value).cast("double").alias("_v"), "_N", F.explode(F.concat(tag(low, "lo"), tag(high, "hi"))).alias("m"))
    side = lambda s: F.max(F.when(F.col("m.side") == s, F.col("_v"))).alias(f"_{s}")
    found = marks.groupBy(*by, F.col("m.p").alias("p")).agg(side("lo"), side("hi"), F.max("_N").alias("_N"))
    at = (F.col("_N") - 1) * F.col("p") / k
    return found.select(*by, "p", (F.col("_lo") + (at - F.floor(at)) * (F.col("_hi") - F.col("_lo"))).alias("q"))


def inspect_source(df: DataFrame, by: Sequence[str], value: str, noise: str, limit: float) -> DataFrame:
    """Per source: depth p10/p50/p90, noise median and p90, band histogram and how many exceed a limit."""
    by = list(by)
    v = F.col(value)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(v < 25).alias("shallow"), F.count_if((v >= 25) & (v < 50)).alias("moderate"),
                                 F.count_if(v >= 50).alias("deep"), F.count_if(v > limit).alias("over_limit"))
    depth = percentiles(df, by, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    floor = percentiles(df, by, noise, {"noise_median": 0.5, "noise_p90": 0.9})
    return counts.join(depth, by).join(floor, by)
