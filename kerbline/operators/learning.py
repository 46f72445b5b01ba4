"""Models fitted with MLlib: scalers, pseudo labels, classifiers, regressors, ordinal and pairwise fits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.linear import solved
from kerbline.operators.evaluation import poisson_weight, regression_scores
from kerbline.operators.ordered import percentiles
from kerbline.storage import materialise, new_folder

SEED = 20260924
SEED_STEP = 1_000_003                                                                     # between trees: neighbouring seeds start alike
# rows that share their feature values, on average, before fits take them together; fewest rows and most features of such a fit
ROWS_PER_CELL, LEAST_ROWS, MOST_FEATURES = 8, 1_000, 4_096


def scaler_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: exact median for missing values, then mean and deviation of the filled column (0 becomes 1)."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.select(F.explode(items).alias("s")).select("s.feature", "s.v")
    med = percentiles(long, ["feature"], "v", {"median": 0.5})
    filled = long.join(F.broadcast(med), "feature").withColumn("v", F.coalesce("v", "median"))      # one row per feature
    out = filled.groupBy("feature").agg(F.first("median").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))


def standardise(df: DataFrame, table: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Impute and standardise by ``scaler_table`` and assemble a vector in the named order."""
    wide = table.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "mean", "scale").alias("s"))))).scalar()
    df = df.withColumn("_w", wide)
    cols = {f"_z_{f}": (F.coalesce(F.col(f).cast("double"), F.col("_w")[f]["median"]) - F.col("_w")[f]["mean"]) / F.col("_w")[f]["scale"] for f in features}
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df.withColumns(cols).drop("_w")).drop(*cols)


def pseudo_labels(df: DataFrame, vector: str, k: int = 3, gaussian: bool = False) -> tuple[DataFrame, float]:
    """Clusters as ordinal labels, ordered by the length of their centres, with the silhouette that compares settings."""
    model = (GaussianMixture if gaussian else KMeans)(k=k, seed=SEED, featuresCol=vector, predictionCol="cluster").fit(df)
    centres = model.gaussiansDF.collect() if gaussian else model.clusterCenters()
    norm = [float(sum(v * v for v in (c["mean"].toArray() if gaussian else c))) for c in centres]
    order = sorted(range(k), key=lambda i: norm[i])
    out = model.transform(df)
    score = ClusteringEvaluator(featuresCol=vector, predictionCol="cluster").evaluate(out) if out.select("cluster").distinct().count() > 1 else float("nan")
    return out.withColumn("pseudo_label", F.get(F.array(*[F.lit(order.index(i)) for i in range(k)]), F.col("cluster"))), score


def classifiers(features: str, label: str, classes: int, width: int) -> dict:
    """The classifier line-up under their usual names."""
    base = dict(featuresCol=features, labelCol=label)
    return {"logistic": LogisticRegression(maxIter=50, **base), "random_forest": RandomForestClassifier(numTrees=30, maxDepth=6, seed=SEED, **base),
            "boosted": OneVsRest(classifier=GBTClassifier(maxIter=8, maxDepth=3, seed=SEED), **base), "svm": OneVsRest(classifier=LinearSVC(maxIter=20), **base),
            "naive_bayes": NaiveBayes(modelType="gaussian", **base), "mlp": MultilayerPerceptronClassifier(layers=[width, 16, classes], maxIter=50, seed=SEED, **base)}


def soft_vote(df: DataFrame, models: Mapping, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Average the class probabilities of several fitted models; the first of the most probable classes wins."""
    out = df
    for name, model in models.items():
        scored = model.transform(out.drop("rawPrediction", "probability", "prediction"))
        out = scored.withColumn(f"_p_{name}", vector_to_array("probability"))
    out = out.drop("rawPrediction", "probability", "prediction")
    first, *rest = [F.col(f"_p_{n}") for n in models]
    total = first
    for p in rest:
        total = F.zip_with(total, p, lambda a, b: a + b)
    out = out.withColumn("_t", F.transform(total, lambda v: v / len(models)))
    return out.select(*key, *keep, (F.array_position("_t", F.array_max("_t")) - 1).cast("int").alias("prediction"), F.array_max("_t").alias("confidence"))


def regressors(features: str, label: str) -> dict:
    """The regressor line-up: ridge, forest, boosting."""
    base = dict(featuresCol=features, labelCol=label)
    return {"ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0, **base), "forest": RandomForestRegressor(numTrees=10, maxDepth=5, seed=SEED, **base),
            "boosting": GBTRegressor(maxIter=5, maxDepth=3, seed=SEED, **base)}


def ridge_folds(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, alpha: float = 1.0) -> DataFrame:
    """One ridge on standardised features per fold (``by``; several names are repeats and folds), fitted on all rows outside it: by..., n, intercept and coef, in the features' own units.

    The rows are read once: every fold gives its sums of products, a fold's training sums are those of its repeat less its own, and each fit is a small system in closed form. Rows with a null
    feature or label take no part; a feature without spread in the training rows has no weight.
    """
    *repeat, fold = by
    x, k = [F.col(f).cast("double") for f in features], len(features)
    known = df.where(F.forall(F.array(*x, F.col(label).cast("double")), lambda v: v.isNotNull()))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    y = F.col(label).cast("double")
    own = known.groupBy(*by).agg(F.array(F.count(F.lit(1)).cast("double"), F.sum(y), *[F.sum(v) for v in x], *[F.sum(v * y) for v in x], *[F.sum(x[i] * x[j]) for i, j in pairs]).alias("_s"))
    size = 2 + 2 * k + len(pairs)
    total = own.groupBy(*repeat).agg(F.array(*[F.sum(F.get("_s", F.lit(i))) for i in range(size)]).alias("_t"))
    both = (own.join(total, repeat) if repeat else own.withColumn("_t", total.scalar())).select(*by, F.zip_with("_t", "_s", lambda t, s: t - s).alias("_s")).where(F.get("_s", F.lit(0)) > 0)
    at = {**{("x", i): 2 + i for i in range(k)}, **{("xy", i): 2 + k + i for i in range(k)}, **{p: 2 + 2 * k + n for n, p in enumerate(pairs)}}
    s = {key: F.get("_s", F.lit(i)) for key, i in at.items()}
    n, mean_y = F.get("_s", F.lit(0)), F.get("_s", F.lit(1)) / F.get("_s", F.lit(0))
    stats = both.select("*", n.alias("_n"), mean_y.alias("_y"), *[(s["x", i] / n).alias(f"_m{i}") for i in range(k)])
    spread = [F.sqrt(F.greatest(s[i, i] / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{i}"), F.lit(0.0))) for i in range(k)]
    stats = stats.select("*", *[F.when(v > 1e-12 * F.greatest(F.abs(f"_m{i}"), F.lit(1e-300)), v).otherwise(1.0).alias(f"_d{i}") for i, v in enumerate(spread)])
    cross = lambda i, j: (s[min(i, j), max(i, j)] - F.col("_n") * F.col(f"_m{i}") * F.col(f"_m{j}")) / (F.col(f"_d{i}") * F.col(f"_d{j}"))
    rows = [F.array(*[cross(i, j) + (alpha if i == j else 0.0) for j in range(k)], (s["xy", i] - F.col("_n") * F.col(f"_m{i}") * F.col("_y")) / F.col(f"_d{i}")) for i in range(k)]
    fit = stats.withColumn("_w", solved(F.array(*rows), k)).withColumn("coef", F.transform("_w", lambda w, i: w / F.get(F.array(*[F.col(f"_d{j}") for j in range(k)]), i)))
    shift = sum((F.get("coef", F.lit(i)) * F.col(f"_m{i}") for i in range(k)), F.lit(0.0))
    return fit.select(*by, F.col("_n").cast("long").alias("n"), (F.col("_y") - shift).alias("intercept"), "coef")


def ridge_out_of_fold(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, alpha: float = 1.0, out: str = "prediction") -> DataFrame:
    """Rows with the prediction of the ridge that never saw their fold; null where it cannot be made. One row of coefficients per fold is broadcast."""
    fits = ridge_folds(df, by, features, label, alpha).withColumnsRenamed({b: f"_f_{b}" for b in by}).drop("n")
    met = df.join(F.broadcast(fits), [F.col(b).eqNullSafe(F.col(f"_f_{b}")) for b in by], "left")
    value = sum((F.get("coef", F.lit(i)) * F.col(f).cast("double") for i, f in enumerate(features)), F.col("intercept"))
    return met.withColumn(out, value).drop("coef", "intercept", *[f"_f_{b}" for b in by])


def out_of_fold(df: DataFrame, fold: str, k: int, model) -> DataFrame:
    """Predictions of every row by a model that never saw its fold."""
    out = None
    for f in range(k):
        part = model.fit(df.where(F.col(fold) != f)).transform(df.where(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out


def training_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows written once for fits that pass over them many times: plain numbers in small row groups, so that a file split of 128 MB holds some three million rows and a fit's cached form of it stays small."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_cells(model) -> bool:
    """Whether the fit is the same from rows of equal features taken together, by the number, mean and deviation of their labels: squared losses over all rows, and bootstrapped trees, whose draws can be counted."""
    if isinstance(model, LinearRegression):
        return model.getLoss() == "squaredError" and model.getSolver() != "l-bfgs" and not model.isSet("weightCol")
    if not isinstance(model, (GBTRegressor, RandomForestRegressor)) or model.isSet("weightCol") or model.getSubsamplingRate() < 1 or model.getMinInstancesPerNode() > 1:
        return False
    return model.getBootstrap() if isinstance(model, RandomForestRegressor) else model.getLossType() == "squared" and not model.isSet("validationIndicatorCol")


def forest_draws(models: Mapping) -> dict[str, list[str]]:
    """Names of the columns that count the draws of each forest's trees."""
    return {name: [f"_d{i}_{t}" for t in range(m.getNumTrees())] for i, (name, m) in enumerate(models.items()) if isinstance(m, RandomForestRegressor)}


def cells(df: DataFrame, fold: str, models: Mapping, label: str) -> DataFrame:
    """One row per fold and feature values: n, mean and deviation of the label, and for each tree of a forest the rows it draws, a Poisson(1) count of every row by its place in its partition, as MLlib draws, with the sum of their labels."""
    vectors = dict.fromkeys(m.getFeaturesCol() for m in models.values())
    y = F.coalesce(F.col(label).cast("double"), F.lit(float("nan")))                      # a missing label stops the fit, as it does among rows
    draws = {d: F.rand(models[name].getSeed() + SEED_STEP * t) for name, trees in forest_draws(models).items() for t, d in enumerate(trees)}
    drawn = df.select(fold, *[vector_to_array(v).alias(f"_x_{v}") for v in vectors], y.alias("_y"), *[u.alias(d) for d, u in draws.items()]).withColumns({d: poisson_weight(F.col(d)) for d in draws})
    sums = [s for d in draws for s in (F.sum(d).cast("double").alias(d), F.sum(F.col(d) * F.col("_y")).alias(f"{d}_y"))]
    found = drawn.groupBy(fold, *[f"_x_{v}" for v in vectors]).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_y").alias("_m"), F.stddev_pop("_y").alias("_s"), *sums)
    return found.select("*", *[array_to_vector(f"_x_{v}").alias(v, metadata=df.schema[v].metadata) for v in vectors])


def fit_cells(train: DataFrame, model, label: str, draws: Sequence[str] = ()) -> list:
    """The model fitted on ``cells``; a forest as its trees, each on the rows it drew. For a ridge, whose penalty depends on the labels' deviation, a cell is two rows that far from their mean."""
    rows = lambda w, y: train.where(w > 0).select(model.getFeaturesCol(), w.alias("_w"), y.alias(label))
    if isinstance(model, RandomForestRegressor):
        some = model.getFeatureSubsetStrategy()
        one = {model.numTrees: 1, model.bootstrap: False, model.weightCol: "_w", model.featureSubsetStrategy: "onethird" if some == "auto" and model.getNumTrees() > 1 else some}
        return [model.fit(rows(F.col(d), F.col(f"{d}_y") / F.col(d)), one | {model.seed: model.getSeed() + SEED_STEP * t}) for t, d in enumerate(draws)]
    if isinstance(model, LinearRegression):
        return [model.fit(rows(F.col("_n") / 2, F.explode(F.array(F.col("_m") - F.col("_s"), F.col("_m") + F.col("_s")))), {model.weightCol: "_w"})]
    return [model.fit(rows(F.col("_n"), F.col("_m")), {model.weightCol: "_w"})]


def cell_predictions(found: DataFrame, fold: str, k: int, models: Mapping, label: str) -> DataFrame:
    """fold, feature values and a column per model: its prediction for cells of the fold, by a fit that never saw it."""
    out, draws, keys = None, forest_draws(models), [c for c in found.columns if c.startswith("_x_")]
    for f in range(k):
        held, train, means = found.where(F.col(fold) == f), found.where(F.col(fold) != f), []
        for i, (name, m) in enumerate(models.items()):
            fitted = fit_cells(train, m, label, draws.get(name, ()))
            for t, one in enumerate(fitted):
                held = one.setPredictionCol(f"_p{i}_{t}").transform(held)
            means.append((sum((F.col(f"_p{i}_{t}") for t in range(1, len(fitted))), F.col(f"_p{i}_0")) / len(fitted)).alias(f"_p{i}"))
        part = held.select(fold, *keys, *means)
        out = part if out is None else out.unionByName(part)
    return out


def rows_repeat(df: DataFrame, fold: str, k: int, vectors: Sequence[str]) -> bool:
    """Whether feature values come back often enough for ``cells`` to be far fewer than the rows, every fit has enough rows for a tree to draw from, and MLlib solves linear fits of that width by sums of products."""
    x = F.concat(*[vector_to_array(v) for v in vectors])
    rows, kinds, width, least = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(x)), F.max(F.size(x)), F.array_min(F.array(*[F.count_if(F.col(fold) != f) for f in range(k)]))).first()
    return rows >= ROWS_PER_CELL * kinds and least >= LEAST_ROWS and width <= MOST_FEATURES


def compare_models(df: DataFrame, fold: str, k: int, models: Mapping, label: str, clip_max: float = 250.0) -> DataFrame:
    """Out-of-fold scores of each model, predictions clipped to the plausible range.

    Where feature values repeat, models that allow it (``fits_cells``) are fitted on ``cells``, so the rows are read once to count them and once to score all those models, however many passes the
    fits take. Other models, and all where values hardly repeat, are fitted on the rows.
    """
    vectors = list(dict.fromkeys(m.getFeaturesCol() for m in models.values()))
    quick = {name: m for name, m in models.items() if fits_cells(m)}
    if quick and not rows_repeat(df, fold, k, vectors):
        quick = {}
    slow = {name: m for name, m in models.items() if name not in quick}
    df = (training_rows if slow else materialise)(df.select(*dict.fromkeys([fold, label, *vectors])), "compared")
    clipped = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(clip_max))
    scores = {}
    if quick:
        seen = materialise(cells(df, fold, quick, label), "cells")
        told = materialise(cell_predictions(seen, fold, k, quick, label), "cell_predictions")
        keys = [v for v in told.columns if v.startswith("_x_")]
        met = df.select(fold, label, *[vector_to_array(v.removeprefix("_x_")).alias(v) for v in keys]).join(told, [fold, *keys])
        each = met.select(label, F.explode(F.array(*[F.struct(F.lit(name).alias("model"), clipped(F.col(f"_p{i}")).alias("pred")) for i, name in enumerate(quick)])).alias("_r")).select(label, "_r.*")
        s = regression_scores(each, label, "pred", ["model"])
        scores["cells"] = s.select(*[x for x in s.columns if x != "model"], "model")
    for name, m in slow.items():
        scores[name] = regression_scores(out_of_fold(df, fold, k, m).withColumn("pred", clipped(F.col("prediction"))), label, "pred").withColumn("model", F.lit(name))
    return reduce(DataFrame.unionByName, scores.values())


def ordinal_logistic(df: DataFrame, features: str, grade: str, top: int = 5) -> list[tuple[list[float], float]]:
    """Per threshold k: (weights, bias) of P(grade > k); a threshold no grade crosses becomes a constant."""
    shares = df.agg(*[F.avg((F.col(grade) > k).cast("double")).alias(f"s{k}") for k in range(1, top)]).first()
    width = len(df.select(vector_to_array(features)).first()[0])
    out = []
    for k in range(1, top):
        share = shares[f"s{k}"]
        if share in (0.0, 1.0):
            p = min(max(share, 1e-3), 1 - 1e-3)
            out.append(([0.0] * width, math.log(p / (1 - p))))
            continue
        m = LogisticRegression(featuresCol=features, labelCol="_t", maxIter=100).fit(df.withColumn("_t", (F.col(grade) > k).cast("double")))
        out.append((m.coefficients.toArray().tolist(), float(m.intercept)))
    return out


def expected_grade(df: DataFrame, features: str, fits: Sequence[tuple[list[float], float]]) -> DataFrame:
    """1 + sum of P(> k), each chance capped by the one before it."""
    v = vector_to_array(features)
    total, floor = F.lit(1.0), F.lit(1.0)
    for w, b in fits:
        z = F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in w]), lambda a, c: a * c), F.lit(float(b)), lambda s, x: s + x)
        floor = F.least(floor, 1.0 / (1.0 + F.exp(-z)))
        total = total + floor
    return df.withColumn("expected", total).withColumn("grade", F.least(F.greatest(F.floor(F.col("expected") + 0.5), F.lit(1)), F.lit(5)).cast("int"))


def bradley_terry(pairs: DataFrame, pool: DataFrame, key: str, features: Sequence[str], a: str = "pool_a", b: str = "pool_b", answer: str = "label") -> list[float]:
    """Weights of a score whose difference predicts which of two potholes looks worse. A tie counts half each way; both orders enter, so no intercept."""
    ask = F.when(F.col(answer) == "equal", F.array(F.struct(F.lit(1.0).alias("y"), F.lit(0.5).alias("w")), F.struct(F.lit(0.0).alias("y"), F.lit(0.5).alias("w")))).otherwise(
        F.array(F.struct((F.col(answer) == "a").cast("double").alias("y"), F.lit(1.0).alias("w"))))
    rows = pairs.withColumn("_q", F.explode(ask)).select(a, b, "_q.y", "_q.w")
    side = lambda k, p: pool.select(F.col(key).alias(k), *[F.col(f).alias(f"{p}{f}") for f in features])
    j = rows.join(side(a, "a_"), a).join(side(b, "b_"), b)
    flip = j.withColumn("_s", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    d = flip.select(F.when(F.col("_s") > 0, F.col("y")).otherwise(1 - F.col("y")).alias("y"), "w", *[((F.col(f"a_{f}") - F.col(f"b_{f}")) * F.col("_s")).alias(f) for f in features])
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(d)
    return LogisticRegression(labelCol="y", weightCol="w", fitIntercept=False, maxIter=100).fit(data).coefficients.toArray().tolist()


def pair_agreement(pairs: DataFrame, margin: Column, answer: str = "label") -> DataFrame:
    """Share of decided pairs ranked like the raters; a zero margin counts half."""
    hit = F.when(margin == 0, 0.5).otherwise(((margin > 0) == (F.col(answer) == "a")).cast("double"))
    return pairs.where(F.col(answer) != "equal").agg(F.avg(hit).alias("agreement"), F.count(F.lit(1)).alias("decided"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: n / (classes * class size)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    w = sizes.withColumn("weight", total.getField("n") / (total.getField("k") * F.col("_n"))).drop("_n")
    return df.join(F.broadcast(w), label)                                                     # one row per class


def cue_logistic(df: DataFrame, cues: Sequence[str], label: str) -> tuple[dict[str, float], float, dict[str, float]]:
    """Signed coefficients and intercept of a class-balanced logistic on cue scores, and the clipped, normalised weights."""
    data = VectorAssembler(inputCols=list(cues), outputCol="features").transform(balanced_weights(df, label))
    m = LogisticRegression(labelCol=label, weightCol="weight", maxIter=100).fit(data)
    coef = dict(zip(cues, (float(v) for v in m.coefficients)))
    total = sum(max(v, 0.0) for v in coef.values()) or 1.0
    return coef, float(m.intercept), {c: round(max(v, 0.0) / total, 4) for c, v in coef.items()}


def cue_logistic_f1(df: DataFrame, cues: Sequence[str], label: str, fold: str, k: int = 5) -> DataFrame:
    """fold, rows, precision, recall, f1 of a class-balanced logistic on cue scores, each fold scored by a model fitted on the others; the label is 0 or 1, a null cue counts as 0."""
    data = VectorAssembler(inputCols=list(cues), outputCol="features").transform(df.fillna(0.0, subset=list(cues)).withColumn(label, F.col(label).cast("double")))
    parts = None
    for f in range(k):
        model = LogisticRegression(labelCol=label, weightCol="weight", maxIter=100).fit(balanced_weights(data.where(F.col(fold) != f), label))
        part = model.transform(data.where(F.col(fold) == f)).select(fold, F.col(label).alias("_y"), F.col("prediction").alias("_p"))
        parts = part if parts is None else parts.unionByName(part)
    hit = lambda y, p: F.count_if((F.col("_y") == y) & (F.col("_p") == p))
    c = parts.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"), hit(1, 1).alias("_tp"), hit(0, 1).alias("_fp"), hit(1, 0).alias("_fn"))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return c.select(fold, "rows", part(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("precision"), part(F.col("_tp"), F.col("_tp") + F.col("_fn")).alias("recall"),
                    part(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")).alias("f1"))


def learned_selector(df: DataFrame, options: Mapping[str, str], truth: str, features: str) -> DataFrame:
    """One model per option predicts that option's error; the option with the least predicted error is read, skipping missing ones."""
    out, wanted = df, []
    errors = {f"_e_{name}": F.when(F.col(col).isNotNull(), F.struct(F.abs(F.col(col) - F.col(truth)).cast("double").alias("e"))) for name, col in options.items()}
    slim = training_rows(df.select(F.col(features), *[e.alias(n) for n, e in errors.items()]), "option_errors")
    for name, col in options.items():
        known = slim.where(F.col(f"_e_{name}").isNotNull()).select(features, F.col(f"_e_{name}.e").alias("_e"))
        m = GBTRegressor(featuresCol=features, labelCol="_e", predictionCol=f"_e_{name}", maxIter=5, maxDepth=3, seed=SEED).fit(known)
        out = m.transform(out)
        wanted.append(F.when(F.col(col).isNotNull(), F.struct(F.col(f"_e_{name}").alias("e"), F.lit(name).alias("name"), F.col(col).cast("double").alias("value"))))
    best = F.array_min(F.array_compact(F.array(*wanted)))
    return out.withColumn("_b", best).withColumns({"chosen": F.col("_b.name"), "served": F.col("_b.value")}).drop("_b", *[f"_e_{n}" for n in options])


def subset_scores(df: DataFrame, subsets: Mapping[str, Sequence[str]], label: str, test: Column, make) -> list[tuple[str, int, float]]:
    """Ablation: (subset, number of features, accuracy) of one fit per feature subset."""
    rows = []
    for name, cols in subsets.items():
        data = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)
        got = make().fit(data.where(~test)).transform(data.where(test)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        rows.append((name, len(cols), float(got)))
    return rows


def learning_curve(df: DataFrame, draw: Column, shares: Sequence[float], label: str, test: Column, make, features: str = "features") -> list[tuple[float, float]]:
    """(share of the training rows, accuracy) for growing random shares."""
    held = df.where(test)
    return [(s, float(make().fit(df.where(~test & (draw < s))).transform(held).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])) for s in shares]

