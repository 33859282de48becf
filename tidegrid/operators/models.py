"""Linear and tree models over walk-forward folds, probability calibration, and comparisons of models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import classification, regression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.frames import average_rank, ratio

#: Model features, label horizon, fold sizes, penalties, calibration limits.
FEATURES = ("ret_21d", "mom_12_1", "vol_63d", "dist_sma_200", "macd_hist_pct", "adv_eur_21", "volume_z_63", "beta_252", "mom_resid_12_1_sec", "rev_5d_sec")
HORIZON, TEST, MIN_TRAIN, FILL = 21, 63, 200, 0.5
RIDGE_ALPHA, LOGIT_C, PLATT_C, SLICE, BINS, ECE_LIMIT, GAP_LIMIT, PROB_CLIP = 1.0, 1.0, 1e6, 0.4, 10, 0.02, 0.05, 1e-6


def build_frame(panel: DataFrame, labels: DataFrame, features: list[str], target: str, fill: float = FILL) -> DataFrame:
    """Panel rows with any feature, others filled, and their target."""
    some = panel.where(F.coalesce(*[F.col(f) for f in features]).isNotNull())
    out = some.select("date", "ticker", *[F.coalesce(f, F.lit(fill)).alias(f) for f in features])
    return out.join(labels.select("date", "ticker", F.col(target).alias("target")), ["date", "ticker"], "left")


# ---- ridge from per-date sums -----------------------------------------------------------------


def gram_by_date(frame: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """For each date the sums of all products of (1, features, target): every fold's training matrix is a sum of these,
    so one scan serves all folds."""
    cols = [F.lit(1.0), *[F.col(f) for f in features], F.col(target)]
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return frame.where(F.col(target).isNotNull()).groupBy("date").agg(*sums)


def ridge_from_gram(row, k: int, alpha: float = RIDGE_ALPHA) -> tuple[float, np.ndarray]:
    """(intercept, coefficients); the intercept is not penalised."""
    g = np.zeros((k + 2, k + 2))
    for i in range(k + 2):
        for j in range(i, k + 2):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    centred = g[1:, 1:] - n * np.outer(mean, mean)
    coef = np.linalg.solve(centred[:k, :k] + alpha * np.eye(k), centred[:k, k])
    return float(mean[k] - mean[:k] @ coef), coef


def ridge_walk_forward(frame: DataFrame, folds: DataFrame, features: list[str], alpha: float = RIDGE_ALPHA) -> tuple[DataFrame, DataFrame]:
    """(predictions(fold, date, ticker, score), coefficients(fold, feature, value)).

    The folds' sums come to the driver: folds x products of features numbers, whatever the rows.
    """
    spark, k = frame.sparkSession, len(features)
    grams = gram_by_date(frame, features)
    names = [c for c in grams.columns if c != "date"]
    per_fold = folds.where("role = 'train'").join(grams, "date").groupBy("fold").agg(*[F.sum(c).alias(c) for c in names]).collect()
    fits = [(r.fold, *ridge_from_gram(r, k, alpha)) for r in per_fold]
    table = spark.createDataFrame([(f, b, [float(x) for x in w]) for f, b, w in fits], "fold int, intercept double, weights array<double>")
    tests = folds.where("role = 'test'").select("fold", "date")
    met = frame.join(F.broadcast(tests), "date").join(F.broadcast(table), "fold")
    score = reduce(lambda a, b: a + b, [F.get("weights", F.lit(i)) * F.col(f) for i, f in enumerate(features)], F.col("intercept"))
    coefs = spark.createDataFrame([(f, x, float(v)) for f, _, w in fits for x, v in zip(features, w, strict=True)], "fold int, feature string, value double")
    return met.select("fold", "date", "ticker", score.alias("score"), "target"), coefs


# ---- fitted models ----------------------------------------------------------------------------


class Model:
    """A named estimator over a fixed list of columns; predicts under the same list only."""

    def __init__(self, name: str, estimator, features: list[str], probability: bool = False):
        self.name, self.estimator, self.features, self.probability, self.fitted = name, estimator, list(features), probability, None

    def _vectors(self, df: DataFrame) -> DataFrame:
        if missing := [f for f in self.features if f not in df.columns]:
            raise ValueError(f"{self.name} needs {missing}")
        return VectorAssembler(inputCols=self.features, outputCol="_x").transform(df)

    def fit(self, df: DataFrame) -> "Model":
        if self.probability and df.where("target is not null and target not in (0, 1)").limit(1).count():
            raise ValueError("a classifier's target is 0 or 1")
        train = self._vectors(df.where("target is not null"))
        self.fitted = self.estimator(train.count()).fit(train)
        return self

    def predict(self, df: DataFrame, column: str = "score") -> DataFrame:
        out = self.fitted.transform(self._vectors(df))
        score = vector_to_array("probability")[1] if self.probability else F.col("prediction")
        return out.select(*df.columns, score.alias(column))


#: The registry: a name to a model over some features. Tree models play the part of leaf-wise boosting here and
#: do not give its numbers.
MODELS = {
    "ridge": lambda f, alpha=RIDGE_ALPHA: Model("ridge", lambda n: regression.LinearRegression(featuresCol="_x", labelCol="target", elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha / n), f),
    "gbt": lambda f, trees=50, depth=4, rate=0.05, seed=39: Model("gbt", lambda n: regression.GBTRegressor(featuresCol="_x", labelCol="target", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed), f),
    "logit": lambda f, c=LOGIT_C: Model("logit", lambda n: classification.LogisticRegression(featuresCol="_x", labelCol="target", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200), f, True),
    "gbt_clf": lambda f, trees=50, depth=4, rate=0.05, seed=39: Model("gbt_clf", lambda n: classification.GBTClassifier(featuresCol="_x", labelCol="target", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed), f, True),
}


def model(name: str, features: list[str], **params) -> Model:
    if name not in MODELS:
        raise KeyError(f"no model {name}; there are {sorted(MODELS)}")
    return MODELS[name](features, **params)


def registry() -> list[tuple[str, str]]:
    """(name, what it predicts) of each model, by name."""
    return [(n, "probability" if MODELS[n](["x"]).probability else "score") for n in sorted(MODELS)]


def walk_forward(frame: DataFrame, folds: DataFrame, name: str, features: list[str], **params) -> DataFrame:
    """(fold, date, ticker, score, target): one fit for each fold, which is the unit of work here."""
    out = None
    for k in sorted(r.fold for r in folds.select("fold").distinct().collect()):
        pick = lambda role, k=k: frame.join(F.broadcast(folds.where((F.col("fold") == k) & (F.col("role") == role)).select("date")), "date", "left_semi")
        part = model(name, features, **params).fit(pick("train")).predict(pick("test")).select(F.lit(k).alias("fold"), "date", "ticker", "score", "target")
        out = part if out is None else out.unionByName(part)
    return out


# ---- calibration ------------------------------------------------------------------------------


def clipped_logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - PROB_CLIP)), F.lit(PROB_CLIP))
    return F.ln(q / (1 - q))


def platt(df: DataFrame, prob: str, target: str = "target", rounds: int = 25) -> tuple[float, float]:
    """Slope and level of a logistic fit to the logit, by Newton steps of one aggregation each, hardly penalised."""
    a, b = 1.0, 0.0
    z = clipped_logit(F.col(prob))
    slim = df.where(F.col(prob).isNotNull() & F.col(target).isNotNull()).select(z.alias("z"), F.col(target).cast("double").alias("y"))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(a * F.col("z") + b)))
        w, e = p * (1 - p), F.col("y") - p
        r = slim.agg(F.sum(e * F.col("z")).alias("ga"), F.sum(e).alias("gb"), F.sum(w * F.col("z") * F.col("z")).alias("aa"), F.sum(w * F.col("z")).alias("ab"), F.sum(w).alias("bb")).first()
        if r.ga is None:
            return 1.0, 0.0
        h = np.array([[r.aa + 1 / PLATT_C, r.ab], [r.ab, r.bb + 1e-12]])
        da, db = np.linalg.solve(h, [r.ga - a / PLATT_C, r.gb])
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-12:
            break
    return float(a), float(b)


def calibrate(fit_on: DataFrame, apply_to: DataFrame, kind: str, prob: str = "score") -> DataFrame:
    """apply_to with `prob_<kind>`: isotonic, platt or none, fitted on other rows with their target."""
    if kind == "none":
        return apply_to.withColumn("prob_none", F.col(prob))
    if kind == "platt":
        a, b = platt(fit_on, prob)
        return apply_to.withColumn("prob_platt", 1 / (1 + F.exp(-(a * clipped_logit(F.col(prob)) + b))))
    if kind != "isotonic":
        raise ValueError(f"no calibration {kind}")
    iso = regression.IsotonicRegression(featuresCol=prob, labelCol="target").fit(fit_on.where(F.col(prob).isNotNull() & F.col("target").isNotNull()).select(prob, F.col("target").cast("double")))
    return iso.transform(apply_to).withColumnRenamed("prediction", "prob_isotonic")


def calibration_split(train: list, ends: dict, share: float = SLICE) -> tuple[list, list]:
    """(fit dates, slice dates): the last share of the training dates, and earlier ones whose label ends before it."""
    n = round(share * len(train))
    late = train[len(train) - n :]
    return [d for d in train[: len(train) - n] if ends[d] < late[0]] if late else list(train), late


def calibrated_walk_forward(frame: DataFrame, fold_dates: list, ends: dict, name: str, features: list[str], kinds=("isotonic", "platt", "none"), **params) -> DataFrame:
    """(fold, date, ticker, raw, prob_<kind>..., target): fit before the slice, calibrate on it, predict the test."""
    out = None
    for k, train, test in fold_dates:
        early, late = calibration_split(train, ends)
        m = model(name, features, **params).fit(frame.where(F.col("date").isin(early)))
        fit_on, part = m.predict(frame.where(F.col("date").isin(late))), m.predict(frame.where(F.col("date").isin(test)))
        for kind in kinds:
            part = calibrate(fit_on, part, kind)
        part = part.select(F.lit(k).alias("fold"), "date", "ticker", F.col("score").alias("raw"), *[f"prob_{x}" for x in kinds], "target")
        out = part if out is None else out.unionByName(part)
    return out


def reliability(df: DataFrame, prob: str, target: str = "target", bins: int = BINS) -> DataFrame:
    """(bin, n, mean_p, observed, gap, margin): bins of equal count by min-rank, ties together."""
    known = df.where(F.col(prob).isNotNull() & F.col(target).isNotNull()).select(F.col(prob).alias("p"), F.col(target).cast("double").alias("y"))
    # ranks from counts of equal values: no global sort of rows in one task
    sizes = known.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    ranked = sizes.withColumn("r", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    edges = ranked.agg(F.percentile("r", F.array(*[F.lit(k / bins) for k in range(1, bins)]), F.col("n")).alias("e"))
    binned = ranked.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda e: e < F.col("r"))))  # edges: one row
    out = binned.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_p"), (F.sum("y") / F.sum("n")).alias("observed"))
    se = F.sqrt(F.col("observed") * (1 - F.col("observed")) / F.col("n"))
    return out.select("bin", "n", "mean_p", "observed", (F.col("observed") - F.col("mean_p")).alias("gap"), (1.96 * se).alias("margin"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"), F.max(F.abs("gap")).alias("worst"))


def probability_scores(df: DataFrame, prob: str, target: str = "target", by: list[str] | None = None) -> DataFrame:
    """(by..., n, base, brier, skill, log_loss, auc, p05, p95); AUC from average ranks."""
    by = by or []
    known = df.where(F.col(prob).isNotNull() & F.col(target).isNotNull()).select(*by, F.col(prob).alias("p"), F.col(target).cast("double").alias("y"))
    rank, _ = average_rank(F.col("p"), by or [F.lit(1)])
    q = F.greatest(F.least("p", F.lit(1 - PROB_CLIP)), F.lit(PROB_CLIP))
    brier, base = F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), F.avg("y")
    ones = F.sum("y")
    zeros = F.count("*") - ones
    return known.withColumn("r", rank).groupBy(*by).agg(
        F.count("*").alias("n"), base.alias("base"), brier.alias("brier"), (1 - ratio(brier, base * (1 - base))).alias("skill"),
        F.avg(-(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))).alias("log_loss"),
        ratio(F.sum(F.col("r") * F.col("y")) - ones * (ones + 1) / 2, ones * zeros).alias("auc"), F.percentile("p", F.lit(0.05)).alias("p05"), F.percentile("p", F.lit(0.95)).alias("p95"),
    )


def calibration_check(bins: DataFrame, ece_limit: float = ECE_LIMIT, gap_limit: float = GAP_LIMIT) -> DataFrame:
    e = expected_calibration_error(bins)
    return e.select("ece", "worst", ((F.col("ece") <= ece_limit) & (F.col("worst") <= gap_limit)).alias("calibrated"))


# ---- tables over folds and models -------------------------------------------------------------


def coefficient_table(coefs: DataFrame) -> DataFrame:
    return coefs.groupBy("feature").agg(F.avg("value").alias("mean"), F.max_by("value", "fold").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg((F.col("value") > 0).cast("double")).alias("positive"))


def ic_summary(ic: DataFrame, horizon: int = HORIZON, by: list[str] | None = None) -> DataFrame:
    """(by..., n, mean, std, share_positive, t): over all dates, or for each fold or year; t over the root of the
    horizon, as labels overlap."""
    m, s = F.avg("ic"), F.stddev_samp("ic")
    n = F.count("ic")
    return ic.groupBy(*(by or [])).agg(n.alias("n"), m.alias("mean"), s.alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("share_positive"), (ratio(m, s) * F.sqrt(n) / F.sqrt(F.lit(float(horizon)))).alias("t"))


def fairness(a: DataFrame, b: DataFrame) -> DataFrame:
    """(check, passed): what makes two prediction tables (fold, date, ticker, score, target) comparable.

    rows, folds, targets: both have the same (date, ticker), (fold, date) and (date, ticker, target). axis, span,
    names: the same dates, first and last date, and tickers. unique: no key twice in either. scores: none is
    missing or not finite. coverage: as many rows on each date. order: in either, later folds have later dates."""
    checks = []
    for name, cols in (("rows", ["date", "ticker"]), ("folds", ["fold", "date"]), ("targets", ["date", "ticker", "target"]), ("axis", ["date"]), ("names", ["ticker"])):
        x, y = a.select(*cols).distinct(), b.select(*cols).distinct()
        both = x.withColumn("_s", F.lit(1)).unionByName(y.withColumn("_s", F.lit(2))).groupBy(*cols).agg(F.sum("_s").alias("_s"))
        checks.append(both.agg(F.lit(name).alias("check"), (F.count_if(F.col("_s") != 3) == 0).alias("passed")))
    cols = ["fold", "date", "ticker", "score"]
    two = a.select(F.lit(1).alias("_s"), *cols).unionByName(b.select(F.lit(2).alias("_s"), *cols))
    keys = two.groupBy("_s", "date", "ticker").count()
    checks.append(keys.agg(F.lit("unique").alias("check"), (F.max("count") <= 1).alias("passed")))
    sound = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    checks.append(two.agg(F.lit("scores").alias("check"), (F.count_if(~sound) == 0).alias("passed")))
    ends = two.groupBy("_s").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    checks.append(ends.agg(F.lit("span").alias("check"), ((F.min("lo") == F.max("lo")) & (F.min("hi") == F.max("hi"))).alias("passed")))
    per_date = two.groupBy("date").agg(F.count_if(F.col("_s") == 1).alias("x"), F.count_if(F.col("_s") == 2).alias("y"))
    checks.append(per_date.agg(F.lit("coverage").alias("check"), (F.count_if(F.col("x") != F.col("y")) == 0).alias("passed")))
    spans = two.groupBy("_s", "fold").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    before = spans.withColumn("_p", F.lag("hi").over(Window.partitionBy("_s").orderBy("fold")))
    checks.append(before.agg(F.lit("order").alias("check"), (F.count_if(F.col("lo") <= F.col("_p")) == 0).alias("passed")))
    return reduce(DataFrame.unionByName, checks)


# ---- feature hygiene --------------------------------------------------------------------------


def nan_coverage(panel: DataFrame, features: list[str]) -> DataFrame:
    """(feature, year, share): share of rows with a value."""
    long = panel.select(F.year("date").alias("year"), *features).unpivot(["year"], features, "feature", "x")
    return long.groupBy("feature", "year").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("share"))


def rank_correlation(ranks: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, corr, n): pooled correlation of per-date ranks for each pair, on rows that have both. One aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    if not pairs:
        return ranks.sparkSession.createDataFrame([], "a string, b string, corr double, n long")
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = lambda a, b: F.when(both(a, b), F.col(a))
    corr = lambda a, b: ratio(F.covar_pop(a, b), F.stddev_pop(one(a, b)) * F.stddev_pop(one(b, a)))
    row = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(a, b).alias("corr"), F.count_if(both(a, b)).alias("n")) for a, b in pairs])
    return ranks.agg(row.alias("r")).select(F.inline("r"))


def correlation_prune(corr: DataFrame, features: list[str], threshold: float = 0.95) -> list[tuple[str, str | None]]:
    """Greedy walk in order: (feature, the kept one it repeats or None). As many numbers as pairs of features."""
    high = {frozenset((r.a, r.b)) for r in corr.where(F.abs("corr") > threshold).collect()}
    kept, out = [], []
    for f in features:
        twin = next((k for k in kept if frozenset((k, f)) in high), None)
        out.append((f, twin))
        if twin is None:
            kept.append(f)
    return out


def explained_share(ranks: DataFrame, features: list[str]) -> list[tuple[str, float]]:
    """R2 of each column on the others over complete rows, from sums of products made in one aggregation."""
    full = ranks.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features]))
    cols = [F.lit(1.0), *[F.col(f) for f in features]]
    k = len(cols)
    r = full.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    c = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / max(g[0, 0], 1.0)
    out = []
    for i, f in enumerate(features):
        rest = [j for j in range(k - 1) if j != i]
        fit = np.linalg.lstsq(c[np.ix_(rest, rest)], c[rest, i], rcond=None)[0]
        out.append((f, float(fit @ c[rest, i] / c[i, i]) if c[i, i] > 0 else 0.0))
    return out


def check_selection(selection: list[dict], features: list[str], corr: DataFrame, threshold: float = 0.95) -> list[str]:
    """What a selection (name, use: model | filter | drop, why) breaks: every column once, a reason for each, and no
    two model columns that repeat each other."""
    out = []
    names = [s["name"] for s in selection]
    out += [f"{f}: not decided" for f in features if f not in names]
    out += [f"{n}: {names.count(n)} times" for n in dict.fromkeys(names) if names.count(n) > 1]
    out += [f"{s['name']}: use {s.get('use')!r}" for s in selection if s.get("use") not in ("model", "filter", "drop")]
    out += [f"{s['name']}: no reason" for s in selection if not s.get("why")]
    used = {s["name"] for s in selection if s.get("use") == "model"}
    out += [f"{r.a} and {r.b}: correlation {r.corr:.3f}" for r in corr.where(F.abs("corr") > threshold).orderBy("a", "b").collect() if r.a in used and r.b in used]
    return out


def score_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(date, ic, n): rank correlation per date of two models' scores."""
    from tidegrid.operators.labels import information_coefficient

    both = a.select("date", "ticker", F.col("score").alias("a")).join(b.select("date", "ticker", F.col("score").alias("b")), ["date", "ticker"])
    return information_coefficient(both, "a", "b")


def head_to_head(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(date, overlap, ic): how alike two models' scores are on each date."""
    from tidegrid.operators.labels import top_overlap

    return top_overlap(a, b, k).join(score_correlation(a, b).select("date", "ic"), "date", "left")
