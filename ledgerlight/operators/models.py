"""MLlib models: classifiers, regressors, the three-class network, and scorers for back-tests."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions.numeric import correlation, expected_score, minmax_score, three_class
from ledgerlight.operators import evaluate as E
from ledgerlight.operators.clean import (
    drop_constant, feature_columns, impute_constant, impute_median, split_by_columns, suffix_columns,
)
from ledgerlight.operators.prices import lag_features
from ledgerlight.session import durable

CLASSES = ("bad", "mediocre", "good")

# fixed values: parameters of the two classifiers and the regressors
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2, "seed": 42}
BOOSTED = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "seed": 42}
CLASSIFIERS = {"rf": (RandomForestClassifier, FOREST), "boosted": (GBTClassifier, BOOSTED)}
REGRESSORS = {
    "boosted_sampled": (GBTRegressor, {**BOOSTED, "subsamplingRate": 0.8}),
    "random_forest": (RandomForestRegressor, FOREST),
    "gradient_boosting": (GBTRegressor, BOOSTED),
}


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)


def _estimator(table: dict, name: str, label: str, params: dict):
    if name not in table:
        raise ValueError(f"model is one of {sorted(table)}")
    cls, defaults = table[name]
    return cls(featuresCol="_x", labelCol=label, **{**defaults, **params})


def indicate_missing(train: DataFrame, test: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """No-imputation stand-in for trees without NULL: a constant plus a missing flag per feature."""
    flags = [f"{c}_missing" for c in features]

    def flag(df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.col(f"`{c}`").isNull().cast("double") for c, n in zip(features, flags)})

    a, b = impute_constant(flag(train), flag(test), features)
    return a, b, [*features, *flags]


def _fit(estimator, known: DataFrame, features: Sequence[str]):
    """The fitted model; None if no train row has a label. Only then is the failed fit looked into."""
    try:
        return estimator.fit(_vectors(known, features))
    except Exception:
        if known.isEmpty():
            return None
        raise


def importances(model, features: Sequence[str], spark) -> DataFrame:
    """(rank, feature, importance), one row per feature; 0 for all without a model."""
    found = [0.0] * len(features) if model is None else model.featureImportances.toArray().tolist()
    pairs = sorted(zip(found, features), key=lambda p: (-p[0], p[1]))
    return spark.createDataFrame([(i + 1, f, float(v)) for i, (v, f) in enumerate(pairs)], "rank int, feature string, importance double")


def classification_metrics(scored: DataFrame, label: str) -> DataFrame:
    """Accuracy, precision and recall weighted by class, and ROC area, as one row.

    Works on the four confusion counts.
    """
    cells = E.confusion_matrix(scored.withColumn("_p", (F.col("y_pred_proba") > 0.5).cast("int")), label, "_p")
    hit = F.col(label) == F.col("_p")
    per = cells.groupBy(label).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    predicted = cells.groupBy(F.col("_p").alias(label)).agg(F.sum("n").alias("predicted"))
    rates = per.join(predicted, label, "left")
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    total = F.sum("support")
    m = rates.agg(
        F.try_divide(F.sum("tp"), total).alias("accuracy"), F.try_divide(F.sum(precision * F.col("support")), total).alias("precision"),
        F.try_divide(F.sum("tp"), total).alias("recall"),
    )
    return m.withColumn("roc_auc", E.auc(scored, "y_pred_proba", label).scalar())


def classify(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "trend_up_or_down", model: str = "rf", **params):
    """(test rows with y_pred_proba, fitted model). Features must be filled.

    Without labelled train rows there is no model (None), and every score is 0.5. A class that no
    train row has is given 0.
    """
    known = train.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    fitted = _fit(_estimator(CLASSIFIERS, model, label, params), known, features)
    if fitted is None:
        return test.withColumn("y_pred_proba", F.lit(0.5)), None
    positive = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    scored = fitted.transform(_vectors(test, features)).withColumn("y_pred_proba", positive)
    return scored.drop("_x", "rawPrediction", "probability", "prediction"), fitted


def model_grid(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "trend_up_or_down", target: str = "price_return",
    selections: Iterable[str] = ("completeness", "current", "change", "all"), imputations: Iterable[str] = ("none", "median"),
    models: Iterable[str] = ("rf", "boosted"), params: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(one row per configuration with its metrics, importances of the best by ROC area).

    The loop is over configurations; each fit and score is a distributed job on a dataset that
    is checkpointed once. A selection without columns is skipped.
    """
    spark = train.sparkSession
    train, test = durable(train), durable(test)
    rows, best = [], (-1.0, None)
    for selection in selections:
        cols = feature_columns(train.select(*[f"`{c}`" for c in features]), selection)
        if not cols:
            continue
        for imputation in imputations:
            if imputation == "median":
                a, b = impute_median(train, test, cols)
                used = cols
            else:
                a, b, used = indicate_missing(train, test, cols)
            for name in models:
                scored, fitted = classify(a, b, used, label, name, **(params or {}).get(name, {}))
                scored = durable(scored.select(label, target, "y_pred_proba"))
                m = classification_metrics(scored, label).first()
                corr = scored.agg(correlation(F.col("y_pred_proba"), F.col(target)).alias("c")).first()["c"]
                rows.append((f"{selection}_{imputation}_{name}", m["accuracy"], m["precision"], m["recall"], m["roc_auc"], corr))
                if (m["roc_auc"] or 0.0) > best[0]:
                    best = (m["roc_auc"] or 0.0, importances(fitted, used, spark))
    table = spark.createDataFrame(rows, "approach string, accuracy double, precision double, recall double, roc_auc double, corr_confidence_growth double")
    return table, best[1]


def regress(train: DataFrame, test: DataFrame, features: Sequence[str], target: str = "price_return", model: str = "boosted_sampled", **params):
    """(test rows with y_pred, fitted model). Features must be filled.

    Without train rows that have the target there is no model (None), and y_pred is 0, as medians are.
    """
    known = train.filter(F.col(target).isNotNull())
    fitted = _fit(_estimator(REGRESSORS, model, target, params), known, features)
    if fitted is None:
        return test.withColumn("y_pred", F.lit(0.0)), None
    scored = fitted.transform(_vectors(test, features)).withColumnRenamed("prediction", "y_pred")
    return scored.drop("_x"), fitted


def regression_report(scored: DataFrame, target: str = "price_return", trend: str | None = "trend_up_or_down") -> DataFrame:
    """Regression metrics, with correlation and ROC area against the trend label when there is one."""
    m = E.regression_metrics(scored, target, "y_pred")
    if trend is None or trend not in scored.columns:
        return m
    m = m.withColumn("corr_trend", scored.agg(correlation(F.col("y_pred"), F.col(trend))).scalar())
    return m.withColumn("auc_trend", E.auc(scored, "y_pred", trend).scalar())


def prepare_three_class(
    train: DataFrame, test: DataFrame, good: float = 1.05, bad: float = 0.95, share: float = 0.7, rules: dict[str, str] | None = None,
    suffixes: Sequence[str] = ("_current", "_augment"),
) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(train, validation, test, features): labels, train statistics, split, constant features dropped."""
    features = suffix_columns(train.columns, suffixes)
    train, test = (d.withColumn("class", three_class(F.col("price_return"), good, bad)) for d in (train, test))
    train, test = impute_median(train, test, features)
    fit, val = split_by_columns(train, share, rules)
    fit, test = drop_constant(fit, test, features)
    features = [c for c in features if c in fit.columns]
    return fit, val.select(*[f"`{c}`" for c in fit.columns]), test, features


def classify_three(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "class", layers: Sequence[int] = (128, 64), epochs: int = 100, seed: int = 42):
    """Test rows with p_bad, p_mediocre, p_good, the predicted class and the expected score.

    Without labelled train rows there is no network: the classes are equally likely, and the middle one,
    which has the expected score, is predicted.
    """
    scaler = E.standard_scaler(train, features)
    index = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col(label)) - 1
    known = E.scale(train, scaler).filter(F.col(label).isNotNull()).withColumn("_label", index.cast("double"))
    rows = E.scale(test, scaler)
    if known.isEmpty():  # a network does not always fail then: it may keep its random first weights
        out = rows.withColumns({**{f"p_{c}": F.lit(1 / 3) for c in CLASSES}, "predicted": F.lit("mediocre")})
    else:
        net = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_label", layers=[len(features), *layers, 3], maxIter=epochs, seed=seed, blockSize=256)
        p = vector_to_array("probability")
        out = net.fit(_vectors(known, features)).transform(_vectors(rows, features)).withColumns({f"p_{c}": p[i] for i, c in enumerate(CLASSES)})
        out = out.withColumn("predicted", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("prediction") + 1).cast("int")))
    out = out.withColumn("y_pred_proba", expected_score(F.col("p_bad"), F.col("p_good")))
    return out.drop("_x", "rawPrediction", "probability", "prediction")


def three_class_report(scored: DataFrame, label: str = "class", trend: str = "trend_up_or_down") -> DataFrame:
    """Accuracy, correlation of the score with the class order, ROC area against the trend."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col(label)).cast("double")
    m = scored.agg(F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("accuracy"), correlation(F.col("y_pred_proba"), rank).alias("corr_label"))
    return m.withColumn("auc_trend", E.auc(scored, "y_pred_proba", trend).scalar())


def lag_regression(
    aligned: DataFrame, features: Sequence[str], target: str, cutoff: str, lags: Sequence[int] = C.LAGS, model: str = "boosted_sampled",
    keys: Sequence[str] = ("cik",), order: Sequence[str] = ("month_end_date",), **params,
) -> DataFrame:
    """Regression on features and their lags, split by date; test rows with y_pred."""
    lagged = lag_features(aligned, features, lags, keys, order)
    used = [*features, *[f"{c}_lag_{k}" for k in lags for c in features]]
    early = F.col(order[0]) < F.lit(cutoff).cast("date")
    train, test = impute_median(lagged.filter(early), lagged.filter(~early), used)
    return regress(train, test, used, target, model, **params)[0]


def binary_scorer(features: Sequence[str], label: str = "trend_up_or_down", model: str = "rf", **params) -> Callable:
    """Scorer for back-tests: probability of the positive class."""

    def score(train: DataFrame, test: DataFrame) -> DataFrame:
        a, b, used = indicate_missing(train, test, [c for c in features if c in train.columns])
        return classify(a, b, used, label, model, **params)[0]

    return score


def regression_scorer(features: Sequence[str], target: str = "price_return", model: str = "boosted_sampled", **params) -> Callable:
    """Scorer for back-tests: predicted return placed in the range of the train returns."""

    def score(train: DataFrame, test: DataFrame) -> DataFrame:
        a, b = impute_median(train, test, [c for c in features if c in train.columns])
        a, b = drop_constant(a, b, [c for c in features if c in a.columns])
        used = [c for c in features if c in a.columns]
        span = train.agg(F.min(target).alias("lo"), F.max(target).alias("hi")).first()
        scored = regress(a, b, used, target, model, **params)[0]
        return scored.withColumn("y_pred_proba", minmax_score(F.col("y_pred"), F.lit(span["lo"]), F.lit(span["hi"])))

    return score


def three_class_scorer(suffixes: Sequence[str] = ("_current", "_augment"), good: float = 1.05, bad: float = 0.95, epochs: int = 100, layers: Sequence[int] = (128, 64)) -> Callable:
    """Scorer for back-tests: expected class score."""

    def score(train: DataFrame, test: DataFrame) -> DataFrame:
        fit, _, rows, used = prepare_three_class(train, test, good, bad, 1.0, None, suffixes)
        return classify_three(fit, rows, used, layers=layers, epochs=epochs)

    return score
