"""Evaluation of scores: thresholds, curves, histograms, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions.numeric import clean, correlation
from ledgerlight.operators.ordered import exact_quantiles, running


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def threshold_metrics(df: DataFrame, thresholds: Sequence[float] = C.CONFIDENCE_THRESHOLDS, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts and rates at each threshold, one pass (0 where a denominator is 0)."""
    pos, neg = F.col(label) == 1, F.col(label) == 0
    rows = df.select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"), F.col(score).alias("_s"), F.col(label).alias(label))
    hit = F.col("_s") >= F.col("threshold")
    c = rows.groupBy("threshold").agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & neg).alias("fp"),
        F.count_if(~hit & neg).alias("tn"), F.count_if(~hit & pos).alias("fn"), F.count("*").alias("n"),
    )
    tp, fp, tn, fn, n = (F.col(x) for x in ("tp", "fp", "tn", "fn", "n"))
    return c.select(
        "threshold", "tp", "fp", "tn", "fn",
        _rate(fp, fp + tn).alias("fpr"), _rate(fn, fn + tp).alias("fnr"), _rate(tp, tp + fn).alias("tpr"), _rate(tn, tn + fp).alias("tnr"),
        _rate(tp, tp + fp).alias("precision"), _rate(tp + tn, n).alias("accuracy"), _rate(tp + fp, n).alias("predicted_positive"),
    )


def _score_counts(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: equal scores collapse before the shuffle."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def curve_points(df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """ROC and precision/recall point at each distinct score, from the highest down."""
    counts = _score_counts(df, score, label, keys)
    run = running(counts, keys, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, totals={"tp": "positives", "fp": "negatives"})
    return run.select(
        *keys, "score", "pos", "neg", "tp", "fp", "positives", "negatives",
        _rate(F.col("tp"), F.col("positives")).alias("tpr"), _rate(F.col("fp"), F.col("negatives")).alias("fpr"),
        _rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def curve_areas(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision."""
    wins = F.sum(F.col("pos") * (F.col("negatives") - F.col("fp") + F.col("neg") / 2.0))
    return points.groupBy(*keys).agg(
        F.try_divide(wins, F.max(F.col("positives") * F.col("negatives")).cast("double")).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("positives").cast("double")).alias("average_precision"),
    )


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    return curve_areas(curve_points(df, score, label)).select("auc")


def score_at_percentile(df: DataFrame, percentile: float, score: str = "score") -> DataFrame:
    """Score below which the given percentage of rows lies."""
    return exact_quantiles(df, [], score, {"score_at": percentile / 100.0})


def score_histogram(df: DataFrame, bins: int = 20, score: str = "score", label: str = "label") -> DataFrame:
    """Counts per class in equal bins over the class's own score range; the top edge joins the last bin."""
    s = F.col(score)
    edges = df.groupBy(label).agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.coalesce(F.least(F.floor(F.try_divide(s - F.col("_lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    rows = df.filter(s.isNotNull()).join(F.broadcast(edges), label)  # one row per class
    return rows.groupBy(label, at.alias("bin")).agg(F.count("*").alias("n"), (F.min("_lo") + F.col("bin") * F.min(width)).alias("bin_start"))


def feature_correlation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Absolute correlation of each median-filled feature with the label, ranked.

    The tall form groups by feature, so one aggregate of moments holds all features. Constant
    features, and all features of a constant label, have no correlation (NULL) and come last.
    """
    cells = df.select(F.col(label).cast("double").alias("_y"), *[clean(F.col(f"`{c}`")).alias(c) for c in features])
    tall = cells.unpivot(["_y"], [F.col(f"`{c}`") for c in features], "feature", "value")
    med = exact_quantiles(tall, ["feature"], "value", {"median": 0.5}).drop("n")
    # one row per feature column: bounded by the table's width
    filled = tall.join(F.broadcast(med), "feature", "left").withColumn("value", F.coalesce("value", "median", F.lit(0.0)))
    r = filled.groupBy("feature").agg(F.abs(correlation(F.col("value"), F.col("_y"))).alias("correlation"))
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("correlation"), "feature"))
    return r.withColumn("rank", rank)


def correlation_counts(correlations: DataFrame) -> DataFrame:
    """Features, and those above 0.1 and 0.05."""
    c = F.col("correlation")
    return correlations.agg(F.count("*").alias("features"), F.count_if(c > 0.1).alias("above_10"), F.count_if(c > 0.05).alias("above_5"))


def regression_metrics(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """mse, rmse, mae, r2 and Pearson correlation over rows with both values; NULL r2 for a constant
    target, NULL correlation where either side is constant."""
    y, p = clean(F.col(target)), clean(F.col(predicted))
    rows = df.select(y.alias("y"), p.alias("p")).filter("y is not null and p is not null")
    e = F.col("y") - F.col("p")
    m = rows.agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop("y").alias("_v"), correlation(F.col("y"), F.col("p")).alias("pearson"),
    )
    r2 = 1 - F.try_divide(F.col("mse"), F.col("_v"))
    return m.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "pearson")


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per (actual, predicted) class."""
    return df.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def standard_scaler(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each train feature; a zero deviation becomes 1."""
    row = train.agg(*[F.avg(f"`{c}`").alias(f"m_{i}") for i, c in enumerate(features)], *[F.stddev_pop(f"`{c}`").alias(f"s_{i}") for i, c in enumerate(features)]).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(features)}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`") - m) / s for c, (m, s) in scaler.items()})


def normalize_labels(df: DataFrame, col: str, out: str = "label_name") -> DataFrame:
    """0/1 to bad/good; three numbers to bad/mediocre/good by size; the class names pass."""
    values = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(5).collect()]
    names = ("bad", "mediocre", "good")
    if len(values) <= 3 and all(isinstance(v, str) for v in values) and set(values) <= set(names):
        return df.withColumn(out, F.col(col))
    if set(values) == {0, 1}:
        found = {0: "bad", 1: "good"}
    elif len(values) == 3 and not any(isinstance(v, str) for v in values):
        found = dict(zip(sorted(values), names))
    else:
        raise ValueError(f"labels are 0/1, three numbers or {names}; found {values}")
    expr = F.lit(None).cast("string")
    for v, name in found.items():
        expr = F.when(F.col(col) == v, name).otherwise(expr)
    return df.withColumn(out, expr)


#: Rows of a batch that are compared with one another: three matrices of 128 MB.
LARGEST_BATCH = 4096


def contrastive_separation(df: DataFrame, key: str, vector: str, label: str, batch: str, temperature: float = 0.1) -> DataFrame:
    """Supervised-contrastive loss of each anchor against the other rows of its batch: (key, batch, loss).

    `batch` names the column of training batches, which are bounded by their purpose; a batch is
    scored as one small matrix product in a task. One of more than `LARGEST_BATCH` rows is an error.
    Their mean is `contrastive_loss`.
    """
    eps = 1e-8

    def score(pdf):
        import numpy as np

        if len(pdf) > LARGEST_BATCH:
            raise ValueError(f"a batch has {len(pdf)} rows, at most {LARGEST_BATCH} are compared with one another")
        x = np.stack(pdf[vector].to_numpy()).astype("float64")
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        e = np.exp(x @ x.T / temperature)
        np.fill_diagonal(e, 0.0)
        y = pdf[label].to_numpy()
        same = y[:, None] == y[None, :]
        loss = -np.log((e * same).sum(1) / (e.sum(1) + eps) + eps)
        return pdf[[key, batch]].assign(loss=loss)

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, batch)]
    return df.select(key, batch, label, vector).groupBy(batch).applyInPandas(score, f"{', '.join(kinds)}, loss double")


def contrastive_loss(losses: DataFrame, batch: str = "batch") -> DataFrame:
    """Mean loss and anchors of every batch, and of all batches together (batch NULL)."""
    return losses.rollup(batch).agg(F.avg("loss").alias("loss"), F.count("*").alias("anchors"))
