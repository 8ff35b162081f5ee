"""Scores of trees and of probabilities, as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAMP = 1e-15


def set_metric(metric: str, p: Column | int, n: Column | int) -> Column:
    """F1, balanced accuracy or one-threshold AUC from tp, tn and the class sizes; as doubles, since products of counts fit neither an int nor, of many rows, a long."""
    tp, tn, p, n = (x.cast("double") for x in (F.col("tp"), F.col("tn"), *(x if isinstance(x, Column) else F.lit(x) for x in (p, n))))
    if metric == "f1":
        return tp / (tp + 0.5 * (p - tp + n - tn))
    if metric == "bacc":
        return (tp / p + tn / n) / 2
    if metric == "auc":
        return (tn * tp + 0.5 * (tp * (n - tn) + tn * (p - tp))) / (n * p)
    raise ValueError(f"metric: f1, bacc or auc, not {metric!r}")


def clamped(p: Column) -> Column:
    return F.greatest(F.lit(CLAMP), F.least(F.lit(1 - CLAMP), p))


def scores(y: str, prob: str, truth: str | None = None) -> dict[str, Column]:
    """Aggregates over a table with the label, a probability and (maybe) the true probability."""
    p, t = F.col(prob), F.col(truth or y)
    q = clamped(p)
    return {
        "mae": F.avg(F.abs(p - t)),
        "rmse": F.sqrt(F.avg((p - t) * (p - t))),
        "brier": F.avg((p - F.col(y)) * (p - F.col(y))),
        "corr": F.corr(p, t.cast("double")),
        "cross_entropy": -F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)),
        "calibration": F.abs(F.avg(p) - F.avg(F.col(y))),
    }


def calibration_bins(df: DataFrame, y: str, prob: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_prob, share) for each bin of probability that has rows; the first takes 0 as well."""
    at = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.col(prob) * bins))).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(y).cast("double")).alias("share"))


def size_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))


def class_table(df: DataFrame, column: str) -> DataFrame:
    """(class, n, share)."""
    counts = df.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("class", "n", (F.col("n") / F.col("total")).alias("share"))  # one row on the right
