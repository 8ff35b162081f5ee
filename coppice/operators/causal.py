"""Doubly robust estimates from a treatment, a propensity and two outcome models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def influence(y: str, a: str, pi: str, mu1: str, mu0: str) -> Column:
    """(a y - (a - pi) mu1) / pi - ((1 - a) y - (pi - a) mu0) / (1 - pi), the row's part of the effect."""
    y_, a_, p, m1, m0 = (F.col(c) for c in (y, a, pi, mu1, mu0))
    treated = (a_ * y_ - (a_ - p) * m1) / p
    control = ((1 - a_) * y_ - ((1 - a_) - (1 - p)) * m0) / (1 - p)
    return treated - control


def dr_estimate(df: DataFrame, value: str = "influence") -> DataFrame:
    """(estimate, std_error, n)."""
    return df.agg(F.avg(value).alias("estimate"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("std_error"), F.count(value).alias("n"))


def residualize(df: DataFrame, y: str, x: str, out: str = "residual") -> DataFrame:
    """``df`` with the least-squares residual of y on x, moved to the prediction at the mean of x."""
    line = df.agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_intercept"), F.avg(x).alias("_mean"))
    fitted = F.col("_intercept") + F.col("_slope") * F.col(x)
    at_mean = F.col("_intercept") + F.col("_slope") * F.col("_mean")
    return df.crossJoin(F.broadcast(line)).withColumn(out, F.col(y) - fitted + at_mean).drop("_slope", "_intercept", "_mean")  # one row on the right


def cell_means(df: DataFrame, keys: list[str], y: str, a: str) -> DataFrame:
    """``df`` with pi, mu1 and mu0 as the means of each cell of the keys: a saturated outcome model."""
    per = df.groupBy(*keys).agg(F.avg(F.col(a).cast("double")).alias("pi"), F.avg(F.when(F.col(a) == 1, F.col(y))).alias("mu1"), F.avg(F.when(F.col(a) == 0, F.col(y))).alias("mu0"))
    return df.join(per, keys)


def simulated(spark, rows: int, seed: int) -> DataFrame:
    """A simulated study: four hidden normal covariates, a logistic propensity, y = 120 + 6a + 3 sum(x) + noise of sd 6."""
    df = spark.range(rows).select("id", *[F.randn(seed + k).alias(f"x{k}") for k in range(1, 5)])
    index = -F.col("x1") + 0.5 * F.col("x2") - 0.25 * F.col("x3") - 0.1 * F.col("x4")
    df = df.withColumn("pi", 1 / (1 + F.exp(-index))).withColumn("a", (F.rand(seed + 9) < F.col("pi")).cast("int"))
    base = 120 + 3 * (F.col("x1") + F.col("x2") + F.col("x3") + F.col("x4"))
    return df.withColumns({"mu0": base, "mu1": base + 6}).withColumn("y", F.when(F.col("a") == 1, F.col("mu1")).otherwise(F.col("mu0")) + 6 * F.randn(seed + 10))


def cross_fitted(df: DataFrame, keys: list[str], y: str, a: str, folds: list[Column]) -> DataFrame:
    """(repeat, estimate, std_error, n) for each way of dealing folds: nuisances of a row come from the other folds' rows of its cell.

    Rows whose cell has no treated or no control row in the other folds have no estimate;
    n counts the others.
    """
    many = df.select("*", F.posexplode(F.array(*folds)).alias("repeat", "fold"))
    treated = F.col(a).cast("double")
    per = many.groupBy("repeat", "fold", *keys).agg(F.count("*").alias("n"), F.sum(treated).alias("n1"), F.sum(treated * F.col(y)).alias("y1"), F.sum((1 - treated) * F.col(y)).alias("y0"))
    sums = ("n", "n1", "y1", "y0")
    whole = per.groupBy("repeat", *keys).agg(*[F.sum(c).alias(f"{c}_all") for c in sums])
    rest = per.join(whole, ["repeat", *keys]).withColumns({c: F.col(f"{c}_all") - F.col(c) for c in sums})
    share = lambda top, bottom: F.when(bottom > 0, top / bottom)
    fitted = rest.select("repeat", "fold", *keys, share(F.col("n1"), F.col("n")).alias("pi"), share(F.col("y1"), F.col("n1")).alias("mu1"), share(F.col("y0"), F.col("n") - F.col("n1")).alias("mu0"))
    value = many.join(fitted, ["repeat", "fold", *keys]).where("pi > 0 and pi < 1").withColumn("influence", influence(y, a, "pi", "mu1", "mu0"))
    return value.groupBy("repeat").agg(F.avg("influence").alias("estimate"), (F.stddev_samp("influence") / F.sqrt(F.count("influence"))).alias("std_error"), F.count("influence").alias("n"))
