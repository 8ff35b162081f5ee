"""What a set of rows could cost at best and at worst, and how alike features are, from a pattern table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions import masks
from coppice.functions.losses import best_class, cost_of, total, uniform_costs


def cost_aggregates(costs: list[list[float]]) -> dict[str, list[float]]:
    """For each true class: cost when it is met, the least when it isn't, the least and most of all, and their distance."""
    of = [[row[j] for row in costs] for j in range(len(costs))]
    out = {"match": [c[j] for j, c in enumerate(of)], "mismatch": [min([x for i, x in enumerate(c) if i != j], default=0.0) for j, c in enumerate(of)], "max": [max(c) for c in of], "min": [min(c) for c in of]}
    return out | {"diff": [a - b for a, b in zip(out["max"], out["min"], strict=True)]}


def _weighed(weights: list[float]) -> Column:
    out = F.lit(0.0)
    for k, w in enumerate(weights):
        out = out + F.lit(float(w)) * F.col(f"n_{k}")
    return out


def equivalent_points(classes: int, costs: list[list[float]]) -> Column:
    """What a pattern's rows cost at least: its cheapest class is met, the others at their least cost of an error."""
    sums, best = cost_aggregates(costs), best_class(classes, costs)
    out = F.lit(0.0)
    for k in range(classes):
        out = out + F.when(best == k, F.lit(float(sums["match"][k]))).otherwise(F.lit(float(sums["mismatch"][k]))) * F.col(f"n_{k}")
    return out


def information(classes: int, support: Column) -> Column:
    """Support times the sum of n (ln n - ln support) over the classes that are there."""
    out = F.lit(0.0)
    for k in range(classes):
        n = F.col(f"n_{k}")
        out = out + F.when(n > 0, n * (F.log(n) - F.log(support))).otherwise(0.0)
    return support * out


def set_measures(patterns: DataFrame, care: int, classes: int, rows: int, costs: list[list[float]] | None = None) -> DataFrame:
    """(val, n_0 .., support, potential, min_loss, max_loss, information) of the sets that the features of ``care`` tell apart.

    potential: the most that splitting on could save; min_loss: the bound by equal
    patterns; max_loss: the cost of the set as one leaf.
    """
    costs = costs or uniform_costs(classes, rows)
    ns = [f"n_{k}" for k in range(classes)]
    sums = patterns.withColumn("_least", equivalent_points(classes, costs)).groupBy(F.col("bits").bitwiseAND(F.lit(care).cast("long")).alias("val")).agg(*[F.sum(n).alias(n) for n in ns], F.sum("_least").alias("min_loss"))
    leaf, best = cost_of(0, costs), best_class(classes, costs)
    for k in range(1, classes):
        leaf = F.when(best == k, cost_of(k, costs)).otherwise(leaf)
    got = sums.withColumn("support", total(classes) / F.lit(rows))
    return got.select("val", *ns, "support", _weighed(cost_aggregates(costs)["diff"]).alias("potential"), "min_loss", leaf.alias("max_loss"), information(classes, F.col("support")).alias("information"))


def feature_distance(patterns: DataFrame, features: int, classes: int, costs: list[list[float]]) -> DataFrame:
    """(i, j, distance): the cost spread of the rows in which two features differ, or in which they agree, whichever is less."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(features) for j in range(i + 1, features)]))
    spread = patterns.select("bits", _weighed(cost_aggregates(costs)["diff"]).alias("w"), pairs.alias("x")).select("bits", "w", "x.i", "x.j")
    differ = masks.is_set(F.col("bits"), F.col("i")) != masks.is_set(F.col("bits"), F.col("j"))
    sums = spread.groupBy("i", "j").agg(F.sum(F.when(differ, F.col("w")).otherwise(0.0)).alias("differ"), F.sum(F.when(differ, 0.0).otherwise(F.col("w"))).alias("agree"))
    return sums.select("i", "j", F.least("differ", "agree").alias("distance"))
