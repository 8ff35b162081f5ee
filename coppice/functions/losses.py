"""Leaf losses from class counts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAMP = 1e-12


def counts(classes: int) -> list[Column]:
    return [F.col(f"n_{k}") for k in range(classes)]


def total(classes: int) -> Column:
    out = F.col("n_0")
    for k in range(1, classes):
        out = out + F.col(f"n_{k}")
    return out


def uniform_costs(classes: int, rows: int) -> list[list[float]]:
    return [[0.0 if i == j else 1.0 / max(rows, 1) for j in range(classes)] for i in range(classes)]


def balanced_costs(class_rows: list[int]) -> list[list[float]]:
    k = len(class_rows)
    return [[0.0 if i == j else 1.0 / (k * max(class_rows[j], 1)) for j in range(k)] for i in range(k)]


def cost_of(prediction: int, costs: list[list[float]]) -> Column:
    """Cost of a leaf that predicts one class."""
    out = F.lit(0.0)
    for j, c in enumerate(costs[prediction]):
        if c:
            out = out + F.lit(float(c)) * F.col(f"n_{j}")
    return out


def entropy_loss(classes: int) -> Column:
    """Rows times entropy, shares clamped away from 0 and 1."""
    n = F.greatest(total(classes), F.lit(1)).cast("double")
    out = F.lit(0.0)
    for c in counts(classes):
        p = F.greatest(F.lit(CLAMP), F.least(F.lit(1 - CLAMP), c / n))
        out = out - p * F.log(p)
    return out * n


def best_class(classes: int, costs: list[list[float]] | None) -> Column:
    """Cheapest class, the highest of equals; without costs the most frequent one, likewise."""
    if costs is None:
        worth = [c.cast("double") for c in counts(classes)]
        top = F.greatest(*worth) if classes > 1 else worth[0]
    else:
        worth = [F.round(cost_of(i, costs), 12) for i in range(classes)]
        top = F.least(*worth) if classes > 1 else worth[0]
    out = F.lit(0)
    for k in range(classes):
        out = F.when(worth[k] == top, F.lit(k)).otherwise(out)
    return out


def leaf_columns(classes: int, loss: str, costs: list[list[float]] | None, unit: float) -> dict[str, Column]:
    """prediction, falses (wrong rows) and loss of a cell made a leaf.  unit: cost of an error where costs are uniform."""
    pred = best_class(classes, costs if loss == "misclassification" else None)
    right = F.lit(0).cast("long")
    for k in range(classes):
        right = F.when(pred == k, F.col(f"n_{k}")).otherwise(right)
    falses = total(classes) - right
    if loss == "log_loss":
        value = entropy_loss(classes)
    elif costs is None:
        value = falses * F.lit(unit)
    else:
        value = cost_of(0, costs)
        for k in range(1, classes):
            value = F.when(pred == k, cost_of(k, costs)).otherwise(value)
    return {"prediction": pred.cast("int"), "falses": falses.cast("long"), "loss": F.round(value.cast("double"), 12)}
