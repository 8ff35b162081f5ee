"""Search for the regularization or the bound that gives a wanted number of trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.config import FitConfig
from coppice.operators import search
from coppice.operators.encode import pattern_table
from coppice.operators.fit import TreeModel, _classes, binary_rules, fit_patterns
from coppice.sources.tables import check_binary
from coppice.sources.work import kept

#: Ranges of the search.
RANGES = {("bound_multiplier", "misclassification"): (0.01, 0.5), ("bound_multiplier", "log_loss"): (0.01, 0.5), ("regularization", "misclassification"): (0.01, 0.5), ("regularization", "log_loss"): (0.1, 1.0)}
MOST_STEPS, LEAST_WIDTH = 20, 0.001


@dataclass
class TuneResult:
    model: TreeModel
    value: float
    n_trees: int
    steps: int
    converged: bool
    tried: list[tuple[float, int]]


def auto_tune(df: DataFrame, label: str, features: list[str], target: int = 1, most: int = 5, parameter: str = "bound_multiplier", config: FitConfig = FitConfig(), search_range: tuple[float, float] | None = None, max_steps: int = MOST_STEPS) -> TuneResult:
    """Halve the range until the near-optimal set has between ``target`` and ``most`` trees.

    A larger multiplier means more trees, a larger regularization fewer; the cells hold
    counts only, so they are made once.  The result is the closest setting met.
    """
    if parameter not in ("bound_multiplier", "regularization"):
        raise ValueError("parameter: bound_multiplier or regularization")
    if not 1 <= target <= most:
        raise ValueError("1 <= target <= most")
    check_binary(df, features)
    rules, classes = binary_rules(features), _classes(df, label)
    patterns = kept(pattern_table(df, rules, F.col(f"`{label}`"), classes), "patterns")
    low, high = search_range or RANGES[parameter, config.loss]
    tried, best = [], None
    converged = False
    setting = lambda x: config.with_(bound=0.0, bound_adder=0.0, **{parameter: x})
    # The cells of the setting that allows the deepest trees serve all others.
    whole = search.problem(patterns, len(rules), len(classes), setting(high if parameter == "bound_multiplier" else low))
    for _ in range(max_steps):
        value = (low + high) / 2
        trial = setting(value)
        p = search.retuned(whole, trial)
        levels = search.optimum(p)
        reach = search.budgets(p, levels, p.scale.bound(trial))
        n = int(search.root_clusters(p, search.entries(p, reach)).agg(F.sum("trees")).first()[0] or 0)
        tried.append((value, n))
        miss = max(target - n, n - most, 0)
        if best is None or miss < best[0]:
            best = (miss, value, n, trial)
        if miss == 0:
            converged = True
            break
        if (n > most) == (parameter == "bound_multiplier"):
            high = value
        else:
            low = value
        if high - low <= LEAST_WIDTH:
            break
    _, value, n, trial = best
    model = fit_patterns(patterns, rules, classes, label, trial.with_(model_limit=max(trial.model_limit, n)), single_tree=False, max_trees=most, p=search.retuned(whole, trial))
    return TuneResult(model, value, n, len(tried), converged, tried)


def cv_losses(fold_scores: DataFrame) -> DataFrame:
    """(regularization, cv_loss) averaged over folds, from (fold, regularization, loss)."""
    return fold_scores.groupBy("regularization").agg(F.avg("loss").alias("cv_loss"))
