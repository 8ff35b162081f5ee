"""Options of a fit; immutable, so one fit can't leak into the next."""

from __future__ import annotations

from dataclasses import dataclass, replace

LOSSES = ("misclassification", "log_loss")
METRICS = ("f1", "bacc", "auc")
SEARCHES = ("auto", "cube", "levels")


@dataclass(frozen=True)
class FitConfig:
    """What is minimised, and how far around the optimum trees are kept.

    regularization: penalty of a leaf.  max_depth: levels of a tree, the root one of
    them; 0 stands for no limit.  min_support: both sides of a split must keep more
    than this many rows, and leave more than this many of the whole table out.
    Exactly one of bound (absolute), bound_multiplier and bound_adder says which trees
    are near-optimal; none of them: a multiplier of 0.05.  costs: cost of predicting
    row for column, in order of the classes.  balance: errors weigh as if classes were
    equally frequent.  precision: significant figures kept in numeric domains.
    upper_bound: an objective known to be reached; what costs more isn't searched.
    search: cube makes all cells, levels only those that trees within the bound can reach,
    auto takes the cube where it fits max_cells.  time_limit: seconds after which the search
    by levels ends with what it has; 0 for none.
    """

    loss: str = "misclassification"
    regularization: float = 0.1
    bound: float = 0.0
    bound_multiplier: float = 0.0
    bound_adder: float = 0.0
    ignore_trivial: bool = True
    model_limit: int = 10_000
    max_depth: int = 0
    min_support: int = 0
    costs: tuple[tuple[float, ...], ...] | None = None
    balance: bool = False
    precision: int = 0
    rule_list: bool = False
    upper_bound: float = 0.0
    prob_clip: tuple[float, float] | None = None
    max_cells: int = 4_000_000
    search: str = "auto"
    time_limit: float = 0.0

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"loss: one of {LOSSES}, not {self.loss!r}")
        if self.regularization < 0:
            raise ValueError("regularization: not below zero")
        if sum(x != 0 for x in (self.bound, self.bound_multiplier, self.bound_adder)) > 1:
            raise ValueError("give one of bound, bound_multiplier and bound_adder")
        if min(self.bound, self.bound_multiplier, self.bound_adder) < 0:
            raise ValueError("bounds: not below zero")
        if self.costs is not None and self.balance:
            raise ValueError("give costs or balance, not both")
        if self.loss == "log_loss" and (self.costs is not None or self.balance):
            raise ValueError("costs apply to misclassification")
        if self.search not in SEARCHES:
            raise ValueError(f"search: one of {SEARCHES}, not {self.search!r}")
        if self.search == "cube" and self.time_limit:
            raise ValueError("time_limit: the search by levels has one, the cube hasn't")
        if min(self.max_depth, self.min_support, self.model_limit, self.time_limit) < 0:
            raise ValueError("limits: not below zero")

    def with_(self, **changes) -> FitConfig:
        return replace(self, **changes)

    def rashomon_bound(self, best: float) -> float:
        if self.bound:
            return self.bound
        if self.bound_adder:
            return best + self.bound_adder
        return best * (1 + (self.bound_multiplier or 0.05))


#: Option names of configuration files -> fields; search-only options are accepted and have no effect.
OPTIONS = {
    "loss_function": "loss", "regularization": "regularization", "rashomon_bound": "bound", "rashomon_bound_multiplier": "bound_multiplier", "rashomon_bound_adder": "bound_adder",
    "rashomon_ignore_trivial_extensions": "ignore_trivial", "model_limit": "model_limit", "depth_budget": "max_depth", "minimum_captured_points": "min_support", "balance": "balance",
    "precision_limit": "precision", "rule_list": "rule_list", "upperbound": "upper_bound", "time_limit": "time_limit",
}
WITHOUT_EFFECT = frozenset("look_ahead similar_support cancellation feature_exchange continuous_feature_exchange feature_transform worker_limit stack_limit uncertainty_tolerance verbose diagnostics rashomon".split())


def from_options(options: dict) -> FitConfig:
    """A configuration from the names that configuration files use; an unknown name is an error."""
    unknown = set(options) - set(OPTIONS) - WITHOUT_EFFECT
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    values = {OPTIONS[k]: v for k, v in options.items() if k in OPTIONS}
    if "loss" in values:
        values["loss"] = values["loss"].replace("-", "_").replace("logloss", "log_loss")
    return FitConfig(**values)
