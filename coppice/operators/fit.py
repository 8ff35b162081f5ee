"""Fitting: the optimal tree, the near-optimal set, and what is derived from both."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.config import FitConfig
from coppice.functions import masks, metrics
from coppice.operators import levelwise, ranking, search, trees
from coppice.operators.encode import Rule, codex, pattern_table
from coppice.sources.tables import check_binary
from coppice.sources.work import kept


@dataclass
class TreeModel:
    """A fit.  n_trees counts all trees within the bound, n_optimal those that tie for the optimum; ``trees`` holds the texts that were asked for.

    levels: for the search by levels, a row a level with what it made and cut and the bounds
    it reached.  trace: its splits one by one, where asked for.  lower: what the optimum
    costs at least; below the objective only where time ran out before it was proved.  cells:
    counts of the conjunctions that were made.  space: what ``ranked`` reads.  training: the
    table of the fit, where it was to be kept.
    """

    config: FitConfig
    rules: list[Rule]
    classes: list
    label: str
    objective: float
    bound: float
    n_trees: int
    n_optimal: int
    rows: int
    trees: list[trees.Tree]
    stats: dict[tuple[int, int], dict]
    clusters: DataFrame | None = None
    edges: DataFrame | None = None
    seconds: dict[str, float] = field(default_factory=dict)
    lower: float | None = None
    finished: bool = True
    levels: DataFrame | None = None
    trace: DataFrame | None = None
    cells: DataFrame | None = None
    space: tuple[search.Problem, list[DataFrame]] | None = None
    training: DataFrame | None = None
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    def _training(self) -> DataFrame:
        if self.training is None:
            raise ValueError("the fit didn't keep its table: give keep_training=True")
        return self.training

    def training_predictions(self) -> DataFrame:
        """The table of the fit with ``prediction`` and ``prob_<k>``, worked out when it is read."""
        if "predictions" not in self._known:
            self._known["predictions"] = predict(self, predict(self, self._training()), "prob", check=False)
        return self._known["predictions"]

    def training_accuracy(self) -> float:
        """The share of right predictions on the table of the fit, counted once."""
        if "accuracy" not in self._known:
            self._known["accuracy"] = accuracy(self, self._training())
        return self._known["accuracy"]

    def ranked(self, first: int, last: int) -> DataFrame:
        """(rank, tree, objective, leaves) of the trees ranked first to last, from 0, best first; nothing else of the set is made."""
        if self.space is None:
            raise ValueError("ranks are those of a fit of the near-optimal set")
        return ranking.trees_between(*self.space, first, last)

    @property
    def gap(self) -> float:
        """What the optimum may be below the objective; above 0 only where time ran out."""
        return self.objective - (self.objective if self.lower is None else self.lower)

    @property
    def tree(self) -> trees.Tree:
        return self.trees[0]

    def tests(self) -> list[Column]:
        return [r.test() for r in self.rules]

    def _shares(self, care: int, val: int, t: trees.Tree) -> list[float]:
        got = self.stats.get((care, val), {}).get("probabilities") or [1.0 if k == t.prediction else 0.0 for k in range(len(self.classes))]
        if self.config.prob_clip:
            low, high = self.config.prob_clip
            got = [min(high, max(low, x)) for x in got]
            got = [x / sum(got) for x in got]
        return got

    def probabilities(self, tree: trees.Tree | None = None) -> list[Column]:
        """A column for each class."""
        tree = tree or self.tree
        cells = {node: (care, val) for node, care, val, _ in tree.cells()}
        return [trees.column_of(tree, self.tests(), lambda node, t, k=k: F.lit(float(self._shares(*cells[node], t)[k]))) for k in range(len(self.classes))]

    def prediction(self, tree: trees.Tree | None = None) -> Column:
        """The class; for two classes under log-loss the second where its share is a half or more."""
        tree = tree or self.tree
        cells = {node: (care, val) for node, care, val, _ in tree.cells()}

        def leaf(node, t):
            shares = self._shares(*cells[node], t)
            two = self.config.loss == "log_loss" and len(shares) == 2
            return F.lit(self.classes[int(shares[1] >= 0.5) if two else t.prediction])

        return trees.column_of(tree, self.tests(), leaf)

    def json(self, tree: trees.Tree | None = None) -> dict:
        tree = tree or self.tree
        return trees.to_json(tree, self.rules, self.classes, self.stats, self.config.regularization, self.objective if tree == self.tree else None)

    def envelope(self) -> dict:
        """The trees with the outcomes of the set and the fit's metadata.

        storage: an entry for each outcome (how many trees have it), then the splits;
        metric_pointers: for each outcome its place in there.  More than model_limit
        of either is an error.
        """
        limit = self.config.model_limit
        values = [] if self.clusters is None else self.clusters.groupBy("objective", "falses", "leaves").agg(F.sum("trees").alias("trees")).orderBy("objective", "leaves", "falses").limit(limit + 1).collect()
        edges = [] if self.edges is None else self.edges.limit(limit + 1).collect()
        if max(len(values), len(edges)) > limit:
            raise ValueError(f"over model_limit={limit} outcomes or splits: read the tables instead")
        storage = [{"terminal": r.leaves == 1, "count": int(r.trees), "falses": r.falses, "leaves": r.leaves} for r in values] + [r.asDict() for r in edges]
        return {"storage": storage, "available_metric_values": {"metric_values": [[r.objective, r.falses, r.leaves] for r in values], "metric_pointers": list(range(len(values)))}, "metadata": {"regularization": self.config.regularization, "dataset_size": self.rows}, "trees": [self.json(t) for t in self.trees]}

    def trees_df(self, spark) -> DataFrame:
        """(tree_id, tree: text, leaves, json) of the trees that were asked for, best first."""
        rows = [(i, t.text(), t.leaves(), trees.canonical_json(self.json(t))) for i, t in enumerate(self.trees, 1)]
        return spark.createDataFrame(rows, "tree_id long, tree string, leaves int, json string")

    def summary(self) -> dict:
        """What a fit comes to: objective, bound, counts, the best tree's leaves, depth and features, seconds a step."""
        t = self.tree
        return {"loss": self.config.loss, "regularization": self.config.regularization, "objective": self.objective, "bound": self.bound, "n_trees": self.n_trees, "n_optimal": self.n_optimal, "rows": self.rows, "classes": self.classes, "leaves": t.leaves(), "depth": t.depth(), "features": sorted(self.rules[f].name for f in t.features()), "seconds": dict(self.seconds)}

    def __repr__(self) -> str:
        return f"TreeModel(loss={self.config.loss}, regularization={self.config.regularization}, objective={self.objective:.6g}, n_trees={self.n_trees}, n_optimal={self.n_optimal}, rows={self.rows})\n{trees.readable(self.tree, self.rules, self.classes)}"


def binary_rules(features: list[str]) -> list[Rule]:
    return [Rule(i, i, c, "numeric_binary", "==", "1") for i, c in enumerate(features)]


def _classes(df: DataFrame, label: str, most: int = 100) -> list:
    if label not in df.columns:
        raise ValueError(f"columns not there: {[label]}")
    got = [r[0] for r in df.select(F.col(f"`{label}`")).distinct().limit(most + 2).collect()]
    if None in got:
        raise ValueError(f"rows without a label in {label}")
    if len(got) > most:
        raise ValueError(f"over {most} classes in {label}")
    if not got:
        raise ValueError("the table has no labelled rows")
    return sorted(got)


def _leaf_stats(p: search.Problem, found: list[trees.Tree]) -> dict[tuple[int, int], dict]:
    need = {(care, val) for t in found for _, care, val, s in t.cells() if s.feature is None}
    mask = masks.sql_type(p.features)
    wanted = p.cells.sparkSession.createDataFrame([tuple(masks.stored_form(x, p.features) for x in cell) for cell in sorted(need)], f"care {mask}, val {mask}")
    out = {}
    for r in p.cells.withColumn("loss", p.scale.shown("cost")).join(F.broadcast(wanted), ["care", "val"]).collect():  # a row for each leaf
        out[masks.number(r.care), masks.number(r.val)] = {"loss": r.loss, "probabilities": [r[f"n_{k}"] / r.n_total for k in range(p.classes)], "rows": r.n_total}
    return out


def fit(df: DataFrame, label: str, features: list[str] | None = None, rules: list[Rule] | None = None, config: FitConfig = FitConfig(), single_tree: bool = True, max_trees: int | None = None, trace: bool = False, keep_training: bool = False) -> TreeModel:
    """Fit over binary ``features``, over given ``rules``, or (neither) over rules made from all other columns.

    single_tree: only the optimum, with one tree kept.  Otherwise the whole near-optimal
    set is counted and up to ``max_trees`` of its trees (all of them: None) are kept; over
    config.model_limit trees that is an error, as nothing is dropped silently.
    """
    began, seconds = time.time(), {}
    if rules is None:
        if features is not None:
            check_binary(df, features)
            rules = binary_rules(features)
        else:
            rules = codex(df, [c for c in df.columns if c != label], config.precision)
    classes = _classes(df, label)
    patterns = kept(pattern_table(df, rules, F.col(f"`{label}`"), classes), "patterns")
    seconds["patterns"] = time.time() - began
    model = fit_patterns(patterns, rules, classes, label, config, single_tree, max_trees, seconds, trace=trace)
    model.training = df if keep_training else None
    return model


def by_levels(config: FitConfig, features: int) -> bool:
    """Whether cells are made level by level: where asked for, and where the cube can't be made but something limits the depth."""
    if config.search != "auto":
        return config.search == "levels"
    if config.time_limit or masks.wide(features):
        return True
    return masks.cells_bound(features, search.literal_limit(features, config)) > config.max_cells and bool(config.regularization or config.max_depth)


def fit_patterns(patterns: DataFrame, rules: list[Rule], classes: list, label: str, config: FitConfig, single_tree: bool = True, max_trees: int | None = None, seconds: dict | None = None, p: search.Problem | None = None, trace: bool = False) -> TreeModel:
    """trace: keep the splits that the search by levels met."""
    seconds, began = seconds if seconds is not None else {}, time.time()
    grown = None
    if p is None and by_levels(config, len(rules)):
        grown = levelwise.grow(patterns, len(rules), len(classes), config, not single_tree, trace, config.time_limit)
        p = grown.problem
    p = p or search.problem(patterns, len(rules), len(classes), config)
    if not p.rows:
        raise ValueError("the table has no rows")
    levels = grown.values if grown else search.optimum(p)
    best = search.best(p, levels)
    if config.upper_bound and best > config.upper_bound * (1 + search.TOLERANCE):
        raise ValueError(f"the optimum is above the given upper bound of {config.upper_bound}")
    seconds["optimum"], began = time.time() - began, time.time()
    bound = best if single_tree else config.rashomon_bound(best)
    reach = search.budgets(p, levels, p.scale.bound(config, single_tree))
    found = search.entries(p, reach)
    clusters = kept(search.root_clusters(p, found), "clusters")
    least = levels[0].select("v").first()[0]
    outcomes = clusters.agg(F.sum("trees").alias("all"), F.sum(F.when(p.scale.within(F.col("units"), F.lit(least)), F.col("trees"))).alias("tied")).first()
    n_trees, n_optimal = int(outcomes["all"] or 0), int(outcomes.tied or 0)
    edges = None if single_tree else search.dag_edges(p, levels, reach, found)
    wanted = min(n_trees, 1 if single_tree else n_trees if max_trees is None else max_trees)
    if wanted > config.model_limit:
        raise ValueError(f"{n_trees} trees are within the bound and {wanted} are wanted, over model_limit={config.model_limit}: lower the bound, give max_trees or raise the limit")
    best_first = search.entries(p, reach, trees=True, most=wanted if wanted < n_trees else None)[0].withColumn("units", search.units(p))
    texts = [r.tree for r in best_first.orderBy("units", "leaves", F.length("tree"), "tree").limit(wanted).collect()]
    kept_trees = [trees.parse(t) for t in texts]
    seconds["trees"] = time.time() - began
    return TreeModel(config, rules, classes, label, best, bound, n_trees, n_optimal, p.rows, kept_trees, _leaf_stats(p, kept_trees), None if single_tree else clusters, edges, seconds, *((grown.lower, grown.finished, grown.levels, grown.trace) if grown else (best, True, None, None)), cells=p.cells, space=None if single_tree else (p, found))


def fit_tree(df: DataFrame, label: str, features: list[str] | None = None, config: FitConfig = FitConfig()) -> TreeModel:
    return fit(df, label, features, config=config, single_tree=True)


def fit_rashomon(df: DataFrame, label: str, features: list[str] | None = None, config: FitConfig = FitConfig(), max_trees: int | None = None) -> TreeModel:
    return fit(df, label, features, config=config, single_tree=False, max_trees=max_trees)


def example_fit(spark) -> TreeModel:
    """A fit to begin with: whether two of three features are equal, on 25 rows of each kind."""
    from itertools import product

    rows = [(*x, int(x[0] == x[1])) for x in product((0, 1), repeat=3) for _ in range(25)]
    df = spark.createDataFrame(rows, ["feature_1", "feature_2", "feature_3", "y"])
    return fit(df, "y", ["feature_1", "feature_2", "feature_3"], config=FitConfig(regularization=0.01), keep_training=True)


def _checked(model: TreeModel, value: Column) -> Column:
    """``value``; a row whose binary features hold something else than 0 and 1 is an error when it is read."""
    if model.rules != binary_rules([r.column for r in model.rules]):
        return value  # rules made from columns of any kind: a missing value fails them
    wrong = F.lit(False)
    for r in model.rules:
        wrong = wrong | F.coalesce(~F.col(f"`{r.column}`").cast("double").isin(0.0, 1.0), F.lit(True))
    return F.when(wrong, F.raise_error(F.lit(f"values other than 0 and 1 in {[r.column for r in model.rules]}"))).otherwise(value)


def predict(model: TreeModel, df: DataFrame, kind: str = "class", tree: trees.Tree | None = None, strict_names: bool = False, check: bool = True) -> DataFrame:
    """``df`` with ``prediction`` (kind class) or ``prob_<k>`` for each class (kind prob); works on streams too.

    strict_names: the table must have exactly the model's columns, in order.  check: for
    models of binary features, missing and other values are an error, found as rows are read.
    """
    need = list(dict.fromkeys(r.column for r in model.rules))
    if strict_names and [c for c in df.columns if c != model.label] != need:
        raise ValueError(f"columns must be {need}")
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"columns not there: {missing}")
    if kind == "class":
        found = model.prediction(tree)
        return df.withColumn("prediction", _checked(model, found) if check else found)
    if kind == "prob":
        found = model.probabilities(tree)
        return df.withColumns({f"prob_{k}": _checked(model, c) if check and not k else c for k, c in enumerate(found)})
    raise ValueError("kind: class or prob")


def predict_ensemble(model: TreeModel, df: DataFrame, found: list[trees.Tree] | None = None) -> DataFrame:
    """``df`` with the mean probability of the second class over the trees, the majority vote, and how many trees vote for it."""
    found = found or model.trees
    if not found:
        raise ValueError("no trees to vote")
    if len(model.classes) != 2:
        raise ValueError("votes are between two classes")
    prob = votes = None
    for t in found:
        q, v = model.probabilities(t)[1], (model.prediction(t) == F.lit(model.classes[1])).cast("int")
        prob, votes = (q, v) if prob is None else (prob + q, votes + v)
    out = df.withColumns({"prob_1": prob / len(found), "votes": votes})
    return out.withColumn("prediction", F.when(F.col("votes") * 2 >= len(found), F.lit(model.classes[1])).otherwise(F.lit(model.classes[0])))


def get_predictions(model: TreeModel, df: DataFrame, label: str | None = None) -> DataFrame:
    """``df`` with its prediction and whether it is right."""
    done = predict(model, df)
    return done.withColumn("correct", F.col("prediction") == F.col(f"`{label or model.label}`"))


def accuracy(model: TreeModel, df: DataFrame) -> float:
    return df.select((model.prediction() == F.col(f"`{model.label}`")).cast("double").alias("hit")).agg(F.avg("hit")).first()[0]


def covered(clusters: DataFrame, positives: int, negatives: int, regularization: float, metric: str, threshold: float) -> DataFrame:
    """The outcomes whose 1 - metric + regularization * leaves is within the threshold."""
    value = metrics.set_metric(metric, positives, negatives)
    return clusters.withColumn("metric", F.round(value, 12)).where(1 - F.col("metric") + regularization * F.col("leaves") <= threshold + search.TOLERANCE)
