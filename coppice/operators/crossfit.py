"""Cross-fitting: the fold is a key of the cells, so all folds are fitted in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.config import FitConfig
from coppice.operators import levelwise, search, trees
from coppice.operators.encode import pattern_table
from coppice.operators.fit import TreeModel, _classes, binary_rules, by_levels, fit_patterns
from coppice.sources.tables import check_binary
from coppice.sources.work import kept


def stratified_folds(df: DataFrame, label: str, order: list, folds: int) -> DataFrame:
    """``df`` with ``fold``: each class is dealt round by rank in the given order (a key, or a hash of seed and key).

    Ranks come from a range partitioning and its running sums, so no task holds a class.
    """
    if folds < 2:
        raise ValueError("folds: two at least")
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    place = df.select("*", F.monotonically_increasing_id().alias("_row"))
    dealt = place.repartitionByRange(F.col(label), *cols, F.col("_row")).sortWithinPartitions(F.col(label), *cols, F.col("_row"))
    marked = kept(dealt.select("*", F.spark_partition_id().alias("_part")), "dealt")
    from pyspark.sql.window import Window

    within = Window.partitionBy("_part", label).orderBy(*cols, "_row")
    sizes = marked.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select(F.col(label).alias("_label"), "_part", F.coalesce("_before", F.lit(0)).alias("_before"))  # a row for each partition
    ranked = marked.withColumn("_at", F.row_number().over(within) - 1).join(before.withColumnRenamed("_part", "_of"), (F.col("_part") == F.col("_of")) & F.col(label).eqNullSafe(F.col("_label")))
    return ranked.withColumn("fold", ((F.col("_before") + F.col("_at")) % folds + 1).cast("int")).select(*df.columns, "fold")


@dataclass
class CrossFitResult:
    """Trees of each fold's fit on the other folds, and those found in all of them."""

    folds: int
    config: FitConfig
    rules: list
    classes: list
    label: str
    sets: DataFrame  # fold, tree, objective, leaves
    model: TreeModel  # on all rows: its leaf shares serve the ensemble

    def sizes(self) -> DataFrame:
        return self.sets.groupBy("fold").agg(F.count("*").alias("trees"))

    def intersection(self) -> DataFrame:
        return intersection(self.sets, self.folds)

    def stable_trees(self) -> list[trees.Tree]:
        found = self.intersection().orderBy("tree").limit(self.config.model_limit + 1).collect()
        if len(found) > self.config.model_limit:
            raise ValueError(f"over model_limit={self.config.model_limit} trees in all folds: read intersection()")
        return [trees.parse(r.tree) for r in found]

    def features(self) -> DataFrame:
        """(feature, name, fold, trees): how many of a fold's trees use each feature."""
        return features_used(self.sets, [r.name for r in self.rules])


def fold_patterns(df: DataFrame, tests: list, label, classes: list, fold: str = "fold") -> DataFrame:
    """(fold, bits, n_0 ..): for each fold the pattern table of the other folds: the whole less its own."""
    per = kept(pattern_table(df, tests, label, classes, [fold]), "fold-patterns")
    ks = [f"n_{k}" for k in range(len(classes))]
    whole = per.groupBy("bits").agg(*[F.sum(k).alias(f"{k}_all") for k in ks])
    folds = F.broadcast(per.select(fold).distinct())  # a row for each fold
    own = per.select(F.col(fold), "bits", *ks)
    joined = whole.crossJoin(folds).join(own, [fold, "bits"], "left")
    out = joined.select(fold, "bits", *[(F.col(f"{k}_all") - F.coalesce(k, F.lit(0))).alias(k) for k in ks])
    keep = F.lit(0)
    for k in ks:
        keep = keep + F.col(k)
    return out.where(keep > 0)


def _within_limit(trees, config: FitConfig) -> None:
    if int(trees or 0) > config.model_limit:
        raise ValueError(f"{trees} trees in one fold, over model_limit={config.model_limit}")


def _sets_by_levels(patterns: DataFrame, features: int, classes: int, config: FitConfig, folds: int, single_tree: bool) -> DataFrame:
    """(fold, tree, objective, leaves) where the cube can't be made: a search by levels for each fold, one after the other."""
    out = None
    for k in range(1, folds + 1):
        own = kept(patterns.where(F.col("fold") == k).drop("fold"), "fold-patterns")
        grown = levelwise.grow(own, features, classes, config, near=not single_tree, seconds=config.time_limit)
        p = grown.problem
        reach = search.budgets(p, grown.values, p.scale.bound(config, single_tree))
        _within_limit(search.entries(p, reach)[0].agg(F.sum("cnt")).first()[0], config)
        one = search.entries(p, reach, trees=True)[0].select(F.lit(k).alias("fold"), "tree", search.objective(p).alias("objective"), "leaves")
        out = one if out is None else out.unionByName(one)
    return kept(out, "fold-trees")


def cross_fit(df: DataFrame, label: str, features: list[str], config: FitConfig = FitConfig(), folds: int = 5, order: list | None = None, seed: int = 0, single_tree: bool = False) -> CrossFitResult:
    """Fit the near-optimal set (or the tied optima) on each fold's complement; order: what ranks rows for dealing folds."""
    check_binary(df, features)
    rules, classes = binary_rules(features), _classes(df, label)
    order = order or [F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])]
    dealt = stratified_folds(df, label, order, folds)
    patterns = kept(fold_patterns(dealt, rules, F.col(f"`{label}`"), classes), "train-patterns")
    if by_levels(config, len(rules)):
        sets = _sets_by_levels(patterns, len(rules), len(classes), config, folds, single_tree)
    else:
        p = search.problem(patterns, len(rules), len(classes), config, ["fold"])
        levels = search.optimum(p)
        reach = search.budgets(p, levels, p.scale.bound(config, single_tree))
        _within_limit(search.entries(p, reach)[0].groupBy("fold").agg(F.sum("cnt").alias("cnt")).agg(F.max("cnt")).first()[0], config)
        sets = kept(search.entries(p, reach, trees=True)[0].select("fold", "tree", search.objective(p).alias("objective"), "leaves"), "fold-trees")

    whole = kept(pattern_table(dealt, rules, F.col(f"`{label}`"), classes), "patterns")
    return CrossFitResult(folds, config, rules, classes, label, sets, fit_patterns(whole, rules, classes, label, config))


def intersection(sets: DataFrame, folds: int, key: str = "tree") -> DataFrame:
    """Trees of all folds.  The key is the tree's text: structure and predicted classes; leaf shares differ from fold to fold."""
    return sets.groupBy(key).agg(F.count_distinct("fold").alias("folds")).where(F.col("folds") == folds).select(key)


def features_used(sets: DataFrame, names: list[str]) -> DataFrame:
    """(feature, name, fold, trees): how many trees of each fold split on each feature, from their texts."""
    used = sets.select("fold", "tree", F.explode(F.array_distinct(F.regexp_extract_all("tree", F.lit(r"\((\d+)"), F.lit(1)))).alias("feature"))
    counted = used.groupBy("fold", F.col("feature").cast("int").alias("feature")).agg(F.count("*").alias("trees"))
    return counted.withColumn("name", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature") + 1)).select("feature", "name", "fold", "trees")


def compare(a: DataFrame, b: DataFrame, key: str = "tree") -> DataFrame:
    """(part, n): trees in both sets, only in the first, only in the second, and the share of both in all."""
    one, two = a.select(key).distinct(), b.select(key).distinct()
    both = one.select(key, F.lit(1).alias("x")).join(two.select(key, F.lit(1).alias("y")), key, "full")
    row = both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("common"), F.count_if(F.col("y").isNull()).alias("only_first"), F.count_if(F.col("x").isNull()).alias("only_second"))
    return row.withColumn("overlap", F.col("common") / F.greatest(F.lit(1), F.col("common") + F.col("only_first") + F.col("only_second")))


def presence(sets: DataFrame, stable: DataFrame) -> DataFrame:
    """(fold, tree, present) for each fold and each tree of ``stable``."""
    grid = stable.select("tree").distinct().crossJoin(F.broadcast(sets.select("fold").distinct()))  # a row for each fold
    return grid.join(sets.select("fold", "tree", F.lit(True).alias("present")), ["fold", "tree"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def cf_metrics(sets: DataFrame, folds: int) -> DataFrame:
    """(total_folds, average_trees, intersecting, stability): share of the average set that all folds have."""
    sizes = sets.groupBy("fold").agg(F.count("*").alias("trees")).agg(F.avg("trees").alias("average_trees"))
    common = intersection(sets, folds).agg(F.count("*").alias("intersecting"))
    return sizes.crossJoin(common).select(F.lit(folds).alias("total_folds"), "average_trees", "intersecting", (F.col("intersecting") / F.col("average_trees")).alias("stability"))  # one row each


def tune_intersecting(train: DataFrame, features: int, classes: int, config: FitConfig, folds: int, parameter: str, values: list[float]) -> DataFrame:
    """(value, intersecting): how many trees are near-optimal in all folds, for each value of a parameter; one search for all.

    train: patterns of each fold's complement, (fold, bits, n_0 ..).  Penalties are a further key of the
    cells.  Multipliers need no search of their own: a tree is in all sets from the largest of what it
    costs above a fold's optimum.
    """
    table = train.sparkSession.createDataFrame([(float(x),) for x in values], "value double")
    if parameter == "bound_multiplier":
        widest = config.with_(bound=0.0, bound_adder=0.0, bound_multiplier=max(values))
        p = search.problem(train, features, classes, widest, ["fold"])
        levels = search.optimum(p)
        found = search.entries(p, search.budgets(p, levels, p.scale.bound(widest)), trees=True)[0]
        above = found.join(levels[0].select("fold", "v"), "fold").select("tree", "fold", (search.units(p) / F.col("v") - 1).alias("above"))
        needed = kept(above.groupBy("tree").agg(F.max("above").alias("needed"), F.count("*").alias("folds")).where(F.col("folds") == folds), "needed")
        return table.join(needed, F.col("needed") <= F.col("value") + search.TOLERANCE, "left").groupBy("value").agg(F.count("tree").alias("intersecting"))
    if parameter != "regularization":
        raise ValueError("parameter: bound_multiplier or regularization")
    least = config.with_(regularization=min(values))
    p = search.over_settings(search.problem(train, features, classes, least, ["fold"]), values)
    levels = search.optimum(p)
    found = search.entries(p, search.budgets(p, levels, p.scale.bound(least)), trees=True)[0]
    common = found.groupBy("setting", "tree").agg(F.count("*").alias("folds")).where(F.col("folds") == folds)
    counted = common.groupBy("setting").agg(F.count("*").alias("n"))
    numbered = train.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "setting int, value double")
    return numbered.join(counted, "setting", "left").select("value", F.coalesce("n", F.lit(0).cast("long")).alias("intersecting"))


@dataclass
class TunedCrossFit:
    """value: the least one met at which folds share enough trees; tried: all (value, trees shared)."""

    fit: CrossFitResult
    value: float
    intersecting: int
    converged: bool
    tried: list[tuple[float, int]]


def auto_tune_intersecting(df: DataFrame, label: str, features: list[str], target: int = 1, parameter: str = "regularization", config: FitConfig = FitConfig(), folds: int = 5, search_range: tuple[float, float] | None = None, settings: int = 8, rounds: int = 3, seed: int = 0) -> TunedCrossFit:
    """Cross-fit at the least penalty, or bound, at which ``target`` trees are near-optimal in all folds.

    A larger penalty makes for simpler trees, a larger bound for more of them; either way folds share more.  Each
    round tries ``settings`` values of a range in one search and goes on between the last that fails and the first that does.
    """
    from coppice.operators.tune import RANGES

    check_binary(df, features)
    rules, classes = binary_rules(features), _classes(df, label)
    dealt = stratified_folds(df, label, [F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])], folds)
    train = kept(fold_patterns(dealt, rules, F.col(f"`{label}`"), classes), "train-patterns")
    low, high = search_range or RANGES[parameter, config.loss]
    tried: dict[float, int] = {}
    for _ in range(rounds):
        values = [round(low + (high - low) * i / (settings - 1), 9) for i in range(settings)]
        rows = tune_intersecting(train, len(rules), len(classes), config, folds, parameter, values).collect()  # a row a value
        tried.update({r.value: r.intersecting for r in rows})
        good = [v for v in values if tried[v] >= target]
        if not good or good[0] == values[0]:
            break
        low, high = values[values.index(good[0]) - 1], good[0]
    enough = [v for v, n in tried.items() if n >= target]
    value = min(enough) if enough else max(tried, key=lambda v: (tried[v], -v))
    chosen = {"bound": 0.0, "bound_adder": 0.0, "bound_multiplier": value} if parameter == "bound_multiplier" else {"regularization": value}
    return TunedCrossFit(cross_fit(df, label, features, config.with_(**chosen), folds, seed=seed), value, tried[value], bool(enough), sorted(tried.items()))
