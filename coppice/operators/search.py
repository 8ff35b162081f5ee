"""The optimum and the near-optimal set, level by level over the cells of a cube.

A cell is a conjunction of literals with its class counts.  All quantities of the
search are sums over cells, so after the pattern table nothing reads rows again.
Three passes: best objectives from many literals to few, budgets from few to many
(how much a subtree may cost within the bound), entries from many to few.

Objectives are whole numbers wherever they fit 62 bits: errors (or costs) and the
penalty of a leaf are brought to one denominator, so ties are told exactly at any number
of rows.  Log-loss, and what doesn't fit, goes by doubles with a relative tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from coppice.config import FitConfig
from coppice.functions import masks
from coppice.functions.losses import balanced_costs, leaf_columns, total
from coppice.sources.work import kept

TOLERANCE = 1e-9
#: Pattern rows times feature sets up to which counting runs on the JVM by repeating rows; above it numpy counts in place.
SPREAD_ROWS = 20_000_000
SPREAD_MASKS = 2_000
#: Rows that numpy counts at once.
COUNT_ROWS = 1 << 17


@dataclass(frozen=True)
class Scale:
    """How an objective is counted.

    exact: in whole numbers.  costs: an error's cost for each prediction and class.  A leaf
    costs ``leaf``, and ``per`` is what stands for an objective of 1; both for each row of the
    table where ``by_rows``.
    """

    exact: bool
    costs: list[list[int]] | None
    leaf: int | float
    per: int | float
    by_rows: bool
    settings: tuple | None = None  # what a leaf costs under each of several penalties, by the key ``setting``

    def leaf_cost(self) -> Column:
        leaf = F.element_at(F.array(*[F.lit(x) for x in self.settings]), F.col("setting") + 1) if self.settings else F.lit(self.leaf)
        return leaf * F.col("rows_of_key") if self.by_rows else leaf

    def one(self) -> Column:
        return F.lit(self.per) * F.col("rows_of_key") if self.by_rows else F.lit(self.per)

    def shown(self, value: Column | str) -> Column:
        """An objective as the number that options speak of."""
        return F.round((F.col(value) if isinstance(value, str) else value) / self.one(), 12)

    def within(self, value: Column, room: Column) -> Column:
        return value <= room if self.exact else value <= room + F.lit(TOLERANCE) * F.greatest(F.lit(1.0), F.abs(room))

    def part(self, whole: Column, share: float) -> Column:
        """``share`` of a value, rounded down where values are whole."""
        if not self.exact:
            return whole * F.lit(float(share))
        x = Fraction(str(share))
        wide = (whole.cast("decimal(19,0)") * F.lit(x.numerator).cast("decimal(18,0)")).cast("decimal(38,0)")
        down = F.lit(x.denominator).cast("decimal(18,0)")
        return ((wide - wide % down) / down).cast("long")

    def bound(self, config: FitConfig, single_tree: bool = False) -> Column:
        """What trees may cost, from v, the optimum."""
        v = F.col("v")
        if single_tree:
            return v
        if config.bound:
            return self.part(self.one(), config.bound)
        if config.bound_adder:
            return v + self.part(self.one(), config.bound_adder)
        return v + self.part(v, config.bound_multiplier or 0.05)


@dataclass
class Problem:
    """Cells of one table, or of one table per key, with their leaf columns."""

    cells: DataFrame
    features: int
    classes: int
    depth: int  # most literals of a cell
    rows: int
    costs: list[list[float]] | None
    config: FitConfig
    keys: list[str]
    scale: Scale
    class_rows: list[int]

    def level(self, k: int) -> DataFrame:
        return self.cells.where(F.col("k") == k)


def literal_limit(features: int, config: FitConfig) -> int:
    return features if not config.max_depth else min(features, config.max_depth - 1)


def scale_of(config: FitConfig, class_rows: list[int], costs: list[list[float]] | None) -> Scale:
    """Whole numbers where errors, costs and penalties fit them."""
    classes, rows = len(class_rows), max(1, sum(class_rows))
    penalty = Fraction(str(config.regularization))
    if config.loss == "misclassification":
        if costs is None:
            per, by_rows = penalty.denominator, True
            table = [[0 if i == j else per for j in range(classes)] for i in range(classes)]
            most = rows * per
        else:
            exact = [[Fraction(0) if i == j else Fraction(1, classes * max(class_rows[j], 1)) if config.balance else Fraction(str(costs[i][j])) for j in range(classes)] for i in range(classes)]
            if not config.balance:
                exact = [[Fraction(str(x)) for x in r] for r in costs]
            per, by_rows = lcm(penalty.denominator, *[x.denominator for r in exact for x in r]), False
            table = [[int(x * per) for x in r] for r in exact]
            most = max(max(map(abs, r)) for r in table) * rows
        leaf = int(penalty * per)
        widest = most + leaf * (rows if by_rows else 1) * 2**10
        if max(widest, per * (rows if by_rows else 1)) < 1 << 62:
            return Scale(True, table, leaf, per, by_rows)
    return Scale(False, None, config.regularization, 1.0, False)


def _spread(patterns: DataFrame, features: int, classes: int, depth: int, keys: list[str]) -> DataFrame:
    sets = ", ".join(f"{m}L" for m in masks.care_masks(features, depth))  # as text: a call to the JVM for each of them takes longer than the query
    ns = [f"n_{k}" for k in range(classes)]
    return patterns.selectExpr(*keys, f"explode(array({sets})) AS care", "bits", *ns).selectExpr(*keys, "care", "bits & care AS val", *ns)


def _counted(patterns: DataFrame, features: int, classes: int, depth: int, keys: list[str]) -> DataFrame:
    """The same counts, added up in each task: it sends a row for each cell it met, not for each row and feature set."""
    ns = [f"n_{k}" for k in range(classes)]
    own = patterns.select(*keys, "bits", *ns)
    schema = T.StructType([*[own.schema[k] for k in keys], T.StructField("care", T.LongType()), T.StructField("val", T.LongType()), *[T.StructField(n, T.LongType()) for n in ns]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, dict[tuple, np.ndarray]] = {}

        def add(table: pa.Table) -> None:
            bits = table.column("bits").to_numpy()
            weights = [table.column(n).to_numpy().astype(np.float64) for n in ns]
            flags = [((bits >> f) & 1).astype(np.int32) for f in range(features)]
            names = list(zip(*[table.column(k).to_pylist() for k in keys], strict=True)) if keys else [()] * len(bits)
            for name in set(names):
                inside = slice(None) if len(set(names)) == 1 else np.array([x == name for x in names])
                own_weights, own_flags, cells = [w[inside] for w in weights], [f[inside] for f in flags], sums.setdefault(name, {})

                def walk(chosen: tuple, code: np.ndarray) -> None:
                    n = np.stack([np.bincount(code, w, 1 << len(chosen)) for w in own_weights]).astype(np.int64)
                    cells[chosen] = cells[chosen] + n if chosen in cells else n
                    if len(chosen) < depth:
                        for f in range(chosen[-1] + 1 if chosen else 0, features):
                            walk((*chosen, f), code * 2 + own_flags[f])

                walk((), np.zeros(len(own_weights[0]), np.int32))

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= COUNT_ROWS:
                add(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            add(pa.Table.from_batches(held))
        for name, cells in sums.items():
            care, val, counts = [], [], []
            for chosen, n in cells.items():
                met = np.flatnonzero(n.any(axis=0))
                value = np.zeros(len(met), np.int64)
                for place, f in enumerate(reversed(chosen)):
                    value |= ((met >> place) & 1) << f
                care.append(np.full(len(met), sum(1 << f for f in chosen), np.int64))
                val.append(value)
                counts.append(n[:, met])
            counts = np.concatenate(counts, axis=1)
            arrays = [pa.array([x] * counts.shape[1], own_type) for x, own_type in zip(name, [pa_types[k] for k in keys], strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate(care)), pa.array(np.concatenate(val)), *[pa.array(x) for x in counts]], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_types = {k: to_arrow_type(own.schema[k].dataType) for k in keys}
    return own.mapInArrow(scan, schema)


def cell_counts(patterns: DataFrame, features: int, classes: int, depth: int, keys: list[str] = (), rows: int | None = None) -> DataFrame:
    """(keys, care, val, k, n_0 ..): counts of every conjunction of at most ``depth`` literals that has rows.

    rows: how many patterns there are, if known: with many, or with many sets of features,
    tasks add up cells themselves instead of repeating each pattern for each set.
    """
    sets = masks.sets_bound(features, depth)
    by_task = sets > SPREAD_MASKS or (rows is not None and rows * sets > SPREAD_ROWS)
    met = (_counted if by_task else _spread)(patterns, features, classes, depth, list(keys))
    grouped = met.groupBy(*keys, "care", "val").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in range(classes)])
    return grouped.withColumn("k", masks.literals(F.col("care"))).where(total(classes) > 0)


def _leaf(classes: int, config: FitConfig, costs: list[list[float]] | None, scale: Scale) -> dict[str, Column]:
    """prediction, falses, cost and leaf_objective of a cell made a leaf; the highest class of those that cost least."""
    if not scale.exact:
        leaf = leaf_columns(classes, config.loss, costs, 1.0)
        return {"prediction": leaf["prediction"], "falses": leaf["falses"], "cost": leaf["loss"], "leaf_objective": F.round(leaf["loss"] + scale.leaf_cost(), 12)}
    worth = [" + ".join([f"{price}L * n_{j}" for j, price in enumerate(prices) if price]) or "0L" for prices in scale.costs]
    top = f"least({', '.join(worth)})" if classes > 1 else worth[0]
    chosen = lambda values: "CASE " + " ".join(f"WHEN {worth[k]} = {top} THEN {values[k]}" for k in reversed(range(classes))) + " END"
    right = chosen([f"n_{k}" for k in range(classes)])
    return {"prediction": F.expr(chosen(list(range(classes)))).cast("int"), "falses": F.expr(f"cast({' + '.join(f'n_{k}' for k in range(classes))} - {right} AS bigint)"), "cost": F.expr(top), "leaf_objective": F.expr(top) + scale.leaf_cost()}


def _finished(counts: DataFrame, classes: int, config: FitConfig, costs: list[list[float]] | None, scale: Scale) -> DataFrame:
    """Cells with their leaf columns for a config; they hold counts, so another config needs no new cells."""
    return counts.withColumns(_leaf(classes, config, costs, scale))


def depth_needed(sizes: list, classes: int, config: FitConfig, scale: Scale) -> int | None:
    """The most splits on a path that a tree within the bound can have, or None for no limit.

    A path of k splits has k + 1 leaves at least, and no tree costs less than rows of equal
    patterns do that aren't told apart; no bound is above that of the single leaf.
    """
    if not scale.leaf:
        return None
    most = 0
    for r in sizes:
        n = [int(r[f"n_{k}"] or 0) for k in range(classes)]
        rows = max(1, sum(n))
        leaf, per = (x * (rows if scale.by_rows else 1) for x in (scale.leaf, scale.per))
        alone = float(r.alone or 0) + leaf
        bound = max(alone, config.bound * per, alone + config.bound_adder * per, alone * (1 + (config.bound_multiplier or 0.05)))
        most = max(most, int((bound * (1 + 1e-9) - float(r.least or 0)) / leaf) - 1 if leaf else 0)
    return most


def problem(patterns: DataFrame, features: int, classes: int, config: FitConfig, keys: list[str] = (), class_rows: list[int] | None = None) -> Problem:
    """Cells and leaf columns.  With keys, ``class_rows`` still belongs to the whole table and unit costs to each key's rows."""
    if masks.wide(features):
        raise ValueError(f"over {masks.MOST_FEATURES} features: the search by levels takes them (levelwise.grow), not the cube")
    ns = [F.sum(f"n_{k}").alias(f"n_{k}") for k in range(classes)]
    if class_rows is None:
        class_rows = [int(x or 0) for x in patterns.agg(*ns).first()]
    rows = sum(class_rows)
    costs = [list(r) for r in config.costs] if config.costs else balanced_costs(class_rows) if config.balance else None
    if costs is not None and len(costs) != classes:
        raise ValueError(f"costs for {len(costs)} classes, the label has {classes}")
    scale = scale_of(config, class_rows, costs)
    keys = list(keys)
    # One row a key: what all of it costs as one leaf, and with each pattern its own leaf.
    own = patterns.withColumn("rows_of_key", total(classes)).withColumns(_leaf(classes, config, costs, scale))
    least = own.groupBy(*keys).agg(*ns, F.sum("cost").alias("least"), F.count("*").alias("patterns"))
    sizes = least.withColumn("rows_of_key", total(classes)).withColumns({"alone": _leaf(classes, config, costs, scale)["cost"]}).collect()
    depth, needed = literal_limit(features, config), depth_needed(sizes, classes, config, scale)
    depth = depth if needed is None else max(0, min(depth, needed))
    if masks.cells_bound(features, depth) > config.max_cells:
        raise ValueError(f"{features} features at {depth} splits have up to {masks.cells_bound(features, depth)} cells: give a max_depth or a larger regularization, or raise max_cells")
    cells = cell_counts(patterns, features, classes, depth, keys, sum(r.patterns for r in sizes))
    if keys:
        sized = patterns.sparkSession.createDataFrame([(*[r[k] for k in keys], sum(int(r[f"n_{k}"]) for k in range(classes))) for r in sizes], T.StructType([*[patterns.schema[k] for k in keys], T.StructField("rows_of_key", T.LongType())]))
        cells = cells.join(F.broadcast(sized), keys)  # a row for each key, as the driver just met them
    else:
        cells = cells.withColumn("rows_of_key", F.lit(rows).cast("long"))
    cells = kept(cells.withColumn("n_total", total(classes)), "cells")
    return Problem(_finished(cells, classes, config, costs, scale), features, classes, depth, rows, costs, config, keys, scale, class_rows)


def retuned(p: Problem, config: FitConfig) -> Problem:
    """The problem under another penalty or bound, on the cells that are there; its trees mustn't need deeper ones."""
    scale = scale_of(config, p.class_rows, p.costs)
    counts = p.cells.drop("prediction", "falses", "cost", "leaf_objective")
    return replace(p, cells=_finished(counts, p.classes, config, p.costs, scale), config=config, scale=scale)


def over_settings(p: Problem, penalties: list[float]) -> Problem:
    """The problem under each of several penalties at once: ``setting``, the place of the penalty, is a further key of its cells."""
    exact = [Fraction(str(x)) for x in penalties]
    digits = 0
    while any((x * 10**digits).denominator != 1 for x in exact):
        digits += 1
    scale = scale_of(p.config.with_(regularization=float(Fraction(1, 10**digits))), p.class_rows, p.costs)
    own = [int(x * scale.per) for x in exact] if scale.exact else [float(x) for x in penalties]
    scale = replace(scale, leaf=min(own), settings=tuple(own))
    counts = p.cells.drop("prediction", "falses", "cost", "leaf_objective")
    counts = counts.withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(penalties) - 1))))
    return replace(p, cells=_finished(counts, p.classes, p.config, p.costs, scale), keys=[*p.keys, "setting"], scale=scale)


def split_pairs(p: Problem, above: DataFrame, below: DataFrame, left: list[Column], right: list[Column], carry: list[str]) -> DataFrame:
    """Each cell of ``above`` with each feature it leaves free and the rows of ``below`` on both sides.

    left and right: columns of ``below`` to take from the side where the feature fails and
    where it holds.  A side without rows has no cell, so the split isn't there.
    """
    wide = masks.wide(p.features)
    if not p.features:
        free = "cast(array() AS array<int>)"
    elif wide:
        free = f"filter(sequence(0, {p.features - 1}), k -> shiftright(care[cast(k / {masks.WORD} AS int)], k % {masks.WORD}) & 1L = 0)"
    else:
        free = f"filter(sequence(0, {p.features - 1}), k -> shiftright(care, k) & 1L = 0)"
    spread = above.select(*p.keys, "care", "val", *carry, F.expr(f"explode({free}) AS feature"))
    spread = spread.withColumns({"child_care": masks.plus("care", "feature", wide), "child_true": masks.plus("val", "feature", wide)})
    lo = below.select(*p.keys, F.expr("care AS child_care"), "val", *left)
    hi = below.select(*p.keys, F.expr("care AS child_care"), F.expr("val AS child_true"), *right)
    return spread.join(lo, [*p.keys, "child_care", "val"]).join(hi, [*p.keys, "child_care", "child_true"])


def _supported(p: Problem, pairs: DataFrame) -> DataFrame:
    m = p.config.min_support
    if not m:
        return pairs
    enough = lambda c: F.least(F.col(c), F.col("rows_of_key") - F.col(c)) > m
    return pairs.where(enough("n_l") & enough("n_r"))


def _both(*columns: str) -> list[list[Column]]:
    """What to take from the left and from the right side, with ``_l`` and ``_r`` behind its name."""
    return [[F.expr(f"{c} AS {'n' if c == 'n_total' else 'leaf' if c == 'leaf_objective' else c}_{s}") for c in columns] for s in "lr"]


def _tidy(p: Problem, value: Column) -> Column:
    return value if p.scale.exact else F.round(value, 12)


def optimum(p: Problem) -> list[DataFrame]:
    """For each number of literals, the cells with v, the best objective of a tree there."""
    levels = {p.depth: p.level(p.depth).withColumn("v", F.col("leaf_objective"))}
    for k in reversed(range(p.depth)):
        own = p.level(k)
        pairs = _supported(p, split_pairs(p, own, levels[k + 1], *_both("v", "n_total", "leaf_objective"), ["rows_of_key"]))
        value = F.col("v_l") + F.col("v_r")
        if p.config.rule_list:
            value = F.least(F.col("leaf_l") + F.col("v_r"), F.col("v_l") + F.col("leaf_r"))
        best = pairs.groupBy(*p.keys, "care", "val").agg(F.min(value).alias("split_v"))
        done = own.join(best, [*p.keys, "care", "val"], "left").withColumn("v", _tidy(p, F.least("leaf_objective", F.coalesce("split_v", "leaf_objective")))).drop("split_v")
        levels[k] = kept(done, "best") if k else kept(done, "best").coalesce(1)  # a row for each key
    return [levels[k] for k in range(p.depth + 1)]


def best(p: Problem, levels: list[DataFrame]) -> float:
    """The optimum of a table without keys, as options speak of it."""
    return float(levels[0].select(p.scale.shown("v")).first()[0])


def best_splits(p: Problem, level: DataFrame, below: DataFrame) -> DataFrame:
    """(keys, care, val, feature, objective) of every split of a level's cells."""
    pairs = _supported(p, split_pairs(p, level, below, *_both("v", "n_total"), ["rows_of_key"]))
    return pairs.select(*p.keys, "care", "val", "feature", p.scale.shown(F.col("v_l") + F.col("v_r")).alias("objective"))


def budgets(p: Problem, levels: list[DataFrame], bound: Column) -> list[DataFrame]:
    """The cells a tree within the bound can reach, with ``room``, the most its subtree there may cost.  bound: over columns of the first level."""
    top = levels[0].withColumn("room", bound)
    out = [top.where(p.scale.within(F.col("v"), F.col("room")))]
    for k in range(p.depth):
        pairs = _supported(p, split_pairs(p, out[k], levels[k + 1], *_both("v", "n_total"), ["rows_of_key", "room"]))
        pairs = pairs.where(p.scale.within(F.col("v_l") + F.col("v_r"), F.col("room")))
        both = "explode(array(struct(child_care AS care, val, room - v_r AS room), struct(child_care AS care, child_true AS val, room - v_l AS room))) AS x"
        room = pairs.selectExpr(*p.keys, both).select(*p.keys, "x.*").groupBy(*p.keys, "care", "val").agg(F.max("room").alias("room"))
        out.append(kept(levels[k + 1].join(room, [*p.keys, "care", "val"]), "room"))
    return out


_SUMS = ("cost", "falses", "tp", "tn", "leaves")


def _leaf_entries(p: Problem, cells: DataFrame, trees: bool) -> DataFrame:
    tp, tn = ("if(prediction = 1, n_1, 0)", "if(prediction = 0, n_0, 0)") if p.classes == 2 else ("n_total - falses", "0")
    out = cells.where(p.scale.within(F.col("leaf_objective"), F.col("room")))
    return out.selectExpr(*p.keys, "care", "val", "rows_of_key", "-1 AS feature", "prediction AS leaf", "cost", "falses", f"cast({tp} AS bigint) AS tp", f"cast({tn} AS bigint) AS tn", "1 AS leaves", "cast(1 AS decimal(38,0)) AS cnt", *(["cast(prediction AS string) AS tree"] if trees else []))


def _first(p: Problem, splits: DataFrame, most: int | None) -> DataFrame:
    """A cell's best ``most`` + 1 splits (a leaf may be barred beside its like); what a whole tree among the best needs of a cell is among them and its leaf."""
    if most is None:
        return splits
    order = Window.partitionBy(*p.keys, "care", "val").orderBy(units(p), "leaves", F.length("tree"), "tree")
    return splits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most + 1).drop("nth")  # Spark cuts to so many in each task, before the shuffle


def entries(p: Problem, reach: list[DataFrame], trees: bool = False, most: int | None = None) -> list[DataFrame]:
    """For each level, the subtrees within each cell's room.

    Without trees they are counted in clusters of equal (feature, leaf, cost, falses, tp,
    tn, leaves); with trees each has its text: a class for a leaf, else (feature true false).
    Leaves and splits stay apart, so a split into two leaves of one class is told exactly.
    most: with trees, how many of the best are wanted; cells then keep no more than those need.
    """
    out = {p.depth: _leaf_entries(p, reach[p.depth], trees)}
    for k in reversed(range(p.depth)):
        below = out[k + 1]
        if not trees:  # the children's own feature doesn't matter above
            below = below.groupBy(*p.keys, "care", "val", "leaf", *_SUMS).agg(F.sum("cnt").cast("decimal(38,0)").alias("cnt"))
        sides = [[F.expr(f"{c} AS {c}_{s}") for c in ("leaf", *_SUMS, "cnt", *(["tree"] if trees else []))] for s in "lr"]
        if p.config.min_support:
            below = below.join(p.cells.select(*p.keys, "care", "val", F.col("n_total").alias("n")), [*p.keys, "care", "val"])
            sides = [[*side, F.col("n").alias(f"n_{s}")] for side, s in zip(sides, "lr", strict=True)]
        pairs = _supported(p, split_pairs(p, reach[k], below, *sides, ["room", "rows_of_key"]))
        pairs = pairs.withColumns({c: F.expr(f"{c}_l + {c}_r") for c in _SUMS})
        pairs = pairs.withColumn("cost", _tidy(p, F.col("cost")))
        pairs = pairs.where(p.scale.within(F.col("cost") + p.scale.leaf_cost() * F.col("leaves"), F.col("room")))
        if p.config.ignore_trivial:
            pairs = pairs.where(~F.coalesce(F.col("leaf_l") == F.col("leaf_r"), F.lit(False)))
        if p.config.rule_list:
            pairs = pairs.where(F.col("leaf_l").isNotNull() | F.col("leaf_r").isNotNull())
        none = F.lit(None).cast("int").alias("leaf")
        if trees:
            text = F.expr("concat('(', feature, ' ', tree_r, ' ', tree_l, ')')")
            splits = pairs.select(*p.keys, "care", "val", "rows_of_key", "feature", none, *_SUMS, F.lit(1).cast("decimal(38,0)").alias("cnt"), text.alias("tree"))
        else:
            splits = pairs.groupBy(*p.keys, "care", "val", "rows_of_key", "feature", *_SUMS).agg(F.sum(F.col("cnt_l") * F.col("cnt_r")).cast("decimal(38,0)").alias("cnt")).select(*p.keys, "care", "val", "rows_of_key", "feature", none, *_SUMS, "cnt")
        own = _leaf_entries(p, reach[k], trees).unionByName(_first(p, splits, most))
        out[k] = kept(own, "entries") if k else own  # what a level above reads twice is stored
    return [out[k] for k in range(p.depth + 1)]


def units(p: Problem) -> Column:
    """The objective of an entry, as it is counted."""
    return _tidy(p, F.col("cost") + p.scale.leaf_cost() * F.col("leaves"))


def objective(p: Problem) -> Column:
    return p.scale.shown(F.col("cost") + p.scale.leaf_cost() * F.col("leaves"))


def root_clusters(p: Problem, found: list[DataFrame]) -> DataFrame:
    """(keys, objective, units, loss, falses, tp, tn, leaves, trees): how many trees share each outcome."""
    own = found[0].groupBy(*p.keys, "rows_of_key", *_SUMS).agg(F.sum("cnt").cast("decimal(38,0)").alias("trees"))
    return own.select(*p.keys, objective(p).alias("objective"), units(p).alias("units"), p.scale.shown("cost").alias("loss"), *_SUMS[1:], "trees")


def dag_edges(p: Problem, levels: list[DataFrame], reach: list[DataFrame], found: list[DataFrame]) -> DataFrame:
    """(keys, care, val, feature, child_care, false_val, true_val): the splits that trees within the bound have.

    found: the entries, so support, trivial splits and rule lists count as they do there.
    A subtree's split is in a tree if the cheapest subtree with it fits what the cheapest
    rest of the tree leaves; in a rule list the other side of a split is a leaf.
    """
    out, room = None, reach[0].select(*p.keys, "care", "val", "rows_of_key", "room")
    sibling = "leaf" if p.config.rule_list else "v"
    for k in range(p.depth):
        least = found[k].where("feature >= 0").groupBy(*p.keys, "care", "val", "feature").agg(F.min(units(p)).alias("least"), F.first("rows_of_key").alias("rows"))
        used = least.join(room, [*p.keys, "care", "val"]).where(p.scale.within(F.col("least"), F.col("room")))
        pairs = split_pairs(p, room, levels[k + 1], *_both("v", "leaf_objective"), ["room"]).join(used.select(*p.keys, "care", "val", "feature"), [*p.keys, "care", "val", "feature"])
        edges = pairs.select(*p.keys, "care", "val", "feature", "child_care", F.col("val").alias("false_val"), F.col("child_true").alias("true_val"))
        out = edges if out is None else out.unionByName(edges)
        sides = [pairs.select(*p.keys, F.col("child_care").alias("care"), F.col(at).alias("val"), (F.col("room") - F.col(f"{sibling}_{other}")).alias("room")) for at, other in (("val", "r"), ("child_true", "l"))]
        below = sides[0].unionByName(sides[1]).groupBy(*p.keys, "care", "val").agg(F.max("room").alias("room"))
        room = kept(levels[k + 1].select(*p.keys, "care", "val", "rows_of_key").join(below, [*p.keys, "care", "val"]), "edge-room")
    if out is None:
        none = reach[0].where("false")
        return none.select(*p.keys, "care", "val", F.lit(0).alias("feature"), F.col("care").alias("child_care"), F.col("val").alias("false_val"), F.col("val").alias("true_val"))
    return out


def greedy(p: Problem) -> str:
    """The tree that takes the split with the largest fall of loss at each step, as text; a baseline, not the optimum.  One job a level."""
    from coppice.operators.trees import Tree

    spark = p.cells.sparkSession
    mask = masks.sql_type(p.features)
    split: dict[tuple[int, int], int] = {}
    leaves: dict[tuple[int, int], int] = {}
    front = [(0, 0)]
    for k in range(p.depth + 1):
        if not front:
            break
        asked = [tuple(masks.stored_form(x, p.features) for x in cell) for cell in front]
        own = p.level(k).join(F.broadcast(spark.createDataFrame(asked, f"care {mask}, val {mask}")), ["care", "val"])  # 2^k cells at most
        leaves.update({(masks.number(r.care), masks.number(r.val)): r.prediction for r in own.select("care", "val", "prediction").collect()})
        if k == p.depth:
            break
        pairs = _supported(p, split_pairs(p, own.withColumn("own_cost", F.col("cost")), p.level(k + 1), *_both("cost", "n_total"), ["rows_of_key", "own_cost"]))
        fall = F.col("own_cost") - F.col("cost_l") - F.col("cost_r")
        best_of = pairs.groupBy("care", "val").agg(F.min(F.struct((-_tidy(p, fall)).alias("loss"), "feature", "rows_of_key")).alias("x"))
        taken = best_of.where(-F.col("x.loss") > (F.lit(p.scale.leaf) * F.col("x.rows_of_key") if p.scale.by_rows else F.lit(p.scale.leaf))).select("care", "val", "x.feature").collect()
        taken = [(masks.number(r.care), masks.number(r.val), r.feature) for r in taken]
        split.update({(care, val): f for care, val, f in taken})
        front = [(care | 1 << f, val | side << f) for care, val, f in taken for side in (0, 1)]

    def grow(care: int, val: int) -> Tree:
        f = split.get((care, val))
        if f is None:
            return Tree(None, None, None, leaves[care, val])
        return Tree(f, grow(care | 1 << f, val | 1 << f), grow(care | 1 << f, val), None)

    return grow(0, 0).text()
