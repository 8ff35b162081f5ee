"""The search by levels: the same answers as plain enumeration, with fewer cells; wide tables; limits."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_search import CASES, every, rows_of

from coppice.config import FitConfig
from coppice.functions import masks
from coppice.operators import levelwise, search, trees
from coppice.operators.encode import pattern_table
from coppice.operators.fit import fit, fit_rashomon, fit_tree, predict
from coppice.sources.work import kept


@pytest.mark.parametrize(("seed", "n", "p", "classes", "cfg"), [c for c in CASES if c[0] in (1, 5, 11)])
def test_set_is_that_of_enumeration(spark, seed, n, p, classes, cfg):
    data = rows_of(seed, n, p, classes)
    names = [f"x{i}" for i in range(p)]
    depth = cfg.max_depth - 1 if cfg.max_depth else p
    trees_ = every(data, data, list(range(p)), cfg, classes, depth)
    best = min(v for _, v, _ in trees_)
    bound = cfg.rashomon_bound(best)
    want = Counter({t: 1 for t, v, _ in trees_ if v <= bound + 1e-9})
    model = fit_rashomon(spark.createDataFrame(data, [*names, "y"]), "y", names, cfg.with_(search="levels"))
    assert abs(model.objective - best) < 1e-9 and model.finished and model.gap == 0
    assert Counter(t.text() for t in model.trees) == want
    assert model.n_trees == len(want) and model.n_optimal == sum(v <= best + 1e-9 for _, v, _ in trees_)
    splits = {(care, val, n.feature) for t in want for _, care, val, n in trees.parse(t).cells() if n.feature is not None}
    assert {(r.care, r.val, r.feature) for r in model.edges.collect()} == splits


def table(spark, seed, n, p, noise=0.1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [int(rng.random() < 0.5) for _ in range(p)]
        y = (x[p - 1] & x[3]) | (x[p // 2] & (1 - x[1]))
        rows.append((*x, y if rng.random() > noise else 1 - y))
    return spark.createDataFrame(rows, [*[f"x{i}" for i in range(p)], "y"]), rows


def test_optimum_and_ties_as_over_the_cube(spark):
    for seed, cfg in ((1, FitConfig(regularization=0.02, max_depth=4, min_support=5)),):
        df, _ = table(spark, seed, 300, 8, 0.25)
        names = df.columns[:-1]
        cube, levels = (fit(df, "y", names, config=cfg.with_(search=s)) for s in ("cube", "levels"))
        assert abs(cube.objective - levels.objective) < 1e-9 and cube.n_optimal == levels.n_optimal and cube.tree == levels.tree
        made = levels.levels.agg(F.sum("cells")).first()[0]
        assert made < masks.cells_bound(8, cfg.max_depth - 1)


def test_over_sixty_two_features(spark):
    df, rows = table(spark, 5, 400, 70, 0.05)
    names, cfg = df.columns[:-1], FitConfig(regularization=0.02, max_depth=3)
    model = fit_rashomon(df, "y", names, cfg.with_(bound_multiplier=0.1))
    assert model.tree.depth() == 2 and len(model.tree.features() & {69, 3, 35, 1}) >= 2
    assert model.n_trees == len(model.trees) == model.clusters.agg(F.sum("trees")).first()[0]

    def walk(t, r):
        return t.prediction if t.feature is None else walk(t.true if r[t.feature] else t.false, r)

    errors = sum(walk(model.tree, r) != r[-1] for r in rows)
    assert abs(model.objective - (errors / len(rows) + 0.02 * model.tree.leaves())) < 1e-9
    got = predict(model, df).collect()
    assert all(r.prediction == walk(model.tree, tuple(r)) for r in got)


def test_five_levels_of_sixty_two(spark):
    rng = random.Random(6)
    sides = [[rng.randrange(2) for _ in range(62)] for _ in range(60)]  # sixty kinds of rows, each many times
    df = spark.createDataFrame([(*x, int(rng.random() < (0.95 if (x[61] & x[3]) | (x[31] & (1 - x[1])) else 0.05))) for x in sides for _ in range(30)], [*[f"x{i}" for i in range(62)], "y"])
    model = fit_tree(df, "y", df.columns[:-1], FitConfig(regularization=0.03, max_depth=6))
    assert model.finished and model.tree.depth() >= 2
    log = model.levels.orderBy("level").collect()
    assert [r.level for r in log] == list(range(len(log))) and all(r.lower <= model.objective + 1e-9 <= r.upper + 2e-9 for r in log)
    assert all(a.lower <= b.lower + 1e-9 and a.upper >= b.upper - 1e-9 for a, b in zip(log, log[1:], strict=False))
    assert sum(r.cells for r in log) < masks.cells_bound(62, 5) / 100


def test_rules_made_of_a_wide_column(spark):
    df = spark.range(600).selectExpr("id % 90 AS a", "id % 7 AS b", "concat('k', id % 3) AS c", "int((id % 90 >= 40 AND id % 7 < 3) OR id % 3 = 1) AS y")
    model = fit_tree(df, "y", config=FitConfig(regularization=0.01, max_depth=4))
    assert len(model.rules) == 90 + 7 + 3 and abs(model.objective - 0.04) < 1e-9
    assert {model.rules[f].name for f in model.tree.features()} == {"a>=40.0", "b>=3.0", "c==k1"}
    assert predict(model, df).where("prediction <> y").count() == 0


def test_masks_of_both_widths(spark):
    for p in (62, 130):
        rng = random.Random(p)
        marks = sorted(rng.sample(range(p), 3))
        own = spark.range(1).select(masks.of_bits(F.array(*[F.lit(k) for k in marks]), p).alias("made"), masks.of_bits(F.array(*[F.lit(k) for k in marks[:2]]), p).alias("two"), F.lit(marks[2]).alias("third"))
        row = own.select("made", masks.pack([F.lit(k in marks) for k in range(p)]).alias("packed"), masks.plus("two", "third", masks.wide(p)).alias("more"), masks.literals(F.col("made"), masks.wide(p)).alias("n"), F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: masks.is_set(F.col("made"), k, masks.wide(p))).alias("set")).first()
        value = sum(1 << k for k in marks)
        assert {masks.number(x) for x in (row.packed, row.made, row.more)} == {value} and row.n == 3 and [k for k in range(p) if row.set[k]] == marks
        assert masks.number(masks.stored_form(value, p)) == value


def test_upper_bound_cuts_and_is_checked(spark):
    df, _ = table(spark, 7, 400, 12, 0.15)
    names, cfg = df.columns[:-1], FitConfig(regularization=0.01, max_depth=4, search="levels")
    patterns = kept(pattern_table(df, [F.col(n) == 1 for n in names], F.col("y"), [0, 1]), "patterns")
    free = levelwise.grow(patterns, 12, 2, cfg)
    told = levelwise.grow(patterns, 12, 2, cfg.with_(upper_bound=free.upper + 1e-6))
    cells = lambda g: sum(r.cells for r in g.levels.collect())
    assert told.upper == free.upper == told.lower and cells(told) < cells(free)
    with pytest.raises(ValueError, match="upper bound"):
        fit_tree(df, "y", names, cfg.with_(upper_bound=free.upper - 0.01))


def test_time_limit_states_the_gap(spark):
    df, _ = table(spark, 8, 3000, 40, 0.3)
    names, cfg = df.columns[:-1], FitConfig(regularization=0.001, max_depth=6, max_cells=50_000_000)
    patterns = kept(pattern_table(df, [F.col(n) == 1 for n in names], F.col("y"), [0, 1]), "patterns")
    began = time.time()
    found = levelwise.grow(patterns, 40, 2, cfg, seconds=8)
    assert not found.finished and found.lower < found.upper and time.time() - began < 120
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    p = found.problem
    assert abs(search.best(p, found.values) - found.upper) < 1e-9
    model = fit_tree(df, "y", names, cfg.with_(time_limit=6.0))
    log = model.levels.orderBy("level").collect()  # how far it came depends on the machine
    assert not model.finished and model.gap > 0 and abs(log[-1].upper - model.objective) < 1e-9 and model.tree.depth() <= log[-1].level
    with pytest.raises(levelwise.OutOfTime, match="between"):
        fit_rashomon(df, "y", names, cfg.with_(time_limit=6.0, bound_multiplier=0.1), max_trees=1)
    assert spark.range(10).count() == 10  # later jobs aren't cancelled


@pytest.mark.parametrize(("support", "reason"), [(60, "support"), (0, "bound")])
def test_trace_says_what_became_of_each_split(spark, support, reason):
    df, rows = table(spark, 9, 200, 6, 0.1)
    patterns = kept(pattern_table(df, [F.col(n) == 1 for n in df.columns[:-1]], F.col("y"), [0, 1]), "patterns")
    grown = levelwise.grow(patterns, 6, 2, FitConfig(regularization=0.03, max_depth=3, min_support=support), trace=True)
    got, log = grown.trace.collect(), {r.level: r for r in grown.levels.collect()}
    assert {None, reason} <= {r.cut for r in got} <= {None, "support", "bound"}
    for level in {r.level for r in got}:
        own = [r for r in got if r.level == level]
        assert log[level + 1].splits == len(own) and log[level + 1].cut == sum(r.cut is not None for r in own)
    for r in got:
        inside = lambda cell: [x for x in rows if all(x[c // 2] == c % 2 for c in cell)]
        n = [len(inside(r.left)), len(inside(r.right))]
        few = support and min(*n, *[len(rows) - x for x in n]) <= support
        assert (r.cut == "support") == bool(few) and sorted(set(r.right) - set(r.cell)) == [2 * r.feature + 1]
        assert (r.cut == "bound") == (not few and r.low > r.room + 1e-12)
