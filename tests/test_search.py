"""The engine against plain enumeration of all trees on small random tables."""

import math
import random
from collections import Counter

import pytest

from coppice.config import FitConfig
from coppice.operators import search, trees
from coppice.operators.encode import pattern_table
from coppice.operators.fit import accuracy, binary_rules, fit, fit_patterns, fit_rashomon, fit_tree, get_predictions, predict, predict_ensemble


def rows_of(seed, n, p, classes=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = [rng.randint(0, 1) for _ in range(p)]
        out.append((*x, (x[0] ^ x[1] if rng.random() < 0.8 else rng.randrange(classes))))
    return out


def leaf(rows, all_rows, cfg, classes):
    counts = [sum(r[-1] == c for r in rows) for c in range(classes)]
    n, total = len(rows), len(all_rows)
    if cfg.loss == "log_loss":
        h = -sum(q * math.log(q) for q in (max(1e-12, min(1 - 1e-12, c / n)) for c in counts))
        return max(c for c in range(classes) if counts[c] == max(counts)), n * h
    if cfg.costs:
        cost = [sum(cfg.costs[i][j] * counts[j] for j in range(classes)) for i in range(classes)]
    elif cfg.balance:
        sizes = [sum(r[-1] == c for r in all_rows) for c in range(classes)]
        cost = [sum(counts[j] / (classes * sizes[j]) for j in range(classes) if j != i) for i in range(classes)]
    else:
        cost = [(n - counts[i]) / total for i in range(classes)]
    best = min(round(c, 12) for c in cost)
    pred = max(i for i in range(classes) if round(cost[i], 12) == best)
    return pred, cost[pred]


def every(rows, all_rows, free, cfg, classes, depth):
    """(text, objective, leaf class or None) of every tree over these rows."""
    pred, loss = leaf(rows, all_rows, cfg, classes)
    out = [(str(pred), loss + cfg.regularization, pred)]
    if depth == 0:
        return out
    for f in free:
        t, e = [r for r in rows if r[f]], [r for r in rows if not r[f]]
        if not t or not e or min(len(t), len(all_rows) - len(t), len(e), len(all_rows) - len(e)) <= cfg.min_support:
            continue
        rest = [g for g in free if g != f]
        for a, va, la in every(t, all_rows, rest, cfg, classes, depth - 1):
            for b, vb, lb in every(e, all_rows, rest, cfg, classes, depth - 1):
                if not (cfg.ignore_trivial and la is not None and la == lb) and not (cfg.rule_list and la is None and lb is None):
                    out.append((f"({f} {a} {b})", va + vb, None))
    return out


CASES = [
    (1, 40, 3, 2, FitConfig(regularization=0.02, bound_multiplier=0.4)),
    (2, 60, 3, 2, FitConfig(regularization=0.05, bound_adder=0.1)),
    (3, 50, 3, 2, FitConfig(regularization=0.01, bound=0.3, max_depth=3)),
    (4, 50, 3, 3, FitConfig(regularization=0.03, bound_multiplier=0.3)),
    (5, 50, 3, 2, FitConfig(loss="log_loss", regularization=2.0, bound_multiplier=0.15)),
    (6, 60, 3, 2, FitConfig(regularization=0.02, bound_multiplier=0.3, balance=True)),
    (7, 60, 3, 2, FitConfig(regularization=0.02, bound_multiplier=0.3, costs=((0.0, 0.03), (0.01, 0.0)))),
    (8, 60, 3, 2, FitConfig(regularization=0.02, bound_multiplier=0.3, min_support=8)),
    (9, 40, 3, 2, FitConfig(regularization=0.02, bound_multiplier=0.2, ignore_trivial=False, max_depth=3)),
    (10, 60, 3, 2, FitConfig(regularization=0.01, bound_multiplier=0.3, rule_list=True)),
    (11, 60, 3, 2, FitConfig(regularization=0.01, bound_adder=0.05, rule_list=True, min_support=6)),
    (12, 50, 3, 3, FitConfig(regularization=0.03, bound_multiplier=0.2, balance=True)),
]


@pytest.mark.parametrize(("seed", "n", "p", "classes", "cfg"), CASES)
def test_set_is_that_of_enumeration(spark, seed, n, p, classes, cfg):
    data = rows_of(seed, n, p, classes)
    names = [f"x{i}" for i in range(p)]
    df = spark.createDataFrame(data, [*names, "y"])
    depth = cfg.max_depth - 1 if cfg.max_depth else p
    trees_ = every(data, data, list(range(p)), cfg, classes, depth)
    best = min(v for _, v, _ in trees_)
    bound = cfg.rashomon_bound(best)
    want = Counter({t: 1 for t, v, _ in trees_ if v <= bound + 1e-9})
    model = fit_rashomon(df, "y", names, cfg)
    assert abs(model.objective - best) < 1e-9
    assert Counter(t.text() for t in model.trees) == want
    assert model.n_trees == len(want) and model.n_optimal == sum(v <= best + 1e-9 for _, v, _ in trees_)
    assert sum(r.trees for r in model.clusters.collect()) == len(want)
    splits = {(care, val, n.feature) for t in want for _, care, val, n in trees.parse(t).cells() if n.feature is not None}
    assert {(r.care, r.val, r.feature) for r in model.edges.collect()} == splits
    values = {t: v for t, v, _ in trees_}
    assert all(abs(values[t.text()] - best) < 1e-9 for t in model.trees[: model.n_optimal])


def test_single_tree_and_prediction(spark):
    data = rows_of(3, 80, 3)
    df = spark.createDataFrame(data, ["a", "b", "c", "y"])
    model = fit_tree(df, "y", ["a", "b", "c"], FitConfig(regularization=0.01))
    assert len(model.trees) == 1
    tree = model.tree

    def walk(t, r):
        return t.prediction if t.feature is None else walk(t.true if r[t.feature] else t.false, r)

    got = predict(model, df).collect()
    assert all(r.prediction == walk(tree, tuple(r)) for r in got)
    assert abs(accuracy(model, df) - sum(walk(tree, r) == r[-1] for r in data) / len(data)) < 1e-12
    probs = predict(model, df, "prob").collect()
    assert all(abs(r.prob_0 + r.prob_1 - 1) < 1e-12 for r in probs)
    errors = sum(walk(tree, r) != r[-1] for r in data)
    assert abs(model.objective - (errors / len(data) + 0.01 * tree.leaves())) < 1e-9
    many = fit(df, "y", ["a", "b", "c"], config=FitConfig(regularization=0.01, bound_multiplier=0.2), single_tree=False)
    votes = predict_ensemble(many, df).collect()
    for r in votes:
        n = sum(walk(t, tuple(r)) == 1 for t in many.trees)
        assert r.votes == n and r.prediction == int(2 * n >= len(many.trees))


def test_metamorphic(spark):
    data = rows_of(11, 60, 3)
    df = spark.createDataFrame(data, ["a", "b", "c", "y"])
    cfg = FitConfig(regularization=0.02)
    one = fit_tree(df, "y", ["a", "b", "c"], cfg)
    assert abs(fit_tree(df.unionAll(df), "y", ["a", "b", "c"], cfg).objective - one.objective) < 1e-12
    assert abs(fit_tree(df, "y", ["c", "a", "b"], cfg).objective - one.objective) < 1e-12
    few, more = (fit_rashomon(df, "y", ["a", "b", "c"], cfg.with_(bound_multiplier=m, max_depth=3), max_trees=1000) for m in (0.01, 0.4))
    assert few.n_trees <= more.n_trees and {t.text() for t in few.trees} <= {t.text() for t in more.trees}


def test_odd_inputs(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], ["a", "b", "y"])
    assert fit_tree(df, "y", ["a", "b"]).tree == trees.Tree(None, None, None, 0)
    assert fit_tree(df, "y", ["a", "b"]).classes == [1]
    for bad in (df.where("false"), df.withColumn("a", df.a + 1), df.selectExpr("cast(null as int) a", "b", "y")):
        with pytest.raises(ValueError):
            fit_tree(bad, "y", ["a", "b"])
    with pytest.raises(ValueError):
        fit_tree(df, "y", [])
    with pytest.raises(ValueError):
        fit_tree(df, "y", ["nope"])
    for wrong in ({"loss": "x"}, {"bound": 1, "bound_adder": 1}, {"regularization": -1}):
        with pytest.raises(ValueError):
            FitConfig(**wrong)
    wide = spark.createDataFrame([tuple([0] * 40)], [f"f{i}" for i in range(40)])
    assert fit_tree(wide, "f0", [f"f{i}" for i in range(1, 40)]).tree.text() == "0"  # a leaf's penalty leaves no room for splits
    with pytest.raises(ValueError, match="max_depth"):
        fit_tree(wide, "f0", [f"f{i}" for i in range(1, 40)], FitConfig(regularization=0.0))
    with pytest.raises(ValueError, match="without a label"):
        fit_tree(df.selectExpr("a", "b", "nullif(y, 1) y"), "y", ["a", "b"])
    many = spark.createDataFrame(rows_of(2, 40, 3), ["a", "b", "c", "y"])
    with pytest.raises(ValueError, match="model_limit"):
        fit_rashomon(many, "y", ["a", "b", "c"], FitConfig(regularization=0.01, bound_multiplier=0.5, model_limit=2))


def test_ties_are_told_at_any_number_of_rows(spark):
    """At 2e10 rows, 1000 errors and 1012 are not the same."""
    patterns = spark.createDataFrame([(0, 10**10, 0), (1, 500, 506), (2, 506, 500), (3, 0, 10**10)], "bits long, n_0 long, n_1 long")
    cfg = FitConfig(regularization=0.01, max_depth=2, bound_adder=0.01)
    model = fit_patterns(patterns, binary_rules(["a", "b"]), [0, 1], "y", cfg, single_tree=False)
    rows = 2 * 10**10 + 2012
    assert model.rows == rows and model.n_optimal == 1 and [t.text() for t in model.trees] == ["(0 1 0)", "(1 1 0)"]
    p = search.problem(patterns, 2, 2, cfg)
    assert p.scale.exact and [r.v for r in search.optimum(p)[0].collect()] == [1000 * 100 + 2 * rows]


def test_limits_are_on_what_is_asked_for(spark):
    data = rows_of(2, 40, 3)
    df = spark.createDataFrame(data, ["a", "b", "c", "y"])
    cfg = FitConfig(regularization=0.01, max_depth=3, bound=0.55)
    full = fit_rashomon(df, "y", ["a", "b", "c"], cfg)
    assert full.n_trees > 12
    few = fit_rashomon(df, "y", ["a", "b", "c"], cfg.with_(model_limit=10), max_trees=7)
    assert few.n_trees == full.n_trees and few.trees == full.trees[:7]
    assert fit_tree(df, "y", ["a", "b", "c"], cfg.with_(model_limit=1)).tree == full.tree
    with pytest.raises(ValueError, match="model_limit"):
        fit_rashomon(df, "y", ["a", "b", "c"], cfg.with_(model_limit=10))
    small = fit_rashomon(df, "y", ["a", "b", "c"], cfg.with_(model_limit=10), max_trees=1)
    with pytest.raises(ValueError, match="model_limit"):
        small.envelope()
    whole = full.envelope()
    at = whole["available_metric_values"]
    assert sum(whole["storage"][k]["count"] for k in at["metric_pointers"]) == full.n_trees and len(whole["trees"]) == full.n_trees
    assert [r.tree for r in full.trees_df(spark).orderBy("tree_id").collect()] == [t.text() for t in full.trees]
    assert full.summary()["n_trees"] == full.n_trees


def test_two_ways_of_counting_cells(spark):
    rng = random.Random(5)
    rows = [(k % 3, rng.getrandbits(12), rng.randrange(9), rng.randrange(9)) for k in range(700)]
    patterns = spark.createDataFrame(rows, "fold int, bits long, n_0 long, n_1 long").repartition(5)
    for keys in ([], ["fold"]):
        one, two = (sorted(map(tuple, f(patterns, 12, 2, 3, keys).groupBy(*keys, "care", "val").agg({"n_0": "sum", "n_1": "sum"}).where("`sum(n_0)` + `sum(n_1)` > 0").collect())) for f in (search._spread, search._counted))
        assert one == two


def test_many_features(spark):
    """40 features over many patterns: cells are added up in the tasks."""
    df = spark.range(60_000).selectExpr("xxhash64(id) & ((1L << 40) - 1) AS bits", "id").selectExpr("bits", "IF((bits >> 7 & 1) = 1 AND (bits >> 31 & 1) = 1, 0L, 1L) AS n_0", "IF((bits >> 7 & 1) = 1 AND (bits >> 31 & 1) = 1, 1L, 0L) AS n_1")
    model = fit_patterns(df, binary_rules([f"f{i}" for i in range(40)]), [0, 1], "y", FitConfig(regularization=0.01, max_depth=3))
    assert model.tree.text() in ("(7 (31 1 0) 0)", "(31 (7 1 0) 0)") and model.n_optimal == 2


def test_greedy_tree(spark):
    data = rows_of(6, 80, 3)
    df = spark.createDataFrame(data, ["a", "b", "c", "y"])
    cfg = FitConfig(regularization=0.01)

    def plain(rows, free):
        pred, loss = leaf(rows, data, cfg, 2)
        best = None
        for f in free:
            parts = [[r for r in rows if r[f] == s] for s in (1, 0)]
            if all(parts):
                cost = sum(leaf(x, data, cfg, 2)[1] for x in parts)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, parts)
        if best is None or loss - best[0] <= cfg.regularization + 1e-12:
            return str(pred)
        return f"({best[1]} {plain(best[2][0], [g for g in free if g != best[1]])} {plain(best[2][1], [g for g in free if g != best[1]])})"

    patterns = pattern_table(df, [r.test() for r in binary_rules(["a", "b", "c"])], df.y, [0, 1])
    assert search.greedy(search.problem(patterns, 3, 2, cfg)) == plain(data, [0, 1, 2])


def test_new_data_is_checked(spark):
    df = spark.createDataFrame(rows_of(3, 60, 2), ["a", "b", "y"])
    model = fit_tree(df, "y", ["a", "b"], FitConfig(regularization=0.01))
    for bad in ("2", "cast(null as int)"):
        with pytest.raises(Exception, match="other than 0 and 1"):
            predict(model, df.selectExpr(f"{bad} a", "b")).collect()
        assert predict(model, df.selectExpr(f"{bad} a", "b"), check=False).count() == 60
    with pytest.raises(ValueError, match="columns must be"):
        predict(model, df.select("b", "a"), strict_names=True)
    assert predict(model, df.select("a", "b"), strict_names=True).count() == 60
    assert get_predictions(model, df).where("correct").count() == round(60 * accuracy(model, df))
