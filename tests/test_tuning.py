"""A setting at which folds agree; options and checks that no other test names."""

import pytest
from pyspark.sql import functions as F
from test_search import every, rows_of

from coppice.config import FitConfig, from_options
from coppice.operators import crossfit, search
from coppice.operators.encode import pattern_table
from coppice.operators.fit import fit_tree, predict
from coppice.operators.trees import readable
from coppice.sources.tables import check_binary
from coppice.sources.work import kept


@pytest.fixture(scope="module")
def dealt(spark):
    data = [(*r, i % 3 + 1) for i, r in enumerate(rows_of(31, 120, 3))]
    df = spark.createDataFrame(data, ["a", "b", "c", "y", "fold"])
    return data, kept(crossfit.fold_patterns(df, [F.col(n) == 1 for n in "abc"], F.col("y"), [0, 1]), "train")


def shared(data, cfg):
    """Trees that enumeration finds near-optimal on each fold's complement."""
    sets = []
    for fold in (1, 2, 3):
        own = [r[:4] for r in data if r[4] != fold]
        found = every(own, own, [0, 1, 2], cfg, 2, 2)
        best = min(v for _, v, _ in found)
        sets.append({t for t, v, _ in found if v <= best * (1 + cfg.bound_multiplier) + 1e-12})
    return len(set.intersection(*sets))


def test_many_penalties_in_one_search(dealt):
    data, train = dealt
    values = [0.005, 0.0125, 0.05, 0.2]
    cfg = FitConfig(bound_multiplier=0.25, max_depth=3)
    got = {r.value: r.intersecting for r in crossfit.tune_intersecting(train, 3, 2, cfg, 3, "regularization", values).collect()}
    assert got == {v: shared(data, cfg.with_(regularization=v)) for v in values}
    got = {r.value: r.intersecting for r in crossfit.tune_intersecting(train, 3, 2, cfg.with_(regularization=0.01), 3, "bound_multiplier", [0.01, 0.2, 0.5]).collect()}
    assert got == {m: shared(data, cfg.with_(regularization=0.01, bound_multiplier=m)) for m in (0.01, 0.2, 0.5)}


def test_tuned_cross_fit(spark):
    df = spark.createDataFrame(rows_of(33, 150, 3), ["a", "b", "c", "y"])
    got = crossfit.auto_tune_intersecting(df, "y", ["a", "b", "c"], target=2, parameter="bound_multiplier", config=FitConfig(regularization=0.01, max_depth=3), folds=3, settings=5, rounds=2)
    assert got.converged and got.intersecting >= 2 and all(n < 2 for v, n in got.tried if v < got.value)
    assert crossfit.intersection(got.fit.sets, 3).count() == got.intersecting
    with pytest.raises(ValueError, match="parameter"):
        crossfit.tune_intersecting(kept(pattern_table(df, [F.col("a") == 1], F.col("y"), [0, 1]), "x"), 1, 2, FitConfig(), 1, "max_depth", [1])


def test_folds_by_levels_are_those_of_the_cube(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows_of(35, 90, 3))], ["a", "b", "c", "y", "i"])
    cfg = FitConfig(regularization=0.02, max_depth=3, bound_multiplier=0.2)
    sets = [{(r.fold, r.tree, round(r.objective, 9)) for r in crossfit.cross_fit(df, "y", ["a", "b", "c"], cfg.with_(search=s), 2, ["i"]).sets.collect()} for s in ("cube", "levels")]
    assert sets[0] == sets[1] and {f for f, _, _ in sets[0]} == {1, 2}


def test_options_and_checks(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)] * 10, ["a", "y"])
    model = fit_tree(df, "y", ["a"], FitConfig(regularization=0.01, prob_clip=(0.1, 0.9)))
    probs = {r.a: (round(r.prob_0, 9), round(r.prob_1, 9)) for r in predict(model, df, "prob").collect()}
    assert probs == {0: (round(2 / 3, 9), round(1 / 3, 9)), 1: (0.1, 0.9)}
    assert readable(model.tree, model.rules, model.classes) == "if a==1\n  predict 1\nelse\n  predict 0"
    check_binary(df, ["a"], "y")
    for wrong, columns in ((df.withColumn("a", F.lit(2)), ["a"]), (df.where("false"), ["a"]), (df, []), (df, ["b"]), (df.withColumn("a", F.lit("1")), ["a"]), (df.withColumn("a", F.lit(None).cast("int")), ["a"])):
        with pytest.raises(ValueError):
            check_binary(wrong, columns)
    assert from_options({"time_limit": 5, "upperbound": 0.2, "depth_budget": 3}) == FitConfig(time_limit=5, upper_bound=0.2, max_depth=3)
    for wrong in ({"search": "x"}, {"search": "cube", "time_limit": 1.0}, {"time_limit": -1.0}):
        with pytest.raises(ValueError):
            FitConfig(**wrong)
    assert search.literal_limit(5, FitConfig(max_depth=3)) == 2
