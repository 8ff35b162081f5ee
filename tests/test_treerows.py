"""Trees as rows against the same on the driver; votes of many trees; ranks of a set."""

import random

import pytest
from test_search import CASES, every, rows_of

from coppice.config import FitConfig
from coppice.operators import treerows, trees, votes
from coppice.operators.encode import Rule
from coppice.operators.fit import binary_rules, fit_rashomon, predict_ensemble


def random_tree(rng, free, depth):
    if depth == 0 or not free or rng.random() < 0.25:
        return trees.Tree(None, None, None, rng.randrange(3))
    f = rng.choice(free)
    rest = [g for g in free if g != f]
    return trees.Tree(f, random_tree(rng, rest, depth - 1), random_tree(rng, rest, depth - 1), None)


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(4)
    own = [random_tree(rng, list(range(70)), 4) for _ in range(60)] + [trees.parse("0"), trees.parse("(11 2 (0 1 0))")]
    return own, spark.createDataFrame([(i, t.text()) for i, t in enumerate(own, 1)], "tree_id long, tree string")


RULES = [Rule(k, k, f'c"{k}', "categorical" if k % 2 else "integral", "==" if k % 2 else ">=", f"v\\{k}") for k in range(70)]
CLASSES = ["no", 'ye"s', "é"]


def test_nodes_rules_and_paths_are_those_of_the_driver(spark, some):
    own, df = some
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, treerows.nodes_table(df, RULES, CLASSES).collect()), key=key) == sorted(map(tuple, trees.nodes_df(spark, own, RULES, CLASSES).collect()), key=key)
    rules = sorted(map(tuple, treerows.rules_table(df, RULES, CLASSES).collect()))
    assert rules == sorted((i, *r) for i, t in enumerate(own, 1) for r in trees.rules_of(t, RULES, CLASSES))
    want = {r.tree: [list(x) for x in r.path] for r in trees.level_paths(spark, own).collect()}
    assert {r.tree: [list(x) for x in r.path] for r in treerows.level_paths(df).collect()} == want
    trie = {tuple(tuple(x) for x in r.prefix): (r.level, r.key, r.trees) for r in treerows.trie_table(df).collect()}
    for path in (want[t.text()] for t in own):
        for k in range(1, len(path) + 1):
            prefix = tuple(tuple(x) for x in path[:k])
            assert trie.pop(prefix, (k, " ".join(map(str, path[k - 1])), None))[:2] == (k, " ".join(map(str, path[k - 1])))
    assert not trie


def test_json_and_back(some):
    own, df = some
    import json

    written = df.select("tree_id", treerows.json_of("tree", RULES, CLASSES).alias("json"))

    def plain(d):
        if "prediction" in d:
            assert CLASSES[d["class"]] == d["prediction"]
            return trees.Tree(None, None, None, d["class"])
        r = RULES[d["rule"]]
        assert (d["feature"], d["name"], d["relation"], d["reference"]) == (r.position, r.column, r.relation, r.reference)
        return trees.Tree(d["rule"], plain(d["true"]), plain(d["false"]), None)

    assert {r.tree_id: plain(json.loads(r.json)) for r in written.collect()} == dict(enumerate(own, 1))
    nodes = sorted((r.tree_id, r.id, r.depth, r.rule, r["class"]) for r in treerows.from_json(written).collect())
    want = sorted((i, node, care.bit_count(), t.feature, t.prediction) for i, tree in enumerate(own, 1) for node, care, _, t in tree.cells())
    assert nodes == want


def test_votes_of_a_set(spark):
    data = rows_of(21, 200, 4)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], ["a", "b", "c", "d", "y", "bits"])
    names = ["a", "b", "c", "d"]
    model = fit_rashomon(df, "y", names, FitConfig(regularization=0.01, bound_multiplier=0.6, max_depth=4))
    few = model.trees[:12]
    plain = {r.bits: (r.votes, r.prediction, round(r.prob_1, 9)) for r in predict_ensemble(model, df, few).collect()}
    rows = spark.createDataFrame([(t.text(),) for t in few], "tree string")
    got = votes.predict_set(model, df, rows, model.cells)
    assert got.columns == [*df.columns, "prob_1", "votes", "prediction"]
    assert {r.bits: (r.votes, r.prediction, round(r.prob_1, 9)) for r in got.collect()} == plain
    many = spark.range(300).crossJoin(rows).select("tree")  # each tree three hundred times
    assert {r.bits: (r.votes / 300, r.prediction, round(r.prob_1, 9)) for r in votes.predict_set(model, df, many, model.cells).collect()} == plain
    with pytest.raises(ValueError, match="different leaves"):
        votes.predict_set(model, df, rows, model.cells, most=2).collect()
    with pytest.raises(ValueError, match="no trees"):
        votes.predict_set(model, df, rows.limit(0), model.cells)


def test_rows_stay_where_they_are_for_votes(spark, monkeypatch):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows_of(21, 40, 4))], ["a", "b", "c", "d", "y", "bits"])
    model = fit_rashomon(df, "y", ["a", "b", "c", "d"], FitConfig(regularization=0.01, bound_multiplier=0.6, max_depth=4))
    rows = spark.createDataFrame([("(2 (3 1 0) 0)",), ("(3 1 0)",), ("1",)], "tree string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the patterns were too large for Spark to send of itself
    try:
        got = votes.predict_set(model, df, rows, model.cells)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        want = {(i, r[2] * r[3] + r[3] + 1) for i, r in enumerate(rows_of(21, 40, 4))}
        assert {(r.bits, r.votes) for r in got.collect()} == want
        monkeypatch.setattr(votes, "MOST_SENT", 0)  # more patterns than are sent: dealt out, none left out
        assert {(r.bits, r.votes) for r in votes.predict_set(model, df, rows, model.cells).collect()} == want
        alone = votes.predict_set(model, df, rows.where("tree = '1'"), model.cells)  # no rule at all
        assert [r.votes for r in alone.collect()] == [1] * 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_votes_with_many_features(spark):
    rng = random.Random(2)
    wide = [tuple(rng.randrange(2) for _ in range(75)) for _ in range(50)]
    df = spark.createDataFrame(wide, [f"x{i}" for i in range(75)])
    own = [t for t in (random_tree(rng, list(range(75)), 3) for _ in range(40)) if all(n.prediction != 2 for *_, n in t.cells())]
    fitted = fit_rashomon(spark.createDataFrame([(0, 0), (1, 1)], ["a", "y"]), "y", ["a"])
    fitted.rules = binary_rules(df.columns)
    none = spark.createDataFrame([], "care array<long>, val array<long>, n_0 long, n_1 long")
    got = votes.predict_set(fitted, df, spark.createDataFrame([(t.text(),) for t in own], "tree string"), none).collect()
    walk = lambda t, r: t.prediction if t.feature is None else walk(t.true if r[t.feature] else t.false, r)
    assert sorted((tuple(r)[:75], r.votes) for r in got) == sorted((r, sum(walk(t, r) for t in own)) for r in wide)


@pytest.mark.parametrize("case", [CASES[i] for i in (4, 10)])
def test_ranks_go_through_the_whole_set(spark, case):
    seed, n, p, classes, cfg = case
    data = rows_of(seed, n, p, classes)
    model = fit_rashomon(spark.createDataFrame(data, [*[f"x{i}" for i in range(p)], "y"]), "y", [f"x{i}" for i in range(p)], cfg, max_trees=1)
    got = sorted(model.ranked(0, model.n_trees + 5).collect(), key=lambda r: r["rank"])
    values = {t: v for t, v, _ in every(data, data, list(range(p)), cfg, classes, cfg.max_depth - 1 if cfg.max_depth else p)}
    assert [int(r["rank"]) for r in got] == list(range(model.n_trees)) and len({r.tree for r in got}) == model.n_trees
    assert all(abs(values[r.tree] - r.objective) < 1e-9 for r in got) and all(a.objective <= b.objective + 1e-9 for a, b in zip(got, got[1:], strict=False))
    some = model.ranked(2, 4).collect()
    assert {(r["rank"], r.tree) for r in some} == {(r["rank"], r.tree) for r in got[2:5]}


def test_ranks_of_a_set_over_the_limit(spark):
    data = rows_of(5, 150, 4)
    model = fit_rashomon(spark.createDataFrame(data, [*"abcd", "y"]), "y", list("abcd"), FitConfig(regularization=0.001, bound=0.9), max_trees=1)
    assert model.n_trees > model.config.model_limit  # more than a fit would make
    middle = model.n_trees // 2
    got = [model.ranked(x, x + 3).orderBy("rank").collect() for x in (0, middle)]
    assert all(len({r.tree for r in own}) == 4 for own in got)
    flat = [r for own in got for r in own]
    assert [int(r["rank"]) for r in flat] == [x + i for x in (0, middle) for i in range(4)]
    assert all(a.objective <= b.objective for a, b in zip(flat, flat[1:], strict=False)) and flat[0].tree == model.tree.text()
    for r in flat:
        t = trees.parse(r.tree)
        walk = lambda t, x: t.prediction if t.feature is None else walk(t.true if x[t.feature] else t.false, x)
        assert abs(sum(walk(t, x) != x[-1] for x in data) / 150 + 0.001 * t.leaves() - r.objective) < 1e-9 and t.leaves() == r.leaves
