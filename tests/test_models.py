import json

import pytest

from coppice.config import FitConfig
from coppice.operators import causal, crossfit, trees
from coppice.operators.encode import codex
from coppice.operators.fit import fit, predict
from coppice.operators.tune import auto_tune
from coppice.sources import models, tables
from coppice.streaming.scoring import scored

CFG = FitConfig(regularization=0.02, max_depth=3, bound_multiplier=0.2)


def table(spark, n=60):
    return spark.createDataFrame([(i, i % 2, i // 2 % 2, i // 4 % 2, int((i % 2) == (i // 2 % 2)) if i % 7 else 0) for i in range(n)], ["id", "a", "b", "c", "y"])


@pytest.fixture(scope="module")
def model(spark):
    return fit(table(spark), "y", ["a", "b", "c"], config=CFG, single_tree=False)


def test_texts_json_and_tables_of_trees(spark, model):
    for t in model.trees:
        assert trees.parse(t.text()) == t
        trees.validate(t, 3, 2)
        doc = json.loads(json.dumps(model.json(t)))
        back, stats = trees.from_json(doc, model.rules, model.classes)
        assert back == t and all(abs(sum(s["probabilities"]) - 1) < 1e-12 for s in stats.values())
        assert len(trees.rules_of(t, model.rules, model.classes)) == t.leaves()
    for bad in ("(0 1", "x", "(0 1 0) 1", ""):
        with pytest.raises(ValueError):
            trees.parse(bad)
    with pytest.raises(ValueError):
        trees.validate(trees.parse("(0 (0 1 0) 0)"), 3, 2)
    nodes = trees.nodes_df(spark, model.trees, model.rules, model.classes)
    assert nodes.where("type = 'leaf'").count() == sum(t.leaves() for t in model.trees)
    assert trees.layout(nodes).count() == nodes.count() - len(model.trees)
    assert model.envelope()["metadata"]["dataset_size"] == 60 and "TreeModel" in repr(model)
    paths = trees.level_paths(spark, model.trees).collect()
    deep = trees.trie(model.trees)
    for r in paths:
        here = deep
        for level in r.path:
            here = here[" ".join(map(str, level))]


def test_saved_models_predict_the_same(spark, model, tmp_path):
    models.save(model, spark, f"file://{tmp_path}/m")
    back = models.load(spark, f"file://{tmp_path}/m")
    df = table(spark)
    assert back.config == model.config and [t.text() for t in back.trees] == [t.text() for t in model.trees]
    assert predict(back, df, "prob").collect() == predict(model, df, "prob").collect()
    assert back.clusters.count() == model.clusters.count() and back.edges.count() == model.edges.count()


def test_streams_are_scored_like_tables(spark, model, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table(spark).schema).parquet(f"{tmp_path}/in")
    q = scored(model, stream).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, predict(model, table(spark)).collect()))
    with pytest.raises(ValueError):
        scored(model, table(spark))


def test_csv_with_thresholds(spark, tmp_path):
    rows = [(x / 4, "red" if x % 3 else "blue", int(x > 7)) for x in range(16)]
    spark.createDataFrame(rows, ["size", "colour", "class"]).coalesce(1).write.csv(f"{tmp_path}/t", header=True)
    df, label = tables.read_labelled(spark, f"file://{tmp_path}/t")
    assert label == "class"
    rules = codex(df, ["size", "colour"])
    m = fit(df, label, rules=rules, config=FitConfig(regularization=0.01, max_depth=2))
    assert m.rules[m.tree.feature].name == "size>=1.875" and m.classes == ["0", "1"]
    nary = trees.n_ary(m.tree, m.rules, m.classes)
    assert nary["name"] == "size" and len(nary["children"]) == 2


def test_costs_from_a_file(spark, tmp_path):
    spark.createDataFrame([(1.0, 3.0)], ["no", "yes"]).coalesce(1).write.csv(f"{tmp_path}/c", header=True)
    assert tables.read_costs(spark, f"file://{tmp_path}/c") == (["no", "yes"], ((0.0, 3.0), (1.0, 0.0)))


def test_cross_fit_and_tuning(spark):
    df = table(spark, 90)
    got = crossfit.cross_fit(df, "y", ["a", "b", "c"], CFG, folds=3, order=["id"])
    folds = crossfit.stratified_folds(df, "y", ["id"], 3).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in folds if r.y == y]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1
    dealt = crossfit.stratified_folds(df, "y", ["id"], 3)
    for k in (1, 3):
        own = fit(dealt.where(f"fold <> {k}"), "y", ["a", "b", "c"], config=CFG, single_tree=False)
        assert {t.text() for t in own.trees} == {r.tree for r in got.sets.where(f"fold = {k}").collect()}
    common = set.intersection(*[{r.tree for r in got.sets.where(f"fold = {k}").collect()} for k in (1, 2, 3)])
    assert {t.text() for t in got.stable_trees()} == common
    tuned = auto_tune(df, "y", ["a", "b", "c"], target=2, most=6, config=CFG, max_steps=6)
    assert tuned.steps <= 6 and (not tuned.converged or 2 <= tuned.n_trees <= 6)


def test_simulated_effect_is_found(spark):
    df = causal.simulated(spark, 4000, 3).withColumn("influence", causal.influence("y", "a", "pi", "mu1", "mu0"))
    row = causal.dr_estimate(df).first()
    assert abs(row.estimate - 6) < 4 * row.std_error


def test_what_a_fit_writes(spark, model, tmp_path):
    docs = [model.json(t) for t in model.trees]
    tables.write_trees(spark, docs, f"file://{tmp_path}/trees")
    assert [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/trees").collect()] == json.loads(json.dumps(docs))
    tables.write_table(model.clusters, f"file://{tmp_path}/clusters")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/clusters").collect())) == sorted(map(tuple, model.clusters.collect()))
    nested = trees.trie(model.trees)
    tables.write_nested_trie(spark, nested, f"file://{tmp_path}/trie")
    assert json.loads(spark.read.text(f"file://{tmp_path}/trie", wholetext=True).first().value) == nested
    assert model.summary()["leaves"] == model.tree.leaves() and model.summary()["features"]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from coppice.sources.work import work_root

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_root(session)


def test_example_keeps_its_table_and_prints(spark, tmp_path):
    import json

    from coppice.operators import trees
    from coppice.operators.fit import example_fit, fit_tree
    from coppice.sources.tables import write_covered

    model = example_fit(spark)
    assert model.tree.leaves() == 4 and model.training_accuracy() == 1.0 and model.training_accuracy() is model._known["accuracy"]
    done = model.training_predictions()
    assert done.where("prediction <> y or abs(prob_1 - y) > 1e-12").count() == 0 and model.training_predictions() is done
    assert json.loads(trees.pretty(model.json())) == model.json() and trees.pretty(model.json()).count("\n") > 20
    text = trees.graph_text(model.tree, model.rules, model.classes)
    assert text.startswith("digraph tree {") and text.count("->") == 6 and text.count("shape=ellipse") == 4 and 'n1 [label="feature_' in text
    with pytest.raises(ValueError, match="keep_training"):
        fit_tree(model.training, "y", ["feature_1"]).training_accuracy()
    write_covered({"f1": spark.range(3), "auc": spark.range(2)}, f"{tmp_path}/covered")
    assert {(r.metric, r.id) for r in spark.read.parquet(f"{tmp_path}/covered").collect()} == {("f1", 0), ("f1", 1), ("f1", 2), ("auc", 0), ("auc", 1)}


def test_covered_set_by_auc_of_many_rows(spark):
    from coppice.operators.fit import covered

    clusters = spark.createDataFrame([(90_000, 400_000, 2), (9_000_000_000, 40_000_000_000, 2), (0, 0, 1)], "tp long, tn long, leaves int")
    few = covered(clusters.where("tp < 1000000"), 100_000, 500_000, 0.005, "auc", 0.2).collect()  # the product of the class sizes is no int
    assert [(r.tp, r.metric) for r in few] == [(90_000, 0.85)]
    many = covered(clusters.where("tp > 1000000"), 10_000_000_000, 50_000_000_000, 0.005, "auc", 0.2).collect()  # nor a long
    assert [(r.tp, r.metric) for r in many] == [(9_000_000_000, 0.85)]
