"""Models in a folder: a JSON document and, for near-optimal sets, Parquet tables."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from coppice.config import FitConfig
from coppice.operators import trees
from coppice.operators.encode import Rule
from coppice.operators.fit import TreeModel

FORMAT = 1


def save(model: TreeModel, spark: SparkSession, path: str) -> None:
    doc = {
        "format": FORMAT, "config": asdict(model.config), "rules": [r.to_dict() for r in model.rules], "classes": model.classes, "label": model.label, "objective": model.objective, "bound": model.bound,
        "n_trees": model.n_trees, "n_optimal": model.n_optimal, "rows": model.rows, "trees": [t.text() for t in model.trees], "stats": [[care, val, s] for (care, val), s in sorted(model.stats.items())],
    }
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(f"{path}/model")
    for name, table in (("clusters", model.clusters), ("edges", model.edges)):
        if table is not None:
            table.write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> TreeModel:
    doc = json.loads(spark.read.text(f"{path}/model", wholetext=True).first()[0])
    if doc["format"] != FORMAT:
        raise ValueError(f"format {doc['format']}, not {FORMAT}")
    config = doc["config"]
    config["costs"] = tuple(map(tuple, config["costs"])) if config["costs"] else None
    config["prob_clip"] = tuple(config["prob_clip"]) if config["prob_clip"] else None
    tables = {}
    for name in ("clusters", "edges"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        tables[name] = spark.read.parquet(f"{path}/{name}") if there else None
    return TreeModel(FitConfig(**config), [Rule(**r) for r in doc["rules"]], doc["classes"], doc["label"], doc["objective"], doc["bound"], doc["n_trees"], doc["n_optimal"], doc["rows"], [trees.parse(t) for t in doc["trees"]], {(a, b): s for a, b, s in doc["stats"]}, **tables)
