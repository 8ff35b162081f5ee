"""Trees as rows: read from and written to text and JSON on the cluster, node by node.

A table of trees has a column with a tree's text, ``(feature true false)`` or a class for a leaf.
Everything here is one expression over that column, or a grouping of what it gives, so a
set of any number of trees stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions import masks

_NODE = "struct<id:bigint,depth:int,feature:int,leaf:int,path:array<int>>"
_GAP = "\x01"


def nodes_of(text: str) -> Column:
    """The nodes of the tree in column ``text``, true side before false: id as in a heap, depth, feature or leaf, and the path's literals (2f + 1: feature f holds, 2f: it fails)."""
    top, n = "element_at(s.stack, -1)", "cast(ltrim('(', t) as int)"
    split = "startswith(t, '(')"
    side = lambda v: f"named_struct('id', 2 * {top}.id + {v}, 'path', array_append({top}.path, 2 * {n} + {v}))"
    node = f"named_struct('id', {top}.id, 'depth', size({top}.path), 'feature', if({split}, {n}, null), 'leaf', if({split}, null, {n}), 'path', {top}.path)"
    rest = "slice(s.stack, 1, size(s.stack) - 1)"
    return F.expr(f"""aggregate(regexp_extract_all(`{text}`, '[(]?[0-9]+', 0),
      named_struct('stack', array(named_struct('id', 1L, 'path', cast(array() as array<int>))), 'nodes', cast(array() as array<{_NODE}>)),
      (s, t) -> named_struct('stack', if({split}, concat({rest}, array({side(0)}, {side(1)})), {rest}), 'nodes', array_append(s.nodes, {node})),
      s -> s.nodes)""".replace("ltrim('(', t)", "trim(leading '(' from t)"))


def exploded(trees: DataFrame, keep: list[str], text: str = "tree") -> DataFrame:
    """(keep, nth, id, depth, feature, leaf, path) of each node of each tree."""
    return trees.select(*keep, F.posexplode(nodes_of(text)).alias("nth", "node")).select(*keep, "nth", "node.*")


def _names(values: list) -> Column:
    return F.split(F.lit(_GAP.join(map(str, values))), _GAP)


def _named(names: Column, at: Column) -> Column:
    return F.element_at(names, at + 1)


def nodes_table(trees: DataFrame, rules: list, classes: list) -> DataFrame:
    """(tree_id, id, parent_id, depth, type, label, prediction, feature) from (tree_id, tree)."""
    rows = exploded(trees, ["tree_id"])
    leaf = F.col("feature").isNull()
    prediction = F.when(leaf, _named(_names(classes), F.col("leaf")))
    label = F.when(leaf, F.concat(F.lit("Pred: "), prediction)).otherwise(_named(_names([r.name for r in rules]), F.col("feature")))
    return rows.select("tree_id", "id", F.when(F.col("id") > 1, F.shiftright("id", 1)).alias("parent_id"), "depth", F.when(leaf, F.lit("leaf")).otherwise(F.lit("decision")).alias("type"), label.alias("label"), prediction.alias("prediction"), "feature")


def rules_table(trees: DataFrame, rules: list, classes: list) -> DataFrame:
    """(tree_id, rule_id, condition, prediction): the way to each leaf, from the true side on, from (tree_id, tree)."""
    names = _names([r.name for r in rules])
    leaves = F.filter(nodes_of("tree"), lambda x: x.leaf.isNotNull())
    rows = trees.select("tree_id", F.posexplode(leaves).alias("nth", "node"))
    said = F.transform("node.path", lambda x: F.concat(F.when(x % 2 == 0, F.lit("NOT ")).otherwise(F.lit("")), F.element_at(names, (x / 2).cast("int") + 1)))
    condition = F.when(F.size("node.path") == 0, F.lit("TRUE")).otherwise(F.array_join(said, " AND "))
    return rows.select("tree_id", (F.col("nth") + 1).alias("rule_id"), condition.alias("condition"), _named(_names(classes), F.col("node.leaf")).alias("prediction"))


def level_paths(trees: DataFrame, text: str = "tree") -> DataFrame:
    """``trees`` with path: an array of levels, each an array of features or -(class + 1), true side first."""
    level = lambda d: F.transform(F.filter("_nodes", lambda x: x.depth == d), lambda x: F.coalesce(x.feature, -(x.leaf + 1)))
    deepest = F.array_max(F.transform("_nodes", lambda x: x.depth))
    return trees.withColumn("_nodes", nodes_of(text)).withColumn("path", F.transform(F.sequence(F.lit(0), deepest), level)).drop("_nodes")


def trie_table(trees: DataFrame, text: str = "tree") -> DataFrame:
    """(level, prefix, key, trees): the prefix tree of a set, a row for each node: its levels so far, the last as text, and how many trees go on from there."""
    paths = level_paths(trees.select(text), text)
    prefixes = paths.select(F.explode(F.sequence(F.lit(1), F.size("path"))).alias("level"), "path").select("level", F.slice("path", 1, F.col("level")).alias("prefix"))
    nodes = prefixes.groupBy("level", "prefix").agg(F.count("*").alias("trees"))
    return nodes.select("level", "prefix", F.array_join(F.element_at("prefix", -1).cast("array<string>"), " ").alias("key"), "trees")


def _quoted(values: list) -> list[str]:
    import json

    return [json.dumps(str(v)) for v in values]


def json_of(text: str, rules: list, classes: list) -> Column:
    """The tree in column ``text`` as JSON: splits with feature (source column's place), rule, name, relation, reference, true and false; leaves with prediction."""
    heads = _names([f'{{"feature": {r.position}, "rule": {r.index}, "name": {a}, "relation": {b}, "reference": {c}, "true": ' for r, a, b, c in zip(rules, _quoted([r.column for r in rules]), _quoted([r.relation for r in rules]), _quoted([r.reference for r in rules]), strict=True)])
    leaves = _names([f'{{"prediction": {c}, "class": {i}}}' for i, c in enumerate(_quoted(classes))])

    def step(stack: Column, token: Column) -> Column:
        n = F.regexp_replace(token, "[(]", "").cast("int")
        split = F.concat(_named(heads, n), F.element_at(stack, -1), F.lit(', "false": '), F.element_at(stack, -2), F.lit("}"))
        return F.when(token.startswith("("), F.concat(F.slice(stack, 1, F.size(stack) - 2), F.array(split))).otherwise(F.concat(stack, F.array(_named(leaves, n))))

    tokens = F.regexp_extract_all(F.col(text), F.lit("[(]?[0-9]+"), F.lit(0))
    return F.aggregate(F.reverse(tokens), F.array().cast("array<string>"), step, lambda s: F.element_at(s, 1))


def from_json(trees: DataFrame) -> DataFrame:
    """(tree_id, id, depth, rule, class) of each node, from (tree_id, json): VARIANT values, level by level in one recursive query."""
    trees.select("tree_id", "json").createOrReplaceTempView("_coppice_json_trees")
    at = lambda way, kind: f"try_variant_get(v, '$.{way}', '{kind}')"
    return trees.sparkSession.sql(f"""
WITH RECURSIVE n(tree_id, id, depth, j) AS (
  SELECT tree_id, 1L, 0, json FROM _coppice_json_trees
  UNION ALL SELECT tree_id, 2 * id + side, depth + 1, if(side = 1, get_json_object(j, '$.true'), get_json_object(j, '$.false')) FROM n, (VALUES (0), (1)) AS s(side) WHERE get_json_object(j, '$.true') IS NOT NULL)
SELECT tree_id, id, depth, {at('rule', 'int')} AS rule, {at('class', 'int')} AS class FROM (SELECT tree_id, id, depth, parse_json(j) AS v FROM n)""")


def leaf_cells(trees: DataFrame, features: int, text: str = "tree") -> DataFrame:
    """(cell: literals in order, care, val, leaf, trees): the different leaves of a set of trees and how many trees have each."""
    leaves = trees.select(F.explode(F.filter(nodes_of(text), lambda x: x.leaf.isNotNull())).alias("x")).groupBy(F.array_sort("x.path").alias("cell"), F.col("x.leaf").alias("leaf")).agg(F.count("*").alias("trees"))
    half = lambda xs: F.transform(xs, lambda x: (x / 2).cast("int"))
    holds = F.filter("cell", lambda x: x % 2 == 1)
    return leaves.select("cell", masks.of_bits(half(F.col("cell")), features).alias("care"), masks.of_bits(half(holds), features).alias("val"), "leaf", "trees")
