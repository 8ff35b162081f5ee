"""Trees: text, JSON, paths, tables of nodes, and the column that applies one."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A leaf (prediction: class index) or a split (feature: rule index) with the sides where the rule holds and fails."""

    feature: int | None
    true: Tree | None
    false: Tree | None
    prediction: int | None

    def text(self) -> str:
        return str(self.prediction) if self.feature is None else f"({self.feature} {self.true.text()} {self.false.text()})"

    def leaves(self) -> int:
        return 1 if self.feature is None else self.true.leaves() + self.false.leaves()

    def depth(self) -> int:
        return 0 if self.feature is None else 1 + max(self.true.depth(), self.false.depth())

    def features(self) -> set[int]:
        return set() if self.feature is None else {self.feature} | self.true.features() | self.false.features()

    def cells(self, care: int = 0, val: int = 0, node: int = 1):
        """(node, care, val, subtree) of each node; the root is 1, a node's false and true sides 2i and 2i+1."""
        yield node, care, val, self
        if self.feature is not None:
            b = 1 << self.feature
            yield from self.false.cells(care | b, val, 2 * node)
            yield from self.true.cells(care | b, val | b, 2 * node + 1)


def parse(text: str) -> Tree:
    tokens = text.replace("(", " ( ").replace(")", " ) ").split()
    at = 0

    def take() -> Tree:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"not a tree: {text!r}")
        t = tokens[at]
        at += 1
        if t != "(":
            return Tree(None, None, None, int(t))
        feature = int(tokens[at])
        at += 1
        true, false = take(), take()
        if at >= len(tokens) or tokens[at] != ")":
            raise ValueError(f"not a tree: {text!r}")
        at += 1
        return Tree(feature, true, false, None)

    out = take()
    if at != len(tokens):
        raise ValueError(f"not a tree: {text!r}")
    return out


def column_of(tree: Tree, tests: list[Column], leaf) -> Column:
    """Nested CASE WHEN; ``leaf`` gives the column of a node number and leaf."""

    def build(t: Tree, node: int) -> Column:
        if t.feature is None:
            return leaf(node, t)
        return F.when(tests[t.feature], build(t.true, 2 * node + 1)).otherwise(build(t.false, 2 * node))

    return build(tree, 1)


def to_json(tree: Tree, rules: list, classes: list, stats: dict[tuple[int, int], dict], regularization: float, objective: float | None = None) -> dict:
    """The wire form: leaves with prediction, loss, complexity and probabilities; splits with feature, name, relation, reference, type."""

    def node(t: Tree, care: int, val: int) -> dict:
        if t.feature is None:
            s = stats.get((care, val), {})
            return {"prediction": classes[t.prediction], "name": "prediction", "loss": s.get("loss", 0.0), "complexity": regularization, "probabilities": s.get("probabilities", [1.0 if k == t.prediction else 0.0 for k in range(len(classes))])}
        r, b = rules[t.feature], 1 << t.feature
        kind = {"binary": "categorical", "numeric_binary": "integral"}.get(r.kind, r.kind)
        return {"feature": r.position, "name": r.column, "relation": r.relation, "reference": r.reference, "type": kind, "true": node(t.true, care | b, val | b), "false": node(t.false, care | b, val)}

    out = node(tree, 0, 0)
    if objective is not None:
        out["model_objective"] = objective
    return out


def from_json(doc: dict, rules: list, classes: list) -> tuple[Tree, dict]:
    """The tree and its leaves' loss and probabilities by cell."""
    stats: dict = {}
    index = {(r.column, r.relation, r.reference): r.index for r in rules}

    def node(d: dict, care: int, val: int) -> Tree:
        if "feature" not in d:
            stats[care, val] = {"loss": d["loss"], "probabilities": d["probabilities"]}
            return Tree(None, None, None, classes.index(d["prediction"]))
        k = index[d["name"], d["relation"], d["reference"]]
        return Tree(k, node(d["true"], care | 1 << k, val | 1 << k), node(d["false"], care | 1 << k, val), None)

    return node(doc, 0, 0), stats


def canonical_json(doc: dict) -> str:
    return json.dumps(doc, sort_keys=True, separators=(",", ":"))


def validate(tree: Tree, features: int, classes: int) -> None:
    """Raise ValueError for a node that isn't a leaf or a split, an unknown feature or class, or a feature used twice on a path."""

    def walk(t: Tree, used: frozenset) -> None:
        if t.feature is None:
            if t.true or t.false or t.prediction is None or not 0 <= t.prediction < classes:
                raise ValueError(f"not a leaf: {t}")
            return
        if not (t.true and t.false) or not 0 <= t.feature < features or t.feature in used:
            raise ValueError(f"not a split: {t}")
        walk(t.true, used | {t.feature})
        walk(t.false, used | {t.feature})

    walk(tree, frozenset())


def n_ary(tree: Tree, rules: list, classes: list) -> dict:
    """Nested splits on one source column as one node: ranges of an ordinal column, values of a categorical one."""
    if tree.feature is None:
        return {"prediction": classes[tree.prediction]}
    column = rules[tree.feature].column
    children: list[dict] = []

    def walk(t: Tree, low: str | None, high: str | None, is_: list, not_: list) -> None:
        if t.feature is not None and rules[t.feature].column == column:
            r = rules[t.feature]
            if r.relation == ">=":
                walk(t.false, low, r.reference, is_, not_)
                walk(t.true, r.reference, high, is_, not_)
            else:
                walk(t.false, low, high, is_, [*not_, r.reference])
                walk(t.true, low, high, [*is_, r.reference], not_)
            return
        if low is not None or high is not None:
            inside = f"[{low or '-inf'}, {high or 'inf'})"
        else:
            inside = " and ".join(is_) if is_ else "not " + ", ".join(not_)
        children.append({"in": inside, "then": n_ary(t, rules, classes)})

    walk(tree, None, None, [], [])
    return {"feature": rules[tree.feature].position, "name": column, "children": children}


def readable(tree: Tree, rules: list, classes: list, indent: int = 0) -> str:
    pad = "  " * indent
    if tree.feature is None:
        return f"{pad}predict {classes[tree.prediction]}"
    name = rules[tree.feature].name
    return f"{pad}if {name}\n{readable(tree.true, rules, classes, indent + 1)}\n{pad}else\n{readable(tree.false, rules, classes, indent + 1)}"


def pretty(doc: dict) -> str:
    """A tree's JSON over several lines."""
    return json.dumps(doc, indent=2, ensure_ascii=False)


def graph_text(tree: Tree, rules: list, classes: list) -> str:
    """The tree as a directed graph in DOT, nodes numbered as in a heap."""
    quoted = lambda x: json.dumps(str(x), ensure_ascii=False)
    lines = ["digraph tree {"]
    for node, _, _, t in tree.cells():
        label, shape = (f"predict {classes[t.prediction]}", "ellipse") if t.feature is None else (rules[t.feature].name, "box")
        lines.append(f"  n{node} [label={quoted(label)}, shape={shape}];")
        if node > 1:
            lines.append(f'  n{node // 2} -> n{node} [label="{"true" if node % 2 else "false"}"];')
    return "\n".join([*lines, "}"])


def rules_of(tree: Tree, rules: list, classes: list) -> list[tuple[int, str, object]]:
    """(number, condition, class) of each leaf, from the true side on."""
    out: list = []

    def walk(t: Tree, path: list[str]) -> None:
        if t.feature is None:
            out.append((len(out) + 1, " AND ".join(path) or "TRUE", classes[t.prediction]))
            return
        walk(t.true, [*path, rules[t.feature].name])
        walk(t.false, [*path, f"NOT {rules[t.feature].name}"])

    walk(tree, [])
    return out


_NODES = "tree_id long, id long, parent_id long, depth int, type string, label string, prediction string, feature int"


def nodes_df(spark: SparkSession, trees: list[Tree], rules: list, classes: list) -> DataFrame:
    """A row for each node of each tree; ids as in a heap: root 1, false side 2i, true side 2i+1."""
    rows = []
    for i, tree in enumerate(trees, 1):
        for node, care, _, t in tree.cells():
            leaf = t.feature is None
            rows.append((i, node, node // 2 if node > 1 else None, care.bit_count(), "leaf" if leaf else "decision", f"Pred: {classes[t.prediction]}" if leaf else rules[t.feature].name, str(classes[t.prediction]) if leaf else None, None if leaf else t.feature))
    return spark.createDataFrame(rows, _NODES)


def edges_df(nodes: DataFrame) -> DataFrame:
    """(tree_id, from, to, label) of each node but the roots."""
    return nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("from"), F.col("id").alias("to"), F.when(F.col("id") % 2 == 1, "true").otherwise("false").alias("label"))


def layout(nodes: DataFrame) -> DataFrame:
    """Edges with the places of both ends and of their middle: two levels down a step, nodes of a level side by side."""
    from pyspark.sql.window import Window

    level = Window.partitionBy("tree_id", "depth")
    placed = nodes.withColumn("x", F.row_number().over(level.orderBy("id")) - (F.count("*").over(level) + 1) / 2).withColumn("y", 0.0 - 2.0 * F.col("depth"))
    edges = edges_df(nodes)
    a = placed.select("tree_id", F.col("id").alias("from"), F.col("x").alias("x_from"), F.col("y").alias("y_from"))
    b = placed.select("tree_id", F.col("id").alias("to"), F.col("x").alias("x_to"), F.col("y").alias("y_to"))
    return edges.join(a, ["tree_id", "from"]).join(b, ["tree_id", "to"]).withColumns({"x_mid": (F.col("x_from") + F.col("x_to")) / 2, "y_mid": (F.col("y_from") + F.col("y_to")) / 2})


def tree_summary(nodes: DataFrame) -> DataFrame:
    """(tree_id, n_nodes, n_decisions, n_leaves, max_depth)."""
    return nodes.groupBy("tree_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("type") == "decision").alias("n_decisions"), F.count_if(F.col("type") == "leaf").alias("n_leaves"), F.max("depth").alias("max_depth"))


def trie(trees: list[Tree]) -> dict:
    """Trees as a prefix tree over levels: a level's key lists its features, a leaf of class c as -(c+1)."""
    root: dict = {}
    for tree in trees:
        here, level = root, [tree]
        while level:
            key = " ".join(str(-(t.prediction + 1) if t.feature is None else t.feature) for t in level)
            here = here.setdefault(key, {})
            level = [c for t in level if t.feature is not None for c in (t.true, t.false)]
    return root


def level_paths(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    """(tree, path: array of levels, each an array of features or -(class+1))."""
    rows = []
    for tree in trees:
        path, level = [], [tree]
        while level:
            path.append([-(t.prediction + 1) if t.feature is None else t.feature for t in level])
            level = [c for t in level if t.feature is not None for c in (t.true, t.false)]
        rows.append((tree.text(), path))
    return spark.createDataFrame(rows, "tree string, path array<array<int>>")
