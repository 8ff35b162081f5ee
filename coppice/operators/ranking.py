"""The i-th best tree of a near-optimal set, out of the counts of its subtrees.

``search.entries`` counts, for each cell and outcome, the subtrees that have it.  A rank picks an
outcome of the root and a place among its trees; the place picks a pair of
outcomes of both sides and a place in each; and so on down.  So trees i to j of a set of any
size are j - i + 1 rows going down the levels, and nothing else of the set is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.operators import search
from coppice.operators.search import _SUMS, Problem

_WHOLE = "decimal(38,0)"
_ORDER = ["feature", "leaf", *_SUMS]


def _upto(order: Window, count: Column) -> Column:
    """How many come before a row, in a whole window."""
    return F.sum(count).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - count


def _started(p: Problem, root: DataFrame, first: int, last: int) -> DataFrame:
    """A row for each rank asked for: (rank, node, care, val, feature, leaf, sums, place)."""
    order = Window.orderBy(search.units(p), "leaves", *_ORDER)  # the outcomes of one cell, the root
    counted = root.withColumn("before", _upto(order, F.col("cnt").cast(_WHOLE)))
    low, high = F.lit(str(first)).cast(_WHOLE), F.lit(str(last)).cast(_WHOLE)
    met = counted.where((F.col("before") <= high) & (F.col("before") + F.col("cnt") > low))
    from_, to = F.greatest(low, F.col("before")), F.least(high, F.col("before") + F.col("cnt") - 1)
    steps = F.explode(F.sequence(F.lit(0).cast("long"), (to - from_).cast("long"))).alias("step")
    rows = met.select("*", from_.alias("from_"), steps).withColumn("rank", (F.col("from_") + F.col("step")).cast(_WHOLE))
    return rows.select("rank", F.lit(1).cast("long").alias("node"), "care", "val", *_ORDER, (F.col("rank") - F.col("before")).cast(_WHOLE).alias("place"), "rows_of_key")


def _below(p: Problem, asked: DataFrame, entries: DataFrame) -> DataFrame:
    """What is asked of both sides of each split that is asked for."""
    if p.config.min_support:
        entries = entries.join(p.cells.select("care", "val", F.col("n_total").alias("n")), ["care", "val"])
    else:
        entries = entries.withColumn("n", F.lit(0))
    sides = [[F.col(c).alias(f"{c}_{s}") for c in (*_ORDER, "cnt", "n")] for s in "lr"]
    asked = asked.where("feature >= 0")
    wanted = [F.col(c).alias(f"own_{c}") for c in ("feature", *_SUMS)]
    cells = asked.select("care", "val", F.struct("rank", "node", "place", "rows_of_key", *wanted).alias("ask"))
    pairs = search.split_pairs(p, cells, entries, *sides, ["ask"]).where(F.col("feature") == F.col("ask.own_feature")).withColumn("rows_of_key", F.col("ask.rows_of_key"))
    for c in _SUMS:
        both = F.col(f"{c}_l") + F.col(f"{c}_r")
        pairs = pairs.where((search._tidy(p, both) if c == "cost" else both) == F.col(f"ask.own_{c}"))
    pairs = search._supported(p, pairs)
    if p.config.ignore_trivial:
        pairs = pairs.where(~F.coalesce(F.col("leaf_l") == F.col("leaf_r"), F.lit(False)))
    if p.config.rule_list:
        pairs = pairs.where(F.col("leaf_l").isNotNull() | F.col("leaf_r").isNotNull())
    count = (F.col("cnt_l") * F.col("cnt_r")).cast(_WHOLE)
    order = Window.partitionBy("ask.rank", "ask.node").orderBy(*[f"{c}_{s}" for s in "lr" for c in _ORDER])
    taken = pairs.withColumn("count", count).withColumn("before", _upto(order, F.col("count")).cast(_WHOLE))
    taken = taken.where((F.col("before") <= F.col("ask.place")) & (F.col("ask.place") < F.col("before") + F.col("count"))).withColumn("left_over", (F.col("ask.place") - F.col("before")).cast(_WHOLE))
    in_right = (F.col("left_over") % F.col("cnt_r")).cast(_WHOLE)
    in_left = ((F.col("left_over") - F.col("left_over") % F.col("cnt_r")) / F.col("cnt_r")).cast(_WHOLE)

    def side(s: str, value: str, at: Column, place: Column) -> Column:
        return F.struct(F.col("ask.rank").alias("rank"), at.alias("node"), F.col("child_care").alias("care"), F.col(value).alias("val"), *[F.col(f"{c}_{s}").alias(c) for c in _ORDER], place.alias("place"), F.col("rows_of_key"))

    both = F.array(side("l", "val", 2 * F.col("ask.node"), in_left), side("r", "child_true", 2 * F.col("ask.node") + 1, in_right))
    return taken.select(F.explode(both).alias("x")).select("x.*")


def trees_between(p: Problem, found: list[DataFrame], first: int, last: int) -> DataFrame:
    """(rank, tree, objective, leaves) of the trees ranked first to last, from 0, best first: by objective, leaves, then root outcome and places.

    found: the entries of ``search.entries`` without trees, of a table without keys.
    """
    from coppice.sources.work import kept

    if first < 0 or last < first:
        raise ValueError("ranks: from 0, the last not before the first")
    asked = [kept(_started(p, found[0], first, last), "ranked")]
    for k in range(p.depth):
        asked.append(kept(_below(p, asked[k], found[k + 1]), "ranked"))
    text = None
    for own in reversed(asked):
        leaf = own.where("feature < 0").select("rank", "node", F.col("leaf").cast("string").alias("tree"))
        if text is None:
            text = leaf
            continue
        side = lambda bit, name, t=text: t.where(F.col("node") % 2 == bit).select("rank", F.shiftright("node", 1).alias("node"), F.col("tree").alias(name))
        splits = own.where("feature >= 0").join(side(1, "true"), ["rank", "node"]).join(side(0, "false"), ["rank", "node"])
        text = leaf.unionByName(splits.select("rank", "node", F.concat(F.lit("("), F.col("feature").cast("string"), F.lit(" "), "true", F.lit(" "), "false", F.lit(")")).alias("tree")))
    root = asked[0].select("rank", search.objective(p).alias("objective"), "leaves")
    return text.select("rank", "tree").join(root, "rank").select(F.col("rank"), "tree", "objective", "leaves")
