"""Votes of a whole set of trees, without an expression for each.

A pattern of a table's rows ends in one leaf of each tree.  So the leaves of all trees are
put together first, equal ones once with how many trees have them; each different pattern adds up the leaves it
ends in; rows get the sums of their pattern.  Patterns are those of the rules that the leaves have,
and up to ``MOST_SENT`` of them go to all tasks, so that rows stay where they are.  The plan is the same for three trees and for ten thousand.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import masks
from coppice.operators.encode import bits_of
from coppice.operators.treerows import leaf_cells
from coppice.sources.work import kept

#: Different leaves of a set, which all tasks get; more are an error.
MOST_LEAVES = 1_000_000
#: Patterns with their votes that all tasks get, some 80 bytes each; with more, rows are dealt out by pattern.
MOST_SENT = 500_000


def _table(leaves: DataFrame, most: int) -> list[tuple]:
    """For each set of features: their numbers, and the sorted codes of its leaves with votes and shares."""
    rows = leaves.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} different leaves: ask for fewer trees")
    by_features = defaultdict(dict)
    for r in rows:
        own = by_features[tuple(x >> 1 for x in r.cell)]
        code = sum((x & 1) << i for i, x in enumerate(r.cell))
        votes, share = own.get(code, (0, 0.0))
        own[code] = votes + r.votes, share + r.share
    out = []
    for features, own in sorted(by_features.items()):
        codes = sorted(own)
        out.append((features, np.array(codes, np.int64), np.array([own[c][0] for c in codes], np.int64), np.array([own[c][1] for c in codes])))
    return out


def pattern_votes(patterns: DataFrame, features: int, leaves: DataFrame, most: int = MOST_LEAVES) -> DataFrame:
    """(bits, votes, share): what the leaves (cell, votes, share) that a pattern ends in come to."""
    return _scored(patterns, features, _table(leaves, most))


def _scored(patterns: DataFrame, features: int, leaves: list[tuple]) -> DataFrame:
    table = patterns.sparkSession.sparkContext.broadcast(leaves)
    kind = masks.sql_type(features)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = b.column(0)
            words = np.asarray(bits.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(b.num_rows, -1) if masks.wide(features) else bits.to_numpy(zero_copy_only=False).reshape(-1, 1)
            has = [(words[:, f // masks.WORD] >> (f % masks.WORD)) & 1 for f in range(features)]
            votes, share = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for own, codes, own_votes, own_share in table.value:
                code = np.zeros(b.num_rows, np.int64)
                for i, f in enumerate(own):
                    code |= has[f] << i
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                met = codes[at] == code
                votes += np.where(met, own_votes[at], 0)
                share += np.where(met, own_share[at], 0.0)
            yield pa.RecordBatch.from_arrays([bits, pa.array(votes), pa.array(share)], names=["bits", "votes", "share"])

    return patterns.select("bits").mapInArrow(scan, f"bits {kind}, votes long, share double")


def predict_set(model, df: DataFrame, trees: DataFrame, cells: DataFrame, most: int = MOST_LEAVES) -> DataFrame:
    """``df`` with prob_1, the mean share of the second class over all trees, votes, how many trees say so, and the majority's prediction.

    trees: (tree) texts as rows, any number.  cells: (care, val, n_0, n_1) that hold their leaves, as a fit has them.
    Half of the votes go to the second class.
    """
    if len(model.classes) != 2:
        raise ValueError("votes are between two classes")
    p = len(model.rules)
    n = trees.count()
    if not n:
        raise ValueError("no trees to vote")
    share = F.col("n_1") / (F.col("n_0") + F.col("n_1"))
    if model.config.prob_clip:
        low, high = model.config.prob_clip
        clip = lambda x: F.least(F.lit(high), F.greatest(F.lit(low), x))
        share = clip(share) / (clip(share) + clip(1 - share))
    leaves = leaf_cells(trees, p).join(cells.select("care", "val", "n_0", "n_1"), ["care", "val"], "left")
    leaves = leaves.groupBy("cell").agg(F.sum(F.col("trees") * F.col("leaf")).alias("votes"), F.sum(F.col("trees") * F.coalesce(share, F.col("leaf").cast("double"))).alias("share"))
    table = _table(leaves, most)
    used = sorted({f for features, *_ in table for f in features})
    place = {f: i for i, f in enumerate(used)}
    table = [(tuple(place[f] for f in features), *rest) for features, *rest in table]
    bits = bits_of([model.rules[f] for f in used]).alias("_bits")
    scored = kept(_scored(df.select(bits.alias("bits")).distinct(), len(used), table), "votes").withColumnRenamed("bits", "_bits")
    own = df.select(F.struct("*").alias("row"), bits)
    vote = F.when(F.col("votes") * 2 >= n, F.lit(model.classes[1])).otherwise(F.lit(model.classes[0]))
    sent = scored.count() <= MOST_SENT
    return own.join(F.broadcast(scored) if sent else scored, "_bits").select("row.*", (F.col("share") / n).alias("prob_1"), "votes", vote.alias("prediction"))
