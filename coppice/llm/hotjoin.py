"""A join that gives rows what is known of their key, whatever part of the rows a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with over one row in so many; so there are fewer than that many hot keys, at any size.
PART = 1000


def joined_back(rows: DataFrame, known: DataFrame, on: str, total: int, small=None) -> DataFrame:
    """``rows`` left-joined with ``known`` (a row for each key, not null, with n, the key's rows) on ``on``.

    total: how many rows there are.  Hot keys are broadcast, so that their rows stay where
    they are; all other keys, each at most one row in PART, are joined through a shuffle.
    small: a condition on ``known`` that its broadcast rows must meet besides, where their size isn't fixed;
    a hot key that fails it is left to the join's own splitting.
    Both tables are read twice: pass stored ones.
    """
    is_hot = F.col("n") * PART > total
    if small is not None:
        is_hot = is_hot & small
    hot, cold = known.where(is_hot), known.where(~is_hot)
    at_hand = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on, "left")
    return at_hand.unionByName(rest)
