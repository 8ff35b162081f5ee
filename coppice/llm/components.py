"""Connected components of a table of links, in rounds of joins on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.storage import discard, stored, working_tables


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(arcs: DataFrame) -> DataFrame:
    """Each arc (u, v) with m, the least of u and all its neighbours; the minimum combines before the shuffle."""
    least = arcs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return arcs.join(least, "u")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: comparable, not null); root is the component's least node.

    Alternates two steps.  *Large*: each neighbour above u is tied to the least of
    u's neighbourhood.  *Small*: u and its neighbours below u are tied to the least
    of them.  Each round is written to the shared folder, the one before it
    deleted; it ends when a round changes nothing.  A node with very many links is only ever reduced to a minimum
    or split by skew handling of the join.  No links give no rows.
    """
    spark = links.sparkSession
    with working_tables(spark) as old:
        links = stored(links.where("u <> v").select("u", "v").distinct(), "links")
    before = _signature(links)
    for _ in range(rounds):
        if not before[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        tied = _with_least(down)
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        with working_tables(spark) as new:
            links = stored(small.where("u <> v").distinct(), "links")
        after = _signature(links)
        discard(spark, old)
        old = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    member = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return member.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
