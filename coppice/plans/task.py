"""The labelled table that the queries work on, in Spark and in SQL.

The task: whether a line item brings 60 000 or more (eight predicates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names and conditions of the line item task; the same text serves both engines.
TESTS = {
    "price_low": "l_extendedprice >= 26881", "price_mid": "l_extendedprice >= 53028", "price_high": "l_extendedprice >= 79194", "discount": "l_discount >= 0.05",
    "quantity": "l_quantity >= 25", "tax": "l_tax >= 0.04", "returned": "l_returnflag = 'R'", "finished": "l_linestatus = 'F'",
}
LABEL = "l_extendedprice * (1 - l_discount) >= 60000"
NAMES = list(TESTS)
P = len(TESTS)
FOLD_KEY = ("l_orderkey", "l_linenumber")
#: A total order of rows: the key above repeats in the synthetic table.
FOLD_ORDER = (*FOLD_KEY, "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def tests() -> list[Column]:
    return [F.expr(t) for t in TESTS.values()]


def label() -> Column:
    return F.expr(LABEL).cast("int")


def binary(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, the eight 0/1 features, y)."""
    return lineitem(spark, sf_dir).select(*keep, *[F.coalesce(F.expr(t), F.lit(False)).cast("int").alias(n) for n, t in TESTS.items()], label().alias("y"))


#: CTEs: rows with their bits, patterns, and all cells of at most two literals.
SQL_BITS = " + ".join(f"CASE WHEN {t} THEN {1 << k} ELSE 0 END" for k, t in enumerate(TESTS.values()))
SQL_ROWS = f"b AS (SELECT *, ({SQL_BITS})::BIGINT AS bits, ({LABEL})::INT AS y FROM lineitem)"
SQL_PATTERNS = f"{SQL_ROWS}, pat AS (SELECT bits, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1 FROM b GROUP BY bits)"


def sql_cells(depth: int, patterns: str = "pat", keys: str = "", name: str = "c") -> str:
    on = f"{keys}, " if keys else ""
    return f"""{name} AS (SELECT {on}m AS care, bits & m AS val, bit_count(m)::INT AS k, sum(n_0)::BIGINT AS n_0, sum(n_1)::BIGINT AS n_1
  FROM {patterns}, (SELECT unnest(range({1 << P}))::BIGINT AS m) WHERE bit_count(m) <= {depth} GROUP BY ALL)"""
