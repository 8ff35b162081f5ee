"""Labelled tables from files, cost matrices, and what a fit can write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_labelled(spark: SparkSession, path: str, fmt: str = "csv", label: str | None = None) -> tuple[DataFrame, str]:
    """A table with a header and its label: named, or else the last column.  CSV cells stay text, types are inferred by profiling."""
    df = spark.read.csv(path, header=True, inferSchema=False) if fmt == "csv" else spark.read.format(fmt).load(path)
    if not df.columns:
        raise ValueError(f"no columns in {path}")
    return df, label or df.columns[-1]


def read_costs(spark: SparkSession, path: str) -> tuple[list[str], tuple[tuple[float, ...], ...]]:
    """A cost matrix: the header names the classes; one row gives each class's cost of an error, K rows the whole matrix."""
    df = spark.read.csv(path, header=True, schema=None)
    names = df.columns
    rows = [[float(x) for x in r] for r in df.limit(len(names) + 1).collect()]
    if len(rows) == 1:
        matrix = tuple(tuple(0.0 if i == j else rows[0][j] for j in range(len(names))) for i in range(len(names)))
    elif len(rows) == len(names):
        matrix = tuple(map(tuple, rows))
    else:
        raise ValueError(f"{len(names)} classes need 1 or {len(names)} rows of costs")
    return names, matrix


def write_trees(spark: SparkSession, trees: list[dict], path: str) -> None:
    """One JSON document a line."""
    spark.createDataFrame([(json.dumps(t, sort_keys=True),) for t in trees], "value string").coalesce(1).write.text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_nested_trie(spark: SparkSession, trie: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(trie, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def write_covered(covered: dict[str, DataFrame], path: str) -> None:
    """Covered sets by metric, as Parquet in a folder for each."""
    for metric, df in covered.items():
        df.write.mode("overwrite").parquet(f"{path}/metric={metric}")


def check_binary(df: DataFrame, features: list[str], label: str | None = None) -> None:
    """Raise ValueError unless the features (and the label) hold 0 and 1 only; one aggregation over the table."""
    missing = [c for c in [*features, *([label] if label else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not there: {missing}")
    if not features:
        raise ValueError("no features")
    strings = [c for c in features if isinstance(df.schema[c].dataType, (T.StringType, T.DateType, T.TimestampType))]
    if strings:
        raise ValueError(f"not numeric: {strings}")
    wrong = lambda c: F.count_if(F.coalesce(~F.col(f"`{c}`").cast("double").isin(0.0, 1.0), F.lit(True)))
    row = df.agg(F.count("*").alias("rows"), *[wrong(c).alias(f"bad_{i}") for i, c in enumerate([*features, *([label] if label else [])])]).first()
    if not row["rows"]:
        raise ValueError("the table has no rows")
    bad = [c for i, c in enumerate([*features, *([label] if label else [])]) if row[f"bad_{i}"]]
    if bad:
        raise ValueError(f"values other than 0 and 1 in {bad}")
