"""A fitted tree is a stateless column expression, so it scores streams as it scores tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from coppice.operators.fit import TreeModel, predict


def scored(model: TreeModel, stream: DataFrame, kind: str = "class") -> DataFrame:
    """The stream with the model's predictions; no state, no shuffle, any output mode that the stream allows."""
    if not stream.isStreaming:
        raise ValueError("not a streaming table; use predict")
    return predict(model, stream, kind)
