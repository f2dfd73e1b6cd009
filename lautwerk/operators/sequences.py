"""Ordered contexts: what stands before and after each element of a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(df: DataFrame, key: str, order: str, symbol: str) -> DataFrame:
    """``source, target`` of every element that has a successor in its sequence."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select(F.col(symbol).alias("source"), F.lead(symbol).over(w).alias("target")).where("target is not null")


def neighbours(df: DataFrame, key: str, order: str, symbol: str, reach: int = 3) -> DataFrame:
    """``df`` with before_1.., after_1.. and position: initial, medial, final; a sequence of one is initial."""
    w = Window.partitionBy(key).orderBy(order)
    columns = {f"before_{k}": F.lag(symbol, k).over(w) for k in range(1, reach + 1)}
    columns |= {f"after_{k}": F.lead(symbol, k).over(w) for k in range(1, reach + 1)}
    position = F.when(F.lag(symbol).over(w).isNull(), "initial").when(F.lead(symbol).over(w).isNull(), "final").otherwise("medial")
    return df.withColumns(columns | {"position": position})


def somewhere(df: DataFrame, key: str, order: str, tests: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with a boolean for each test: whether it holds anywhere 'before' or 'after' the element."""
    w = Window.partitionBy(key).orderBy(order)
    frame = {"before": w.rowsBetween(Window.unboundedPreceding, -1), "after": w.rowsBetween(1, Window.unboundedFollowing)}
    return df.withColumns({name: F.coalesce(F.bool_or(test).over(frame[side]), F.lit(False)) for name, (side, test) in tests.items()})
