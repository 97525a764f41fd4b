"""Shared pieces of the training-data operators: scratch tables, input tables, repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions.scratch import spread
from lorewright.functions.scratch import written as materialize

__all__ = ["hot_size", "join_hot", "materialize", "once", "spread", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """Repeated rows count once: one row per key; rows without key are dropped (they cannot be named in a result)."""
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key])


def hot_size(total: int, parts: int = 1000, least: int = 20_000) -> int:
    """From how many rows on a key is hot: more than a thousandth of all rows, so that at most ``parts`` keys are."""
    return max(least, total // parts)


def join_hot(rows: DataFrame, reps: DataFrame, keys: list[str], n: str, total: int, parts: int = 1000, least: int = 20_000, any_hot: bool | None = None, hint: str | None = None) -> DataFrame:
    """Inner join of rows to the few records of their key (a written table), where column ``n`` tells how many rows a key has.

    The records of hot keys are broadcast, so no task gets the rows of a hot key; all other keys are joined by shuffle.
    any_hot: whether there are hot keys, if that is known already. hint: how the other keys are joined."""
    size = hot_size(total, parts, least)
    hinted = lambda r: r.hint(hint) if hint else r
    hot = reps.filter(F.col(n) > size)
    if hot.isEmpty() if any_hot is None else not any_hot:
        return rows.join(hinted(reps), keys)
    cold = reps.filter(F.col(n) <= size)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(hinted(cold), keys))
