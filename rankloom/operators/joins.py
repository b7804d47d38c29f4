"""Joins with the guarantees that pipelines ask of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, keys: list[str], name: str) -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{name} repeats {', '.join(keys)}")


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables whose keys are checked to be unique."""
    require_unique(a, keys, "left side")
    require_unique(b, keys, "right side")
    return a.join(b, keys)



def without(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a with no equal keys in b; nulls are equal to each other."""
    right = b.select(*keys).distinct().select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return a.join(right, on, "left_anti")


def within(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    right = b.select(*keys).distinct().select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return a.join(right, on, "left_semi")


def assert_no_leak(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    if not within(a, b, keys).isEmpty():
        raise ValueError("rows of one table are in the other")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Adds value by key, the default where the key isn't found. The optimizer chooses the join."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label 1 where (query_key, item_id) is in truth, else 0."""
    yes = truth.select("query_key", "item_id").distinct().withColumn("_yes", F.lit(1))
    return pairs.join(yes, ["query_key", "item_id"], "left").withColumn("label", F.coalesce("_yes", F.lit(0))).drop("_yes")


def collisions(pairs: DataFrame, batch: str = "batch") -> DataFrame:
    """Pairs of rows of one batch (a bounded size) with the same query or item id: batch, a, b.
    Two equi-joins, so a batch is never paired with itself as a whole."""
    out = None
    for column in ("query_id", "item_id"):
        x = pairs.select(batch, F.col("row").alias("a"), column)
        y = pairs.select(batch, F.col("row").alias("b"), column)
        hit = x.join(y, [batch, column]).filter("a < b").select(batch, "a", "b")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()
