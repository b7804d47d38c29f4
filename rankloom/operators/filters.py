"""Structured filters between queries and items, as joins without a theta condition.

``category = 0`` asks for every category. A condition (q.category = 0 or
q.category = i.category) would make a nested loop; it is split into an equi-join
of the filtered queries and one of the unfiltered, each on what they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_COLUMNS = ["query_key", "category", "location", "delivery", "least_rating"]


def global_ok(q: str = "q_", i: str = "") -> Column:
    category = (F.col(f"{q}category") == 0) | (F.col(f"{q}category") == F.col(f"{i}category"))
    rating = F.col(f"{q}least_rating").isNull() | (F.coalesce(f"{i}rating", F.lit(-1.0)) >= F.col(f"{q}least_rating"))
    return category & rating


def local_ok(q: str = "q_", i: str = "") -> Column:
    """On top of the global conditions; delivery queries have no local channel."""
    return global_ok(q, i) & (F.col(f"{q}delivery") == 0) & (F.col(f"{q}location") == F.col(f"{i}location"))


def query_side(queries: DataFrame) -> DataFrame:
    """query_key and q_ columns that the conditions read. queries: with least_rating."""
    return queries.select("query_key", *[F.col(c).alias(f"q_{c}") for c in QUERY_COLUMNS[1:]])


def pool_counts(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_key, n, sum_ids: how many items a query's global filters allow, and the sum of their ids.

    Items are counted by category (0: all) and rating first; queries meet these counts, never items.
    """
    per = items.groupBy("category", "rating").agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("ids"))
    every = per.groupBy("rating").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).withColumn("category", F.lit(0).cast(items.schema["category"].dataType))
    counts = per.filter("category <> 0").unionByName(every)
    met = queries.select("query_key", "category", "least_rating").join(counts, "category")
    allowed = met.filter(F.col("least_rating").isNull() | (F.coalesce("rating", F.lit(-1.0)) >= F.col("least_rating")))
    return allowed.groupBy("query_key").agg(F.sum("n").alias("n"), F.sum("ids").alias("sum_ids"))


def eligible_local(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Every (query_key, item_id) that passes the local filters, joined on the location; for selective filters."""
    q = query_side(queries)
    return q.join(items, q.q_location == items.location).filter(local_ok()).select("query_key", "item_id")


def fill_candidates(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """query_key, item_id: the k first eligible items by item_id, for each query.

    Items are cut to k for each distinct filter before any query meets them:
    a cut a category (and over all) and asked rating.
    """
    ratings = queries.select("least_rating").distinct()
    asked = items.join(F.broadcast(ratings)).filter(F.col("least_rating").isNull() | (F.coalesce("rating", F.lit(-1.0)) >= F.col("least_rating")))
    from .ranking import ranked

    keyed = asked.select("item_id", "least_rating", F.explode(F.array(F.lit(0).cast("long"), F.col("category"))).alias("category"))
    cut = ranked(keyed, F.col("item_id"), by=["least_rating", "category"], top=k)
    q = queries.select("query_key", "category", "least_rating")
    return q.join(cut, (q.category == cut.category) & q.least_rating.eqNullSafe(cut.least_rating)).select("query_key", "item_id")
