"""Evaluation of rankings. truth: query_key, item_id (distinct); rankings: query_key, item_id, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(ranking: DataFrame, truth: DataFrame, k: int | None = 50) -> DataFrame:
    """query_key, n_relevant, n_found for each query with truth; a repeated item counts once."""
    top = ranking.filter(F.col("rank") <= k) if k is not None else ranking
    found = top.select("query_key", "item_id").distinct().withColumn("hit", F.lit(1))
    rows = truth.select("query_key", "item_id").distinct().join(found, ["query_key", "item_id"], "left")
    return rows.groupBy("query_key").agg(F.count(F.lit(1)).alias("n_relevant"), F.count("hit").alias("n_found"))


def per_query_recall(ranking: DataFrame, truth: DataFrame, k: int | None = 50) -> DataFrame:
    return hits(ranking, truth, k).select("query_key", (F.col("n_found") / F.col("n_relevant")).alias("recall"))


def recall(ranking: DataFrame, truth: DataFrame, k: int | None = 50) -> DataFrame:
    """Macro mean; queries without truth don't count, a missing prediction counts 0."""
    return per_query_recall(ranking, truth, k).agg(F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def recall_value(ranking: DataFrame, truth: DataFrame, k: int | None = 50) -> float:
    row = recall(ranking, truth, k).first()
    if not row["n_queries"]:
        raise ValueError("no query has a relevant item")
    return row["recall"]


def hit_rate(ranking: DataFrame, truth: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """Share of queries with a hit; queries without truth count as misses."""
    got = hits(ranking, truth, k).select("query_key", (F.col("n_found") > 0).cast("int").alias("hit"))
    rows = queries.select("query_key").join(got, "query_key", "left")
    return rows.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("hit_rate"), F.count(F.lit(1)).alias("n_queries"))


def recall_sum(ranking: DataFrame, n_relevant: DataFrame, truth: DataFrame, k: int = 50) -> DataFrame:
    """Sum of recalls with given denominators (query_key, n_relevant), which count items outside the pool too."""
    found = hits(ranking, truth, k).select("query_key", "n_found")
    rows = n_relevant.join(found, "query_key", "left")
    return rows.agg(F.sum(F.coalesce("n_found", F.lit(0)) / F.col("n_relevant")).alias("recall_sum"), F.count(F.lit(1)).alias("n_queries"))


def recall_at(ranking: DataFrame, truth: DataFrame, depths: list[int]) -> DataFrame:
    """depth, recall for several depths from one join."""
    best = ranking.groupBy("query_key", "item_id").agg(F.min("rank").alias("rank"))
    rows = truth.select("query_key", "item_id").distinct().join(best, ["query_key", "item_id"], "left")
    per = rows.groupBy("query_key").agg(*[F.avg((F.coalesce("rank", F.lit(2**30)) <= d).cast("int")).alias(f"d{d}") for d in depths])
    wide = per.agg(*[F.avg(f"d{d}").alias(f"d{d}") for d in depths])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"d{d}").alias("recall")) for d in depths])).alias("x")).select("x.*")


def oracle_recall(lists: DataFrame, truth: DataFrame, sources: list[str], depth: int) -> DataFrame:
    """Recall of the whole union of the sources' tops."""
    pool = lists.filter(F.col("channel").isin(sources) & (F.col("rank") <= depth)).select("query_key", "item_id").distinct().withColumn("rank", F.lit(1))
    return recall(pool, truth, None).select(F.lit(depth).alias("depth"), "recall")


def oracle_compression(pool: DataFrame, truth: DataFrame, k: int = 50) -> DataFrame:
    """The best recall that k items out of the pool could give."""
    rows = hits(pool.withColumn("rank", F.lit(1)), truth, None)
    return rows.agg(F.avg(F.least("n_found", F.lit(k)) / F.col("n_relevant")).alias("compression_recall"))


def pool_sizes(pool: DataFrame) -> DataFrame:
    per = pool.groupBy("query_key").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg("n").alias("mean_size"), F.percentile("n", F.lit(0.95)).alias("p95_size"), F.max("n").alias("max_size"))


def slices(per_query: DataFrame, columns: list[str], value: str = "recall") -> DataFrame:
    """slice, segment, n, value: the mean in each segment of several columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("segment")) for c in columns])
    rows = per_query.select(value, F.explode(pairs).alias("x")).select("x.*", value)
    return rows.groupBy("slice", "segment").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(value))


def segments(per_query: DataFrame, membership: DataFrame, value: str = "recall") -> DataFrame:
    """The mean in each segment of a membership table (query_key, segment)."""
    return per_query.join(membership, "query_key").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(value))


def overlap(a: DataFrame, b: DataFrame, k: int = 50, denominator: str = "k") -> DataFrame:
    """query_key, overlap of two rankings' tops: by k, or by the larger list (1 if both are empty)."""
    x = a.filter(F.col("rank") <= k).select("query_key", "item_id", F.lit(1).alias("a"))
    y = b.filter(F.col("rank") <= k).select("query_key", "item_id", F.lit(1).alias("b"))
    both = x.join(y, ["query_key", "item_id"], "full")
    per = both.groupBy("query_key").agg(F.sum((F.col("a") + F.col("b") == 2).cast("int")).alias("n"), F.count("a").alias("na"), F.count("b").alias("nb"))
    n = F.coalesce("n", F.lit(0))
    size = F.lit(k) if denominator == "k" else F.greatest("na", "nb")
    return per.select("query_key", F.when(size == 0, 1.0).otherwise(n / size).alias("overlap"))


def win_tie_loss(candidate: DataFrame, baseline: DataFrame, value: str = "recall") -> DataFrame:
    d = candidate.select("query_key", F.col(value).alias("c")).join(baseline.select("query_key", F.col(value).alias("b")), "query_key").select((F.col("c") - F.col("b")).alias("d"))
    count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    return d.agg(count(F.col("d") > 0).alias("wins"), count(F.col("d") == 0).alias("ties"), count(F.col("d") < 0).alias("losses"), F.avg("d").alias("mean_delta"))


def misses(truth: DataFrame, final: DataFrame, pool: DataFrame, k: int = 50) -> DataFrame:
    """query_key, item_id, outcome: found, a selection miss (in the pool only) or a
    retrieval miss; best_rank is the item's in the pool. pool: query_key, item_id, rank."""
    top = final.filter(F.col("rank") <= k).select("query_key", "item_id").distinct().withColumn("final", F.lit(True))
    best = pool.groupBy("query_key", "item_id").agg(F.min("rank").alias("best_rank"))
    rows = truth.select("query_key", "item_id").distinct().join(top, ["query_key", "item_id"], "left").join(best, ["query_key", "item_id"], "left")
    outcome = F.when(F.col("final"), "found").when(F.col("best_rank").isNotNull(), "selection_miss").otherwise("retrieval_miss")
    return rows.select("query_key", "item_id", outcome.alias("outcome"), "best_rank")


def share(df: DataFrame, *keys: str) -> DataFrame:
    """Keys, n and the share of all rows."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row a group


def condition_share(df: DataFrame, test: Column, name: str) -> DataFrame:
    return df.agg(F.avg(test.cast("int")).alias(name))
