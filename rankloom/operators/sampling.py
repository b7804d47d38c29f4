"""Splits and samples by hash order: the same rows on every run and at every size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut
from .ranking import ranked


def shuffled(*keys: str, seed: int = 42) -> Column:
    """A fixed random order of the keys, that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffled(key, seed=seed), key).limit(n)


def with_strata(queries: DataFrame, pool_sizes: DataFrame, frequency: DataFrame) -> DataFrame:
    """Adds has_filters, local pool and frequency buckets and primary_stratum.
    pool_sizes: query_key, local_pool_size; frequency: query_key, query_frequency."""
    rows = queries.join(pool_sizes, "query_key", "left").join(frequency, "query_key", "left")
    rows = rows.withColumns({
        "local_pool_size": F.coalesce("local_pool_size", F.lit(0)), "query_frequency": F.coalesce("query_frequency", F.lit(0)),
        "has_filters": F.length(F.trim(F.coalesce("filters", F.lit("")))) > 0,
    })
    rows = rows.withColumns({
        "local_pool_bucket": cut("local_pool_size", [0, 99, 499, 1999, 9999], ["0", "1-99", "100-499", "500-1999", "2000-9999", "10000+"]),
        "query_frequency_bucket": cut("query_frequency", [1, 5, 20], ["0-1", "2-5", "6-20", "21+"]),
    })
    return rows.withColumn("primary_stratum", F.concat_ws("|", F.col("has_filters").cast("string"), F.col("delivery").cast("string"), "local_pool_bucket"))


def stratified(df: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """Rows by hash order up to the quota of each stratum (stratum, quota)."""
    rows = ranked(df, shuffled(key, stratum, seed=seed), F.col(key), by=[stratum], name="_place")
    return rows.join(quotas, stratum).filter(F.col("_place") <= F.col("quota")).drop("_place", "quota")


def proportional_quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """Quotas by share, rounded down, the deficit going to the largest remainders (a row a stratum)."""
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    n = n.withColumn("exact", F.col("n") * total / F.sum("n").over(every)).withColumn("base", F.floor("exact"))
    order = F.row_number().over(every.orderBy((F.col("exact") - F.col("base")).desc(), stratum))
    left = F.lit(total) - F.sum("base").over(every)
    return n.withColumn("quota", F.least(F.col("n"), F.col("base") + (order <= left).cast("long"))).select(stratum, "quota")


def folds(df: DataFrame, stratum: str, key: str, k: int = 2, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1, even within each stratum."""
    rows = ranked(df, shuffled(key, seed=seed), F.col(key), by=[stratum], name="_place")
    return rows.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place")


def fit_tune(df: DataFrame, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """Adds part: three in four rows of each stratum to fit, one to tune."""
    return folds(df, stratum, key, 4, seed).withColumn("part", F.when(F.col("fold") < 3, "fit").otherwise("tune")).drop("fold")


def tail(queries: DataFrame) -> DataFrame:
    return queries.filter(F.col("query_frequency") <= 1)


def category_clustered(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Sorted so that a batch shares a category, in hash order inside it."""
    return pairs.orderBy("category", shuffled("item_id", seed=seed), "item_id")


def pu_bag(frame: DataFrame, seed: int, budget: int = 48, hard_budget: int = 32, hard_fused: int = 75, hard_channel: int = 40) -> DataFrame:
    """All positives and ``budget`` unlabelled rows of each query, up to
    ``hard_budget`` of them hard (high in the pool or in a channel), the rest
    others, refilled from what is left. frame: query_key, item_id, label, fused, min_rank."""
    hard = (F.col("fused") <= hard_fused) | (F.col("min_rank") <= hard_channel)
    order = shuffled("query_key", "item_id", seed=seed)
    rows = frame.withColumn("_kind", F.when(F.col("label") == 1, 0).when(hard, 1).otherwise(2))
    rows = ranked(rows, order, F.col("item_id"), by=["query_key", "_kind"], name="_place")
    n_hard = F.sum((F.col("_kind") == 1).cast("int")).over(Window.partitionBy("query_key"))
    # first choice: hard rows up to their budget, others up to what that leaves; then whatever is left
    first = F.when(F.col("_kind") == 1, F.col("_place") <= hard_budget).otherwise(F.col("_place") <= budget - F.least(n_hard, F.lit(hard_budget)))
    rows = rows.withColumn("_later", F.when(F.col("_kind") == 0, 0).when(first, 1).otherwise(2))
    rows = ranked(rows, F.col("_later"), order, F.col("item_id"), by=["query_key", "label"], name="_take")
    return rows.filter((F.col("label") == 1) | (F.col("_take") <= budget)).drop("_kind", "_place", "_later", "_take")


def training_pairs(pairs: DataFrame, holdout: DataFrame, signature: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Pairs to train on and the number left after each step (step, name, n).

    Pairs whose signature is in the holdout go, then those of empty text, then
    repeats of (query_text, item_id); what is left comes in hash order.
    """
    from .joins import without

    steps = [("all", pairs)]
    steps.append(("no_leak", without(pairs, holdout, signature)))
    steps.append(("has_text", steps[-1][1].filter(F.length(F.trim("query_text")) > 0)))
    steps.append(("distinct", steps[-1][1].dropDuplicates(["query_text", "item_id"])))
    counts = None
    for k, (name, df) in enumerate(steps):
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("step"), F.lit(name).alias("name"), "n")
        counts = row if counts is None else counts.unionByName(row)
    return steps[-1][1].orderBy(shuffled("query_text", "item_id", seed=seed)), counts


def best_passage(pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """For each pair its item's passage that shares most tokens with the query, the first of equals.
    pairs: query_key, item_id, tokens; passages: item_id, chunk, passage."""
    from ..functions.text import token_set

    p = passages.withColumn("ptokens", token_set("passage"))
    rows = pairs.join(p, "item_id").withColumn("shared", F.size(F.array_intersect("tokens", "ptokens")))
    return ranked(rows, F.col("shared").desc(), F.col("chunk"), by=["query_key", "item_id"], top=1, name="_k").drop("_k", "ptokens", "tokens")
