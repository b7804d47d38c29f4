"""Ranks within a query: top k, fusion order, ensembles, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = 501


def ranked(df: DataFrame, *order: Column, by: list[str] | None = None, top: int | None = None, name: str = "rank") -> DataFrame:
    """Rank from 1 in the given order within ``by``; ``top`` plans a rank limit before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or ["query_key"])).orderBy(*order)))
    return out.filter(F.col(name) <= top) if top is not None else out


def by_score(df: DataFrame, score: str = "score", top: int | None = None, digits: int = 9, by: list[str] | None = None) -> DataFrame:
    """Score descending, then item_id; scores compare after rounding, so that the
    order of a sum's terms can't change a ranking."""
    return ranked(df, F.round(score, digits).desc(), F.col("item_id"), by=by, top=top)


def unique_top(df: DataFrame, k: int = 50) -> DataFrame:
    """query_key, item_id, rank: the first occurrence of each item, re-ranked.

    k = 0 returns everything, as the first item is taken before k is looked at.
    """
    first = df.groupBy("query_key", "item_id").agg(F.min("rank").alias("first"))
    return ranked(first, F.col("first"), F.col("item_id"), top=k or None).drop("first")


def fuse(lists: DataFrame, weights: dict[str, float], rrf_k: float = 60, top: int | None = 50, clean: bool = False) -> DataFrame:
    """Reciprocal rank fusion: query_key, item_id, rank, score, best_rank.

    lists: query_key, channel, item_id, rank. Repeats inside a list are dropped
    and ranks renewed; channels with weight zero drop out. Items are pivoted to
    one row with a rank a channel, and terms added in the order of ``weights``,
    so scores don't depend on the order of rows. clean: the lists are known to
    have no repeats and ranks from 1, so they aren't ranked again.
    """
    used = {c: w for c, w in weights.items() if w}
    rows = lists.filter(F.col("channel").isin(list(used)))
    if clean:
        return fuse_clean(rows, used, rrf_k, top)
    first = rows.groupBy("query_key", "channel", "item_id").agg(F.min("rank").alias("rank"))
    again = ranked(first, F.col("rank"), F.col("item_id"), by=["query_key", "channel"], name="place")
    return fuse_clean(again.select("query_key", "channel", "item_id", F.col("place").alias("rank")), used, rrf_k, top)


def blend(order: DataFrame, base: DataFrame, rrf_k: float = 20, top: int | None = 50) -> DataFrame:
    """A model's order and a submitted ranking fused with equal weights. Both: query_key, item_id, rank."""
    both = order.select("query_key", F.lit("order").alias("channel"), "item_id", "rank").unionByName(base.select("query_key", F.lit("base").alias("channel"), "item_id", "rank"))
    return fuse(both, {"order": 1.0, "base": 1.0}, rrf_k, top)


def fuse_clean(lists: DataFrame, used: dict[str, float], rrf_k: float, top: int | None) -> DataFrame:
    """The same for lists that hold each item once with ranks from 1."""
    wide = lists.groupBy("query_key", "item_id").agg(*[F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(f"r_{k}") for k, c in enumerate(used)])
    score, best = F.lit(0.0), []
    for k, weight in enumerate(used.values()):
        score = score + F.coalesce(F.lit(float(weight)) / (F.lit(float(rrf_k)) + F.col(f"r_{k}")), F.lit(0.0))
        best.append(F.col(f"r_{k}"))
    wide = wide.select("query_key", "item_id", score.alias("score"), (F.least(*best) if len(best) > 1 else best[0]).alias("best_rank"))
    order = (F.round("score", 12).desc(), F.col("best_rank"), F.col("item_id"))
    return ranked(wide, *order, top=top).select("query_key", "item_id", "rank", "score", "best_rank")


def fuse_systems(lists: DataFrame, systems: dict[str, dict[str, float]], rrf_k: float = 60, top: int = 250) -> DataFrame:
    """query_key, channel (the system's name), item_id, rank: several fusions of
    clean lists with one aggregation and one window over all of them."""
    parts = [F.struct(F.lit(s).alias("system"), F.lit(c).alias("channel"), F.lit(float(w)).alias("weight")) for s, ws in systems.items() for c, w in ws.items() if w]
    mine = F.filter(F.array(*parts), lambda x: x["channel"] == F.col("channel"))
    rows = lists.select("query_key", "item_id", "rank", F.explode(mine).alias("x"))
    scored = rows.groupBy("query_key", F.col("x.system").alias("channel"), "item_id").agg(F.sum(F.col("x.weight") / (F.lit(float(rrf_k)) + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))
    order = (F.round("score", 12).desc(), F.col("best_rank"), F.col("item_id"))
    return ranked(scored, *order, by=["query_key", "channel"], top=top).select("query_key", "channel", "item_id", "rank")


def fuse_grid(lists: DataFrame, configs: DataFrame, top: int = 50) -> DataFrame:
    """Fusion under each config: config, query_key, item_id, rank.

    configs: config, channel, weight, rrf_k, a small table given by the caller.
    """
    rows = lists.join(F.broadcast(configs.filter("weight <> 0")), "channel")
    scored = rows.groupBy("config", "query_key", "item_id").agg(
        F.sum(F.col("weight") / (F.col("rrf_k") + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank")
    )
    return ranked(scored, F.round("score", 12).desc(), F.col("best_rank"), F.col("item_id"), by=["config", "query_key"], top=top)


def union_pool(lists: DataFrame, sources: list[str], depth: int = 100) -> DataFrame:
    """query_key, item_id, position: items of the top of each source, in the order first seen."""
    order = F.array_position(F.array(*map(F.lit, sources)), F.col("channel"))
    rows = lists.filter(F.col("channel").isin(sources) & (F.col("rank") <= depth))
    first = rows.groupBy("query_key", "item_id").agg(F.min(F.struct(order.alias("source"), "rank")).alias("seen"))
    return ranked(first, F.col("seen"), F.col("item_id"), name="position").select("query_key", "item_id", "position")


def rank_table(lists: DataFrame, channels: list[str], missing: int = MISSING) -> DataFrame:
    """query_key, item_id and a rank column for each channel, ``missing`` where absent."""
    cols = [F.coalesce(F.min(F.when(F.col("channel") == c, F.col("rank"))), F.lit(missing)).cast("int").alias(c) for c in channels]
    return lists.filter(F.col("channel").isin(channels)).groupBy("query_key", "item_id").agg(*cols)


def mean_reciprocal_rank(scored: DataFrame, models: list[str], tie: str = "fused", offset: float = 20.0, top: int | None = 50) -> DataFrame:
    """Items by the mean over models of 1 / (offset + rank), ties by ``tie``."""
    out, score = scored, F.lit(0.0)
    for k, m in enumerate(models):
        out = ranked(out, F.col(m).desc(), F.col(tie), F.col("item_id"), name=f"place_{k}")
        score = score + 1.0 / (F.lit(offset) + F.col(f"place_{k}"))
    out = out.withColumn("score", score / F.lit(float(len(models))))
    return ranked(out, F.round("score", 12).desc(), F.col(tie), F.col("item_id"), top=top).select("query_key", "item_id", "rank", "score")


def reserve_fill(selector: DataFrame, base: DataFrame, reserve: int, k: int = 50) -> DataFrame:
    """The first k - reserve of selector, then base's items that aren't among them, up to k."""
    head = selector.filter(F.col("rank") <= k - reserve).select("query_key", "item_id", F.lit(0).alias("part"), "rank")
    fill = base.select("query_key", "item_id", F.lit(1).alias("part"), "rank").join(head.select("query_key", "item_id"), ["query_key", "item_id"], "left_anti")
    return ranked(head.unionByName(fill).withColumnRenamed("rank", "old"), F.col("part"), F.col("old"), F.col("item_id"), top=k).select("query_key", "item_id", "rank")


def partition_allowed(lists: DataFrame, allowed: Column, mode: str) -> DataFrame:
    """Ranks after a filter: ``hard`` drops what isn't allowed, ``stable`` moves it behind."""
    by = ["query_key", "channel"]
    rows = (lists.filter(allowed) if mode == "hard" else lists).withColumnRenamed("rank", "old")
    behind = F.when(allowed, 0).otherwise(1)
    return ranked(rows, behind, F.col("old"), by=by).drop("old")


def hard_negatives(frame: DataFrame, most: int = 201) -> DataFrame:
    return ranked(frame, F.col("label").desc(), F.col("min_rank"), F.col("item_id"), top=most, name="place")
