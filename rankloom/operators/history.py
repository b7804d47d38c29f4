"""Retrieval through past queries: character n-gram TF-IDF neighbours and their clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import ranked


def click_postings(clicks: DataFrame) -> DataFrame:
    """query_norm, item_id, clicks."""
    return clicks.groupBy("query_norm", "item_id").agg(F.count(F.lit(1)).alias("clicks"))


def gram_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, F.explode(T.char_ngrams(text)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(history: DataFrame, min_df: int = 2, most: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of the history's texts (text, gram, weight) and gram, idf.

    Sublinear term frequency, smooth idf, grams in min_df texts or more, the most
    frequent ``most`` of them.
    """
    counts = gram_counts(history, "text", "text")
    every = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).filter(F.col("df") >= min_df)
    kept = every.orderBy(F.col("cf").desc(), "gram").limit(most)
    n = history.agg(F.count(F.lit(1)).alias("n"))
    idf = kept.join(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return unit_vectors(counts, "text", idf), idf


def unit_vectors(counts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    raw = counts.join(idf, "gram").select(key, "gram", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("weight"))


def neighbours(queries: DataFrame, history: DataFrame, k: int = 50) -> DataFrame:
    """query_key, text, similarity: the k nearest texts by cosine, among those that share a gram."""
    vectors, idf = tfidf(history)
    q = unit_vectors(gram_counts(queries, "query_key", "search_query"), "query_key", idf)
    pairs = q.withColumnRenamed("weight", "qw").join(vectors, "gram")
    near = pairs.groupBy("query_key", "text").agg(F.sum(F.col("qw") * F.col("weight")).alias("similarity"))
    return ranked(near, F.round("similarity", 9).desc(), F.col("text"), top=k)


def rank_by_history(near: DataFrame, clicks: DataFrame, queries: DataFrame, threshold: float = 0.3, boost: float = 1.5, top: int = 250) -> DataFrame:
    """query_key, item_id, rank, score, best: items clicked under the neighbours.

    Each gives similarity^2 times ln(1 + clicks), boosted where the click's
    location is the query's. clicks: query_norm, item_id, location; queries: query_key, location.
    """
    posted = clicks.groupBy("query_norm", "item_id", "location").agg(F.count(F.lit(1)).alias("clicks"))
    hits = near.filter(F.col("similarity") >= threshold).join(posted, F.col("text") == F.col("query_norm"))
    hits = hits.join(queries.select("query_key", F.col("location").alias("q_location")), "query_key")
    gain = F.col("similarity") * F.col("similarity") * F.log1p("clicks") * F.when(F.col("location").eqNullSafe(F.col("q_location")), boost).otherwise(1.0)
    scored = hits.groupBy("query_key", "item_id").agg(F.sum(gain).alias("score"), F.max("similarity").alias("best"))
    return ranked(scored, F.round("score", 9).desc(), F.round("best", 9).desc(), F.col("item_id"), top=top)
