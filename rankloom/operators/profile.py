"""Profiles of tables and shifts between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_profile(df: DataFrame) -> DataFrame:
    """column_name, n_rows, n_null, null_rate, n_unique (without nulls), in one pass over the table."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for k, c in enumerate(df.columns):
        aggs += [F.count(c).alias(f"_c{k}"), F.countDistinct(c).alias(f"_d{k}")]
    row = df.agg(*aggs)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"), (F.col("_n") - F.col(f"_c{k}")).alias("n_null"), F.col(f"_d{k}").alias("n_unique"))
        for k, c in enumerate(df.columns)
    ]
    out = row.select(F.explode(F.array(*entries)).alias("x")).select("x.*")
    return out.select("column_name", "n_rows", "n_null", (F.col("n_null") / F.greatest("n_rows", F.lit(1))).alias("null_rate"), "n_unique")


def repeated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows repeat the keys of another, nulls equal; is_unique says that none does."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return out.withColumn("is_unique", F.col("n_repeated") == 0)


def quantiles(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """quantile, value: exact, interpolated."""
    found = df.agg(F.percentile(value, F.array(*map(F.lit, qs))).alias("q"))
    return found.select(F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("quantile"), F.col("q").alias("value"))).alias("x")).select("x.quantile", "x.value")


def crosstab(df: DataFrame, row: str, column: str, values: list, normalize: bool = False) -> DataFrame:
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    cols = [F.coalesce(F.col(str(v)), F.lit(0)) for v in values]
    total = sum(cols[1:], cols[0])
    return wide.select(row, *[(c / total if normalize else c).alias(str(v)) for c, v in zip(cols, values)])


def pivot_mean(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))


def compare_shares(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, share_a, share_b, ratio over the values of either table."""

    def shares(df, name):
        n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return n.select(key, (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))

    both = shares(a, "share_a").join(shares(b, "share_b"), key, "full")
    both = both.select(key, F.coalesce("share_a", F.lit(0.0)).alias("share_a"), F.coalesce("share_b", F.lit(0.0)).alias("share_b"))
    return both.withColumn("ratio", F.when(F.col("share_b") > 0, F.col("share_a") / F.col("share_b")))


def total_variation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Half the summed difference of shares, and the share of b whose value a lacks."""
    s = compare_shares(a, b, key)
    return s.agg((F.sum(F.abs(F.col("share_a") - F.col("share_b"))) / 2).alias("total_variation"), F.coalesce(F.sum(F.when(F.col("share_a") == 0, F.col("share_b"))), F.lit(0.0)).alias("unseen_share"))


def exposure(texts: DataFrame, history: DataFrame, key: str, most: int = 32) -> DataFrame:
    """Share of texts seen in history, and history rows counted up to ``most`` a text."""
    seen = history.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = texts.select(key).join(seen, key, "left")
    return rows.agg(
        F.count(F.lit(1)).alias("n_texts"), F.avg(F.col("n").isNotNull().cast("int")).alias("seen_share"),
        F.avg((F.coalesce("n", F.lit(0)) <= 1).cast("int")).alias("rare_share"), F.coalesce(F.sum(F.least("n", F.lit(most))), F.lit(0)).alias("capped_rows"),
    )


def vocabulary_misses(terms: DataFrame, vocabulary: DataFrame, by: str | None = None) -> DataFrame:
    """n_tokens, miss_rate (and miss_rate_distinct) of terms that a vocabulary lacks, in all or for each ``by``.
    terms: term and ``by``; vocabulary: term."""
    keys = [by] if by else []
    counts = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(vocabulary.select("term", F.lit(1).alias("known")), "term", "left")
    missing = F.col("known").isNull().cast("int")
    return rows.groupBy(*keys).agg(F.sum("n").alias("n_tokens"), (F.sum(F.col("n") * missing) / F.sum("n")).alias("miss_rate"), F.avg(missing).alias("miss_rate_distinct"))
