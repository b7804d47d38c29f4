"""Significance of differences between systems."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

Z95 = 1.959963984540054


def wilson(k: Column | str, n: Column | str, confidence: float = 0.95) -> tuple[Column, Column]:
    if confidence != 0.95:
        raise ValueError("only 0.95 is supported")
    k, n = (F.col(x) if isinstance(x, str) else x for x in (k, n))
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, Z95 * Z95
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half


def holm(df: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Adds p_holm: step-down adjustment, running maximum, at most 1. A family is a small group."""
    family = by or []
    key = [F.col(c) for c in family] or [F.lit(0)]
    up = Window.partitionBy(*key).orderBy(p)
    m = F.count(F.lit(1)).over(Window.partitionBy(*key))
    stepped = df.withColumn("_step", F.col(p) * (m - F.row_number().over(up) + 1))
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(up.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def deltas(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """query_key, delta over queries that both have (query_key, recall)."""
    c, b = candidate.withColumnRenamed("recall", "c"), baseline.withColumnRenamed("recall", "b")
    return c.join(b, "query_key").select("query_key", (F.col("c") - F.col("b")).alias("delta"))


DRAWS = "comparison {kind}, n long, total double, weights array<double>, weighted array<double>, flipped array<double>"


def _draw(n_resamples: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each comparison of a task, sums over its rows for every resample: of
    Poisson weights, of deltas so weighted, and of deltas with random signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for of, row, delta in zip(*(c.to_pylist() for c in batch.columns)):
                if of not in sums:
                    sums[of] = [0, 0.0, *np.zeros((3, n_resamples))]
                # a row's draws are its own, wherever it is and in whatever order it comes
                rng = np.random.Generator(np.random.Philox(key=np.array([row % (1 << 64), seed], dtype=np.uint64)))
                weights = rng.poisson(1.0, n_resamples)
                signs = 1.0 - 2.0 * rng.integers(0, 2, n_resamples)
                own = sums[of]
                own[0] += 1
                own[1] += delta
                own[2] += weights
                own[3] += delta * weights
                own[4] += delta * signs
        names = ["comparison", "n", "total", "weights", "weighted", "flipped"]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), kind), *(pa.array([x[k] for x in sums.values()]) for k in range(5))], names=names)

    return run


def paired_test(candidate: DataFrame, baseline: DataFrame, n_resamples: int = 20_000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """One row: mean_delta, ci_low, ci_high, p_value, one_sided_low, n_queries."""
    rows = deltas(candidate, baseline).withColumn("comparison", F.lit(0))
    return paired_tests(rows, n_resamples, seed, confidence).drop("comparison")


def paired_tests(rows: DataFrame, n_resamples: int = 20_000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """The same for each comparison. rows: comparison, query_key, delta.

    Bootstrap by Poisson weights and sign flips are sums over queries, so each
    task sums its own rows for all resamples, and what is shuffled has the size
    of the resamples and not of the queries. A query's draws come from its key
    and the seed alone. The p-value is one-sided, for a positive mean.
    """
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    kind = rows.schema["comparison"].dataType.simpleString()
    keyed = rows.select("comparison", F.xxhash64("query_key").alias("row"), F.col("delta").cast("double").alias("delta"))
    parts = keyed.mapInArrow(_draw(n_resamples, seed), DRAWS.format(kind=kind))
    parts = written(parts, "resamples")
    seen = parts.groupBy("comparison").agg(F.sum("n").alias("n_queries"), (F.sum("total") / F.sum("n")).alias("mean_delta"))
    each = parts.select("comparison", F.posexplode(F.arrays_zip("weights", "weighted", "flipped")).alias("k", "x"))
    each = each.groupBy("comparison", "k").agg(F.sum("x.weights").alias("w"), F.sum("x.weighted").alias("v"), F.sum("x.flipped").alias("f")).join(F.broadcast(seen), "comparison")
    tail = 1 - confidence
    cuts = F.percentile(F.when(F.col("w") > 0, F.col("v") / F.col("w")), F.array(*[F.lit(x) for x in (tail / 2, 1 - tail / 2, tail)]))
    # sums of one set of numbers in another order may differ in their last digits
    above = F.count_if(F.round(F.col("f") / F.col("n_queries"), 12) >= F.round("mean_delta", 12))
    out = each.groupBy("comparison", "mean_delta", "n_queries").agg(cuts.alias("cuts"), ((1 + above) / F.lit(n_resamples + 1)).alias("p_value"))
    return out.select("comparison", "mean_delta", F.get("cuts", 0).alias("ci_low"), F.get("cuts", 1).alias("ci_high"), "p_value", F.get("cuts", 2).alias("one_sided_low"), "n_queries")


def accepted(tests: DataFrame, alpha: float = 0.05, comparisons: int = 1) -> DataFrame:
    """Adds accepted: better on average, interval above 0, p under alpha / comparisons."""
    return tests.withColumn("accepted", (F.col("mean_delta") > 0) & (F.col("ci_low") > 0) & (F.col("p_value") < alpha / comparisons))


def not_inferior(tests: DataFrame, margin: float = 0.005) -> DataFrame:
    return tests.withColumn("not_inferior", F.col("one_sided_low") > -margin)


def latency_summary(samples: DataFrame, value: str = "ms", guardrail: float = 500.0) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = samples.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), q.alias("q"), F.max(value).alias("max"))
    return out.select("n", "mean", F.get("q", 0).alias("p50"), F.get("q", 1).alias("p95"), F.get("q", 2).alias("p99"), "max", (F.get("q", 1) <= guardrail).alias("within_guardrail"))


def best_config(results: DataFrame, group: list[str], fold: str, value: str, folds: int) -> DataFrame:
    """The config with the largest sum over all folds; incomplete ones drop out."""
    sums = results.groupBy(*group).agg(F.sum(value).alias("total"), F.countDistinct(fold).alias("folds")).filter(F.col("folds") == folds)
    return sums.orderBy(F.round("total", 12).desc(), *group).limit(1)


