"""Exact vector search over passages, and sparse vectors.

Queries are a batch of bounded size: ``BATCH`` at most are sent to the tasks at
once, more go in several passes. A task multiplies its passages with them as
matrices, an Arrow batch at a time, and passes on only each query's top of the
batch, so what is shuffled grows with queries times depth times batches and
never with queries times passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import global_ok, query_side
from .ranking import by_score, fuse, ranked

BATCH = 4096
#: Scores are compared to so many digits, as all rankings are.
DIGITS = 9


def top_of_batches(queries: DataFrame, passages: DataFrame, depth: int | None, local: bool = False) -> DataFrame:
    """query_key, score and the passages' columns but the vector: at least each
    query's ``depth`` best passages of every shard and batch, ties included.

    queries: query_key, qvector, and q_location for local search, which scores a
    query only against passages at its location. A stated query set meets all
    passages. passages may have a shard column.
    """
    n = queries.count()
    parts = max(1, -(-n // BATCH))
    keep = [c for c in passages.columns if c != "vector"]
    kinds = ", ".join(f"{c} {passages.schema[c].dataType.simpleString()}" for c in keep)
    out = None
    for k in range(parts):
        q = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("query_key"), F.lit(parts)) == k)
        table = q.select("query_key", "qvector", *(["q_location"] if local else [])).filter("qvector is not null").toArrow()
        matrix = _matrix(table["qvector"].combine_chunks()) if table.num_rows else np.empty((0, 1))
        places = table["q_location"].to_numpy() if local else None
        shared = queries.sparkSession.sparkContext.broadcast((table["query_key"].to_pylist(), matrix, places))
        rows = passages.filter("vector is not null").select(*keep, "vector")
        key = queries.schema["query_key"].dataType.simpleString()
        found = rows.mapInArrow(_scorer(shared, depth, keep, pa.int64() if key == "bigint" else None), f"query_key {key}, score double, {kinds}")
        out = found if out is None else out.unionByName(found)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scorer(shared, depth: int | None, keep: list[str], kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix, places = shared.value
        keys = pa.array(keys, kind)
        for batch in batches:
            if not batch.num_rows or not len(keys):
                continue
            names = batch.schema.names
            vectors = _matrix(batch.column(names.index("vector")))
            shard = batch.column(names.index("shard")).to_numpy() if "shard" in names else np.zeros(batch.num_rows, dtype=np.int64)
            at = batch.column(names.index("location")).to_numpy(zero_copy_only=False) if places is not None else None
            which, who, values = [], [], []
            for s in np.unique(shard):
                rows = np.flatnonzero(shard == s)
                for k in range(0, len(keys), 256):
                    part = matrix[k : k + 256]
                    scores = vectors[rows] @ part.T
                    ok = np.ones(scores.shape, dtype=bool) if at is None else at[rows][:, None] == places[k : k + 256][None]
                    if depth is not None and len(rows) > depth:
                        compared = np.round(scores, DIGITS)
                        ranked_scores = np.where(ok, compared, -np.inf)
                        ok &= compared >= np.partition(ranked_scores, len(rows) - depth, axis=0)[len(rows) - depth]
                    r, c = np.nonzero(ok)
                    which.append(rows[r])
                    who.append(c + k)
                    values.append(scores[r, c])
            rows = pa.array(np.concatenate(which))
            columns = [keys.take(pa.array(np.concatenate(who))), pa.array(np.concatenate(values)), *(batch.column(names.index(c)).take(rows) for c in keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_key", "score", *keep])

    return run


def shard_of(passages: DataFrame, shards: int = 2) -> DataFrame:
    """Contiguous shards of the passage order, the first ones larger by one where they don't divide."""
    n = passages.count()
    size, more = divmod(n, shards)
    # passage_id counts from 0 without gaps, so a shard is a range of it
    edge = more * (size + 1)
    pid = F.col("passage_id")
    shard = F.when(pid < edge, F.floor(pid / F.lit(size + 1))).otherwise(F.lit(more) + F.floor((pid - edge) / F.lit(max(size, 1))))
    return passages.withColumn("shard", shard.cast("int"))


def collapse(hits: DataFrame, allowed: Column | None = None, top: int = 250) -> DataFrame:
    """Passages in order (column place) to items: filter after the cut, first occurrence, re-rank."""
    rows = hits if allowed is None else hits.filter(allowed)
    first = rows.groupBy("query_key", "item_id").agg(F.min("place").alias("place"))
    return ranked(first, F.col("place"), top=top).select("query_key", "item_id", "rank")


def _hits(scored: DataFrame, top: int, by: list[str]) -> DataFrame:
    return ranked(scored, F.round("score", DIGITS).desc(), F.col("passage_id"), by=by, top=top, name="cut")


def search_global(queries: DataFrame, passages: DataFrame, per_shard: int = 1500, top: int = 250, shards: int = 2) -> DataFrame:
    """Top passages of each shard, merged by score, collapsed to items.

    passages: passage_id, item_id, vector and the items' filter columns.
    """
    scored = top_of_batches(queries, shard_of(passages, shards), per_shard)
    hits = _hits(scored, per_shard, ["query_key", "shard"])
    placed = ranked(hits, F.round("score", DIGITS).desc(), F.col("passage_id"), name="place")
    return collapse(placed.join(query_side(queries), "query_key"), global_ok(), top)


def search_local(queries: DataFrame, passages: DataFrame, depth: int = 750, top: int = 250) -> DataFrame:
    """The same at the query's location; a location without passages gives nothing."""
    asked = queries.withColumn("q_location", F.col("location"))
    hits = _hits(top_of_batches(asked, passages, depth, local=True), depth, ["query_key"]).withColumnRenamed("cut", "place")
    return collapse(hits.join(query_side(queries), "query_key"), global_ok(), top)


def channels(queries: DataFrame, passages: DataFrame, prefix: str = "dense", per_shard: int = 1500, depth: int = 750, top: int = 250) -> DataFrame:
    """query_key, channel, item_id, rank for <prefix>_global and <prefix>_local."""
    g, loc = search_global(queries, passages, per_shard, top), search_local(queries, passages, depth, top)
    return g.withColumn("channel", F.lit(f"{prefix}_global")).unionByName(loc.withColumn("channel", F.lit(f"{prefix}_local")))


def dense(queries: DataFrame, passages: DataFrame, local_weight: float = 1.15, rrf_k: float = 60, top: int = 250) -> DataFrame:
    return fuse(channels(queries, passages), {"dense_global": 1.0, "dense_local": local_weight}, rrf_k, top, clean=True)


def by_location(passages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Passages clustered by location, for local search to read few files."""
    dealt = passages.repartition(partitions, "location") if partitions else passages.repartition("location")
    return dealt.sortWithinPartitions("location", "passage_id")


# --- sparse vectors: id, dim, weight -------------------------------------------


def to_sparse(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The positive entries of an array column."""
    return df.select(key, F.posexplode(vector).alias("dim", "weight")).filter("weight > 0").withColumn("weight", F.col("weight").cast("double"))


def prune(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The largest weights of each vector, ties to the smaller dimension."""
    return ranked(rows, F.col("weight").desc(), F.col("dim"), by=[key], top=most, name="kept").drop("kept")


def sparse_search(q: DataFrame, d: DataFrame, queries: DataFrame, meta: DataFrame, depth: int = 4000, top: int = 250, local: bool = False) -> DataFrame:
    """q: query_key, dim, weight; d: passage_id, dim, weight; meta: passage_id, item_id and filter columns.
    Filters hold before the cut; only passages that share a dimension are scored."""
    from .filters import local_ok

    hits = q.withColumnRenamed("weight", "qw").join(d, "dim").groupBy("query_key", "passage_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
    rows = hits.join(meta, "passage_id").join(query_side(queries), "query_key").filter(local_ok() if local else global_ok())
    placed = _hits(rows, depth, ["query_key"]).withColumnRenamed("cut", "place")
    return collapse(placed, None, top)


def agreement(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Least and mean cosine and largest absolute difference of paired vectors."""
    from ..functions.text import dot

    cosine = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    worst = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return pairs.agg(F.min(cosine).alias("min_cosine"), F.avg(cosine).alias("mean_cosine"), F.max(worst).alias("max_abs_diff"), F.count(F.lit(1)).alias("n"))


__all__ = ["agreement", "by_location", "by_score", "channels", "collapse", "dense", "prune", "search_global", "search_local", "shard_of", "sparse_search", "to_sparse", "top_of_batches"]
