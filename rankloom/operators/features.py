"""Features of (query, item) pairs for the candidate selector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import small, written
from .ranking import MISSING, rank_table, union_pool

RANKS = ["bm25", "bm25_plain", "fused", "zero", "zero_global", "zero_local", "v2", "v2_global", "v2_local"]
SOURCES = ["bm25", "zero", "v2"]
PRIORS = ["rating", "log_reviews", "log_price", "phone_hidden", "message_forbidden"]
OVERLAPS = [f"{field}_{kind}" for field in ("title", "params", "desc") for kind in ("overlap", "coverage", "jaccard")]
FEATURES = [
    *RANKS, "min_rank", "source_count", "query_tokens", "location_match", "exact_in_title", "exact_in_desc",
    "title_tokens", "desc_tokens", *OVERLAPS, "filter_overlap", "filter_coverage", *PRIORS,
]


#: The learned fusion's sets: its channels (the vector channels of the second system and the list of the second
#: attempt go by the names of this schema), text and match features (A), and these with the item's priors (B).
FUSION_RANKS = ["bm25", "bm25_plain", "zero_global", "zero_local", "v2_global", "v2_local", "zero", "v2", "fused"]
FUSION_A = [*FUSION_RANKS, *FEATURES[len(RANKS) : -len(PRIORS)]]
FUSION_B = [*FUSION_A, *PRIORS]


def item_side(items: DataFrame) -> DataFrame:
    """What features need of an item, computed once an item: token sets, normal texts, priors."""
    return items.select(
        "item_id", F.col("location").alias("i_location"),
        T.token_set("title").alias("t_title"), T.token_set("params").alias("t_params"), T.token_set("description").alias("t_desc"),
        T.clean("title").alias("c_title"), T.clean("description").alias("c_desc"),
        F.coalesce("rating", F.lit(-1.0)).alias("rating"), F.log1p(T.positive("reviews")).alias("log_reviews"), F.log1p(T.positive("price")).alias("log_price"),
        F.coalesce((F.col("phone_hidden") == 1).cast("int"), F.lit(0)).alias("phone_hidden"),
        F.coalesce((F.col("message_forbidden") == 1).cast("int"), F.lit(0)).alias("message_forbidden"),
    )


def query_side(queries: DataFrame) -> DataFrame:
    return queries.select(
        "query_key", F.col("location").alias("q_location"),
        T.token_set(T.dense_query_text("search_query", "filters")).alias("t_query"), T.token_set("filters").alias("t_filter"), T.clean("search_query").alias("c_query"),
    )


def pair_columns() -> dict:
    """Text and match features of joined query and item sides."""
    cols = {
        "query_tokens": F.size("t_query"),
        "location_match": F.coalesce((F.col("q_location") == F.col("i_location")).cast("int"), F.lit(0)),
        "exact_in_title": T.contains_text(F.col("c_query"), F.col("c_title")),
        "exact_in_desc": T.contains_text(F.col("c_query"), F.col("c_desc")),
        "title_tokens": F.size("t_title"),
        "desc_tokens": F.size("t_desc"),
    }
    for field in ("title", "params", "desc"):
        for kind, value in zip(("overlap", "coverage", "jaccard"), T.overlap(F.col("t_query"), F.col(f"t_{field}"))):
            cols[f"{field}_{kind}"] = value
    cols["filter_overlap"], cols["filter_coverage"], _ = T.overlap(F.col("t_filter"), F.col("t_params"))
    return cols


def pair_features(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """pairs: query_key, item_id and further columns, kept. Items are cut to those asked for before their texts are read,
    and where these are few no other item's text is moved."""
    pairs = written(pairs, "pairs")
    needed = items.join(small(written(pairs.select("item_id").distinct(), "asked")), "item_id", "left_semi")
    rows = pairs.join(query_side(queries), "query_key").join(item_side(needed), "item_id")
    return rows.withColumns(pair_columns())


def fusion_frame(lists: DataFrame, queries: DataFrame, items: DataFrame, depth: int = 100) -> DataFrame:
    """query_key, item_id and FUSION_B: the whole union of the sources' tops, not cut by any fused rank."""
    return selector_frame(lists, queries, items, depth, MISSING).select("query_key", "item_id", *FUSION_B)


def selector_frame(lists: DataFrame, queries: DataFrame, items: DataFrame, depth: int = 100, pool: int = 200) -> DataFrame:
    """query_key, item_id and FEATURES: the union of the sources' tops, cut at the fused rank.
    lists: query_key, channel, item_id, rank with every channel of RANKS."""
    ranks = rank_table(lists, RANKS)
    pairs = union_pool(lists, SOURCES, depth).join(ranks, ["query_key", "item_id"]).filter(F.col("fused") <= pool)
    pairs = pairs.withColumns({
        "min_rank": F.least(*SOURCES),
        "source_count": sum(((F.col(s) <= depth).cast("int") for s in SOURCES[1:]), (F.col(SOURCES[0]) <= depth).cast("int")),
    }).drop("position")
    return pair_features(pairs, queries, items).select("query_key", "item_id", *FEATURES)


def history_features(pairs: DataFrame, clicks: DataFrame, queries: DataFrame, items: DataFrame, channels: list[str]) -> DataFrame:
    """Reciprocal ranks, category match, rating margin and click popularity.

    pairs: query_key, item_id, a rank column for each channel. clicks: query_norm, item_id, category.
    """
    per_item = clicks.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_clicks"))
    per_pair = clicks.groupBy("query_norm", "item_id").agg(F.count(F.lit(1)).alias("pair_clicks"))
    per_category = clicks.groupBy("query_norm", F.col("category").cast("string").alias("i_category")).agg(F.count(F.lit(1)).alias("category_clicks"))
    q = queries.select("query_key", T.clean("search_query").alias("query_norm"), F.col("category").alias("q_category"), "least_rating")
    i = items.select("item_id", F.col("category").cast("string").alias("i_category"), F.coalesce("rating", F.lit(-1.0)).alias("i_rating"))
    rows = pairs.join(q, "query_key").join(i, "item_id").join(per_item, "item_id", "left").join(per_pair, ["query_norm", "item_id"], "left")
    rows = rows.join(per_category, ["query_norm", "i_category"], "left")
    rr = {f"rr_{c}": F.when(F.col(c) < MISSING, 1.0 / (F.lit(20.0) + F.col(c))).otherwise(0.0) for c in channels}
    return rows.withColumns(rr | {
        "category_match": ((F.col("q_category") == 0) | (F.col("q_category").cast("string") == F.col("i_category"))).cast("int"),
        "rating_margin": F.when(F.col("least_rating").isNull(), 0.0).otherwise(F.col("i_rating") - F.col("least_rating")),
        "log_item_clicks": F.log1p(F.coalesce("item_clicks", F.lit(0))),
        "log_query_item_clicks": F.log1p(F.coalesce("pair_clicks", F.lit(0))),
        "log_query_category_clicks": F.log1p(F.coalesce("category_clicks", F.lit(0))),
        "history_present": F.col("item_clicks").isNotNull().cast("int"),
    }).drop("query_norm", "q_category", "i_category", "i_rating", "least_rating", "item_clicks", "pair_clicks", "category_clicks")
