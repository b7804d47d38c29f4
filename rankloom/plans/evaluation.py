"""Named queries of evaluation, statistics, splits and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features, filters, joins, metrics, ranking, sampling, stats
from ..sources import tables
from . import sql as S
from .retrieval import _F, _L, HEURISTIC, entities, heuristic_ranking, lists, selector_frame
from .sql import BASE, ITEMS, UNION_POOL, recall_of

SOURCES = features.SOURCES


def _channel(rows, name):
    return rows.filter(F.col("channel") == name).select("query_key", "item_id", "rank")


def _round(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def recall_at_50(spark, d):
    return _round(metrics.recall(_channel(lists(spark, d), "fused"), tables.relevant(spark, d)), "recall")


def hit_rate(spark, d):
    _, queries = entities(spark, d)
    return _round(metrics.hit_rate(_channel(lists(spark, d), "fused"), tables.relevant(spark, d), queries), "hit_rate")


def per_query_recall(spark, d):
    return _round(metrics.per_query_recall(_channel(lists(spark, d), "bm25"), tables.relevant(spark, d), 10), "recall")


def recall_sum(spark, d):
    truth = tables.relevant(spark, d)
    n = truth.groupBy("query_key").agg(F.count(F.lit(1)).alias("n_relevant"))
    return _round(metrics.recall_sum(_channel(lists(spark, d), "bm25"), n, truth), "recall_sum")


def recall_by_depth(spark, d):
    out = metrics.recall_at(_channel(lists(spark, d), "fused"), tables.relevant(spark, d), [1, 10, 50, 100, 200])
    return _round(out, "recall")


def oracle_recall_by_depth(spark, d):
    rows, truth = lists(spark, d), tables.relevant(spark, d)
    out = None
    for depth in (10, 50, 100, 200):
        one = metrics.oracle_recall(rows, truth, SOURCES, depth)
        out = one if out is None else out.unionByName(one)
    return _round(out, "recall")


def oracle_compression(spark, d):
    return _round(metrics.oracle_compression(ranking.union_pool(lists(spark, d), SOURCES), tables.relevant(spark, d), 2), "compression_recall")


def pool_sizes(spark, d):
    return _round(metrics.pool_sizes(ranking.union_pool(lists(spark, d), SOURCES)), "mean_size", "p95_size")


def slice_recall(spark, d):
    _, queries = entities(spark, d)
    per = metrics.per_query_recall(_channel(lists(spark, d), "fused"), tables.relevant(spark, d))
    rows = per.join(queries.select("query_key", "category", "delivery", (F.length("filters") > 0).cast("long").alias("has_filters")), "query_key")
    return _round(metrics.slices(rows, ["category", "delivery", "has_filters"]), "recall")


def segment_recall(spark, d):
    _, queries = entities(spark, d)
    per = metrics.per_query_recall(_channel(lists(spark, d), "fused"), tables.relevant(spark, d))
    member = queries.select("query_key", F.when(F.col("query_key") % 2 == 0, "dev").otherwise("test").alias("segment"))
    tail = queries.filter("query_key % 3 = 0").select("query_key", F.lit("tail").alias("segment"))
    return _round(metrics.segments(per, member.unionByName(tail)), "recall")


def miss_types(spark, d):
    rows = lists(spark, d)
    pool = ranking.union_pool(rows, SOURCES).withColumnRenamed("position", "rank")
    return metrics.misses(tables.relevant(spark, d), _channel(rows, "fused"), pool, 5)


def topk_overlap(spark, d):
    rows = lists(spark, d)
    return _round(metrics.overlap(_channel(rows, "bm25"), _channel(rows, "zero")), "overlap")


def win_tie_loss(spark, d):
    rows, truth = lists(spark, d), tables.relevant(spark, d)
    out = metrics.win_tie_loss(metrics.per_query_recall(_channel(rows, "fused"), truth, 5), metrics.per_query_recall(_channel(rows, "bm25"), truth, 5))
    return _round(out, "mean_delta")


def wilson_table(spark, d):
    e = tables.table(spark, d, "events", ["event_type", "value", "user_id"])
    n = e.groupBy("event_type").agg(F.sum((F.col("user_id") % 3 == 0).cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson("k", "n")
    return n.select("event_type", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def holm(spark, d):
    e = tables.table(spark, d, "events", ["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    p = e.select("event_type", ((F.col("n") % 97) / 1000.0).alias("p"))
    return _round(stats.holm(p), "p", "p_holm")


def freq_buckets(spark, d):
    c = tables.clicks(spark, d).groupBy("query_norm").agg(F.count(F.lit(1)).alias("n"))
    return c.select("query_norm", "n", T.cut("n", [1, 5, 20], ["0-1", "2-5", "6-20", "21+"]).alias("bucket"))


def strata(spark, d):
    items, queries = entities(spark, d)
    pools = filters.eligible_local(queries, items).groupBy("query_key").agg(F.count(F.lit(1)).alias("local_pool_size"))
    frequency = queries.select("query_key", (F.col("query_key") % 7).alias("query_frequency"))
    return sampling.with_strata(queries, pools, frequency)


def strata_counts(spark, d):
    return strata(spark, d).groupBy("primary_stratum", "query_frequency_bucket").agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(spark, d):
    rows = strata(spark, d)
    return sampling.stratified(rows, "primary_stratum", "query_key", sampling.proportional_quotas(rows, "primary_stratum", 20)).select("query_key", "primary_stratum")


def stratum_quotas(spark, d):
    return sampling.proportional_quotas(tables.table(spark, d, "documents", ["lang"]), "lang", 100)


def kfold_sizes(spark, d):
    rows = sampling.folds(tables.table(spark, d, "documents", ["doc_id", "lang"]), "lang", "doc_id")
    return rows.groupBy("lang", "fold").agg(F.count(F.lit(1)).alias("n"))


def fit_tune_sizes(spark, d):
    rows = sampling.fit_tune(tables.table(spark, d, "documents", ["doc_id", "lang"]), "lang", "doc_id")
    return rows.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))


def leakage_anti_join(spark, d):
    h = tables.clicks(spark, d).withColumn("location", F.when(F.col("location") != "Brand#1", F.col("location")))
    held = h.filter("item_id % 11 = 0")
    keys = ["query_norm", "category", "location"]
    return joins.without(h, held, keys).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def pair_steps(spark, d):
    c = tables.clicks(spark, d).withColumn("query_text", F.when(F.col("item_id") % 13 == 0, "").otherwise(F.col("query_norm")))
    _, counts = sampling.training_pairs(c, c.filter("item_id % 11 = 0"), ["query_norm", "category", "location"])
    return counts


def in_batch_collisions(spark, d):
    rows = tables.table(spark, d, "events", ["event_id", "user_id", "event_type"])
    pairs = rows.select(F.col("event_id").alias("row"), F.floor(F.col("event_id") / 32).alias("batch"), F.col("user_id").alias("query_id"), (F.col("event_id") % 29).alias("item_id"))
    return joins.collisions(pairs).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


def best_passages(spark, d):
    items, queries = entities(spark, d)
    pairs = tables.relevant(spark, d).join(queries.select("query_key", T.token_set("search_query").alias("tokens")), "query_key")
    p = items.select("item_id", F.posexplode(T.passages("title", "params", "description")).alias("chunk", "passage"))
    return sampling.best_passage(pairs, p).select("query_key", "item_id", F.col("chunk").cast("long").alias("chunk"), F.col("shared").cast("long").alias("shared"))


def channel_join(spark, d):
    rows = lists(spark, d)
    a, b = (tables.serialize_rankings(_channel(rows, c), c) for c in ("bm25", "zero"))
    out = joins.one_to_one(a, b, ["query_key"])
    return out.select("query_key", F.size(F.split("bm25", " ")).cast("long").alias("n_bm25"), F.size(F.split("zero", " ")).cast("long").alias("n_zero"))


def local_pools(spark, d):
    items, queries = entities(spark, d)
    return filters.pool_counts(queries, items)


def latency_summary(spark, d):
    e = tables.table(spark, d, "events", ["value"]).select(F.col("value").alias("ms"))
    return _round(stats.latency_summary(e), "mean", "p50", "p95", "p99", "max")


def best_config(spark, d):
    e = tables.table(spark, d, "events", ["event_type", "user_id", "value"])
    r = e.groupBy("event_type", (F.col("user_id") % 2).alias("fold")).agg(F.avg("value").alias("v"))
    return _round(stats.best_config(r, ["event_type"], "fold", "v", 2), "total")


def paired_delta(spark, d):
    """The part of the paired test that isn't random."""
    rows, truth = lists(spark, d), tables.relevant(spark, d)
    out = stats.deltas(metrics.per_query_recall(_channel(rows, "fused"), truth, 5), metrics.per_query_recall(_channel(rows, "bm25"), truth, 5))
    return out.agg(F.round(F.avg("delta"), 9).alias("mean_delta"), F.count(F.lit(1)).alias("n_queries"))


def known_part_rows(spark, d):
    """Rows of one table with keys in another, null-safe, and the other's value looked up."""
    docs = tables.table(spark, d, "documents", ["doc_id", "source"])
    marks = tables.table(spark, d, "labels", ["doc_id", "quality"])
    toxic = tables.table(spark, d, "labels", ["doc_id", "toxic"]).filter("toxic = 1")
    rows = joins.within(docs.filter("doc_id % 2 = 0"), toxic, ["doc_id"]).withColumn("in_toxic", F.lit(1)).unionByName(joins.without(docs.filter("doc_id % 2 = 0"), toxic, ["doc_id"]).withColumn("in_toxic", F.lit(0)))
    joins.assert_no_leak(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), ["doc_id"])
    return joins.lookup(rows, marks, "doc_id", "quality", -1).select("doc_id", "in_toxic", F.col("quality").cast("long").alias("quality"))


def hash_sample(spark, d):
    return sampling.sample(tables.table(spark, d, "documents", ["doc_id", "source"]), "doc_id", 100).select("doc_id", "source")


def tail_queries(spark, d):
    """Queries whose first word occurs in one query at most."""
    q = tables.queries(spark, d).withColumn("word", F.get(T.tokenize("search_query"), 0))
    n = q.groupBy("word").agg(F.count(F.lit(1)).alias("query_frequency"))
    return sampling.tail(q.join(n, "word")).select("query_key", "query_frequency")


def category_batches(spark, d):
    """Batches of 8 training pairs that share a category, in clustered order: per batch its rows and sum of ids."""
    pairs = tables.items(spark, d).select("item_id", "category")
    place = ranking.ranked(pairs, sampling.shuffled("item_id"), F.col("item_id"), by=["category"], name="place")
    batch = place.withColumn("batch", F.floor((F.col("place") - 1) / 8))
    return batch.groupBy("category", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("sum_ids"))


def cutoff_variants(spark, d):
    """How far ranks lie inside the cutoff, by the variants of cutoff and width."""
    from ..operators.ltr import inside

    ranks = spark.range(1, 101).withColumn("rank", F.col("id").cast("int"))
    each = F.array(*[F.struct(F.lit(f"k{k}_tau{t}").alias("variant"), inside("rank", k, t).alias("inside")) for k, t in VARIANTS])
    return ranks.select("rank", F.explode(each).alias("x")).select("x.variant", "rank", F.round("x.inside", 9).alias("inside"))


VARIANTS = [(50, 0), (50, 8), (50, 20), (5, 8), (10, 8), (20, 8)]


def paired_test(spark, d):
    rows, truth = lists(spark, d), tables.relevant(spark, d)
    out = stats.paired_test(metrics.per_query_recall(_channel(rows, "fused"), truth, 5), metrics.per_query_recall(_channel(rows, "bm25"), truth, 5), n_resamples=20_000)
    return stats.not_inferior(stats.accepted(out))


def final_recall(spark, d):
    return _round(metrics.recall(heuristic_ranking(selector_frame(spark, d)), tables.relevant(spark, d)), "recall")


_HITS = "h as ({})"
_CHAN = "{n} as (select query_key, item_id, rank from lists where channel = '{c}')"
_fused = _CHAN.format(n="fz", c="fused")
_clicks = f"clicks as (select {S.clean('p_name')} as query_norm, l_partkey as item_id, p_type as category, p_brand as location from lineitem join part on l_partkey = p_partkey)"
_pool = f"select query_key, item_id, min(rank) as rank from lists where channel in ('bm25', 'zero', 'v2') and rank <= {{}} group by all"
_STRATA = BASE + """pools as (select q.query_key, count(*) as n from queries q join items i on q.location = i.location and q.delivery = 0 and (q.category = 0 or q.category = i.category)
    and (q.least_rating is null or coalesce(i.rating, -1) >= q.least_rating) group by all),
strata as (select query_key, concat_ws('|', (length(trim(filters)) > 0)::varchar, delivery::varchar, case when n is null or n <= 0 then '0' when n <= 99 then '1-99' when n <= 499 then '100-499' when n <= 1999 then '500-1999' when n <= 9999 then '2000-9999' else '10000+' end) as primary_stratum,
    case when query_key % 7 <= 1 then '0-1' when query_key % 7 <= 5 then '2-5' else '6-20' end as query_frequency_bucket from queries left join pools using (query_key))"""

SQL = {
    "recall_at_50": f"{_L}, {_fused}, {_HITS.format(recall_of('fz'))} select round(avg(n_found / n_relevant), 6) as recall, count(*) as n_queries from h",
    "hit_rate": f"{_L}, {_fused}, {_HITS.format(recall_of('fz'))} select round(avg(coalesce((n_found > 0)::int, 0)), 6) as hit_rate, count(*) as n_queries from queries left join h using (query_key)",
    "per_query_recall": f"{_L}, {_CHAN.format(n='bz', c='bm25')}, {_HITS.format(recall_of('bz', 10))} select query_key, round(n_found / n_relevant, 6) as recall from h",
    "recall_sum": f"{_L}, {_CHAN.format(n='bz', c='bm25')}, {_HITS.format(recall_of('bz'))} select round(sum(n_found / n_relevant), 6) as recall_sum, count(*) as n_queries from h",
    "recall_by_depth": f"{_L}, {_fused}, " + ", ".join(f"h{k} as ({recall_of('fz', k)})" for k in (1, 10, 50, 100, 200)) + " " + " union all ".join(f"select {k}::int as depth, round(avg(n_found / n_relevant), 6) as recall from h{k}" for k in (1, 10, 50, 100, 200)),
    "oracle_recall_by_depth": f"{_L}, " + ", ".join(f"p{k} as ({_pool.format(k)}), h{k} as ({recall_of(f'p{k}', None)})" for k in (10, 50, 100, 200)) + " " + " union all ".join(f"select {k}::int as depth, round(avg(n_found / n_relevant), 6) as recall from h{k}" for k in (10, 50, 100, 200)),
    "oracle_compression": f"{_L}, p as ({_pool.format(100)}), {_HITS.format(recall_of('p', None))} select round(avg(least(n_found, 2) / n_relevant), 6) as compression_recall from h",
    "pool_sizes": f"{_L}, p as (select query_key, count(*) as n from ({_pool.format(100)}) group by all) select round(avg(n), 6) as mean_size, round(quantile_cont(n, 0.95), 6) as p95_size, max(n) as max_size from p",
    "slice_recall": f"{_L}, {_fused}, {_HITS.format(recall_of('fz'))}, r as (select n_found / n_relevant as recall, q.* from h join queries q using (query_key)), "
        + "s as (" + " union all ".join(f"select '{c}' as slice, ({e})::varchar as segment, recall from r" for c, e in (("category", "category"), ("delivery", "delivery"), ("has_filters", "(length(filters) > 0)::bigint"))) + ") select slice, segment, count(*) as n, round(avg(recall), 6) as recall from s group by all",
    "segment_recall": f"{_L}, {_fused}, {_HITS.format(recall_of('fz'))}, m as (select query_key, case when query_key % 2 = 0 then 'dev' else 'test' end as segment from queries union all select query_key, 'tail' from queries where query_key % 3 = 0) select segment, count(*) as n, round(avg(n_found / n_relevant), 6) as recall from h join m using (query_key) group by segment",
    "miss_types": f"{_L},\n{UNION_POOL}, {_fused}, t as (select distinct query_key, item_id from relevant) select t.query_key, t.item_id, case when f.item_id is not null then 'found' when u.item_id is not null then 'selection_miss' else 'retrieval_miss' end as outcome, u.position as best_rank from t left join (select distinct query_key, item_id from fz where rank <= 5) f using (query_key, item_id) left join union_pool u using (query_key, item_id)",
    "topk_overlap": f"{_L}, {_CHAN.format(n='a', c='bm25')}, {_CHAN.format(n='b', c='zero')}, k as (select query_key from a union select query_key from b), o as (select a.query_key, count(*) as n from a join b using (query_key, item_id) where a.rank <= 50 and b.rank <= 50 group by all) select query_key, round(coalesce(n, 0) / 50, 6) as overlap from k left join o using (query_key)",
    "win_tie_loss": f"{_L}, {_fused}, {_CHAN.format(n='bz', c='bm25')}, x as ({recall_of('fz', 5)}), y as ({recall_of('bz', 5)}), e as (select x.n_found / x.n_relevant - y.n_found / y.n_relevant as d from x join y using (query_key)) select count(*) filter (d > 0) as wins, count(*) filter (d = 0) as ties, count(*) filter (d < 0) as losses, round(avg(d), 6) as mean_delta from e",
    "wilson_table": f"""with c as (select event_type, count(*) filter (user_id % 3 = 0) as k, count(*) as n from events group by event_type), z as (select *, {stats.Z95} as z, k / n as p from c)
        select event_type, k, n, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) as low,
          round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) as high from z""",
    "holm": "with p as (select event_type, (count(*) % 97) / 1000.0 as p from events group by event_type), s as (select *, p * (count(*) over () - row_number() over (order by p) + 1) as step from p) select event_type, round(p, 6) as p, round(least(1.0, max(step) over (order by p rows unbounded preceding)), 6) as p_holm from s",
    "freq_buckets": f"with {_clicks} select query_norm, count(*) as n, case when count(*) <= 1 then '0-1' when count(*) <= 5 then '2-5' when count(*) <= 20 then '6-20' else '21+' end as bucket from clicks group by query_norm",
    "strata_counts": _STRATA + " select primary_stratum, query_frequency_bucket, count(*) as n from strata group by all",
    "stratified_sample": _STRATA + """, n as (select primary_stratum, count(*) as n from strata group by all), e as (select *, n * 20 / sum(n) over () as exact, floor(n * 20 / sum(n) over ())::bigint as base from n),
        o as (select *, row_number() over (order by exact - base desc, primary_stratum) <= 20 - sum(base) over () as more from e), q as (select primary_stratum, least(n, base + more::int) as quota from o),
        r as (select query_key, primary_stratum, row_number() over (partition by primary_stratum order by md5(concat_ws('|', query_key::varchar, primary_stratum, '42')), query_key) as k from strata)
        select query_key, primary_stratum from r join q using (primary_stratum) where k <= quota""",
    "stratum_quotas": """with n as (select lang, count(*) as n from documents group by lang), e as (select *, n * 100 / sum(n) over () as exact, floor(n * 100 / sum(n) over ())::bigint as base from n),
        o as (select *, row_number() over (order by exact - base desc, lang) <= 100 - sum(base) over () as more from e) select lang, least(n, base + more::int)::bigint as quota from o""",
    "kfold_sizes": "with n as (select lang, count(*) as n from documents group by lang) select lang, unnest([0, 1])::int as fold, unnest([(n + 1) // 2, n // 2]) as n from n",
    "fit_tune_sizes": "with n as (select lang, count(*) as n from documents group by lang) select lang, unnest(['fit', 'tune']) as part, unnest([n - n // 4, n // 4]) as n from n",
    "leakage_anti_join": f"with {_clicks}, h as (select query_norm, item_id, category, case when location <> 'Brand#1' then location end as location from clicks), x as (select distinct query_norm, category, location from h where item_id % 11 = 0) select category, count(*) as n from h where not exists (select 1 from x where x.query_norm is not distinct from h.query_norm and x.category is not distinct from h.category and x.location is not distinct from h.location) group by category",
    "pair_steps": f"""with {_clicks}, c as (select *, case when item_id % 13 = 0 then '' else query_norm end as query_text from clicks), x as (select distinct query_norm, category, location from c where item_id % 11 = 0),
        a as (select * from c where not exists (select 1 from x where x.query_norm = c.query_norm and x.category = c.category and x.location = c.location)), b as (select * from a where trim(query_text) <> '')
        select 0::int as step, 'all' as name, (select count(*) from c) as n union all select 1, 'no_leak', (select count(*) from a) union all select 2, 'has_text', (select count(*) from b) union all select 3, 'distinct', (select count(*) from (select distinct query_text, item_id from b))""",
    "in_batch_collisions": "with p as (select event_id as row, event_id // 32 as batch, user_id as q, event_id % 29 as i from events) select a.batch, count(*) as n from p a join p b on a.batch = b.batch and a.row < b.row and (a.q = b.q or a.i = b.i) group by all",
    "best_passages": BASE + f"""c as (select item_id, title, list_concat(list_concat({S.tokens('params')}, ['описание']), {S.tokens('description')}) as content from items where item_id in (select item_id from relevant)),
        w as (select item_id, title, content, unnest(range(0, least(4, (len(content) - 1) // 110 + 1))) as chunk from c),
        p as (select item_id, chunk, concat('passage: ', title, '. ', array_to_string(list_slice(content, chunk * 110 + 1, chunk * 110 + 140), ' ')) as passage from w),
        s as (select r.query_key, r.item_id, chunk, len(list_intersect({S.token_set('q.search_query')}, {S.token_set('p.passage')})) as shared from relevant r join queries q using (query_key) join p using (item_id))
        select query_key, item_id, chunk, shared from (select *, row_number() over (partition by query_key, item_id order by shared desc, chunk) as k from s) where k = 1""",
    "channel_join": f"{_L} select query_key, count(*) filter (channel = 'bm25') as n_bm25, count(*) filter (channel = 'zero') as n_zero from lists group by query_key having n_bm25 > 0 and n_zero > 0",
    "local_pools": BASE.rstrip(",\n") + " select query_key, count(*) as n, sum(item_id)::bigint as sum_ids from queries q join items i on (q.category = 0 or q.category = i.category) and (q.least_rating is null or coalesce(i.rating, -1) >= q.least_rating) group by query_key",
    "paired_delta": f"{_L}, {_CHAN.format(n='fz', c='fused')}, {_CHAN.format(n='bm', c='bm25')}, a as ({recall_of('fz', 5)}), b as ({recall_of('bm', 5)}) select round(avg(a.n_found / a.n_relevant - b.n_found / b.n_relevant), 9) as mean_delta, count(*) as n_queries from a join b using (query_key)",
    "known_part_rows": "select d.doc_id, (t.doc_id is not null)::int as in_toxic, coalesce(l.quality, -1)::bigint as quality from documents d left join (select distinct doc_id from labels where toxic = 1) t using (doc_id) left join labels l using (doc_id) where d.doc_id % 2 = 0",
    "hash_sample": "select doc_id, source from documents order by md5(concat_ws('|', doc_id::varchar, '42')), doc_id limit 100",
    "tail_queries": BASE + f"w as (select query_key, {S.tokens('search_query')}[1] as word from queries), n as (select word, count(*) as query_frequency from w group by word) select query_key, query_frequency from w join n using (word) where query_frequency <= 1",
    "category_batches": f"with {ITEMS}, p as (select item_id, category, (row_number() over (partition by category order by md5(concat_ws('|', item_id::varchar, '42')), item_id) - 1) // 8 as batch from items) select category, batch, count(*) as n, sum(item_id)::bigint as sum_ids from p group by all",
    "cutoff_variants": "select 'k' || k || '_tau' || t as variant, rank::int as rank, round(case when t = 0 then (rank <= k)::int::double else 1 / (1 + exp(-(k + 0.5 - rank) / t::double)) end, 9) as inside from (values " + ", ".join(f"({k}, {t})" for k, t in VARIANTS) + ") v(k, t), unnest(range(1, 101)) r(rank)",
    "latency_summary": "select count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(max(value), 6) as max, quantile_cont(value, 0.95) <= 500 as within_guardrail from events",
    "best_config": "with r as (select event_type, user_id % 2 as fold, avg(value) as v from events group by all) select event_type, round(sum(v), 6) as total, count(distinct fold) as folds from r group by event_type having count(distinct fold) = 2 order by round(sum(v), 12) desc, event_type limit 1",
    "final_recall": f"{_F},\n{HEURISTIC}, {_HITS.format(recall_of('final'))} select round(avg(n_found / n_relevant), 6) as recall, count(*) as n_queries from h",
}

QUERIES = {
    f.__name__: f
    for f in (
        recall_at_50, hit_rate, per_query_recall, recall_sum, recall_by_depth, oracle_recall_by_depth, oracle_compression, pool_sizes, slice_recall, segment_recall,
        miss_types, topk_overlap, win_tie_loss, wilson_table, holm, freq_buckets, strata_counts, stratified_sample, stratum_quotas, kfold_sizes, fit_tune_sizes,
        leakage_anti_join, pair_steps, in_batch_collisions, best_passages, channel_join, local_pools, latency_summary, best_config, paired_delta, known_part_rows, hash_sample, tail_queries, category_batches, cutoff_variants, paired_test, final_recall,
    )
}

