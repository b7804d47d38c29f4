"""Named queries over texts, tables and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import profile
from ..sources import tables
from . import sql as S
from .sql import BASE, ITEMS


def clean_text(spark, d):
    rows = tables.spread(tables.table(spark, d, "documents", ["doc_id", "text"]))
    return rows.select("doc_id", F.md5(T.clean("text")).alias("clean_md5"), F.length(T.clean("text")).cast("long").alias("n_clean"))


def tok_items(spark, d):
    rows = tables.spread(tables.table(spark, d, "documents", ["doc_id", "text"]))
    t = T.tokenize("text")
    return rows.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def dominant_script(spark, d):
    rows = tables.items(spark, d)
    fixed = F.concat(F.col("title"), F.when(F.col("item_id") % 3 == 0, " ремонт айфона быстро и качественно во всех районах города").otherwise(""))
    return rows.select("item_id", T.dominant_script(fixed).alias("title_script"), T.item_script("title", "description").alias("item_script"))


def min_rating(spark, d):
    rows = tables.table(spark, d, "documents", ["doc_id"])
    text = F.expr("case doc_id % 5 when 0 then 'Рейтинг пользователя 4 звезды и выше' when 1 then 'рейтинг 4,5' when 2 then 'рейтинг от 3.5 до 5' when 3 then 'без условий' else '' end")
    return rows.select("doc_id", T.min_rating(text).alias("least_rating"))


def query_id_sha1(spark, d):
    q = tables.queries(spark, d)
    return q.select("query_key", T.query_id("search_query", "location", "delivery", F.nullif("filters", F.lit("")), "category").alias("query_id"))


def raw_titles(spark, d):
    """Items, a third of them with capitals, ё, Ё and repeated spaces in the title."""
    raw = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Ремонт ТЁплый  тёплый ДОМ: "), F.col("title"))).otherwise(F.col("title"))
    return tables.items(spark, d).withColumn("title", raw)


def passages(spark, d):
    rows = raw_titles(spark, d)
    p = rows.select("item_id", F.posexplode(T.passages("title", "params", "description")).alias("chunk", "passage"))
    return p.select("item_id", F.col("chunk").cast("long").alias("chunk"), F.md5("passage").alias("passage_md5"))


def short_views(spark, d):
    rows = raw_titles(spark, d)
    return rows.select("item_id", T.short_view("title", "params").alias("short_view"), F.md5(T.item_text("title", "params", "description")).alias("text_md5"))


def item_text_stats(spark, d):
    rows = tables.items(spark, d)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.length(c).alias("n")) for c in ("title", "params", "description")])).alias("x")).select("x.*")
    q = F.percentile("n", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]))
    out = long.groupBy("field").agg(F.avg("n").alias("mean"), F.max("n").cast("long").alias("max_len"), q.alias("q"))
    return out.select("field", F.round("mean", 6).alias("mean_len"), "max_len", *[F.round(F.get("q", k), 6).alias(n) for k, n in enumerate(("p25", "p50", "p75", "p90", "p95", "p99"))])


def char_ngrams(spark, d):
    q = tables.queries(spark, d)
    g = q.select("query_key", F.explode(T.char_ngrams("search_query")).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_key").alias("n_queries"))


def query_views(spark, d):
    """Both query views of raw texts."""
    q = tables.queries(spark, d)
    raw = F.when(F.col("query_key") % 2 == 0, F.concat(F.lit("Найти ТЁплый  "), F.col("search_query"))).otherwise(F.col("search_query"))
    q = q.withColumn("search_query", raw).withColumn("filters", F.upper("filters"))
    return q.select("query_key", T.query_text("search_query", "filters").alias("sparse_view"), T.dense_query_text("search_query", "filters").alias("dense_view"))


def text_overlap(spark, d):
    """Overlap of queries and items of one location that share a word: joined on the word, so no pair without one is made."""

    def side(df, key, text):
        rows = df.select(key, "location", T.token_set(text).alias("t"))
        return rows.select(key, "location", F.size("t").alias(f"n_{key}"), F.explode("t").alias("word"))

    both = side(tables.queries(spark, d), "query_key", "search_query").join(side(tables.items(spark, d), "item_id", "title"), ["location", "word"])
    n = both.groupBy("query_key", "item_id", "n_query_key", "n_item_id").agg(F.count(F.lit(1)).alias("overlap"))
    share, jaccard = F.col("overlap") / F.col("n_query_key"), F.col("overlap") / (F.col("n_query_key") + F.col("n_item_id") - F.col("overlap"))
    return n.select("query_key", "item_id", "overlap", F.round(share, 6).alias("coverage"), F.round(jaccard, 6).alias("jaccard"))


def item_priors(spark, d):
    from ..operators.features import item_side

    i = item_side(tables.items(spark, d))
    return i.select("item_id", "rating", F.round("log_reviews", 6).alias("log_reviews"), F.round("log_price", 6).alias("log_price"), F.col("phone_hidden").cast("long").alias("phone_hidden"), F.col("message_forbidden").cast("long").alias("message_forbidden"))


KINDS = ["ремонт", "ремонт окон", "маникюр", "сборка мебели", "уборка"]


def service_kind(spark, d):
    """The longest vocabulary value that the text after the key starts with.

    The vocabulary is closed and small: it is matched as a list of literals."""
    docs = tables.table(spark, d, "documents", ["doc_id"])
    value = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    params = F.when(F.col("doc_id") % 7 == 0, F.lit("Онлайн-запись Да")).otherwise(F.concat(F.lit("Категория X Вид услуги "), value, F.when(F.col("doc_id") % 2 == 0, " Тип услуги на дому").otherwise("")))
    rows = docs.select("doc_id", params.alias("p"))
    at = F.locate(T.KIND_KEY, F.col("p"))
    rest = F.substring(F.col("p"), at + len(T.KIND_KEY), F.length("p"))
    kind = F.lit(None).cast("string")
    for k in sorted(KINDS, key=len):  # the last, longest match wins
        kind = F.when((at > 0) & F.startswith(rest, F.lit(k)), k).otherwise(kind)
    return rows.select("doc_id", T.raw_kind("p").alias("raw_kind"), kind.alias("kind"))


def table_sizes(spark, d):
    return tables.table_profile(spark, d, ["documents", "benchmark", "embeddings", "labels", "events", "part", "lineitem"])


def null_profile(spark, d):
    out = profile.column_profile(tables.items(spark, d).select("item_id", "title", "category", "location", "rating", "price"))
    return out.withColumn("null_rate", F.round("null_rate", 6))


def repeated_texts(spark, d):
    rows = tables.table(spark, d, "documents", ["text", "lang"])
    return profile.repeated_rows(rows.select(F.sha2("text", 256).alias("h"), "lang"), ["h", "lang"])


def text_quantiles(spark, d):
    rows = tables.table(spark, d, "documents", ["text"])
    return profile.quantiles(rows.select(F.length("text").alias("n")), "n", [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]).withColumn("value", F.round("value", 6))


def pivot_crosstab(spark, d):
    rows = tables.table(spark, d, "documents", ["lang", "source"])
    out = profile.crosstab(rows, "source", "lang", ["de", "en", "es", "fr"], normalize=True)
    return out.select("source", *[F.round(c, 6).alias(c) for c in ("de", "en", "es", "fr")])


def pivot_values(spark, d):
    rows = tables.table(spark, d, "documents", ["lang", "source", "n_chars"])
    out = profile.pivot_mean(rows, "source", "lang", ["de", "en", "es", "fr"], "n_chars")
    return out.select("source", *[F.round(c, 6).alias(c) for c in ("de", "en", "es", "fr")])


def share_table(spark, d):
    from ..operators.metrics import share

    return share(tables.table(spark, d, "events", ["event_type"]), "event_type").withColumn("share", F.round("share", 6))


def _halves(spark, d):
    e = tables.table(spark, d, "events", ["event_id", "event_type", "user_id"]).withColumn("bucket", F.col("user_id") % 37)
    return e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0")


def tv_shift(spark, d):
    a, b = _halves(spark, d)
    out = profile.total_variation(a, b, "bucket")
    return out.select(F.round("total_variation", 6).alias("total_variation"), F.round("unseen_share", 6).alias("unseen_share"))


def share_ratio(spark, d):
    a, b = _halves(spark, d)
    return profile.compare_shares(a, b, "event_type").select("event_type", *[F.round(c, 6).alias(c) for c in ("share_a", "share_b", "ratio")])


def exposure(spark, d):
    h = tables.clicks(spark, d)
    q = tables.table(spark, d, "part", ["p_name"]).select(T.clean("p_name").alias("query_norm"))
    out = profile.exposure(q, h, "query_norm")
    return out.select("n_texts", F.round("seen_share", 6).alias("seen_share"), F.round("rare_share", 6).alias("rare_share"), "capped_rows")


def vocabulary_miss(spark, d):
    """Share of the queries' words that no item title holds."""
    q = tables.queries(spark, d).select("query_key", F.explode(T.tokenize("search_query")).alias("term"))
    v = tables.items(spark, d).select(F.explode(T.tokenize("title")).alias("term")).distinct()
    out = profile.vocabulary_misses(q.withColumn("part", F.col("query_key") % 4), v, "part")
    return out.select("part", "n_tokens", F.round("miss_rate", 6).alias("miss_rate"), F.round("miss_rate_distinct", 6).alias("miss_rate_distinct"))


QUANTILES = "[0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]"
HALVES = "e as (select *, user_id % 37 as bucket from events), a as (select * from e where event_id % 3 = 0), b as (select * from e where event_id % 3 <> 0)"


def _shares(key):
    return f"""sa as (select {key}, count(*) / sum(count(*)) over () as share_a from a group by {key}),
sb as (select {key}, count(*) / sum(count(*)) over () as share_b from b group by {key}),
s as (select coalesce(sa.{key}, sb.{key}) as {key}, coalesce(share_a, 0) as share_a, coalesce(share_b, 0) as share_b from sa full join sb on sa.{key} = sb.{key})"""


def _script(x):
    n = lambda p: f"len(regexp_extract_all({x}, '{p}'))"
    c, la = n("[А-Яа-яЁё]"), n("[A-Za-z]")
    return f"case when {c} + {la} < 2 then 'other' when {c} / greatest({c} + {la}, 1) >= 0.6 then 'cyrillic' when {la} / greatest({c} + {la}, 1) >= 0.6 then 'latin' else 'mixed' end"


_RAW = "raw as (select * replace (case when item_id % 3 = 0 then concat('Ремонт ТЁплый  тёплый ДОМ: ', title) else title end as title) from items)"
_CONTENT = f"list_concat(list_concat({S.tokens('params')}, ['описание']), {S.tokens('description')})"
_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"

SQL = {
    "clean_text": f"select doc_id, md5({S.clean('text')}) as clean_md5, length({S.clean('text')}) as n_clean from documents",
    "tok_items": f"select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, {S.tokens('text')} as t from documents)",
    "dominant_script": f"""with {ITEMS}, x as (select item_id, concat(title, case when item_id % 3 = 0 then ' ремонт айфона быстро и качественно во всех районах города' else '' end) as f,
        concat(title, ' ', substr(description, 1, 1000)) as g from items) select item_id, {_script('f')} as title_script, {_script('g')} as item_script from x""",
    "min_rating": f"""select doc_id, {S.least_rating('t')} as least_rating from (select doc_id, case doc_id % 5 when 0 then 'Рейтинг пользователя 4 звезды и выше' when 1 then 'рейтинг 4,5'
        when 2 then 'рейтинг от 3.5 до 5' when 3 then 'без условий' else '' end as t from documents)""",
    "query_id_sha1": BASE.rstrip(",\n") + " select query_key, substr(sha1(concat_ws(chr(31), search_query, location::varchar, delivery::varchar, coalesce(nullif(filters, ''), 'None'), category::varchar)), 1, 16) as query_id from queries",
    "passages": f"""with {ITEMS}, {_RAW}, c as (select item_id, {S.clean('title')} as title, {_CONTENT} as content from raw),
        w as (select item_id, title, content, unnest(range(0, least(4, (len(content) - 1) // 110 + 1))) as chunk from c)
        select item_id, chunk, md5(concat('passage: ', title, '. ', array_to_string(list_slice(content, chunk * 110 + 1, chunk * 110 + 140), ' '))) as passage_md5 from w""",
    "short_views": f"""with {ITEMS}, {_RAW}, c as (select item_id, {S.clean('title')} as t, {S.clean('params')} as p, {S.clean('description')} as d from raw)
        select item_id, concat(t, '. ', p) as short_view, md5(trim(concat_ws(' ', t, t, t, p, d))) as text_md5 from c""",
    "query_views": BASE + f"""raw as (select query_key, case when query_key % 2 = 0 then concat('Найти ТЁплый  ', search_query) else search_query end as s, upper(filters) as f from queries)
        select query_key, trim(concat('query: ', {S.clean('s')}, ' ', {S.clean('f')})) as sparse_view, trim(concat({S.clean('s')}, ' ', {S.clean('f')})) as dense_view from raw""",
    "item_text_stats": f"""with {ITEMS}, l as (select 'title' as field, length(title) as n from items union all select 'params', length(params) from items union all select 'description', length(description) from items)
        select field, round(avg(n), 6) as mean_len, max(n) as max_len, """ + ", ".join(f"round(quantile_cont(n, {q / 100}), 6) as p{q}" for q in (25, 50, 75, 90, 95, 99)) + " from l group by field",
    "char_ngrams": BASE + f"""w as (select query_key, concat(' ', unnest(string_split({S.clean('search_query')}, ' ')), ' ') as p from queries),
        g as (select query_key, p, unnest([3, 4, 5]) as n from w where length(p) > 2),
        x as (select query_key, substr(p, unnest(range(1, greatest(1, length(p) - n + 1)::bigint + 1)), n) as gram from g where n <= length(p) or n = 3)
        select gram, count(*) as n, count(distinct query_key) as n_queries from x group by gram""",
    "text_overlap": BASE + f"""x as (select query_key, item_id, {S.token_set('search_query')} as a, {S.token_set('title')} as b from queries q join items i on q.location = i.location)
        select query_key, item_id, len(list_intersect(a, b)) as overlap, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) as coverage,
          round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) as jaccard from x where len(list_intersect(a, b)) > 0""",
    "item_priors": f"""with {ITEMS} select item_id, coalesce(rating, -1.0) as rating, round(ln(1 + greatest(coalesce(reviews, 0), 0)), 6) as log_reviews, round(ln(1 + greatest(coalesce(price, 0), 0)), 6) as log_price,
        cast(phone_hidden = 1 as bigint) as phone_hidden, cast(message_forbidden = 1 as bigint) as message_forbidden from items""",
    "service_kind": f"""with k as (select unnest({_KINDS}) as kind), r as (
          select doc_id, case when doc_id % 7 = 0 then 'Онлайн-запись Да' else concat('Категория X Вид услуги ', {_KINDS}[doc_id % 5 + 1], case when doc_id % 2 = 0 then ' Тип услуги на дому' else '' end) end as p from documents),
        s as (select doc_id, case when instr(p, 'Вид услуги ') > 0 then substr(p, instr(p, 'Вид услуги ') + 11) end as rest from r),
        c as (select doc_id, rest, least(""" + ", ".join(f"nullif(instr(rest, '{e}'), 0) - 1" for e in T.KIND_ENDS) + """) as cut from s)
        select doc_id, any_value(nullif(trim(substr(rest, 1, coalesce(cut, length(rest)))), '')) as raw_kind, arg_max(kind, length(kind)) filter (starts_with(rest, kind)) as kind from c, k group by doc_id""",
    "table_sizes": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows, {n}::bigint as n_columns from {t}" for t, n in (("documents", 5), ("benchmark", 2), ("embeddings", 3), ("labels", 3), ("events", 6), ("part", 6), ("lineitem", 11))),
    "null_profile": f"with {ITEMS} " + " union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, round((count(*) - count({c})) / count(*), 6) as null_rate, count(distinct {c}) as n_unique from items" for c in ("item_id", "title", "category", "location", "rating", "price")),
    "repeated_texts": "select sum(n - 1)::bigint as n_repeated, max(n) as largest, sum(n - 1) = 0 as is_unique from (select count(*) as n from documents group by text, lang)",
    "text_quantiles": f"select unnest({QUANTILES})::double as quantile, round(unnest((select quantile_cont(length(text), {QUANTILES}) from documents)), 6) as value",
    "pivot_crosstab": "select source, " + ", ".join(f"round(count(*) filter (lang = '{c}') / count(*) filter (lang in ('de', 'en', 'es', 'fr')), 6) as {c}" for c in ("de", "en", "es", "fr")) + " from documents group by source",
    "pivot_values": "select source, " + ", ".join(f"round(avg(n_chars) filter (lang = '{c}'), 6) as {c}" for c in ("de", "en", "es", "fr")) + " from documents group by source",
    "share_table": "select event_type, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from events group by event_type",
    "tv_shift": f"with {HALVES}, {_shares('bucket')} select round(sum(abs(share_a - share_b)) / 2, 6) as total_variation, round(coalesce(sum(share_b) filter (share_a = 0), 0.0), 6) as unseen_share from s",
    "share_ratio": f"with {HALVES}, {_shares('event_type')} select event_type, round(share_a, 6) as share_a, round(share_b, 6) as share_b, round(case when share_b > 0 then share_a / share_b end, 6) as ratio from s",
    "exposure": f"""with c as (select {S.clean('p_name')} as q, count(*) as n from lineitem join part on l_partkey = p_partkey group by q),
        t as (select {S.clean('p_name')} as q from part) select count(*) as n_texts, round(avg(cast(n is not null as int)), 6) as seen_share, round(avg(cast(coalesce(n, 0) <= 1 as int)), 6) as rare_share,
        sum(least(n, 32))::bigint as capped_rows from t left join c using (q)""",
    "vocabulary_miss": BASE + f"""q as (select query_key % 4 as part, unnest({S.tokens('search_query')}) as term from queries), c as (select part, term, count(*) as n from q group by all),
        v as (select distinct unnest({S.tokens('title')}) as term, 1 as known from items)
        select part, sum(n)::bigint as n_tokens, round(sum(case when known is null then n else 0 end) / sum(n), 6) as miss_rate, round(avg((known is null)::int), 6) as miss_rate_distinct from c left join v using (term) group by part""",
}

QUERIES = {
    f.__name__: f
    for f in (
        clean_text, tok_items, dominant_script, min_rating, query_id_sha1, query_views, passages, short_views, item_text_stats, char_ngrams, text_overlap, item_priors,
        service_kind, table_sizes, null_profile, repeated_texts, text_quantiles, pivot_crosstab, pivot_values, share_table, tv_shift, share_ratio, exposure, vocabulary_miss,
    )
}
