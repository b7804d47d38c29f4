"""DuckDB building blocks of the oracle SQL: the same entities and operators as CTEs."""

TOKEN = r"[\pL\pN_]+(?:[-''][\pL\pN_]+)*"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(lower(replace(coalesce({x}, ''), 'ё', 'е')), '\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({clean(x)}, '{TOKEN}')"


def token_set(x: str) -> str:
    return f"list_distinct({tokens(x)})"


ITEMS = f"""items as (
  select doc_id as item_id, array_to_string(list_slice({tokens('text')}, 1, 8), ' ') as title,
    concat_ws(' ', lang, source) as params, text as description,
    cast(case lang when 'en' then 1 when 'es' then 2 when 'fr' then 3 when 'de' then 4 else 0 end as bigint) as category,
    cast(substr(source, 4) as bigint) as location,
    case when doc_id % 7 <> 0 then 1 + (doc_id % 9) / 2.0 end as rating,
    n_chars % 50 as reviews, n_chars as price, doc_id % 2 as phone_hidden, cast(doc_id % 3 = 0 as bigint) as message_forbidden
  from documents)"""

RATING = r"try_cast(replace(nullif(regexp_extract(lower(coalesce({x}, '')), 'рейтинг[^\d]{{0,20}}([1-5](?:[.,]\d+)?)', 1), ''), ',', '.') as double)"


def least_rating(x: str) -> str:
    return RATING.format(x=x)


QUERIES = f"""queries0 as (
  select item_id as query_key, array_to_string(list_slice({tokens('text')}, 1, 6), ' ') as search_query,
    item_id % 5 as category, item_id % 20 as location, cast(item_id % 10 = 9 as bigint) as delivery,
    case when item_id % 4 = 0 then 'рейтинг 3,5' else '' end as filters
  from benchmark),
queries as (select *, {least_rating('filters')} as least_rating from queries0)"""

RELEVANT = """relevant as (
  select b.item_id as query_key, d.doc_id as item_id from benchmark b join documents d on contains(d.text, b.text))"""

#: Postings of the item texts, then scores of every (query, item) that shares a term.
BM25 = f"""docs as (select item_id, concat_ws(' ', title, title, title, params, coalesce(description, '')) as doc from items),
counts as (select item_id, term, count(*) as tf from (select item_id, unnest({tokens('doc')}) as term from docs) group by all),
terms as (select term, count(*) as df from counts group by term having count(*) >= 2 order by sum(tf) desc, term limit 350000),
kept as (select c.*, t.df from counts c join terms t using (term)),
lengths as (select item_id, sum(tf) as length from kept group by item_id),
mean as (select (select count(*) from items) as n, greatest((select sum(length) from lengths) / (select count(*) from items), 1.0) as avgdl),
postings as (
  select term, item_id, tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / avgdl)) * ln(1 + (n - df + 0.5) / (df + 0.5)) as weight
  from kept join lengths using (item_id), mean),
qterms as (select query_key, unnest({token_set("trim(concat('query: ', search_query, ' ', filters))")}) as term from queries),
scored as (
  select query_key, item_id, sum(weight) as score from qterms join postings using (term) group by all),
pairs as (
  select s.query_key, s.item_id, s.score,
    (q.category = 0 or q.category = i.category) and (q.least_rating is null or coalesce(i.rating, -1) >= q.least_rating) as global_ok,
    q.delivery = 0 and q.location = i.location as local_ok
  from scored s join queries q using (query_key) join items i using (item_id))"""

BASE = f"with {ITEMS},\n{QUERIES},\n{RELEVANT},\n"


def top(source: str, k: int, by: str = "query_key", where: str = "true", score: str = "score", digits: int = 9) -> str:
    return (
        f"select * from (select *, cast(row_number() over (partition by {by} order by round({score}, {digits}) desc, item_id) as int) as rank "
        f"from {source} where {where}) where rank <= {k}"
    )


CHANNELS = f"""sparse as (
  select query_key, 'bm25_global' as channel, item_id, rank from ({top('pairs', 250, where='global_ok')})
  union all select query_key, 'bm25_local', item_id, rank from ({top('pairs', 250, where='global_ok and local_ok')})
  union all select query_key, 'bm25_plain', item_id, rank from ({top('pairs', 250)}))"""

#: Exact passage search; inner products are added in order, as the engine does.
DENSE = """passages as (
  select vec_id as passage_id, vec_id % 100 as item_id, embedding as vector,
    case when vec_id < (select (count(*) + 1) // 2 from embeddings) then 0 else 1 end as shard from embeddings),
dq as (select q.*, e.embedding as qvector from queries q join embeddings e on e.vec_id = q.query_key),
dots as (
  select q.query_key, p.passage_id, p.item_id, p.shard, list_sum(list_transform(list_zip(p.vector, q.qvector), lambda x: x[1]::double * x[2]::double)) as score,
    i.location = q.location as at_place,
    (q.category = 0 or q.category = i.category) and (q.least_rating is null or coalesce(i.rating, -1) >= q.least_rating) as ok
  from dq q, passages p join items i on i.item_id = p.item_id),
dcut as (select *, row_number() over (partition by query_key, shard order by round(score, 9) desc, passage_id) as cut from dots),
dplace as (select *, row_number() over (partition by query_key order by round(score, 9) desc, passage_id) as place from dcut where cut <= {per_shard}),
dglobal as (
  select query_key, item_id, cast(row_number() over (partition by query_key order by place) as int) as rank
  from (select query_key, item_id, min(place) as place from dplace where ok group by all)),
lcut as (select *, row_number() over (partition by query_key order by round(score, 9) desc, passage_id) as place from dots where at_place),
dlocal as (
  select query_key, item_id, cast(row_number() over (partition by query_key order by place) as int) as rank
  from (select query_key, item_id, min(place) as place from lcut where place <= 750 and ok group by all))"""


def fused(source: str, weights: dict[str, float], k: float, limit: int = 250) -> str:
    """RRF of clean lists (query_key, channel, item_id, rank), terms added in order."""
    wide = ", ".join(f"min(case when channel = '{c}' then rank end) as r{n}" for n, c in enumerate(weights))
    score = " + ".join(["0.0::double", *(f"coalesce({float(w)}::double / ({float(k)}::double + r{n}), 0)" for n, w in enumerate(weights.values()))])
    best = f"least({', '.join(f'r{n}' for n in range(len(weights)))})" if len(weights) > 1 else "r0"
    names = ", ".join(f"'{c}'" for c in weights)
    return f"""select query_key, item_id, cast(rank as int) as rank, score, best_rank from (
    select *, row_number() over (partition by query_key order by round(score, 12) desc, best_rank, item_id) as rank from (
      select query_key, item_id, {score} as score, {best} as best_rank from (
        select query_key, item_id, {wide} from {source} where channel in ({names}) group by all))) where rank <= {limit}"""


#: All channels of the selector: sparse, two dense systems (the second over reversed vectors), and their fusion.
ALL_LISTS = (
    BM25 + ",\n" + CHANNELS + ",\n" + DENSE.format(per_shard=1500) + ",\n"
    + DENSE.format(per_shard=1500).replace("passages as", "passages2 as").replace("embedding as vector", "list_reverse(embedding) as vector").replace("dq as", "dq2 as")
    .replace("dots as", "dots2 as").replace("from dq q, passages p", "from dq2 q, passages2 p").replace("dcut as", "dcut2 as").replace("from dots)", "from dots2)")
    .replace("dplace as", "dplace2 as").replace("from dcut ", "from dcut2 ").replace("dglobal as", "dglobal2 as").replace("from dplace ", "from dplace2 ")
    .replace("lcut as", "lcut2 as").replace("from dots where", "from dots2 where").replace("dlocal as", "dlocal2 as").replace("from lcut ", "from lcut2 ") + """,
parts as (
  select * from sparse
  union all select query_key, 'zero_global', item_id, rank from dglobal union all select query_key, 'zero_local', item_id, rank from dlocal
  union all select query_key, 'v2_global', item_id, rank from dglobal2 union all select query_key, 'v2_local', item_id, rank from dlocal2),
systems as (
  select query_key, 'bm25' as channel, item_id, rank from (""" + fused("parts", {"bm25_global": 1.0, "bm25_local": 1.15}, 60) + """)
  union all select query_key, 'zero', item_id, rank from (""" + fused("parts", {"zero_global": 1.0, "zero_local": 1.15}, 60) + """)
  union all select query_key, 'v2', item_id, rank from (""" + fused("parts", {"v2_global": 1.0, "v2_local": 2.0}, 60) + """)),
fused_list as (""" + fused("systems", {"bm25": 1.0, "zero": 1.0, "v2": 1.0}, 20) + """),
lists as (
  select * from parts union all select * from systems union all select query_key, 'fused', item_id, rank from fused_list)"""
)

UNION_POOL = """union_pool as (
  select query_key, item_id, cast(row_number() over (partition by query_key order by seen, item_id) as int) as position from (
    select query_key, item_id, min((case channel when 'bm25' then 1 when 'zero' then 2 else 3 end) * 1000 + rank) as seen
    from lists where channel in ('bm25', 'zero', 'v2') and rank <= 100 group by all))"""


def recall_of(ranking: str, k: int | None = 50) -> str:
    cut = f"where rank <= {k}" if k is not None else ""
    return f"""select query_key, count(*) as n_relevant, count(hit) as n_found from (select distinct query_key, item_id from relevant)
    left join (select distinct query_key, item_id, 1 as hit from {ranking} {cut}) using (query_key, item_id) group by query_key"""
