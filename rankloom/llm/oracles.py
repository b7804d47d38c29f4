"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .kneser_ney import UNIT as KN_UNIT
from .rules import UNIT

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Every byte 4-gram of every text, as an integer.
GRAMS = """raw as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
spots as (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 3, 0)::bigint)) as pos from raw),
grams as (select doc_id, ('0x' || substr(h, 2 * pos + 1, 8))::bigint as gram from spots)"""

TRUSTED = "good as (select distinct doc_id from labels where quality = 1)"

QUALITY_RULES = f"""with w as (select doc_id, coalesce(text, '') as text, {WORDS} as ws from documents),
fives as (select doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') as key from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1)::bigint)) as i from w)),
again as (select doc_id, key from fives group by all having count(*) > 1),
repeated as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + 5)) as p from fives join again using (doc_id, key)) group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
dups as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
base as (
  select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(dups.n, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words from w left join dups using (doc_id) left join repeated using (doc_id)),
{GRAMS}, {TRUSTED},
hashed as (select doc_id, (gram * 2654435769 % 4294967296) // 65536 as bucket from grams),
counted as (
  select bucket, 1 + count(h.bucket) as n, 1 + count(case when g.doc_id is not null then h.bucket end) as t
  from (select unnest(range(0, 65536)) as bucket) b left join hashed h using (bucket) left join good g using (doc_id) group by bucket),
ratios as (select bucket, round({UNIT} * (ln(t / (select sum(t) from counted)::double) - ln(n / (select sum(n) from counted)::double)))::bigint as ratio from counted),
scores as (select doc_id, sum(ratio)::bigint as total, count(*) as n from hashed join ratios using (bucket) group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  coalesce(total::double / n::double / {UNIT}, 0.0) as score,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and coalesce(total, 0) >= {round(-0.3 * UNIT)} * coalesce(n, 0) as kept
from base left join scores using (doc_id)"""

SUBSTRING_DEDUP = f"""with w as (select doc_id, {WORDS} as ws from documents),
windows as (select doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) as h from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1)::bigint)) as i from w)),
least as (select h, min(doc_id) as first from windows group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from windows join least using (h) where first < doc_id),
spots as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws)::bigint + 1)) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n from spots anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)"""


def _order(k: int, of: str = "") -> str:
    """Counts, discounts, context totals and probabilities of one order; c{k}{of} holds gram and c."""
    lower = "1 / 256.0::double" if k == 1 else "l.p"
    wanted = "select unnest(range(0, 256)) as gram" if k == 1 else f"select distinct gram & {(1 << 8 * k) - 1} as gram from corpus"
    join = "" if k == 1 else f" join p{k - 1}{of} l on l.gram = x.gram & {(1 << 8 * (k - 1)) - 1}"
    clip = lambda e, n: f"least(greatest({e}, 0.05), {n}.95)"
    y, i = "(n1 / (n1 + 2 * n2)::double)", f"{k}{of}"
    return f"""n{i} as (select count(*) filter (c = 1) as n1, count(*) filter (c = 2) as n2, count(*) filter (c = 3) as n3, count(*) filter (c = 4) as n4 from c{i}),
d{i} as (select case when n1 > 0 and n2 > 0 then {clip(f'1 - 2 * {y} * n2 / n1', 0)} else 0.5 end as d1, case when n1 > 0 and n2 > 0 then {clip(f'2 - 3 * {y} * n3 / n2', 1)} else 0.5 end as d2,
  case when n1 > 0 and n2 > 0 then {clip(f'case when n3 > 0 then 3 - 4 * {y} * n4 / n3 else 1.5 end', 2)} else 0.5 end as d3 from n{i}),
o{i} as (select gram, c, (case c when 1 then d1 when 2 then d2 else d3 end)::double as off from c{i}, d{i}),
t{i} as (select gram >> 8 as context, sum(c)::double as total, sum(least(off, c)) as rest from o{i} group by gram >> 8),
p{i} as (select x.gram, case when t.total is null then {lower} else (greatest(coalesce(o.c - o.off, 0), 0) + t.rest * {lower}) / t.total end as p
  from ({wanted}) x left join t{i} t on t.context = x.gram >> 8 left join o{i} o on o.gram = x.gram{join})"""


def _model(of: str, good: str) -> str:
    """p4{of} over the documents in ``good``, and the costs it gives (scored{of})."""
    counts = f"c4{of} as (select gram, count(*) as c from grams semi join {good} using (doc_id) group by gram)"
    for k in (3, 2, 1):
        counts += f", c{k}{of} as (select gram & {(1 << 8 * k) - 1} as gram, count(*) as c from c{k + 1}{of} group by 1)"
    scored = f"select doc_id, -sum(round(ln(p) * {KN_UNIT})::bigint)::double / count(*) / {KN_UNIT} as cost, count(*) as n from grams join p4{of} using (gram) group by doc_id"
    return f"{counts}, {', '.join(_order(k, of) for k in (1, 2, 3, 4))}, scored{of} as ({scored})"


QUALITY_CLASSIFIER = f"""with {GRAMS}, {TRUSTED}, good_a as (select * from good where doc_id % 2 <> 0), good_b as (select * from good where doc_id % 2 <> 1),
corpus as (select distinct gram from grams), {_model('', 'good')}, {_model('_a', 'good_a')}, {_model('_b', 'good_b')},
held as (select * from scored_a where doc_id % 2 = 0 union all select * from scored_b where doc_id % 2 = 1),
steps as (select lang, ceil((cost - 1.0::double / sqrt(n::double)) * 1000)::bigint as step from held join documents using (doc_id) semi join good using (doc_id)),
ranked as (select lang, step, row_number() over (partition by lang order by step) as k, count(*) over (partition by lang) as total, row_number() over (order by step) as k_all, count(*) over () as total_all from steps),
each as (select lang, min(step) / 1000.0::double as most from ranked where k >= 0.99 * total and total >= 20 and lang is not null group by lang),
every as (select min(step) / 1000.0::double as most from ranked where k_all >= 0.99 * total_all),
out as (select doc_id, lang, cost, coalesce(each.most, every.most) + 1.0::double / sqrt(greatest(coalesce(n, 1), 1)::double) as limit_cost
  from documents left join scored using (doc_id) left join each using (lang), every)
select doc_id, lang, round(exp(cost), 6) as perplexity, round(exp(limit_cost), 6) as threshold, coalesce(cost is not null and (limit_cost is null or cost <= limit_cost), false) as kept from out"""

SQL = {"op6_quality_rules": QUALITY_RULES, "op8_quality_classifier": QUALITY_CLASSIFIER, "op10_substring_dedup": SUBSTRING_DEDUP}
