"""Checking SQL of this folder's queries, for another engine on the same tables.

Queries that tokenize or learn have none; they are tested against plain Python.
"""

from .mixing import LEVELS
from .queries import EPOCHS, PERMILLE, SEED, SHARDS, WEIGHTS
from .sharding import SLOTS

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = {}


def number_of(text):
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


# Turn t of a round claims for the shard whose weights cover it.
turns = [s for s in sorted(SHARDS) for _ in range(SHARDS[s])]
SQL["op1_sharding"] = f"""
with recursive orders as (
  select shard, k, ({number_of("'offset ' || shard")} + k * ({number_of("'skip ' || shard")} % ({SLOTS} - 1) + 1)) % {SLOTS} as slot
  from (select distinct unnest({turns}) as shard), range(0, {SLOTS}) r(k)
), turns as (select unnest({turns}) as shard, unnest(range(0, {len(turns)})) as turn),
filled(slot, t, shard) using key (slot) as (
  select -1::bigint, 0::bigint, -1::int
  union
  (select o.slot, f.t + 1, o.shard from (select max(t) as t from filled) f join turns on turn = f.t % {len(turns)}
    join orders o using (shard) where not exists (select 1 from recurring.filled r where r.slot = o.slot)
    order by k limit 1)
)
select doc_id, d.slot, filled.shard::bigint as shard
from (select doc_id, {number_of("coalesce(doc_id::varchar, 'null key')")} % {SLOTS} as slot from documents) d
join filled using (slot)
"""

SQL["op2_jaccard_join"] = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words
), shingles as (select doc_id, len(s) as n, unnest(s) as sh from sets),
links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b using (sh) where a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached as (
  select doc_id, doc_id as x from sets union select doc_id, b from reached join links on a = x
)
select doc_id, len(s)::bigint as n_shingles, (select min(x) from reached r where r.doc_id = sets.doc_id) as component_id
from sets
"""

SQL["op3_exact_topk"] = """
with v as (
  select vec_id, min(list_transform(embedding, lambda x: floor(64 * x::double))) as w from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.w, c.w)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.w) = len(c.w)
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 20
"""

SQL["op4_quality"] = f"""
with d as (
  select doc_id, source, regexp_extract_all(coalesce(text, ''), '{WORD}') as w, coalesce(text, '') as t,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from documents
), windows as (
  select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': array_to_string(w[i:i + 2], ' ')}})) as x from d
), repeated as (
  select doc_id, x.i as i from windows qualify count(*) over (partition by doc_id, x.g) > 1
), covered as (
  select doc_id, count(distinct i + k) as n from repeated, range(0, 3) r(k) group by doc_id
), counts as (
  select doc_id, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words
  from d left join covered using (doc_id)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts
), failures as (
  select source, unnest([base_failed, word_chars < 2 * n_words or word_chars > 12 * n_words, 10 * n_symbols > n_words,
    20 * n_dup_lines > n_words]) as failed, unnest([1, 2, 3, 4]) as rule from judged
), hosts as (
  select source, rule, count(*)::double as n, sum(failed::int)::double as f from failures group by source, rule
), sums as (
  select rule, count(*) as hosts, sum(n) as docs, sum(f) / sum(n) as mean, sum(f * f / n) - sum(f) * sum(f) / sum(n) as spread,
    sum(n) - sum(n * n) / sum(n) as room from hosts group by rule
), between_hosts as (
  select rule, mean, case when room > 0 then (spread - (hosts - 1) * mean * (1 - mean)) / room else 0 end as v from sums
), prior as (
  select rule, mean, case when v > 0 then least(greatest(mean * (1 - mean) / v - 1, 1), 1e6) else 1e6 end as weight from between_hosts
), rejected as (
  select distinct source from hosts join prior using (rule)
  where (f + greatest(mean * weight, 1e-3)) / (n + greatest(mean * weight, 1e-3) + greatest((1 - mean) * weight, 1e-3)) > 0.5
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from rejected r where r.source is not distinct from judged.source) as kept
from judged
"""

SQL["op6_warc"] = """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p
)
select page_id, payload_bytes, payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type,
  case when page_id <> first then first end as refers_to, null::varchar as error
from f
"""


def weight(level):
    known = "".join(f" when '{value}' then {w}" for value, w in sorted(WEIGHTS.get(level, {}).items()))
    return f"case {level}{known} else 1 end" if known else "1"


def shared(depth):
    """Budgets of one level from those of the level above."""
    path = ", ".join(LEVELS[: depth + 1])
    above = ", ".join(LEVELS[:depth])
    granted = f"join b{depth - 1} using ({above})" if depth else f"""cross join (
      select least((sum(lim)::bigint // {EPOCHS}) * {PERMILLE} // 1000, (sum(lim)::bigint // {EPOCHS}) * {EPOCHS}) as budget from leaves)"""
    by = f"partition by {above}" if above else ""
    return f"""
n{depth} as (
  select {path}, lim, w, budget as granted from (
    select {path}, sum(lim)::bigint as lim, any_value({weight(LEVELS[depth])}) as w from leaves group by {path}
  ) {granted}
), o{depth} as (
  select *, granted - coalesce(sum(lim) over (x rows between unbounded preceding and 1 preceding), 0) as l,
    sum(w) over (x rows between current row and unbounded following) as ws
  from n{depth} window x as ({by} order by lim / w, {LEVELS[depth]})
), r{depth} as (
  select *, first_value(case when l * w // ws < lim then l end ignore nulls) over x as rl,
    first_value(case when l * w // ws < lim then ws end ignore nulls) over x as rw
  from o{depth} window x as ({by} order by lim / w, {LEVELS[depth]} rows between unbounded preceding and current row)
), b{depth} as (
  select {path}, case when rl is null then lim else least(lim, rl * w // rw) end::bigint as budget from r{depth}
)"""


SQL["op7_mixing"] = f"""
with docs as (
  select doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n,
    ['web', 'books', 'code', 'forums'][try_cast(substr(source, 4) as int) % 4 + 1] as domain from documents
), leaves as (select domain, lang, source, sum(n)::bigint as tokens, sum(n)::bigint * {EPOCHS} as lim from docs group by all),
{",".join(shared(d) for d in range(len(LEVELS)))}, epochs as (
  select doc_id, domain, lang, source, n, e as epoch, budget - e * tokens as rest,
    coalesce(sum(n) over (partition by domain, lang, source, e order by md5('{SEED} ' || e || ' ' || doc_id)
      rows between unbounded preceding and 1 preceding), 0) as start
  from docs join leaves using (domain, lang, source) join b2 using (domain, lang, source) cross join range(0, {EPOCHS}) r(e)
)
select doc_id, epoch::int as epoch, domain, lang, source, least(n, rest - start)::bigint as taken from epochs
where start < rest
"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(table, key):
    return f"""
  select {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}')) as term
  from {table} where {key} is not null"""


SQL["op11_ranked_search"] = f"""
with d as ({terms("documents", "doc_id")}), i as ({terms("benchmark", "item_id")}),
tf as (select doc_id, term, count(*) as tf from d group by all),
df as (select term, count(*) as df from tf group by term),
n as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
sums as (select count(*) as n_all, sum(n)::bigint as l_all from n),
norm as (select doc_id, 75 + (25 * n * n_all) // l_all as m from n, sums),
weights as (select term, floor(1000 * ln((2 * n_all + 2)::double / (2 * df + 1)))::bigint as w from df, sums),
scored as (
  select item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from (select item_id, term, count(*) as repeats from i group by all)
  join weights using (term) join tf using (term) join norm using (doc_id) group by all
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 20
"""

SQL["op12_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  qualify row_number() over (partition by vec_id order by 2, 3) = 1
), scored as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.w, c.w)::bigint as score
  from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id and len(a.w) = len(c.w)
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
  (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

SQL["op13_suffix_dedup"] = """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
windows as (
  select doc_id, p, b[p:p + 99] as s from (select doc_id, b, unnest(range(1, octet_length(b) - 98)) as p from d)
), repeated as (
  select doc_id, p from windows qualify row_number() over (partition by s order by doc_id, p) > 1
), marked as (
  select *, coalesce(p > lag(p) over w + 100, true) as new from repeated window w as (partition by doc_id order by p)
), runs as (
  select doc_id, min(p) as first, max(p) + 99 as last from (
    select *, sum(new::int) over (partition by doc_id order by p) as run from marked) group by doc_id, run
), gaps as (
  select doc_id, first, coalesce(lag(last) over (partition by doc_id order by first), 0) + 1 as begin, first - 1 as stop from runs
  union all select doc_id, 1e15::bigint, coalesce(max(last), 0) + 1, max(octet_length(b)) from d left join runs using (doc_id) group by doc_id
), kept as (
  select doc_id, string_agg(hex(b[begin:stop]), '' order by begin) filter (begin <= stop) as h from gaps join d using (doc_id) group by doc_id
), sums as (select doc_id, sum(last - first + 1)::bigint as n, count(*) as runs from runs group by doc_id)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(runs, 0) as n_spans,
  sha256(unhex(coalesce(h, ''))) as kept_sha256
from d left join kept using (doc_id) left join sums using (doc_id)
"""
