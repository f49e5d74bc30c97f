"""Operators 1, 2 and 5 as plain SQL for DuckDB: right, but for small tables only."""

from .shared import WORD

#: A byte is two hexadecimal digits; frames of 50 rows are the strings.
OP1_SQL = """
with b as (
  select doc_id, unnest(h) as byte, generate_subscripts(h, 1) as pos
  from (select doc_id, regexp_extract_all(hex(encode(text)), '..') as h from documents)
), g as (
  select *, string_agg(byte, '') over (partition by doc_id order by pos rows between current row and 49 following) as win,
    count(*) over (partition by doc_id) as n from b
), c as (
  select doc_id, pos, byte, pos + 49 <= n and min(doc_id) over (partition by win, pos + 49 <= n) < doc_id as early from g
), m as (
  select *, bool_or(early) over (partition by doc_id order by pos rows between 49 preceding and current row) as gone from c
), e as (
  select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as opens from m
), a as (
  select doc_id, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans,
    string_agg(byte, '' order by pos) filter (where not gone) as kept from e group by doc_id
)
select d.doc_id, coalesce(n_bytes, 0)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, ''))) as kept_sha256
from documents d left join a on a.doc_id = d.doc_id
"""

OP2_SQL = f"""
with w as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from (select doc_id, regexp_extract_all(text, '{WORD}') as ws from documents)
), g as (
  select *, string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and 34 following) as win,
    count(*) over (partition by doc_id) as n from w
), c as (
  select doc_id, pos, word, pos + 34 <= n and count(*) over (partition by win, pos + 34 <= n) > 1 as again from g
), m as (
  select *, bool_or(again) over (partition by doc_id order by pos rows between 34 preceding and current row) as gone from c
), a as (
  select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by pos) filter (where not gone) as kept from m group by doc_id
)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join a on a.doc_id = d.doc_id
"""

OP5_SQL = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from documents
), s as (
  select distinct doc_id, array_to_string(ws[i : i + 2], ' ') as shingle
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), l as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by 1, 2) p
    join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 85 * (na.n + nb.n - common)
), e as (
  select a, b from l union all select b, a from l
), r as (
  select doc_id, doc_id as reached from documents union select r.doc_id, e.b from r join e on e.a = r.reached
), c as (
  select doc_id, min(reached) as component_id from r group by doc_id
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
"""
