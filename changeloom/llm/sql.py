"""DuckDB SQL for the queries that SQL can express over whole tables.

Packing, token files and suffix deduplication are tested against brute force
instead: tokenizing has no SQL, and listing every 400-byte string is too slow.
"""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = f"""
lines as (
  select doc_id, source, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos,
         unnest(string_split(coalesce(text, ''), chr(10))) as line
  from documents),
keyed as (
  select *, trim(line, {_SPACES}) <> '' as worded,
         lower(regexp_replace(trim(line, {_SPACES}), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as key
  from lines)
"""

OP1 = f"""
with {_LINES},
pages as (select source, count(*) as pages from documents group by source),
counted as (select source, key, count(distinct doc_id) as n from keyed where worded group by source, key),
bad as (select c.source, c.key from counted c join pages p on c.source is not distinct from p.source
        where c.n >= 3 and c.n > p.pages * 0.05),
marked as (
  select k.*, worded and exists (select 1 from bad b where b.source is not distinct from k.source and b.key = k.key) as gone
  from keyed k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as text_sha256
from marked group by doc_id
"""

OP3 = """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select *, min(page_id) over (partition by html) as first from p)
select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest,
       case when strlen(html) >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when strlen(html) >= 100 and page_id <> first then first end as refers_to
from f
"""

OP4 = f"""
with {_LINES},
pages as (select source, count(distinct doc_id) as docs from keyed where worded group by source),
counted as (select source, key, count(distinct doc_id) as n from keyed where worded group by 1, 2),
bad as (select c.source, c.key from counted c join pages p on c.source is not distinct from p.source
        where c.n > 20 and c.n > p.docs * 0.02),
gone as (
  select k.doc_id, sum(len(regexp_extract_all(k.line, '[^\\x20\\x09-\\x0D]+'))) as removed
  from keyed k join bad b on b.source is not distinct from k.source and b.key = k.key where k.worded group by 1),
dup as (
  select doc_id, sum(n - 1) as n_dup_lines from (select doc_id, line, count(*) as n from keyed where worded group by 1, 2) group by 1),
w as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
tri as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as t
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)),
starts as (select doc_id, i from (select *, count(*) over (partition by doc_id, t) as n from tri) where n > 1),
covered as (
  select doc_id, count(distinct i + k) as n_repeat_words
  from starts, (values (0), (1), (2)) as o(k) group by doc_id),
base as (
  select w.doc_id, len(words)::bigint as n_words, len(array_to_string(words, ''))::bigint as word_chars,
         len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(d.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words,
         coalesce(g.removed, 0)::bigint as n_removed_words
  from w left join dup d using (doc_id) left join covered c using (doc_id) left join gone g using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not n_removed_words > n_words * 0.5 as kept, n_removed_words
from judged
"""

OP5 = """
with s as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
k as (select *, md5(concat_ws(':', 'mix-1', doc_id::varchar, size::varchar)) as key from s),
n as (select greatest(1, least(65536, (count(*) + 2047) // 2048)) as shards from s),
dealt as (select *, ('0x' || substr(key, 1, 8))::bigint % (select shards from n) as shard from k),
src as (select source, sum(size)::bigint as words, row_number() over (order by source nulls last) as rank from s group by source),
wt as (select *, [5, 2, 1][(rank - 1) % 3 + 1] as weight, 3 * words as most, sum(words) over ()::bigint as total from src),
lv as (
  select *, total - coalesce(sum(most) over (order by most / weight, rank rows between unbounded preceding and 1 preceding), 0) as room,
         sum(weight) over () - coalesce(sum(weight) over (order by most / weight, rank rows between unbounded preceding and 1 preceding), 0) as rest
  from wt),
st as (select *, most * rest <= room * weight as stopped from lv),
t as (
  select source, words, rank, total,
         round(case when stopped then most::double else
           (total - sum(case when stopped then most else 0 end) over ())::double * weight
             / greatest(sum(case when stopped then 0 else weight end) over (), 1)::double end, 6) as target
  from st),
seats as (select *, floor(total / 16 + 0.5)::bigint as seats from t),
quot as (
  select source, rank, unnest(range(0, ceil(target / 16)::bigint + 40)) as j, target, seats from seats),
won as (select *, row_number() over (order by target / (2 * j + 1) desc, rank, j) as place from quot),
q as (select source, count(*) filter (place <= seats and target > 0) as blocks from won group by source),
parts as (select source, least((select shards from n), greatest(1, words // 16384)) as parts from src),
d as (
  select d.*, case when size > 0 then shard * parts // (select shards from n) else -1 - shard end as cell
  from dealt d join parts p on d.source is not distinct from p.source),
cell as (select source, cell, sum(size)::bigint as cell_words from d group by source, cell),
cq as (
  select c.source, c.cell, c.cell_words, q.blocks, unnest(range(0, ceil(4 * c.cell_words / 16)::bigint + 40)) as j
  from cell c join q on c.source is not distinct from q.source),
cw as (select *, row_number() over (partition by source order by cell_words::double / (2 * j + 1) desc, cell, j) as place from cq),
quota as (
  select source, cell, cell_words, count(*) filter (place <= blocks and cell_words > 0) as quota,
         greatest(1, floor(cell_words / 16 + 0.5)::bigint) as cuts
  from cw group by source, cell, cell_words),
r as (
  select *, least(3, quota // cuts) as rounds, case when quota // cuts < 3 then quota % cuts else 0 end as run,
         ('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce('s' || source, 'n'), cell::varchar)), 1, 8))::bigint % cuts as first
  from quota),
e as (
  select *, first * cell_words // cuts as x1, least(first + run, cuts) * cell_words // cuts as y1,
         greatest(first + run - cuts, 0) * cell_words // cuts as y2
  from r),
p as (
  select d.*, sum(size) over (partition by source, cell order by key, doc_id, size rows unbounded preceding) - size as a from d)
select p.doc_id, p.size, t.words as source_size, t.target,
       (e.rounds * p.size + greatest(0, least(p.a + p.size, e.y1) - greatest(p.a, e.x1)) + greatest(0, least(p.a + p.size, e.y2) - p.a))::bigint as taken
from p join e on p.source is not distinct from e.source and p.cell = e.cell
join t on p.source is not distinct from t.source
"""

OP6 = """
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
from n
"""


def _escaped(text: str) -> str:
    text = f"replace({text}, '\\', '\\\\')"
    for mark in ("</s>", "<s>", "[/INST]", "[INST]"):
        text = f"replace({text}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return text


OP9 = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) as v(conv_id, turn, role, text)),
n as (
  select *, coalesce(lag(role) over (partition by conv_id order by turn, role, text), 'start') as before,
         row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back
  from c)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(case when role = 'assistant' then len(text) end), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       (3 + sum(17 + len({_escaped("role")}) + len({_escaped("text")})))::bigint as formatted_chars,
       bool_and((before || '>' || role) in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')
                and (back > 1 or role = 'assistant')) as valid
from n group by conv_id
"""

OP10 = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
sh as (
  select distinct doc_id, array_to_string(words[i:i + 4], ' ') as s
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select p.a, p.b from pairs p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * common >= 75 * (x.n + y.n - common)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from w union select r.doc_id, e.b from reach r join edges e on e.a = r.other),
comp as (select doc_id, min(other) as component_id from reach group by doc_id)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, c.doc_id = c.component_id as kept
from comp c left join n using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1,
        "op3_warc_salvage": OP3,
        "op4_quality_rules": OP4,
        "op5_source_mixing": OP5,
        "op6_exact_dedup": OP6,
        "op9_chat_format": OP9,
        "op10_minhash_dedup": OP10,
    }
