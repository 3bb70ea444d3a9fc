"""Queries of this subpackage and their SQL, by the names they are registered under."""

from __future__ import annotations

import corpus_pipeline
from gridlark.llm.align import op12_alignment
from gridlark.llm.ann import op1_ann
from gridlark.llm.bpe import op7_bpe
from gridlark.llm.chat import op3_chat_format
from gridlark.llm.decontaminate import op2_decontaminate
from gridlark.llm.jaccard_join import op5_jaccard_join
from gridlark.llm.langid import op4_language_id
from gridlark.llm.license_scan import op10_license_scan
from gridlark.llm.line_dedup import op9_line_dedup
from gridlark.llm.mixing import op11_mixing
from gridlark.llm.quality import op6_quality
from gridlark.llm.resample import op13_resample
from gridlark.llm.shard import op8_sharding

QUERIES = {
    "op1_ann": op1_ann,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat_format": op3_chat_format,
    "op4_language_id": op4_language_id,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_mixing": op11_mixing,
    "op12_alignment": op12_alignment,
    "op13_resample": op13_resample,
    "pipeline": corpus_pipeline.run,
}

_OP3 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m as (select *, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as fresh,
             length(text) + len(regexp_extract_all(text, '<\\*\|')) as n from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       (sum(n) + sum(fresh * (length(role) + 15)) + 7 * (count(*) - sum(fresh)))::bigint as formatted_chars
from m group by conv_id
"""

_OP5 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from documents),
s as (select distinct doc_id, case when len(a) < 4 then array_to_string(a, ' ') else array_to_string(a[i:i+3], ' ') end as g
      from (select doc_id, a, unnest(range(1, greatest(len(a) - 3, least(len(a), 1)) + 1)) as i from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
k as (select a, least(min(a), min(b)) as m from r group by a),
d as (select a, count(*) as links from l group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(k.m, w.doc_id) as component_id, coalesce(d.links, 0) as n_links
from w left join n using (doc_id) left join k on k.a = w.doc_id left join d on d.a = w.doc_id
"""

# Not by suffixes: of each line the shortest run of five words that begins or ends there,
# as text; the union of those that have been before is that of all repeated runs.
_OP9 = r"""
with a as (select doc_id, string_split(text, chr(10)) as a from documents where text is not null),
l as (select doc_id, a, unnest(range(len(a))) as i from a),
w as (select doc_id, a, i, len(regexp_extract_all(a[i + 1], '[^\x20\x09-\x0D]+')) as n from l),
r as (select *, sum(n) over (partition by doc_id order by i) as c, sum(n) over (partition by doc_id order by i) - n as b from w),
up as (select doc_id, c * 1000000 + i as k, i from r),
down as (select doc_id, b * 1000000 + i as k, i from r),
f as (select x.doc_id, x.a, x.i as s, up.i as e from (select doc_id, a, i, (b + 5) * 1000000 as k from r) x asof join up on x.doc_id = up.doc_id and x.k <= up.k),
g as (select x.doc_id, x.a, down.i as s, x.i as e from (select doc_id, a, i, (c - 5) * 1000000 + 999999 as k from r where c >= 5) x asof join down on x.doc_id = down.doc_id and x.k >= down.k),
u as (select distinct doc_id, s, e, array_to_string(a[s + 1:e + 1], chr(10)) as t from (select * from f union all select * from g)),
m as (select *, min((doc_id, s)) over (partition by t) as first from u),
d as (select distinct doc_id, unnest(range(s, e + 1)) as i from m where (doc_id, s) <> first),
k as (select r.doc_id, count(d.i) as n_deleted, coalesce(string_agg(cast(d.i as varchar), ',' order by d.i), '') as deleted,
             coalesce(string_agg(r.a[r.i + 1], chr(10) order by r.i) filter (d.i is null), '') as text from r left join d on d.doc_id = r.doc_id and d.i = r.i group by 1)
select doc_id, coalesce(n_deleted, 0) as n_deleted, coalesce(deleted, '') as deleted, k.text from documents left join k using (doc_id)
"""

# The level is that of the first number of full sources (in order of limit over weight)
# at which the next one is not full; the turn is the one of 32 that comes nearest.
_OP11 = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, ('0x' || substr(sha256('11:' || doc_id), 1, 8))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, [5, 2, 1][(row_number() over (order by source is null, source) - 1) % 3 + 1] as w, 3::double * sum(size) as cap from d group by source),
o as (select *, sum(cap) over (order by cap / w, w, source rows unbounded preceding) - cap as c, sum(w) over () - sum(w) over (order by cap / w, w, source rows unbounded preceding) + w as r, sum(source_size) over () as t from s),
lv as (select arg_min((t - c) / r, (cap / w, w, source)) as level from o where (t - c) / r <= cap / w),
g as (select source, source_size, least(cap, level * w) as target, case when source_size > 0 then least(cap, level * w) / source_size else 0 end as rate from s, lv),
x as (select d.*, g.* exclude (source) from d join g on d.source is not distinct from g.source),
y as (select x.*, k, case when ((h + k * 2654435761) % 4294967296 + 0.5::double) / 4294967296 < rate - floor(rate) then 1 else 0 end as extra from x, range(32) q(k)),
e as (select source, k, abs(any_value(source_size) * floor(any_value(rate)) + sum(size * extra) - any_value(target)) as off from y group by all),
b as (select source, arg_min(k, (off, k)) as k from e group by source)
select doc_id, size, source_size, target, ((floor(rate) + extra) * size)::bigint as taken, y.source, (floor(rate) + extra)::bigint as copies from y join b on y.source is not distinct from b.source and y.k = b.k
"""

_OP13 = r"""
with crc as (select list(c order by i) as t from (select i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) r(i))),
d as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents),
q as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
v as (select w, xor(list_reduce(list_concat([4294967295], list_transform(range(len(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as b
  from (select w from d union select w from q), crc),
s as (select b, count(*) as s from d join v using (w) group by b),
t as (select b, count(*) as t from q join v using (w) group by b),
n as (select (select count(*) from d) as big, (select count(*) from q) as target),
g as (select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * (big + 10000)::double / ((s + 1)::double * (target + 10000)::double))) as gain from s left join t using (b), n),
f as (select doc_id, count(*) as n, floor(sum(gain) / count(*))::bigint as weight from d join v using (w) join g using (b) group by doc_id),
x as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from documents left join f using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from x where n_features >= 20)
select x.*, case when rank <= r.n * 10 // 100 then rank end as rank from x left join r using (doc_id)
"""

ORACLES: dict[str, str] = {"op9_line_dedup": _OP9, "op3_chat_format": _OP3, "op5_jaccard_join": _OP5, "op11_mixing": _OP11, "op13_resample": _OP13}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
