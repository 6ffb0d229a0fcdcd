"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from . import linededup, quality, sharding

_M = quality.METRICS
_Q = """
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as body,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from documents),
grams as (
  select rid, i, array_to_string(ws[i:i + 4], ' ') as g
  from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from d where len(ws) >= 5)),
spots as (
  select rid, i, lead(i) over (partition by rid order by i) as nxt
  from (select rid, i, count(*) over (partition by rid, g) as c from grams) where c > 1),
reps as (select rid, sum(least(5, coalesce(nxt - i, 5)))::bigint as n from spots group by rid),
base as (
  select d.rid, doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines, coalesce(reps.n, 0)::bigint as n_repeat_words
  from d left join reps on d.rid = reps.rid),
m as (
  select *, n_words < {min_words} or 100 * n_repeat_words > {repeat} * n_words as base_failed,
    coalesce(1000 * n_symbols // nullif(word_chars, 0), 0)::bigint as symbol_pm,
    coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)::bigint as repeat_pm,
    coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0)::bigint as dup_line_pm,
    coalesce(100 * word_chars // nullif(n_words, 0), 0)::bigint as word_len_c
  from base),
vals as (
  {vals}),
buckets as (
  select lang, source, metric, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) as bucket from vals),
sketch as (select lang, source, metric, bucket, count(*) as n from buckets group by all),
groups as (select lang, source, count(*) as n_group from m where not base_failed group by all),
share as (
  select g.lang, g.source, {prior} * {unit}::hugeint // (n_lang + {prior}) as w_lang, n_all
  from groups g join (select lang, sum(n_group) as n_lang from groups group by all) l on g.lang is not distinct from l.lang, (select sum(n_group) as n_all from groups)),
weights as (select lang, source, w_lang, w_lang * {prior} // n_all as w_all from share),
parts as (
  select lang, source, metric, bucket, n * {unit}::hugeint as w from sketch union all
  select s.lang, s.source, metric, bucket, n * w_lang from weights s join (select lang, metric, bucket, sum(n) as n from sketch group by all) l on s.lang is not distinct from l.lang union all
  select s.lang, s.source, metric, bucket, n * w_all from weights s, (select metric, bucket, sum(n) as n from sketch group by all)),
merged as (select lang, source, metric, bucket, sum(w) as w from parts group by all),
run as (
  select *, sum(w) over (partition by lang, source, metric order by bucket) as upto, sum(w) over (partition by lang, source, metric) as total from merged),
quant as (
  select lang, source, metric, slack, both_sides, min(case when 100 * upto >= top * total then bucket end) as hi,
    min(case when 100 * upto >= 50 * total then bucket end) as mid, min(case when 100 * upto >= (100 - top) * total then bucket end) as lo
  from run join ({slacks}) using (metric) group by all),
limits as (
  select lang, source, metric, 2 * hi - mid + slack as high, case when both_sides then 2 * lo - mid - slack end as low from quant),
wide as (select lang, source, {wide} from limits group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce({bad}, false) as kept, symbol_pm, repeat_pm, dup_line_pm, word_len_c
from m left join wide on m.lang is not distinct from wide.lang and m.source is not distinct from wide.source
"""
OP1 = _Q.format(
    min_words=quality.MIN_WORDS, repeat=quality.REPEAT_PERCENT, prior=quality.PRIOR, unit=quality.UNIT,
    vals=" union all ".join(f"select lang, source, '{m}' as metric, {m} as v from m where not base_failed" for m in _M),
    slacks=" union all ".join(f"select '{m}' as metric, {t} as top, {s} as slack, {str(both).lower()} as both_sides" for m, (t, s, both) in _M.items()),
    wide=", ".join(f"max(case when metric = '{m}' then high end) as high_{m}, max(case when metric = '{m}' then low end) as low_{m}" for m in _M),
    bad=" or ".join(f"m.{m} > wide.high_{m}" + f" or m.{m} < wide.low_{m}" * both for m, (_, _, both) in _M.items()))

OP4 = f"""
with r as (
  select doc_id, coalesce(strlen(text), 0)::bigint as bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 8))::bigint as h from documents),
e as (select h, depth, h >> (32 - depth) as bucket from (select distinct h from r), (select unnest(range(33)) as depth)),
held as (select depth, bucket, sum(bytes) as bytes from (select r.bytes, depth, r.h >> (32 - depth) as bucket from r, (select unnest(range(33)) as depth)) group by all),
d as (select h, min(depth)::int as depth from e join held using (depth, bucket) where held.bytes <= {sharding.SHARD_BYTES} group by h)
select doc_id, bytes, depth, case when depth = 0 then '*' else substr(lpad(bin(h), 32, '0'), 1, depth) end as shard, bytes > {sharding.SHARD_BYTES} as oversize
from r join d using (h)
"""

_T = "replace(replace({}, '&', '&amp;'), '<', '&lt;')"
OP10 = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, r, '\\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(i, r))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<turn role="' || replace({_T.format("role")}, '"', '&quot;') || '">' || {_T.format("text")} || '</turn>' || chr(10)))::bigint as formatted_chars
from t group by conv_id
"""

_A = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_W = f"regexp_extract_all(translate(coalesce(text, ''), {_A}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7 = f"""
with d as (select row_number() over () as rid, doc_id, {_W} as ws from documents),
b as (select item_id::varchar as item, {_W} as ws from benchmark),
bw as (
  select item, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i, ws from b where len(ws) > 0),
bg as (select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') as g from bw),
dw as (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from bg) where len(ws) >= n),
m as (
  select rid, i, dw.n, item from (select rid, n, i, array_to_string(ws[i:i + n - 1], ' ') as g from dw) dw join bg on dw.n = bg.n and dw.g = bg.g),
hits as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from m) group by rid),
items as (select rid, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as s from (select distinct rid, item from m) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(s, sha256('')) as items_sha256, n_hit is not null as contaminated
from d left join hits using (rid) left join items using (rid)
"""

OP6 = f"""
with recursive d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A}), '[^\\x20\\x09-\\x0D]+') as ws from documents),
sh as (
  select distinct rid, array_to_string(ws[i:i + 4], ' ') as g
  from (select rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from d where len(ws) > 0)),
n as (select rid, count(*) as n from sh group by rid),
ab as (select a.rid as a, b.rid as b, count(*) as c from sh a join sh b on a.g = b.g and a.rid < b.rid group by all),
link as (select a, b from ab join n x on x.rid = a join n y on y.rid = b where 100 * c >= 75 * (x.n + y.n - c)),
step as (select a, b from link union all select b, a from link),
reach as (select rid, rid as r from d union select reach.rid, step.b from reach join step on step.a = reach.r),
comp as (select reach.rid, min(o.doc_id) as component_id from reach join d o on o.rid = reach.r group by reach.rid)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id is not distinct from component_id as kept
from d join comp using (rid) left join n using (rid)
"""

#: Allowed edits by the shorter line's length. Two edits leave the first 12 characters, the last 12, or the next 12 whole, the latter shifted by one at most.
_E = "case " + " ".join(f"when {{0}} >= {n} then {k}" for n, k in reversed(linededup.LADDER)) + " else 0 end"
_LCP = "(coalesce(list_position(list_transform(range(1, least(len(a), len(b)) - greatest({i}, {j}) + 1), lambda k: a[{i} + k] = b[{j} + k]), false), least(len(a) - {i}, len(b) - {j}) + 1) - 1)"
OP9 = f"""
with recursive l as (
  select doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos + 1] as line
  from (select doc_id, text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents)),
f as (
  select line, length(line) as n, doc_id as d, pos as p
  from (select *, row_number() over (partition by line order by doc_id, pos) as k from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')) where k = 1),
g as (select *, {_E.format("n")} as e from f where n >= {linededup.LADDER[0][0]}),
c as (
  select a.line as x, b.line as y, a.e from g a join g b on left(a.line, 12) = left(b.line, 12) and b.n - a.n between 0 and a.e and a.line <> b.line
  union
  select a.line, b.line, a.e from g a join g b on right(a.line, 12) = right(b.line, 12) and b.n - a.n between 0 and a.e and a.line <> b.line
  union
  select a.line, b.line, a.e from g a join (select *, unnest([11, 12, 13]) + 1 as s from g) b on substr(a.line, 13, 12) = substr(b.line, s, 12) and b.n - a.n between 0 and a.e and a.line <> b.line),
t as (select x, y, e, string_split(x, '') as a, string_split(y, '') as b from c),
r as (
  select x, y, e, a, b, {_LCP.format(i="0", j="0")} as i, {_LCP.format(i="0", j="0")} as j, 0 as d from t
  union
  select x, y, e, a, b, i + {_LCP.format(i="i", j="j")} as i, j + {_LCP.format(i="i", j="j")} as j, d
  from (select x, y, e, a, b, i + di as i, j + dj as j, d + 1 as d from r, (values (1, 1), (1, 0), (0, 1)) o(di, dj) where d < e and i + di <= len(a) and j + dj <= len(b))),
near as (select distinct x, y from r where i = len(a) and j = len(b)),
late as (
  select distinct case when (u.d, u.p) < (v.d, v.p) then y else x end as line
  from near join g u on u.line = x join g v on v.line = y),
k as (
  select l.doc_id, l.pos, l.line, f.line is null or (f.d = l.doc_id and f.p = l.pos and late.line is null) as stays
  from l left join f on f.line = l.line left join late on late.line = l.line)
select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (stays), '')) as text_sha256
from k group by doc_id
"""

# the CRC of the ten digits' bytes, a bit at a time
_CRC = "xor(list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda i: i::bigint), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"
OP12 = f"""
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as n,
    md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as k, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, {_CRC} % 6 as h from (select distinct conv_id from own)),
turns as (
  select c.conv_id, 0 as part, n, k, chars from c join own on own.conv_id = c.base where n <= h
  union all
  select c.conv_id, 1, n, k, chars from c join own on own.conv_id = c.conv_id where n > h),
path as (
  select conv_id, row_number() over w as depth, string_agg(k, '') over (w rows unbounded preceding) as node, chars
  from turns window w as (partition by conv_id order by part, n)),
rows as (
  select conv_id, depth, node, chars from path union all select conv_id, 0, '', 0 from c),
last as (select conv_id, max(depth) as depth from rows group by conv_id),
node as (
  select node, any_value(r.depth) as depth, min(r.conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved,
    sha256(coalesce(string_agg(r.conv_id::varchar, ',' order by r.conv_id) filter (l.depth = r.depth), '')) as ends_sha256
  from rows r join last l on l.conv_id = r.conv_id group by node),
kids as (select left(node, 32 * (depth - 1)::int) as node, count(*) as n from node where depth > 0 group by 1),
up as (select n.node, n.saved, kids.n is null as leaf, left(n.node, 32 * d) as above from (select *, unnest(range(depth + 1))::int as d from node) n left join kids on kids.node = n.node),
sums as (select above as node, sum(saved) as saved_tokens, count(*) filter (leaf) as n_leaves from up group by above)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n, 0) as n_children, sums.n_leaves::bigint as n_leaves, sums.saved_tokens::bigint as saved_tokens, n.ends_sha256
from node n join sums on sums.node = n.node left join kids on kids.node = n.node left join node p on n.depth > 0 and p.node = left(n.node, 32 * (n.depth - 1)::int)
"""

OP13 = r"""
with piece as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(p, '[^ \t]+') as ws
  from (select lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as p from documents)),
spot as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from piece),
grams as (select lang, ws[i:i + k - 1] as g from spot, (select unnest([1, 2, 3]) as k) where i + k - 1 <= len(ws)),
f as (select lang, g, count(*) as f from grams group by all),
n as (select lang, sum(f)::bigint as n from f where len(g) = 1 group by lang),
cand as (select lang, g, f as a from f where len(g) > 1 and f >= 10),
cut as (
  select c.lang, c.g, c.a, k, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a // (x.f::hugeint * y.f))::bigint as score
  from (select *, unnest(range(1, len(g))) as k from cand) c
  join f x on x.lang = c.lang and x.g = c.g[1:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:]),
low as (select * from cut qualify row_number() over (partition by lang, g order by score, k) = 1),
longer as (
  select lang, p, max(a) as a from (select lang, a, unnest([g[1:2], g[2:3]]) as p from cand where len(g) = 3) group by all),
kept as (
  select low.*, array_to_string(low.g, ' ') as phrase from low left join longer on longer.lang = low.lang and longer.p = low.g
  where longer.a is null or 100 * longer.a < 50 * low.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""

ORACLE: dict[str, str] = {"op1_quality_rules": OP1, "op4_sharding": OP4, "op6_near_duplicates": OP6, "op7_decontamination": OP7, "op9_line_dedup": OP9, "op10_chat_format": OP10, "op12_conversation_trie": OP12, "op13_collocations": OP13}
