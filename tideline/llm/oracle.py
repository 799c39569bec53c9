"""SQL that gives the same rows as the registered corpus queries, written without their code's constants."""

from __future__ import annotations

OP7 = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
           from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""

OP9 = r"""
with d as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l
  from documents),
pos as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d),
win as (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from pos),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, a, b, c) > 1),
cov as (select doc_id, count(distinct i + k) as n from rep, range(3) as r(k) group by doc_id),
m as (
  select d.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, coalesce(cov.n, 0) as n_repeat_words
  from d left join cov using (doc_id)),
j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 100 * n_symbols > 30 * n_words or 100 * n_dup_lines > 30 * n_lines
            or 10 * word_chars < 20 * n_words or 10 * word_chars > 150 * n_words) as kept
from j
"""

OP5 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as g
        from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
rep as (select doc_id, i from win qualify min(doc_id) over (partition by g) < doc_id),
gone as (select distinct doc_id, i + k as i from rep, range(13) as r(k)),
word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d),
left_ as (select word.doc_id, string_agg(x, ' ' order by word.i) as kept, count(*) as n
          from word anti join gone on word.doc_id = gone.doc_id and word.i = gone.i group by 1)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join left_ using (doc_id)
"""

OP6 = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
line as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as x from d),
k as (select *, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line),
often as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.*, often.last is not null and often.last <> doc_id as gone from k left join often using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(x, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""

OP10 = r"""
with t(k, license, text) as (values
  (0, 'Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
  (1, 'BSD-3-Clause', 'Released under the BSD 3-Clause License.'),
  (2, 'CC-BY-4.0', 'Licensed under CC BY 4.0.'),
  (3, 'CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
  (4, 'CC-BY-SA-4.0', 'Licensed under CC BY-SA 4.0.'),
  (5, 'CC0-1.0', 'Released into the public domain under CC0 1.0.'),
  (6, 'GPL-2.0', 'This work is licensed under the GNU General Public License, version 2.'),
  (7, 'GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
  (8, 'LGPL-3.0', 'This work is licensed under the GNU Lesser General Public License, version 3.'),
  (9, 'MIT', 'Released under the MIT License.'),
  (10, 'MPL-2.0', 'This work is subject to the terms of the Mozilla Public License, version 2.0.'),
  (11, 'reserved', 'All rights reserved.')),
tw as (select k, license, regexp_extract_all(lower(text), '[0-9a-z]+') as w from t),
tp as (select k, a, count(*) as n from (select k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as a from tw) group by all),
ts as (select k, license, len(w) - 1 as size from tw),
d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
line as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as x from d),
lw as (select doc_id, i, list_transform(regexp_extract_all(x, '[0-9A-Za-z]+'), lambda y: lower(y)) as w from line),
lp as (select doc_id, i, size, a, count(*) as n
       from (select doc_id, i, len(w) - 1 as size, unnest(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) as a
             from lw where len(w) between 2 and 100) group by all),
share as (select doc_id, i, ts.k, ts.license, 200 * sum(least(lp.n, tp.n)) / (lp.size + ts.size) as share
          from lp join tp using (a) join ts on ts.k = tp.k group by doc_id, i, ts.k, ts.license, lp.size, ts.size),
best as (select * from share where share >= 80 qualify row_number() over (partition by doc_id, i order by share desc, k) = 1)
select d.doc_id, count(best.i) as n_found,
       coalesce(string_agg(best.i || ':' || license || ':' || floor(share)::int, ',' order by best.i), '') as found
from d left join best using (doc_id) group by d.doc_id
"""

OP3 = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
           group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from d union select reach.a, link.b from reach join link on reach.b = link.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(reach.b) as component_id
from d left join n using (doc_id) join reach on reach.a = d.doc_id group by 1, 2
"""


def _filled(children: str, parent: str, name: str) -> str:
    """Water filling of one level: rows of children with cap, w and the parent's budget."""
    return f"""
  (select *, case when full_ then cap else floor((budget - min(case when not full_ then before end) over (partition by {parent})) * w
          / max(case when not full_ then w_left end) over (partition by {parent}))::hugeint end as quota
   from (select *, cap * w_left <= w * (budget - before) as full_
         from (select *, coalesce(sum(cap) over o, 0)::hugeint as before,
                      (sum(w) over (partition by {parent}) - coalesce(sum(w) over o, 0))::hugeint as w_left
               from {children}
               window o as (partition by {parent} order by cap::double / w, {name} rows between unbounded preceding and 1 preceding))))"""


OP1 = rf"""
with d as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens,
         ['web', 'reference', 'forum', 'news'][coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint), 0) % 4 + 1] as domain
  from documents),
leaf as (select domain, lang, source, sum(n_tokens)::hugeint as size, 4 * sum(n_tokens)::hugeint as cap from d group by all),
l1 as (select domain, sum(cap)::hugeint as cap, case domain when 'web' then 3 when 'reference' then 4 when 'forum' then 1 else 2 end as w,
              (select floor(sum(size) * 90 / 100)::hugeint from leaf) as budget, 0 as root from leaf group by domain),
f1 as (select domain, quota from {_filled("l1", "root", "domain")}),
l2 as (select domain, lang, sum(cap)::hugeint as cap, case lang when 'en' then 6 when 'de' then 2 when 'fr' then 2 else 1 end as w,
              any_value(quota) as budget from leaf join f1 using (domain) group by domain, lang),
f2 as (select domain, lang, quota from {_filled("l2", "domain", "lang")}),
l3 as (select domain, lang, source, size, cap, 1 as w, quota as budget from leaf join f2 using (domain, lang)),
f3 as (select domain, lang, source, case when size > 0 then quota // size else 0 end as epochs,
              case when size > 0 then quota % size else 0 end as rest
       from {_filled("l3", "domain, lang", "source")}),
placed as (select d.*, epochs, rest, sum(n_tokens) over (partition by domain, lang, source
                    order by md5('1:' || epochs::varchar || ':' || doc_id::varchar), doc_id) as total
           from d join f3 using (domain, lang, source))
select doc_id, domain, lang, source, n_tokens,
       (epochs + case when rest > 0 and total <= rest then 1 else 0 end)::bigint as epochs
from placed
"""


OP11 = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
fails as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) as c,
         regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by t), false) as e
  from d left join l using (doc_id)),
f as (select part, good, toxic, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end,
                           case when d then 'D' else '' end, case when e then 'E' else '' end) as failed, count(*) as n
      from fails group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select p.x || q.x || r.x || s.x || t.x as filter_order from x p, x q, x r, x s, x t
           where p.x not in (q.x, r.x, s.x, t.x) and q.x not in (r.x, s.x, t.x) and r.x not in (s.x, t.x) and s.x <> t.x),
steps as (select filter_order, step::int as step, filter_order[step] as x, filter_order[1:step - 1] as before
          from orders, range(1, 6) as r(step)),
each as (select *, contains(failed, x) as hit,
                translate(failed, before, '') <> failed and before <> '' as gone from f, steps)
select part, filter_order, step,
       coalesce(sum(n) filter (where not hit and not gone), 0)::bigint as kept,
       coalesce(sum(n) filter (where hit and not gone), 0)::bigint as removed,
       coalesce(sum(n) filter (where hit and gone), 0)::bigint as redundant,
       coalesce(sum(n) filter (where failed = x), 0)::bigint as unique_fails,
       coalesce(sum(n * good) filter (where hit and not gone), 0)::bigint as good_lost,
       coalesce(sum(n * toxic) filter (where hit and not gone), 0)::bigint as toxic_lost,
       (sum(coalesce(sum(n) filter (where hit and not gone), 0)) over (partition by part, x))::bigint as shapley
from each group by part, filter_order, step, x
"""

OP12 = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first,
           md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as i
  from conversations where conv_id is not null),
crc as (
  -- unsigned CRC-32 of the decimal conv_id, bit by bit
  select conv_id, (list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
             lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end))) as c
  from (select distinct conv_id from turns)),
head as (select conv_id, xor(c, 4294967295) % 4 as h from crc),
rebuilt as (
  select head.conv_id, t.i, t.role, t.text from head join turns t on t.conv_id = head.conv_id - head.conv_id % 20 and t.i <= h
  union all
  select head.conv_id, 1000000 + t.i, t.role, t.text from head join turns t on t.conv_id = head.conv_id and t.i > h),
seq as (
  select conv_id, row_number() over (partition by conv_id order by i) as d, {'r': role, 't': text} as x from rebuilt),
path as (select conv_id, list(x order by d) as p from seq group by conv_id
         union all select conv_id, [] from head where conv_id not in (select conv_id from seq)),
member as (select conv_id, d, p[1:d] as k, d = len(p) as ends from (select conv_id, p, unnest(range(0, len(p) + 1)) as d from path)),
node as (
  select k, d, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256,
         case when d = 0 then 0 else len(regexp_extract_all(k[d].t, '[^\x20\x09-\x0D]+')) end as words
  from member group by k, d),
child as (select k[1:d - 1] as k, count(*) as n from node where d > 0 group by 1),
full_node as (select node.*, coalesce(child.n, 0) as n_children from node left join child on node.k = child.k),
up as (select n.k, n.d, n.n_children, (n_convs - 1) * words as saving, n.k[1:a] as above
       from (select *, unnest(range(0, d + 1)) as a from full_node) n),
tree as (select above, sum((n_children = 0)::int)::bigint as n_leaves, sum(saving)::bigint as saved_tokens from up group by above)
select f.conv_id, f.d as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, tree.n_leaves, tree.saved_tokens, f.ends_sha256
from full_node f join tree on tree.above = f.k left join node p on f.d > 0 and p.k = f.k[1:f.d - 1] and p.d = f.d - 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op3_ngram_join": OP3, "op5_substring_dedup": OP5, "op6_line_dedup": OP6,
            "op7_exact_dedup": OP7, "op9_quality_rules": OP9, "op10_license_scan": OP10, "op11_filter_audit": OP11,
            "op12_conversation_trie": OP12}
