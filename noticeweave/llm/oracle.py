"""SQL for the queries that SQL can express."""

from __future__ import annotations

from noticeweave.llm.licenses import TEMPLATES

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
with item as (select item_id, {_WORDS.format("text")} w from benchmark where text is not null and item_id is not null),
win as (
  select item_id, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') p, least(13, len(w)) m
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from item where len(w) > 0)
),
doc as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
sizes as (select distinct m from win),
occ as (
  select d.doc_id, d.i, d.m, win.item_id
  from (select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') p
        from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from doc, sizes)) d
  join win on win.p = d.p and win.m = d.m
),
hit as (select doc_id, count(distinct i + k) n_hit from (select distinct doc_id, i, m, unnest(range(0, m)) k from occ) group by 1),
who as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) s
        from (select distinct doc_id, item_id::varchar i from occ) group by 1)
select doc.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from doc left join hit using (doc_id) left join who using (doc_id)
"""

OP2 = """
with line as (
  select doc_id, text, i, l from (select doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 i,
                                         unnest(string_split(text, chr(10))) l from documents)
),
win as (
  select doc_id, text, i, p, row_number() over (partition by p order by doc_id, i) k from (
    select doc_id, text, i, [l, lead(l) over d, lead(l, 2) over d] p, lead(l, 2) over d x from line
    window d as (partition by doc_id order by i)) where x is not null
),
gone as (select distinct doc_id, i + unnest([0, 1, 2]) i from win where k > 1),
kept as (
  select line.doc_id, count(*) n_lines, count(gone.i) n_removed,
         count(*) filter (gone.i is not null and prev.i is null) n_runs,
         coalesce(string_agg(l, chr(10) order by line.i) filter (gone.i is null), '') t
  from line left join gone on gone.doc_id = line.doc_id and gone.i = line.i
            left join gone prev on prev.doc_id = line.doc_id and prev.i = line.i - 1
  group by 1
)
select doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed,
       coalesce(n_runs, 0)::bigint n_runs, sha256(coalesce(t, '')) text_sha256
from documents left join kept using (doc_id)
"""

_BIGRAMS = r"""(select list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from (
  select list_filter(string_split(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g')), ' '), lambda x: x <> '') w))"""


def _templates() -> str:
    return ", ".join("('{}', '{}')".format(n, t.replace("'", "''").replace("\n", " ")) for n, t in TEMPLATES.items())


OP8 = rf"""
with template(name, t) as (values {_templates()}),
tb as (select name, {_BIGRAMS.format("t")} b from template),
unit as (
  select doc_id, 0 r, 'text' unit, 0 i, coalesce(text, '') t from documents
  union all
  select doc_id, 1, 'paragraph', generate_subscripts(p, 1) - 1, unnest(p)
  from (select doc_id, regexp_split_to_array(text, '\n[ \t]*\n[ \t\n\x0b\f\r]*') p from documents) where len(p) > 1
  union all
  select doc_id, 2, 'line', generate_subscripts(p, 1) - 1, unnest(p)
  from (select doc_id, string_split(text, chr(10)) p from documents) where len(p) > 1
),
ub as (select doc_id, r, unit, i, b from (select doc_id, r, unit, i, {_BIGRAMS.format("t")} b from unit) where len(b) between 1 and 1000),
found as (
  select doc_id, r, unit, i, name, 2.0::double * len(list_intersect(ub.b, tb.b)) / (len(ub.b) + len(tb.b)) dice
  from ub, tb where len(ub.b) <= 1.5 * len(tb.b) and len(tb.b) <= 1.5 * len(ub.b)
),
per as (
  select doc_id, count(*) n, list_aggregate(list_sort(list_distinct(list(name))), 'string_agg', ',') names, max(dice) best,
         string_agg(name || ':' || unit || ':' || i, ',' order by r, i, name) places
  from found where dice >= 0.8 group by 1
)
select doc_id, coalesce(n, 0)::bigint n_matches, coalesce(names, '') licenses, best best_dice, coalesce(places, '') places
from documents left join per using (doc_id)
"""

_CONTROL = r"regexp_replace({0}, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"

OP3 = rf"""
with turn as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
one as (
  select *, {_CONTROL.format("t")} te, {_CONTROL.format("replace(replace(r, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} re from turn
)
select conv_id, count(*)::bigint n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
       coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
       sum(length('<|im_start|>' || re || chr(10) || te || '<|im_end|>' || chr(10)))::bigint formatted_chars
from one group by conv_id
"""

_TERM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
with doc as (select coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () d, {_TERM} w from documents),
tok as (select lang, source, d, unnest(w) t from doc),
kept as (select lang, t, count(*) c from tok group by all having count(distinct d) >= 3),
grp as (select distinct lang, source from doc),
cnt as (select lang, source, t, count(*) c from tok semi join kept using (lang, t) group by all),
v as (select lang, count(*) v, sum(c) n from kept group by all),
gn as (select grp.lang, grp.source, coalesce(sum(c), 0) n from grp left join cnt using (lang, source) group by all),
p as (
  select lang, gn.source, kept.t, coalesce(cnt.c, 0) c, 1 + (1000000000::hugeint * (coalesce(cnt.c, 0) + 1)) // (gn.n + v.v) p,
         1 + (1000000000::hugeint * (kept.c + 1)) // (v.n + v.v) q
  from gn join kept using (lang) join v using (lang) left join cnt on cnt.lang = gn.lang and cnt.source = gn.source and cnt.t = kept.t
),
two as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) val
  from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all
),
pairs as (select a.lang, a.source, b.source item, coalesce(val, 0) val from grp a join grp b on a.lang = b.lang and a.source <> b.source
          left join two on two.lang = a.lang and two.source = a.source and two.item = b.source),
terms as (select lang, source, t item, (p - q) * (p - q) // q val from p where c > 0 and p > q),
every as (select lang, source, 'pair' part, item, val from pairs union all select lang, source, 'term', item, val from terms)
select lang, source, part, item, val::bigint "value", k::int "rank"
from (select *, row_number() over (partition by lang, source, part order by val desc, item) k from every) where part = 'pair' or k <= 200
"""

# CRC-32 byte by byte: a table of 256 entries made by its rule, and bytes from their hexadecimal digits.
OP12 = """
with crc as (
  select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) tab
  from range(256) r(n)
),
doc as (
  select doc_id, coalesce(strlen(text), 0) + 8 size, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) crc
  from documents, crc
),
summed as (select *, sum(size) over (order by doc_id) - size before, sum(size) over () total from doc),
cut as (select *, (((2 * before + size) * 24) // (2 * total))::int shard from summed)
select doc_id, size::bigint size, crc::bigint text_crc32, 'bytes' law, shard, row_number() over (partition by shard order by doc_id) - 1 slot, null::int grown_shard
from cut
"""

OP13 = r"""
with recursive word as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
),
lab as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1),
bad as (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
         map {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': doc_id > min(doc_id) over (partition by t)} f
  from word left join lab using (doc_id)
),
m as (
  select part, list_sort(list_filter(map_keys(f), lambda k: f[k])) x, count(*) n, sum(good) good, sum(toxic) toxic from bad group by all
),
orders as (
  select '' o union all select o || l from orders, unnest(['A', 'B', 'C', 'D', 'E']) u(l) where length(o) < 5 and not contains(o, l)
),
step as (select o, i, o[i] l, string_split(left(o, i - 1), '') was from orders, range(1, 6) r(i) where length(o) = 5),
row as (
  select part, o, i, l,
         coalesce(sum(n) filter (not list_has_any(x, was) and not list_contains(x, l)), 0) kept,
         coalesce(sum(n) filter (not list_has_any(x, was) and list_contains(x, l)), 0) removed,
         coalesce(sum(n) filter (list_has_any(x, was) and list_contains(x, l)), 0) redundant,
         coalesce(sum(n) filter (x = [l]), 0) unique_fails,
         coalesce(sum(good) filter (not list_has_any(x, was) and list_contains(x, l)), 0) good_lost,
         coalesce(sum(toxic) filter (not list_has_any(x, was) and list_contains(x, l)), 0) toxic_lost
  from m, step group by all
)
select part, o filter_order, i::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
       good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, l))::bigint shapley
from row
"""

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2,
    "op3_chat": OP3,
    "op4_decontamination": OP4,
    "op8_licenses": OP8,
    "op11_divergence": OP11,
    "op12_sharding": OP12,
    "op13_filter_interactions": OP13,
}
