"""SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from . import host_rules, merkle, mixing

# each paragraph as the digests of its pieces; p: those of a text
_PARAGRAPHS = "list_transform(regexp_extract_all({t}, '" + merkle.PARAGRAPH + "'), lambda x: {'l': list_transform(regexp_extract_all(hex(x), '" + merkle.PIECE + "'), lambda y: md5(y)), 'last': suffix(x, chr(10) || chr(10))})"
_ENDS = "list_filter(range(1, len({p}) + 1), lambda i: {p}[i].last or i = len({p}))"
_DIGESTS = "list_transform({p}, lambda x: md5('paragraph' || coalesce(array_to_string(x.l, ''), '')))"
_SECTIONS = "list_transform(range(1, len({e}) + 1), lambda k: md5('section' || array_to_string({d}[(case when k = 1 then 1 else {e}[k - 1] + 1 end):{e}[k]], '')))"
_WRITTEN = "list_transform(range(1, len({p}) + 1), lambda i: '/' || substr({d}[i], 1, 8) || ':' || array_to_string(list_transform({p}[i].l, lambda y: substr(y, 1, 8)), ''))"
_PRINT = (
    "md5('root' || coalesce(array_to_string({s}, ''), '')) || coalesce(array_to_string(list_transform(range(1, len({s}) + 1), "
    "lambda k: ' ' || substr({s}[k], 1, 8) || array_to_string({w}[(case when k = 1 then 1 else {e}[k - 1] + 1 end):{e}[k]], '')), ''), '')"
)
_LEAVES = "list_distinct(flatten(list_transform({p}, lambda x: list_transform(x.l, lambda y: substr(y, 1, 8)))))"
_NEAR = "case when len({a}) + len({b}) = 0 then 1.0::double else 2.0::double * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end"


def _fill(pattern: str, **values: str) -> str:
    for name, value in values.items():
        pattern = pattern.replace("{" + name + "}", value)
    return pattern


FINGERPRINTS = f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
pairs as (select doc_id, text, coalesce(lead(text) over w, first_value(text) over w) as after from texts window w as (order by doc_id nulls first, md5(text))),
edits as (select *, substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2) as edited from pairs),
cut as (select doc_id, length(text) as n_chars, sha256(edited) as edited_sha256, {_fill(_PARAGRAPHS, t="text")} as p1, {_fill(_PARAGRAPHS, t="edited")} as p2, {_fill(_PARAGRAPHS, t="after")} as p3 from edits),
digests as (select *, {_fill(_ENDS, p="p1")} as e1, {_fill(_DIGESTS, p="p1")} as d1, {_fill(_ENDS, p="p2")} as e2, {_fill(_DIGESTS, p="p2")} as d2 from cut),
trees as (select *, {_fill(_SECTIONS, e="e1", d="d1")} as s1, {_fill(_WRITTEN, p="p1", d="d1")} as w1, {_fill(_SECTIONS, e="e2", d="d2")} as s2, {_fill(_WRITTEN, p="p2", d="d2")} as w2,
  {_fill(_LEAVES, p="p1")} as a, {_fill(_LEAVES, p="p2")} as b, {_fill(_LEAVES, p="p3")} as c from digests)
select doc_id, n_chars, edited_sha256, {_fill(_PRINT, s="s1", w="w1", e="e1")} as fingerprint, {_fill(_PRINT, s="s2", w="w2", e="e2")} as edited_fingerprint,
  {_fill(_NEAR, a="a", b="b")} as near_edited, {_fill(_NEAR, a="a", b="c")} as near_next
from trees"""

MIX = f"""
with sizes as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORDS}')) as size, md5('1:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as draw from documents),
sources as (select source, count(*) as rows, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3)::int + 1]::double as weight from sizes group by source),
caps as (select *, {mixing.SHARE}::double * sum(source_size) over () as mix, {mixing.MOST}.0::double * source_size as cap from sources),
levels as (select *, cap / weight <= (mix - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as capped from caps),
targets as (select *, case when capped then cap else least(cap, weight * (mix - sum(case when capped then cap else 0 end) over ()) / sum(case when not capped then weight end) over ()) end as target from levels),
quotients as (select source, target / (2 * k + 1) as q, k, floor(mix / {mixing.BLOCK} + 0.5) as seats from (select *, unnest(range((1.1 * target / {mixing.BLOCK})::bigint + 20)) as k from targets) where target > 0),
won as (select source, count(*) as blocks from (select * from quotients qualify row_number() over (order by q desc, source nulls last, k) <= seats) group by source),
quotas as (select t.source, t.source_size, t.target, coalesce(w.blocks, 0) as blocks, greatest(1, least(ceil(t.rows * {mixing.SHARDS} / sum(t.rows) over ()), ceil(t.rows / {mixing.LEAST_SHARD_ROWS})))::bigint as shards from targets t left join won w on t.source is not distinct from w.source),
dealt as (select s.*, q.source_size, q.target, q.blocks, (('0x' || substr(draw, 1, 8))::bigint % q.shards)::int as shard from sizes s join quotas q on s.source is not distinct from q.source),
parts as (select source, shard, sum(size)::bigint as shard_size, any_value(source_size) as source_size, any_value(blocks) as blocks from dealt group by source, shard),
sums as (select *, sum(shard_size) over (partition by source order by shard)::bigint as upto from parts),
split as (select source, shard, shard_size, case when source_size > 0 then (floor(blocks * (upto / source_size) + 0.5) - floor(blocks * ((upto - shard_size) / source_size) + 0.5))::bigint else 0 end as shard_blocks from sums),
lines as (select d.*, p.shard_size, p.shard_blocks, least(p.shard_blocks * {mixing.BLOCK}, {mixing.MOST} * p.shard_size) as goal,
  coalesce(sum(size) over (partition by d.source, d.shard order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from dealt d join split p on d.source is not distinct from p.source and d.shard = p.shard)
select doc_id, size, source_size, round(target, 6) as target, (case when shard_size > 0 then goal // shard_size * size + greatest(0, least(size, goal % shard_size - before)) else 0 end)::bigint as taken, source, shard, shard_blocks
from lines"""

_MEASURED = """
texts as (select doc_id, source as host, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
runs as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as run from texts, lateral (select unnest(range(1, len(w) - 3)) as i)),
often as (select doc_id, i from runs qualify count(*) over (partition by doc_id, run) > 1),
covered as (select doc_id, count(distinct i + k) as n from often, (select unnest(range(5)) as k) group by 1),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from texts),
doubled as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
measured as (
  select t.doc_id, host, len(w) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(d.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from texts t left join doubled d on t.doc_id = d.doc_id left join covered c on t.doc_id = c.doc_id)"""


def _prior(x: str) -> str:
    """Mean and strength of one rule's prior over the table ``counts``."""
    most, least = host_rules.MOST_STRENGTH, host_rules.LEAST_STRENGTH
    return f"""{x}_sums as (select sum({x}) / sum(n) as mean, sum(n) as docs, count(*) as hosts, sum(n * n)::double as squared, sum({x} * {x} / n) as spread from counts),
{x}_share as (select mean, mean * (1 - mean) as noise, docs - squared / docs - (hosts - 1) as room, spread - docs * mean * mean - mean * (1 - mean) * (hosts - 1) as excess from {x}_sums),
{x}_prior as (select mean, case when noise * room > 1e-9 and excess / (noise * room) > 1 / (1 + {most}) then greatest({least}, (1 - excess / (noise * room)) / (excess / (noise * room))) else {most} end as strength from {x}_share)"""


def _host_rules() -> str:
    rules, base = host_rules.RULES, " or ".join(host_rules.BASE.values())
    names = ["any_failed", *(f"soft_{r}" for r in rules)]
    tests = [f"({base} or {' or '.join(f'{x.score} > {x.hard}' for x in rules.values())}) as any_failed", *(f"({x.score} > {x.soft}) as soft_{r}" for r, x in rules.items())]
    rate = lambda x: f"(({x} + (select mean * strength from {x}_prior)) / (n + (select strength from {x}_prior)))"
    spread = lambda x: f"sqrt(rate_{x} * (1 - rate_{x}) / (n + (select strength from {x}_prior) + 1))"
    limit = lambda r, x: f"{x.hard} - ({x.hard} - {x.soft}) * case when {spread('soft_' + r)} > 0 then 1 / (1 + exp(-{host_rules.SLOPE} * (rate_soft_{r} - (select mean from soft_{r}_prior)) / {spread('soft_' + r)})) else 0.5 end as limit_{r}"
    return f"""
with {_MEASURED},
tested as (select *, ({base}) as base_failed, {", ".join(tests)} from measured),
counts as (select host, count(*) as n, {", ".join(f"sum({x}::int) as {x}" for x in names)} from tested group by 1),
{", ".join(map(_prior, names))},
rates as (select *, {", ".join(f"{rate(x)} as rate_{x}" for x in names)} from counts),
verdicts as (select *, rate_any_failed - {host_rules.SURE} * {spread("any_failed")} > 0.5 as host_dropped, {", ".join(limit(r, x) for r, x in rules.items())} from rates)
select t.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_dropped and not ({" or ".join(f"{x.score} > limit_{r}" for r, x in rules.items())}) as kept,
  t.host, round(rate_any_failed, 6) as host_rate, {", ".join(f"round(limit_{r}, 6) as limit_{r}" for r in rules)}
from tested t join verdicts v on t.host is not distinct from v.host"""


HOST_RULES = _host_rules()

NEAR = """
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common c join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c.n >= 85 * (p.n + q.n - c.n)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select x, y from both_ways union select r.x, b.y from reach r join both_ways b on r.y = b.x),
roots as (select x, min(y) as root from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) as component_id, coalesce(root, d.doc_id) >= d.doc_id as kept
from documents d left join sizes s on d.doc_id = s.doc_id left join roots r on d.doc_id = r.x"""

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED = f"""
with texts as (select row_number() over () as row, doc_id, {_TERMS} as t from documents),
counted as (select row, doc_id, len(t)::bigint as n, t from texts where len(t) > 0),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as terms from counted),
asked as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
postings as (select row, doc_id, any_value(n) as n, term, count(*)::bigint as tf from (select row, doc_id, n, unnest(t) as term from counted) where term in (select term from asked) group by row, doc_id, term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from postings group by term), corpus),
impacts as (select row, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)) as impact from postings, corpus),
scores as (select item_id, row, doc_id, sum(w * impact)::bigint as score from impacts join weights using (term) join asked using (term) group by item_id, row, doc_id),
ranked as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls first))::int as rank, doc_id, score from scores where score > 0)
select * from ranked where rank <= 50"""

# the checksum of a short ASCII string, bit by bit
_CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({s}, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

TRIE = f"""
with turns as (select conv_id as c, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as t from conversations where conv_id is not null),
own as (select c, list(t order by turn nulls first, t.role, md5(len(t.role) || ':' || t.role || t.text)) as s from turns group by c),
heads as (select o.c, o.s, d.s as donor, ({_fill(_CRC32, s="o.c::varchar")} % 4)::int as h from own o left join own d on d.c = o.c - o.c % 20),
built as (select c, list_concat(coalesce(donor[1:h], []), s[h + 1:]) as s from heads),
members as (select c, d, s[1:d] as p, d = len(s) as ends from (select c, s, unnest(range(len(s) + 1)) as d from built)),
nodes as (
  select p, any_value(d) as depth, min(c) as conv_id, count(*) as n_convs, len(regexp_extract_all(coalesce(any_value(p)[-1].text, ''), '[^\\x20\\x09-\\x0D]+')) as words,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as ends_sha256
  from members group by p),
families as (select p[1:depth - 1] as p, count(*) as n_children from nodes where depth > 0 group by 1),
full_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join families f on n.p = f.p),
above as (select p[1:k] as p, case when n_children = 0 then 1 else 0 end as leaf, (n_convs - 1) * words as saved from (select *, unnest(range(depth + 1)) as k from full_nodes)),
sums as (select p, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from above group by p)
select n.conv_id, n.depth::bigint as depth, u.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, n.n_children::bigint as n_children, n_leaves, saved_tokens, n.ends_sha256
from full_nodes n join sums s on n.p = s.p left join nodes u on n.depth > 0 and u.p = n.p[1:n.depth - 1]"""
