"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from .urlfilter import HOST_RULES, PATH_RULES, PATTERN_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Base 32 of a hexadecimal SHA-1: 32 groups of five bits, each within two digits.
_BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (((
  (strpos('0123456789abcdef', substr(h, cast(1 + (5 * i) // 4 as bigint), 1)) - 1) * 16
  + strpos('0123456789abcdef', substr(h || '0', cast(2 + (5 * i) // 4 as bigint), 1)) - 1) >> cast(3 - (5 * i) % 4 as bigint)) & 31) as bigint), 1)
  for i in range(32)], '')"""

_WARC = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
m as (select h, max(page_id) as head from p group by 1)
select page_id, payload_bytes, {_BASE32} as payload_digest,
  case when head = page_id then 'response' else 'revisit' end as record_type,
  case when head <> page_id then head end as refers_to
from p join m using (h)
"""

_COMPONENTS = """
lab(id, l) as (select {id}, {id} from {nodes} union select k.b, lab.l from lab join link k on k.a = lab.id where lab.l < k.b),
comp(id, component_id) as (select id, min(l) from lab group by 1)
"""

_JACCARD = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)
  union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 2),
n as (select doc_id, count(*) as n from s group by 1),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
one as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
link(a, b) as (select a, b from one union all select b, a from one),
{_COMPONENTS.format(id='doc_id', nodes='documents')}
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id from documents d left join n on n.doc_id = d.doc_id join comp on comp.id = d.doc_id
"""

_EMBDEDUP = f"""
with recursive v as (
  select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding::double[], lambda z: not isfinite(z))) = 0 and len(list_filter(embedding::double[], lambda z: z <> 0)) > 0),
link(a, b) as materialized (
  select a.vec_id, b.vec_id from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98),
k as (select a, count(*) as n from link group by 1),
{_COMPONENTS.format(id='vec_id', nodes='embeddings')}
select e.vec_id, coalesce(k.n, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e left join k on k.a = e.vec_id join comp on comp.id = e.vec_id
"""

_SUBSTRING = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w from documents),
win as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from w where len(w) >= 20)),
f as (select k, min((doc_id, s)) as f from win group by 1 having count(*) > 1),
cov as (select distinct doc_id, unnest(range(s, s + 20)) as p from win join f using (k) where (doc_id, s) <> f.f),
word as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from w),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from word anti join cov using (doc_id, p) group by 1)
select w.doc_id, len(w.w) as n_words, len(w.w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join kept using (doc_id)
"""


def _url_filter() -> str:
    rules = ", ".join(f"('{r.text}', '{r.text.partition('/')[0]}', '/{r.text.partition('/')[2]}', '{r.verdict}')" for r in HOST_RULES)
    words = "|".join(r.text for r in PATH_RULES)
    patterns = ", ".join("('" + r.regex.replace("\\Z", "\\z") + f"', '{r.verdict}')" for r in PATTERN_RULES)
    return f"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
rules(rule, h, p, verdict) as (values {rules}),
hit as (
  select page_id, max_by(rule, len(rule)) as rule, max_by(verdict, len(rule)) as verdict
  from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1),
pattern(regex, verdict) as (values {patterns}),
found as (select page_id, min(verdict) as verdict from u join pattern on regexp_matches(host || path, regex) group by 1)
select u.page_id, host, path, hit.rule,
  coalesce(hit.verdict, case when found.verdict = 'allow' then 'allow' when found.verdict = 'block' then 'block' when regexp_matches(host || path, '/([^/]*[^a-z0-9/])?({words})([^a-z0-9]|$)') then 'block' else 'allow' end) as verdict
from u left join hit using (page_id) left join found using (page_id)
"""


def _fields(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')" for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: CRC-32 of a decimal number, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), [cast(ascii(z) as bigint) for z in string_split(cast(doc_id as varchar), '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))))"""

_MERKLE = f"""
with recursive d as (
  select doc_id, coalesce('=' || lang, '') as g, {_fields('n_chars')} as leaf, case when {_CRC32} % 7 = 0 then {_fields('(n_chars + 1)')} end as other from documents),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos from d),
node(g, lvl, pos, h) as (
  select g, 0, pos, leaf from p
  union all
  select g, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over (partition by g) as k from node) where k > 1 group by g, lvl, pos // 2),
tops as (select g, arg_max(h, lvl) as subroot, max(lvl) as m from node group by 1),
t as (select *, row_number() over (order by g) - 1 as pos from tops),
over_(lvl, pos, h) as (
  select 0, pos, subroot from t
  union all
  select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over () as k from over_) where k > 1 group by lvl, pos // 2),
r as (select arg_max(h, lvl) as root, max(lvl) as m from over_),
places as (
  select p.g, p.pos, lvl, p.pos >> lvl as spot, false as above from p join t on t.g = p.g, unnest(range(t.m)) u(lvl)
  union all select p.g, p.pos, lvl, t.pos >> lvl, true from p join t on t.g = p.g, r, unnest(range(r.m)) u(lvl)),
steps as (
  select x.g, x.pos, row_number() over (partition by x.g, x.pos order by above, x.lvl) as j, spot % 2 = 1 as last, coalesce(a.h, b.h, '') as h
  from places x left join node a on not above and a.g = x.g and a.lvl = x.lvl and a.pos = xor(spot, 1) left join over_ b on above and b.lvl = x.lvl and b.pos = xor(spot, 1)),
fold(g, pos, j, h) as (
  select g, pos, cast(1 as bigint), coalesce(other, leaf) from p
  union all
  select f.g, f.pos, f.j + 1, sha256(case when s.last then s.h || f.h else f.h || s.h end) from fold f join steps s on s.g = f.g and s.pos = f.pos and s.j = f.j),
ends as (select g, pos, arg_max(h, j) as folded_root from fold group by 1, 2),
proofs as (select g, pos, string_agg(h, '' order by j) as x from steps group by 1, 2)
select doc_id, leaf, subroot, root, sha256(coalesce(x, '')) as proof_sha256, folded_root, folded_root = root as verified
from p join t on t.g = p.g join ends e on e.g = p.g and e.pos = p.pos left join proofs q on q.g = p.g and q.pos = p.pos, r
"""


_NEGATIVES = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding::double[], lambda x: floor(256 * x)) as x
  from embeddings where label is not null and embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding::double[], lambda z: not isfinite(z))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.x, b.x) as bigint) as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select *, row_number() over (partition by anchor_id order by score desc, id) as r from s where same),
n as (
  select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
  where p.r <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

ORACLES = {"op2_warc": _WARC, "op7_jaccard": _JACCARD, "op8_embdedup": _EMBDEDUP, "op9_substring": _SUBSTRING, "op10_url_filter": _url_filter(), "op11_negatives": _NEGATIVES, "op12_merkle": _MERKLE}
