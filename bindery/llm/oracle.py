"""SQL of the queries that SQL can express on whole tables in reasonable time."""

# w: weights by source order; the sources at their cap are a prefix in the order of size by weight
OP1 = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('17|' || coalesce(doc_id::varchar, '')) as k
  from documents),
totals as (
  select source, sum(size)::bigint as s,
         ((row_number() over (order by source is null, source) - 1) % 3 + 1)::double as w
  from sized group by source),
ranked as (
  select *, sum(s) over ()::double as t, sum(w) over () as every,
         coalesce(sum(3 * s) over (order by s / w, source rows between unbounded preceding and 1 preceding), 0)::double as spent,
         coalesce(sum(w) over (order by s / w, source rows between unbounded preceding and 1 preceding), 0) as used
  from totals),
level as (
  select spent, every - used as free, t from ranked
  where not (3 * s * (every - used) < w * (t - spent)) order by spent limit 1),
targets as (
  select r.source, r.s, case when 3 * r.s * l.free < r.w * (l.t - l.spent) then (3 * r.s)::double
                             else r.w * (l.t - l.spent) / l.free end as target
  from ranked r, level l),
placed as (
  select d.doc_id, d.size, x.s, x.target, floor(x.target)::bigint as quota,
         coalesce(sum(d.size) over (partition by d.source order by k, d.doc_id, d.size
                                    rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized d join targets x on d.source is not distinct from x.source)
select doc_id, size, s as source_size, target,
       (case when s > 0 then quota // s else 0 end * size
        + greatest(0, least(size, quota - case when s > 0 then quota // s else 0 end * s - before)))::bigint as taken
from placed
"""

# strings of 50 bytes as hex digits, taken from blocks of 512 starts
OP4 = r"""
with bytes as (
  select row_number() over () as r, doc_id, coalesce(hex(encode(text)), '') as h from documents),
blocks as (
  select r, doc_id, off, substr(h, 2 * off + 1, 2 * 561) as h
  from (select r, doc_id, h, unnest(range(0, length(h) // 2 - 49, 512)) as off from bytes)),
starts as (
  select r, doc_id, off, h, unnest(range(0, least(512, length(h) // 2 - 49))) as p from blocks),
strings as (
  select r, doc_id, off + p as p, substr(h, 2 * p + 1, 100) as s from starts),
least as (
  select s, min(doc_id) as first from strings group by s),
again as (
  select r, p from strings join least using (s) where first < doc_id),
marked as (
  select r, p, case when p <= lag(p) over (partition by r order by p) + 50 then 0 else 1 end as new from again),
numbered as (
  select r, p, sum(new) over (partition by r order by p) as k from marked),
spans as (
  select r, k, min(p) as b, max(p) + 50 as e from numbered group by r, k),
gaps as (
  select r, b, e, coalesce(lag(e) over (partition by r order by b), 0) as was from spans),
cut as (
  select g.r, sum(e - b)::bigint as n_removed, count(*)::bigint as n_spans, max(e) as last,
         string_agg(substr(h, 2 * was + 1, 2 * (b - was)), '' order by b) as front
  from gaps g join bytes using (r) group by g.r)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from bytes left join cut using (r)
"""

# every pair of a label
OP7 = r"""
with recursive rows as (
  select row_number() over () as r, vec_id, label, [c::double for c in embedding] as x,
         label is not null and embedding is not null and len(embedding) > 0
         and len([c for c in embedding if c is null or not isfinite(c)]) = 0 as whole
  from embeddings),
vectors as (
  select r, vec_id, label, len(x) as dim, list_transform(x, lambda c: c / sqrt(list_dot_product(x, x))) as u
  from rows where whole and list_dot_product(x, x) > 0),
links as (
  select a.r as a, b.r as b, b.vec_id
  from vectors a join vectors b on a.label = b.label and a.dim = b.dim and a.r <> b.r
  where list_dot_product(a.u, b.u) >= 0.93),
reach(a, b) as (
  select a, b from links
  union
  select reach.a, links.b from reach join links on reach.b = links.a),
found as (
  select a as r, min(vec_id) as least from reach join rows on reach.b = rows.r group by a),
counted as (
  select a as r, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(least(least, vec_id), vec_id)::bigint as component_id,
       coalesce(coalesce(least(least, vec_id), vec_id) = vec_id, false) as kept
from rows left join found using (r) left join counted using (r)
"""

# keys of the method: hosts with a blocked label
OP10 = r"""
with parts as (
  select page_id,
         case when url like '%://%' then regexp_replace(url, '^.*?://', '', 's') end as rest
  from pages),
split as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') as path
  from parts),
rules(rule, rhost, rpath, v) as (
  values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits as (
  select s.page_id, s.host, s.path, r.rule, r.v,
         row_number() over (partition by s.page_id order by length(r.rule) desc nulls last) as n
  from split s left join rules r
    on (s.host = r.rhost or s.host like '%.' || r.rhost) and starts_with(s.path, r.rpath)),
listed as (
  select *, len(list_intersect(string_split(host, '.'),
    ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])) > 0 as listed_host
  from fits where n = 1)
select page_id, host, path, rule, coalesce(v, case when listed_host then 'block' else 'allow' end) as verdict, listed_host
from listed
"""

# inner products of whole numbers are exact in double precision
OP13 = r"""
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256 * c::double) for c in embedding] as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
pairs as (
  select a.r, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
         list_dot_product(a.x, b.x)::bigint as score, b.label, b.r as other
  from v a join v b on a.vec_id % 50 = 0 and a.r <> b.r and len(a.x) = len(b.x)),
positives as (
  select r, anchor_id, vec_id as positive_id, score as positive_score, other from pairs where same
  qualify row_number() over (partition by r order by score desc, vec_id, other) <= 5),
fits as (
  select p.anchor_id, p.positive_id, n.vec_id as negative_id, p.positive_score, n.score as negative_score,
         row_number() over (partition by p.r, p.other order by n.score desc, n.vec_id, n.label) as rank
  from positives p join pairs n
    on p.r = n.r and not n.same and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from fits where rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1,
        "op4_suffix_dedup": OP4,
        "op7_vector_near_dedup": OP7,
        "op10_url_filter": OP10,
        "op13_hard_negatives": OP13,
    }
