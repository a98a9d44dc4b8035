"""DuckDB SQL of the operators that SQL can express, over whole tables."""

KEY = "('0x' || substr(md5({}), 1, 15))::bigint"

SHARD_SQL = f"""
with k as (select doc_id, strlen(coalesce(text, '')) n_bytes,
                  {KEY.format("coalesce(doc_id::varchar, '') || chr(1) || coalesce(text, '')")} key from documents),
d as (select unnest(range(0, 61)) depth),
b as (select depth, key >> (60 - depth) prefix, sum(n_bytes)::bigint shard_bytes, count(*) shard_docs, min(key) low, max(key) high
      from k, d group by all),
s as (select * from b where shard_bytes <= {{limit}} or low = high or depth = 60),
f as (select k.doc_id, k.n_bytes, s.*, row_number() over (partition by k.doc_id, k.key order by s.depth) r
      from k join s on key >> (60 - depth) = prefix)
select doc_id, n_bytes, right(lpad(bin(prefix), 60, '0'), depth) shard_id, depth::int depth, shard_bytes, shard_docs,
       shard_bytes > {{limit}} oversize from f where r = 1
"""

MIX_SQL = rf"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
                      {KEY.format("coalesce(doc_id::varchar, '') || chr(1) || coalesce(text, '')")} key from documents),
per as (select source, sum(size)::bigint source_size,
               ([3, 1, 2])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint weight from sized group by source),
fill as (select *, 2 * source_size cap, (2 * source_size)::double / weight fill from per),
level as (select *, (1.5 * (sum(source_size) over ())::double
                     - coalesce(sum(cap) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
                    / (sum(weight) over () - coalesce(sum(weight) over (order by fill, source nulls last
                                                      rows between unbounded preceding and 1 preceding), 0))::double level from fill),
best as (select level from level where level <= fill order by fill, source nulls last limit 1),
target as (select source, source_size, least(cap::double, coalesce((select level from best) * weight, cap::double)) target from level),
whole as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end whole from target),
docs as (select s.*, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size rest,
                sum(size) over (partition by s.source, key) own, row_number() over (partition by s.source, key order by doc_id) - 1 copy,
                sum(size) over (partition by s.source order by key range between unbounded preceding and current row) upto
         from sized s join whole w on s.source is not distinct from w.source)
select doc_id, size, source_size, target,
       (size * (whole + (upto <= rest or (upto - own <= rest and (2 * copy + 1) * size < 2 * (rest - (upto - own))))::int))::bigint taken from docs
"""

NEAR_SQL = r"""
with recursive
lowered as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) = 0 then []
                    when len(w) < 5 then [array_to_string(w, ' ')]
                    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from lowered),
sizes as (select doc_id, count(*) n from shingles group by all),
shared as (select x.doc_id a, y.doc_id b, count(*) i from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all),
linked as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * i >= 85 * (p.n + q.n - i)),
both_ways as (select a, b from linked union select b, a from linked),
reach as (select doc_id, doc_id r from lowered union select reach.doc_id, b from reach join both_ways on a = r)
select l.doc_id, coalesce(any_value(n), 0)::bigint n_shingles, min(r) component_id, l.doc_id = min(r) kept
from lowered l left join sizes using (doc_id) join reach on reach.doc_id = l.doc_id group by l.doc_id
"""

VECTOR_SQL = r"""
with recursive
good as (select vec_id, label, embedding::double[] v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) n from embeddings
         where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
ok as (select * from good where n > 0),
linked as (select a.vec_id a, b.vec_id b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
           where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
reach as (select vec_id, vec_id r from embeddings union select reach.vec_id, b from reach join linked on a = r),
c as (select vec_id, min(r) component_id from reach group by all),
l as (select a vec_id, count(*) n_links from linked group by all)
select c.vec_id, coalesce(n_links, 0)::bigint n_links, component_id, c.vec_id = component_id kept from c left join l using (vec_id)
"""

WARC_SQL = """
with p as (select page_id, url, coalesce(html, '') payload from pages),
d as (select page_id, url, strlen(payload)::bigint payload_bytes, sha256(payload) payload_digest from p),
f as (select *, first_value(page_id) over w first_page, row_number() over w r from d
      window w as (partition by payload_digest order by page_id nulls last, coalesce(url, '')))
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and r > 1 then 'revisit' else 'response' end record_type,
       case when payload_bytes >= 100 and r > 1 then first_page end refers_to from f
"""

LINE_SQL = r"""
with split as (select doc_id, text, string_split(text, chr(10)) l from documents where text <> ''),
every as (select doc_id, generate_subscripts(l, 1) - 1 line_no, trim(unnest(l), ' ') line from split),
seq as (select doc_id, line_no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) words,
               row_number() over (partition by doc_id order by line_no) pos
        from every where regexp_matches(line, '[^\x20\x09-\x0D]')),
same as (select p.doc_id d, p.pos p, q.doc_id e, q.pos q from seq p join seq q on p.line = q.line
         and (q.doc_id < p.doc_id or q.doc_id = p.doc_id and q.pos < p.pos)),
diagonal as (select *, p - row_number() over (partition by d, e, p - q order by p) island from same),
reach as (select d, p, max(p) over (partition by d, e, p - q, island) - p + 1 n from diagonal),
runs as (select d, p, max(n) n from reach group by all),
sized as (select d, p, n, sum(words) words, min(line_no) a, max(line_no) b
          from runs join seq on doc_id = d and pos between p and p + n - 1 group by all),
copies as (select * from sized where n >= 3 or words >= 50),
removed as (select distinct doc_id, line_no from every join copies on doc_id = d and line_no between a and b),
counts as (select doc_id, count(*) n_removed from removed group by all),
longest as (select d doc_id, max(n) longest_run from copies group by all),
lines as (select doc_id, i - 1 line_no, l[i] line from (select doc_id, l, unnest(range(1, len(l) + 1)) i from split)),
kept as (select doc_id, string_agg(line, chr(10) order by line_no) t from lines anti join removed using (doc_id, line_no) group by all)
select d.doc_id, case when d.text <> '' then len(string_split(d.text, chr(10))) else 0 end::int n_lines,
       coalesce(n_removed, 0)::int n_removed, coalesce(longest_run, 0)::int longest_run,
       length(case when d.text is null then null else coalesce(t, '') end)::int n_chars_kept,
       sha256(case when d.text is null then null else coalesce(t, '') end) text_sha256
from documents d left join counts using (doc_id) left join longest using (doc_id) left join kept using (doc_id)
"""
