"""DuckDB SQL for the results of the operators that SQL can express."""

MIXING = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')),0)::bigint as size, (('0x'||substr(md5(doc_id::varchar),1,12))::bigint::double + 0.5)/281474976710656.0::double as u from documents),
s as (select source, sum(size)::bigint source_size, count(*) n_docs from d group by source),
w as (select *, [1,2,3][((row_number() over (order by source nulls last)-1)%3)+1]::bigint weight from s),
k as (select *, sum(source_size) over () total,
  coalesce(sum(source_size*3) over (order by source_size::double/weight, source nulls last rows between unbounded preceding and 1 preceding),0) stopped,
  sum(weight) over (order by source_size::double/weight, source nulls last rows between current row and unbounded following) sharing from w),
l as (select *, (total::double-stopped::double)/sharing::double as lvl from k),
m as (select *, first_value(lvl) over (order by case when lvl*weight <= source_size*3 then 0 else 1 end, source_size::double/weight, source nulls last) best from l),
t as (select source, source_size, n_docs, least((source_size*3)::double, best*weight) target from m),
p as (select *, case when source_size>0 then least(floor(target/source_size),3) else 0 end::bigint certain from t),
q as (select d.doc_id, d.size, d.u, p.*, target - certain*source_size as lft from d join p on d.source is not distinct from p.source),
b as (select source, size, count(*) n, any_value(lft) lft from q where lft>0 and size>0 group by source, size),
c as (select source, size, lft - coalesce(sum(size*n) over (partition by source order by size desc rows between unbounded preceding and 1 preceding),0)::bigint as rest,
  (sum(size::hugeint*size*n) over (partition by source order by size))::hugeint::double as squares from b),
f as (select source, max(size) cut, arg_max(rest/squares, size) k from c where rest*size < squares group by source),
h as (select q.*, case when size=0 or lft<=0 then 0.0::double when cut is null or size>cut then 1.0::double else k*size end as chance from q left join f on q.source is not distinct from f.source),
r as (select *, case when chance<=0 then 1.0 when chance>=1 then 0.0 else o/(1+o) end as rk from (select *, u/(1-u)*(1-chance)/chance o from h)),
z as (select *, sum(size) over (partition by source order by rk, doc_id rows between unbounded preceding and current row) upto from r where chance>0),
y as (select h.doc_id, h.size, h.source_size, h.target, h.chance, h.certain + case when z.upto - z.size/2.0 <= z.lft then 1 else 0 end as copies from h left join z using (doc_id))
select doc_id, size, source_size, target, chance, (copies*size)::bigint as taken, copies::bigint as copies from y
"""

#: Words one edit apart: those of a length that are alike without the letter at one place, or a word that is
#: another without one letter. DuckDB has no crc32, so it is worked out byte by byte.
SPELLING = r"""
with recursive tab as materialized (select list(c order by i) as t from (select i, list_reduce([i,0,0,0,0,0,0,0,0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256))::bigint as i))),
r as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents) group by all),
x as (select *, hex(encode(concat(coalesce(doc_id::varchar, ''), ':', run))) as hx from r),
h as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::bigint, 2))::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as crc from x, tab),
v as materialized (select w, sum(n)::bigint as n from (select case when crc % 199 = 0 then substr(run, 1, (crc % length(run))::bigint) || substr(run, (crc % length(run) + 2)::bigint) else run end as w, n from h) group by w having sum(n) >= 5 and length(w) >= 6),
c as materialized (select w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) as d from (select w, n, unnest(range(1, length(w) + 1)) as i from v)),
e as (select distinct a.w, b.w as o, b.n as m from c a join c b on a.i = b.i and a.d = b.d and a.w <> b.w union select c.w, v.w, v.n from c join v on v.w = c.d union select v.w, c.w, c.n from c join v on v.w = c.d),
b as (select w, count(*) as n_near, min((-m, o)) as best from e group by w),
f as materialized (select v.w as word, v.n, coalesce(n_near, 0)::bigint as n_near, case when -best[1] >= 5 * v.n then best[2] end as form, case when -best[1] >= 5 * v.n then -best[1] end::bigint as form_n from v left join b on v.w = b.w),
g as (select word, form as root, 1 as k from f where form is not null union all select g.word, f.form, k + 1 from g join f on f.word = g.root where f.form is not null)
select f.word, f.form, coalesce(l.root, f.word) as root, f.n, f.n_near, f.form_n from f left join (select word, arg_max(root, k) as root from g group by word) l on l.word = f.word
"""

#: Every window as a text of its own, and every word that a repeated one covers.
REPEATS = r"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
q as materialized (select r, i, array_to_string(w[i:i + 34], ' ') as s from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
c as (select r, i from q where s in (select s from q group by s having count(*) > 1)),
x as (select distinct r, i + k as j from c, (select unnest(range(35)) as k)),
k as (select r, string_agg(word, ' ' order by j) as t, count(*) as n from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from d) anti join x using (r, j) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join k using (r)
"""
