"""Registered queries of mixing, manifest and spelling variants, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing, shared
from .merkle import manifest
from .variants import spelling_variants


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(shared.read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(shared.read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(shared.read(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """crc32 of a text in SQL: a fold over its UTF-8 bytes, eight bits each."""
    data = f"list_transform(range(1, strlen({text}) + 1), lambda k: ('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::bigint)"
    step = "list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    return f"xor(list_reduce({data}, lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint)"


OP11_SQL = rf"""
with d as (select doc_id, coalesce('=' || source, '') as sk, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as h from documents),
s0 as (select sk, sum(size)::bigint as source_size, count(*) as n_rows, row_number() over (order by sk = '', sk) - 1 as rk from d group by sk),
s1 as (select *, (case rk % 3 when 0 then 3 when 1 then 1 else 2 end)::double as w from s0),
s2 as (select *, 2 * source_size / w as r from s1),
s3 as (select *, (1.5::double * sum(source_size) over () - (sum(2 * source_size) over (order by r, sk) - 2 * source_size)) / (sum(w) over () - (sum(w) over (order by r, sk) - w)) as lam from s2),
s4 as (select sk, source_size, n_rows, case when w * l > 2 * source_size then 2.0::double * source_size else w * l end as target
  from s3, (select lam as l from s3 where lam * w <= 2 * source_size order by r, sk limit 1)),
b as (select floor(1.5::double * sum(source_size) / {mixing.BLOCK} + 0.5)::bigint as blocks, sum(target) as t, count(*) as n from s4),
q1 as (select sk, row_number() over (order by target / (2 * k + 1) desc, sk) as nth from (select sk, target, unnest(range((floor(target / t * blocks) + ceil(target / t * n / 2) + 3)::bigint)) as k from s4, b where target > 0)),
s5 as (select s4.*, (select count(*) from q1, b where q1.sk = s4.sk and nth <= blocks) as blocks,
  greatest(1, ceil(source_size / {mixing.SHARD_WORDS}), ceil(n_rows / {mixing.SHARD_ROWS}))::bigint as n_shards from s4),
e as (select d.*, h % n_shards as shard from d join s5 using (sk)),
h0 as (select sk, shard, sum(size)::bigint as words, any_value(blocks) as blocks from e join s5 using (sk) group by sk, shard),
h1 as (select *, sum(words) over (partition by sk) as t, count(*) over (partition by sk) as n from h0),
q2 as (select sk, shard, blocks, row_number() over (partition by sk order by words / (2 * k + 1) desc, shard) as nth
  from (select *, unnest(range((floor(words / t * blocks) + ceil(words / t * n / 2) + 3)::bigint)) as k from h1 where words > 0)),
h2 as (select sk, shard, greatest(1, ceil(words / {mixing.BLOCK}))::bigint as n, (select count(*) from q2 where q2.sk = h0.sk and q2.shard = h0.shard and nth <= blocks) as won from h0),
h3 as (select sk, shard, n, least(won, 2 * n) // n as each, least(won, 2 * n) % n as extra, ('0x' || substr(md5('mix:' || sk || ':' || shard), 1, 15))::bigint % n as phase from h2),
p as (select e.*, coalesce(sum(size) over (partition by sk, shard order by h, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as a from e),
f as (select p.*, n, each, extra, phase, a // {mixing.BLOCK} as ka, (a + size) // {mixing.BLOCK} as kz from p join h3 using (sk, shard)),
g as (select *, each * size + ((kz * extra + phase) // n - (ka * extra + phase) // n) * {mixing.BLOCK}
   + (((kz + 1) * extra + phase) // n - (kz * extra + phase) // n) * ((a + size) % {mixing.BLOCK}) - (((ka + 1) * extra + phase) // n - (ka * extra + phase) // n) * (a % {mixing.BLOCK}) as got from f),
m as (select g.*, source_size, target, floor(target + 0.5) - sum(got) over (partition by sk) as short from g join s5 using (sk)),
o as (select *, case when short > 0 then 2 * size - got else got end as room from m),
z as (select *, coalesce(sum(room) over (partition by sk order by shard, h, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as before from o)
select doc_id, size, source_size, target, (got + sign(short) * greatest(0, least(room, abs(short) - before)))::bigint as taken from z
"""

_FRAMED = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FRAMED.format("{0}") + ")"
#: Trees by lk; t has every node, s each node's siblings in its run, u the leaves on their way up.
OP12_SQL = f"""
with recursive d as (select doc_id, coalesce('=' || lang, '') as lk, {_LEAF.format("text")} as leaf, case when {_crc32("coalesce(doc_id::varchar, '')")} % 3 = 0 then {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as low from documents),
l as (select *, coalesce(low, leaf) as given, row_number() over (order by lk, doc_id nulls first, leaf) as id, row_number() over (partition by lk order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lk) as n from d),
t as (select lk, 0 as lvl, pos, n, leaf as digest from l union all select lk, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from t where n > 1 group by lk, lvl, n, pos // 8),
r as (select lk, digest as subroot, row_number() over (order by lk) - 1 as pos, count(*) over () as n from t where n = 1),
t2 as (select 0 as lvl, pos, n, subroot as digest from r union all select lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from t2 where n > 1 group by lvl, n, pos // 8),
s as (select lk, lvl, pos, n, coalesce(string_agg(digest, '') over (partition by lk, lvl, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as lhs,
  coalesce(string_agg(digest, '') over (partition by lk, lvl, pos // 8 order by pos rows between 1 following and unbounded following), '') as rhs from t where n > 1),
s2 as (select lvl, pos, n, coalesce(string_agg(digest, '') over (partition by lvl, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as lhs,
  coalesce(string_agg(digest, '') over (partition by lvl, pos // 8 order by pos rows between 1 following and unbounded following), '') as rhs from t2 where n > 1),
u as (select id, lk, 0 as lvl, pos, n, ''::varchar as proof, given as f from l
  union all select u.id, u.lk, u.lvl + 1, u.pos // 8, (u.n + 7) // 8, u.proof || s.lhs || s.rhs, sha256(s.lhs || u.f || s.rhs) from u join s on s.lk = u.lk and s.lvl = u.lvl and s.pos = u.pos),
v as (select u.id, u.lk, 0 as lvl, r.pos, r.n, u.proof, u.f from u join r on r.lk = u.lk where u.n = 1
  union all select v.id, v.lk, v.lvl + 1, v.pos // 8, (v.n + 7) // 8, v.proof || s2.lhs || s2.rhs, sha256(s2.lhs || v.f || s2.rhs) from v join s2 on s2.lvl = v.lvl and s2.pos = v.pos)
select l.doc_id, l.leaf, r.subroot, t2.digest as root, sha256(v.proof) as proof_sha256, v.f as folded_root, v.f = t2.digest as verified
from l join v on v.id = l.id and v.n = 1 join r on r.lk = l.lk join t2 on t2.n = 1
"""

OP13_SQL = rf"""
with recursive w0 as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as w from documents),
w1 as (select w, count(*) as m, coalesce(doc_id::varchar, '') || ':' || w as x from w0 group by doc_id, w),
w2 as (select w, m, {_crc32("x")} as h from w1),
w3 as (select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, m from w2),
v as (select word, sum(m)::bigint as n from w3 where length(word) >= 5 group by word having sum(m) >= 3),
x as (select word, n, word as k, -1 as i from v union all select word, n, substr(word, 1, i) || substr(word, i + 2), i from v, unnest(range(length(word))) as t(i)),
e as (select distinct a.word, b.word as other, b.n from x a join x b on a.k = b.k and a.word <> b.word and (a.i = b.i or a.i = -1 or b.i = -1)),
b as (select word, count(*) as n_near, max(n) as top, arg_min(other, (-n, other)) as other from e group by word),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when top >= 2 * v.n then other end as form, case when top >= 2 * v.n then top end as form_n from v left join b using (word)),
r as (select word, form, word as root, form as nxt from f union all select r.word, r.form, r.nxt, f.form from r join f on f.word = r.nxt)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from f join r on r.word = f.word and r.nxt is null
"""

QUERIES = {"op11_source_mix": op11_source_mix, "op12_merkle_manifest": op12_merkle_manifest, "op13_spelling_variants": op13_spelling_variants}
SQL = {"op11_source_mix": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_spelling_variants": OP13_SQL}
