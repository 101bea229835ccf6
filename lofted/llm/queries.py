"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, divergence, langid, license_scan, ngram_join, packing, prefix_trie, secret_scan, suffix_dedup, token_io, url_filter, warc
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(url_filter.host(F.col("url")).rlike(url_filter.LISTED_HOSTS)).select("url")
    return url_filter.judge(pages, url_filter.rule_table(spark), listed.unionByName(url_filter.listed_table(spark)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "record_id", "refers_to_id")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents")).drop("k", "comp")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are files `<source>/<thousands of doc_id>/<doc_id>.txt`."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_token_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.round_trip(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.query(spark, sf_dir)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.query(spark, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_secret_scan, op3_warc, op4_ngram_join, op5_ann, op6_packing, op7_license_scan, op8_decontaminate, op9_langid, op10_token_io, op11_suffix_dedup, op12_prefix_trie, op13_divergence, pipeline)}


def _op1_sql() -> str:
    fits = " union all ".join(f"select '{v}' as verdict, '{h}' as rule_host, '{p}' as rule_path" for v, h, p in url_filter.RULES)
    return f"""
with parts as (
  select page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules as ({fits}),
urls as (select distinct host, path from parts),
best as (
  select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(verdict, length(rule_host || rule_path)) as verdict
  from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path),
cut as (
  select page_id, host, path, regexp_replace(rtrim(regexp_replace(host, ':(80|443)$', ''), '.'), '^www\\.', '') as name,
    list_sort(list_filter(string_split(regexp_extract(url, '^(?s:.*?)://[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^{url_filter.TRACKING}'))) as kept
  from parts where contains(url, '://')),
canonical as (select page_id, host, name || rtrim(path, '/') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url from cut),
listed as (select distinct url from canonical where regexp_matches(host, '{url_filter.LISTED_HOSTS}') union select unnest({[url_filter.canonical(u) for u in url_filter.LISTED]!r}))
select p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, case when l.url is not null then 'block' end, 'allow') as verdict
from parts p left join best b on p.host = b.host and p.path = b.path left join canonical c on c.page_id = p.page_id left join listed l on l.url = c.url"""


_OP3_SQL = """
with keyed as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
tops as (select hex, max(page_id) as top from keyed group by hex),
digests as (
  select hex, top, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast('0x' || substr(hex, 1 + (i // 4) * 5, 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1)), 'string_agg', '') as digest
  from tops)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, digest as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from keyed join digests using (hex)"""

_OP5_SQL = """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and embedding is not null),
own as (select * from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
scored as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.e, b.e) as score
  from own a join own b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20"""


def _op7_sql() -> str:
    tables = ((0, license_scan.WHOLES, license_scan.TEXT_FLOOR), (1, license_scan.LINES, license_scan.LINE_FLOOR))
    words, names, other = [], [], {}
    for kind, templates, floor in tables:
        rows, other[kind] = license_scan.weights(templates, floor)
        words += [f"({kind},'{w}',{t},{i:.17e},{x:.17e})" for w, t, i, x in rows]
        names += [f"({kind}, {t}, '{name}')" for t, (name, _) in enumerate(templates)]
    notice = license_scan.NOTICE
    return f"""
with files as (select row_number() over () as fid, doc_id, source || '/' || cast(doc_id // 1000 as varchar) || '/' || doc_id || '.txt' as path, text from documents),
w(kind, word, t, idf, x) as (values {",".join(words)}),
idf as (select distinct kind, word, idf from w),
names(kind, t, name) as (values {", ".join(names)}),
lines as (select fid, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from files where regexp_matches(text, '{notice}')),
notices as (
  select fid, n, regexp_extract_all(lower(line), '[a-z0-9]+') as tokens from lines where regexp_matches(line, '{notice}')
  union all select fid, 0, regexp_extract_all(lower(text), '[a-z0-9]+') from files where regexp_matches(text, '{notice}')),
terms as (select fid, n, case when n = 0 then 0 else 1 end as kind, word, count(*) as tf from (select fid, n, unnest(tokens) as word from notices) group by all),
vectors as (select fid, n, kind, word, tf * coalesce(idf, case when kind = 0 then {other[0]:.17e} else {other[1]:.17e} end) as v from terms left join idf using (kind, word)),
norms as (select fid, n, sqrt(sum(v * v)) as norm from vectors group by all),
dots as (select fid, n, kind, t, round(sum(v * x) / any_value(norm), 6) as score from vectors join w using (kind, word) join norms using (fid, n) group by all),
named as (select * from dots join names using (kind, t)),
best as (select fid, n, max(score) as score, arg_max(name, score * 1000000 - t * 0.001) as name from named group by all),
second as (select d.fid, d.n, max(d.score) as score from named d join best b on b.fid = d.fid and b.n = d.n and b.name <> d.name group by all),
good as (
  select b.fid, b.n, b.score, b.name from best b left join second s using (fid, n)
  where case when b.n = 0 then b.score >= {license_scan.TEXT_SCORE} and b.score - coalesce(s.score, 0) >= {license_scan.TEXT_MARGIN} else b.score >= {license_scan.MIN_SCORE} end),
tops as (select g.fid, g.score, arg_max(d.name, -d.t) as name, any_value(g.n) as n, -min(d.t) as minus from good g join named d on d.fid = g.fid and d.n = g.n and d.score = g.score and d.name = g.name group by g.fid, g.n, g.score),
own as (select fid, coalesce(max(score) filter (where n = 0), max(score) filter (where n > 0)) as own_score,
    coalesce(max(name) filter (where n = 0), arg_max(name, score * 1000000 + minus * 0.001) filter (where n > 0)) as name from tops group by fid),
covered as (select fid, coalesce(sum(len(tokens)) filter (where n > 0), 0) as c, max(n = 0) as whole from good join notices using (fid, n) group by fid),
sized as (select f.*, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as size, coalesce(whole, false) as whole, coalesce(c, 0) as c, own.name, own.own_score as s from files f left join own using (fid) left join covered using (fid)),
judged as (
  select fid, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, name is not null and (whole or c >= {license_scan.FILE_SHARE} * size) as is_file,
    name as own_license, s as own_score from sized),
dirs as (select dir, arg_min(own_license, (-own_score, own_license)) as license, max(own_score) as score from judged where is_file group by dir),
above as (select j.fid, d.dir as license_dir, d.license, d.score, row_number() over (partition by j.fid order by length(d.dir) desc) as r
  from judged j join dirs d on j.dir = d.dir or starts_with(j.dir, d.dir || '/') or d.dir = '' where j.own_license is null)
select doc_id, path, coalesce(own_license, a.license) as license, coalesce(own_score, a.score) as score,
  case when own_license is not null then 'own' when a.license is not null then 'inherited' end as basis, a.license_dir
from judged j left join above a on j.fid = a.fid and a.r = 1"""


def _op4_sql() -> str:
    return r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) end as g from d),
n as (select doc_id, len(g) as n, list_sort(g) as g from s),
sets as (select md5(array_to_string(g, chr(10))) as h, any_value(n) as n, any_value(g) as g, min(doc_id) as id from n where n > 0 group by 1),
post as (select id, n, unnest(g) as t from sets),
pairs as (select a.id as x, b.id as y, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from post a join post b on a.t = b.t and a.id < b.id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
e as (select x, y from pairs where 100 * c >= 80 * (na + nb - c) union all select y, x from pairs where 100 * c >= 80 * (na + nb - c)),
reach(v, m) as (select id, id from sets union select e.y, r.m from reach r join e on e.x = r.v and r.m < e.y),
comp as (select v, min(m) as m from reach group by v),
rep as (select n.doc_id, n.n, sets.id from n left join sets on md5(array_to_string(n.g, chr(10))) = sets.h and n.n > 0)
select doc_id, n as n_shingles, coalesce(m, doc_id) as component_id from rep left join comp on rep.id = comp.v"""


_OP11_SQL = """
with d as (select row_number() over (order by doc_id, file_row_number) as r, doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from (select *, row_number() over () as file_row_number from documents)),
windows as (select r, i, substr(x, 2 * i + 1, 200) as s from (select r, x, unnest(range(n - 99)) as i from d where n >= 100)),
later as (select r, i from windows qualify row_number() over (partition by s order by r, i) > 1),
opened as (select r, i, case when i - lag(i) over (partition by r order by i) <= 100 then 0 else 1 end as new from later),
numbered as (select r, i, sum(new) over (partition by r order by i) as k from opened),
spans as (select r, k, min(i) as a, max(i) + 100 as b from numbered group by all),
bounds as (select r, a, b from spans union all select r, n, n from d),
pieces as (select r, a, coalesce(lag(b) over (partition by r order by a, b), 0) as c from bounds),
kept as (select r, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' order by a, c) as x, sum(a - c) as n, count(*) - 1 as k from pieces join (select r, x from d) using (r) group by r)
select doc_id, cast(d.n as bigint) as n_bytes, cast(d.n - kept.n as bigint) as n_removed, cast(k as bigint) as n_spans, sha256(unhex(kept.x)) as kept_sha256
from d join kept using (r)"""


#: CRC-32 of a decimal number, byte by byte and bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({x}::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295)"

_OP12_SQL = f"""
with own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 5 as base, {_CRC32.format(x="conv_id")} % 9 as h from (select distinct conv_id from own)),
parts as (
  select c.conv_id, 0 as part, o.pos, o.role, o.text from convs c join own o on o.conv_id = c.base and o.pos <= c.h
  union all select c.conv_id, 1, o.pos, o.role, o.text from convs c join own o using (conv_id) where o.pos > c.h),
turns as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, sha256(octet_length(encode(role)) || ':' || role || text) as turn, octet_length(encode(text)) as bytes from parts),
prefixes as (
  select conv_id, depth, sha256(string_agg(turn, '') over (partition by conv_id order by depth)) as key, bytes from turns
  union all select conv_id, 0, '', 0 from convs),
lens as (select conv_id, max(depth) as len from prefixes group by conv_id),
nodes as (select depth, key, min(conv_id) as owner, count(*) as n_convs, max(bytes) as bytes from prefixes group by all),
links as (select distinct p.depth, p.key, up.key as parent_key from prefixes p join prefixes up on up.conv_id = p.conv_id and up.depth = p.depth - 1),
kids as (select depth - 1 as depth, parent_key as key, count(*) as n from links group by all),
weighed as (select n.*, (n.n_convs - 1) * n.bytes as saved, case when kids.n is null then 1 else 0 end as leaf from nodes n left join kids using (depth, key)),
totals as (
  select p.depth, p.key, sum(w.saved) as saved, sum(w.leaf) as leaves
  from prefixes p join prefixes low on low.conv_id = p.conv_id and low.depth >= p.depth join weighed w on w.depth = low.depth and w.key = low.key and w.owner = p.conv_id group by all),
ended as (select depth, key, string_agg(p.conv_id::varchar, ',' order by p.conv_id) as ids from prefixes p join lens l on l.conv_id = p.conv_id and l.len = p.depth group by all)
select n.owner as conv_id, n.depth, up.owner as parent_conv_id, n.n_convs, coalesce(kids.n, 0) as n_children, cast(t.leaves as bigint) as n_leaves, cast(t.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join totals t using (depth, key) left join kids using (depth, key) left join links l using (depth, key) left join nodes up on up.depth = n.depth - 1 and up.key = l.parent_key left join ended e on e.depth = n.depth and e.key = n.key"""

_OP13_SQL = r"""
with docs as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as n from words group by all having count(distinct i) >= 3),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as n from words group by all),
dense as (select lang, source, term, coalesce(c.n, 0)::hugeint as n from groups join kept using (lang) left join counts c using (lang, source, term)),
p as (select lang, source, term, n, (1 + 1000000000 * (n + 1) // (sum(n) over (partition by lang, source) + count(*) over (partition by lang, source)))::hugeint as p from dense),
ql as (select lang, term, (1 + 1000000000 * (n::hugeint + 1) // (sum(n) over (partition by lang) + count(*) over (partition by lang)))::hugeint as q from kept),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p join ql using (lang, term) where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200"""

ORACLE_SQL: dict[str, str] = {"op11_suffix_dedup": _OP11_SQL, "op12_prefix_trie": _OP12_SQL, "op13_divergence": _OP13_SQL, "op1_url_filter": _op1_sql(), "op3_warc": _OP3_SQL, "op4_ngram_join": _op4_sql(), "op7_license_scan": _op7_sql()}
