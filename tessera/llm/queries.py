"""Queries of the operators in this subpackage, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, collocations, decontaminate, filter_audit, jaccard_join, kneser_ney, lm_score, packing, pii, quality_rules, suffix_dedup, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


RULES_SQL = r"""
with w as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
win as (
  select r, i, array_to_string(list_slice(words, i, i + 7), ' ') as g
  from (select r, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
hit as (select r, unnest(range(i, i + 8)) as p
  from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1),
rep as (select r, count(distinct p) as n_repeat_words from hit group by r),
m as (
  select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(lines) as n_lines,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join rep using (r)),
b as (
  select *, cast(n_words < 20 as bigint) + 2 * cast(100 * n_repeat_words > 30 * n_words as bigint)
    + 4 * cast(10 * n_symbols > n_words as bigint) + 8 * cast(2 * n_dup_lines > n_lines as bigint)
    + 16 * cast(word_chars < 2 * n_words as bigint) + 32 * cast(word_chars > 15 * n_words as bigint) as fail_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits, (fail_bits & 3) <> 0 as base_failed,
  fail_bits = 0 as kept, 2 as policy
from b
"""


@query("op1_quality_rules", RULES_SQL)
def op1(spark: SparkSession, path: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(table(spark, path, "documents")), 2)


DECONTAMINATE_SQL = r"""
with lower_docs as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
items as (
  select cast(item_id as varchar) as item, words, least(13, len(words)) as size
  from (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark where text is not null)
  where len(words) > 0),
win as (
  select distinct item, size, array_to_string(list_slice(words, i, i + size - 1), ' ') as g
  from (select item, words, size, unnest(range(1, len(words) - size + 2)) as i from items)),
doc_win as (
  select r, size, i, array_to_string(list_slice(words, i, i + size - 1), ' ') as g
  from (select r, words, size, unnest(range(1, len(words) - size + 2)) as i
        from lower_docs, (select distinct size from win) where len(words) >= size)),
hit as (select r, d.size, i, item from doc_win d join win using (size, g)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from hit) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from lower_docs left join covered using (r) left join named using (r)
"""


@query("op3_decontaminate", DECONTAMINATE_SQL)
def op3(spark: SparkSession, path: str) -> DataFrame:
    found = decontaminate.scan(table(spark, path, "documents"), table(spark, path, "benchmark"))
    return decontaminate.report(found).withColumnRenamed("key", "doc_id")


@query("op5_pii_deobfuscation")
def op5(spark: SparkSession, path: str) -> DataFrame:
    return pii.find(table(spark, path, "documents")).withColumnRenamed("key", "doc_id")


@query("op10_byte_bpe")
def op10(spark: SparkSession, path: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.round_trip(table(spark, path, "documents"), ranks, public_tokenizers.PATTERN).withColumnRenamed("key", "doc_id")


JACCARD_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(words, i, i + 4), ' ') as g
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a as doc_id, b as r from both_ways union select reach.doc_id, both_ways.b from reach join both_ways on reach.r = both_ways.a),
comp as (select doc_id, least(doc_id, min(r)) as component_id from reach group by doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, w.doc_id) as component_id
from w left join n using (doc_id) left join comp using (doc_id)
"""


@query("op9_jaccard_join", JACCARD_SQL)
def op9(spark: SparkSession, path: str) -> DataFrame:
    return jaccard_join.join(table(spark, path, "documents")).withColumnRenamed("doc", "doc_id")


WARC_SQL = """
with p as (select row_number() over () as r, page_id, encode(coalesce(html, '')) as payload from pages),
d as (select r, page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha1(payload) as payload_digest from p),
g as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as newest from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> newest then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> newest then newest end as refers_to
from g
"""


@query("op4_warc_index", WARC_SQL)
def op4(spark: SparkSession, path: str) -> DataFrame:
    return warc.round_trip(table(spark, path, "pages"))


@query("op8_token_files")
def op8(spark: SparkSession, path: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, path, "documents"), public_tokenizers.path("word_bpe_49k.json"))


LM_SQL = r"""
with w as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    doc_id in (select doc_id from labels where quality = 1 and toxic = 0) as target
  from documents),
t as (select r, target, unnest(words) as w, unnest(range(len(words))) as i from w),
c1 as (select w, count(*) as b, count(*) filter (target) as t from t group by w),
n as (select count(*) as nb, count(*) filter (target) as nt from t),
v as (select * from c1 where b >= 2),
size as (select count(*) as size, coalesce(sum(b), 0) as b, coalesce(sum(t), 0) as t from v),
uni as (
  select w, b as cb, t as ct, (b + 1) / (nb + size + 1) as pb, (t + 1) / (nt + size + 1) as pt
  from (select w, b, t from v union all select null, nb - b, nt - t from size, n), n, (select size from size)),
tok as (select r, i, t.w, v.w as k, target from t left join v on t.w = v.w),
p as (select a.r, a.i, a.target, b.k as l, a.k as w from tok a join tok b on a.r = b.r and a.i = b.i + 1 where a.k is not null and b.k is not null),
c2 as (select l, w, count(*) as b, count(*) filter (target) as t from p group by l, w having count(*) >= 2),
pairs as (
  select c2.l, c2.w, -ln(0.6 * (c2.b / x.cb) + 0.4 * y.pb) as lb, -ln(0.6 * (case when x.ct > 0 then c2.t / x.ct else y.pt end) + 0.4 * y.pt) as lt
  from c2 join uni x on x.w = c2.l join uni y on y.w = c2.w),
loss as (
  select tok.r, coalesce(pairs.lb, -ln(0.4 * uni.pb)) as lb, coalesce(pairs.lt, -ln(0.4 * uni.pt)) as lt
  from tok left join p on p.r = tok.r and p.i = tok.i left join pairs on pairs.l = p.l and pairs.w = p.w
  join uni on uni.w is not distinct from tok.k),
m as (select r, avg(lb) as lb, avg(lt) as lt from loss group by r)
select doc_id, cast(len(words) as bigint) as n_tokens, round(lt, 6) as target_loss, round(lb, 6) as background_loss, round(lt - lb, 6) as score
from w left join m using (r)
"""


@query("op2_cross_entropy_difference", LM_SQL)
def op2(spark: SparkSession, path: str) -> DataFrame:
    trusted = table(spark, path, "labels").filter("quality = 1 and toxic = 0")
    rows = lm_score.cross_entropy_difference(table(spark, path, "documents"), trusted)
    return rows.select(F.col("key").alias("doc_id"), "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


@query("op7_kneser_ney")
def op7(spark: SparkSession, path: str) -> DataFrame:
    trusted = table(spark, path, "labels").filter("quality = 1 and toxic = 0")
    rows = kneser_ney.classify(table(spark, path, "documents"), trusted)
    return rows.select(F.col("key").alias("doc_id"), "lang", "n_tokens", *[F.round(c, 4).alias(c) for c in ("perplexity", "threshold")], "kept")


REPEATS_SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, doc_id, i, md5(substr(h, 2 * i - 1, 200)) as m from (select r, doc_id, h, unnest(range(1, len(h) // 2 - 98)) as i from d where len(h) >= 200)),
later as (select r, i from (select r, i, row_number() over (partition by m order by doc_id, i) as k from w) where k > 1),
runs as (
  select r, min(i) as a, max(i) + 99 as b
  from (select r, i, sum(gap) over (partition by r order by i) as g
        from (select r, i, cast(coalesce(i > lag(i) over (partition by r order by i) + 100, true) as int) as gap from later))
  group by r, g),
pieces as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as p from runs),
kept as (
  select d.r, string_agg(substr(h, 2 * p + 1, 2 * (a - 1 - p)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as k, sum(b - a + 1) as n, count(*) as s
  from pieces join d using (r) group by d.r)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(s, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from d left join kept using (r)
"""


@query("op6_suffix_dedup", REPEATS_SQL)
def op6(spark: SparkSession, path: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, path, "documents"))
    return rows.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


FILTERS_SQL = r"""
with l as (select doc_id, max(cast(quality = 1 as int)) as q, max(cast(toxic = 1 as int)) as x from labels group by doc_id),
t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    coalesce(doc_id > min(doc_id) over (partition by coalesce(text, '')), false) as copy
  from documents),
m as (
  select part, coalesce(q, 0) as q, coalesce(x, 0) as x,
    cast(len(w) < 100 as int) + 2 * cast(100 * len(list_distinct(w)) < 80 * len(w) as int)
    + 4 * cast(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) as int)
    + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(copy as int) as m
  from t left join l using (doc_id)),
c as (select part, m, count(*) as n, sum(q) as good, sum(x) as toxic from m group by part, m),
f as (select f, 1 << (ascii(f) - 65) as b from (select unnest(string_split('ABCDE', '')) as f)),
o as (
  select unnest([a.f || b.f || c.f || d.f || e.f]) as filter_order
  from f a join f b on b.f <> a.f join f c on c.f not in (a.f, b.f) join f d on d.f not in (a.f, b.f, c.f) join f e on e.f not in (a.f, b.f, c.f, d.f)),
s as (
  select filter_order, step, 1 << (ascii(filter_order[step]) - 65) as bit,
    list_sum(list_transform(string_split(left(filter_order, step - 1), ''), lambda z: case when z = '' then 0 else 1 << (ascii(z) - 65) end)) as before
  from (select filter_order, unnest(range(1, 6)) as step from o)),
r as (select part, m, n, good, toxic, filter_order, step, bit, coalesce(before, 0)::bigint as before from c, s)
select part, filter_order, cast(step as int) as step,
  cast(coalesce(sum(n) filter (m & (before | bit) = 0), 0) as bigint) as kept,
  cast(coalesce(sum(n) filter (m & bit <> 0 and m & before = 0), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter (m & bit <> 0 and m & before <> 0), 0) as bigint) as redundant,
  cast(coalesce(sum(n) filter (m = bit), 0) as bigint) as unique_fails,
  cast(coalesce(sum(good) filter (m & bit <> 0 and m & before = 0), 0) as bigint) as good_lost,
  cast(coalesce(sum(toxic) filter (m & bit <> 0 and m & before = 0), 0) as bigint) as toxic_lost,
  cast(coalesce(sum(n * (120 // nullif(bit_count(m), 0))) filter (m & bit <> 0), 0) as bigint) as shapley
from r group by part, filter_order, step
"""


@query("op12_filter_audit", FILTERS_SQL)
def op12(spark: SparkSession, path: str) -> DataFrame:
    return filter_audit.audit_table(spark, f"{path}/documents.parquet", table(spark, path, "labels"))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, path: str) -> DataFrame:
    import public_tokenizers

    rows = packing.pack_documents(table(spark, path, "documents"), public_tokenizers.path("word_bpe_49k.json")).rows
    return rows.select(F.col("doc").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc32").alias("ids_crc32"), "sequence_id", "offset")


PHRASES_SQL = r"""
with p as (
  select row_number() over () as r, lang, piece
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
t as (select lang, r, unnest(w) as w, unnest(range(len(w))) as i from (select lang, r, regexp_extract_all(piece, '[^\x20\x09]+') as w from p)),
g as (select lang, w as w1, lead(w) over s as w2, lead(w, 2) over s as w3 from t window s as (partition by r order by i)),
n as (select lang, count(*) as n from g group by lang),
f1 as (select lang, w1, count(*) as f from g group by all),
f2 as (select lang, w1, w2, count(*) as f from g where w2 is not null group by all having f >= 10),
f3 as (select lang, w1, w2, w3, count(*) as f from g where w3 is not null group by all having f >= 10),
around as (
  select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all),
two as (
  select x.lang, x.w1 || ' ' || x.w2 as phrase, x.f as a, l.f as l, r.f as r, 1000000::hugeint * x.f * x.f // (l.f::hugeint * r.f) as score
  from f2 x left join around y on y.lang = x.lang and y.w1 = x.w1 and y.w2 = x.w2
  join f1 l on l.lang = x.lang and l.w1 = x.w1 join f1 r on r.lang = x.lang and r.w1 = x.w2
  where y.f is null or 100 * y.f < 50 * x.f),
cuts as (
  select x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3 as phrase, x.f as a, l1.f as l1, r1.f as r1, l2.f as l2, r2.f as r2,
    1000000::hugeint * x.f * x.f // (l1.f::hugeint * r1.f) as s1, 1000000::hugeint * x.f * x.f // (l2.f::hugeint * r2.f) as s2
  from f3 x join f1 l1 on l1.lang = x.lang and l1.w1 = x.w1 join f2 r1 on r1.lang = x.lang and r1.w1 = x.w2 and r1.w2 = x.w3
  join f2 l2 on l2.lang = x.lang and l2.w1 = x.w1 and l2.w2 = x.w2 join f1 r2 on r2.lang = x.lang and r2.w1 = x.w3),
found as (
  select * from two union all
  select lang, phrase, a, case when s2 < s1 then l2 else l1 end, case when s2 < s1 then r2 else r1 end, least(s1, s2) from cuts)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from found) join n using (lang)
where rank <= 2000
"""


@query("op11_collocations", PHRASES_SQL)
def op11(spark: SparkSession, path: str) -> DataFrame:
    return collocations.collocations(table(spark, path, "documents"))
