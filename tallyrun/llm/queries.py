"""The registered queries of this subpackage, one per operator, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_format, decontaminate, divergence, language_id, line_dedup, minhash, packing, quality_rules, substring_dedup, suffix_array, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("payload_bytes"))
    return found.select("page_id", sound.cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=4)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents"), packing.tokenizer_path(), packing.tokenizer_path("piece_bpe_32k.model"))


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_quality_rules, op3_suffix_array_dedup, op4_language_id, op5_decontamination, op6_substring_dedup, op7_chat_formatting, op8_warc, op9_minhash_near_dedup, op10_packing,
              op11_cross_tokenizer_alignment, op12_source_divergence_audit, op13_line_dedup)
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _terms(terms: tuple[str, ...]) -> str:
    return " + ".join(f"cast(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as integer)" for t in terms)


def _rules() -> str:
    ordered = sorted(url_filter.RULES, key=lambda r: (-len(r[1]) - len(r[2]), r))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", a, h + p) for a, h, p in ordered]
    rule = "case " + " ".join(f"when {c} then '{r}'" for c, _, r in fits) + " end"
    action = "case " + " ".join(f"when {c} then '{a}'" for c, a, _ in fits) + " end"
    return f"{rule} as rule, {action} as action"


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op1_url_filters": f"""
with a as (select page_id, coalesce(url, '') as url, translate(coalesce(url, ''), {_AZ}) as u, strpos(coalesce(url, ''), '://') as mark from pages),
b as (select page_id, u, case when mark > 0 then substr(url, mark + 3) else '' end as rest from a),
c as (select page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from b),
d as (select page_id, host, path, {_rules()}, {_terms(url_filter.STRICT_TERMS)} as n_strict, {_terms(url_filter.SOFT_TERMS)} as n_soft from c)
select page_id, host, path, rule, n_strict, n_soft,
  coalesce(action, case when n_strict > 0 or n_soft >= {url_filter.SOFT_LIMIT} then 'block' else 'allow' end) as verdict from d""",
    "op2_quality_rules": rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
w as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from d),
g as (select r, i, word || ' ' || string_agg(word, ' ') over (partition by r order by i rows between 1 following and 7 following) as g,
  count(*) over (partition by r order by i rows between current row and 7 following) as n from w),
s as (select r, i, count(*) over (partition by r, g) as c from g where n = 8),
p as (select r, i - coalesce(lag(i) over (partition by r order by i), -8) as gap from s where c > 1),
t as (select r, sum(least(8, gap)) as n_repeat_words from p group by r),
l as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
f as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
  cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
  len(list_filter(l, lambda x: regexp_matches(x, '{quality_rules.BULLET_LINE}'))) as n_bullets,
  len(list_filter(l, lambda x: regexp_matches(x, '{quality_rules.ELLIPSIS_LINE}'))) as n_ellipses,
  len(list_filter(w, lambda x: regexp_matches(x, '{quality_rules.LETTERLESS_WORD}'))) as n_letterless
  from d join l using (r) left join t using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select * exclude (n_bullets, n_ellipses, n_letterless), not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
  or (n_lines >= 5 and 100 * n_dup_lines > 60 * n_lines)
  or (n_lines >= 5 and 10 * n_bullets > 9 * n_lines) or (n_lines >= 5 and 10 * n_ellipses > 3 * n_lines)
  or 100 * n_letterless > 40 * n_words) as kept from b""",
    "op7_chat_formatting": """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
c as (select conv_id, count(*) as n_turns, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as chat from t group by conv_id),
p as (select conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '') over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as prefix,
  row_number() over (partition by conv_id order by turn nulls first, role, text) as n from t),
e as (select min(conv_id) as conv_id, n_turns, count(*) as n_copies, chat from c group by n_turns, chat)
select * from e where not exists (select 1 from p join c using (conv_id) where p.n < c.n_turns and p.n = e.n_turns and p.prefix = e.chat)""",
    "op8_warc": f"""
with a as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
b as (select *, case when payload_bytes >= {warc.REVISIT_BYTES} then max(page_id) over (partition by payload_digest) end as target from a)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when target <> page_id then 'revisit' else 'response' end as record_type,
  case when target <> page_id then target end as refers_to from b""",
    "op9_minhash_near_dedup": f"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from d),
n as (select doc_id, cast(len(s) as bigint) as n_shingles from s),
x as (select doc_id, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
e as (select a, b from l union all select b, a from l),
r as (with recursive r as (select doc_id, doc_id as o from n union select r.doc_id, e.b from r join e on e.a = r.o) select doc_id, min(o) as component_id from r group by doc_id)
select doc_id, n_shingles, component_id, doc_id = component_id as kept from n join r using (doc_id)""",
    "op12_source_divergence_audit": rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct r) as docs from w group by all),
k as (select lang, term, sum(n) as n from c group by all having sum(docs) >= {divergence.MIN_DOCS}),
v as (select lang, count(*) as v, sum(n) as n from k group by lang),
g as (select distinct lang, source from d),
s as (select lang, source, coalesce(sum(c.n), 0) as n from g left join (select c.* from c join k using (lang, term)) c using (lang, source) group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
  1 + (1000000000::hugeint * (coalesce(c.n, 0) + {divergence.SMOOTH})) // (s.n::hugeint + {divergence.SMOOTH} * v.v) as p,
  1 + (1000000000::hugeint * (k.n + {divergence.SMOOTH})) // (v.n::hugeint + {divergence.SMOOTH} * v.v) as q
  from g join k using (lang) join v using (lang) join s on s.lang = g.lang and s.source = g.source
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select lang, a.source, 'pair' as part, b.source as item, coalesce(x.f, 0) as value from g a join g b using (lang)
  left join (select a.lang, a.source as s1, b.source as s2, sum(abs(a.p - b.p)) as f from p a join p b on a.lang = b.lang and a.term = b.term group by all) x
  on x.lang = a.lang and x.s1 = a.source and x.s2 = b.source where a.source <> b.source
  union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank
from f qualify part = 'pair' or rank <= {divergence.TOP_TERMS}""",
    "op13_line_dedup": rf"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) as key from l),
n as (select key, count(distinct r) as docs, max(doc_id) as keeper from k where length(key) >= {line_dedup.MIN_CHARS} group by key having count(distinct r) >= {line_dedup.MIN_DOCS}),
j as (select r, i, line, n.key is not null and n.keeper is distinct from k.doc_id as gone from k left join n on n.key = k.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from j join d using (r) group by r, doc_id""",
}
