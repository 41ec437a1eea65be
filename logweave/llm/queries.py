"""The queries of this subpackage, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import align, decontam, langid, linkgraph, minhash, mixing, phrases, quality, spelling, suffix, tokenbin, toxicity, warc
from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), k=4, percent=80)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.report(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return tokenbin.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup(read(spark, sf_dir, "documents", "doc_id", "text")).drop("kept_text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.detect(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(read(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(read(spark, sf_dir, "documents", "doc_id", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return align.report(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return linkgraph.judge(pages, linkgraph.rule_table(spark, URL_RULES))


def queries() -> dict:
    ops = [
        op1_mixing, op2_langid, op3_minhash, op4_decontamination, op5_token_files, op6_phrases, op7_toxicity,
        op8_quality_rules, op9_warc, op10_suffix_array, op11_spelling, op12_alignment, op13_url_filter,
    ]
    return {f.__name__: f for f in ops}


# ── DuckDB SQL for the queries SQL can express ─────────────────────────────
_WORD = r"[^\x20\x09-\x0D]+"
_SIZED = f"sized as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as h, text from documents)"

OP1 = f"""
with {_SIZED},
src as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source asc nulls last) as i from sized group by source),
w as (select *, case (i - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, cast(source_size * 2 as double) as cap from src),
lev as (select *, row_number() over r as k,
  (cast(sum(source_size) over () as bigint) * cast(1.5 as double) - coalesce(sum(cap) over b, 0))
    / (cast(sum(weight) over () as bigint) - coalesce(cast(sum(weight) over b as bigint), 0)) as level
  from w window r as (order by cap / weight, source nulls last), b as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
free as (select min(k) as k from lev where weight * level <= cap),
goal as (select source, source_size, least(case when k < (select k from free) then cap else weight * (select level from lev where k = (select k from free)) end, cap) as target from lev),
pos as (select *, cast(coalesce(sum(size) over (partition by source order by h, doc_id nulls first, text nulls first rows between unbounded preceding and 1 preceding), 0) as bigint) as x from sized)
select p.doc_id, p.size, g.source_size, g.target,
  cast(case when p.size = 0 then 0 else (cast(floor(g.target) as bigint) // g.source_size) * p.size
    + greatest(least(cast(floor(g.target) as bigint) % g.source_size - p.x, p.size), 0) end as bigint) as taken
from pos p join goal g on p.source is not distinct from g.source
"""

_SP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_VALUES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
}
_RULE_ROWS = " union all ".join(
    f"select rid, doc_id, stratum, '{name}' as rule, cast({value} as double) as value from base" for name, value in _VALUES.items()
)
_CUTS = ", ".join(f"('{name}', {j}, cast({cut} as double))" for name, cuts in quality.RULES.items() for j, cut in enumerate(cuts, 1))
OP8 = f"""
with t as (select row_number() over () as rid, doc_id, lang as stratum, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{_WORD}') as ws from t),
tri as (select rid, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] as g from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from tri) where n > 1),
rep as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from again) group by rid),
lines as (select rid, list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '{_WORD}')) > 0) as ls from t),
base as (
  select w.rid, doc_id, stratum, cast(len(ws) as bigint) as n_words,
    cast(length(translate(text, {_SP}, '')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, len(ls) as n_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
    length(text) - length(translate(text, '!', '')) as n_bangs,
    length(text) - length(regexp_replace(text, '[\\p{{Lu}}]+', '', 'g')) as n_upper,
    len(ws) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(ws) as base_failed
  from w join lines using (rid) left join rep using (rid)),
vals as ({_RULE_ROWS}),
cuts(rule, j, cut) as (values {_CUTS}),
held as (select v.stratum, v.rule, v.value, l.quality from vals v join labels l using (doc_id) where l.quality in (0, 1)),
steps as (select stratum, rule, j, cut, sum(quality) as n, sum(case when value > cut then quality else 0 end) as k,
    sum(case when value > cut then 1 - quality else 0 end) as caught
  from held join cuts using (rule) group by all),
tail as (select *, case when k >= n * 0.01 then 1.0 else
    list_sum(list_transform(range(0, cast(k + 1 as bigint)), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) end as p,
    (select count(distinct coalesce(stratum, chr(0))) * {len(quality.RULES)} from held) as tests from steps),
certified as (select *, bool_and(p <= 0.05 / tests) over (partition by stratum, rule order by j rows unbounded preceding) as ok from tail),
best as (select stratum, rule, cut from certified where ok and caught > 10 * k
  qualify row_number() over (partition by stratum, rule order by caught - 10 * k desc, j) = 1),
hit as (select distinct v.rid from vals v join best b on v.stratum is not distinct from b.stratum and v.rule = b.rule and v.value > b.cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rid not in (select rid from hit) as kept
from base
"""


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_STEPS = 40
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_FRONTS = ",\n".join(
    f"f{i + 1} as materialized (select w.kind, w.dst as node, cast(sum((f.mass * 85) // (100 * d.n)) as bigint) as mass"
    f" from f{i} f join degree d using (kind, node) join walks w using (kind, node) where (f.mass * 85) // (100 * d.n) > 0 group by all)"
    for i in range(_STEPS)
)
OP13 = f"""
with rules(v, h, p) as (values {_RULES}),
u as (select row_number() over () as rid, page_id, html,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_AZ}) as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
fit as (select rid, arg_min(struct_pack(v := v, rule := h || p), (-length(h || p), h || p, v)) as r
  from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rid),
j as (select u.*, r.v as v, r.rule as rule from u left join fit using (rid)),
links as (select distinct host as src, translate(dst, {_AZ}) as dst
  from (select host, unnest(regexp_extract_all(html, '(?i)[\x20\x09-\x0D]href=["'']?(?:https?:)?//([^/?#"''<>\x20\x09-\x0D]+)', 1)) as dst from u)),
e as (select * from links where src <> '' and src <> dst),
walks as (select 'trust' as kind, src as node, dst from e union all select 'distrust', dst, src from e),
degree as (select kind, node, count(*) as n from walks group by all),
votes as (select host, sum(case when v = 'allow' then 1000000 else 0 end) as t, sum(case when v = 'block' then 1000000 else 0 end) as d
  from j where v is not null group by host),
f0 as (select 'trust' as kind, host as node, cast(t as bigint) as mass from votes where t > 0
  union all select 'distrust', host, cast(d as bigint) from votes where d > 0),
{_FRONTS},
every as ({" union all ".join(f"select * from f{i}" for i in range(_STEPS + 1))}),
score as (select node as host, cast(coalesce(sum(mass) filter (kind = 'trust'), 0) as bigint) as trust,
  cast(coalesce(sum(mass) filter (kind = 'distrust'), 0) as bigint) as distrust from every group by node)
select page_id, j.host, path, rule,
  coalesce(v, case when coalesce(distrust, 0) * 100 > 50 * (coalesce(trust, 0) + coalesce(distrust, 0)) then 'block' else 'allow' end) as verdict,
  coalesce(trust, 0) as trust, coalesce(distrust, 0) as distrust
from j left join score on j.host = score.host
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op8_quality_rules": OP8, "op13_url_filter": OP13}
