"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from cairnlake.llm import line_dedup as lines
from cairnlake.llm import decontaminate, embedding_dedup, html_text, jaccard, packing, substring_dedup, toxicity
from cairnlake.llm import license_scan as licenses
from cairnlake.llm import url_filter as urls
from cairnlake.llm.runtime import table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def op7_url_filters(spark, sf_dir):
    out = urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op7_url_filters"] = """
with rules(action, rh, rp) as (values ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')),
u as (select page_id,
 coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
m as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(action, length(rh || rp)) as action
 from u join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select u.page_id, host, path, rule, coalesce(action, 'allow') as verdict from u left join m using (page_id)
"""


def op10_line_dedup(spark, sf_dir):
    out = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


ORACLE_SQL["op10_line_dedup"] = """
with d as (select doc_id, coalesce(source, '') as h, text, string_split(text, chr(10)) as ls from documents),
totals as (select h, count(*) as pages from d group by h),
counts as (select h, line, count(*) as n from (select h, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ')))) as line from d) where line <> '' group by h, line),
bad as (select counts.h, list(line) as bl from counts join totals on counts.h = totals.h where n >= 2 and n / pages > 0.1 group by counts.h),
k as (select doc_id, text, ls, list_filter(ls, lambda x: trim(x, ' ') = '' or not list_contains(coalesce(bl, []), trim(x, ' '))) as kept from d left join bad on d.h = bad.h)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(len(ls) - len(kept), 0)::bigint as n_dropped, case when text is not null then md5(array_to_string(kept, chr(10))) end as kept_md5 from k
"""


def op1_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op2_license_scans(spark, sf_dir):
    out = licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "license", F.round("dice", 6).alias("dice"), "n_units")


def _license_sql() -> str:
    rows = ", ".join(f"('{n}', {[*sorted(licenses.bigrams_of(t))]})" for n, t in licenses.TEMPLATES.items())
    mark = "(" + " or ".join(f"contains(lower(u), '{w}')" for w in licenses.markers(licenses.TEMPLATES, licenses.THRESHOLD)) + ")"
    return f"""
with t(name, b) as (values {rows}),
u as (select doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n[ \\t\\r]*\\n'), [text]))) as u from documents),
w as (select doc_id, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') as w from u where {mark}),
g as (select doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w),
s as (select doc_id, g, name, 2.0::double * len(list_intersect(g, b)) / (len(g) + len(b)) as dice from g, t where len(g) >= len(b) * 0.8 / 1.2 - 1e-9 and len(g) <= len(b) * 1.2 / 0.8 + 1e-9),
h as (select doc_id, max(dice) as unit_dice from s where dice >= 0.8 group by doc_id, g),
n as (select doc_id, count(*) as n_units from h group by doc_id),
best as (select doc_id, name, dice, row_number() over (partition by doc_id order by dice desc, name) as k from s where dice >= 0.8)
select d.doc_id, name as license, coalesce(round(dice, 6), 0.0)::double as dice, coalesce(n_units, 0)::bigint as n_units
from documents d left join best on d.doc_id = best.doc_id and k = 1 left join n on d.doc_id = n.doc_id
"""


ORACLE_SQL["op2_license_scans"] = _license_sql()


def op3_ngram_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op4_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_array_dedup(spark, sf_dir):
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"))


def op6_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    out = toxicity.score(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), packing.tokenizer_path())


for _f in (op1_html_extraction, op2_license_scans, op3_ngram_jaccard_join, op4_benchmark_decontamination, op5_suffix_array_dedup, op6_embedding_near_dedup, op7_url_filters, op8_toxicity, op9_packing, op10_line_dedup):
    QUERIES[_f.__name__] = _f
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
