"""Queries of the operators that judge or cut whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmosaic.llm import decontaminate, licenses, lines, quality, toxicity
from docmosaic.llm.base import query
from docmosaic.llm.common import fold, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(rf"""
with dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
iw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark),
sized as (select item_id, w, least(10, len(w)) as size from iw where len(w) > 0),
windows as (
  select distinct item_id, size, array_to_string(w[i : i + size - 1], ' ') as x
  from (select *, unnest(generate_series(1, len(w) - size + 1)) as i from sized)),
sizes as (select distinct size from windows),
places as (
  select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as x
  from (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as i from dw, sizes where len(w) >= size)),
found as (select p.doc_id, p.i, p.size, m.item_id from places p join windows m on p.size = m.size and p.x = m.x),
hits as (
  select doc_id, count(distinct j) as n_hit
  from (select doc_id, unnest(generate_series(i, i + size - 1)) as j from found) group by doc_id),
named as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, item_id::varchar as item from found) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join hits using (doc_id) left join named using (doc_id)
""")
def op5_suffix_array_decontamination(spark, sf_dir):
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.transform("matches", lambda x: x["item_id"]))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"),
        decontaminate.item_digest(F.col("matches")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op6_byte_cnn_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"


@query(rf"""
with l as (
  select doc_id, unnest(x) as line, generate_subscripts(x, 1) as i
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
k as (select doc_id, i, line, translate({STRIP.format('line')}, '{UPPER}', '{LOWER}') as key from l),
often as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (o.key is not null))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (o.key is null), '')) as kept_sha256
from k left join often o on k.key = o.key group by doc_id
""")
def op7_two_bloom_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.dedup_lines(docs, min_docs=10, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Distinct pairs of neighbouring words of a text; a lone word by itself.
BIGRAMS = """(select case when w = [''] then []::varchar[] when len(w) = 1 then w
  else list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) end
  from (select string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' ') as w))"""
_TEMPLATES = ", ".join(
    f"({_quoted(name)}, {k}, {_quoted(text)})" for name, several in licenses.TEMPLATES.items() for k, text in enumerate(several))


@query(rf"""
with t as (select license, template, list_distinct(b) as b, len(b) as m from (
    select license, template, {BIGRAMS.format(x='x')} as b from (values {_TEMPLATES}) v(license, template, x))),
l as (
  select doc_id, unnest(x) as unit, generate_subscripts(x, 1) - 1 as line
  from (select doc_id, string_split(text, chr(10)) as x from documents)
  union all
  select doc_id, unit, line from (
    select doc_id, unnest(x) as unit, -generate_subscripts(x, 1) as line
    from (select doc_id, regexp_split_to_array(text, '
[	 ]*
') as x from documents)) where contains(unit, chr(10))),
u as (select doc_id, line, {BIGRAMS.format(x='unit')} as b from l),
d as (
  select doc_id, line, license, max(2.0 * len(list_intersect(u.b, t.b)) / (len(u.b) + m)) as dice
  from u, t where len(u.b) > 0 and len(u.b) between 2.0 / 3 * m - 1e-9 and 1.5 * m + 1e-9 group by all),
k as (select * from d where dice >= 0.8),
g as (
  select doc_id, count(*) as n_matches, string_agg(distinct license, ',' order by license) as licenses, max(dice) as best_dice
  from k group by doc_id)
select doc_id, coalesce(n_matches, 0)::bigint as n_matches, coalesce(licenses, '') as licenses, coalesce(best_dice, 0.0)::double as best_dice
from documents left join g using (doc_id)
""")
def op4_dice_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"), F.max("dice").alias("best"))
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_matches"), F.coalesce("names", F.lit("")).alias("licenses"),
        F.coalesce("best", F.lit(0.0)).alias("best_dice"))


@query()
def op2_clause_grammar_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
