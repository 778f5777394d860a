"""Queries of the operators on pairs and fingerprints of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmosaic.llm import fingerprint, ngram_join
from docmosaic.llm.base import query
from docmosaic.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(rf"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as x
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
sets as (select list(x order by x) as k, doc_id from s group by doc_id),
reps as (select k, min(doc_id) as rep from sets group by k),
member as (select doc_id, rep from sets join reps using (k)),
rs as (select s.* from s join (select distinct rep from member) r on s.doc_id = r.rep),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from rs a join rs b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (
  select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * c >= 90 * (na.n + nb.n - c)),
pairs as (select a, b from links union all select b, a from links),
reach(a, b) as (select rep, rep from reps union select r.a, e.b from reach r join pairs e on r.b = e.a),
comp as (select a as rep, min(b) as component_id from reach group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.component_id, w.doc_id) as component_id
from w left join n using (doc_id) left join member m using (doc_id) left join comp c on c.rep = m.rep
""")
def op9_ngram_jaccard_join(spark, sf_dir):
    join = ngram_join.NgramJoin(table(spark, sf_dir, "documents"), size=3, least=90)
    return join.members().select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query()
def op10_one_permutation_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = fingerprint.with_next(
        docs, "doc_id", {"text": "next", "print": "next_print"}, lambda rows: fingerprint.with_fingerprint(rows, "text", "print"))
    chars = F.length("text")
    third = F.floor(chars / 3).cast("int")
    edited = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), chars - third), F.substring("next", F.lit(1), third)))
    return fingerprint.with_fingerprint(edited, "edited", "edited_print").select(
        "doc_id", chars.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.hex_of("print").alias("fingerprint"), fingerprint.hex_of("edited_print").alias("edited_fingerprint"),
        fingerprint.likeness("print", "edited_print").alias("near_edited"),
        fingerprint.likeness("print", "next_print").alias("near_next"),
    )
