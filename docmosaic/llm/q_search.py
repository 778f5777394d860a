"""Queries of ranked search, SimHash near-duplicates and spelling variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmosaic.llm import ranked, simhash, spelling
from docmosaic.llm.base import query
from docmosaic.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(rf"""
with d as (select doc_id, unnest({_TERMS}) as term from documents where text is not null),
tf as (select doc_id, term, count(*) as tf from d group by all),
len as (select doc_id, sum(tf)::bigint as n from tf group by 1),
tot as (select count(*)::bigint as docs, sum(n)::bigint as terms from len),
df as (select term, count(*)::bigint as df from tf group by 1),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from df, tot),
m as (select doc_id, 75 + ((25 * n * docs) // terms) as m from len, tot),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark where text is not null) group by all),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from q join w using (term) join tf using (term) join m using (doc_id) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score from s where score > 0)
select * from r where rank <= 20
""")
def op11_ranked_lexical_search(spark, sf_dir):
    index = ranked.LexicalIndex(table(spark, sf_dir, "documents"))
    found = index.search(table(spark, sf_dir, "benchmark"), k=20)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query()
def op12_simhash_near_dedup(spark, sf_dir):
    found = simhash.members(table(spark, sf_dir, "documents"), size=3, radius=3)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


#: crc32 of '<doc_id>:<run>', whose characters have one byte, or two with the first C3; by table of 256 remainders.
_CRC_TABLE = ("list_transform(generate_series(0, 255), lambda k: list_reduce(list_prepend(k::bigint, [1::bigint, 2, 3, 4, 5, 6, 7, 8]), "
              "lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))")
_BYTES = ("flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''), "
          "lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))")


@query(rf"""
with recursive t as materialized (select {_CRC_TABLE} as t),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run
  from documents where text is not null),
seen as (select doc_id, run, count(*) as k from runs group by all),
hashed as (
  select run, k, xor(4294967295, list_reduce(list_prepend(4294967295, {_BYTES}),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) as h from seen, t),
shown as (
  select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k
  from hashed),
words as (select word, sum(k)::bigint as n from shown where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, n, i, left(word, i::int - 1) || substr(word, i::int + 1) as rest
  from (select word, n, unnest(generate_series(1, length(word))) as i from words)),
pairs as (
  select distinct a.word as a, b.word as b from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select c.word, w.word from cut c join words w on c.rest = w.word
  union select w.word, c.word from cut c join words w on c.rest = w.word),
near as (
  select a, count(*)::bigint as n_near, arg_min(b, (-w.n, b)) as best, max(w.n) as best_n from pairs join words w on w.word = b group by a),
forms as (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 5 * n then best end as form,
    case when best_n >= 5 * n then best_n end as form_n
  from words left join near on a = word),
chain(word, last) as (select word, word from forms union all select c.word, f.form from chain c join forms f on f.word = c.last where f.form is not null),
roots as (select c.word, c.last as root from chain c join forms f on f.word = c.last where f.form is null)
select word, form, root, n, n_near, form_n from forms join roots using (word)
""")
def op13_spelling_variants(spark, sf_dir):
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), one_in=199)
    words = counts.where((F.length("word") >= 6) & (F.col("n") >= 5))
    return spelling.variants(words, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")
