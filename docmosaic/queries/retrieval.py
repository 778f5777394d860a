"""Retrieval: BM25 routing, keyword scan, vector search, fusion, reranking, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.embedding import embed
from docmosaic.functions.text import excerpt
from docmosaic.operators import cells, cross_encoder, keyword, mmr, ranking, vector
from docmosaic.operators.inverted import InvertedIndex
from docmosaic.plans import answering, coverage, retrieval
from docmosaic.queries import base, query
from docmosaic.queries.base import (
    CENTROIDS, CHUNKS, FIRST_VECTORS, PHRASINGS, PROBES, WHOLE, collapse_sql, cosine, embedded_sql, nearest, strip_sql, table,
)
from docmosaic.session import looked_up, materialize
from docmosaic.sources.catalog import list_collections

DEFINITION_SECTIONS = ["src7", "src1"]
RANK = "row_number() over (partition by {p} order by round(score, 9) desc, chunk_id)"


def _first_vectors(spark, d):
    v = base.vectors(spark, d)
    return v.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "chunk_id").alias("embedding"))


def _centroids(spark, d):
    return vector.centroids(base.vectors(spark, d), "label").withColumnRenamed("label", "query_id")


def _asked_scores(spark, d):
    """Every chunk that shares a word with an item, asked with all its words."""
    found = base.index(spark, d).scores(base.whole_questions(spark, d))
    return found.select(F.col("entity_id").alias("query_id"), "collection", "chunk_id", "score")


def _bigint(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("bigint"))
    return df


@query(f"""
with {CHUNKS}, {WHOLE}, {base.bm25()},
r as (select entity_id as query_id, collection, chunk_id, score, {RANK.format(p='entity_id')} as rank from scores)
select query_id::bigint as query_id, collection, chunk_id, rank, round(score, 4) as score from r where rank <= 20
""")
def bm25_topk(spark, d):
    top = base.index(spark, d).ranking(base.whole_questions(spark, d), 20)
    return _bigint(top.withColumn("score", F.round("score", 4)), "rank")


ROUTED = """
routed as (
  select entity_id, collection, max(round(score, 9)) as score,
         arg_max(variant, {{'s': round(score, 9), 'p': -pos}}) as winning_variant
  from scores group by all)""".replace("{{", "{").replace("}}", "}")


@query(f"""
with {CHUNKS}, {WHOLE}, {base.bm25()}, {ROUTED},
every as (select e.entity_id, c.collection from (select distinct entity_id from variants) e,
          (select distinct collection from chunks) c),
f as (select entity_id, collection, coalesce(score, 0.0)::double as score
      from every left join routed using (entity_id, collection))
select entity_id, collection, round(score, 4) as score,
       row_number() over (partition by entity_id order by score desc, collection) as route_rank
from f where score >= 0.0
""")
def bm25_route_sections(spark, d):
    from pyspark.sql import Window

    chunks = base.chunks(spark, d)
    listed = list_collections(chunks)
    scored = base.index(spark, d).section_scores(base.whole_questions(spark, d), collections=listed)
    order = Window.partitionBy("entity_id").orderBy(F.col("score").desc(), "collection")
    return scored.select(
        "entity_id",
        "collection",
        F.row_number().over(order).cast("bigint").alias("route_rank"),
        F.round("score", 4).alias("score"),
    )


@query(f"""
with {CHUNKS}, {PHRASINGS}, {base.bm25('chunks', 'phrasings')}, {ROUTED}
select entity_id, collection, round(score, 4) as score, winning_variant from routed where score > 0
""")
def bm25_section_scores(spark, d):
    scored = base.index(spark, d).section_scores(base.phrasings(spark, d), strict=True)
    return scored.withColumn("score", F.round("score", 4))


HITS = """
hits as (
  select v.entity_id, v.pos, v.variant, c.collection, c.chunk_id, c.text
  from variants v join chunks c on contains(lower(c.text), lower(v.variant)))"""
UNIQUE_HITS = f"""
unique_hits as (
  select * from (
    select *, row_number() over (partition by entity_id, {collapse_sql('text')} order by chunk_id) as k
    from (select distinct entity_id, collection, chunk_id, text from hits))
  where k = 1)"""


@query(f"""
with {CHUNKS}, {PROBES}, {HITS}, {UNIQUE_HITS}
select entity_id, collection, chunk_id, md5({collapse_sql('text')}) as text_md5 from unique_hits
""")
def keyword_scan(spark, d):
    from docmosaic.functions.text import collapse

    hits = keyword.entity_hits(base.chunks(spark, d), base.probes(spark, d))
    return keyword.distinct_hits(hits).select(
        "entity_id", "collection", "chunk_id", F.md5(collapse(F.col("text"))).alias("text_md5")
    )


@query(f"""
with {CHUNKS}, {PROBES}, {HITS}
select entity_id, collection, count(distinct chunk_id) as n_chunks from hits group by all
""")
def keyword_sections(spark, d):
    return keyword.section_hits(keyword.entity_hits(base.chunks(spark, d), base.probes(spark, d), with_text=False))


@query(f"""
with {CHUNKS}
select b.item_id, c.collection, c.chunk_id from benchmark b join chunks c on contains(lower(c.text), lower(b.text))
""")
def multi_term_keyword(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("term"))
    found = keyword.scan_terms(base.chunks(spark, d), items, ["collection", "chunk_id"])
    return found.join(items, "term").select("item_id", "collection", "chunk_id")


@query(f"""
with {FIRST_VECTORS}, {nearest('qv', 'vecs', 10)}
select query_id, chunk_id, rank, round(score, 5) as score from near
""")
def vector_topk(spark, d):
    near = vector.nearest(base.vectors(spark, d), _first_vectors(spark, d), 10)
    return _bigint(near, "rank").withColumn("score", F.round("score", 5))


# Every vector whose id is divisible by 50, against all vectors.
FIFTIETH = """
vecs as (select vec_id as chunk_id, embedding from embeddings),
qv as (select chunk_id as query_id, embedding from vecs where chunk_id % 50 = 0)"""


@query(f"""
with {FIFTIETH}, {nearest('qv', 'vecs', 10)}
select query_id, chunk_id, rank, round(score, 5) as score from near
""")
def vector_cells_topk(spark, d):
    """Exact search over vectors written by cell: cells whose bound cannot reach a query's k-th best stay closed."""
    v = base.vectors(spark, d).select("chunk_id", "embedding")
    asked = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    near = cells.CellIndex(v).search(asked, 10)
    return _bigint(near, "rank").withColumn("score", F.round("score", 5))


# All chunks and all items, each with a vector made from its text.
STORED = f"""
{CHUNKS}, {WHOLE}, {embedded_sql('chunks', 'chunk_id', 'text', 'made')},
stored as (select c.collection, c.chunk_id, c.text, v.embedding from chunks c join made v using (chunk_id)),
{embedded_sql('variants', 'entity_id', 'variant', 'asked')},
qv as (select entity_id as query_id, embedding from asked)"""


def _embedded_questions(asked):
    return asked.select(F.col("entity_id").alias("query_id"), embed(F.col("variant")).alias("embedding"))


HYBRID = f"""
{STORED}, {base.bm25()}, {nearest('qv', 'stored', 20, 'dense')},
lex as (
  select * from (select entity_id as query_id, chunk_id, {RANK.format(p='entity_id')} as rank from scores) where rank <= 20),
fused as (
  select query_id, chunk_id, sum(1.0::double / (60 + rank - 1)) as score
  from (select query_id, chunk_id, rank from dense union all select query_id, chunk_id, rank from lex) group by all),
hybrid as (
  select * from (select query_id, chunk_id, score, {RANK.format(p='query_id')} as rank from fused) where rank <= 20)"""


@query(f"with {HYBRID} select query_id, chunk_id, rank, round(score, 6) as score from hybrid")
def hybrid_rrf(spark, d):
    asked = base.whole_questions(spark, d)
    out = retrieval.hybrid(base.index(spark, d), base.embedded(spark, d), asked, _embedded_questions(asked), 20)
    return _bigint(out, "rank").withColumn("score", F.round("score", 6))


@query("""
with d as (select lang as query_id, doc_id as chunk_id, n_chars,
                  length(text) - length(replace(text, chr(10), '')) as n_lines from documents),
a as (select query_id, chunk_id, row_number() over (partition by query_id order by n_chars desc, chunk_id) as rank from d),
b as (select query_id, chunk_id, row_number() over (partition by query_id order by n_lines desc, chunk_id) as rank from d),
f as (select query_id, chunk_id, sum(1.0::double / (60 + rank - 1)) as score
      from (select * from a where rank <= 50 union all select * from b where rank <= 50) group by all)
select query_id, chunk_id, round(score, 6) as score,
       row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from f
""")
def rrf_fusion(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("lang").alias("query_id"),
        F.col("doc_id").alias("chunk_id"),
        "n_chars",
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_lines"),
    )
    by = lambda c: ranking.top_k(docs, ["query_id"], 50, [F.col(c).desc(), F.col("chunk_id")])
    fused = ranking.reciprocal_rank_fusion([by("n_chars"), by("n_lines")], ["query_id", "chunk_id"])
    out = ranking.top_k(fused, ["query_id"], 100, ranking.score_order())
    return _bigint(out, "rank").withColumn("score", F.round("score", 6))


ASKED = f"{CHUNKS}, {WHOLE}, {base.bm25()}, asked_scores as (select entity_id as query_id, collection, chunk_id, score from scores)"
N_COLLECTIONS = "(select count(distinct collection) from chunks)"
PER_COLLECTION = f"""
per_collection as (
  select * from (select *, {RANK.format(p='query_id, collection')} as collection_rank from asked_scores)
  where collection_rank <= greatest(88 // {N_COLLECTIONS}, 5))"""


def _n_collections(spark, d):
    return base.index(spark, d).stats.count()


def _per_collection(spark, d):
    k = ranking.per_collection_k(fixed.RETRIEVE_K, _n_collections(spark, d))
    found = base.index(spark, d).ranking(base.whole_questions(spark, d), k, per_collection=True)
    return found.withColumnRenamed("rank", "collection_rank")


@query(f"""
with {ASKED}, {PER_COLLECTION}
select query_id::bigint as query_id, collection, chunk_id, collection_rank, round(score, 4) as score from per_collection
""")
def topk_per_collection(spark, d):
    return _bigint(_per_collection(spark, d), "collection_rank").withColumn("score", F.round("score", 4))


@query(f"""
with {ASKED}, {PER_COLLECTION},
small as (select collection from chunks group by 1 having count(*) <= 45)
select query_id::bigint as query_id, collection, chunk_id, 1.0::double as score
from (select distinct query_id from asked_scores), chunks where collection in (select * from small)
union all
select query_id, collection, chunk_id, round(score, 4) from per_collection where collection not in (select * from small)
""")
def full_context_or_topk(spark, d):
    chunks = base.chunks(spark, d)
    out = retrieval.full_context_or_top(_asked_scores(spark, d), chunks, 45, fixed.RETRIEVE_K, _n_collections(spark, d))
    return out.withColumn("score", F.round("score", 4))


@query(f"""
with {ASKED}, {PER_COLLECTION},
p as (select query_id, collection, chunk_id, score, {RANK.format(p='query_id')} as rank from per_collection)
select query_id::bigint as query_id, collection, chunk_id, rank, round(score, 4) as score from p where rank <= 25
""")
def pooled_query(spark, d):
    pool = _per_collection(spark, d)
    best = ranking.top_k(pool, ["query_id"], fixed.RERANK_K, ranking.score_order())
    return _bigint(best, "rank").select("query_id", "collection", "chunk_id", "rank", F.round("score", 4).alias("score"))


# All words of a step's texts, or an equal share of each once they exceed the budget.
def _step_sql(texts: str, budget: int) -> str:
    joined = f"array_to_string({texts}, chr(10) || chr(10))"
    share = f"greatest(1, {budget} // greatest(1, len({texts})) - 2)::int"
    return f"case when length({joined}) <= {budget} then {joined} else array_to_string(list_transform({texts}, lambda t: left(t, {share})), chr(10) || chr(10)) end"


def _tree_sql(source: str, keys: str, steps: int, name: str, budget: int = answering.BUDGET) -> str:
    """CTEs that put the ``text`` of ``source``(keys, place, text) together in groups of neighbours, and end in ``name``."""
    out, last = [], source
    for k in range(steps):
        now = name if k == steps - 1 else f"{name}_{k}"
        out.append(f"""{now}_t as (select {keys}, place // {answering.FAN} as place, list(text order by place) as texts from {last} group by {keys}, place // {answering.FAN}),
{now} as (select {keys}, place, {_step_sql('texts', budget)} as text from {now}_t)""")
        last = now
    return ",\n".join(out)


TOLD = f"""
{ASKED}, {PER_COLLECTION},
told as (
  select query_id, p.collection, collection_rank, {collapse_sql("coalesce(c.text, '')")} as text from per_collection p join chunks c using (chunk_id)),
kept as (select query_id, collection, collection_rank - 1 as place, text from told where text <> '' and not starts_with(lower(text), 'not documented')),
{_tree_sql('kept', 'query_id, collection', 1, 'answered')},
sections as (select query_id, collection, text as response from answered where text <> '' and not starts_with(lower(text), 'not documented'))"""


def _sections(spark, d):
    found = _per_collection(spark, d).withColumnRenamed("collection_rank", "rank")
    return answering.collection_answers(found, base.chunks(spark, d), ranking.per_collection_k(fixed.RETRIEVE_K, _n_collections(spark, d)))


@query(f"with {TOLD} select query_id, collection, '[' || collection || ']' || chr(10) || response as response from sections")
def iterative_sections(spark, d):
    headed = F.concat(F.lit("["), "collection", F.lit("]\n"), "response")
    return _sections(spark, d).select("query_id", "collection", headed.alias("response"))


@query(f"""
with {TOLD},
named as (
  select query_id, row_number() over (partition by query_id order by collection) - 1 as place,
    count(*) over (partition by query_id) as n, collection, response from sections),
several as (select query_id, place, '[' || collection || ']' || chr(10) || response as text from named where n > 1),
{_tree_sql('several', 'query_id', 2, 'more')},
told_all as (select query_id, response as text, 1 as n from named where n = 1
  union all select query_id, text, (select count(*) from sections s where s.query_id = more.query_id) from more)
select i.entity_id as query_id, md5(coalesce(t.text, 'Not documented.')) as response_md5, coalesce(t.n, 0)::bigint as n_sections,
  length(coalesce(t.text, 'Not documented.')) as n_chars
from (select distinct entity_id from variants) i left join told_all t on t.query_id = i.entity_id
""")
def iterative_answers(spark, d):
    """Every collection answers from all its candidates; the answers of a question are put together in a tree."""
    questions = base.whole_questions(spark, d).select(F.col("entity_id").alias("query_id"))
    n = _n_collections(spark, d)
    out = answering.polished(materialize(_sections(spark, d), "sections"), questions, max(n, answering.FAN + 1))
    return out.select("query_id", F.md5("response").alias("response_md5"), "n_sections", F.length("response").cast("bigint").alias("n_chars"))


FUSED = f"""
{CHUNKS}, {PHRASINGS}, {base.bm25('chunks', 'phrasings')},
{embedded_sql('chunks', 'chunk_id', 'text', 'made')}, {embedded_sql('phrasings', 'entity_id, pos', 'variant', 'asked')},
lex as (select entity_id as query_id, pos, collection, chunk_id, {RANK.format(p='entity_id, pos, collection')} as rank from scores),
near as (
  select a.entity_id as query_id, a.pos, c.collection, c.chunk_id, round({cosine('a.embedding', 'm.embedding')}, 9) as score
  from asked a, made m join chunks c on c.chunk_id = m.chunk_id),
dense as (select query_id, pos, collection, chunk_id, {RANK.format(p='query_id, pos, collection')} as rank from near),
lists as (select * from lex union all select * from dense),
fused as (
  select query_id, collection, chunk_id, sum(1.0::double / (60 + rank - 1)) as score
  from lists where rank <= greatest(88 // (select count(distinct collection) from chunks), 5) group by all),
found as (
  select * from (select query_id, collection, chunk_id, score, {RANK.format(p='query_id, collection')} as rank from fused)
  where rank <= greatest(88 // (select count(distinct collection) from chunks), 5))"""


def _phrased(spark, d):
    asked = base.phrasings(spark, d)
    return asked, materialize(asked.select("entity_id", "pos", embed(F.col("variant")).alias("embedding")), "phrasing-vectors")


@query(f"with {FUSED} select query_id, collection, chunk_id, rank, round(score, 6) as score from found")
def hybrid_per_collection(spark, d):
    """Six lists of each item and collection, three phrasings by words and by vectors, fused inside the collection."""
    asked, vectors = _phrased(spark, d)
    k = ranking.per_collection_k(fixed.RETRIEVE_K, _n_collections(spark, d))
    out = answering.hybrid_per_collection(base.index(spark, d), base.embedded(spark, d), asked, vectors, k)
    return _bigint(out, "rank").select("query_id", "collection", "chunk_id", "rank", F.round("score", 6).alias("score"))


POOL88 = f"""
{STORED}, {base.bm25()},
pool as (
  select query_id, chunk_id, collection, text, embedding from (
    select entity_id as query_id, s.chunk_id, {RANK.format(p='entity_id').replace('chunk_id)', 's.chunk_id)')} as rank
    from scores s) p join stored using (chunk_id) where rank <= 88)"""
RERANKED = f"""
reranked as (
  select * from (
    select query_id, chunk_id, collection, text, score, {RANK.format(p='query_id')} as rank from (
      select p.query_id, p.chunk_id, p.collection, p.text, {cosine('p.embedding', 'q.embedding')} as score
      from pool p join qv q using (query_id))))"""


def _pool(spark, d):
    """The best candidates of every item by words, with texts and vectors, and the items' vectors."""
    asked = base.whole_questions(spark, d)
    top = materialize(base.index(spark, d).ranking(asked, fixed.RETRIEVE_K).select("query_id", "chunk_id"), "pool")
    return top.join(looked_up(base.embedded(spark, d), top, "chunk_id"), "chunk_id"), _embedded_questions(asked)


@query(f"""
with {POOL88}, {RERANKED}
select query_id, chunk_id, rank, round(score, 5) as score from reranked where rank <= 25
""")
def embedding_rerank(spark, d):
    pool, qv = _pool(spark, d)
    out = vector.rerank(pool, qv, fixed.RERANK_K)
    return _bigint(out, "rank").select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query(f"""
with {POOL88}, {RERANKED},
c as (select *, count(*) over (partition by query_id) as n from reranked where rank <= 25)
select query_id, chunk_id, rank,
  case when n <= 2 then rank - 1 when (rank - 1) % 2 = 0 then (rank - 1) // 2 else n - 1 - (rank - 2) // 2 end as position
from c
""")
def lost_in_middle(spark, d):
    pool, qv = _pool(spark, d)
    out = ranking.lost_in_middle(vector.rerank(pool, qv, fixed.RERANK_K), ["query_id"])
    return _bigint(out, "rank").select("query_id", "chunk_id", "rank", "position")


@query(f"""
with {POOL88}, {RERANKED}
select query_id, chunk_id, collection, rank, round(score, 5) as score, left({collapse_sql('text')}, 100) as preview,
       case when rank <= 25 then 'INCLUDED' else 'DROPPED' end as status
from reranked
""")
def ranking_report(spark, d):
    pool, qv = _pool(spark, d)
    out = ranking.report(vector.rerank(pool, qv, fixed.RETRIEVE_K))
    return _bigint(out, "rank").select(
        "query_id", "chunk_id", "collection", "rank", F.round("score", 5).alias("score"), "preview", "status"
    )


DENSE_POOL = f"""
{STORED}, {nearest('qv', 'stored', 88, 'dense')},
pool as (select d.query_id, d.chunk_id, d.score, d.rank, s.text from dense d join stored s using (chunk_id)),
pool_chunks as (select query_id as collection, chunk_id, text from pool)"""


@query(f"""
with {DENSE_POOL}, {base.bm25('pool_chunks', 'variants')},
best as (select collection as query_id, chunk_id, max(score) as score from scores where entity_id = collection group by all),
r as (select p.query_id, p.chunk_id, coalesce(b.score, 0.0)::double as score
      from pool p left join best b on p.query_id = b.query_id and p.chunk_id = b.chunk_id)
select query_id, chunk_id, round(score, 4) as score, {RANK.format(p='query_id')} as rank from r
""")
def bm25_rerank(spark, d):
    texts, stored = base.whole_questions(spark, d), base.embedded(spark, d)
    near = materialize(vector.nearest(stored, _embedded_questions(texts), fixed.RETRIEVE_K), "near")
    pool = near.select(F.col("query_id").alias("collection"), "chunk_id").join(
        looked_up(stored.select("chunk_id", "text"), near, "chunk_id"), "chunk_id"
    )
    out = ranking.top_k(retrieval.pool_bm25(pool, texts), ["query_id"], fixed.RETRIEVE_K, ranking.score_order())
    return _bigint(out, "rank").withColumn("score", F.round("score", 4))


@query(f"""
with {DENSE_POOL},
probe as (select item_id as entity_id, w as variant from words where rn <= 2),
kw as (select distinct v.entity_id as query_id, {strip_sql('c.text')} as keyword
       from probe v join chunks c on contains(lower(c.text), v.variant)),
flags as (select distinct p.query_id, p.chunk_id from pool p join kw using (query_id)
          where {strip_sql('p.text')} = keyword or (length(keyword) > 30 and contains({strip_sql('p.text')}, keyword))),
r as (select p.query_id, p.chunk_id, p.rank, f.chunk_id is not null as is_keyword
      from pool p left join flags f on p.query_id = f.query_id and p.chunk_id = f.chunk_id),
c as (select *, 25 + count(*) filter (rank > 25 and is_keyword) over (partition by query_id) as cutoff from r)
select query_id, chunk_id, rank, is_keyword, cutoff, case when rank <= cutoff then 'INCLUDED' else 'DROPPED' end as status from c
""")
def boosted_cutoff(spark, d):
    stored = base.embedded(spark, d)
    near = materialize(vector.nearest(stored, _embedded_questions(base.whole_questions(spark, d)), fixed.RETRIEVE_K), "near")
    ranked = near.join(looked_up(stored.select("chunk_id", "text"), near, "chunk_id"), "chunk_id")
    # an item's two longest words are its names, which the boost is about
    probes = base.probes(spark, d).where("pos < 2")
    hits = keyword.entity_hits(base.chunks(spark, d), probes).withColumnRenamed("entity_id", "query_id")
    out = ranking.boosted_cutoff(ranked, ranking.keyword_flags(ranked, hits))
    return _bigint(out, "rank", "cutoff").select("query_id", "chunk_id", "rank", "is_keyword", "cutoff", "status")


COVERAGE = f"""
{CENTROIDS}, {nearest('qv', 'vecs', 5)},
m as (select query_id, count(*) as chunks_found, round(max(score), 4) as top_score, round(avg(score), 4) as avg_score,
             arg_min(chunk_id, rank) as chunk_id from near group by 1),
cov as (
  select query_id, chunks_found, top_score, avg_score,
    coalesce({strip_sql("replace(left(d.text, 120), chr(10), ' ')")}, '') as preview,
    case when top_score >= 0.70 then 'STRONG' when top_score >= 0.55 then 'MODERATE'
         when top_score >= 0.40 then 'THIN' else 'ABSENT' end as verdict
  from m left join documents d on m.chunk_id = d.doc_id)"""


def _coverage(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return coverage.with_verdict(coverage.scores(base.vectors(spark, d), texts, _centroids(spark, d)))


@query(f"with {COVERAGE} select query_id, chunks_found, top_score, avg_score, preview from cov")
def coverage_score(spark, d):
    return _coverage(spark, d).drop("verdict")


@query(f"with {COVERAGE} select query_id, top_score, verdict from cov")
def coverage_verdict(spark, d):
    return _coverage(spark, d).select("query_id", "top_score", "verdict")


@query(f"""
with {COVERAGE}, n as (select verdict, count(*) as n from cov group by 1)
select verdict, n, round_even(n / sum(n) over () * 100, 0)::bigint as pct from n
""")
def coverage_summary(spark, d):
    return coverage.summary(_coverage(spark, d))


UNION = f"""
{CHUNKS}, {PROBES}, {base.bm25()}, {ROUTED}, {HITS},
parts as (
  select entity_id, s as collection, 0 as origin, i::double as place, '' as tie
  from (select distinct entity_id from variants), (values ('src7', 0), ('src1', 1)) t(s, i)
  union all select entity_id, collection, 1, -score, collection from routed where score > 0
  union all select distinct entity_id, collection, 2, 0.0::double, collection from hits),
first as (select *, row_number() over (partition by entity_id, collection order by origin, place, tie) as k from parts)"""


@query(f"""
with {UNION}
select entity_id, collection, origin, row_number() over (partition by entity_id order by origin, place, tie) - 1 as position
from first where k = 1
""")
def ordered_section_union(spark, d):
    return retrieval.routed_sections(base.chunks(spark, d), base.probes(spark, d), DEFINITION_SECTIONS)


@query(f"""
with {CHUNKS}, {PROBES}, {base.bm25()}, {ROUTED}, {HITS}, {UNIQUE_HITS},
s as (select entity_id, collection, 1 as b, 0 as k from routed where score > 0
      union all select distinct entity_id, collection, 0, 1 from hits),
g as (select entity_id, collection, max(b) as b, max(k) as k from s group by all),
c as (select entity_id, sum(b)::bigint as b, sum(k)::bigint as k, count(*) as n from g group by 1),
u as (select entity_id, count(*) as t from unique_hits group by 1)
select v.entity_id, v.variant as entity_name, coalesce(b, 0) as bm25_sections, coalesce(k, 0) as keyword_sections,
       coalesce(n, 0) as sections, coalesce(t, 0) as keyword_chunks,
       case when coalesce(n, 0) > 0 then 'ROUTED' else 'SKIPPED' end as status
from variants v left join c using (entity_id) left join u using (entity_id) where v.pos = 0
""")
def routing_cascade(spark, d):
    return retrieval.routing_cascade(base.chunks(spark, d), base.probes(spark, d))


@query(f"""
with {CHUNKS}, {PROBES},
h as (select v.entity_id, c.chunk_id, c.text, strpos(lower(c.text), lower(v.variant)) as pos0
      from variants v join chunks c on contains(lower(c.text), lower(v.variant)) where v.pos = 0),
b as (select *, greatest(1, pos0 - 300) as b0, least(length(text), pos0 - 1 + 300) as e0 from h),
s as (select *, strpos(reverse(left(text, b0)), ' ') as lb, strpos(substr(text, greatest(e0, 1)), ' ') as nb from b),
w as (select *, case when b0 > 1 and lb > 0 then b0 - lb + 2 else b0 end as b1,
             case when e0 < length(text) and nb > 0 then e0 + nb - 2 else e0 end as e1 from s)
select entity_id, chunk_id, {strip_sql('substr(text, b1, greatest(e1 - b1 + 1, 0))')} as excerpt from w
""")
def excerpt_window(spark, d):
    names = base.probes(spark, d).where("pos = 0")
    hits = keyword.entity_hits(base.chunks(spark, d), names)
    return hits.select("entity_id", "chunk_id", excerpt(F.col("text"), F.col("variant")).alias("excerpt"))


@query(f"""
with recursive {CENTROIDS}, {nearest('qv', 'vecs', 30)},
c as materialized (select n.query_id, n.chunk_id as id, {cosine('q.embedding', 'v.embedding')} as rel, v.embedding::double[] as e
      from near n join vecs v using (chunk_id) join qv q using (query_id)),
sim as materialized (select a.query_id, a.id as a, b.id as b, {cosine('a.e', 'b.e')} as s
      from c a join c b on a.query_id = b.query_id),
m(query_id, k, ids) as (
  select query_id, 1, [arg_min(id, {{'r': -round(rel, 9), 'i': id}})] from c group by query_id
  union all
  select m.query_id, m.k + 1, list_append(m.ids, (
    select c.id from c where c.query_id = m.query_id and not list_contains(m.ids, c.id)
    order by round(0.7 * c.rel - 0.3 * (select max(s.s) from sim s where s.query_id = c.query_id and s.a = c.id
                                 and list_contains(m.ids, s.b)), 9) desc, c.id limit 1))
  from m where m.k < 10)
select m.query_id, c.id as chunk_id, round(c.rel, 5) as score,
       row_number() over (partition by m.query_id order by round(c.rel, 9) desc, c.id) as rank
from m join c on m.query_id = c.query_id and list_contains(m.ids, c.id) where m.k = 10
""")
def mmr_select(spark, d):
    qv = _centroids(spark, d)
    v = base.vectors(spark, d)
    pool = vector.nearest(v, qv, 30).select("query_id", "chunk_id").join(v, "chunk_id")
    out = mmr.diversify(pool, qv, 10)
    return _bigint(out, "rank").withColumn("score", F.round("score", 5))


@query(f"""
with {POOL88},
tq as (select distinct entity_id as query_id, w from (select entity_id, unnest(regexp_split_to_array(lower(variant), '[^a-z0-9]+')) as w from variants) where w <> ''),
tc as (select distinct chunk_id, w from (select chunk_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as w from chunks) where w <> ''),
nq as (select query_id, count(*) as n from tq group by 1), nc as (select chunk_id, count(*) as n from tc group by 1),
shared as (select p.query_id, p.chunk_id, count(*) as n from pool p join tq using (query_id) join tc on tc.chunk_id = p.chunk_id and tc.w = tq.w group by all),
s as (select p.query_id, p.chunk_id, coalesce(b.n, 0) / greatest(1, coalesce(nq.n, 0) + coalesce(nc.n, 0) - coalesce(b.n, 0)) as score
  from pool p left join shared b on b.query_id = p.query_id and b.chunk_id = p.chunk_id left join nq on nq.query_id = p.query_id left join nc on nc.chunk_id = p.chunk_id),
r as (select query_id, chunk_id, score, {RANK.format(p='query_id')} as rank from s)
select query_id, chunk_id, rank, round(score, 6) as score, 'cross-encoder' as ranker from r where rank <= 25
""")
def cross_encoder_rerank(spark, d):
    """The pool of every item, scored pair by pair with the offline model."""
    pool, vectors = _pool(spark, d)
    asked = base.whole_questions(spark, d).select(F.col("entity_id").alias("query_id"), F.col("variant").alias("question"))
    out = cross_encoder.rerank(pool, asked.join(vectors, "query_id"), fixed.RERANK_K)
    return _bigint(out, "rank").select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "ranker")


@query(f"""
with {CHUNKS}, t as (select collection, chunk_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as term from chunks),
c as (select collection, count(*) as n from chunks group by 1)
select collection, term, count(distinct chunk_id) as df, count(*) as total, round(ln(1 + (any_value(n) - count(distinct chunk_id) + 0.5) / (count(distinct chunk_id) + 0.5)), 6) as idf
from t join c using (collection) where term <> '' group by collection, term
""")
def inverted_index(spark, d):
    """The index is written anew, and gives the terms of every collection with their counts and weights."""
    built = InvertedIndex(base.chunks(spark, d))
    return built.terms().select("collection", "term", "df", "total", F.round("idf", 6).alias("idf"))


@query(f"""
with {FUSED},
pool as (select query_id, chunk_id from found),
ranked as (
  select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from (
    select p.query_id, p.chunk_id, {cosine('m.embedding', 'a.embedding')} as score
    from pool p join made m using (chunk_id) join asked a on a.entity_id = p.query_id and a.pos = 0)),
context as (select *, count(*) over (partition by query_id) as n from ranked where rank <= 25),
placed as (
  select query_id, chunk_id, case when n <= 2 then rank - 1 when (rank - 1) % 2 = 0 then (rank - 1) // 2 else n - 1 - (rank - 2) // 2 end as position
  from context)
select p.query_id, md5(string_agg({collapse_sql('c.text')}, chr(10) || chr(10) order by p.position)) as response_md5, count(*) as n_sources
from placed p join chunks c using (chunk_id) group by 1
""")
def answer_pooled(spark, d):
    """Pooled answers as ``answer_questions``, ranked by likeness alone."""
    asked, vectors = _phrased(spark, d)
    settings = retrieval.QuerySettings(use_mmr=False)
    out = answering.answer(base.index(spark, d), base.chunks(spark, d), base.embedded(spark, d), asked, vectors, settings)
    return out.select("query_id", F.md5("response").alias("response_md5"), "n_sources")


@query()
def answer_questions(spark, d):
    """Pooled answers of all items in three phrasings, over the candidates of every collection."""
    asked, vectors = _phrased(spark, d)
    return answering.answer(base.index(spark, d), base.chunks(spark, d), base.embedded(spark, d), asked, vectors)
