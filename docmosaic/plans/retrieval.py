"""Question answering over collections: candidates, fusion, reranking, context order, answer.

Each function takes all questions at once. ``variants`` is (entity_id, pos,
variant), where entity_id identifies the question; results call it query_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.parse import alias_candidates
from docmosaic.functions.text import collapse
from docmosaic.operators import bm25, keyword, mmr, ranking, vector
from docmosaic.operators.inverted import InvertedIndex
from docmosaic.session import looked_up, materialize, small_side


@dataclass(frozen=True)
class QuerySettings:
    """Retrieval settings; the defaults are those of the shipped configuration."""

    similarity_top_k: int = 8
    use_hybrid_search: bool = True
    use_reranker: bool = True
    reranker_strategy: str = "embedding"
    retrieve_k: int = fixed.RETRIEVE_K
    rerank_k: int = fixed.RERANK_K
    use_mmr: bool = True
    mmr_threshold: float = fixed.MMR_LAMBDA
    use_lost_in_middle: bool = True
    full_context_max_chunks: int = 0


def lexical_ranking(chunks: DataFrame, variants: DataFrame) -> DataFrame:
    """(query_id, collection, chunk_id, score): best variant per chunk."""
    scored = bm25.chunk_scores(chunks, variants)
    return (
        scored.groupBy("entity_id", "collection", "chunk_id")
        .agg(F.max("score").alias("score"))
        .withColumnRenamed("entity_id", "query_id")
    )


def pool_bm25(pool: DataFrame, variants: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): BM25 with the candidate pool of a question as its corpus.

    ``pool`` has (collection, chunk_id, text) with the question's id as collection;
    a candidate without any of the question's terms scores 0.
    """
    own = (
        bm25.chunk_scores(pool, variants)
        .where(F.col("entity_id") == F.col("collection"))
        .groupBy("collection", "chunk_id")
        .agg(F.max("score").alias("score"))
    )
    return pool.join(own, ["collection", "chunk_id"], "left").select(
        F.col("collection").alias("query_id"), "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def hybrid(index: InvertedIndex, vectors: DataFrame, variants: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): vector and BM25 rankings of depth ``k`` over all collections, fused by reciprocal rank."""
    dense = vector.nearest(vectors, query_vectors, k)
    lexical = index.ranking(variants, k)
    fused = ranking.reciprocal_rank_fusion([dense, lexical], ["query_id", "chunk_id"])
    return ranking.top_k(fused, ["query_id"], k, ranking.score_order())


def per_collection(scored: DataFrame, retrieve_k: int, n_collections: int) -> DataFrame:
    """Best chunks of each collection, ``max(retrieve_k // n, 5)`` of them."""
    k = ranking.per_collection_k(retrieve_k, n_collections)
    return ranking.top_k(scored, ["query_id", "collection"], k, ranking.score_order(), "collection_rank")


def full_context_or_top(
    scored: DataFrame, chunks: DataFrame, max_chunks: int, retrieve_k: int, n_collections: int
) -> DataFrame:
    """Collections of at most ``max_chunks`` chunks come whole, at score 1.0; others by top-k.

    Counts are taken by an aggregate and joined back, so that a large
    collection is never gathered for the sake of its size.
    """
    sizes = chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("size"))
    small = sizes.where(F.col("size") <= max_chunks).select("collection")
    names = small.agg(F.collect_set("collection")).scalar()
    asked = scored.select("query_id").distinct().select("query_id", F.explode(names).alias("collection"))
    every = asked.join(chunks.select("collection", "chunk_id"), "collection").select("query_id", "collection", "chunk_id")
    top = per_collection(scored.join(small, "collection", "left_anti"), retrieve_k, n_collections)
    return every.withColumn("score", F.lit(1.0)).unionByName(top.select("query_id", "collection", "chunk_id", "score"))


def rerank(pool: DataFrame, query_vectors: DataFrame, settings: QuerySettings) -> DataFrame:
    """(query_id, chunk_id, score, rank, position): reranked context of each question, from (query_id, chunk_id, embedding)."""
    if settings.use_mmr:
        best = mmr.diversify(pool, query_vectors, settings.rerank_k, settings.mmr_threshold)
    else:
        best = vector.rerank(pool, query_vectors, settings.rerank_k)
    best = best.select("query_id", "chunk_id", "score", "rank")
    if settings.use_lost_in_middle:
        return ranking.lost_in_middle(best, ["query_id"])
    return best.withColumn("position", (F.col("rank") - 1).cast("bigint"))


def extractive_answer(context: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, response, n_sources): chunks of the context joined in their position.

    Stands in for a language model; the context is bounded by ``rerank_k``.
    """
    context = materialize(context.select("query_id", "chunk_id", "position"), "context")
    parts = context.join(looked_up(texts.select("chunk_id", "text"), context, "chunk_id"), "chunk_id")
    ordered = F.array_sort(F.collect_list(F.struct("position", collapse(F.col("text")).alias("body"))))
    return parts.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda s: s.body), "\n\n").alias("response"),
        F.count(F.lit(1)).alias("n_sources"),
    )


def routed_sections(
    chunks: DataFrame, variants: DataFrame, definition_sections: list[str], hits: DataFrame | None = None
) -> DataFrame:
    """(entity_id, collection, origin, position): definition, BM25 and keyword sections, first mention kept."""
    scored = bm25.section_scores(chunks, variants, strict=True)
    hits = keyword.entity_hits(chunks, variants, with_text=False) if hits is None else hits
    found = keyword.section_hits(hits)
    entities = variants.select("entity_id").distinct()
    listed = F.posexplode(F.array(*[F.lit(s) for s in definition_sections]))
    parts = [
        entities.select("entity_id", listed.alias("n", "collection")).select(
            "entity_id", "collection", F.lit(0).alias("origin"), F.col("n").cast("double").alias("place"), F.lit("").alias("tie")
        ),
        scored.select(
            "entity_id", "collection", F.lit(1).alias("origin"), (-F.col("score")).alias("place"), F.col("collection").alias("tie")
        ),
        found.select(
            "entity_id", "collection", F.lit(2).alias("origin"), F.lit(0.0).alias("place"), F.col("collection").alias("tie")
        ),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = ranking.keep_first(union, ["entity_id", "collection"], ["origin", "place", "tie"])
    order = Window.partitionBy("entity_id").orderBy("origin", "place", "tie")
    return first.select(
        "entity_id", "collection", "origin", (F.row_number().over(order) - 1).cast("bigint").alias("position")
    )


def expanded_variants(variants: DataFrame, scored: DataFrame, min_sections: int, expand) -> DataFrame:
    """Suggested aliases for entities routed to fewer than ``min_sections`` sections.

    ``expand`` adds ``response`` (a comma list) to (entity_id, variant) of those entities.
    """
    counts = scored.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    names = variants.where("pos = 0").join(counts, "entity_id", "left")
    sparse = names.where(F.coalesce("n", F.lit(0)) < min_sections).select("entity_id", "variant")
    listed = alias_candidates(F.col("response"), F.col("variant"))
    more = expand(sparse).select("entity_id", F.posexplode(listed).alias("pos", "variant"))
    return more.select("entity_id", (F.col("pos") + 1000).alias("pos"), "variant")


def routing_cascade(chunks: DataFrame, variants: DataFrame, min_sections: int = 0, expand=None) -> DataFrame:
    """One row per entity: what BM25 and the keyword scan found, and whether it is worth a context.

    The keyword scan is written once, without the texts, and feeds both of its counts.
    """
    found = keyword.entity_hits(chunks, variants)
    digest = F.sha2(collapse(F.col("text")), 256).alias("digest")
    hits = materialize(found.select("entity_id", "collection", "chunk_id", digest), "hits")
    scored = bm25.section_scores(chunks, variants, strict=True)
    if min_sections > 0 and expand is not None:
        more = bm25.section_scores(chunks, expanded_variants(variants, scored, min_sections, expand), strict=True)
        scored = scored.unionByName(more)
    lexical = scored.select("entity_id", "collection", F.lit(1).alias("by_bm25"), F.lit(0).alias("by_keyword"))
    verbatim = keyword.section_hits(hits).select(
        "entity_id", "collection", F.lit(0).alias("by_bm25"), F.lit(1).alias("by_keyword")
    )
    sections = (
        lexical.unionByName(verbatim)
        .groupBy("entity_id", "collection")
        .agg(F.max("by_bm25").alias("by_bm25"), F.max("by_keyword").alias("by_keyword"))
        .groupBy("entity_id")
        .agg(
            F.sum("by_bm25").alias("bm25_sections"),
            F.sum("by_keyword").alias("keyword_sections"),
            F.count(F.lit(1)).alias("sections"),
        )
    )
    texts = hits.groupBy("entity_id").agg(F.countDistinct("digest").alias("keyword_chunks"))
    names = ranking.keep_first(variants.select("entity_id", "pos", "variant"), ["entity_id"], ["pos"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    counts = ("bm25_sections", "keyword_sections", "sections", "keyword_chunks")
    return (
        names.join(sections, "entity_id", "left")
        .join(texts, "entity_id", "left")
        .select("entity_id", F.col("variant").alias("entity_name"), *[zero(c) for c in counts])
        .withColumn("status", F.when(F.col("sections") > 0, F.lit("ROUTED")).otherwise(F.lit("SKIPPED")))
    )
