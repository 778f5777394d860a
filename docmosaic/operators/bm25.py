"""BM25 over named collections, for all entities and query variants in one job.

The corpus of a score is one collection: document counts, lengths and term
frequencies are taken per collection, as in the original per-section indexes.

Plan: the texts are read and tokenised once. Of each chunk, only its length and
the counts of query terms leave the map side; these postings are written to the
shared folder and every statistic is derived from them. What is shuffled grows
with the matched (chunk, term) pairs, never with the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.text import tokens
from docmosaic.session import is_small, materialize, small_result, small_side


def query_terms(variants: DataFrame) -> DataFrame:
    """(entity_id, pos, variant) -> one row per distinct term of the variant text."""
    return variants.select(
        "entity_id", "pos", "variant", F.explode(F.array_distinct(tokens(F.col("variant")))).alias("term")
    )


def postings(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(collection, chunk_id, length, term, tf) for the given terms, written once.

    Every chunk also has one row with the empty term, so that the collection
    statistics need no second pass over the texts.
    """
    vocabulary = terms.select("term").distinct().withColumn("known", F.lit(True))
    counted = chunks.select("collection", "chunk_id", tokens(F.col("text")).alias("words"))
    counted = counted.select(
        "collection",
        "chunk_id",
        F.size("words").cast("bigint").alias("length"),
        F.concat(F.array(F.lit("")), "words").alias("words"),
    )
    # explode_outer: explode would add a filter that tokenises every text once more
    words = counted.select("collection", "chunk_id", "length", F.explode_outer("words").alias("term"))
    keys = ["collection", "chunk_id", "length", "term"]
    wanted = F.col("known") | (F.col("term") == "")
    if is_small(vocabulary):
        matched = words.join(F.broadcast(vocabulary), "term", "left").where(wanted)
        tf = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))
    else:
        # too many query terms to send around: count first, so that counts and not words are joined
        counts = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))
        tf = counts.join(vocabulary, "term", "left").where(wanted).select(*keys, "tf")
    return materialize(tf, "postings")


def collection_stats(index: DataFrame) -> DataFrame:
    """(collection, n_chunks, avg_length)"""
    return (
        index.where(F.col("term") == "")
        .groupBy("collection")
        .agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("length").alias("avg_length"))
    )


def term_weights(index: DataFrame) -> DataFrame:
    """(collection, term, idf, avg_length) with the smoothed idf ln(1 + (N - df + .5) / (df + .5))."""
    df = index.where(F.col("term") != "").groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(collection_stats(index), "collection").select(
        "collection", "term", idf.alias("idf"), "avg_length"
    )


def chunk_scores(chunks: DataFrame, variants: DataFrame) -> DataFrame:
    """(entity_id, pos, variant, collection, chunk_id, score) for chunks sharing a term with a variant.

    ``chunks`` has (collection, chunk_id, text); ``variants`` has (entity_id, pos, variant), pos being their order.
    """
    terms = query_terms(variants)
    index = postings(chunks, terms)
    weights = small_result(term_weights(index), "weights")
    k1, b = fixed.BM25_K1, fixed.BM25_B
    part = (
        F.col("idf")
        * F.col("tf")
        * (k1 + 1)
        / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    )
    return (
        index.where(F.col("term") != "")
        .join(weights, ["collection", "term"])
        .select("collection", "chunk_id", "term", part.alias("part"))
        .join(small_side(terms), "term")
        .groupBy("entity_id", "pos", "variant", "collection", "chunk_id")
        .agg(F.sum("part").alias("score"))
    )


def section_scores(
    chunks: DataFrame,
    variants: DataFrame,
    threshold: float = 0.0,
    strict: bool = False,
    collections: list[str] | None = None,
) -> DataFrame:
    """(entity_id, collection, score, winning_variant): best chunk of any variant per collection.

    A collection passes at ``score >= threshold``. With the catalog's
    ``collections`` given, those without a shared term score 0.0 and so pass at
    the default threshold; ``strict`` asks for more than the threshold instead.
    """
    order = F.struct(F.round("score", 9).alias("score"), (-F.col("pos")).alias("first"), "variant")
    best = (
        chunk_scores(chunks, variants)
        .groupBy("entity_id", "collection")
        .agg(F.max(order).alias("top"))
        .select("entity_id", "collection", "top.score", F.col("top.variant").alias("winning_variant"))
    )
    if collections is not None and not strict and threshold <= 0:
        listed = F.explode(F.array(*[F.lit(c) for c in collections]))
        every = variants.select("entity_id").distinct().select("entity_id", listed.alias("collection"))
        best = every.join(best, ["entity_id", "collection"], "left").withColumn(
            "score", F.coalesce("score", F.lit(0.0))
        )
    passed = F.col("score") > threshold if strict else F.col("score") >= threshold
    return best.where(passed)
