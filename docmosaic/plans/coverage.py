"""Coverage of entities by the corpus: similarity metrics, verdicts, distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.predicates import coverage_verdict
from docmosaic.functions.text import strip
from docmosaic.operators import vector


def scores(vectors: DataFrame, texts: DataFrame, entities: DataFrame, k: int = fixed.COVERAGE_TOP_K) -> DataFrame:
    """(query_id, chunks_found, top_score, avg_score, preview) from the ``k`` nearest chunks."""
    near = vector.nearest(vectors, entities, k)
    metrics = near.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("chunks_found"),
        F.round(F.max("score"), 4).alias("top_score"),
        F.round(F.avg("score"), 4).alias("avg_score"),
        F.min_by("chunk_id", "rank").alias("chunk_id"),
    )
    head = strip(F.translate(F.left("text", F.lit(120)), "\n", " "))
    previews = texts.select("chunk_id", head.alias("preview"))
    all_entities = entities.select("query_id")
    return (
        all_entities.join(metrics, "query_id", "left")
        .join(previews, "chunk_id", "left")
        .select(
            "query_id",
            F.coalesce("chunks_found", F.lit(0)).alias("chunks_found"),
            F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
            F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
            F.coalesce("preview", F.lit("")).alias("preview"),
        )
    )


def with_verdict(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("verdict", coverage_verdict(F.col("top_score"), F.col("chunks_found")))


def summary(verdicts: DataFrame) -> DataFrame:
    """(verdict, n, pct): whole percents, halves to even."""
    n = verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    share = F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 0).cast("bigint")
    return n.withColumn("pct", share)
