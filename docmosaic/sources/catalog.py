"""Collection catalog: named partitions of one chunks table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collection_counts(chunks: DataFrame) -> DataFrame:
    """(collection, n_chunks)"""
    return chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"))


def list_collections(chunks: DataFrame, prefix: str | None = None) -> list[str]:
    """Sorted names, optionally those called ``prefix_*``. Names are metadata, like partitions."""
    names = chunks.select("collection").distinct()
    if prefix is not None:
        names = names.where(F.startswith("collection", F.lit(f"{prefix}_")))
    return sorted(r.collection for r in names.collect())


def resolve_prefixes(chunks: DataFrame, prefixes: list[str]) -> DataFrame:
    """(prefix, collection, position): collections called ``prefix_*``, in the order of the prefixes."""
    names = chunks.select("collection").distinct()
    listed = F.explode(
        F.array(*[F.struct(F.lit(i).alias("n"), F.lit(p).alias("prefix")) for i, p in enumerate(prefixes)])
    )
    pairs = names.select("collection", listed.alias("p")).where(
        F.startswith("collection", F.concat(F.col("p.prefix"), F.lit("_")))
    )
    return pairs.select("p.n", "p.prefix", "collection")


def status(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """(collection, n_chunks, n_indexed, missing) with a TOTAL row.

    Both sides are counted per collection before they meet in a full outer join.
    """
    texts = collection_counts(chunks)
    vectors = collection_counts(indexed).withColumnRenamed("n_chunks", "n_indexed")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = texts.join(vectors, "collection", "full_outer").select("collection", zero("n_chunks"), zero("n_indexed"))
    missing = F.count_if(F.col("n_indexed") == 0)
    return (
        both.rollup("collection")
        .agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_indexed").alias("n_indexed"), missing.alias("missing"))
        .withColumn("collection", F.coalesce("collection", F.lit("TOTAL")))
    )
