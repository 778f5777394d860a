"""Rankings: top-k, rank fusion, cutoffs, position changes.

Every ranking has a total order (score down, then id up). Scores are rounded to
nine places first, so that copies of a chunk tie exactly and the id decides.
``row_number() <= k`` is planned with a per-task group limit before the shuffle,
so a collection holding a third of all chunks sends k rows per task, not all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.text import preview, strip


def score_order(score: str = "score", key: str = "chunk_id") -> list[Column]:
    return [F.round(F.col(score), 9).desc(), F.col(key).asc()]


def top_k(
    df: DataFrame, keys: list[str], k: int, order: list[Column], rank: str = "rank", salt: Column | None = None
) -> DataFrame:
    """First ``k`` rows per group with their 1-based rank.

    Every task hands on at most ``k`` rows per group. Where even those add up for a
    hot group, ``salt`` (a number with few values) has them cut down within parts of
    the group first; the best of the parts hold the best of the whole.
    """

    def cut(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)

    if salt is not None:
        df = cut(df.withColumn("_salt", salt), [*keys, "_salt"], "_part").drop("_salt", "_part")
    return cut(df, keys, rank)


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` (a unique order).

    An aggregate with map-side combine: each task sends one row per key.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    rest = [c for c in df.columns if c not in order]
    key_cols = [k.alias(f"_key{i}") for i, k in enumerate(named)]
    first = F.min(F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in rest]).alias("_rest")))
    slim = df.groupBy(*key_cols).agg(first.alias("_first"))
    cols = [F.col(f"_first.{c}") if c in order else F.col(f"_first._rest.{c}") for c in df.columns]
    return slim.select(*[c.alias(n) for c, n in zip(cols, df.columns)])


def per_collection_k(retrieve_k: int, n_collections: int) -> int:
    return max(retrieve_k // max(n_collections, 1), 5)


def reciprocal_rank_fusion(rankings: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sum of 1 / (60 + rank from 0) over rankings that hold (keys..., rank from 1)."""
    parts = [r.select(*keys, (1.0 / (fixed.RRF_K + F.col("rank") - 1)).alias("part")) for r in rankings]
    pooled = parts[0]
    for p in parts[1:]:
        pooled = pooled.unionByName(p)
    return pooled.groupBy(*keys).agg(F.sum("part").alias("score"))


def cutoff_status(df: DataFrame, cutoff: Column | int) -> DataFrame:
    limit = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    return df.withColumn("status", F.when(F.col("rank") <= limit, F.lit("INCLUDED")).otherwise(F.lit("DROPPED")))


def report(df: DataFrame, cutoff: int = fixed.RERANK_K) -> DataFrame:
    """Ranked candidates with a preview and the cutoff flag."""
    return cutoff_status(df.withColumn("preview", preview(F.col("text"), 100)), cutoff)


def lost_in_middle(df: DataFrame, keys: list[str]) -> DataFrame:
    """Position (from 0) that puts the best chunks at both ends of the context.

    Even ranks fill the front, odd ranks the back; one or two rows stay as they are.
    Groups are cut to the context size before, so the window is small.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.col("rank") - 1
    spread = F.when(i % 2 == 0, (i / 2).cast("bigint")).otherwise(n - 1 - ((i - 1) / 2).cast("bigint"))
    return df.withColumn("position", F.when(n <= 2, i.cast("bigint")).otherwise(spread))


def keyword_flags(pool: DataFrame, keyword_texts: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of pooled chunks that are, or contain, a keyword chunk.

    The pool of a query is bounded by the retrieval depth, so it is packed into
    one row per query and every keyword text is tested against it where it lies:
    the keyword side, which has no bound, is not collected or paired up.
    """
    packed = pool.groupBy("query_id").agg(
        F.collect_list(F.struct("chunk_id", strip(F.col("text")).alias("body"))).alias("pool")
    )
    same = keyword_texts.select("query_id", strip(F.col("text")).alias("keyword"))
    hit = F.filter(
        "pool",
        lambda p: (p.body == F.col("keyword"))
        | ((F.length("keyword") > 30) & F.contains(p.body, F.col("keyword"))),
    )
    return (
        same.join(packed, "query_id")
        .select("query_id", F.explode(hit).alias("h"))
        .select("query_id", "h.chunk_id")
        .distinct()
    )


def boosted_cutoff(ranked: DataFrame, flags: DataFrame, k: int = fixed.RERANK_K) -> DataFrame:
    """Rank order kept; the cutoff grows by the keyword chunks ranked beyond ``k``."""
    flagged = ranked.join(flags.withColumn("is_keyword", F.lit(True)), ["query_id", "chunk_id"], "left").withColumn(
        "is_keyword", F.coalesce("is_keyword", F.lit(False))
    )
    beyond = F.count_if((F.col("rank") > k) & F.col("is_keyword")).over(Window.partitionBy("query_id"))
    return cutoff_status(flagged.withColumn("cutoff", beyond + k), F.col("cutoff"))
