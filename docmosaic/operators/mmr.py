"""Maximal marginal relevance over a bounded candidate pool per query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.operators.ranking import score_order, top_k
from docmosaic.operators.vector import EPSILON


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=-1, keepdims=True) + EPSILON)


def diversify(
    pool: DataFrame, queries: DataFrame, k: int = fixed.RERANK_K, trade_off: float = fixed.MMR_LAMBDA
) -> DataFrame:
    """(query_id, chunk_id, score, rank): ``k`` diverse candidates, ranked by relevance.

    The choice is sequential, so each query's pool is one group. A pool is the
    output of a top-k retrieval and therefore bounded by the retrieval depth.
    Diversity decides membership; the order returned is by relevance.
    """
    q = queries.select("query_id", F.col("embedding").alias("_query"))
    rows = pool.select("query_id", "chunk_id", "embedding").join(q, "query_id")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk_id").reset_index(drop=True)
        docs = _unit(np.stack(group["embedding"].to_numpy()).astype(np.float64))
        relevance = docs @ _unit(np.asarray(group["_query"].iloc[0], dtype=np.float64))
        nearest = np.zeros(len(group))
        free = np.ones(len(group), dtype=bool)
        for step in range(min(k, len(group))):
            gain = relevance if step == 0 else trade_off * relevance - (1 - trade_off) * nearest
            pick = int(np.argmax(np.where(free, np.round(gain, 9), -np.inf)))
            free[pick] = False
            sims = docs @ docs[pick]
            nearest = sims if step == 0 else np.maximum(nearest, sims)
        out = group.loc[~free, ["query_id", "chunk_id"]].copy()
        out["score"] = relevance[~free]
        return out

    id_type = dict(pool.dtypes)["query_id"]
    chosen = rows.groupBy("query_id").applyInPandas(
        choose, f"query_id {id_type}, chunk_id bigint, score double"
    )
    return top_k(chosen, ["query_id"], k, score_order())
