"""Reranking by a model that reads question and text together, with a fallback.

Pairs are scored in Arrow batches; the model is loaded once per worker. A batch that fails is
tried pair by pair, and what still fails is marked in a column. Scores of a model and of
embeddings cannot be ranked together, so a question with a failed pair goes to the embedding
ranker with its whole pool; all other questions keep the model's ranking.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.operators import vector
from docmosaic.operators.ranking import score_order, top_k
from docmosaic.session import bounded_batches, materialize, returning

#: Questions and texts of a batch to one score per pair.
Model = Callable[[list[str], list[str]], np.ndarray]
BATCH = 256

_WORD = re.compile("[a-z0-9]+")


def word_overlap(questions: list[str], texts: list[str]) -> np.ndarray:
    """Offline model: distinct words in common, over those of question and text together."""
    out = np.zeros(len(texts))
    for i, (q, t) in enumerate(zip(questions, texts)):
        a, b = set(_WORD.findall(q.lower())), set(_WORD.findall(t.lower()))
        out[i] = len(a & b) / max(1, len(a | b))
    return out


def offline() -> Model:
    return word_overlap


def score_pairs(pairs: DataFrame, load: Callable[[], Model] = offline, batch: int = BATCH) -> DataFrame:
    """(query_id, chunk_id, score, failed) of (query_id, chunk_id, question, text); nulls are empty texts."""

    bounded_batches(pairs.sparkSession)

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.slice(at, batch)
                asked, texts = ([x or "" for x in part.column(c).to_pylist()] for c in ("question", "text"))
                try:
                    model = model or load()
                    scores = np.asarray(model(asked, texts), np.float64)
                except Exception:
                    scores = np.array([_alone(model, q, t) for q, t in zip(asked, texts)], np.float64)
                bad = ~np.isfinite(scores)
                yield pa.RecordBatch.from_arrays(
                    [part.column("query_id"), part.column("chunk_id"), pa.array(scores, mask=bad), pa.array(bad)],
                    names=["query_id", "chunk_id", "score", "failed"])

    kinds = dict(pairs.dtypes)
    return pairs.select("query_id", "chunk_id", "question", "text").mapInArrow(
        run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, failed boolean")


def _alone(model: Model | None, question: str, text: str) -> float:
    """NaN where the model cannot be loaded or fails: the caller turns that into the mark of a failure."""
    if model is None:
        return float("nan")
    try:
        return float(np.asarray(model([question], [text]))[0])
    except Exception:
        return float("nan")


def rerank(pool: DataFrame, questions: DataFrame, k: int, load: Callable[[], Model] = offline) -> DataFrame:
    """(query_id, chunk_id, score, rank, ranker): the best ``k`` of each question's pool.

    ``pool`` has (query_id, chunk_id, text, embedding), ``questions`` (query_id, question,
    embedding). ``ranker`` says which of the two ranked the question.
    """
    pairs = pool.select("query_id", "chunk_id", "text").join(questions.select("query_id", "question"), "query_id")
    scored = materialize(score_pairs(pairs, load), "cross-encoded")
    failing = scored.where("failed").select("query_id").distinct()
    good = top_k(scored.join(failing, "query_id", "left_anti").drop("failed"), ["query_id"], k, score_order())
    rest = pool.select("query_id", "chunk_id", "embedding").join(failing, "query_id", "left_semi")
    rest = vector.rerank(rest, questions.select("query_id", "embedding"), k)
    columns = ("query_id", "chunk_id", "score", "rank")
    return good.select(*columns, F.lit("cross-encoder").alias("ranker")).unionByName(
        rest.select(*columns, F.lit("embedding").alias("ranker")))
