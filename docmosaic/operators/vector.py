"""Exact vector search by cosine, for many queries in one pass over the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmosaic.operators.ranking import score_order, top_k
from docmosaic.session import bounded_batches, materialize, returning

EPSILON = 1e-9
# Query vectors of one pass, in bytes; more queries take further passes.
QUERY_BYTES = 64 * 1024 * 1024
# Of a search within collections: queries of one pass, and the sides of a tile of scores.
GROUP_QUERIES = 8192
TILE = 1024
# Best hits a task holds before it hands them on.
HELD = 1_000_000


def dot(a: Column, b: Column) -> Column:
    pair = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pair, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, with 1e-9 added to each norm."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + EPSILON) * (F.sqrt(dot(b, b)) + EPSILON))


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per key; averaged per component, so no group is collected."""
    part = vectors.select(key, F.posexplode("embedding").alias("i", "x"))
    mean = part.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return mean.groupBy(key).agg(F.transform(ordered, lambda s: s.x).alias("embedding"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.sqrt(np.einsum("ij,ij->i", m, m))[:, None] + EPSILON)


def _one_pass(vectors: DataFrame, ids: list, matrix: np.ndarray, k: int, id_type: str) -> DataFrame:
    bounded_batches(vectors.sparkSession)
    sc = vectors.sparkSession.sparkContext
    shared = sc.broadcast((ids, _unit(matrix)))

    @returning
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        kept: list[list[tuple[float, int]]] = [[] for _ in query_ids]
        for batch in batches:
            col = batch.column("embedding")
            if not len(col):
                continue
            rows = _unit(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1))
            keys = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            scores = np.round(queries @ rows.T, 9)
            for q, s in enumerate(scores):
                order = np.lexsort((keys, -s))[:k]
                merged = kept[q] + [(-float(s[i]), int(keys[i])) for i in order]
                kept[q] = sorted(merged)[:k]
        flat = [(q, key, -s) for q, hits in zip(query_ids, kept) for s, key in hits]
        cols = list(zip(*flat)) if flat else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64() if id_type == "bigint" else pa.string()),
             pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
            names=["query_id", "chunk_id", "score"],
        )

    return vectors.select("chunk_id", "embedding").mapInArrow(best, f"query_id {id_type}, chunk_id bigint, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` vectors closest to each query, exactly.

    ``vectors`` has (chunk_id, embedding), ``queries`` (query_id, embedding).
    A task multiplies its vectors with the block of queries and hands on only
    its own k best per query; pairs are never materialised. Queries beyond the
    size of one block are taken in further passes.
    """
    id_type = "bigint" if dict(queries.dtypes)["query_id"] in ("bigint", "int") else "string"
    queries = queries.select(F.col("query_id").cast(id_type).alias("query_id"), "embedding")
    size = queries.agg(F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()[0]
    passes = int(size // QUERY_BYTES) + 1
    if passes > 1:
        part = F.pmod(F.xxhash64("query_id"), F.lit(passes))
        queries = materialize(queries.withColumn("part", part), "queries")
    out = None
    for p in range(passes):
        block = queries if passes == 1 else queries.where(F.col("part") == p)
        rows = block.orderBy("query_id").select("query_id", "embedding").collect()
        if not rows and passes > 1:
            continue
        matrix = np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), -1)
        hits = _one_pass(vectors, [r.query_id for r in rows], matrix, k, id_type)
        hits = hits if passes == 1 else materialize(hits, "nearest")
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, ["query_id"], k, score_order())


def _best_of_tile(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, column) of the ``k`` best of each row; equal scores by key."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, 1)[:, -k]
        row, at = np.nonzero(scores >= least[:, None])
    else:
        row, at = np.nonzero(np.ones(scores.shape, bool))
    return _first_k(row, at, scores[row, at], keys[at], k)


def _first_k(row, at, score, key, k):
    order = np.lexsort((key, -score, row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k]


def nearest_in_groups(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, pos, collection, chunk_id, score, rank): the ``k`` closest vectors of each collection, exactly.

    ``vectors`` has (collection, chunk_id, embedding), ``queries`` (query_id, pos, embedding).
    Scores exist as tiles of bounded size only; a task hands on its best ``k`` of a query
    and collection. More queries than ``GROUP_QUERIES`` take further passes.
    """
    kind, id_kind = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]
    count = queries.count()
    passes = max(1, -(-count // GROUP_QUERIES))
    queries = queries.select("query_id", "pos", "embedding")
    if passes > 1:
        queries = materialize(queries.withColumn("part", F.pmod(F.xxhash64("query_id", "pos"), F.lit(passes))), "queries")
    bounded_batches(vectors.sparkSession)
    sc = vectors.sparkSession.sparkContext
    schema = f"query_id {kind}, pos int, collection string, chunk_id {id_kind}, score double"
    out = None
    for p in range(passes):
        block = queries.where(F.col("part") == p) if passes > 1 else queries
        rows = block.orderBy("query_id", "pos").collect()  # about GROUP_QUERIES vectors at most
        if not rows and out is not None:
            continue
        shared = sc.broadcast((
            [r.query_id for r in rows], np.array([r.pos for r in rows], np.int32),
            _unit(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1 if rows else 0))))

        @returning
        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, places, matrix = shared.value
            held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

            def done() -> Iterator[pa.RecordBatch]:
                for collection, (row, key, score) in held.items():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i] for i in row], typed), pa.array(places[row]), pa.array([collection] * len(row), pa.string()),
                         pa.array(key), pa.array(score)],
                        names=["query_id", "pos", "collection", "chunk_id", "score"])
                held.clear()

            typed = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
            for batch in batches:
                batch = batch.filter(batch.column("embedding").is_valid())
                if not len(batch) or not len(names):
                    continue
                rows = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1))
                keys = batch.column("chunk_id").to_numpy(zero_copy_only=False)
                groups, which = np.unique(batch.column("collection").to_numpy(zero_copy_only=False), return_inverse=True)
                for g, collection in enumerate(groups):
                    mine = np.flatnonzero(which == g)
                    found = [held[collection]] if collection in held else []
                    for a in range(0, len(mine), TILE):
                        cut = mine[a : a + TILE]
                        for b in range(0, len(names), TILE):
                            scores = np.round(matrix[b : b + TILE] @ rows[cut].T, 9)
                            row, at = _best_of_tile(scores, keys[cut], k)
                            found.append((row + b, keys[cut][at], scores[row, at]))
                    row, key, score = (np.concatenate(x) for x in zip(*found))
                    _, at = _first_k(row, np.arange(len(row)), score, key, k)
                    held[collection] = row[at], key[at], score[at]
                if sum(len(x[0]) for x in held.values()) > HELD:
                    yield from done()
            yield from done()

        hits = vectors.select("collection", "chunk_id", "embedding").mapInArrow(best, schema)
        hits = hits if passes == 1 else materialize(hits, "nearest")
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, ["query_id", "pos", "collection"], k, score_order())


def rerank(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, chunk_id, embedding) re-scored by cosine, best ``k`` per query."""
    q = queries.select("query_id", F.col("embedding").alias("_query"))
    scored = candidates.join(q, "query_id").withColumn("score", cosine(F.col("embedding"), F.col("_query")))
    return top_k(scored.drop("_query"), ["query_id"], k, score_order())
