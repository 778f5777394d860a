"""Vector search by cells: vectors lie in folders by their nearest centre, a search opens the cells it needs.

With no number of probes the result is exact: the nearest cells give every query a k-th best
score to beat, and only cells whose bound reaches it are opened afterwards. The bound of a cell
is an angle: no vector of the cell is nearer to the query than the query's angle to the centre
less the widest angle between the centre and a vector of the cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.operators import vector
from docmosaic.operators.ranking import score_order, top_k
from docmosaic.session import materialize, shared_path

# Centres are fitted on at most this many vectors, the first by a hash of their ids; every vector gets a cell.
SAMPLE_ROWS = 20_000
SAMPLE_PER_CELL = 16
ROUNDS = 12
# Cells that an exact search opens before it knows which others it needs.
FIRST_PROBES = 4
# Allowance for rounding in bounds.
SLACK = 1e-6
# Queries of one pass, and the vectors of a tile of scores.
BLOCK_QUERIES = 8192
TILE = 4096


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample; a centre that loses all its rows stays where it was."""
    rows = vector._unit(sample)
    rows = rows[np.einsum("ij,ij->i", rows, rows) > 0.5]
    if not len(rows):
        return np.zeros((1, sample.shape[1]))
    centres = rows[np.unique(np.linspace(0, len(rows) - 1, cells).astype(int))].copy()
    for _ in range(ROUNDS):
        near = np.argmax(rows @ centres.T, 1)
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(len(centres)))
        filled = np.flatnonzero(np.diff(np.append(starts, len(rows))))
        sums = np.add.reduceat(rows[order], starts[filled], 0)
        norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        sound = norms > 1e-6
        centres[filled[sound]] = sums[sound] / norms[sound, None]
    return centres


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class CellIndex:
    """Vectors (chunk_id, embedding) of one length, written by cell.

    A null or empty vector is in no cell and in no result. ``cells`` is about the square
    root of the number of vectors unless given; a sample row count a sixteenth of which is
    less bounds it, so that the centres that go to tasks stay small. A crowded cell is many
    files, so it is many tasks of a search.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, path: str | None = None) -> None:
        spark = vectors.sparkSession
        self.path = path or shared_path(spark, "cells")
        kept = vectors.where("size(embedding) > 0").select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
        total = kept.count()
        wanted = max(1, min(cells or round(math.sqrt(total)), sample_rows // SAMPLE_PER_CELL))
        rows = kept.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows).collect()
        sample = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1 if rows else 1)
        centres = _centres(sample, wanted)
        shared = spark.sparkContext.broadcast(centres)
        kind = dict(kept.dtypes)["chunk_id"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), TILE):
                    part = batch.slice(at, TILE)
                    near = vector._unit(_matrix(part.column("embedding"))) @ shared.value.T
                    cell = np.argmax(near, 1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("chunk_id"), part.column("embedding"),
                         pa.array(near[np.arange(len(part)), cell]), pa.array(cell.astype(np.int32))],
                        names=["chunk_id", "embedding", "near", "cell"])

        placed = kept.mapInArrow(assign, f"chunk_id {kind}, embedding array<float>, near double, cell int")
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.path}/vectors")
        self._attach(spark, kind)
        widest = {r.cell: (r.near, r.n) for r in self.vectors.groupBy("cell").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("n")).collect()}
        table = [(i, [float(x) for x in c], float(widest[i][0]), int(widest[i][1])) for i, c in enumerate(centres) if i in widest]
        spark.createDataFrame(table, self.CENTRES).coalesce(1).write.parquet(f"{self.path}/centres")
        self._load(spark)

    CENTRES = "cell int, centre array<double>, near double, n bigint"

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        """The index written at ``path``."""
        self = cls.__new__(cls)
        self.path = path
        self._attach(spark, dict(spark.read.parquet(f"{path}/vectors").dtypes)["chunk_id"])
        self._load(spark)
        return self

    def _attach(self, spark: SparkSession, kind: str) -> None:
        schema = f"chunk_id {kind}, embedding array<float>, near double, cell int"
        self.vectors = spark.read.schema(schema).parquet(f"{self.path}/vectors")

    def _load(self, spark: SparkSession) -> None:
        rows = spark.read.schema(self.CENTRES).parquet(f"{self.path}/centres").orderBy("cell").collect()
        self.cells = np.array([r.cell for r in rows], np.int32)
        self.centres = np.array([r.centre for r in rows], np.float64).reshape(len(rows), -1 if rows else 1)
        # a little wider than measured, for rounding
        self.width = _angle(np.array([r.near for r in rows]) - SLACK)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank): the ``k`` closest vectors of every query (query_id, embedding).

        With ``probes`` only that many nearest cells of a query are opened; without, as many as an
        exact result takes. A query that is null or empty has no result.
        """
        asked = queries.where("size(embedding) > 0").select("query_id", "embedding")
        if not len(self.cells):
            none = f"query_id {dict(asked.dtypes)['query_id']}, chunk_id {dict(self.vectors.dtypes)['chunk_id']}, score double, rank int"
            return queries.sparkSession.createDataFrame([], none)
        passes = max(1, -(-asked.count() // BLOCK_QUERIES))
        if passes > 1:
            asked = materialize(asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(passes))), "queries")
        out = None
        for p in range(passes):
            block = asked.where(F.col("part") == p) if passes > 1 else asked
            hits = self._block(block.orderBy("query_id").collect(), dict(asked.dtypes)["query_id"], k, probes)  # about BLOCK_QUERIES vectors
            hits = hits if passes == 1 else materialize(hits, "nearest")
            out = hits if out is None else out.unionByName(hits)
        return out

    def _block(self, rows: list, kind: str, k: int, probes: int | None) -> DataFrame:
        ids = [r.query_id for r in rows]
        matrix = vector._unit(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), self.centres.shape[1]))
        near = matrix @ self.centres.T
        order = np.argsort(-near, 1, kind="stable")
        opened = np.zeros(near.shape, bool)
        np.put_along_axis(opened, order[:, : FIRST_PROBES if probes is None else probes], True, 1)
        first = self._scan(ids, kind, matrix, opened, k)
        if probes is not None or opened.all():
            return top_k(first, ["query_id"], k, score_order())
        first = materialize(top_k(first, ["query_id"], k, score_order()).drop("rank"), "first-cells")
        # k-th best so far; a query with fewer hits opens every cell
        known = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        least = {r.query_id: r.least for r in known.collect()}  # one row for each query of the block
        floor = np.array([least.get(i, -2.0) for i in ids])
        bound = np.cos(np.maximum(_angle(near) - self.width, 0.0)) + SLACK
        rest = (bound >= floor[:, None]) & ~opened
        if not rest.any():
            return top_k(first, ["query_id"], k, score_order())
        return top_k(first.unionByName(self._scan(ids, kind, matrix, rest, k)), ["query_id"], k, score_order())

    def _scan(self, ids: list, kind: str, matrix: np.ndarray, opened: np.ndarray, k: int) -> DataFrame:
        """Each task's ``k`` best of every query among the vectors of the cells that the query opens."""
        spark = self.vectors.sparkSession
        wanted = opened.any(0)
        askers = {int(c): np.flatnonzero(opened[:, i]) for i, c in enumerate(self.cells) if wanted[i]}
        shared = spark.sparkContext.broadcast((ids, matrix, askers))
        keys = dict(self.vectors.dtypes)["chunk_id"]
        typed = {"string": pa.string(), "int": pa.int32()}

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, queries, by_cell = shared.value
            held = None
            for batch in batches:
                which = batch.column("cell").to_numpy()
                found = [held] if held is not None else []
                unit, key = vector._unit(_matrix(batch.column("embedding"))), batch.column("chunk_id").to_numpy(zero_copy_only=False)
                for cell in np.unique(which):
                    mine, asking = np.flatnonzero(which == cell), by_cell[int(cell)]
                    for a in range(0, len(mine), TILE):
                        cut = mine[a : a + TILE]
                        for b in range(0, len(asking), vector.TILE):
                            some = asking[b : b + vector.TILE]
                            scores = np.round(queries[some] @ unit[cut].T, 9)
                            row, at = vector._best_of_tile(scores, key[cut], k)
                            found.append((some[row], key[cut][at], scores[row, at]))
                if found:
                    row, hit, score = (np.concatenate(x) for x in zip(*found))
                    _, at = vector._first_k(row, np.arange(len(row)), score, hit, k)
                    held = row[at], hit[at], score[at]
            if held is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in held[0]], typed.get(kind, pa.int64())), pa.array(held[1], typed.get(keys, pa.int64())), pa.array(held[2])],
                    names=["query_id", "chunk_id", "score"])

        parts = self.vectors.where(F.col("cell").isin(sorted(askers))).select("cell", "chunk_id", "embedding")
        return parts.mapInArrow(best, f"query_id {kind}, chunk_id {keys}, score double")
