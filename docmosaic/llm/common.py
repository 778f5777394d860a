"""What the operators share: inputs, Arrow batches of bounded size, labelled samples, a keyed random stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.session import bounded_batches, returning  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheltered(change: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that adds columns to ``docs``, whose columns with names like its inner ones come to no harm."""

    @wraps(change)
    def run(docs: DataFrame, *args, **kwargs):
        given = {x for v in (*args, *kwargs.values()) for x in ((v,) if isinstance(v, str) else v if isinstance(v, (dict, tuple)) else ())}
        names = {c: f"kept {k} {c}" for k, c in enumerate(docs.columns) if c.startswith("__") and c not in given}
        if not names:
            return change(docs, *args, **kwargs)
        out = change(docs.withColumnsRenamed(names), *args, **kwargs)
        return out.withColumnsRenamed({v: k for k, v in names.items()})

    return run


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or as many underscores before it as it takes to be none of the columns."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) alone, for operators that make rows of their own."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a batch as bytes; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_pieces(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes each, or one longer text."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > most:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield start, len(texts)


def fold(id_col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text, y): up to ``per_class`` labelled rows of each class outside fold 0.

    The rows are those with the smallest hash of the id, so the sample has the same
    size and kind at every scale; only their ids are chosen and sent around. An id
    labelled twice counts once, as 1 if any of its labels is.
    """
    marked = (
        labels.where(F.col(label).isNotNull() & (fold() != 0))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select(F.col("doc_id").alias("id"), "y")
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most 2 * per_class rows of two numbers: a bounded broadcast
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "y")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input number gives an unrelated one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from hashed counters."""
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
