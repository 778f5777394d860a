"""Text embedding as a column, with a deterministic default that needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docmosaic.session import bounded_batches, returning

DIMENSIONS = 64

# A model: texts of one batch to a matrix with one row per text.
Embedder = Callable[[list[str]], np.ndarray]


@lru_cache(maxsize=100_000)
def _bucket(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % DIMENSIONS


def hashed_words(texts: list[str]) -> np.ndarray:
    """Unit vectors of hashed word counts: equal texts get equal vectors on any machine."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in zip(out, texts):
        buckets = [_bucket(w) for w in re.findall("[a-z0-9]+", text)]
        row += np.bincount(buckets, minlength=DIMENSIONS)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def embed(text: Column, model: Embedder = hashed_words) -> Column:
    """``array<float>`` per text. The model gets Arrow batches, so it is loaded once per worker."""

    active = SparkSession.getActiveSession()
    if active is not None:
        bounded_batches(active)

    @F.pandas_udf("array<float>")
    @returning
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist()).astype(np.float32)), index=texts.index)

    return run(F.lower(text))
