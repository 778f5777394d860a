"""Benchmark decontamination by training suffix arrays.

Each task cuts its documents into shards of bounded size and builds a suffix array
over the words of a shard. Every suffix of every benchmark item is then looked up
by binary search; what it shares with the shard are ranges of the array, hence
places in documents, and neighbouring places on one diagonal join to the longest
verbatim matches. The array leaves out suffixes that cannot match: those that meet
a word unknown to the benchmark within the shortest window. Words are numbered by
the benchmark, so a suffix is a row of small integers and compares as bytes.

No row is shuffled. The benchmark goes to the tasks in blocks of bounded size, one
after the other over the stream of documents, so it may grow without limit.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmosaic.llm.common import bounded_batches, in_pieces, returning, sheltered, utf8

WINDOW = 10
BLOCK_BYTES = 8 * 1024 * 1024
SHARD_BYTES = 4 * 1024 * 1024
MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

#: A-Z to a-z; digits, a-z and all bytes of other characters stay; the rest separates words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_BREAK = b" \xff "  # no text holds this byte


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Probes:
    """The windows of a block of items, by length, as rows of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        self.items = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                seen[tuple(ids[at : at + size])].append((k, at))
        self.by_size: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
        for size in sorted({len(x) for x in seen}):
            rows = [x for x in seen if len(x) == size]
            self.by_size[size] = (np.array(rows, dtype=np.uint32), [seen[x] for x in rows])
        self.vocabulary[b"\xff"] = -1

    def places(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int]]]]:
        """(length, places, [(item, place in item)]) of each window that occurs in a shard; 0 and -1 match nothing."""
        if not self.by_size or not len(ids):
            return
        least, wide = min(self.by_size), self.window
        known = np.concatenate([ids > 0, np.zeros(wide, bool)])
        padded = np.concatenate([np.maximum(ids, 0), np.zeros(wide, ids.dtype)]).astype(">u4")
        runs = np.cumsum(np.concatenate([[0], known]))
        starts = np.flatnonzero(runs[least : least + len(ids)] - runs[: len(ids)] == least)
        if not len(starts):
            return
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, wide)[starts])
        keys = rows.view(f"S{4 * wide}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], starts[order]
        for size, (windows, owners) in self.by_size.items():
            low = np.zeros((len(windows), wide), ">u4")
            low[:, :size] = windows
            high = np.full((len(windows), wide), 0xFFFFFFFF, ">u4")
            high[:, :size] = windows
            first = np.searchsorted(keys, low.view(f"S{4 * wide}").ravel(), "left")
            last = np.searchsorted(keys, high.view(f"S{4 * wide}").ravel(), "right")
            for j in np.flatnonzero(last > first):
                yield size, np.sort(suffixes[first[j] : last[j]]), owners[j]


def _longest(found: dict[tuple[int, int], list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """Windows on one diagonal of an item, joined: (item, start, length)."""
    out = []
    for (item, _), places in found.items():
        places.sort()
        start, size = places[0]
        end = start + size
        for at, size in places[1:]:
            if at > end:
                out.append((item, start, end - start))
                start, end = at, at + size
            else:
                end = max(end, at + size)
        out.append((item, start, end - start))
    return out


@returning
def _scan(batches: Iterator[pa.RecordBatch], probes, text: str, n: str, hit: str, at: str) -> Iterator[pa.RecordBatch]:
    found = probes.value
    for batch in batches:
        names = batch.schema.names
        texts = utf8(batch.column(names.index(text)))
        counts = np.zeros(len(texts), np.int64)
        matches = batch.column(names.index(at)).to_pylist()
        hits = np.zeros(len(texts), np.int64)
        for lo, hi in in_pieces(texts, SHARD_BYTES):
            words = _BREAK.join(x.translate(_WORDS) for x in texts[lo:hi]).split()
            ids = np.fromiter(map(found.vocabulary.get, words, itertools.repeat(0)), np.int32, len(words))
            breaks = np.flatnonzero(ids == -1)
            first = np.concatenate([[0], breaks + 1])
            counts[lo:hi] = np.concatenate([breaks, [len(ids)]]) - first
            new: dict[int, dict] = defaultdict(lambda: defaultdict(list))
            for size, places, owners in found.places(ids):
                of = np.searchsorted(first, places, "right") - 1
                for doc, place in zip(of.tolist(), (places - first[of]).tolist()):
                    for item, inner in owners:
                        new[doc][item, place - inner].append((place, size))
            for doc, diagonals in new.items():
                matches[lo + doc] = (matches[lo + doc] or []) + [
                    {"item_id": found.items[i], "start": s, "length": k} for i, s, k in _longest(diagonals)
                ]
        for i, spans in enumerate(matches):
            end = 0
            for s, k in sorted((x["start"], x["length"]) for x in spans or ()):
                hits[i] += max(0, s + k - max(s, end))
                end = max(end, s + k)
        new_columns = {n: pa.array(counts), hit: pa.array(hits), at: pa.array(matches, _MATCHES)}
        yield pa.RecordBatch.from_arrays(
            [new_columns.get(c, batch.column(i)) for i, c in enumerate(names)],
            schema=pa.schema([pa.field(c, new_columns[c].type) if c in new_columns else batch.schema.field(c) for c in names]),
        )


def _marked(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int,
            block_bytes: int, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with three more columns: words, hit words, matches."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    n, hit, at = names
    out = docs.withColumns({n: F.lit(0).cast("bigint"), hit: F.lit(0).cast("bigint"), at: F.array().cast(MATCHES)})
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        probes = Probes([(r["item"], r["text"].encode()) for r in block.sort("item", "text").collect()], window)
        shared = spark.sparkContext.broadcast(probes)
        out = out.mapInArrow(lambda it, s=shared: _scan(it, s, text, n, hit, at), out.schema)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, matches): per row of ``docs`` the longest verbatim matches with items.

    ``matches`` has (item_id, start, length) in words; a match is a run of windows of
    ``window`` item words, or a whole shorter item. A null or empty text has no words
    and no match; equal rows get equal results; an empty table of documents gives no
    rows and an empty benchmark no matches. An item without an id is named "".
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _marked(rows, benchmark, "text", item_col, item_text_col, window, block_bytes,
                   ("n_words", "n_hit", "matches")).drop("text")


@sheltered
def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs; columns and other rows stay as they are."""
    names = ("__words", "__hit", "__matches")
    marked = _marked(docs, benchmark, text_col, "item_id", "text", window, block_bytes, names)
    return marked.where(F.col("__hit") == 0).drop(*names)


def item_digest(spans: Column) -> Column:
    """Hex digest of the distinct items of ``matches``, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["item_id"]))), ","), 256)
