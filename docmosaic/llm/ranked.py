"""Ranked lexical search: best-first document intervals bounded by range maxima of posting lists.

Documents are dealt to shards by the hash of their id, so many that each holds about
``POSTINGS`` postings. A shard stores its posting lists one after the other, in the order of
documents, with a sparse table of range maxima over blocks of them and running maxima inside
each block: the largest impact of a list in any interval of documents, and where it is, take
two look-ups. A query starts with the interval of all documents. Of the open intervals those
with the highest bounds (the sum over terms of weight times range maximum) come first; each is
split at the document that has the largest single impact in it, which is scored, or, if it is
short, scored throughout. The search ends when no bound reaches the k-th score.

Counts and weights are those of all shards, so the best of each shard merge into the best of all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmosaic.llm.common import ids_and_texts, returning, utf8
from docmosaic.session import materialize, small_side

POSTINGS = 1_500_000
#: Intervals opened at once, and documents of an interval that is scored throughout.
OPENED = 128
SHORT = 32
_WIDE = 16
_PLACE = np.int64((1 << 32) - 1)

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text: bytes) -> list[str]:
    """Maximal runs of ASCII letters, digits and all beyond ASCII; only A-Z is lower-cased."""
    return _TERM.findall(text.lower().decode("utf-8", "replace"))


@returning
def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Counter(terms_of(x)) for x in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([sum(c.values()) for c in found], pa.int64()), pa.array([len(c) for c in found], pa.int64()),
             pa.array([" ".join(c) for c in found], pa.string()), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
            names=["id", "n", "terms_n", "terms", "counts"])


class Shard:
    """Posting lists of some documents, given in the order in which equal scores rank."""

    def __init__(self, terms: list[str], counts: list[np.ndarray], m: np.ndarray):
        split = [x.split(" ") if x else [] for x in terms]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.array([t for x in split for t in x], pa.string()).dictionary_encode()
        self.number = {t: k for k, t in enumerate(coded.dictionary.to_pylist())}
        self.docs = len(terms)
        doc, tf = np.repeat(np.arange(self.docs), sizes), np.concatenate([np.zeros(0, np.int64), *counts])
        key = coded.indices.to_numpy().astype(np.int64) * self.docs + doc
        order = np.argsort(key)
        self.key = key[order]
        self.impact = (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))[order]
        self._tables()

    def _tables(self):
        """Impact and place in one number, so that its maximum says where the largest impact is."""
        n = -(-max(1, len(self.impact)) // _WIDE) * _WIDE
        self.packed = np.full(n, -1, np.int64)
        self.packed[: len(self.impact)] = self.impact << np.int64(32) | np.arange(len(self.impact))
        blocks = self.packed.reshape(-1, _WIDE)
        self.upto = np.maximum.accumulate(blocks, 1).ravel()
        self.onward = np.maximum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [blocks.max(1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(last, np.concatenate((last[step:], np.full(step, -1, np.int64)))))
        self.table = np.stack(self.levels)

    def most(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The largest packed posting of each range of places lo to hi, -1 for an empty one."""
        out = np.full(lo.shape, -1, np.int64)
        some = hi > lo
        a, b = lo[some], hi[some] - 1
        first, last = a // _WIDE, b // _WIDE
        found = np.full(len(a), -1, np.int64)
        one = first == last
        if one.any():
            at = a[one, None] + np.arange(_WIDE)
            inside = at <= b[one, None]
            found[one] = np.where(inside, self.packed[np.where(inside, at, 0)], -1).max(1)
        two = ~one
        if two.any():
            x, y = first[two] + 1, last[two]
            held = np.maximum(self.onward[a[two]], self.upto[b[two]])
            gap = y - x
            level = np.zeros(len(gap), np.int64)
            wide = gap > 0
            level[wide] = np.frexp(gap[wide].astype(np.float64))[1] - 1
            between = np.maximum(self.table[level, np.minimum(x, self.table.shape[1] - 1)], self.table[level, np.maximum(y - (1 << level), 0)])
            found[two] = np.where(wide, np.maximum(held, between), held)
        out[some] = found
        return out

    def search(self, terms: list[str], weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score): the k best with a score above 0, of equal scores the first documents."""
        numbers = np.array([self.number.get(t, -1) for t in terms], np.int64)
        weights = weights[numbers >= 0]
        base = numbers[numbers >= 0] * self.docs
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(base) or k < 1:
            return docs, scores

        def bounds(lo, hi):
            most = self.most(*(np.searchsorted(self.key, base[:, None] + x) for x in (lo, hi)))
            part = np.where(most < 0, 0, most >> np.int64(32)) * weights[:, None]
            top = part.argmax(0)
            place = most[top, np.arange(len(lo))] & _PLACE
            return part.sum(0), np.where(part.max(0) > 0, self.key[np.minimum(place, len(self.key) - 1)] % self.docs, lo)

        lo, hi = np.zeros(1, np.int64), np.full(1, self.docs, np.int64)
        bound, split = bounds(lo, hi)
        least = 1
        while True:
            open_ = bound >= least
            if len(docs) == k:  # an interval whose bound is the k-th score matters only if it holds earlier documents
                open_ &= (bound > least) | (lo < docs[-1])
            lo, hi, bound, split = lo[open_], hi[open_], bound[open_], split[open_]
            if not len(lo):
                return docs, scores
            first = np.argpartition(-bound, OPENED)[:OPENED] if len(lo) > OPENED else np.arange(len(lo))
            rest = np.ones(len(lo), bool)
            rest[first] = False
            a, b, at = lo[first], hi[first], split[first]
            short = b - a <= SHORT
            from_, to = np.concatenate((a[short], at[~short])), np.concatenate((b[short], at[~short] + 1))
            found, score = self._scored(base, weights, from_, to)
            docs, scores = np.concatenate((docs, found)), np.concatenate((scores, score))
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(docs) == k:
                least = scores[-1]
            a, b, at = a[~short], b[~short], at[~short]
            new_lo, new_hi = np.concatenate((a, at + 1)), np.concatenate((at, b))
            some = new_hi > new_lo
            new_lo, new_hi = new_lo[some], new_hi[some]
            new_bound, new_split = bounds(new_lo, new_hi) if len(new_lo) else (new_lo, new_lo)
            lo, hi = np.concatenate((lo[rest], new_lo)), np.concatenate((hi[rest], new_hi))
            bound, split = np.concatenate((bound[rest], new_bound)), np.concatenate((split[rest], new_split))

    def _scored(self, base, weights, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the intervals with a score above 0, and that score."""
        width = int((hi - lo).max())
        a, b = (np.searchsorted(self.key, base[:, None] + x) for x in (lo, hi))
        term, which = np.nonzero(b > a)
        a, n = a[term, which], (b - a)[term, which]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        which = np.repeat(which, n)
        doc = self.key[at] - np.repeat(base[term], n)
        cell = which * width + doc - lo[which]
        # sums of 64-bit integers, not of floats
        total = np.zeros(len(lo) * width, np.int64)
        np.add.at(total, cell, self.impact[at] * np.repeat(weights[term], n))
        found = np.flatnonzero(total > 0)
        return lo[found // width] + found % width, total[found]


@returning
def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a shard: first its documents, in order, then the queries."""
    at, shard, parts = None, None, []
    for batch in batches:
        names = batch.column("shard").to_numpy()
        kinds = batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(names) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            rows = batch.slice(a, b - a)
            if names[a] != at:
                at, shard, parts = names[a], None, []
            if kinds[a] == 0:
                parts.append(rows)
                continue
            if not parts:
                continue
            if shard is None:
                held = pa.Table.from_batches(parts)
                ids = held.column("id").combine_chunks()
                shard = Shard(held.column("terms").to_pylist(), [np.array(x, np.int64) for x in held.column("counts").to_pylist()],
                              held.column("m").to_numpy())
                del held
            for item, terms, weights in zip(rows.column("item"), rows.column("terms").to_pylist(), rows.column("counts").to_pylist()):
                docs, scores = shard.search(terms.split(" ") if terms else [], np.array(weights, np.int64), k)
                if len(docs):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()] * len(docs), item.type), ids.take(pa.array(docs)), pa.array(scores)],
                        names=["item", "id", "score"])


class LexicalIndex:
    """Term vectors of all documents as a written table, with the counts that scores need.

    A null text has no terms; documents without terms count nowhere. Documents without an id
    count, but are never found. Rows that repeat an id count and are found each by its own
    text. An empty table finds nothing.
    """

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"):
        self.kind = docs.schema[id_col].dataType.simpleString()
        made = ids_and_texts(docs, id_col, text_col).mapInArrow(
            _vectors, f"id {self.kind}, n bigint, terms_n bigint, terms string, counts array<bigint>")
        self.vectors = materialize(made.where("n > 0"), "term-vectors")
        self.documents, self.terms, self.postings = (x or 0 for x in self.vectors.agg(F.count(F.lit(1)), F.sum("n"), F.sum("terms_n")).first())

    def weights(self, asked: DataFrame) -> DataFrame:
        """(term, df, weight) of the terms of ``asked`` that documents hold."""
        known = small_side(asked.select("term").distinct())
        df = (self.vectors.select(F.explode(F.split("terms", " ")).alias("term")).join(known, "term")
              .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        return df.withColumn("weight", F.floor(1000 * F.log(F.lit(2.0 * self.documents + 2) / (2 * F.col("df") + 1))).cast("bigint"))

    def search(self, items: DataFrame, *, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """(item, rank, id, score): the ``k`` best documents of each item by the terms of its text, equal scores by id.

        Rows that repeat an item's id and text count once; further texts of one id add
        their terms. Rows without an id are not asked; null texts and texts of unknown
        terms find nothing.
        """
        item_kind = items.schema[item_col].dataType.simpleString()
        rows = ids_and_texts(items.where(F.col(item_col).isNotNull()), item_col, text_col).distinct().mapInArrow(
            _vectors, f"id {item_kind}, n bigint, terms_n bigint, terms string, counts array<bigint>").where("n > 0")
        asked = rows.select(F.col("id").alias("item"), F.explode(F.arrays_zip(F.split("terms", " ").alias("t"), F.col("counts").alias("c"))).alias("z"))
        asked = materialize(asked.groupBy("item", F.col("z.t").alias("term")).agg(F.sum("z.c").alias("times")), "asked")
        weighed = asked.join(self.weights(asked), "term").where("weight > 0")
        # one row for each item: as large as its own text
        queries = weighed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("times") * F.col("weight")).alias("w")))).alias("q"))
        queries = materialize(queries.select("item", F.array_join(F.col("q.term"), " ").alias("terms"), F.col("q.w").alias("counts")), "queries")

        shards = max(1, -(-self.postings // POSTINGS))
        m = F.expr(f"75 + (25L * n * {self.documents}L) div {max(1, self.terms)}L")
        kept = self.vectors.where("id is not null").select(
            F.pmod(F.xxhash64("id", "n"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id",
            F.lit(None).cast(item_kind).alias("item"), m.cast("bigint").alias("m"), "terms", "counts")
        each = queries.select(
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast(self.kind).alias("id"),
            "item", F.lit(None).cast("bigint").alias("m"), "terms", "counts")
        dealt = kept.unionByName(each).repartition("shard").sortWithinPartitions("shard", "kind", "id")
        found = dealt.mapInArrow(lambda it: _searched(it, k), f"item {item_kind}, id {self.kind}, score bigint")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "id", "score")
