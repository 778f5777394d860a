"""Language-model scores by an interpolated modified Kneser-Ney bigram model.

Spark counts in three shuffles of packed arrays: words by hash, word pairs, and what pairs
say about their words (totals and numbers of followers for contexts, numbers of different
predecessors for continuations). Each reduced part is written to the shared folder as a
sorted array; workers map those files into memory and look keys up by binary search.

A word's number is its place in the sorted hashes, so a pair is one 64-bit key. Pairs are
dealt by their context; a context with more than its share of words is cut by the second
word, so that no task gets a frequent word's pairs whole.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.llm.common import bounded_batches, ids_and_texts, in_pieces, mixed, utf8
from docmosaic.llm.shingles import WordHashes, words_of
from docmosaic.session import checkpoint_dir

END = b"\n"  # no word has it
WORDS_PER_PART = 1_500_000
HELD_KEYS = 4_000_000
PIECE_BYTES = 4 * 1024 * 1024
_MAPS: dict = {}


@dataclass(frozen=True)
class Store:
    """Arrays in a folder that the driver and all executors share."""

    uri: str

    def _fs(self):
        from pyarrow import fs

        if urlparse(self.uri).scheme:
            return fs.FileSystem.from_uri(self.uri)
        return fs.LocalFileSystem(), self.uri

    def write(self, name: str, values: np.ndarray) -> None:
        """Under another name first, so that a file that is there is whole."""
        where, path = self._fs()
        where.create_dir(path, recursive=True)
        half = f"{path}/.{name}-{uuid.uuid4().hex}"
        with where.open_output_stream(half) as out:
            out.write(np.ascontiguousarray(values).data if len(values) else b"")
        where.move(half, f"{path}/{name}")

    def map(self, name: str, dtype) -> np.ndarray:
        """The array, mapped into memory; from a copy of the task's own where the folder is not a local file system."""
        if (self.uri, name) not in _MAPS:
            from pyarrow import fs

            where, path = self._fs()
            found = where.get_file_info(f"{path}/{name}")
            if found.type == fs.FileType.NotFound or not found.size:
                _MAPS[self.uri, name] = np.zeros(0, dtype)
            elif isinstance(where, fs.LocalFileSystem):
                _MAPS[self.uri, name] = np.memmap(f"{path}/{name}", dtype, "r")
            else:
                import tempfile

                copy = tempfile.NamedTemporaryFile(delete=False)
                with where.open_input_stream(f"{path}/{name}") as source:
                    while block := source.read(1 << 24):
                        copy.write(block)
                copy.close()
                _MAPS[self.uri, name] = np.memmap(copy.name, dtype, "r")
        return _MAPS[self.uri, name]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts, heads)


def _parted(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, with its rows in their order: one sort, whatever the number of parts."""
    small = part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part
    order = np.argsort(small, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
        yield int(part[rows[0]]), rows


class _Counter:
    """Keys with their counts, condensed whenever many have come in."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > HELD_KEYS and len(self.parts) > 1:
            self.parts = [self.result()]
            self.held = len(self.parts[0][0]) // 2

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return _summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]).astype(np.int64))


_PACKED = "part int, keys binary, counts binary"


def _dealt(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part[rows[0]]], pa.int32()), "keys": pa.array([keys[rows].tobytes()], pa.binary()),
            "counts": pa.array([counts[rows].astype(np.uint32).tobytes()], pa.binary())})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(part, columns) of rows that are sorted by their first column."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at and held:
                yield at, list(zip(*held))
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, list(zip(*held))


def _together(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(counts), np.uint32).astype(np.int64))


@dataclass
class Model:
    """What scoring needs besides the written arrays: sizes, and discounts of both orders."""

    store: Store
    parts: int
    starts: list[int] = field(default_factory=list)  # number of the first word of each part
    tokens: int = 0
    pair_parts: int = 1
    range_size: int = 1
    pair_discounts: tuple[float, ...] = ()
    word_discounts: tuple[float, ...] = ()
    pairs: int = 0
    base_share: float = 1.0

    @property
    def words(self) -> int:
        return self.starts[-1]

    # -- numbers of words ------------------------------------------------

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; one past the last word for BOS is ``words``, unknown is ``words + 1``."""
        out = np.full(len(hashes), self.words + 1, np.int64)
        part = (hashes >> np.uint64(48)).astype(np.int64) * self.parts >> 16
        for p, rows in _parted(part):
            known = self.store.map(f"words-{p}", np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[rows]), len(known) - 1)
                hit = known[at] == hashes[rows]
                out[rows[hit]] = at[hit] + self.starts[p]
        return out

    def _of_numbers(self, name: str, dtype, numbers: np.ndarray, starts: list[int]) -> np.ndarray:
        """Values of an array that lies in parts, 0 beyond its end."""
        out = np.zeros(len(numbers), dtype)
        part = np.searchsorted(starts, numbers, "right") - 1
        for p, rows in _parted(part):
            values = self.store.map(f"{name}-{p}", dtype)
            at = numbers[rows] - starts[p]
            inside = at < len(values)
            out[rows[inside]] = values[at[inside]]
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        return self._of_numbers("counts", np.uint32, numbers, self.starts[:-1]).astype(np.int64)

    def pair_part(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where a pair is counted: by its first word, or several places for a frequent one."""
        share = max(1, self.tokens // (4 * self.pair_parts))
        cut = np.minimum(self.counts(first) // share + 1, self.pair_parts)
        return (mixed(first.astype(np.uint64) * np.uint64(4099) + (second % cut).astype(np.uint64)) % np.uint64(self.pair_parts)).astype(np.int64)

    # -- probabilities -----------------------------------------------------

    def _about(self, name: str, dtype, numbers: np.ndarray) -> np.ndarray:
        starts = list(range(0, self.words + 2, self.range_size))
        return self._of_numbers(name, dtype, numbers, starts)

    def log10(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 of P(second | first) for pairs of numbers."""
        key = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        found = np.zeros(len(key), np.int64)
        part = self.pair_part(first, second)
        for p, rows in _parted(part):
            known = self.store.map(f"pairs-{p}", np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, key[rows]), len(known) - 1)
                hit = known[at] == key[rows]
                found[rows[hit]] = self.store.map(f"pair_counts-{p}", np.uint32)[at[hit]]
        d, w = np.array([0.0, *self.pair_discounts]), np.array([0.0, *self.word_discounts])
        new = np.diff(first, prepend=-1) != 0  # pairs in order have one first word after the other
        context, of = first[new], np.cumsum(new) - 1
        uses = self._about("uses", np.int64, context).astype(float)
        followers = [self._about(f"followers{k}", np.uint32, context) for k in (1, 2, 3)]
        spread = np.where(uses > 0, sum(d[k] * n for k, n in zip((1, 2, 3), followers)) / np.maximum(uses, 1), 1.0)
        uses, spread = uses[of], spread[of]
        before = self._about("before", np.uint32, second).astype(np.int64)
        lower = (before - w[np.minimum(before, 3)]) / max(self.pairs, 1) + self.base_share / (self.words + 1)
        return np.log10((found - d[np.minimum(found, 3)]) / np.maximum(uses, 1) + spread * lower)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of entries seen once to four times; fixed ones where some are missing."""
    n1, n2, n3, n4 = n
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), found))


class _Numbers:
    """Numbers of a batch's tokens, with the words of a task remembered."""

    def __init__(self, model: Model):
        self.model, self.known, self.hashes = model, {}, WordHashes()

    def of(self, tokens: list[bytes]) -> np.ndarray:
        new = list(set(tokens).difference(self.known))
        if len(self.known) + len(new) > 500_000:
            self.known = {}
            new = list(set(tokens))
        found = self.model.numbers(np.fromiter(map(self.hashes.__getitem__, new), np.uint64, len(new)))
        self.known.update(zip(new, found.tolist()))
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))


def _pairs_of(texts: list[bytes], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second words of all pairs, and where each text begins; every text ends with END and begins after BOS."""
    tokens, starts = [], []
    for x in texts:
        starts.append(len(tokens))
        tokens.extend(words_of(x))
        tokens.append(END)
    second = numbers.of(tokens)
    first = np.concatenate([[0], second[:-1]])
    first[starts] = numbers.model.words
    return first, second, np.array(starts)


def fit(texts: DataFrame) -> Model:
    """A model of the column ``text`` of ``texts``: whole texts, words and one end each; null is an empty text."""
    spark = texts.sparkSession
    bounded_batches(spark)
    texts = texts.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(max(4, min(4096, size // (16 << 20))))
    model = Model(Store(f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/kneser-ney-{uuid.uuid4().hex}"), parts)
    store = model.store

    def words(batches):
        hashes, counter = WordHashes(), _Counter()
        for batch in batches:
            for lo, hi in in_pieces(rows := utf8(batch.column(0)), PIECE_BYTES):
                tokens = list(itertools.chain.from_iterable((*words_of(x), END) for x in rows[lo:hi]))
                counter.add(np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens)))
        keys, counts = counter.result()
        yield from _dealt(keys, counts, (keys >> np.uint64(48)).astype(np.int64) * parts >> 16)

    def reduce_words(batches):
        for part, (keys, counts) in _groups(batches):
            k, c = _together(keys, counts)
            store.write(f"words-{part}", k)
            store.write(f"counts-{part}", c.astype(np.uint32))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "words": pa.array([len(k)]), "tokens": pa.array([int(c.sum())])})

    by_part = lambda df: df.repartition("part").sortWithinPartitions("part")
    done = by_part(texts.mapInArrow(words, _PACKED)).mapInArrow(reduce_words, "part int, words bigint, tokens bigint").collect()
    sizes = dict.fromkeys(range(parts), 0) | {r["part"]: r["words"] for r in done}
    model.starts = [0, *np.cumsum([sizes[p] for p in range(parts)]).tolist()]
    model.tokens = sum(r["tokens"] for r in done)
    model.pair_parts = int(max(4, min(65536, model.tokens // WORDS_PER_PART)))
    model.range_size = max(1 << 16, -(-(model.words + 2) // parts))

    def pairs(batches):
        numbers, counter = _Numbers(model), _Counter()
        for batch in batches:
            for lo, hi in in_pieces(rows := utf8(batch.column(0)), PIECE_BYTES):
                first, second, _ = _pairs_of(rows[lo:hi], numbers)
                counter.add((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64))
        keys, counts = counter.result()
        yield from _dealt(keys, counts, model.pair_part((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)))

    def reduce_pairs(batches):
        """Rows (range of words, facts): contexts as (word, uses, followers seen once, twice, more), then (word, predecessors)."""
        for part, (keys, counts) in _groups(batches):
            k, c = _together(keys, counts)
            store.write(f"pairs-{part}", k)
            store.write(f"pair_counts-{part}", c.astype(np.uint32))
            first, second = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            sums = [np.add.reduceat(x.astype(np.int64), heads) for x in (c, c == 1, c == 2, c > 2)]
            contexts = np.column_stack([first[heads], *sums])
            words_, before = np.unique(second, return_counts=True)
            seen = np.column_stack([words_, before])
            times = np.array([(c == n).sum() for n in (1, 2, 3, 4)], np.int64)
            yield _facts_row(-1, "times", times)
            for kind, table in (("contexts", contexts), ("before", seen)):
                where = table[:, 0] // model.range_size
                for rows in np.split(np.arange(len(table)), np.flatnonzero(np.diff(where)) + 1):
                    yield _facts_row(int(where[rows[0]]), kind, table[rows].astype(np.uint32 if kind == "before" else np.int64))

    def reduce_facts(batches):
        for r, (kinds, blobs) in _groups(batches):
            if r < 0:
                times = np.sum([np.frombuffer(b, np.int64) for b in blobs], axis=0)
                yield _facts_row(-1, "pairs", times)
                continue
            base, n = r * model.range_size, model.range_size
            sums = np.zeros((4, n), np.int64)
            before = np.zeros(n, np.int64)
            for kind, blob in zip(kinds, blobs):
                if kind == "contexts":
                    t = np.frombuffer(blob, np.int64).reshape(-1, 5)
                    sums[:, t[:, 0] - base] += t[:, 1:].T  # words of one row differ
                else:
                    t = np.frombuffer(blob, np.uint32).reshape(-1, 2).astype(np.int64)
                    before[t[:, 0] - base] += t[:, 1]
            store.write(f"uses-{r}", sums[0])
            for k in (1, 2, 3):
                store.write(f"followers{k}-{r}", sums[k].astype(np.uint32))
            store.write(f"before-{r}", before.astype(np.uint32))
            yield _facts_row(r, "words", np.array([*((before == k).sum() for k in (1, 2, 3, 4)), (before > 2).sum(), before.sum()], np.int64))

    counted = by_part(texts.mapInArrow(pairs, _PACKED)).mapInArrow(reduce_pairs, _FACTS)
    facts = counted.repartition("range").sortWithinPartitions("range").mapInArrow(reduce_facts, _FACTS).collect()
    of = lambda kind, n: np.sum([np.zeros(n, np.int64), *(np.frombuffer(r["blob"], np.int64) for r in facts if r["kind"] == kind)], axis=0)
    model.pair_discounts = discounts(of("pairs", 4).tolist())
    n1, n2, n3, n4, more, model.pairs = of("words", 6).tolist()
    model.word_discounts = discounts([n1, n2, n3, n4])
    d = model.word_discounts
    model.base_share = (d[0] * n1 + d[1] * n2 + d[2] * more) / model.pairs if model.pairs else 1.0
    return model


_FACTS = "range int, kind string, blob binary"


def _facts_row(r: int, kind: str, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "kind": pa.array([kind]), "blob": pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())})


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for each row, log10 over all words and the end.

    ``base_score`` is that of single words with half a count added. A null or empty text is
    its end alone; equal texts score equally; an empty table gives no rows, and a model of
    an empty table knows no word.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        numbers = _Numbers(m)
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for lo, hi in in_pieces(texts, PIECE_BYTES):
                first, second, starts = _pairs_of(texts[lo:hi], numbers)
                counts = m.counts(second)
                base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
                keys, back = np.unique((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), return_inverse=True)
                own = m.log10((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))[back]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(np.diff(np.append(starts, len(second)))),
                     pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                     pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(own, starts))],
                    names=["id", "n_tokens", "n_known", "base_score", "score"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(
        run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
