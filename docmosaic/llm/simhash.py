"""SimHash near-duplicates by bit-sliced comparison.

1. Each text becomes a 64-bit fingerprint: a bit is 1 if more than half of the hashes of its
   shingles have it. Documents of one fingerprint form a class; classes are compared.
2. Two fingerprints within the radius agree in all but ``radius`` of ``radius + 2`` bands, so
   they share the bits of some two bands. Those bits are the keys of a fingerprint; only
   fingerprints of one key meet, in tiles of bounded size.
3. In a tile fingerprints stand vertically: plane k holds bit k of 64 fingerprints in a
   word. A query's bit turns the plane into 64 differences, which carry-save adders sum into
   bit counters. The carry out of the last counter says which of the 64 exceed the radius; a
   word whose 64 all do is abandoned and costs nothing for the planes that are left.
4. A tile hands on a spanning star of each component it found, never its pairs; stars make
   the components of all fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.llm.common import ids_and_texts, returning, utf8
from docmosaic.llm.components import components
from docmosaic.llm.tiles import dealt, packs, tiled
from docmosaic.session import materialize

BITS = 64
SEED = 42
BLOCK = 4096
#: Small tiles are compared together up to so many fingerprints; what they find across keys is right as well.
PACK = 256
#: Planes between two looks at what can be abandoned, and cells (a query and a word) at work at once.
PLANES = 8
CELLS = 1 << 15
#: Shingles whose bits are spread out at once.
SLICE = 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: bytes, size: int = 3) -> int:
    """The fingerprint of one text; 0 without words. Repeated shingles count as often as they stand there."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, SLICE):
        part = hashes[k : k + SLICE]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


@returning
def _prints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint_of(x, size) for x in utf8(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "print"])


def fingerprints(docs: DataFrame, *, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print) of every row; the 64 bits are those of a signed number. A null text is empty, empty texts have 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    return ids_and_texts(docs, id_col, text_col).mapInArrow(lambda it: _prints(it, size), f"id {kind}, print bigint")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit k of 64 fingerprints in a row, as words; missing ones are 0."""
    words = -(-len(prints) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, count: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, hits): the words of ``planes`` in which some of 64 fingerprints are within ``radius`` of a query.

    The counters start so far up that one more than the radius carries out of the last of them.
    """
    levels = radius.bit_length()
    start = (1 << levels) - 1 - radius
    words = planes.shape[1]
    row, word = np.repeat(np.arange(len(queries)), words), np.tile(np.arange(words), len(queries))
    over = np.zeros(len(row), np.uint64)
    if count % 64:
        over[word == words - 1] = _ALL << np.uint64(count % 64)
    counters = [np.full(len(row), _ALL if start >> k & 1 else 0, np.uint64) for k in range(levels)]
    step = 1 << levels
    for first in range(0, BITS, step):
        inputs = []
        for k in range(first, first + step):
            flip = np.where(queries >> np.uint64(k) & np.uint64(1), _ALL, np.uint64(0))
            inputs.append(planes[k][word] ^ flip[row])
        for level in range(levels):
            carries = []
            for a, b in zip(inputs[::2], inputs[1::2]):
                held = counters[level]
                half = held ^ a
                carries.append(held & a | half & b)
                counters[level] = half ^ b
            inputs = carries
        over |= inputs[0]
        if (first + step) % PLANES == 0:
            open_ = over != _ALL
            if not open_.all():
                row, word, over = row[open_], word[open_], over[open_]
                counters = [c[open_] for c in counters]
            if not len(row):
                break
    return row, word, ~over


def stars(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least): each fingerprint linked to others here, with one name for all of its component. ``prints`` are distinct."""
    planes = planes_of(prints)
    label = np.arange(len(prints))
    some = max(1, CELLS // planes.shape[1])
    for start in range(0, len(prints), some):
        row, word, hits = within(prints[start : start + some], planes, len(prints), radius)
        own = np.uint64(1) << ((row + start) & 63).astype(np.uint64)
        hits = np.where((row + start) >> 6 == word, hits & ~own, hits)
        kept = hits != 0
        row, word, hits = row[kept], word[kept], hits[kept]
        cuts = np.flatnonzero(np.diff(row)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(row)]))):
            if a == b:
                continue
            bits = np.unpackbits(hits[a:b].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            at, bit = np.nonzero(bits)
            names = np.unique(np.append(label[word[a:b][at] * 64 + bit], label[row[a] + start]))
            if len(names) > 1:
                label[np.isin(label, names[1:])] = names[0]
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return prints[linked], prints[label[linked]]


@returning
def _compared(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for pack in packs(batches, [], ["key", "i", "j"], PACK):
        a, b = stars(np.unique(pack.column("print").to_numpy().view(np.uint64)), radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def keys_of(radius: int) -> list[int]:
    """Masks of the bits of every choice of two among ``radius + 2`` bands."""
    bands = radius + 2
    cuts = [BITS * k // bands for k in range(bands + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(masks, 2)]


def links(prints: DataFrame, *, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints in ``print`` that their components are those of all links."""
    if not 1 <= radius < BITS - 2:
        raise ValueError("the radius must be from 1 to 61")
    signed = [m - (1 << 64) if m >> 63 else m for m in keys_of(radius)]
    keys = [F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(m).cast("bigint"))) for k, m in enumerate(signed)]
    rows = prints.select("print", F.explode(F.array(*keys)).alias("key"))
    tiles = dealt(tiled(rows, ["key"], "print", block), ["key"])
    return tiles.select("key", "i", "j", "print").mapInArrow(lambda it: _compared(it, radius), "a bigint, b bigint")


def members(docs: DataFrame, *, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text",
            block: int = BLOCK) -> DataFrame:
    """(id, print, component): one row per row of the table, ``component`` the smallest id reachable by links.

    A null text is empty; texts without words have fingerprint 0 and link like any other.
    Rows that repeat an id are compared each by its own text. A row without an id gets its
    fingerprint and no component, and names none. An empty table gives an empty one; further
    columns are not read.
    """
    made = materialize(fingerprints(docs, size=size, id_col=id_col, text_col=text_col), "prints")
    classes = materialize(made.where("id is not null").groupBy("print").agg(F.min("id").alias("first")), "print-classes")
    of = components(links(classes.select("print"), radius=radius, block=block))
    labelled = classes.join(of, classes["print"] == of["node"], "left").select(
        "print", "first", F.coalesce("component", "print").alias("c"))
    least = labelled.groupBy("c").agg(F.min("first").alias("component"))
    named = labelled.join(least, "c").select("print", "component")
    return made.join(named, "print", "left").select(
        "id", "print", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
