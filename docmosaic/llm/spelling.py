"""Spelling variants by dense prefix-suffix tiling.

Two different words are one edit apart exactly if the lengths of their longest common prefix
and suffix reach the longer length minus one. Words of a tile become padded code-point
matrices, and both lengths are found for all pairs of two blocks at once, column by column
until no pair of the tiles is still alike.

Which blocks have to meet: let L be the longer length and h = L // 2. If the edit lies behind
the first h code points, both words begin with the same h; otherwise both end with the same
L - h. So a word of n code points stands in the groups (L, prefix) and (L, suffix) for L = n
and L = n + 1. A suffix tile leaves out pairs that share the first h code points, so a pair is
found in one group only. Large groups are cut into blocks; a tile hands on, for each word, how
many near words it has and the best of them, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.llm.common import ids_and_texts, returning, utf8
from docmosaic.llm.tiles import dealt, packs, tiled
from docmosaic.session import materialize

BLOCK = 2048
PACK = 256
#: Rows of one side of a matrix at work, and columns turned into code points at once.
ROWS = 512
COLUMNS = 16
#: Different words a task counts before it hands them on.
WORDS = 200_000

_RUN = re.compile("[a-zÀ-ÿ]+")


def words_of(text: bytes) -> list[str]:
    """Maximal runs of letters, only A-Z lower-cased."""
    return _RUN.findall(text.lower().decode("utf-8", "replace"))


@returning
def _counted(batches: Iterator[pa.RecordBatch], one_in: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def done():
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                           names=["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            found = Counter(words_of(text))
            if name is not None and one_in and found:
                start = zlib.crc32(f"{name}:".encode())
                for w, b in zip(list(found), "\n".join(found).encode().split(b"\n")):
                    h = zlib.crc32(b, start)
                    if h % one_in == 0:
                        at, n = h % len(w), found.pop(w)
                        counts[w[:at] + w[at + 1 :]] += n
            for w, n in found.items():
                counts[w] += n
            if len(counts) >= WORDS:
                yield done()
    if counts:
        yield done()


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", one_in: int = 0) -> DataFrame:
    """(word, n) over whole texts. A null text has no words.

    With ``one_in``, misspellings are planted: where it divides h, the crc32 of
    ``<id>:<word>``, the word loses its code point h modulo its length. Words of rows
    without an id stay as they are.
    """
    rows = ids_and_texts(docs, id_col, text_col).withColumn("id", F.col("id").cast("string"))
    return rows.mapInArrow(lambda it: _counted(it, one_in), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str], first: int) -> np.ndarray:
    """Columns ``first`` to ``first + COLUMNS`` of the words as code points, 0 beyond their ends."""
    cut = "".join(w[first : first + COLUMNS].ljust(COLUMNS, "\0") for w in words)
    return np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), COLUMNS)


def common(x: list[str], y: list[str]) -> np.ndarray:
    """Length of the common prefix of each of ``x`` with each of ``y``."""
    out, alive = np.zeros((len(x), len(y)), np.int32), np.ones((len(x), len(y)), bool)
    for first in range(0, min(max(map(len, x)), max(map(len, y))), COLUMNS):
        a, b = _codes(x, first), _codes(y, first)
        for k in range(COLUMNS):
            alive &= (a[:, k, None] == b[None, :, k]) & (a[:, k, None] != 0)
            if not alive.any():
                return out
            out += alive
    return out


def near(x: list[str], y: list[str], longer: int, half: int, by_prefix: bool) -> np.ndarray:
    """Which of ``x`` (of ``longer`` code points) and ``y`` (as many or one less) are one edit apart, and found by this side."""
    before = common(x, y)
    found = before + common([w[::-1] for w in x], [w[::-1] for w in y]) >= longer - 1
    return found & (before < longer) & ((before >= half) if by_prefix else (before < half))


def _tile(words: list[str], counts: np.ndarray, own: np.ndarray, cross: np.ndarray, longer: int, by_prefix: bool):
    """(row, near words, row of the best) of the words in a pack. ``cross`` rows meet only rows of the other block."""
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
    words, own, cross = [words[k] for k in order], own[order], cross[order]
    long = np.fromiter((len(w) == longer for w in words), bool, len(words))
    total, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    everyone, half = np.arange(len(words)), longer // 2
    for a in range(0, len(words), ROWS):
        mine = everyone[a : a + ROWS][long[a : a + ROWS]]
        if not len(mine):
            continue
        hit = near([words[k] for k in mine], words, longer, half, by_prefix)
        if cross.any():
            hit &= ~(cross[mine, None] & (own[mine, None] == own[None, :]))
        # of two words of this length each finds the other; a shorter one is found by the longer alone
        total[mine] += hit.sum(1)
        total[~long] += hit.sum(0)[~long]
        some = hit.any(1)
        best[mine[some]] = np.minimum(best[mine[some]], hit[some].argmax(1))
        some = hit.any(0) & ~long
        best[some] = np.minimum(best[some], mine[hit[:, some].argmax(0)])
    found = np.flatnonzero(total)
    at = np.array(order)
    return at[found], total[found], at[best[found]]


@returning
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pack in packs(batches, ["longer", "side"], ["longer", "side", "key", "i", "j"], PACK):
        words, counts = pack.column("word").to_pylist(), pack.column("n").to_numpy()
        own = pack.column("own").to_numpy()
        cross = pack.column("i").to_numpy() != pack.column("j").to_numpy()
        row, n_near, best = _tile(words, counts, own, cross, pack.column("longer")[0].as_py(), pack.column("side")[0].as_py() == 0)
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[k] for k in row]), pa.array(n_near), pa.array([words[k] for k in best]), pa.array(counts[best])],
                names=["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of the words of (word, n) that have near words; ``form`` is the commonest of those."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(*[
        F.struct((length + more).alias("longer"), F.lit(side).alias("side"))
        for more in (0, 1) for side in (0, 1)])).alias("g")).select("word", "n", "g.*")
    half = F.floor(F.col("longer") / 2).cast("int")
    key = F.when(F.col("side") == 0, F.substring("word", F.lit(1), half)).otherwise(
        F.substring("word", F.length("word") - (F.col("longer") - half) + 1, F.col("longer") - half))
    rows = rows.withColumn("key", F.xxhash64(key))
    keys = ["longer", "side", "key"]
    tiles = dealt(tiled(rows, keys, "word", block), keys)
    parts = tiles.select(*keys, "i", "j", "own", "word", "n").mapInArrow(
        _compared, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def variants(words: DataFrame, *, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the rows (word, n), whose words differ.

    ``form`` is the near word of the largest n (of equal ones the smallest in code-point
    order) if that is at least ``ratio`` times the word's; ``root`` is where forms lead to in
    the end. Null words are left out; an empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("forms end only if each is commoner: the ratio must be 2 or more")
    words = materialize(words.where("word is not null and word <> '' and n > 0").select("word", "n"), "words")
    found = words.join(near_words(words, block=block), "word", "left")
    kept = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    found = materialize(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("form")).alias("form"),
        F.when(kept, F.col("form_n")).alias("form_n")), "forms")
    # each step doubles how far a word looks along its chain; n grows with every form, so chains are short
    at = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            break
        at = at.select("word", "root")
    return found.join(at.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
