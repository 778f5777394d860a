"""N-gram Jaccard join: rare-first prefix filtering, then length, positional and suffix filters.

1. Each text becomes a set of shingle hashes. Texts with equal sets form a class and are
   never compared; a class is its set's 64-bit hash together with its size.
2. Shingles are put in one global order, rare first, by a count sketch of fixed size over
   all documents (any fixed order gives the same result; a good one gives fewer candidates).
3. A set misses at most ``n - ceil(t n)`` of its shingles in any set it links with. All shingles
   up to one place of the global order, the same for all sets, are counted in Bloom filters by
   shingle and size; a set that has more of them to itself among sets of its size links with
   nothing and travels no further. This is done once for texts and again for the classes left.
4. The first ``n - ceil(t n) + 1`` shingles of a set are posted, as far as others have them, with
   a bitmap of the set: bit k says whether an odd number of its shingles falls to k. Classes that
   share a shingle are candidates, if their sizes allow it, if enough can follow the first shared
   position, and if their bitmaps differ in no more bits than their sets may differ in shingles:
   the suffix filter, in the form of a Hamming bound. All three stand in the condition of the join.
5. A pair is verified once, on the whole sets, by a join.

Only components are wanted, so the classes of a posting list need not all meet. First each
meets two leaders of its list, then, where components are still apart, four others. The last
round takes all pairs within a list that are in different components even then, so no link
between different components is lost. Tables that a later one has replaced are deleted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmosaic.llm import bloom
from docmosaic.llm.common import ids_and_texts, mixed, returning, sheltered, utf8
from docmosaic.llm.components import components
from docmosaic.llm.shingles import WordHashes, shingle_set
from docmosaic.session import discard, materialize

SKETCH_BITS = 21
SLICE = 1 << 16
#: 64-bit words of a bitmap.
WORDS = 4
LEADERS = (2, 4)
#: Shingles that are counted in filters, as a multiple of those a set may miss; bits for each of a text, of a class.
COUNTED = 2
BITS = (4, 16)
_MAP = [f"m{k}" for k in range(WORDS)]
_MAPS = ", ".join(f"{m} bigint" for m in _MAP)


def _digest(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Bit k is set if an odd number of the shingles fall to k. Sets that differ in x shingles differ in x bits at most."""
    odd = np.bincount((found & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").astype(np.int64)


@returning
def _facts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row (id, n, d) for each document, then rows (slice, counts) with the sketch of the task."""
    hashes, sketch = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64)
    none = lambda n, kind: pa.nulls(n, kind)
    kinds = None
    for batch in batches:
        kinds = batch.schema.field(0).type
        ns, ds, slots = [], [], []
        for text in utf8(batch.column(1)):
            found = shingle_set(text, size, hashes)
            ns.append(len(found))
            ds.append(_digest(found))
            slots.append((mixed_slots(found)))
        if slots:
            sketch += np.bincount(np.concatenate(slots), minlength=len(sketch))
        n = len(ns)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ns, pa.int32()), pa.array(ds, pa.int64()), none(n, pa.int32()), none(n, pa.binary())],
            names=["id", "n", "d", "slice", "counts"])
    if kinds is not None:
        for k in range(len(sketch) // SLICE):
            part = np.minimum(sketch[k * SLICE : (k + 1) * SLICE], 2**32 - 1).astype(np.uint32)
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [none(1, kinds), none(1, pa.int32()), none(1, pa.int64()), pa.array([k], pa.int32()),
                     pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())],
                    names=["id", "n", "d", "slice", "counts"])


def mixed_slots(found: np.ndarray) -> np.ndarray:
    """Place of a shingle in the sketch: bits that the bitmap does not use."""
    return ((found >> np.uint64(20)) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


@returning
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in order of their number; counts become levels, two to a doubling."""
    at, total = None, None

    def done():
        levels = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "levels": pa.array([zlib.compress(levels.tobytes(), 1)], pa.binary())})

    for batch in batches:
        for k, counts in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
            if k != at:
                if at is not None:
                    yield done()
                at, total = k, part
            else:
                total += part
    if at is not None:
        yield done()


def prefix(n: int, least: int) -> int:
    """Of so many shingles of a set, in any order, a set that links with it has one at least."""
    return n - -(-least * n // 100) + 1


def place(levels: np.ndarray, share: float) -> tuple[int, int]:
    """(level, hash): about this share of all shingles comes before it in the global order."""
    mass = np.bincount(levels) * 2.0 ** (np.arange(int(levels.max()) + 1) / 2)
    ends = np.cumsum(mass)
    wanted = min(share, 1.0) * ends[-1]
    at = int(np.searchsorted(ends, wanted, "right"))
    if at == len(ends):
        return at, 0
    return at, min(int((wanted - ends[at] + mass[at]) / mass[at] * 2.0**64), 2**64 - 1)


@returning
def _prefixes(batches: Iterator[pa.RecordBatch], size: int, least: int, levels, cut: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(d, n, counted, missed, tokens, pos, bitmap) of each set: its first shingles, at least as many as its prefix.

    ``counted`` of them come before ``cut``; ``missed`` of these are known to be in no other set of like size. A null ``pos`` stands for 0, 1, ...
    """
    hashes, order, (level, below) = WordHashes(), np.frombuffer(levels.value, np.uint8), cut
    for batch in batches:
        ds, ns, counted, tokens, maps = [], [], [], [], []
        for text in utf8(batch.column(1)):
            found = shingle_set(text, size, hashes)
            n = len(found)
            if n:
                of = order[mixed_slots(found)]
                first = int(np.count_nonzero(of < level)) + int(np.count_nonzero((of == level) & (found < np.uint64(below))))
                tokens.append(found[np.argsort(of, kind="stable")[: max(prefix(n, least), first)]].tobytes())
                ds.append(_digest(found))
                ns.append(n)
                counted.append(first)
                maps.append(bitmap(found))
        if ds:
            yield pa.RecordBatch.from_arrays(
                [pa.array(ds, pa.int64()), pa.array(ns, pa.int32()), pa.array(counted, pa.int32()), pa.array([0] * len(ds), pa.int32()),
                 pa.array(tokens, pa.binary()), pa.nulls(len(ds), pa.binary()), *(pa.array(x) for x in np.array(maps).T)],
                names=["d", "n", "counted", "missed", "tokens", "pos", *_MAP])


def sized(tokens: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Keys of shingles of sets of one step of sizes."""
    return mixed(tokens ^ mixed(steps.astype(np.uint64) + np.uint64(1)))


def steps_of(ns: np.ndarray, least: int) -> np.ndarray:
    """Steps of sizes: sets that link are of one step or of neighbouring ones."""
    width = math.log(100 / least) * (1 + 1e-9) if 0 < least < 100 else math.inf if least <= 0 else 1e-9
    return np.floor(np.log(ns) / width).astype(np.int64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of all sets of a batch, how many each has, and sizes of the sets."""
    texts = batch.column(4).to_pylist()
    return np.frombuffer(b"".join(texts), np.uint64), np.array([len(x) // 8 for x in texts], np.int64), batch.column(1).to_numpy()


@returning
def _known(batches: Iterator[pa.RecordBatch], least: int, filters, bits: int) -> Iterator[tuple]:
    """For each set that may link: its batch and row, the shingles that sets of like size may have, their places and the number missed."""
    once, twice = (np.frombuffer(x, np.uint8) for x in filters.value)
    for batch in batches:
        flat, lengths, ns = _flat(batch)
        own = np.repeat(steps_of(ns, least), lengths)
        held = bloom.held(twice, sized(flat, own), bits)
        for step in (-1, 1):
            other = np.flatnonzero(~held)
            held[other] = bloom.held(once, sized(flat[other], own[other] + step), bits)
        ends = np.cumsum(lengths)
        counted, missed, places = (batch.column(k).to_pylist() for k in (2, 3, 5))
        for k, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
            pos = np.arange(b - a, dtype=np.int32) if places[k] is None else np.frombuffer(places[k], np.int32)
            here = held[a:b]
            lost = missed[k] + int(np.count_nonzero(~here & (pos < counted[k])))
            most = prefix(int(ns[k]), least)
            if lost < most and (here & (pos < most)).any():
                yield batch, k, flat[a:b][here], pos[here], lost


def _left(batches: Iterator[pa.RecordBatch], least: int, filters, bits: int) -> Iterator[pa.RecordBatch]:
    """The sets that may link, with the shingles they may share."""
    rows, last = [], None

    def done():
        at = last.take(pa.array([r[0] for r in rows]))
        return pa.RecordBatch.from_arrays(
            [at.column(0), at.column(1), at.column(2), pa.array([r[3] for r in rows], pa.int32()),
             pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary()),
             *at.columns[6:]], names=last.schema.names)

    for batch, *row in _known(batches, least, filters, bits):
        if batch is not last and rows:
            yield done()
            rows = []
        last = batch
        rows.append(row)
    if rows:
        yield done()


def _postings(batches: Iterator[pa.RecordBatch], least: int, filters, bits: int) -> Iterator[pa.RecordBatch]:
    """(token, d, n, pos, bitmap): the shingles of the prefix of each set that may link, as far as it may share them."""
    rows, last = [], None

    def done():
        # without the columns of whole sets, which are not to be repeated for each shingle
        at = last.select([0, 1, *range(6, 6 + WORDS)]).take(pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([r[1] for r in rows]).view(np.int64)), at.column(0), at.column(1),
             pa.array(np.concatenate([r[2] for r in rows])), *at.columns[2:]], names=["token", "d", "n", "pos", *_MAP])

    for batch, k, tokens, pos, _ in _known(batches, least, filters, bits):
        if batch is not last and rows:
            yield done()
            rows = []
        last = batch
        inside = pos < prefix(batch.column(1)[k].as_py(), least)
        rows.append((k, tokens[inside], pos[inside]))
    if rows:
        yield done()


@returning
def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = [shingle_set(x, size, hashes) for x in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_digest(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))],
            names=["d", "shingles"])


class NgramJoin:
    """One run of the join over ``docs``; ``classes`` and ``links`` are written tables to look at afterwards.

    ``size`` words make a shingle; two sets link when ``100 * intersection >= least * union``.
    A text with fewer words is one shingle; a null text or one without words has an empty
    set and links with nothing; rows without an id link with nothing. Ids are taken to be
    unique; rows that repeat an id are compared each by its own text. An empty table gives
    empty tables.
    """

    def __init__(self, docs: DataFrame, *, size: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        self.size, self.least = size, least
        self.rows = ids_and_texts(docs, id_col, text_col)
        kind = docs.schema[id_col].dataType.simpleString()
        facts = materialize(self.rows.mapInArrow(
            lambda it: _facts(it, size), f"id {kind}, n int, d bigint, slice int, counts binary"), "shingle-facts")
        self.documents = facts.where("slice is null").select("id", "n", "d")
        self.levels = self._levels(facts.where("slice is not null").select("slice", "counts"))
        known = self.documents.where("n > 0 and id is not null")
        self.classes = materialize(known.groupBy("d", "n").agg(F.min("id").alias("first")), "classes")
        self.links = self._links()

    def _levels(self, parts: DataFrame):
        out = bytearray(1 << SKETCH_BITS)
        summed = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(_summed, "slice int, levels binary")
        for row in summed.toLocalIterator():  # 2**SKETCH_BITS bytes in all
            out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = zlib.decompress(row["levels"])
        return self.rows.sparkSession.sparkContext.broadcast(bytes(out))

    def _filters(self, sets: DataFrame, per_key: int):
        """Two Bloom filters of the shingles of ``sets`` by steps of sizes, at tasks, and their size."""
        least = self.least
        keys = sets.agg(F.sum(F.octet_length("tokens") / 8)).first()[0] or 0
        bits = bloom.bits_for(keys, per_key=per_key)

        def keyed(batch: pa.RecordBatch) -> np.ndarray:
            flat, lengths, ns = _flat(batch)
            return sized(flat, np.repeat(steps_of(ns, least), lengths))

        return self.rows.sparkSession.sparkContext.broadcast(bloom.seen(sets, keyed, bits)), bits

    def _shared(self) -> DataFrame:
        """Postings of shingles that more than one class posts, of classes that the filters leave."""
        size, least, levels = self.size, self.least, self.levels
        cut = place(np.frombuffer(levels.value, np.uint8), COUNTED * (100 - least) / 100)
        posted = materialize(self.rows.where("id is not null").mapInArrow(
            lambda it: _prefixes(it, size, least, levels, cut), f"d bigint, n int, counted int, missed int, tokens binary, pos binary, {_MAPS}"), "prefixes")
        filters, bits = self._filters(posted, BITS[0])
        # rows of a class repeat; any one of them is as good as another
        left = materialize(posted.mapInArrow(lambda it: _left(it, least, filters, bits), posted.schema).dropDuplicates(["d", "n"]), "classes-left")
        discard(posted)
        filters.destroy()
        again, few = self._filters(left, BITS[1])
        likely = materialize(left.mapInArrow(
            lambda it: _postings(it, least, again, few), f"token bigint, d bigint, n int, pos int, {_MAPS}"), "suspected-postings")
        discard(left)
        again.destroy()
        tokens = likely.groupBy("token").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("token")
        out = materialize(likely.join(tokens, "token"), "shared-postings")
        discard(likely)
        return out

    def _may_link(self):
        """Condition on a posting of ``a`` and one of ``b`` with one token: by length, by position and by bitmap."""
        need = F.ceil(F.lit(self.least) * (F.col("an") + F.col("bn")) / F.lit(100 + self.least))
        apart = sum((F.bit_count(F.col(f"a{m}").bitwiseXOR(F.col(f"b{m}"))) for m in _MAP), F.lit(0))
        return (
            (F.least("an", "bn") * 100 >= F.greatest("an", "bn") * self.least)
            # at the first shingle that a pair shares, no more can be common than what follows in both
            & (F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) >= need)
            & (apart <= F.col("an") + F.col("bn") - 2 * need)
        )

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough, written."""
        ends = pairs.select(F.col("a").alias("d"), F.col("an").alias("n")).union(pairs.select("b", "bn")).distinct()
        wanted = materialize(self.classes.join(ends, ["d", "n"], "left_semi").select(F.col("first").alias("id")).distinct(), "to-verify")
        size = self.size
        texts = self.rows.join(wanted, "id", "left_semi")
        sets = materialize(texts.mapInArrow(lambda it: _sets(it, size), "d bigint, shingles array<bigint>"), "sets")
        of = lambda x: sets.select(F.col("d").alias(x), F.col("shingles").alias(f"{x}s"))
        common = F.size(F.array_intersect("as", "bs"))
        union = F.size("as") + F.size("bs") - common
        # the same plan at every size: sets go to pairs, whose number follows the number of similar texts
        both = pairs.hint("merge").join(of("a"), "a").hint("merge").join(of("b"), "b")
        found = materialize(both.where(common * 100 >= union * self.least).select("a", "b"), "links")
        discard(wanted, sets)
        return found

    def _links(self) -> DataFrame:
        shared = self._shared()
        nothing = shared.sparkSession.createDataFrame([], "a bigint, b bigint")
        label, seen, links = shared.withColumn("c", F.col("d")), None, None
        written = None
        for leaders in (*LEADERS, None):
            left = label  # at first, all lists are open
            if written is not None:
                open_ = label.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
                left = materialize(label.join(open_, "token"), "open-postings")
                discard(written)
            if left.isEmpty():
                if left is not label:
                    discard(left)
                break
            x, y = (left.select("token", *(F.col(c).alias(p + q) for c, q in (("d", ""), ("n", "n"), ("pos", "p"), ("c", "c"), *((m, m) for m in _MAP))))
                    for p in "ab")
            if leaders is not None:
                order = Window.partitionBy("token").orderBy(F.xxhash64("a", F.lit(leaders)))
                x = x.withColumn("r", F.row_number().over(order)).where(F.col("r") <= leaders).drop("r")
            apart = (x["token"] == y["token"]) & (F.col("ac") != F.col("bc"))
            if leaders is None:
                apart &= F.col("a") < F.col("b")
            pairs = x.join(y, apart & self._may_link()).select("a", "an", "b", "bn").distinct()
            low = F.col("a") < F.col("b")
            pairs = pairs.select(*[F.when(low, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in
                                   (("a", "b"), ("an", "bn"), ("b", "a"), ("bn", "an"))]).distinct()
            if seen is not None:
                pairs = pairs.join(seen, ["a", "b"], "left_anti")
            pairs = materialize(pairs, "pairs")
            if written is not None:
                discard(left)
            found = self._verified(pairs)
            seen = pairs.select("a", "b") if seen is None else seen.union(pairs.select("a", "b"))
            links = found if links is None else links.union(found)
            if leaders is not None:
                label = shared.join(components(links, 2).withColumnRenamed("node", "d"), "d", "left").withColumn(
                    "c", F.coalesce("component", "d")).drop("component")
                written = label = materialize(label, "labelled-postings")
        discard(shared)
        return nothing if links is None else links

    def members(self) -> DataFrame:
        """(id, n_shingles, component): one row per row of the table; a document that links with nothing is its own component."""
        of = components(self.links).select(F.col("node").alias("d"), F.col("component").alias("c"))
        labelled = self.classes.join(of, "d", "left").select("d", "n", "first", F.coalesce("c", "d").alias("c"))
        least = labelled.groupBy("c").agg(F.min("first").alias("component"))
        named = labelled.join(least, "c").select("d", "n", "component")
        return self.documents.join(named, ["d", "n"], "left").select(
            "id", F.col("n").cast("bigint").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


@sheltered
def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: int = 80) -> DataFrame:
    """``docs`` with the document of the smallest id of each component, columns as they are.

    Rows without an id stay; of kept rows that repeat an id one stays.
    """
    members = materialize(NgramJoin(docs, size=size, least=least, id_col=id_col, text_col=text_col).members(), "members")
    others = materialize(members.where("id <> component").select(F.col("id").alias("other")).distinct(), "not-kept")
    kept = docs.join(others, docs[id_col] == others["other"], "left_anti")
    known = members.where("id is not null and id = component")
    counts = known.agg(F.count("id").alias("n"), F.countDistinct("id").alias("m")).first()
    if counts["n"] == counts["m"]:
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
