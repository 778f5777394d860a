"""Line deduplication with two Bloom filters.

A first pass puts the hash of each line's key into the filter of once-seen lines, or,
when it is there already, into that of twice-seen lines. Tasks fill filters of their
own; slices of them are merged by position, where a line that two tasks saw shows in
both once-seen filters. A second pass sends on only lines that the twice-seen filter
suspects; those are counted exactly, by their text, with map-side combine. A last
pass drops what was confirmed.

The filters have a stated size limit. Where more lines come than suit it, more are
suspected and shuffled, and the exact count still decides, so results never change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.llm import bloom
from docmosaic.llm.common import bounded_batches, returning, sheltered, utf8
from docmosaic.session import materialize

SPACE = b" \t\n\x0b\x0c\r"
BROADCAST_KEYS = 2_000_000


def key_of(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _keys(text: bytes, least: int) -> list[bytes]:
    found = {key_of(x) for x in text.split(b"\n")}
    return [x for x in found if len(x) >= least and (least < 2 or len(x.decode()) >= least)]


@returning
def _suspects(batches: Iterator[pa.RecordBatch], twice, bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """(id, key, line) of the first line of each suspected key in a document."""
    filled = np.frombuffer(twice.value, np.uint8)
    for batch in batches:
        names = batch.schema.names
        keys, owners, numbers = [], [], []
        for i, text in enumerate(utf8(batch.column(names.index("text")))):
            first: dict[bytes, int] = {}
            for n, line in enumerate(text.split(b"\n")):
                first.setdefault(key_of(line), n)
            for k, n in first.items():
                if len(k) >= least and (least < 2 or len(k.decode()) >= least):
                    keys.append(k)
                    owners.append(i)
                    numbers.append(n)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        held = np.flatnonzero(bloom.held(filled, hashes, bits))
        owner = pa.array([owners[i] for i in held], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(names.index(c)).take(owner) for c in ("id", "mark")),
             pa.array([keys[i] for i in held], pa.binary()).cast(pa.string()), pa.array([numbers[i] for i in held], pa.int64())],
            names=["id", "mark", "key", "line"],
        )


def _twice(docs: DataFrame, least: int, most_bits: int) -> tuple[bytes, int]:
    """The merged filter of twice-seen lines and its number of bits."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    bits = bloom.bits_for(lines, most_bits)

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for x in utf8(batch.column(0)) for k in _keys(x, least)], dtype=np.uint64)

    return bloom.twice_seen(docs.select("text"), hashes, bits), bits


def _dropped(text: bytes, drop) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [x for n, x in enumerate(lines) if not drop(n, x)]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _columns(batch: pa.RecordBatch, names: tuple[str, str, str], results: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    text, n, gone = names
    new = {
        text: pa.array([x[0] for x in results], pa.binary()).cast(pa.string()),
        n: pa.array([x[1] for x in results], pa.int64()), gone: pa.array([x[2] for x in results], pa.int64()),
    }
    fields = [(c, new[c] if c in new else batch.column(i)) for i, c in enumerate(batch.schema.names)]
    return pa.RecordBatch.from_arrays([x for _, x in fields], names=[c for c, _ in fields])


@sheltered
def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2,
                keep: str = "first", min_chars: int = 1, most_bits: int = bloom.MOST_BITS,
                broadcast_keys: int = BROADCAST_KEYS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and two more columns of counts.

    A line whose key (see ``key_of``) has at least ``min_chars`` characters and occurs in
    at least ``min_docs`` rows is dropped: everywhere with ``keep="none"``; with
    ``keep="first"`` it stays at its first line in the row with the smallest id. (Rows that
    are alike in id and text are alike in the result.) Other lines keep their order.

    A null text counts as empty, that is one empty line, and comes back empty; a row with
    a null id takes part and sorts first; an empty table gives an empty table. Columns named
    as in ``counts`` are replaced. Few confirmed keys (``broadcast_keys``) are sent to the last
    pass as digests; more are joined to the suspected lines and meet the documents again by id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n_lines, n_dropped = counts
    first = {"first": True, "none": False}[keep]
    slim = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    filled, bits = _twice(slim, min_chars, most_bits)
    shared = spark.sparkContext.broadcast(filled)
    kind = docs.schema[id_col].dataType.simpleString()
    suspects = slim.mapInArrow(
        lambda it: _suspects(it, shared, bits, min_chars), f"id {kind}, mark bigint, key string, line bigint"
    )
    place = F.struct("id", "mark", "line")
    confirmed = materialize(
        suspects.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), *[F.min(place).alias("first")] * first)
        .where(F.col("n") >= min_docs).drop("n"), "repeated-lines"
    )
    out = docs.withColumns({
        "__mark": F.xxhash64(text_col), text_col: F.coalesce(F.col(text_col), F.lit("")), n_lines: F.lit(0).cast("bigint"), n_dropped: F.lit(0).cast("bigint"),
    })
    names = (text_col, n_lines, n_dropped)
    if confirmed.count() <= broadcast_keys:
        digests = spark.sparkContext.broadcast({
            xxhash.xxh3_128_digest(r["key"].encode()): (r["id"], r["mark"], r["line"]) if first else None
            for r in confirmed.select("key", *["first.*"] * first).toLocalIterator()
        })

        @returning
        def apply(batches):
            known = digests.value
            for batch in batches:
                cols = batch.schema.names
                ids = batch.column(cols.index(id_col)).to_pylist() if first else None
                marks = batch.column(cols.index("__mark")).to_pylist() if first else None
                results = []
                for i, text in enumerate(utf8(batch.column(cols.index(text_col)))):
                    def drop(n, line, i=i):
                        key = xxhash.xxh3_128_digest(key_of(line))
                        return key in known and (not first or known[key] != (ids[i], marks[i], n))
                    results.append(_dropped(text, drop))
                yield _columns(batch, names, results)

        return out.mapInArrow(apply, out.schema).drop("__mark")
    # Many keys: the keys to drop of each document meet it by id and a hash of its text.
    stays = F.when(F.col("c.first").eqNullSafe(F.struct("s.id", "s.mark", "s.line")), F.col("s.line")) if first else F.lit(None)
    gone = (
        suspects.alias("s").join(confirmed.alias("c"), "key")
        .select(F.col("s.id").alias("__id"), F.col("s.mark").alias("__mark"), F.struct(
            "key", F.coalesce(stays, F.lit(-1)).cast("bigint").alias("stays")
        ).alias("k"))
        .groupBy("__id", "__mark").agg(F.collect_set("k").alias("__gone"))
    )
    joined = out.join(
        gone.withColumnRenamed("__mark", "__gmark"),
        F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__gmark")), "left",
    ).drop("__id", "__gmark", "__mark")

    @returning
    def rebuild(batches):
        for batch in batches:
            cols = batch.schema.names
            lists = batch.column(cols.index("__gone")).to_pylist()
            results = []
            for text, keys in zip(utf8(batch.column(cols.index(text_col))), lists):
                stays = {k["key"].encode(): k["stays"] for k in keys or ()}
                results.append(_dropped(text, lambda n, x: (k := key_of(x)) in stays and (not first or stays[k] != n)))
            yield _columns(batch, names, results)

    return joined.mapInArrow(rebuild, joined.schema).drop("__gone")
