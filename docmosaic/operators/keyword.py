"""Verbatim keyword scan: many terms against whole texts in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.functions.text import collapse
from docmosaic.session import bounded_batches, materialize, returning, small_side

# Terms of one pass, by characters; more terms take further passes over the texts.
TERM_CHARS = 16_000_000

_matchers: dict[int, object] = {}


def _matcher(terms: list[str]):
    """Matcher for the broadcast term list, built once per Python worker."""
    key = hash(tuple(terms))
    if key not in _matchers:
        _matchers.clear()
        automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            automaton.add_word(t, i)
        automaton.make_automaton()
        _matchers[key] = lambda text: {i for _, i in automaton.iter(text)}
    return _matchers[key]


def _one_pass(texts: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    bounded_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(terms)
    schema = [f for f in texts.schema.fields if f.name in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", term string"

    @returning
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        find = _matcher(words) if words else lambda text: ()
        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch.column("_low")):
                for j in find(text.as_py() or ""):
                    rows.append(i)
                    hits.append(words[j])
            picked = batch.select(keys).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(hits, pa.string())], names=[*keys, "term"])

    return texts.mapInArrow(scan, ddl)


def scan_terms(chunks: DataFrame, terms: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., term) for every distinct term found in a text, ignoring case.

    ``terms`` has a column ``term``. The list is sent to the tasks in parts of
    bounded size, and each part is one pass over the texts; matching a part is
    linear in the text whatever the number of terms. Only true hits leave a task.
    """
    low = chunks.select(*keys, F.lower(F.col(text)).alias("_low"))
    words = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    size = words.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    passes = int(size // TERM_CHARS) + 1
    if passes == 1:
        return _one_pass(low, keys, [r.term for r in words.orderBy("term").collect()])
    part = F.pmod(F.xxhash64("term"), F.lit(passes))
    words = materialize(words.withColumn("part", part), "terms")
    out = None
    for p in range(passes):
        listed = [r.term for r in words.where(F.col("part") == p).orderBy("term").toLocalIterator()]
        hits = materialize(_one_pass(low, keys, listed), "hits")
        out = hits if out is None else out.unionByName(hits)
    return out


def entity_hits(chunks: DataFrame, variants: DataFrame, with_text: bool = True) -> DataFrame:
    """(entity_id, pos, variant, collection, chunk_id, text): chunks that hold a variant verbatim."""
    wanted = variants.select("entity_id", "pos", "variant", F.lower("variant").alias("term"))
    found = scan_terms(chunks, wanted, ["collection", "chunk_id"] + ["text"] * with_text)
    return found.join(small_side(wanted), "term").drop("term")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """(entity_id, collection, chunk_id, text): one chunk per whitespace-collapsed text and entity.

    The first chunk (by id) of equal texts stays. Grouping is by the SHA-256 of
    the text and combines map-side, so a text copied a million times is sent
    once per task.
    """
    digest = F.sha2(collapse(F.col("text")), 256)
    return (
        hits.groupBy("entity_id", digest.alias("digest"))
        .agg(F.min(F.struct("chunk_id", "collection", "text")).alias("first"))
        .select("entity_id", "first.collection", "first.chunk_id", "first.text")
    )


def section_hits(hits: DataFrame) -> DataFrame:
    """(entity_id, collection, n_chunks): sections that hold any variant of an entity."""
    return hits.groupBy("entity_id", "collection").agg(F.countDistinct("chunk_id").alias("n_chunks"))
