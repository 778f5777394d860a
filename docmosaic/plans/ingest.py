"""Ingestion: files to chunks in the store, by content hash, whole or split into section collections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.config import load_batch, load_yaml
from docmosaic.functions.embedding import Embedder, embed, hashed_words
from docmosaic.operators.chunking import ChunkSettings, chunk, split_numbered_sections
from docmosaic.session import materialize
from docmosaic.sources import diagram, documents, hashes, inventory
from docmosaic.sources.store import ChunkStore

# Formats read by a source of their own: (spark, paths) to (path, text), or (path, suffix, text) where each
# suffix is a collection under the config's prefix.
READERS = {"diagram": diagram.read_markdown, "inventory": inventory.read_markdown}

# A preprocessor turns documents (path, text) into documents; new ones are registered by name.
Preprocessor = Callable[[DataFrame], DataFrame]
PREPROCESSORS: dict[str, Preprocessor] = {"identity": lambda docs: docs}


def register_preprocessor(name: str, fn: Preprocessor) -> None:
    PREPROCESSORS[name] = fn


def get_preprocessor(name: str | None) -> Preprocessor:
    """By registered name, or ``module:function`` imported on demand."""
    if not name:
        return PREPROCESSORS["identity"]
    if name in PREPROCESSORS:
        return PREPROCESSORS[name]
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"unknown preprocessor {name!r}")
    from importlib import import_module

    return getattr(import_module(module), attribute)


@dataclass(frozen=True)
class IngestConfig:
    file_paths: list[str]
    collection_name: str | None = None
    collection_prefix: str | None = None
    preprocessor: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    chunking: ChunkSettings = field(default_factory=ChunkSettings)
    rebuild: bool = False

    @classmethod
    def from_dict(cls, data: dict) -> IngestConfig:
        known = ChunkSettings.__dataclass_fields__
        chunking = ChunkSettings(**{k: v for k, v in (data.get("chunking") or {}).items() if k in known})
        meta = {k: str(v) for k, v in (data.get("metadata") or {}).items()}
        return cls(
            list(data.get("file_paths") or []), data.get("collection_name"), data.get("collection_prefix"),
            data.get("preprocessor"), meta, chunking, bool(data.get("rebuild", False)),
        )


def to_chunks(docs: DataFrame, settings: ChunkSettings, metadata: dict[str, str], model: Embedder = hashed_words) -> DataFrame:
    """Documents (collection, path, text) to rows of the chunk table.

    A chunk's id is a hash of its collection, document, place and text, so a retried
    or repeated run gives the same ids.
    """
    pieces = chunk(docs.select("collection", "path", "text"), settings)
    extra = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    return pieces.select(
        F.col("path").alias("doc_id"),
        F.xxhash64("collection", "path", "pos", "text").alias("chunk_id"),
        "pos",
        "content_type",
        "text",
        embed(F.col("text"), model).alias("embedding"),
        documents.sanitize_metadata(F.create_map().cast("map<string,string>"), extra, F.col("path")).alias("metadata"),
        "collection",
    )


def _sections(docs: DataFrame, prefix: str) -> DataFrame:
    """Numbered sections as collections of their own; a document without any stays whole, under the prefix."""
    docs = materialize(docs.select("path", "text"), "documents")
    parts = materialize(split_numbered_sections(docs, "path", prefix).select("collection", "path", "text"), "sections")
    whole = docs.join(parts.select("path").distinct(), "path", "left_anti")
    return parts.unionByName(whole.select(F.lit(prefix).alias("collection"), "path", "text"))


def ingest(spark: SparkSession, config: IngestConfig, store: ChunkStore, model: Embedder = hashed_words, parsers=None) -> int:
    """Ingest the changed files of a config; returns the number of chunks written (0 when nothing changed).

    With a collection prefix each numbered section becomes a collection of its own.
    """
    if not config.file_paths or not (config.collection_name or config.collection_prefix):
        raise ValueError("an ingest config needs file_paths and a collection_name or collection_prefix")
    name = config.collection_name or config.collection_prefix
    found, _ = documents.resolve_paths(config.file_paths, spark.conf.get(documents.FOLDER_SETTING, None))
    if not found:
        raise ValueError(f"no documents found for {name}")
    files = materialize(hashes.listing(spark, name, found), "files")
    key = lambda c: F.regexp_replace(F.col(c), "^file:/+", "/")
    # a listing leaves out files without a byte: those that had some are recorded and not listed
    mine = store.ledger().where(F.col("collection") == name).withColumn("path", key("file_path"))
    emptied = materialize(
        mine.where(F.col("path").isin(found)).join(files.select(key("file_path").alias("path")), "path", "left_anti"), "emptied-files")
    todo = files if config.rebuild else hashes.changed(files, store.ledger())
    todo = materialize(todo.unionByName(emptied.select("collection", "file_path", F.lit(None).cast("string").alias("hash"))), "changed-files")
    # only the changed files are read; the list is no longer than the config's own
    found = [r["file_path"].removeprefix("file:") for r in todo.where("hash is not null").select("file_path").distinct().sort("file_path").collect()]
    if todo.isEmpty():
        return 0
    if not found:
        docs = spark.createDataFrame([], documents.SCHEMA)
    elif config.preprocessor in READERS:
        docs = READERS[config.preprocessor](spark, found)
    else:
        read = materialize(documents.read_documents(spark, found, parsers), "texts")
        # a file that its parser could not read keeps its chunks and its old hash, and is tried again next time
        failed = read.where("text is null").select(key("path").alias("path"))
        todo = materialize(todo.withColumn("path", key("file_path")).join(failed, "path", "left_anti").drop("path"), "readable-files")
        docs = get_preprocessor(config.preprocessor)(read.where("text is not null"))
    docs = docs.withColumn("path", key("path")).join(todo.select(key("file_path").alias("path")), "path", "left_semi")
    if config.collection_prefix and "suffix" in docs.columns:
        docs = docs.withColumn("collection", F.concat(F.lit(f"{config.collection_prefix}_"), "suffix"))
    elif config.collection_prefix and not config.collection_name:
        docs = _sections(docs, config.collection_prefix)
    else:
        docs = docs.select(F.lit(name).alias("collection"), "path", "text")
    rows = materialize(to_chunks(docs, config.chunking, config.metadata, model), "chunks")
    n = rows.count()
    own = store.chunks().where((F.col("collection") == name) | F.startswith("collection", F.lit(f"{name}_")))
    # a collection with files of its own in the ledger belongs to another config
    others = store.ledger().where(F.col("collection") != name).select("collection").distinct()
    own = own.join(others, "collection", "left_anti")
    if config.rebuild:
        # collections that this config's files, now or before, had given and give no longer
        known = files.select("file_path").union(store.ledger().where(F.col("collection") == name).select("file_path"))
        had = own.join(known.select(key("file_path").alias("doc_id")).distinct(), "doc_id", "left_semi").select("collection").distinct()
        for left in had.join(rows.select("collection").distinct(), "collection", "left_anti").collect():
            store.drop(left.collection, ledger=False)
    else:
        # of the collections that had or get chunks of the changed files, the other files' chunks stay
        ids = todo.select(key("file_path").alias("doc_id")).distinct()
        had = own.join(ids, "doc_id", "left_semi").select("collection")
        touched = materialize(rows.select("collection").unionByName(had).distinct(), "touched")
        kept = store.chunks().join(touched, "collection", "left_semi").join(ids, "doc_id", "left_anti")
        rows = materialize(rows.unionByName(kept.select(*rows.columns)), "chunks")
        for left in touched.join(rows.select("collection").distinct(), "collection", "left_anti").collect():
            store.drop(left.collection, ledger=False)
    if not rows.isEmpty():
        store.write(rows, rebuild=True)
    store.record(todo.where("hash is not null"), emptied.select("collection", "file_path"))
    return n


def ingest_from_yaml(spark: SparkSession, path: str, store: ChunkStore, rebuild: bool | None = None) -> int:
    """A config file, or a batch file that lists config files in order."""
    batch = load_batch(path)
    if batch is not None:
        return sum(ingest_from_yaml(spark, p, store, rebuild) for p in batch)
    config = IngestConfig.from_dict(load_yaml(path))
    if rebuild is not None:
        from dataclasses import replace

        config = replace(config, rebuild=rebuild)
    return ingest(spark, config, store)
