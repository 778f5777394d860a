"""Document readers: text, Markdown, HTML and binary formats to rows of Markdown text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.functions.markup import page_text

SCHEMA = "path string, text string"

# A parser for a binary format (PDF, DOCX, PPTX): bytes of one file to Markdown.
Parser = Callable[[bytes], str]


def sanitize_metadata(raw: Column, extra: Column, path: Column) -> Column:
    """Metadata of a document: no error notes, no null values, configured keys on top, source_file set."""
    kept = F.map_filter(raw, lambda k, v: v.isNotNull() & (k != "extraction_errors"))
    extra = F.map_concat(extra, F.create_map(F.lit("source_file"), path))
    kept = F.map_filter(kept, lambda k, v: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


# Folder where files that a config names are looked up when they are not at their own path.
FOLDER_SETTING = "spark.docmosaic.documents.dir"


def resolve_paths(paths: list[str], folder: str | None = None) -> tuple[list[str], list[str]]:
    """Existing paths and missing ones; a missing file is looked up by name in ``folder``."""
    found, missing = [], []
    for p in paths:
        fallback = Path(folder) / Path(p).name if folder else None
        if Path(p).expanduser().exists():
            found.append(str(Path(p).expanduser()))
        elif fallback is not None and fallback.exists():
            found.append(str(fallback))
        else:
            missing.append(p)
    return found, missing


def read_text(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, text): one row per text or Markdown file."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))


def plain_path(encoded: Column) -> Column:
    """A file's path as ``binaryFile`` gives it; the metadata column has it URL-encoded, but for plus signs."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def read_html(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return read_text(spark, paths).withColumn("text", page_text(F.col("text")))


def read_binary(spark: SparkSession, paths: list[str] | str, parser: Parser) -> DataFrame:
    """(path, text) of files that need a parser. A file that fails gives a NULL text, not a failed job."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for content in frame["content"]:
                try:
                    texts.append(parser(bytes(content)))
                except Exception:
                    texts.append(None)
            yield pd.DataFrame({"path": frame["path"], "text": texts})

    return files.mapInPandas(parse, SCHEMA)


TEXT_SUFFIXES = (".txt", ".md", ".markdown")
HTML_SUFFIXES = (".html", ".htm")


def read_documents(
    spark: SparkSession, paths: list[str], parsers: dict[str, Parser] | None = None
) -> DataFrame:
    """(path, text) of mixed files, each format by its own reader, united; the text of a file that its parser failed on is null."""
    parsers = parsers or {}
    by_suffix: dict[str, list[str]] = {}
    for p in paths:
        by_suffix.setdefault(Path(p).suffix.lower(), []).append(p)
    parts = []
    for suffix, group in sorted(by_suffix.items()):
        if suffix in HTML_SUFFIXES:
            parts.append(read_html(spark, group))
        elif suffix in parsers:
            parts.append(read_binary(spark, group, parsers[suffix]))
        elif suffix in TEXT_SUFFIXES:
            parts.append(read_text(spark, group))
        else:
            raise ValueError(f"no parser for {suffix} files: {group}")
    if not parts:
        raise ValueError("no documents to read")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
