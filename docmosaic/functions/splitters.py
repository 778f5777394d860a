"""The splitters as table functions for SQL.

``SELECT * FROM table_chunks(TABLE(docs))``, ``sentence_chunks(TABLE(docs), 256, 32)`` and
``document_chunks(TABLE(docs), 'table_aware')`` give every row of ``docs`` as chunks: its
columns but ``text``, then pos, content_type and text. Sizes are in tokens of four characters,
as in ``ChunkSettings``. Rows are cut where they lie, one at a time; no rows meet.

``FROM docs d, LATERAL sentences_of(d.text, 256, 32)`` cuts a column beside the other columns of a query.

``packed_chunks(TABLE(docs) PARTITION BY key ORDER BY (pos), 256)`` puts the consecutive small
texts of a partition together, up to a size: it holds one chunk at a time.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docmosaic.operators.chunking import CHARS_PER_TOKEN, ChunkSettings, sentence_pieces, splitter, table_pieces

_ADDED = [StructField("pos", LongType()), StructField("content_type", StringType()), StructField("text", StringType())]


def _schema(docs: AnalyzeArgument) -> StructType:
    if not docs.isTable or "text" not in docs.dataType.names:
        raise ValueError("a splitter takes TABLE(...) with a column text")
    taken = {f.name for f in _ADDED}
    return StructType([f for f in docs.dataType.fields if f.name not in taken] + _ADDED)


def _size(given: AnalyzeArgument | None, name: str, least: int = 1) -> None:
    if given is not None and (given.value is None or given.value < least):
        raise ValueError(f"{name} must be {least} or more")


class _Splitter:
    """Every row to its pieces; a null text is one empty piece, as it is for the DataFrame functions."""

    def _rows(self, row: Row, pieces):
        kept = [v for k, v in zip(row.__fields__, row) if k not in ("pos", "content_type", "text")]
        for pos, (kind, body) in enumerate(pieces):
            yield (*kept, pos, kind, body)


class TableChunks(_Splitter):
    @staticmethod
    def analyze(docs: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        _size(size, "size")
        return AnalyzeResult(_schema(docs))

    def eval(self, docs: Row, size: int = ChunkSettings.table_chunk_size):
        yield from self._rows(docs, table_pieces(docs["text"] or "", size * CHARS_PER_TOKEN))


class SentenceChunks(_Splitter):
    @staticmethod
    def analyze(docs: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _size(size, "size")
        _size(overlap, "overlap", 0)
        return AnalyzeResult(_schema(docs))

    def eval(self, docs: Row, size: int = ChunkSettings.chunk_size, overlap: int = ChunkSettings.chunk_overlap):
        pieces = sentence_pieces(docs["text"] or "", size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN)
        yield from self._rows(docs, (("prose", p) for p in pieces))


class DocumentChunks(_Splitter):
    @staticmethod
    def analyze(docs: AnalyzeArgument, strategy: AnalyzeArgument | None = None) -> AnalyzeResult:
        if strategy is not None:
            splitter(ChunkSettings(strategy.value))
        return AnalyzeResult(_schema(docs))

    def eval(self, docs: Row, strategy: str = ChunkSettings.strategy):
        yield from self._rows(docs, splitter(ChunkSettings(strategy))(docs["text"] or ""))


class SentencesOf:
    """(pos, text) of a text given as a column."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _size(size, "size")
        _size(overlap, "overlap", 0)
        return AnalyzeResult(StructType([_ADDED[0], _ADDED[2]]))

    def eval(self, text: str, size: int = ChunkSettings.chunk_size, overlap: int = ChunkSettings.chunk_overlap):
        yield from enumerate(sentence_pieces(text or "", size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN))


class PackedChunks:
    """Consecutive texts of a partition, a line each, up to a size; the first columns are those of the first text put in."""

    def __init__(self):
        self.first, self.held, self.used, self.pos = None, [], 0, 0

    @staticmethod
    def analyze(docs: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        _size(size, "size")
        return AnalyzeResult(_schema(docs))

    def eval(self, docs: Row, size: int = ChunkSettings.chunk_size):
        text = docs["text"] or ""
        if self.held and self.used + len(text) > size * CHARS_PER_TOKEN:
            yield self._done()
        if not self.held:
            self.first = [v for k, v in zip(docs.__fields__, docs) if k not in ("pos", "content_type", "text")]
        self.held.append(text)
        self.used += len(text)

    def terminate(self):
        if self.held:
            yield self._done()

    def _done(self):
        out = (*self.first, self.pos, "packed", "\n".join(self.held))
        self.held, self.used, self.pos = [], 0, self.pos + 1
        return out


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL of this session."""
    for name, kind in (("table_chunks", TableChunks), ("sentence_chunks", SentenceChunks), ("document_chunks", DocumentChunks), ("packed_chunks", PackedChunks),
                       ("sentences_of", SentencesOf)):
        spark.udtf.register(name, udtf(kind))
