"""Chunking: table-aware, section-aware and sentence splitting, section detection, defined terms.

Size-bounded packing depends on order within one document, so it runs as a
small Python function over Arrow batches; a document never leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.text import collapse, strip
from docmosaic.operators.ranking import keep_first
from docmosaic.session import bounded_batches, returning

CHARS_PER_TOKEN = 4
SEPARATOR = r"^[-|+: ]+$"
PIECES = "array<struct<content_type:string,body:string>>"


@dataclass(frozen=True)
class ChunkSettings:
    """Chunking settings in tokens, counted as four characters each."""

    strategy: str = "table_aware"
    chunk_size: int = 256
    chunk_overlap: int = 32
    table_chunk_size: int = 512


def pack(items: Iterable[str], size: Callable[[str], int], limit: int) -> Iterator[list[str]]:
    """Consecutive items in runs whose sizes add up to ``limit`` at most; a larger item is a run of its own."""
    run: list[str] = []
    used = 0
    for item in items:
        if run and used + size(item) > limit:
            yield run
            run, used = [], 0
        run.append(item)
        used += size(item)
    if run:
        yield run


def table_pieces(text: str, limit: int) -> list[tuple[str, str]]:
    """(content_type, body) in order: table rows packed up to ``limit`` characters, prose in between."""
    lines = [s for s in text.split("\n") if not ("|" in s and re.match(SEPARATOR, s.strip()))]
    pieces: list[tuple[str, str]] = []
    for is_table, block in groupby(lines, key=lambda s: "|" in s):
        if not is_table:
            prose = "\n".join(block).strip()
            if prose:
                pieces.append(("prose", prose))
            continue
        for run in pack(block, len, limit):
            if len(run[0]) > limit:
                words = pack(run[0].split(" "), lambda w: len(w) + 1, limit)
                pieces.extend(("table_row", " ".join(w)) for w in words)
            else:
                pieces.append(("table_row", "\n".join(run)))
    return pieces or [("", text)]


# A sentence with the blanks after it, or a line with its break: put together they give the text again.
SENTENCE = re.compile(r".+?(?:[.!?;](?=\s)\s*|\n+|\Z)", re.DOTALL)


def sentence_pieces(text: str, limit: int, overlap: int) -> list[str]:
    """Sentences packed up to ``limit`` characters, line breaks kept; a chunk repeats trailing sentences of
    the last one as far as they fit in ``overlap``. A sentence that leaves no room for the overlap is cut
    between words."""
    sentences: list[str] = []
    limit = max(limit - overlap, 1)
    for s in SENTENCE.findall(text):
        if len(s) <= limit:
            sentences.append(s)
        else:
            sentences.extend("".join(w) for w in pack(re.findall(r"\S*\s*", s), len, limit))
    chunks: list[str] = []
    carried: list[str] = []
    for run in pack(sentences, len, limit):
        chunks.append("".join([*carried, *run]).strip())
        carried, room = [], overlap
        for s in reversed(run):
            room -= len(s)
            if room < 0:
                break
            carried.insert(0, s)
    return [c for c in chunks if c] or [text]


def _piece_udf(split: Callable[[str], list[tuple[str, str]]]):
    @F.pandas_udf(PIECES)
    @returning
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"content_type": k, "body": b} for k, b in split(t or "")])

    return pieces


def table_chunks(docs: DataFrame, table_chunk_size: int = 512) -> DataFrame:
    """Documents (..., text) to (..., pos, content_type, text): table rows and prose, not yet cut to sentences."""
    limit = table_chunk_size * CHARS_PER_TOKEN
    return _explode(docs, _piece_udf(lambda t: table_pieces(t, limit))(F.col("text")))


def splitter(settings: ChunkSettings = ChunkSettings()) -> Callable[[str], list[tuple[str, str]]]:
    """The strategy of the settings as a function from a text to its (content_type, body)."""
    limit = settings.chunk_size * CHARS_PER_TOKEN
    overlap = settings.chunk_overlap * CHARS_PER_TOKEN
    rows = settings.table_chunk_size * CHARS_PER_TOKEN

    def sentences(kind: str, text: str) -> list[tuple[str, str]]:
        return [(kind, s) for s in sentence_pieces(text, limit, overlap)]

    def table_aware(text: str) -> list[tuple[str, str]]:
        return [c for k, b in table_pieces(text, rows) for c in (sentences(k, b) if k == "prose" else [(k, b)])]

    strategies = {"table_aware": table_aware, "sentence": lambda t: sentences("prose", t)}
    if settings.strategy not in strategies:
        raise ValueError(f"unknown chunking strategy {settings.strategy!r}")
    return strategies[settings.strategy]


def chunk(docs: DataFrame, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Documents (..., text) to chunks (..., pos, content_type, text) by the chosen strategy."""
    if settings.strategy == "section_aware":
        parts = docs.withColumn("_part", F.explode(markdown_sections(F.col("text"))))
        parts = parts.withColumn("text", F.col("_part")).drop("_part")
        return _explode(parts, _piece_udf(splitter(replace(settings, strategy="sentence")))(F.col("text")))
    return _explode(docs, _piece_udf(splitter(settings))(F.col("text")))


def _explode(docs: DataFrame, pieces: Column) -> DataFrame:
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(*keep, F.posexplode(pieces).alias("pos", "_piece")).select(
        *keep, F.col("pos").cast("bigint").alias("pos"), "_piece.content_type", F.col("_piece.body").alias("text")
    )


def classified_lines(docs: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line, line_class): table_row, separator or prose for every line."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    body = strip(F.col("line"))
    kind = (
        F.when(~F.contains("line", F.lit("|")), F.lit("prose"))
        .when(body.rlike(SEPARATOR), F.lit("separator"))
        .otherwise(F.lit("table_row"))
    )
    return lines.select(key, F.col("line_no").cast("bigint").alias("line_no"), "line", kind.alias("line_class"))


def markdown_sections(text: Column, keep_preamble: bool = False) -> Column:
    """Array of sections of a Markdown text, split before each heading.

    With fewer than two headings the text stays whole. Otherwise text before the
    first heading is dropped, unless ``keep_preamble`` is set.
    """
    parts = F.split(text, r"(?m)(?=^#{1,6}\s+.+$)")
    headed = F.transform(F.filter(parts, lambda p: p.rlike(r"\A#{1,6}\s+.")), strip)
    kept = F.filter(F.transform(parts, strip), lambda p: p != "") if keep_preamble else headed
    return F.when(F.size(headed) > 1, kept).otherwise(F.array(text))


SECTIONS = "array<struct<number:bigint,title:string,pattern:string,start:bigint,end:bigint,body:string>>"


def numbered_sections(
    text: str, patterns=fixed.SECTION_HEADINGS, gap: int = fixed.HEADING_GAP
) -> list[tuple[int, str, str, int, int]]:
    """(number, title, pattern, start, end) of the numbered sections of a text.

    Headings closer than ``gap`` to the last accepted one are dropped, and a
    heading that repeats the current number continues its section.
    """
    found = []
    for pattern, name, priority in sorted(patterns, key=lambda p: p[2]):
        for m in re.finditer(pattern, text, re.MULTILINE | re.IGNORECASE):
            title = m.group(2) if m.re.groups > 1 else m.group(0)
            found.append((m.start(), priority, int(m.group(1)), name, title))
    heads: list[tuple[int, int, str, str]] = []
    accepted = None
    for start, _, number, name, title in sorted(found, key=lambda f: f[:2]):
        if accepted is not None and start - accepted < gap:
            continue
        accepted = start
        if not heads or heads[-1][1] != number:
            heads.append((start, number, name, title))
    ends = [h[0] for h in heads[1:]] + [len(text)]
    return [(n, title, name, start, end) for (start, n, name, title), end in zip(heads, ends)]


def split_numbered_sections(
    docs: DataFrame,
    key: str,
    prefix: str,
    patterns=fixed.SECTION_HEADINGS,
    gap: int = fixed.HEADING_GAP,
    min_chars: int = fixed.MIN_SECTION_CHARS,
) -> DataFrame:
    """(key, collection, number, title, pattern, start, end, text): one row per section of a document.

    Sections shorter than ``min_chars`` are left out; of sections with the same
    number the last stays. The collection is ``prefix_sNN``.
    """

    @F.pandas_udf(SECTIONS)
    def sections(texts: pd.Series) -> pd.Series:
        names = ("number", "title", "pattern", "start", "end")
        return texts.map(
            lambda t: [
                {**dict(zip(names, s)), "body": t[s[3] : s[4]].strip()} for s in numbered_sections(t or "", patterns, gap)
            ]
        )

    bounded_batches(docs.sparkSession)
    rows = docs.select(key, F.explode(sections(F.col("text"))).alias("s")).select(key, "s.*")
    rows = rows.where(F.length("body") >= min_chars).withColumn("latest", -F.col("start"))
    last = keep_first(rows, [key, "number"], ["latest"]).drop("latest")
    name = F.concat(F.lit(f"{prefix}_s"), F.when(F.col("number") < 10, F.lit("0")).otherwise(F.lit("")), F.col("number"))
    return last.withColumn("collection", name).withColumnRenamed("body", "text")


# Typographic quotes and what they are read as.
QUOTES = ("‘’“”", "''\"\"")


def definitions(chunks: DataFrame, order: str) -> DataFrame:
    """(term, definition): defined terms of all chunks, the first per term (case ignored), length 10 to 1500.

    Both patterns run inside the JVM on the whole text. "First" is by the chunk's
    ``order``, then pattern, then place in the text.
    """
    text = F.translate("text", *QUOTES)
    breaks = lambda c: F.regexp_replace(c, r"<br\s*/?>", " ")

    def pairs(pattern: str, kind: int) -> Column:
        part = lambda i: F.regexp_extract_all("_text", F.lit(pattern), F.lit(i))
        return F.transform(
            F.arrays_zip(part(1).alias("t"), part(2).alias("d")),
            lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), z.t.alias("t"), z.d.alias("d")),
        )

    both = F.concat(pairs(fixed.DEFINITION_INLINE, 0), pairs(fixed.DEFINITION_ROW, 1))
    found = chunks.select(order, text.alias("_text")).select(order, F.explode_outer(both).alias("p")).where("p is not null")
    quotes = "\"'" + QUOTES[0] + "*"
    term = F.regexp_replace(collapse(breaks(F.col("p.t"))), rf"\A[{quotes}]+|[{quotes}]+\z", "")
    definition = F.regexp_replace(F.regexp_replace(collapse(breaks(F.col("p.d"))), r";+\z", ""), r"\.+\z", "")
    rows = found.select(order, "p.kind", "p.at", term.alias("term"), definition.alias("definition"))
    rows = rows.where(F.length("definition").between(*fixed.DEFINITION_LENGTH))
    return keep_first(rows, [F.lower("term")], [order, "kind", "at"]).select("term", "definition")
