"""Parsers for answers of a language model: labelled fields, key-value blocks, actions, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.text import strip


def labelled_field(response: Column, label: str, ignore_case: bool = False) -> Column:
    """Text after ``LABEL:`` up to the next line that starts with a label."""
    flags = "(?si)" if ignore_case else "(?s)"
    stop = r"(?=\n[A-Z_]+:|\z)" if ignore_case else r"(?=\n+[A-Z_]+:|\z)"
    return strip(F.regexp_extract(response, rf"{flags}{label}:\s*(.*?){stop}", 1))


def context_fields(response: Column, ignore_case: bool = False) -> list[Column]:
    return [labelled_field(response, label, ignore_case).alias(name) for label, name in fixed.CONTEXT_FIELDS]


def line_field(lines: Column, key: str) -> Column:
    """Value of the last line that starts with ``KEY:`` (lines already stripped)."""
    hits = F.filter(lines, lambda s: F.startswith(s, F.lit(f"{key}:")))
    return F.coalesce(strip(F.substring(F.try_element_at(hits, F.lit(-1)), len(key) + 2, 2**31 - 1)), F.lit(""))


def stripped_lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"), strip)


def term_blocks(response: Column) -> Column:
    """Array of structs, one per block of lines; blank lines end a block once it has a term.

    A block that has no term yet is carried into the next one, so the blocks
    are cut only after blank lines that follow a TERM line.
    """
    joined = F.array_join(stripped_lines(response), "\n")
    cut = F.regexp_extract_all(joined, F.lit(r"(?s).*?(?<![^\n])TERM:[ \t]*\S.*?(?:\n\n|\z)"), F.lit(0))

    def block(part):
        lines = F.split(part, "\n")
        return F.struct(*[line_field(lines, k).alias(k.lower()) for k in fixed.TERM_FIELDS])
    return F.transform(cut, block)


def reference_fields(response: Column) -> list[Column]:
    lines = stripped_lines(response)
    return [line_field(lines, k).alias(k.lower()) for k in fixed.REFERENCE_FIELDS]


def relation_fields(response: Column) -> list[Column]:
    lines = stripped_lines(response)
    return [line_field(lines, k).alias(k.lower()) for k in fixed.RELATION_FIELDS]


def json_object(response: Column) -> Column:
    """Widest ``{...}`` in the text, or NULL."""
    return F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))


def action_list(text: Column, key: str) -> Column:
    """List after ``key:``; either quote style, or bare values split at commas."""
    raw = F.regexp_extract(text, rf"(?i){key}:\s*(\[[^\]]*\])", 1)
    parsed = F.from_json(F.replace(raw, F.lit("'"), F.lit('"')), "array<string>")
    bare = F.filter(
        F.transform(F.split(F.regexp_replace(raw, "[\\[\\]\"']", ""), ","), strip), lambda s: s != ""
    )
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, bare))


def action(text: Column) -> Column:
    """Struct(kind, query, sections, terms); anything unreadable is DONE."""
    body = strip(text)
    head = F.upper(body)
    query = strip(F.regexp_extract(body, r'(?i)query:\s*"([^"]+)"', 1))
    none = F.array().cast("array<string>")
    kind = (
        F.when(F.startswith(head, F.lit("KEYWORD")), F.lit("KEYWORD"))
        .when(F.startswith(head, F.lit("RETRIEVE")) & (query != ""), F.lit("RETRIEVE"))
        .otherwise(F.lit("DONE"))
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "RETRIEVE", query).otherwise(F.lit("")).alias("query"),
        F.when(kind == "RETRIEVE", action_list(body, "sections")).otherwise(none).alias("sections"),
        F.when(kind == "KEYWORD", action_list(body, "terms")).otherwise(none).alias("terms"),
    )


def alias_candidates(response: Column, name: Column) -> Column:
    """Comma list of suggested aliases: lower case, 2 to 60 characters, not the name, at most four."""
    words = F.transform(F.split(response, ","), lambda s: F.lower(strip(s)))
    kept = F.filter(words, lambda s: F.length(s).between(2, 60) & (s != F.lower(name)))
    return F.slice(kept, 1, 4)
