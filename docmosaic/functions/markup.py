"""Markup: label cleaning, page text and diagram style decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.text import collapse

# Entities decoded in labels, in this order.
LABEL_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#10;", "\n"))


def clean_label(label: Column) -> Column:
    """Tags removed, five entities decoded, whitespace collapsed."""
    out = F.regexp_replace(F.coalesce(label, F.lit("")), "<[^>]+>", "")
    for entity, char in LABEL_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def page_text(html: Column) -> Column:
    """Readable text of a page: no scripts, styles or comments; a blank per tag."""
    out = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, char in (*LABEL_ENTITIES[1:], LABEL_ENTITIES[0]):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def _end(style: Column, key: str) -> Column:
    out = None
    for arrow, mark in fixed.ARROWS:
        hit = F.contains(style, F.lit(f"{key}={arrow}"))
        out = F.when(hit, F.lit(mark)) if out is None else out.when(hit, F.lit(mark))
    return out


def cardinality(style: Column) -> Column:
    """``start-end`` of an edge style; NULL when neither arrow is known."""
    start, end = _end(style, "startArrow"), _end(style, "endArrow")
    blank = F.lit("")
    return F.when(
        start.isNotNull() | end.isNotNull(),
        F.concat(F.coalesce(start, blank), F.lit("-"), F.coalesce(end, blank)),
    )


def relationship_type(style: Column) -> Column:
    out = None
    for token, name in fixed.EDGE_STYLES:
        hit = F.contains(style, F.lit(f"edgeStyle={token}"))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def cardinality_phrase(mark: Column) -> Column:
    phrases = F.create_map(*[F.lit(x) for pair in fixed.CARDINALITY_PHRASES for x in pair])
    known = F.try_element_at(phrases, mark)
    return (
        F.when(F.coalesce(mark, F.lit("")) == "", F.lit("relates to"))
        .when(known.isNotNull(), known)
        .otherwise(F.concat(F.lit("relates to ("), mark, F.lit(")")))
    )
