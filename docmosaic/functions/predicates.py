"""Predicates on answers, definitions and labels."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.text import strip


def _let(value: Column, body) -> Column:
    """``body`` applied to ``value`` computed once; plain reuse of a column repeats its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts_with_any(c: Column, openings) -> Column:
    return reduce(or_, [F.startswith(c, F.lit(o)) for o in openings])


def _contains_any(c: Column, fragments) -> Column:
    return reduce(or_, [F.contains(c, F.lit(f)) for f in fragments])


def _substantive(text: Column, denials) -> Column:
    kept = lambda t: (t != "") & ~F.startswith(t, F.lit("[Error:"))
    return _let(text, lambda t: kept(t) & _let(F.lower(t), lambda low: ~_starts_with_any(low, denials)))


def real_definition(definition: Column) -> Column:
    """Substantive definition: not blank, no error marker, not a known denial."""
    return _substantive(strip(F.coalesce(definition, F.lit(""))), fixed.NO_DEFINITION)


def real_governance(governance: Column) -> Column:
    """Substantive governance text. An error marker does not count as content."""
    text = strip(F.regexp_replace(strip(F.coalesce(governance, F.lit(""))), r"\A\*+", ""))
    return _substantive(text, fixed.NO_GOVERNANCE)


def boilerplate(text: Column) -> Column:
    head = F.left(F.lower(strip(text)), F.lit(fixed.BOILERPLATE_SPAN))
    return _let(head, lambda h: _contains_any(h, fixed.BOILERPLATE))


def quality_gate(response: Column, min_length: int = fixed.QUALITY_MIN_LENGTH) -> Column:
    """Struct of passed, score and reasons for a synthesised answer."""

    def signals(text: Column) -> Column:
        def from_lower(low: Column) -> Column:
            return F.struct(
                F.length(text).alias("n"),
                (F.length(text) >= min_length).alias("long_enough"),
                low.rlike(fixed.CITATION).alias("cited"),
                _contains_any(F.left(low, F.lit(fixed.GENERIC_SPAN)), fixed.GENERIC).alias("generic"),
                (_contains_any(low, fixed.DENIALS) & (F.length(text) < fixed.DENIAL_LENGTH)).alias("denial"),
            )

        return _let(F.lower(text), from_lower)

    def verdict(s: Column) -> Column:
        points = lambda cond, p: F.when(cond, F.lit(p)).otherwise(F.lit(0))
        tenths = points(s.long_enough, 3) + points(s.cited, 3) + points(~s.generic, 2) + points(~s.denial, 2)
        score = tenths.cast("double") / F.lit(10.0)
        blank = s.n == 0
        reasons = F.array_compact(
            F.array(
                F.when(
                    ~s.long_enough, F.concat(F.lit("too short ("), s.n, F.lit(f" < {min_length} chars)"))
                ),
                F.when(s.cited, F.lit("has citations")).otherwise(F.lit("no rule/section citations found")),
                F.when(s.generic, F.lit("starts with generic/negative phrase")),
                F.when(s.denial, F.lit("response is negative definition boilerplate only")),
            )
        )
        passed = (score >= fixed.QUALITY_PASS) & s.long_enough & ~s.generic & ~s.denial & ~blank
        return F.struct(
            passed.alias("passed"),
            F.when(blank, F.lit(0.0)).otherwise(score).alias("score"),
            F.when(blank, F.array(F.lit("empty response"))).otherwise(reasons).alias("reasons"),
        )

    return _let(_let(strip(F.coalesce(response, F.lit(""))), signals), verdict)


def bucket(label: Column) -> Column:
    """Bucket of an uncategorised label; the first list with a hit wins."""


    def first_hit(low: Column) -> Column:
        hits = [F.when(_contains_any(low, fragments), F.lit(name)) for name, fragments in fixed.BUCKETS]
        return F.coalesce(*hits, F.lit("other"))

    return _let(F.lower(label), first_hit)


def review_status(tier: Column, confidence: Column) -> Column:
    return (
        F.when((tier == "existing") & (confidence == "high"), F.lit("PENDING"))
        .when(tier == "new_proposed", F.lit("PROPOSED_NEW_TAXONOMY"))
        .otherwise(F.lit("NEEDS_CLARIFICATION"))
    )


def coverage_verdict(top_score: Column, found: Column) -> Column:
    out = F.when((found == 0) | top_score.isNull(), F.lit("ABSENT"))
    for floor, name in fixed.COVERAGE_BANDS:
        out = out.when(top_score >= floor, F.lit(name))
    return out.otherwise(F.lit("ABSENT"))
