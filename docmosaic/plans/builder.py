"""Model builder: candidate terms per topic, relationships of pairs, terms of reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.functions import parse
from docmosaic.functions.text import first_nonblank, strip
from docmosaic.operators.matching import topic_pairs
from docmosaic.operators.ranking import keep_first
from docmosaic.plans.catalog import remaining

# Answers come as a column ``answer``; an answering step is a function DataFrame -> DataFrame that adds it.


def candidate_terms(answers: DataFrame) -> DataFrame:
    """(ord, topic, term, definition, category, governance) of the answers per topic (ord, topic, answer)."""
    blocks = answers.select("ord", "topic", F.posexplode(parse.term_blocks(F.col("answer"))).alias("block", "b"))
    return blocks.select(F.struct("ord", "block").alias("ord"), "topic", "b.*").where("term <> ''")


def candidate_pairs(terms: DataFrame) -> DataFrame:
    """(topic, entity_a, entity_b) to ask about: pairs of the first five terms per topic."""
    return topic_pairs(terms.select("ord", "topic", strip(F.col("term")).alias("term")))


def relationships(answers: DataFrame) -> DataFrame:
    """(entity_a, entity_b, relationship, direction, rules) of answers per pair."""
    return answers.select("entity_a", "entity_b", *parse.relation_fields(F.col("answer")))


def unique_terms(terms: DataFrame) -> DataFrame:
    """First candidate per term, case ignored."""
    return keep_first(terms, [F.lower(strip(F.col("term")))], ["ord"])


def terms_of_reference(terms: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per unique term; fields missing in its answer fall back to the candidate's.

    ``answers`` has (term, answer).
    """
    told = answers.select(F.col("term").alias("_term"), *parse.reference_fields(F.col("answer")))
    told = told.withColumnsRenamed({"category": "_category"})
    rows = unique_terms(terms).join(told, F.col("term") == F.col("_term"), "left")
    pick = lambda a, b, name: F.coalesce(first_nonblank(F.col(a), F.col(b)), F.lit("")).alias(name)
    return rows.select(
        "term",
        pick("_category", "category", "category"),
        pick("formal_definition", "definition", "formal_definition"),
        pick("governance_rules", "governance", "governance_rules"),
        F.coalesce("related_terms", F.lit("")).alias("related_terms"),
        F.col("topic").alias("source_topic"),
    )


def resume(topics: DataFrame, done: DataFrame) -> DataFrame:
    """Topics without a finished row, compared topic by topic."""
    return remaining(topics, done.select(F.col("source_topic").alias("topic")), "topic")
