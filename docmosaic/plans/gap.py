"""Gap analysis between model names and names found in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.functions.text import first_nonblank, normalize


def candidate_names(candidates: DataFrame) -> DataFrame:
    """(ord, name) from rows that carry the name as entity_name, entity or term."""
    present = [F.col(c) for c in ("entity_name", "entity", "term") if c in candidates.columns]
    return candidates.select("ord", first_nonblank(*present).alias("name")).where("name is not null")


def _keyed(names: DataFrame, label: str) -> DataFrame:
    """Last spelling per normalised name. Unique keys keep the full outer join free of skew."""
    return names.groupBy(normalize(F.col("name")).alias("normalized_name")).agg(F.max_by("name", "ord").alias(label))


def gap_analysis(model: DataFrame, found: DataFrame) -> DataFrame:
    """(normalized_name, model_name, handbook_name, status) over both sets of (ord, name)."""
    rows = _keyed(model, "model_name").join(_keyed(found, "handbook_name"), "normalized_name", "full_outer")
    status = (
        F.when(F.col("model_name").isNotNull() & F.col("handbook_name").isNotNull(), F.lit("MATCHED"))
        .when(F.col("model_name").isNotNull(), F.lit("MODEL_ONLY"))
        .otherwise(F.lit("HANDBOOK_ONLY"))
    )
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select("normalized_name", status.alias("status"), blank("model_name"), blank("handbook_name"))


def gap_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
