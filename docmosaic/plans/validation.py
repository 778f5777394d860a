"""Validation of the conceptual model: per-domain completeness and acceptance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completeness(entities: DataFrame) -> DataFrame:
    """(domain, total, with_id, no_id, subgroup, id_pct, subgroup_pct) with a TOTAL row; whole percents, floored."""
    with_id = F.count_if(F.col("fact_sheet_id") != "")
    rows = entities.rollup("domain").agg(
        F.count(F.lit(1)).alias("total"),
        with_id.alias("with_id"),
        F.count_if(F.col("fact_sheet_id") == "").alias("no_id"),
        F.count_if(F.col("subgroup") != "").alias("subgroup"),
        F.grouping("domain").alias("is_total"),
    )
    pct = lambda c: F.floor(100 * F.col(c) / F.col("total")).alias(f"{c}_pct")
    name = F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col("domain"))
    return rows.select(name.alias("domain"), "total", "with_id", "no_id", "subgroup", pct("with_id"), pct("subgroup"))


def acceptance(entities: DataFrame, min_entities: int = 150, min_subtypes: int = 100) -> DataFrame:
    """(check_name, passed, detail): ids complete, enough entities, enough with a subtype."""
    facts = entities.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("fact_sheet_id") != "").alias("with_id"),
        F.count_if(F.col("subgroup") != "").alias("with_subtype"),
    )

    def check(name: str, passed: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), passed.alias("passed"), detail.alias("detail"))

    n, ids, subs = F.col("n"), F.col("with_id"), F.col("with_subtype")
    checks = F.array(
        check(
            "fact_sheet_ids",
            (ids == n) & (n > 0),
            F.when((ids == n) & (n > 0), F.lit("complete")).when(ids == 0, F.lit("none")).otherwise(F.lit("partial")),
        ),
        check("entity_count", n >= min_entities, n.cast("string")),
        # an empty subgroup field is noted but is not an issue
        check("subtypes", (subs >= min_subtypes) | (subs == 0), subs.cast("string")),
    )
    return facts.select(F.explode(checks).alias("c")).select("c.*")
