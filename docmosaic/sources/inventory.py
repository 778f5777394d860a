"""Inventory of fact sheets: typed collections and their Markdown."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.text import ellipsis, interface_endpoints, strip

COLUMNS = ("id", "type", "name", "displayName", "description", "level", "status", "lxState")
SHEET = "id string, type string, name string, description string, level string, status string"


def non_empty(rows: DataFrame) -> DataFrame:
    """Rows with at least one value."""
    return rows.where(F.coalesce(*[F.col(c).cast("string") for c in rows.columns]).isNotNull())


def typed(inventory: DataFrame, prefix: str) -> DataFrame:
    """Fact sheets of the known types with their collection ``prefix_<type>`` and title."""
    title = F.create_map(*[F.lit(x) for t, _, label in fixed.INVENTORY_TYPES for x in (t, label)])
    suffix = F.create_map(*[F.lit(x) for t, s, _ in fixed.INVENTORY_TYPES for x in (t, s)])
    known = inventory.where(F.col("type").isin([t for t, _, _ in fixed.INVENTORY_TYPES]))
    return known.select(
        "*",
        F.concat(F.lit(f"{prefix}_"), F.try_element_at(suffix, F.col("type"))).alias("collection"),
        F.try_element_at(title, F.col("type")).alias("title"),
    )


def markdown_row(quality_state: Column | None = None) -> Column:
    """Markdown of one fact sheet (columns id, type, name, description, level)."""
    line = lambda label, c: F.when(
        F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{label}**: "), c, F.lit("  \n"))
    ).otherwise(F.lit(""))
    source, target = interface_endpoints(F.col("name"))
    flow = F.when(
        (F.col("type") == "Interface") & source.isNotNull() & target.isNotNull(),
        F.concat(F.lit("**Data flow**: "), source, F.lit(" → "), target, F.lit("  \n")),
    ).otherwise(F.lit(""))
    text = strip(F.coalesce("description", F.lit("")))
    body = F.when(text == "", F.lit("_No description recorded in LeanIX._")).otherwise(ellipsis(text))
    state = F.lit("") if quality_state is None else line("Quality State", quality_state)
    return F.concat(
        F.lit("## "), F.col("name"), F.lit("\n\n**LeanIX ID**: `"), F.col("id"), F.lit("`  \n"),
        line("Level", F.col("level")), state, flow, F.lit("\n"), body, F.lit("\n\n---"),
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, name, description, level, status) from the keyed inventory document.

    A missing file gives no rows.
    """
    schema = f"metadata map<string,string>, fact_sheets map<string,struct<{SHEET.replace(' string', ':string')}>>"
    try:
        doc = spark.read.option("multiLine", True).schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SHEET)
    return doc.select(F.explode("fact_sheets").alias("key", "sheet")).select(
        F.col("key").alias("id"), "sheet.type", "sheet.name", "sheet.description", "sheet.level", "sheet.status"
    )


def read_markdown(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, suffix, text) of inventory workbooks: one Markdown section per fact sheet of a known type."""
    from docmosaic.sources import xlsx

    xlsx.register(spark)
    out = None
    for path in paths:
        rows = non_empty(spark.read.format("workbook").load(path))
        have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        named = rows.select(
            have("id").alias("id"), have("type").alias("type"), F.coalesce(have("name"), have("displayName"), F.lit("Unknown")).alias("name"),
            have("description").alias("description"), have("level").alias("level"), have("lxState").alias("state"),
        )
        sheets = typed(named, "x").select(
            F.lit(path).alias("path"), F.substring("collection", 3, 100).alias("suffix"), markdown_row(F.col("state")).alias("text")
        )
        out = sheets if out is None else out.unionByName(sheets)
    return out
