"""Writers of the batch products. Spark writes folders of part files; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.plans.catalog import page_lines


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sections(sections: DataFrame, path: str) -> None:
    """Markdown per section_key, one folder each."""
    sections.select("section_key", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("section_key").text(path)


def write_model(records: DataFrame, path: str, fmt: str = "both", markdown: DataFrame | None = None) -> None:
    """Model records as JSON, Markdown or both; csv stands for both, as the structured pair."""
    if fmt not in ("json", "markdown", "both", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    if fmt != "markdown":
        records.write.mode("overwrite").partitionBy("kind").text(f"{path}/json")
    if fmt != "json" and markdown is not None:
        markdown.select(F.col("markdown").alias("value")).write.mode("overwrite").text(f"{path}/markdown")


def write_catalog(pages: DataFrame, relationships: DataFrame, path: str) -> None:
    """The nested catalog, a JSON document a page in the order of the tree, and the relationships beside it."""
    page_lines(pages).write.mode("overwrite").text(f"{path}/nested")
    write_json(relationships, f"{path}/relationships")


def report_lines(ranked: DataFrame) -> DataFrame:
    """(query_id, rank, line) of a ranking report with status."""
    line = F.format_string("%3d  %-8s  %.4f  %s  %s", F.col("rank"), "status", F.col("score"), "collection", "preview")
    return ranked.select("query_id", "rank", line.alias("line"))
