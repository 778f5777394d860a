"""File-hash ledger: change detection between a file listing and what was ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.functions.text import content_hash

KEY = ["collection", "file_path"]


def listing(spark: SparkSession, collection: str, paths: list[str] | str) -> DataFrame:
    """(collection, file_path, hash) of files as they are now."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(
        F.lit(collection).alias("collection"), F.col("path").alias("file_path"), content_hash(F.col("content")).alias("hash")
    )


def changed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are new, differ from the ledger, or could not be hashed."""
    known = ledger.select(*KEY, F.col("hash").alias("_known"))
    fresh = F.col("hash").isNull() | F.col("_known").isNull() | (F.col("hash") != F.col("_known"))
    return files.join(known, KEY, "left").where(fresh).drop("_known")


def upsert(ledger: DataFrame, files: DataFrame, emptied: DataFrame | None = None) -> DataFrame:
    """The ledger with the rows of ``files`` put in place of older ones.

    A file that could not be hashed keeps its old row; those in ``emptied`` (collection,
    file_path) have nothing left and lose theirs.
    """
    new = files.where("hash is not null").groupBy(*KEY).agg(F.min("hash").alias("hash"))
    kept = ledger.select(*KEY, "hash").join(new.select(*KEY), KEY, "left_anti")
    if emptied is not None:
        kept = kept.join(emptied.select(*KEY).distinct(), KEY, "left_anti")
    return kept.unionByName(new)


def remove(ledger: DataFrame, collections: list[str]) -> DataFrame:
    return ledger.where(~F.col("collection").isin(collections))


def counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("collection").agg(F.count(F.lit(1)).alias("n_files"))
