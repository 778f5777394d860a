"""Incremental ingestion: new content only, by hash, from a stream of document files.

What was kept lies in folders by batch and by the first two digits of the hash. A batch reads
the hashes of its own prefixes alone, so a small batch does not pay for a long history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.functions.text import collapse, content_hash
from docmosaic.operators.ranking import keep_first
from docmosaic.session import discard, materialize

LEDGER = "hash string, collection string, doc_id bigint, text string, batch bigint, prefix string"
PREFIX = 2


def new_content(batch: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """First document per content hash of a batch, without the hashes ``seen``.

    Texts are compared by hash, and copies are combined before the shuffle.
    """
    hashed = batch.select(content_hash(collapse(F.col("text"))).alias("hash"), "collection", "doc_id", "text")
    first = keep_first(hashed, ["hash"], ["doc_id"])
    return first if seen is None else first.join(seen.select("hash"), "hash", "left_anti")


def run(spark: SparkSession, source: DataFrame, target: str, checkpoint: str, trigger: dict | None = None) -> DataFrame:
    """Drain a streaming source (collection, doc_id, text) into ``target``; returns what was kept.

    Of copies in one batch the lowest id is kept; over batches, the first to arrive.
    Every micro-batch owns the folder ``batch=<id>`` and overwrites it, so a
    batch replayed after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = materialize(new_content(batch, None), "batch")
        prefixes = [r[0] for r in fresh.select(F.left("hash", F.lit(PREFIX))).distinct().collect()]  # 256 at most
        seen = _kept(batch.sparkSession, target).where((F.col("batch") < batch_id) & F.col("prefix").isin(prefixes))
        kept = fresh.join(seen.select("hash"), "hash", "left_anti").withColumn("prefix", F.left("hash", F.lit(PREFIX)))
        kept.write.mode("overwrite").partitionBy("prefix").parquet(f"{target}/batch={batch_id}")
        discard(fresh)

    spark.createDataFrame([], LEDGER.replace(", batch bigint", "")).write.mode("ignore").partitionBy("prefix").parquet(f"{target}/batch=-1")
    query = (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    query.awaitTermination()
    return _kept(spark, target)


def _kept(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(target)
