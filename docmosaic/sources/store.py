"""Chunk store: one Spark table partitioned by collection, read by vector and text search alike."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = (
    "doc_id STRING, chunk_id BIGINT, pos BIGINT, content_type STRING, text STRING, "
    "embedding ARRAY<FLOAT>, metadata MAP<STRING,STRING>, collection STRING"
)
LEDGER = "file_path STRING, hash STRING, collection STRING"


class ChunkStore:
    """Collections as partitions; every change rewrites or drops partitions only."""

    def __init__(self, spark: SparkSession, table: str = "chunks", ledger: str = "file_hashes") -> None:
        self.spark, self.table, self.ledger_table = spark, table, ledger
        for name, columns in ((table, COLUMNS), (ledger, LEDGER)):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (collection)")

    # chunks

    def chunks(self, collections: list[str] | None = None) -> DataFrame:
        """Chunks of some or all collections; the predicate prunes partitions."""
        rows = self.spark.table(self.table)
        return rows if collections is None else rows.where(F.col("collection").isin(collections))

    def write(self, chunks: DataFrame, rebuild: bool = False) -> None:
        """Add chunks, or put them in place of the collections they belong to.

        The rebalance hint lets the runtime size the files: small collections
        are put together, a large one is split over many tasks.
        """
        ordered = chunks.select(*self.spark.table(self.table).columns).hint("rebalance", "collection")
        if rebuild:
            self._overwrite(ordered, self.table)
        else:
            ordered.write.mode("append").insertInto(self.table)

    def _overwrite(self, rows: DataFrame, table: str) -> None:
        """Replace only the partitions that ``rows`` has."""
        key = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")
        try:
            rows.write.mode("overwrite").insertInto(table)
        finally:
            self.spark.conf.set(key, before)

    def collections(self, prefix: str | None = None) -> list[str]:
        names = self._partitions(self.table)
        return [n for n in names if prefix is None or n.startswith(f"{prefix}_")]

    def drop(self, collection: str, ledger: bool = True) -> None:
        """Drop a collection, and unless told otherwise its ledger rows."""
        quoted = collection.replace("\\", "\\\\").replace("'", "\\'")
        for name in (self.table, self.ledger_table)[: 1 + ledger]:
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (collection = '{quoted}')")

    def _partitions(self, table: str) -> list[str]:
        """Collections that a table has; partition names come URL-encoded."""
        rows = self.spark.sql(f"SHOW PARTITIONS {table}").collect()
        return sorted(unquote(r[0].split("=", 1)[1]) for r in rows)

    def _known(self) -> list[str]:
        """Collections of the chunks and of the ledger: a split config is recorded under its prefix alone."""
        return sorted({*self._partitions(self.table), *self._partitions(self.ledger_table)})

    def drop_prefix(self, prefix: str, confirm: bool = False) -> list[str]:
        """Drop ``prefix`` itself and all ``prefix_*``; without ``confirm`` only list them."""
        names = [n for n in self._known() if n == prefix or n.startswith(f"{prefix}_")]
        if confirm:
            for n in names:
                self.drop(n)
        return names

    def drop_all(self, confirm: bool = False) -> list[str]:
        names = self._known()
        if confirm:
            for n in names:
                self.drop(n)
        return names

    def status(self) -> DataFrame:
        """(collection, n_chunks, n_indexed, missing) with a TOTAL row."""
        from docmosaic.sources.catalog import status

        rows = self.chunks()
        return status(rows, rows.where("embedding is not null"))

    # ledger

    def ledger(self) -> DataFrame:
        return self.spark.table(self.ledger_table).select("collection", "file_path", "hash")

    def record(self, files: DataFrame, emptied: DataFrame | None = None) -> None:
        """Put the hashes of ingested files in the ledger and take out the emptied ones; only their collections are rewritten."""
        from docmosaic.session import materialize
        from docmosaic.sources.hashes import upsert

        touched = files.select("collection")
        touched = (touched if emptied is None else touched.unionByName(emptied.select("collection"))).distinct()
        old = self.ledger().join(touched, "collection", "left_semi")
        rows = materialize(upsert(old, files, emptied), "ledger").select("file_path", "hash", "collection")
        self._overwrite(rows, self.ledger_table)
