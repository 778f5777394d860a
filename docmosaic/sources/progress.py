"""Progress of a batch product: finished batches in a folder, so that a stopped run goes on where it was.

A batch is written to a folder of its own under a name that readers skip and takes its place by one
rename. So a batch counts wholly or not at all, and one that was broken off leaves nothing that is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.plans.catalog import remaining

# Items of one batch, on average.
BATCH_ROWS = 50_000


class Progress:
    """Finished rows of one product under ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> list[str]:
        """The folders of finished batches, sorted."""
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        return sorted(f"{self.path}/{n}" for n in names if n.startswith("batch-"))

    def done(self) -> DataFrame | None:
        """All finished rows, or None before the first batch."""
        found = self.batches()
        return self.spark.read.parquet(*found) if found else None

    def commit(self, rows: DataFrame) -> None:
        """Write one batch and put it in place by a rename."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/_open-{name}")
        if not self._files.rename(self._at(f"_open-{name}"), self._at(f"batch-{name}")):
            raise OSError(f"cannot put batch {name} in place below {self.path}")

    def clear(self) -> None:
        """Delete the folder; for the end of a product, once its result is written."""
        self._files.delete(self._folder, True)

    def run(
        self, items: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], batch_rows: int = BATCH_ROWS
    ) -> DataFrame:
        """Rows of ``step`` over all items; those that an earlier run finished are taken as they are.

        ``step`` keeps ``key`` and gives each key at least one row. Batches are cut by a hash of the
        key, so rows that share a key are in one batch. A batch that fails does not keep the others
        from being finished; its error is raised after the last, and the next run does it again.
        """
        done = self.done()
        todo = items if done is None else remaining(items, done, key)
        n = todo.count()
        parts = -(-n // batch_rows)
        if parts > 1:
            todo = todo.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
        failed = None
        for p in range(parts):
            batch = todo.where(F.col("_part") == p).drop("_part") if parts > 1 else todo
            try:
                self.commit(step(batch))
            except Exception as error:  # noqa: BLE001
                failed = failed or error
        if failed is not None:
            raise failed
        if not self.batches():  # no items at all: the result has its columns and no row
            self.commit(step(items))
        return self.done()
