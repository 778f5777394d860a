"""Session helpers: settings that hold at scale, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when Spark's own size estimate, or else a count of
# the rows, shows that it is small. Anything larger takes the shuffle join.
BROADCAST_BYTES = 16 * 1024 * 1024
BROADCAST_ROWS = 200_000
# What an Arrow batch holds at most: a worker has several forms of one at a time.
BATCH_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 4096


def build_session(app: str = "docmosaic", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benches; on a cluster, spark-submit supplies master and sizes."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def bounded_batches(spark: SparkSession) -> None:
    """Limit what one Arrow batch holds by bytes as well as rows, so that long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def returning(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator of Arrow batches that gives a worker's free memory back to the machine when it ends.

    Workers are kept for later tasks; without this each would keep the most it ever held.
    """

    @wraps(run)
    def ended(*args, **kwargs):
        try:
            yield from run(*args, **kwargs)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library keeps its own house

    return ended


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="docmosaic-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path of this application in the shared folder."""
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in iterative jobs and saves a second pass over the source;
    a lost executor re-reads the written table instead of redoing the work.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these, once its successors are written and nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for the optimised plan (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` provably fits a broadcast: by estimate, else by counting rows and bytes.

    The count stops at ``max_rows``, so it is cheap on a large input too.
    """
    if estimated_bytes(df) <= BROADCAST_BYTES:
        return True

    def width(name: str, kind: str):
        if kind == "string":
            return F.coalesce(F.octet_length(name), F.lit(0))
        if kind.startswith(("array", "map")):
            return F.coalesce(F.octet_length(F.to_json(name)), F.lit(0))
        return F.lit(16)

    sizes = df.select(sum((width(n, k) for n, k in df.dtypes), F.lit(16)).alias("bytes"))
    rows, size = sizes.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("bytes")).first()
    return rows <= max_rows and (size or 0) <= 4 * BROADCAST_BYTES


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a side of checked size; leave larger sides to a shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def small_result(df: DataFrame, label: str = "small") -> DataFrame:
    """As ``small_side`` for the result of a costly plan: unless estimated small, it is written first,
    and its size is then that of the written table, so the plan runs once."""
    if estimated_bytes(df) <= BROADCAST_BYTES:
        return F.broadcast(df)
    return small_side(materialize(df, label))


def looked_up(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``found``, a written table.

    Keys that are few go to where the rows lie, so that only rows that are wanted travel to a join.
    """
    return rows.join(small_side(materialize(found.select(key).distinct(), "names")), key, "left_semi")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input of few splits; an input with enough splits is left as it lies.

    Hash partitioning by a key is deterministic, so a retried task sees the same rows.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) > 1024**3 or df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)
