"""Groups dealt out as tiles: the rows of a key in blocks, every pair of blocks one unit of work."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, keys: list[str], tie: str, block: int) -> DataFrame:
    """Rows of keys that two rows or more have, with (own, i, j) added.

    A key of n rows is cut by the hash of ``tie`` into ``ceil(n / block)`` blocks; ``own`` is
    the row's block, and the row takes part in the tiles (i, j), i <= j, that hold it. Any two
    rows of a key so meet in some tile, and no tile has many more than twice ``block`` rows.
    """
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_of_key")).where("rows_of_key > 1")
    blocks = F.ceil(F.col("rows_of_key") / block).cast("int")
    cut = rows.join(many, keys).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(tie), F.col("blocks")).cast("int"))
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("rows_of_key", "blocks", "other")


def dealt(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Each tile whole and in one piece, next to the others of its task in the order of ``keys``."""
    return tiles.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def packs(batches: Iterator[pa.RecordBatch], same: list[str], tile: list[str], least: int) -> Iterator[pa.Table]:
    """Whole tiles in a row that agree in ``same``, put together until they have ``least`` rows.

    Rows arrive in the order of ``dealt``. One pack at a time is held, and a tile cut by a batch is joined again.
    """
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        names = [batch.column(k).to_pylist() for k in tile]
        marks, starts = list(zip(*names)), [0]
        starts += [k for k in range(1, len(marks)) if marks[k] != marks[k - 1]]
        at = 0
        for k in starts:
            mark = marks[k]
            if mark == last:
                continue
            apart = last is not None and any(a != b for a, b, n in zip(mark, last, tile) if n in same)
            if rows + k - at >= least or apart:
                if k > at:
                    held.append(batch.slice(at, k - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, rows, at = [], 0, k
            last = mark
        if len(marks) > at:
            held.append(batch.slice(at))
            rows += len(marks) - at
            last = marks[-1]
    if held:
        yield pa.Table.from_batches(held)
