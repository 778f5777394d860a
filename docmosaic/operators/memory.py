"""Conversation memory over a message table (conv_id, turn, role, text).

A conversation may be arbitrarily long, so frames are not computed by one window
over it: messages get their position from counts per block of turns, and a
block, together with the few messages before it, is the unit of a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.operators.ranking import top_k

BLOCK = 4096


def positions(messages: DataFrame, key: str = "conv_id", order: str = "turn", block: int = BLOCK) -> DataFrame:
    """Messages with ``position``, their 0-based place in the conversation.

    A window over a conversation sees one row per block of ``block`` turns, and
    a window over a block sees at most ``block`` messages.
    """
    placed = messages.withColumn("_block", F.floor(F.col(order) / block))
    counts = placed.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order)) - 1
    return placed.withColumn("_within", within).join(offsets, [key, "_block"]).select(
        *messages.columns, (F.col("_offset") + F.col("_within")).alias("position")
    )


def with_previous(messages: DataFrame, n: int, values: list[str], key: str = "conv_id", order: str = "turn", block: int = BLOCK) -> DataFrame:
    """Messages with ``previous``: structs of the up to ``n`` messages before each, oldest first.

    The last ``n`` messages of a block are also sent to the next one as context.
    """
    placed = positions(messages, key, order, block)
    home = F.floor(F.col("position") / block)
    edge = (F.col("position") % block) >= block - n
    targets = F.when(edge, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(targets))
    w = Window.partitionBy(key, "_block").orderBy("position").rowsBetween(-n, -1)
    previous = F.collect_list(F.struct(*values)).over(w)
    framed = spread.withColumn("previous", previous).where(F.col("_block") == F.col("_home"))
    return framed.drop("_block", "_home")


def context_strings(messages: DataFrame, n: int = 4) -> DataFrame:
    """(conv_id, turn, context): the last ``n`` messages without the current one, as ``ROLE: text`` lines."""
    framed = with_previous(messages, n - 1, ["role", "text"])
    lines = F.transform("previous", lambda m: F.concat(F.upper(m.role), F.lit(": "), m.text))
    return framed.select("conv_id", "turn", "role", F.array_join(lines, "\n").alias("context"))


def fifo(messages: DataFrame, limit: int = fixed.CHAT_LIMIT) -> DataFrame:
    """The newest ``limit`` messages per conversation; each task passes on no more than that."""
    return top_k(messages, ["conv_id"], limit, [F.col("turn").desc()], "_age").drop("_age")


def history(messages: DataFrame, limit: int = fixed.CHAT_LIMIT) -> DataFrame:
    """Kept messages without those of the system."""
    return fifo(messages, limit).where(F.col("role") != "system")


def transcript(messages: DataFrame, limit: int = fixed.CHAT_LIMIT) -> DataFrame:
    """(conv_id, transcript): kept messages as ``ROLE: text`` paragraphs. The limit bounds the group."""
    kept = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.upper("role"), F.lit(": "), "text").alias("line"))))
    return fifo(messages, limit).groupBy("conv_id").agg(
        F.array_join(F.transform(kept, lambda m: m.line), "\n\n").alias("transcript")
    )


def collapse_runs(rows: DataFrame, value: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows whose ``value`` differs from that of the row before (first of each run)."""
    framed = with_previous(rows, 1, [value], key, order)
    last = F.try_element_at("previous", F.lit(1))[value]
    return framed.where(last.isNull() | (last != F.col(value))).drop("previous")
