"""Bounded conversation memory kept as state of a message stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docmosaic.functions import fixed

ROWS = "conv_id bigint, turn bigint, role string, text string"
STATE = "turns array<bigint>, roles array<string>, texts array<string>"


def bounded(messages: DataFrame, limit: int = fixed.CHAT_LIMIT) -> DataFrame:
    """Stream of (conv_id, turn, role, text) to the newest ``limit`` messages of each changed conversation.

    Incoming batches are reduced as they arrive, so a conversation of any length
    takes state and memory for ``limit`` messages.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(("turn", "role", "text"), state.get)) if state.exists else {"turn": [], "role": [], "text": []}
        rows = pd.DataFrame(held)
        for frame in frames:
            rows = pd.concat([rows, frame[["turn", "role", "text"]]])
            rows = rows.drop_duplicates("turn", keep="last").sort_values("turn").tail(limit)
        state.update(([int(t) for t in rows["turn"]], rows["role"].tolist(), rows["text"].tolist()))
        rows.insert(0, "conv_id", key[0])
        yield rows.astype({"conv_id": "int64", "turn": "int64"})

    return messages.groupBy("conv_id").applyInPandasWithState(
        update, ROWS, STATE, "update", GroupStateTimeout.NoTimeout
    )
