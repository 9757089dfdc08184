"""Re-issued prompts on a stream of lookups: a state per (domain, prompt) holds the last unflagged hit."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from promptloom.functions.text import strip_space

OUTPUT = "query_id string, previous_id string, gap_seconds double"
STATE = "last_id string, last_at double"


def reissue_stream(lookups: DataFrame, *, window_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """Streaming twin of the batch operator: ``(query_id, previous_id, gap_seconds)``, window inclusive.

    Rows later than the watermark are dropped; a key's state ends once its window has passed, so the state
    holds the prompts of the last window only. Rows of one key are ordered by time and id within a micro-batch.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_id, last_at = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).drop_duplicates("query_id").sort_values(["at", "query_id"])
        out: list[tuple[Any, Any, float]] = []
        for query_id, at in zip(rows["query_id"], rows["at"]):
            if query_id == last_id:
                continue
            if last_at is not None and 0 <= at - last_at <= window_seconds:
                out.append((query_id, last_id, round(at - last_at, 6)))
            if last_at is None or at >= last_at:
                last_id, last_at = query_id, at
        if last_at is not None:
            state.update((last_id, last_at))
            state.setTimeoutTimestamp(max(int((last_at + window_seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["query_id", "previous_id", "gap_seconds"])

    keyed = lookups.withWatermark("created_at", lateness).select("query_id", "domain", strip_space(F.col("query_prompt")).alias("prompt"), "created_at", (F.unix_micros("created_at") / 1e6).alias("at"))
    return keyed.groupBy("domain", "prompt").applyInPandasWithState(follow, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
