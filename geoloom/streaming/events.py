"""Streaming forms of the event log, the rate windows and the id registry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.registry import STATE_KEY


def deduplicated(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each state key once; keys are forgotten ``delay`` after their event."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(STATE_KEY))


def appended(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append deduplicated events to a Parquet log, exactly once, and stop when the input is read."""
    return deduplicated(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, key: str, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "2 minutes") -> DataFrame:
    """Events per key and sliding window."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), key).agg(F.count("*").alias("n"))


def registry_states(events: DataFrame) -> DataFrame:
    """(spring, first_seen, last_seen, n) after each batch, from (spring, day) sightings."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        for batch in batches:
            days = batch["day"].dropna()
            n += len(batch)
            if len(days):
                first = min(x for x in (first, days.min()) if x is not None)
                last = max(x for x in (last, days.max()) if x is not None)
        state.update((first, last, n))
        yield pd.DataFrame({"spring": [str(key[0])], "first_seen": [first], "last_seen": [last], "n": [n]})

    return events.groupBy("spring").applyInPandasWithState(update, "spring string, first_seen string, last_seen string, n long", "first_seen string, last_seen string, n long", "update", GroupStateTimeout.NoTimeout)
