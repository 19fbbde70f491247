"""The ledger as keyed state: puts compare versions, entries expire by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: days that an entry is kept.
KEEP_DAYS = 7
OUTPUT = "key string, at timestamp, claims long, version long, outcome string"


def fault() -> Column:
    """Why a put is corrupt, or null."""
    return F.when(F.coalesce(F.trim("key"), F.lit("")) == "", "no key").when(F.col("at").isNull(), "no date").when(F.col("claims") < 0, "negative claims")


def refused(puts: DataFrame) -> DataFrame:
    """The corrupt rows of a stream of puts, with ``reason``; ``ledger_states`` leaves them out."""
    return puts.withColumn("reason", fault()).where("reason is not null")


class _Ledger(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at_ms long, claims long, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], self.entry.get() if self.entry.exists() else None
        puts = pd.concat(list(rows)).sort_values(["at", "expected", "claims"], na_position="first")
        for put in puts.itertuples(index=False):
            version = now[2] if now else 0
            if not pd.isna(put.expected) and int(put.expected) != version:
                out.append((key[0], put.at, put.claims, version, "lost the race"))
                continue
            at_ms = int(pd.Timestamp(put.at).value // 1_000_000)
            if now and at_ms < now[0]:
                out.append((key[0], put.at, put.claims, version, "older than the entry"))
                continue
            now = (at_ms, 0 if pd.isna(put.claims) else int(put.claims), version + 1)
            out.append((key[0], put.at, now[1], now[2], "put"))
        if now:
            self.entry.update(now)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now[0] + KEEP_DAYS * 86_400_000)
        yield pd.DataFrame(out, columns=["key", "at", "claims", "version", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at_ms, claims, version = self.entry.get()
        self.entry.clear()
        yield pd.DataFrame({"key": [key[0]], "at": [pd.Timestamp(at_ms, unit="ms")], "claims": [claims], "version": [version], "outcome": ["expired"]})

    def close(self) -> None:
        pass


def ledger_states(puts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """What became of each put of a stream (key, at, claims, expected), and each entry that expires.

    A put says which version it read (``expected``: 0 for a new entry, null for any) and is taken only if that
    is the entry's; of two that read the same version one loses.  An entry goes when event time passes ``KEEP_DAYS`` after
    its date, and its key starts again at version 0.  Rows later than ``delay`` behind the stream are refused by the
    watermark, corrupt ones by ``fault``.  State is one small row a key.  The session must name RocksDB as
    its state store.
    """
    sound = puts.where(fault().isNull()).select("key", "at", F.col("claims").cast("long").alias("claims"), F.col("expected").cast("long").alias("expected"))
    return sound.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(_Ledger(), OUTPUT, outputMode="Update", timeMode="EventTime")
