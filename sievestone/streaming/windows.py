"""Measures over the last rows of a stream, with arbitrary state: a row out for a row in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that list states with a time to live need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class CountWindow(StatefulProcessor):
    """Means of flags over a row and the rows before it, ``size`` in all, of one key.

    The list state holds the flags of the last ``size - 1`` rows, a value state
    the number of rows so far. A timer, set anew with every batch of rows, clears
    both when a key has been idle; a time to live does so even if no timer fires.
    """

    def __init__(self, order: str, flags: list[str], size: int, idle_ms: int | None, schema: str):
        self.order, self.flags, self.size, self.idle_ms, self.schema = order, flags, size, idle_ms, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", ", ".join(f"`{f}` double" for f in self.flags), self.idle_ms)
        self.count = handle.getValueState("count", "n long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # a micro-batch's rows of one key
        held = np.array([list(r) for r in self.last.get()] if self.last.exists() else [], float).reshape(-1, len(self.flags))
        n = self.count.get()[0] if self.count.exists() else 0
        new = batch[self.flags].astype(float).to_numpy()
        every = np.concatenate([held, new])
        known = np.concatenate([np.zeros((1, len(self.flags))), np.cumsum(~np.isnan(every), axis=0)])
        total = np.concatenate([np.zeros((1, len(self.flags))), np.cumsum(np.nan_to_num(every), axis=0)])
        ends = np.arange(len(held), len(every)) + 1
        starts = np.maximum(0, ends - self.size)
        counted, summed = known[ends] - known[starts], total[ends] - total[starts]
        rates = np.divide(summed, counted, out=np.full_like(summed, np.nan), where=counted > 0)
        self.last.put([tuple(r) for r in every[max(0, len(every) - self.size + 1) :].tolist()]) if self.size > 1 else None
        self.count.update((n + len(batch),))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        out = pd.DataFrame({self.order: batch[self.order].to_numpy(), "number": n + 1 + np.arange(len(batch))})
        for i, f in enumerate(self.flags):
            out[f"{f}_rate"] = rates[:, i]
        out.insert(0, "key", key[0])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.count.clear()
        yield from ()

    def close(self) -> None:
        pass


def rolling_rates(stream: DataFrame, key: str, order: str, flags: list[str], size: int = 1000, idle_ms: int | None = None) -> DataFrame:
    """key, order, number, <flag>_rate for each row of a stream: ``history.rolling`` row by row, for rows that come in order.

    Rows of one micro-batch are put in order; across micro-batches they count
    as they come. ``number`` counts a key's rows from 1, so that chunks of a
    stream are ``(number - 1) div size``. Null flags count neither in sum nor in
    number; null keys are one key. State is at most ``size`` rows a key, and
    goes after ``idle_ms`` without rows, by a timer that keeps a query going, so
    one that should end by itself must not set it. Needs the settings of
    ``STORE``.
    """
    kinds = dict(stream.dtypes)
    rows = stream.select(F.col(key).alias("key"), order, *[F.col(f).cast("double").alias(f) for f in flags])
    schema = ", ".join([f"key {kinds[key]}", f"`{order}` {kinds[order]}", "number long", *(f"`{f}_rate` double" for f in flags)])
    processor = CountWindow(order, flags, size, idle_ms, schema)
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if idle_ms is not None else "None")


def chunk_measures(rated: DataFrame, size: int) -> DataFrame:
    """key, chunk, rows and the measures at the end of each chunk of ``size`` rows that is complete, of the rows of ``rolling_rates``."""
    ends = rated.where(F.col("number") % size == 0)
    return ends.select("key", (F.col("number") / size - 1).cast("long").alias("chunk"), F.lit(size).alias("rows"), *[c for c in rated.columns if c.endswith("_rate")])
