"""State per key, carried from batch to batch in the engine's own state store."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from brindle.session import scratch_path
from brindle.streaming.replay import run_to_table, state_on_disk

#: How two reduced values of a key are put together.
TOGETHER = {"sum": lambda a, b: a + b, "min": min, "max": max}


class _PerKey(StatefulProcessor):
    """One value per key; with ``silent``, a timer brings the key back in every batch without rows."""

    def __init__(self, key: str, reduce: Mapping[str, str], update: Callable, kind: str, silent: bool):
        self.key, self.reduce, self.update, self.kind, self.silent = key, dict(reduce), update, kind, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"value {self.kind}, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total: dict[str, Any] = {}
        for frame in rows:
            for column, how in self.reduce.items():
                got = getattr(frame[column], how)(**({"min_count": 1} if how == "sum" else {}))
                if not pd.isna(got):
                    got = got.item() if hasattr(got, "item") else got
                    total[column] = TOGETHER[how](total[column], got) if column in total else got
        yield self._moved(key, {c: total.get(c) for c in self.reduce}, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._moved(key, None, timerValues)

    def _moved(self, key, new: dict[str, Any] | None, timerValues) -> pd.DataFrame:
        old, due = self.state.get() if self.state.exists() else (None, None)
        if due is not None and new is not None:
            self.handle.deleteTimer(due)
        value = self.update(old, new)
        if value is None:
            self.state.clear()
        else:
            due = timerValues.getCurrentProcessingTimeInMs() + 1 if self.silent else None
            self.state.update((value, due))
            if due is not None:
                self.handle.registerTimer(due)
        return pd.DataFrame({self.key: pd.Series([key[0]], dtype=object), "state": pd.Series([value], dtype=object)})

    def close(self) -> None:
        pass


class KeyedState:
    """A value per key that every micro-batch updates.

    ``reduce`` names how each column of the batch is reduced per key (sum, min
    or max), first where the rows are read and again for the key.  ``update``
    gets the old value (None for a new key) and the reduced columns as a dict,
    and answers the new value; None drops the key.  With ``silent`` it is also
    called, with None for the columns, for every key that has a value but no
    rows in the batch: a processing-time timer, set anew in every batch, brings
    the key back.  Without it a batch costs what its own keys cost.

    The values are in RocksDB, and a commit writes the changes alone; a query
    that is started again goes on from its checkpoint.
    """

    def __init__(self, key: str, reduce: Mapping[str, str], update: Callable, state_type: str, silent: bool = True):
        if unknown := set(reduce.values()) - set(TOGETHER):
            raise ValueError(f"reduce by one of {', '.join(TOGETHER)}, not {', '.join(sorted(unknown))}")
        self.key, self.reduce, self.update, self.kind, self.silent = key, dict(reduce), update, state_type, silent

    def changes(self, stream: DataFrame) -> DataFrame:
        """Rows (key, state) of the keys a batch has touched, state null for a dropped one; for update mode."""
        kinds = dict(stream.dtypes)
        columns = [self.key, *self.reduce]
        key, reduce, schema = self.key, self.reduce, ", ".join(f"`{c}` {kinds[c]}" for c in columns)

        def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    got = pa.Table.from_batches([batch]).group_by(key).aggregate(list(reduce.items()))
                    got = got.select([key, *[f"{c}_{how}" for c, how in reduce.items()]]).rename_columns(columns)
                    yield from got.cast(pa.schema([batch.schema.field(c) for c in columns])).to_batches()

        reduced = stream.select(*columns).mapInArrow(partial, schema)
        processor = _PerKey(key, reduce, self.update, self.kind, self.silent)
        out = f"`{key}` {kinds[key]}, state {self.kind}"
        return reduced.groupBy(key).transformWithStateInPandas(processor, out, "Update", "ProcessingTime" if self.silent else "None")

    def run(
        self, stream: DataFrame, label: str, checkpoint: str | None = None, out: str | None = None, feeds=()
    ) -> tuple[DataFrame, str, str]:
        """Process what is available; returns (state table, checkpoint folder, folder of the changes of each batch)."""
        spark = stream.sparkSession
        checkpoint = checkpoint or scratch_path(spark, f"{label}-state")
        out = out or scratch_path(spark, f"{label}-keyed")
        with state_on_disk(spark):
            table = run_to_table(self.changes(stream), label, "update", [self.key], checkpoint, out, feeds)
        return table.filter("state IS NOT NULL"), checkpoint, out


def running_counts_with_timeout(stream: DataFrame, key: str, time: str, idle_ms: int) -> DataFrame:
    """Running count per key in the engine's own state store.

    The stream carries a watermark on ``time``.  A key without rows for
    ``idle_ms`` of event time is emitted once more, closed, and forgotten.
    """
    kind = dict(stream.dtypes)[key]

    def step(k, frames, state: GroupState):
        if state.hasTimedOut:
            n, _ = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "n": [n], "closed": [True]})
            return
        n, last = state.get if state.exists else (0, 0)
        for frame in frames:
            n += len(frame)
            last = max(last, int(frame["__ms"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "n": [n], "closed": [False]})

    rows = stream.select(key, time, F.unix_millis(time).alias("__ms"))
    return rows.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, n long, closed boolean", "n long, last long", "update", GroupStateTimeout.EventTimeTimeout
    )
