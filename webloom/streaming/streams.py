"""Stateful operators over streams. Batch forms of the same are in operators.stats."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(stream: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """The stream with a watermark; a time without zone is taken as UTC."""
    return stream.withColumn(column, F.to_utc_timestamp(F.col(column).cast("timestamp"), "UTC")).withWatermark(column, late)


def without_repeats(stream: DataFrame, keys: list[str], bypass: Column | None = None) -> DataFrame:
    """First events of each key within the watermark, so the state stays bounded; events
    that ``bypass`` the filter all pass."""
    if bypass is None:
        return stream.dropDuplicatesWithinWatermark(keys)
    through = F.coalesce(bypass, F.lit(False))
    once = stream.where(~through).dropDuplicatesWithinWatermark(keys)
    return once.unionByName(stream.where(through))


def _ordered(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame | None:
    """A key's rows of a micro-batch in the order of events, not of arrival."""
    parts = [f for f in frames if len(f)]
    return pd.concat(parts, ignore_index=True).sort_values(order, kind="stable") if parts else None


def _kept(state: GroupState, values: tuple, idle: str | None) -> None:
    state.update(values)
    if idle:
        state.setTimeoutDuration(idle)


def not_stored_before(stream: DataFrame, keys: list[str], stores: str, order: list[str], idle: str | None = None) -> DataFrame:
    """Requests whose key no earlier request stored: the key and whether it is stored
    are the state; a request stores its key when column ``stores`` is true. A key without
    requests for ``idle`` is forgotten; without it states are kept for ever."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.exists and state.get[0]
        rows = _ordered(frames, order)
        if rows is None:
            return
        hits = rows[stores].fillna(False).astype(bool).to_numpy()
        before = hits.cumsum() - hits > 0
        if not stored and not before.all():
            yield rows[~before]
        _kept(state, (bool(stored or hits.any()),), idle)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(step, stream.schema, "stored BOOLEAN", "append", timeout)


def block_learning(stream: DataFrame, domain: str, blocked: str, order: list[str], idle: str | None = None) -> DataFrame:
    """Requests with ``via_proxy`` (an earlier one of the domain was blocked) and
    ``failed`` (blocked through the proxy). ``idle`` as in ``not_stored_before``."""
    from pyspark.sql.types import BooleanType, StructType

    schema = StructType(list(stream.schema.fields)).add("via_proxy", BooleanType()).add("failed", BooleanType())

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.exists and state.get[0]
        rows = _ordered(frames, order)
        if rows is None:
            return
        hits = rows[blocked].fillna(False).astype(bool).to_numpy()
        via = (hits.cumsum() - hits > 0) | bool(seen)
        yield rows.assign(via_proxy=via, failed=hits & via)
        _kept(state, (bool(seen or hits.any()),), idle)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy(domain).applyInPandasWithState(step, schema, "seen BOOLEAN", "append", timeout)


def rates(stream: DataFrame, by: str, width: str = "1 hour", slide: str | None = None, column: str = "ts") -> DataFrame:
    """Events by window and key; windows may slide."""
    return stream.groupBy(F.window(column, width, slide or width), by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, by: str, gap: str = "30 minutes", column: str = "ts") -> DataFrame:
    """Sessions of each key that end after a gap."""
    return stream.groupBy(F.session_window(column, gap), by).agg(F.count("*").alias("n"))


def to_snapshots(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Any:
    """A query that appends each prepared micro-batch as parquet, once: a batch that
    is run again after a failure replaces its own directory."""

    def write(df: DataFrame, number: int) -> None:
        prepare(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
