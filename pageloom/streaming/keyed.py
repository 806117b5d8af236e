"""Streams with state per key: records flagged as a job's first, and selectors with retraction.

State is kept by a function per key (``applyInPandasWithState``); Spark hands it the key's rows of a micro-batch in
pieces, so a large job is never in memory at once. With an event time, a key's state goes once the watermark has left
its last row ``idle_ms`` behind, which bounds state for jobs that never close; a row after that begins the key anew.
Replayed micro-batches start from the state before and give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS, LATE = 24 * 3600 * 1000, "1 hour"


def _kept(state: GroupState, latest: pd.Timestamp | None, idle_ms: int) -> None:
    """Let the state go ``idle_ms`` after this event time."""
    if latest is not None:
        end = int(latest.timestamp() * 1000) + idle_ms
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))


def _watched(stream: DataFrame, event_time: str | None) -> tuple[DataFrame, str]:
    """The stream and its kind of timeout."""
    if event_time is None:
        return stream, GroupStateTimeout.NoTimeout
    return stream.withWatermark(event_time, LATE), GroupStateTimeout.EventTimeTimeout


def _flagged(columns: list[str], order: str, event_time: str | None, idle_ms: int):
    """The function of :func:`flag_first` for one key: a key whose rows come in one piece leaves in one piece."""

    def flagged(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, first = state.exists, state.get[0] if state.exists else ""
        waiting: pd.DataFrame | None = None
        latest = None
        part = next(parts, None)
        while part is not None:
            following = next(parts, None)
            if list(part.columns) != columns:
                part = part[columns]
            if event_time is not None:
                top = part[event_time].max()
                latest = top if latest is None or latest is pd.NaT or top > latest else latest
            if known:
                yield part.assign(is_first=False)
            else:
                # the least record so far waits; all others can go
                own = part if waiting is None else pd.concat([waiting, part], ignore_index=True)
                at = own[order].argmin()
                first = str(own[order].iat[at])
                if following is None:
                    flags = np.zeros(len(own), bool)
                    flags[at] = True
                    yield own.assign(is_first=flags)
                else:
                    waiting = own.iloc[[at]]
                    yield own.drop(index=own.index[at]).assign(is_first=False)
            part = following
        state.update((first,))
        _kept(state, latest, idle_ms)

    return flagged


def flag_first(
    stream: DataFrame, job: str, order: str, event_time: str | None = None, idle_ms: int = IDLE_MS
) -> DataFrame:
    """Every record, with ``is_first``: whether it has the least ``order`` of the micro-batch that brought its job.

    A job's records come in order over micro-batches; within one they may come in any.
    """
    columns = stream.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    flagged = _flagged(columns, order, event_time, idle_ms)
    watched, timeout = _watched(stream, event_time)
    return watched.groupBy(job).applyInPandasWithState(flagged, f"{kind}, is_first boolean", "first string", "append", timeout)


def live_selectors(
    actions: DataFrame, field: str = "field", order: str = "seq", event_time: str | None = None, idle_ms: int = IDLE_MS
) -> DataFrame:
    """The selector of each field as actions ``(field, seq, is_add, selector)`` arrive: ``field, seq, selector``.

    An addition becomes the field's selector; its removal restores the one added before that is still there, or none
    (NULL). Removing a selector that is not there changes nothing. A row comes out for each field and micro-batch;
    ``seq`` is the last action seen. State holds the selectors a field still has, in order.
    """

    def folded(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live: list[str] = json.loads(state.get[0]) if state.exists else []
        pieces = [[p[c] for c in read] for p in parts]
        rows = pieces[0] if len(pieces) == 1 else [pd.concat(c, ignore_index=True) for c in zip(*pieces)]
        seen, is_adds, selectors = (c.to_numpy() for c in rows[:3])
        upwards = np.argsort(seen, kind="stable")
        for is_add, selector in zip(is_adds[upwards], selectors[upwards]):
            if selector in live:
                live.remove(selector)
            if is_add:
                live.append(selector)
        state.update((json.dumps(live),))
        _kept(state, rows[3].max() if event_time else None, idle_ms)
        yield pd.DataFrame({field: [key[0]], order: [int(seen[upwards[-1]])], "selector": [live[-1] if live else None]})

    kinds, read = dict(actions.dtypes), [order, "is_add", "selector", *([event_time] if event_time else [])]
    watched, timeout = _watched(actions, event_time)
    return watched.groupBy(field).applyInPandasWithState(
        folded,
        f"`{field}` {kinds[field]}, `{order}` long, selector string",
        "live string",
        "update",
        timeout,
    )


def live_selectors_of(actions: DataFrame, field: str = "field", order: str = "seq") -> DataFrame:
    """Batch twin of :func:`live_selectors`: each field's selector after all actions.

    A selector is there if its last action is an addition; the one added last counts. Aggregates only.
    """
    last = actions.groupBy(field, "selector").agg(F.max_by("is_add", order).alias("there"), F.max(order).alias("at"))
    top = F.max_by(F.when(F.col("there"), F.col("selector")), F.when(F.col("there"), F.col("at")))
    return last.groupBy(field).agg(F.max("at").alias(order), top.alias("selector"))
