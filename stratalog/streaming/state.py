"""Keyed state machines: rate limits, push queues, access-time throttling.

Each machine is a pure step function. ``folded`` runs it over a batch, ordered by
time within each key; ``streamed`` runs the same step in Structured Streaming, with the
state kept between micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

ATTEMPTS, WINDOW_S, BLOCK_S, TOUCH_S = 5, 60, 300, 60


def rate_limit(state: tuple, row) -> tuple[tuple, str]:
    """State: (attempts, last attempt, blocked until). A success clears it; a block is checked first."""
    attempts, last, until = state or (0, 0, 0)
    if row.ts_s < until:
        return (attempts, last, until), "blocked"
    if row.ok:
        return (0, 0, 0), "allowed"
    if not attempts or row.ts_s - last >= WINDOW_S:
        return (1, row.ts_s, 0), "failed"
    if attempts >= ATTEMPTS:
        return (attempts, row.ts_s, row.ts_s + BLOCK_S), "blocked"
    return (attempts + 1, row.ts_s, 0), "failed"


def admin_limit(state: tuple, row) -> tuple[tuple, str]:
    """Like :func:`rate_limit`, but the right token always wins, blocked or not."""
    return ((0, 0, 0), "allowed") if row.ok else rate_limit(state, row)


def push_queue(state: tuple, row) -> tuple[tuple, str]:
    """State: ends of the active and the next work. One push works, one waits, a third is refused."""
    active, waiting = state or (0, 0)
    if active <= row.ts_s:
        active, waiting = (waiting, 0) if waiting > row.ts_s else (0, 0)
    if not active:
        return (row.ts_s + row.work_s, 0), "started"
    if not waiting:
        return (active, active + row.work_s), "queued"
    return (active, waiting), "refused"


def touch(state: tuple, row) -> tuple[tuple, str]:
    """State: (the last time kept). An access is written only TOUCH_S after the last one written."""
    if state and row.ts_s - state[0] < TOUCH_S:
        return state, "skipped"
    return (row.ts_s,), "written"


def folded(events: DataFrame, key: str | list[str], step: Callable, out: str = "decision") -> DataFrame:
    """``events`` (key, event_id, ts_s, ...) with the decision of each, in order of (ts_s, event_id) within a key."""
    schema = StructType([*events.schema.fields, StructField(out, StringType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts_s", "event_id"], kind="stable")
        state, decisions = None, []
        for row in rows.itertuples(index=False):
            state, decision = step(state, row)
            decisions.append(decision)
        return rows.assign(**{out: decisions})

    return events.groupBy(*([key] if isinstance(key, str) else key)).applyInPandas(run, schema)


def streamed(events: DataFrame, key: str, step: Callable, width: int, out: str = "decision") -> DataFrame:
    """The streaming form of :func:`folded`; ``width`` is the number of integers in a state."""
    columns = ", ".join(f"s{i} long" for i in range(width))
    schema = StructType([*events.schema.fields, StructField(out, StringType())])

    def run(_, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts_s", "event_id"], kind="stable")
        state, decisions = held.getOption, []
        for row in rows.itertuples(index=False):
            state, decision = step(state, row)
            decisions.append(decision)
        held.update(tuple(int(x) for x in state))
        yield rows.assign(**{out: decisions})

    return events.groupBy(key).applyInPandasWithState(run, schema, columns, "append", GroupStateTimeout.NoTimeout)
