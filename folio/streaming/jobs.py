"""Job states over time: what polling would end with, in batch by windows and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# States that end a job, states to wait in, and how often in a row `undefined` may come.
FINAL = ("success", "error")
PENDING = ("waiting", "processing")
PATIENCE = 3
#: Seconds after which a job counts as timed out.
DEADLINE = 1800


def outcomes(states: DataFrame, key: str, order: list[str], patience: int | None = PATIENCE) -> DataFrame:
    """key, outcome, checks: the first of success, error, not_found (`patience` times undefined in a row; None: never)
    and unknown_state that a job's states reach, and after how many of them; pending and all of them if none."""
    w = Window.partitionBy(key).orderBy(*order)
    n = states.withColumns({"nth": F.row_number().over(w), "block": F.sum((F.coalesce("state", F.lit("?")) != "undefined").cast("int")).over(w)})
    streak = F.row_number().over(Window.partitionBy(key, "block").orderBy(*order)) - (F.col("block") > 0).cast("int")
    lost = (F.col("state") == "undefined") & (streak >= patience) if patience else F.lit(False)
    known = F.coalesce(F.col("state").isin(*FINAL, *PENDING, "undefined"), F.lit(False))
    ended = F.when(F.col("state").isin(*FINAL), F.col("state")).when(lost, "not_found").when(~known, "unknown_state")
    first = n.withColumn("ended", ended).groupBy(key).agg(F.min(F.when(F.col("ended").isNotNull(), F.struct("nth", "ended"))).alias("e"), F.count(F.lit(1)).alias("n"))
    return first.select(key, F.coalesce("e.ended", F.lit("pending")).alias("outcome"), F.coalesce(F.col("e.nth").cast("long"), F.col("n")).alias("checks"))


def watch(states: DataFrame, key: str, patience: int = PATIENCE, deadline: int = DEADLINE) -> DataFrame:
    """key, outcome, checks as a stream, once a job; `timeout` after `deadline` seconds of event time.

    states: a streaming DataFrame of `key` (string), ts (timestamp, with a watermark) and state.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        checks, lost, done, began = state.get if state.exists else (0, 0, False, 1 << 62)
        out = None
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame({key: [name[0]], "outcome": ["timeout"], "checks": [checks]})
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for s in rows["state"]:
            if done:
                break
            checks, lost = checks + 1, lost + 1 if s == "undefined" else 0
            if s in FINAL:
                out = s
            elif lost >= patience:
                out = "not_found"
            elif s not in PENDING and s != "undefined":
                out = "unknown_state"
            done = out is not None
        # a finished job is kept till its deadline, so that late states don't start it anew
        start = min(began, int(rows["ts"].min().timestamp() * 1000))
        state.update((checks, lost, done, start))
        state.setTimeoutTimestamp(max(start + deadline * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({key: [name[0]], "outcome": [out], "checks": [checks]})

    return states.groupBy(key).applyInPandasWithState(step, f"{key} string, outcome string, checks long", "checks long, lost long, done boolean, began long", "append", GroupStateTimeout.EventTimeTimeout)


def first_callbacks(calls: DataFrame, key: str = "idempotency_key", ts: str = "ts", keep: str = "24 hours") -> DataFrame:
    """Each callback once: repeats of a key within `keep` are dropped. On a static DataFrame the first by time stays."""
    if calls.isStreaming:
        return calls.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])
    cols = calls.columns
    return calls.groupBy(key).agg(F.min(F.struct(ts, *[c for c in cols if c not in (key, ts)])).alias("r")).select(*[F.col(c) if c == key else F.col(f"r.{c}") for c in cols])


def retained(rows: DataFrame, ts: str, now: str, hours: int = 24) -> DataFrame:
    """Rows that are kept at `now` (a column): those not older than `hours`. Results are kept a day, usage records 14."""
    return rows.where(F.col(ts) >= F.col(now) - F.expr(f"INTERVAL {hours} HOURS"))


def capped(requests: DataFrame, most: int = 5) -> DataFrame:
    """Requests dealt over `most` tasks, so that a connector run on each row has no more of them open at once; what comes
    before keeps its own tasks."""
    return requests.repartition(most)
