"""Callbacks of ended jobs: each counts once a day for its key, whatever its repeats, and its signature must be that of the
raw body. In batch by pointers from each call to the first one a day after it, followed by a recursive query; as a
stream by state that is kept until event time has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.functions.text import signed

#: Hours in which a key's repeats are the same callback; how late a call may come.
KEEP_HOURS, LATENESS = 24, "1 hour"
#: What a call has: an accepted one is reported with all of it.
CALL = "key string, ts timestamp, attempt int, body binary"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def valid(calls: DataFrame, secret: str, signature: str = "signature") -> DataFrame:
    """Calls whose signature is the HMAC of their raw body, without the signature."""
    return calls.where(signed(F.col(signature), secret, F.col("body"))).drop(signature)


def accepted(calls: DataFrame, hours: int = KEEP_HOURS) -> DataFrame:
    """CALL of those calls (CALL) that no accepted call of their key comes before by less than `hours`: the first, then the
    first at least so many hours after that, and so on. Of calls at one time the one with the smallest attempt, then body,
    counts. Calls without a key or time are none."""
    one = calls.where("key is not null and ts is not null").groupBy("key", "ts").agg(F.min(F.struct(F.coalesce("attempt", F.lit(2**31 - 1)).alias("a"), F.col("attempt").alias("attempt"), F.col("body").alias("body"))).alias("c"))
    micros = F.unix_micros("ts")
    after = Window.partitionBy("key").orderBy(micros).rangeBetween(hours * 3_600_000_000, Window.unboundedFollowing)
    # the first call so long after, by a range of microseconds
    next_ = one.select("key", "ts", "c.attempt", "c.body", F.min("ts").over(after).alias("next"))
    firsts = next_.groupBy("key").agg(F.min("ts").alias("ts"))
    chain = calls.sparkSession.sql(
        """WITH RECURSIVE t(key, ts) MAX RECURSION LEVEL 100000 AS (
  SELECT key, ts FROM {firsts} UNION ALL SELECT t.key, n.next FROM t JOIN {links} n ON n.key = t.key AND n.ts = t.ts WHERE n.next IS NOT NULL
) SELECT key, ts FROM t LIMIT ALL""",
        firsts=firsts,
        links=next_.select("key", "ts", "next"),
    )
    return next_.drop("next").join(chain, ["key", "ts"], "left_semi")


class Once(StatefulProcessor):
    """For a key: calls that event time hasn't reached yet, and the last accepted one's time until its day is over."""

    def __init__(self, hours: int):
        self.keep = hours * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ms long, attempt int, body binary")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            calls = [(int(t.value // 1_000_000), None if pd.isna(a) else int(a), b) for t, a, b in zip(frame["ts"], frame["attempt"], frame["body"])]
            self.held.appendList(calls)
            # event time has reached a call when the watermark is behind it: then no earlier one can come
            for ms in {c[0] + 1 for c in calls}:
                self.handle.registerTimer(ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        calls = [tuple(c) for c in self.held.get()] if self.held.exists() else []
        ready = sorted((c for c in calls if c[0] < now), key=lambda c: (c[0], 2**31 if c[1] is None else c[1], bytes(c[2] or b"")))
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ms, attempt, body in ready:
            if last is None or ms >= last + self.keep:
                last = ms
                out.append((key[0], pd.Timestamp(ms, unit="ms"), attempt, body))
        if ready:
            left = [c for c in calls if c[0] >= now]
            self.held.put(left) if left else self.held.clear()
        if last is not None:
            if now > last + self.keep:
                self.last.clear()  # what comes now is a day after it
            else:
                self.last.update((last,))
                self.handle.registerTimer(last + self.keep + 1)
        yield pd.DataFrame(out, columns=["key", "ts", "attempt", "body"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def accepted_stream(calls: DataFrame, hours: int = KEEP_HOURS, lateness: str = LATENESS) -> DataFrame:
    """The same as a stream: an accepted call comes when no earlier one of its key can any more, by `lateness`. Times are
    milliseconds. The state of a key goes when its day is over. Needs the RocksDB state store (STORE)."""
    rows = calls.where("key is not null and ts is not null").select("key", "ts", "attempt", "body").withWatermark("ts", lateness)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Once(hours), outputStructType=CALL, outputMode="Append", timeMode="EventTime")


def recorded(rows: DataFrame, ts: str, now: Column, days: int = 14) -> DataFrame:
    """Records that are kept at `now`: those not older than `days`."""
    return rows.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))
