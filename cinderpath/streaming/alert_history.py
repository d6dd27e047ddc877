"""The history of alerts: a rule that is broken fires, stays silent for its cooldown, and is resolved by a good check or by silence.

Both forms fold checks in the order of their times: a table sorted within its partitions, a stream by event-time timers, which
hold a check back until the watermark says that none before it can come. So the stream gives the table's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Fixed value: milliseconds between two alerts of a key, where nothing else is said.
COOLDOWN = 300_000
_OUT = "key string, at long, status string, value double"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Alert:
    """One key's alert: when it last fired, whether it is active, when it was last checked (milliseconds)."""

    def __init__(self, cooldown: int, quiet: int | None, fired: int | None = None, active: bool = False, last: int = 0):
        self.cooldown, self.quiet, self.fired, self.active, self.last = cooldown, quiet, fired, active, last

    def silent(self, now: int) -> list[tuple]:
        """Resolve an active alert that wasn't checked for the quiet time."""
        if self.active and self.quiet is not None and now - self.last >= self.quiet:
            self.active = False
            return [(self.last + self.quiet, "RESOLVED", None)]
        return []

    def check(self, at: int, broken: bool, value: float | None) -> list[tuple]:
        out = self.silent(at)
        self.last = at
        if broken:
            if self.fired is None or at - self.fired >= self.cooldown:
                self.fired, self.active = at, True
                out.append((at, "FIRING", value))
        elif self.active:
            self.active = False
            out.append((at, "RESOLVED", value))
        return out


def _frame(key: str, told: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(told, columns=["at", "status", "value"])
    out.insert(0, "key", key)
    return out.astype({"at": "int64", "value": "float64"})


def history(checks: DataFrame, cooldown: int = COOLDOWN, quiet: int | None = None, until: int | None = None) -> DataFrame:
    """key, at, status (FIRING or RESOLVED), value of a table of (key, at in milliseconds, broken, value).

    Checks of one key and time are one: broken if any is, with the greatest value. An alert fires again while active once
    its cooldown is over. Null keys and times are left out, null broken is good. Silence after the last check counts up to
    `until`, if that is given. Rows stream through a task; one key's alert is all that is held.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, one = None, None
        for part in parts:
            out = []
            for k, at, broken, value in zip(part["key"], part["at"], part["broken"], part["value"], strict=True):
                if k != key:
                    out += [(key, *t) for t in (one.silent(until) if one and until is not None else [])]
                    key, one = k, Alert(cooldown, quiet)
                out += [(k, *t) for t in one.check(int(at), bool(broken), value)]
            yield pd.DataFrame(out, columns=["key", "at", "status", "value"]).astype({"at": "int64", "value": "float64"})
        if one and until is not None:
            yield _frame(key, one.silent(until))

    rows = checks.where("key is not null and at is not null").groupBy(F.col("key").cast("string").alias("key"), F.col("at").cast("long").alias("at"))
    once = rows.agg(F.coalesce(F.bool_or("broken"), F.lit(False)).alias("broken"), F.max("value").cast("double").alias("value"))
    return once.repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, _OUT).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


class _Processor(StatefulProcessor):
    """Waiting checks by time, and the alert. A timer at a check's time folds all that wait up to the watermark."""

    def __init__(self, cooldown: int, quiet: int | None):
        self.cooldown, self.quiet = cooldown, quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "broken boolean, value double")
        self.alert = handle.getValueState("alert", "fired long, active boolean, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for at, broken, value in zip(part["at"], part["broken"], part["value"], strict=True):
                at, broken, value = int(at), bool(broken) and not pd.isna(broken), None if pd.isna(value) else float(value)
                if at <= now:
                    continue
                if self.waiting.containsKey((at,)):
                    held = self.waiting.getValue((at,))
                    broken, value = broken or held[0], max((v for v in (value, held[1]) if v is not None), default=None)
                self.waiting.updateValue((at,), (broken, value))
                self.handle.registerTimer(at)
        yield _frame(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        one = Alert(self.cooldown, self.quiet, *(self.alert.get() if self.alert.exists() else ()))
        told, due = [], sorted((k[0], *v) for k, v in self.waiting.iterator() if k[0] <= now)
        for at, broken, value in due:
            told += one.check(at, broken, value)
            self.waiting.removeKey((at,))
        told += one.silent(now)
        if one.active and self.quiet is not None:
            self.handle.registerTimer(one.last + self.quiet)
        if one.fired is not None and any(status == "FIRING" for _, status, _ in told):
            self.handle.registerTimer(one.fired + self.cooldown)
        if one.fired is None or (not one.active and now - one.fired >= self.cooldown):
            self.alert.clear()
        else:
            self.alert.update((one.fired, one.active, one.last))
        yield _frame(key[0], told)

    def close(self) -> None:
        pass


def history_stream(checks: DataFrame, cooldown: int = COOLDOWN, quiet: int | None = None, late: str = "10 minutes") -> DataFrame:
    """The same rows of a stream of (key, ts, broken, value); times are those of ts.

    Checks later than the watermark are dropped. A key's state is the checks that wait for the watermark and its alert,
    which goes once it is resolved and its cooldown is over. Sets the session's state store to RocksDB, which timers need.
    """
    checks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = checks.where("key is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select(F.col("key").cast("string").alias("key"), "ts", F.unix_millis("ts").alias("at"), "broken", F.col("value").cast("double").alias("value"))
    told = rows.groupBy("key").transformWithStateInPandas(_Processor(cooldown, quiet), _OUT, "append", "EventTime")
    return told.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
