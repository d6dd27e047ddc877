"""Stateful operators: circuit breakers and alert rules, on streams and on tables.

Both forms share the step functions; a table is dealt by key, sorted by time, and folded row by row, so
a key's rows are streamed through a task and never held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of the failure window, failures that open, seconds open, successes that close.
WINDOW_S, FAILURES, OPEN_S, SUCCESSES = 60.0, 10, 30.0, 3


class Breaker:
    """One key's breaker: closed, open or half_open."""

    def __init__(self, state: str = "closed", failures: list[float] | None = None, opened: float = 0.0, good: int = 0):
        self.state, self.failures, self.opened, self.good = state, failures or [], opened, good

    def step(self, at: float, failed: bool, window: float, limit: int, wait: float, close: int) -> str:
        if self.state == "open" and at - self.opened >= wait:
            self.state, self.good = "half_open", 0
        if self.state == "open":
            return "rejected"
        if self.state == "half_open":
            if failed:
                self.state, self.opened = "open", at
            else:
                self.good += 1
                if self.good >= close:
                    self.state, self.failures = "closed", []
        elif failed:
            self.failures = [t for t in self.failures if at - t <= window] + [at]
            if len(self.failures) >= limit:
                self.state, self.opened = "open", at
        return self.state


_OUT = "key string, id long, outcome string"


def breaker(events: DataFrame, window: float = WINDOW_S, limit: int = FAILURES, wait: float = OPEN_S, close: int = SUCCESSES) -> DataFrame:
    """key, id, outcome (closed, open, half_open or rejected) after each row of (key, id, at in seconds, failed)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, one = None, Breaker()
        for part in parts:
            out = []
            for k, at, failed in zip(part["key"], part["at"], part["failed"], strict=True):
                if k != key:
                    key, one = k, Breaker()
                out.append(one.step(at, bool(failed), window, limit, wait, close))
            yield pd.DataFrame({"key": part["key"], "id": part["id"], "outcome": out})

    rows = events.select(F.col("key").cast("string").alias("key"), "id", "at", "failed").where("key is not null and at is not null")
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, _OUT)


def breaker_stream(events: DataFrame, window: float = WINDOW_S, limit: int = FAILURES, wait: float = OPEN_S, close: int = SUCCESSES) -> DataFrame:
    """The same on a stream; rows of a micro-batch are stepped by time. The state is bounded by the failure limit."""

    def run(key, parts, state):
        got = state.get if state.exists else ("closed", [], 0.0, 0)
        one = Breaker(got[0], list(got[1]), got[2], got[3])
        rows = pd.concat(list(parts)).sort_values(["at", "id"])
        out = [one.step(at, bool(f), window, limit, wait, close) for at, f in zip(rows["at"], rows["failed"], strict=True)]
        state.update((one.state, one.failures, float(one.opened), one.good))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "outcome": out})

    rows = events.select(F.col("key").cast("string").alias("key"), "id", "at", "failed")
    return rows.groupBy("key").applyInPandasWithState(run, _OUT, "state string, failures array<double>, opened double, good int", "append", "NoTimeout")


def rates(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, n, error_rate, mean latency of each window of (ts, failed, value); on streams give the lateness to wait for."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), (F.count_if("failed") / F.count("*")).alias("error_rate"), F.avg("value").alias("latency")).select(F.col("w.start").alias("start"), "n", "error_rate", "latency")


def alerts(windows: DataFrame, error_rate: float = 0.1, latency: float = 10.0, least: int = 10) -> DataFrame:
    """start, rule, value of each rule that a window of enough rows breaks."""
    rules = F.array(
        F.when(F.col("error_rate") > error_rate, F.struct(F.lit("error_rate").alias("rule"), F.col("error_rate").alias("value"))),
        F.when(F.col("latency") > latency, F.struct(F.lit("latency").alias("rule"), F.col("latency").alias("value"))),
    )
    return windows.where(F.col("n") >= least).select("start", F.explode(F.array_compact(rules)).alias("r")).select("start", "r.rule", F.round("r.value", 6).alias("value"))


def cooled(found: DataFrame, seconds: float) -> DataFrame:
    """Alerts, without those within so many seconds of the last one of their rule that was let through."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, last = None, None
        for part in parts:
            keep = []
            for r, at in zip(part["rule"], part["start"], strict=True):
                if r != rule:
                    rule, last = r, None
                ok = last is None or (at - last).total_seconds() >= seconds
                keep.append(ok)
                last = at if ok else last
            yield part[keep]

    return found.repartition("rule").sortWithinPartitions("rule", "start").mapInPandas(run, found.schema)


def error_class(message) -> tuple:
    """(category, whether a retry helps) of an error's text."""
    m = F.lower(message)
    has = lambda *ws: F.greatest(*(F.contains(m, F.lit(w)) for w in ws)) if len(ws) > 1 else F.contains(m, F.lit(ws[0]))
    kind = F.when(has("rate limit", "429"), "rate_limit").when(has("timeout", "timed out"), "timeout").when(has("connection", "network"), "network").when(has("json", "parse"), "parse").when(has("auth", "401"), "auth").otherwise("unknown")
    return kind, kind.isin("rate_limit", "timeout", "network", "parse")
