"""Structured Streaming forms of the stateful operators.

Each function takes and returns a streaming (or, where noted, also a batch)
DataFrame; the caller chooses sink, trigger and checkpoint location.  Outcome logs
have (domain or url, success, latency_ms, ts).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import new_folder

LATE = "1 hour"


def _at(seconds: float) -> pd.Timestamp:
    """Seconds of the epoch to the microsecond."""
    return pd.Timestamp(round(seconds * 1e6), unit="us")


def arms(log: DataFrame, *keys: str) -> DataFrame:
    """Running counters for each arm; use output mode update (or complete)."""
    return log.groupBy(*keys).agg(F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"), F.avg("latency_ms").alias("avg_latency_ms"), F.max("ts").alias("last_seen"))


def tumbling(log: DataFrame, key: str, width: str, late: str = LATE) -> DataFrame:
    """(start, key, n, failures) for event-time windows; rows later than ``late`` are dropped."""
    w = F.window("ts", width)
    return log.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failures")).select(F.col("w.start").alias("start"), key, "n", "failures")


def sliding(log: DataFrame, key: str, width: str, step: str, late: str = LATE) -> DataFrame:
    w = F.window("ts", width, step)
    return log.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency_ms")).select(F.col("w.start").alias("start"), key, "n", "avg_latency_ms")


def sessions(log: DataFrame, key: str, gap: str, late: str = LATE) -> DataFrame:
    """(key, start, end, n): sessions that end after ``gap`` without an event."""
    w = F.session_window("ts", gap)
    return log.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(log: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """The first row of each key within the watermark."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def breaker(log: DataFrame, key: str, threshold: int = 5, timeout_s: float = 300.0, late: str = "0 seconds") -> DataFrame:
    """(key, ts, state, failure_count): one row for each change of a circuit breaker.

    Closed until ``threshold`` consecutive failures, then open; half open after
    ``timeout_s`` of event time (a timer, so it needs no further row), closed at a
    success.  State for each key is three numbers.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, failures, opened = state.get if state.exists else ("closed", 0, 0.0)
        out = []
        if state.hasTimedOut:
            if name == "open":
                name = "half_open"
                out.append((keys[0], _at(opened + timeout_s), name, failures))
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for ok, ts in zip(rows["success"], rows["ts"], strict=True):
                before = name
                at = ts.timestamp()
                if name == "open" and at - opened > timeout_s:
                    name = "half_open"
                    out.append((keys[0], _at(opened + timeout_s), name, failures))
                    before = name
                if ok:
                    name, failures = "closed", 0
                else:
                    failures += 1
                    if failures >= threshold:
                        name, opened = "open", at
                if name != before:
                    out.append((keys[0], ts, name, failures))
        state.update((name, failures, opened))
        if name == "open":
            due = int((opened + timeout_s) * 1000) + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "state", "failure_count"])

    watched = log.withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), "ts", "success")
    return watched.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, state string, failure_count int", "name string, failures int, opened double", "append", GroupStateTimeout.EventTimeTimeout)


def selectors(log: DataFrame, key: str, selector: str, forget: int = 3) -> DataFrame:
    """(key, selector, failures): the state of each key after each batch; an empty selector once it is forgotten.  Output mode update."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, failures = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ok, name in zip(rows["success"], rows["selector"], strict=True):
            if ok:
                known, failures = name, 0
            elif known:
                failures += 1
                if failures >= forget:
                    known, failures = "", 0
        state.update((known, failures))
        yield pd.DataFrame([(keys[0], known, failures)], columns=["key", "selector", "failures"])

    rows = log.select(F.col(key).cast("string").alias("key"), F.col(selector).alias("selector"), "ts", "success")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, selector string, failures int", "known string, failures int", "update", GroupStateTimeout.NoTimeout)


def fresh_cache(entries: DataFrame, key: str, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, ts, event): 'stored', 'changed' or 'unchanged' for each arrival and 'expired' once the TTL has passed in event time."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            digest, at = state.get
            out.append((keys[0], _at(at + ttl_seconds), "expired"))
            state.remove()
        else:
            digest, at = state.get if state.exists else ("", -1.0)
            for ts, new in pd.concat(list(batches)).sort_values("ts", kind="stable")[["ts", "digest"]].itertuples(index=False):
                if at >= 0 and ts.timestamp() - at > ttl_seconds:
                    out.append((keys[0], _at(at + ttl_seconds), "expired"))
                    at = -1.0
                out.append((keys[0], ts, "stored" if at < 0 else "unchanged" if new == digest else "changed"))
                digest, at = new, ts.timestamp()
            state.update((digest, at))
            state.setTimeoutTimestamp(max(int((at + ttl_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "event"])

    rows = entries.withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), "ts", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, event string", "digest string, at double", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming ``stream`` over all that its source has now and give the result as a table in the shared folder.

    Each batch is a folder of Parquet that a repeated batch writes again, so a lost
    driver or executor neither loses nor doubles a row.  In mode ``complete`` the last
    batch is the result, else all of them.
    """
    spark = stream.sparkSession
    folder = f"{new_folder(spark)}-{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    # a source without a file starts no batch
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows") if query.lastProgress else spark.createDataFrame([], stream.schema)
