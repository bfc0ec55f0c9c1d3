"""Job events: an ordered log for each job, replay, and the status state machine, as streams and as batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEPT = 100
TERMINAL = ("completed", "cancelled")


def numbered(events: DataFrame, job: str, at: str, identity: str) -> DataFrame:
    """Adds ``seq``: 1, 2, ... within each job, in order of time and identity."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(job).orderBy(at, identity)))


def last_events(events: DataFrame, job: str, at: str, identity: str, keep: int = KEPT) -> DataFrame:
    """The log's last ``keep`` events of each job."""
    whole = Window.partitionBy(job)
    return numbered(events, job, at, identity).withColumn("_n", F.max("seq").over(whole)).where(F.col("_n") - F.col("seq") < keep).drop("_n")


def replay(log: DataFrame, last_seen: Column) -> DataFrame:
    """The events after the last one seen."""
    return log.where(F.col("seq") > last_seen)


def until_terminal(log: DataFrame, job: str, event: str, terminal: tuple[str, ...] = (*TERMINAL, "failed")) -> DataFrame:
    """What a follower of each job sees: its numbered events up to the first terminal one; later and repeated ones are cut off."""
    first = F.min(F.when(F.col(event).isin(*terminal), F.col("seq"))).over(Window.partitionBy(job))
    return log.withColumn("_end", first).where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end"))).drop("_end")


def next_status(now: str, event: str) -> str:
    """The status after an event: completed and cancelled are final (a job that completed is not cancelled, nor a cancelled one completed);
    failed gives way to processing and completed only; queued counts only right after the dry run."""
    if event == "queued":
        return "queued" if now == "dry-run-complete" else now
    if event == "progress":
        return now if now in (*TERMINAL, "failed") else "processing"
    if event in ("processing", "failed"):
        return now if now in TERMINAL else event
    if event == "completed":
        return now if now == "cancelled" else event
    if event == "cancelled":
        return now if now == "completed" else event
    if event == "reset":
        return "dry-run-complete" if now in ("queued", "failed", "cancelled") else now
    raise ValueError(f"unknown event {event}")


def next_progress(now: float, status: str, event: str, value: float | None) -> float:
    """Progress never falls but on a reset; a completed job has 100."""
    if event == "reset" and status in ("queued", "failed", "cancelled"):
        return 0.0
    if event == "completed" and status != "cancelled":
        return 100.0
    if event == "processing" and status not in TERMINAL:
        return max(now, 1.0)
    if event == "progress" and status not in (*TERMINAL, "failed"):
        return max(now, min(100.0, max(0.0, value if value is not None and value == value else 0.0)))
    return now


def folded(events: DataFrame, job: str, at: str, identity: str, event: str, value: str) -> DataFrame:
    """(job, status, progress, events): the state machine over each job's events in order, in the JVM.

    A job's log is one group; jobs are many and logs short.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(identity).alias("i"), F.col(event).alias("e"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit("dry-run-complete").alias("s"), F.lit(0.0).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        s, p, e = acc["s"], acc["p"], x["e"]
        final, over = s.isin(*TERMINAL), s.isin(*TERMINAL, "failed")
        status = (
            F.when(e == "queued", F.when(s == "dry-run-complete", "queued").otherwise(s))
            .when(e == "progress", F.when(over, s).otherwise("processing"))
            .when(e.isin("processing", "failed"), F.when(final, s).otherwise(e))
            .when(e == "completed", F.when(s == "cancelled", s).otherwise(e))
            .when(e == "cancelled", F.when(s == "completed", s).otherwise(e))
            .when(e == "reset", F.when(s.isin("queued", "failed", "cancelled"), "dry-run-complete").otherwise(s))
            .otherwise(s)
        )
        value_ = F.when(x["v"].isNull() | F.isnan(x["v"]), F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x["v"])))
        progress = (
            F.when((e == "reset") & s.isin("queued", "failed", "cancelled"), 0.0)
            .when((e == "completed") & (s != "cancelled"), 100.0)
            .when((e == "processing") & ~final, F.greatest(p, F.lit(1.0)))
            .when((e == "progress") & ~over, F.greatest(p, value_))
            .otherwise(p)
        )
        return F.struct(status.alias("s"), progress.alias("p"))

    out = events.groupBy(job).agg(F.aggregate(order, start, step).alias("_x"), F.count("*").alias("events"))
    return out.select(job, F.col("_x.s").alias("status"), F.col("_x.p").alias("progress"), "events")


def status_stream(events: DataFrame, job: str, at: str, identity: str, event: str, value: str, ttl: str = "24 hours", late: str = "10 minutes") -> DataFrame:
    """(job, status, progress, events) after each micro-batch.

    A job's state goes once the watermark is ``ttl`` past its last event; ``late`` is the watermark's delay.
    """
    kind = dict(events.dtypes)[job]
    keep = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, progress, n = state.get if state.exists else ("dry-run-complete", 0.0, 0)
        rows = pd.concat(list(batches)).sort_values([at, identity])
        for row in rows.itertuples():
            e, v = getattr(row, event), getattr(row, value)
            progress = next_progress(progress, status, e, None if v is None else float(v))
            status = next_status(status, e)
            n += 1
        state.update((status, progress, n))
        last = int(pd.Timestamp(rows[at].iloc[-1]).timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + keep, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({job: [key[0]], "status": [status], "progress": [progress], "events": [n]})

    return events.withWatermark(at, late).groupBy(job).applyInPandasWithState(fold, f"{job} {kind}, status string, progress double, events long", "status string, progress double, events long", "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests by key and fixed window, with a watermark: the counter behind a rate limit."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))
