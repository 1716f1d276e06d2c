"""Structured Streaming plans: run lifecycles, cooldowns, first-wins deduplication, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_by_url(products: DataFrame, at: str = "seen_at", late: str = "1 hour") -> DataFrame:
    """The first row of each product URL within the watermark; state goes as the watermark passes."""
    return products.where(F.col("product_url") != "").withWatermark(at, late).dropDuplicatesWithinWatermark(["product_url"])


def event_windows(events: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts and sums by event type over tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Each user's sessions."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def cooling_down(failures: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Per provider and window of failures, until when it rests."""
    return failures.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), "provider").agg(F.max("ts").alias("last")).select("provider", (F.col("last") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("until"))


_OUT = "run_id string, status string, at timestamp"
_STATE = "status string, started timestamp"


def lifecycle(events: DataFrame, stale_hours: int = 6, late: str = "1 hour") -> DataFrame:
    """Status changes of runs from events (run_id, status, ts); a run that stays running is failed by an event-time timer."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, started = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": ["failed"], "at": [pd.Timestamp(started) + pd.Timedelta(hours=stale_hours)]})
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        status, started = state.get if state.exists else (None, None)
        out = []
        for r in rows.itertuples():
            if status in ("completed", "failed") or r.status == status:
                continue
            status, started = r.status, started if started is not None else r.ts
            out.append((key[0], status, r.ts))
        state.update((status, started))
        if status == "running":
            due = int((pd.Timestamp(started) + pd.Timedelta(hours=stale_hours)).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run_id", "status", "at"])

    events = events.withColumn("run_id", F.col("run_id").cast("string"))
    return events.withWatermark("ts", late).groupBy("run_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def new_pages(pages: DataFrame, at: str = "seen_at", late: str = "1 hour") -> DataFrame:
    """Pages whose content their site hasn't shown within the watermark: the guard of a crawl that meets one page under two URLs."""
    said = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    fingerprint = F.sha2(F.trim(F.regexp_replace(said, r"\s+", " ")), 256)
    site = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return pages.withColumns({"site": site, "fingerprint": fingerprint}).withWatermark(at, late).dropDuplicatesWithinWatermark(["site", "fingerprint"])


def budgeted(rows: DataFrame, path: str, budget: int = 20, seconds: float = 45.0):
    """A writer that marks, in each micro-batch, the rows that may be looked up: the strongest of each run, `budget` at most.

    `rows` (run, ord, strength, needs_lookup). A batch's rows are appended to `path` under its number, so that a
    repeated batch replaces itself. `seconds` is how often a batch begins.
    """
    from ..operators.merge import within_budget

    def put(batch: DataFrame, number: int) -> None:
        marked = within_budget(batch, F.col("strength"), F.col("needs_lookup"), budget, ["run"])
        marked.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).trigger(processingTime=f"{seconds} seconds")
