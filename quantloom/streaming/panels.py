"""Streaming twins of panel operators: resampling, replays, sessions and the ledger."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_resample(events: DataFrame, value: str = "value", key: str = "event_type", late: str | None = "2 days") -> DataFrame:
    """``date, key, n, total`` by day; a closed day never changes, rows later than the watermark are dropped.

    ``late=None``: the events carry a watermark already.
    """
    day = (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", "1 day"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return day.select(F.to_date("window.start").alias("date"), key, "n", "total")


def rolling_mean(events: DataFrame, value: str = "value", key: str = "event_type", days: int = 20, late: str = "2 days") -> DataFrame:
    """Sliding windows of so many days, by day."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day"), key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(F.col("window.end").alias("until"), key, "mean", "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Replayed rows once, so far as the replay comes within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str = "user_id", gap: str = "1 day", late: str = "2 days") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


STATE = "cash double, ids array<string>, held array<double>, clock bigint"


def ledger(rows: DataFrame, cost_bps: float = 50.0, every: int = 1, max_turnover: float | None = 0.15) -> DataFrame:
    """``book, date, equity, net`` of a stream ``book, date, id, target, r``: cash and holdings are the state of a book.

    A micro-batch must bring whole dates in ascending order; within it dates are sorted.
    """

    def step(key, frames: Iterator[pd.DataFrame], state):
        cash, ids, held, clock = state.get if state.exists else (1.0, [], [], 0)
        book = dict(zip(ids, held))
        out = []
        whole = pd.concat(list(frames), ignore_index=True)
        for date, day in whole.groupby("date", sort=True):
            names = sorted(set(day["id"]) | set(book))
            h = np.array([book.get(i, 0.0) for i in names])
            goal = day.set_index("id")["target"].reindex(names).fillna(0.0).to_numpy(float)
            move = day.set_index("id")["r"].reindex(names).fillna(0.0).to_numpy(float)
            before = cash + h.sum()
            if clock % every == 0:
                change = goal * before - h
                size = np.abs(change).sum() / before
                if max_turnover is not None and size > max_turnover:
                    change *= max_turnover / size
                h = h + change
                cash -= change.sum() + np.abs(change).sum() * cost_bps / 1e4
            h = h * (1 + move)
            clock += 1
            book = {i: v for i, v in zip(names, h.tolist()) if v != 0.0}
            out.append((key[0], date, float(cash + h.sum()), float((cash + h.sum()) / before - 1)))
        state.update((float(cash), list(book), list(book.values()), clock))
        yield pd.DataFrame(out, columns=["book", "date", "equity", "net"])

    return rows.groupBy("book").applyInPandasWithState(step, "book string, date date, equity double, net double", STATE, "append", "NoTimeout")
