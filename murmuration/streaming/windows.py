"""Structured Streaming forms of the windowed jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, late: str = "1 minute", size: str = "20 seconds", step: str = "18 seconds") -> DataFrame:
    """Events per file and sliding window; rows later than the watermark are dropped (STR-1)."""
    return (
        events.withWatermark("ts", late).groupBy("file_id", F.window("ts", size, step)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("file_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")
    )


def pause_sessions(events: DataFrame, late: str = "1 minute", pause: str = "10 minutes") -> DataFrame:
    """Segments of a stream that end with a pause (STR-2)."""
    return (
        events.withWatermark("ts", late).groupBy("file_id", F.session_window("ts", pause)).agg(F.count("*").alias("n"))
        .select("file_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def run_collapse(events: DataFrame) -> DataFrame:
    """Runs of one label per file in order of arrival (STR-2); an open run is carried from batch to batch as state.

    Emits a run when another label follows it. Rows of a batch are put in order of time; the state is one run a file.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        label, first, last, n = state.get if state.exists else (None, None, None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "label"])
        out = []
        for at, name in zip(rows["ts"], rows["label"]):
            micros = int(at.value // 1000)
            if name == label:
                last, n = micros, n + 1
            else:
                if n:
                    out.append((key[0], label, pd.Timestamp(first * 1000), pd.Timestamp(last * 1000), n))
                label, first, last, n = name, micros, micros, 1
        state.update((label, first, last, n))
        yield pd.DataFrame(out, columns=["file_id", "label", "first", "last", "n"])

    out = "file_id long, label string, first timestamp, last timestamp, n long"
    return events.select("file_id", "ts", "label").groupBy("file_id").applyInPandasWithState(step, out, "label string, first long, last long, n long", "append", "NoTimeout")
