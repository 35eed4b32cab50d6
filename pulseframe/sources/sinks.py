"""Sinks for events and groups, of batches and of streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from pulseframe.functions.text import csv_line, event_csv, event_line, group_line


def write_lines(df: DataFrame, path: str, kind: str = "events", mode: str = "append") -> None:
    """Events or groups (with their aggregates) as files of line protocol."""
    line = event_line("events") if kind == "events" else group_line()
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    """Rows as CSV lines in the measurements' format, in a folder for each value of ``by``."""
    out = df.select(*(by or []), csv_line(df.drop(*(by or []))).alias("value"))
    writer = out.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).text(path)


def write_events_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(event_csv().alias("value")).write.mode(mode).text(path)


def show(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def deliver(lines: DataFrame, send: Callable[[list[str]], None], chunk: int = 1000, wait_s: float = 0.5, tries: int | None = None) -> None:
    """Sends lines in chunks from where they are, each again after ``wait_s`` until it goes through: at least once. ``send`` must be picklable; ``tries`` of None never gives up."""

    def run(rows) -> None:
        held: list[str] = []

        def flush() -> None:
            done = 0
            while held:
                try:
                    send(list(held))
                    held.clear()
                except Exception:
                    done += 1
                    if tries is not None and done >= tries:
                        raise
                    time.sleep(wait_s)

        for r in rows:
            held.append(r[0])
            if len(held) >= chunk:
                flush()
        flush()

    lines.foreachPartition(run)


def stream_to(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Each micro-batch to a batch sink; ``once`` takes what is there and ends."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
