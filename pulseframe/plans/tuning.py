"""Tuning: many parameter sets of a detector over the same measurements, in one job."""

from __future__ import annotations

import random
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe import config
from pulseframe.operators.runtime import _ARROW, _RAW, batch_of
from pulseframe.operators.windows import nab_format


def grid(**values: list[Any]) -> list[dict[str, Any]]:
    out: list[dict[str, Any]] = [{}]
    for name, options in values.items():
        out = [x | {name: o} for x in out for o in options]
    return out


def random_search(kind: str, n: int, seed: int = 0) -> list[dict[str, Any]]:
    """n valid random parameter sets of a detector."""
    r = random.Random(seed)
    return [{k.rpartition(".")[2]: v for k, v in config.random_settings([kind], r).items()} for _ in range(n)]


def evaluate(measurements: DataFrame, kind: str, parameters: list[dict[str, Any]]) -> DataFrame:
    """The events of each parameter set, with param_id, its place in the list.

    Measurements are shuffled and sorted once; each stream is read once and
    stepped through all sets side by side, so the rows are not multiplied.
    """
    detectors = [config.build_detector(kind, overrides=p) for p in parameters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, states, first = None, [], True
        for b in batches:
            out, ids = [], []
            for s, t, v, lossy in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if first or s != stream:
                    stream, states, first = s, [d.start() for d in detectors], False
                for i, (d, state) in enumerate(zip(detectors, states, strict=True)):
                    found = d.step(state, t, v, lossy)
                    out += [(s, e) for e in found]
                    ids += [i] * len(found)
            if out:
                yield pa.RecordBatch.from_arrays([*batch_of(out).columns, pa.array(ids, pa.int64())], names=[*_ARROW.names, "param_id"])

    rows = measurements.where("time is not null").select("stream", F.unix_millis("time").alias("ms"), "seq", "value", "is_lossy")
    raw = rows.repartition("stream").sortWithinPartitions("stream", "ms", "seq").mapInArrow(run, f"{_RAW}, param_id long")
    return raw.select("param_id", "event_type", "stream", "severity", F.timestamp_millis("_ms").alias("time"), "detection_latency", "description", "tags")


def scored(measurements: DataFrame, events: DataFrame, binary: bool = False) -> DataFrame:
    """For an outside scorer: every measurement with its anomaly score."""
    return nab_format(measurements, events, binary)


def quality(scores: DataFrame) -> DataFrame:
    """Scores (param_id, score, ...) over all detectors and targets, as 100 less their mean: less is better."""
    return scores.groupBy("param_id").agg((100 - F.avg("score")).alias("quality"))
