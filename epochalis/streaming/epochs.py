"""Streaming twins: count windows per channel with carried state, and event-time roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def count_windows(stream: DataFrame, width: int, key: str = "rec_id") -> DataFrame:
    """Tumbling windows of ``width`` samples a key: ``key, epoch, n, mean, lo, hi, span_ms``.

    ``stream`` has ``key, sample_idx, ms, value``; samples of a key come in order
    within and between batches. State is the unfinished window alone, at most
    ``width - 1`` samples a key.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, ms, values = state.get if state.exists else (0, [], [])
        ms, values, out = list(ms), list(values), []
        for frame in frames:
            frame = frame.sort_values("sample_idx")
            ms += frame["ms"].tolist()
            values += frame["value"].tolist()
            while len(values) >= width:
                w, t = values[:width], ms[:width]
                out.append((keys[0], epoch, width, sum(w) / width, min(w), max(w), float(t[-1] - t[0])))
                values, ms, epoch = values[width:], ms[width:], epoch + 1
        state.update((epoch, ms, values))
        yield pd.DataFrame(out, columns=[key, "epoch", "n", "mean", "lo", "hi", "span_ms"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, epoch long, n long, mean double, lo double, hi double, span_ms double", "epoch long, ms array<long>, vals array<double>", "append", GroupStateTimeout.NoTimeout)


def channel_rollup(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean, spread and count by channel and event-time window; later data than ``late`` is dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "channel").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


_WINDOW = ["start_ms", "windows", "n", "span_ms", "mean", "sd", "reason"]


def _gated(start: int, ms: list, values: list, span: tuple[float, float], keep_bad: bool) -> tuple | None:
    """One closed window: marked ``packet_loss`` where its rows span too little or too much, or dropped."""
    n, mean = len(values), sum(values) / len(values)
    width = float(max(ms) - min(ms))
    reason = None if span[0] <= width <= span[1] else "packet_loss"
    sd = (sum((v - mean) ** 2 for v in values) / n) ** 0.5
    return None if reason and not keep_bad else (start, 1, n, width, mean, sd, reason)


def timed_windows(stream: DataFrame, width_ms: int, span: tuple[float, float], delay: str, key: str = "rec_id", keep_bad: bool = True) -> DataFrame:
    """Event-time windows side by side: ``key, start_ms, windows, n, span_ms, mean, sd, reason``.

    ``stream`` has ``key, ts, value``, in any order. A window is told once, when the
    watermark has passed its end: with no reason, with ``packet_loss`` if the time from
    its first to its last row is outside ``span`` (or dropped, without ``keep_bad``), and
    windows between two told ones that had no row are one row ``missing``, with their
    number. The watermark follows the ends of windows, so that a row is late only if its
    window is closed; such rows don't count, and ``late_rows`` says how many they were.
    State is a key's open windows, which ``delay`` bounds.
    """
    end = F.timestamp_millis((F.floor(F.unix_millis("_ts") / width_ms) + 1) * width_ms)
    timed = stream.where(F.col("value").isNotNull() & F.col("ts").isNotNull()).select(key, F.col("ts").cast("timestamp").alias("_ts"), F.col("value").cast("double").alias("value")).withColumn("closes", end).withWatermark("closes", delay).select(key, "closes", F.unix_millis("_ts").alias("ms"), "value")

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends, ms, values, told = state.get if state.exists else ([], [], [], None)
        open_ = {e: (list(a), list(b)) for e, a, b in zip(ends, ms, values)}
        for frame in frames:
            for m, v in zip(frame["ms"].tolist(), frame["value"].tolist()):
                a, b = open_.setdefault((m // width_ms + 1) * width_ms, ([], []))
                a.append(m)
                b.append(v)
        passed, out = state.getCurrentWatermarkMs(), []
        for e in sorted(open_):
            if e > passed:
                break
            if told is not None and e - told > width_ms:
                out.append((told, (e - told) // width_ms - 1, 0, None, None, None, "missing"))
            rows = _gated(e - width_ms, *open_.pop(e), span, keep_bad)
            out += [rows] if rows else []
            told = e
        left = sorted(open_)
        state.update((left, [open_[e][0] for e in left], [open_[e][1] for e in left], told))
        if left:
            state.setTimeoutTimestamp(max(left[0] - 1, passed))  # due once the watermark is beyond it
        yield pd.DataFrame([(keys[0], *row) for row in out], columns=[key, *_WINDOW])

    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, start_ms long, windows long, n long, span_ms double, mean double, sd double, reason string"
    return timed.groupBy(key).applyInPandasWithState(step, schema, "ends array<long>, ms array<array<long>>, vals array<array<double>>, told long", "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(query) -> int:
    """Rows of a running or ended query that came after their window was closed, as far as its progress is kept."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def timed_windows_of(rows: DataFrame, width_ms: int, span: tuple[float, float], until_ms: int | None = None, key: str = "rec_id", keep_bad: bool = True) -> DataFrame:
    """The same windows of a table: those that end by ``until_ms``, where a stream's watermark would stand."""
    held = rows.where(F.col("value").isNotNull() & F.col("ts").isNotNull()).select(key, F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("value").cast("double").alias("value"))
    start = (F.floor(F.col("ms") / width_ms) * width_ms).cast("bigint")
    windows = held.groupBy(key, start.alias("start_ms")).agg(F.count("*").alias("n"), (F.max("ms") - F.min("ms")).cast("double").alias("span_ms"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    if until_ms is not None:
        windows = windows.where(F.col("start_ms") + width_ms <= until_ms)
    before = F.lag("start_ms").over(Window.partitionBy(key).orderBy("start_ms"))  # a row a window
    windows = windows.withColumn("_gap", ((F.col("start_ms") - before) / width_ms - 1).cast("bigint"))
    bad = ~F.col("span_ms").between(*span)
    told = windows.where(~bad | F.lit(keep_bad)).select(key, "start_ms", F.lit(1).cast("bigint").alias("windows"), "n", "span_ms", "mean", "sd", F.when(bad, "packet_loss").alias("reason"))
    none = F.lit(None).cast("double")
    gaps = windows.where("_gap > 0").select(key, (F.col("start_ms") - F.col("_gap") * width_ms).alias("start_ms"), F.col("_gap").alias("windows"), F.lit(0).cast("bigint").alias("n"), none.alias("span_ms"), none.alias("mean"), none.alias("sd"), F.lit("missing").alias("reason"))
    return told.unionByName(gaps)
