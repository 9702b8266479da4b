"""Epochs: count windows, gates, normalisation, amplitude features, frames, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FLAT, MAX_ABS_Z, RAIL_SHARE, RAILS, SPAN_MS
from ..scratch import written
from .statistics import exact_percentiles

EPOCH = ["rec_id", "epoch"]


def epoch_table(samples: DataFrame, width: int) -> DataFrame:
    """One row an epoch: ``rec_id, epoch, start, span_ms, w`` with ``w`` the values in order."""
    held = samples.withColumn("epoch", F.floor(F.col("sample_idx") / width).cast("bigint"))
    rows = held.groupBy(EPOCH).agg(F.min("sample_idx").alias("start"), (F.max("ms") - F.min("ms")).alias("span_ms"), F.sort_array(F.collect_list(F.struct("sample_idx", "value"))).alias("s"))
    return rows.where(F.size("s") == width).select(*EPOCH, "start", "span_ms", F.transform("s", lambda x: x["value"]).alias("w"))


def mean_of(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / F.size(w)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once a row, not once for each element that a lambda in ``f`` sees."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squares_of(w: Column) -> Column:
    """Sum of squared distances from the mean."""
    return bound(mean_of(w), lambda m: F.aggregate(w, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))


def gate_reason(w: Column, span_ms: Column, span=SPAN_MS, rails=RAILS, rail_share=RAIL_SHARE, max_abs_z=MAX_ABS_Z, check_rails: bool = True) -> Column:
    """First failing test of a window, null if it passes: nonfinite, packet_loss, adc_rail, near_constant, artifact."""
    n = F.size(w)
    bad = F.exists(w, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    mean = mean_of(w)
    sd = F.sqrt(squares_of(w) / n)
    railed = F.size(F.filter(w, lambda x: (x <= rails[0]) | (x >= rails[1]))) / n
    peak = bound(mean, lambda m: F.aggregate(w, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x - m))))
    out = F.when(bad, "nonfinite").when((span_ms < span[0]) | (span_ms > span[1]), "packet_loss")
    if check_rails:
        out = out.when(railed >= rail_share, "adc_rail")
    return out.when(sd < FLAT * (1 + F.abs(mean)), "near_constant").when(peak > max_abs_z * sd, "artifact")


def montage_gate(reasons: DataFrame, require_all: bool = True) -> DataFrame:
    """``rec_id, epoch, n_channels, n_bad, reason`` from ``rec_id, epoch, channel, reason``: why an epoch of several channels goes, null if it stays.

    The reason is the one of the first failing channel. Without ``require_all``
    an epoch goes only if all of its channels fail.
    """
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("channel", "reason")))["reason"]
    out = reasons.groupBy(EPOCH).agg(F.count("*").alias("n_channels"), F.count("reason").alias("n_bad"), first.alias("reason"))
    return out if require_all else out.withColumn("reason", F.when(F.col("n_bad") == F.col("n_channels"), F.col("reason")))


def normalised(w: Column) -> Column:
    """Mean removed, unit length; null where the length is under 1e-6."""
    scaled = lambda m, norm: F.when(norm >= 1e-6, F.transform(w, lambda x: (x - m) / norm))
    return bound(mean_of(w), lambda m: bound(F.sqrt(squares_of(w)), lambda norm: scaled(m, norm)))


def amplitude_features(epochs: DataFrame) -> DataFrame:
    """``log_rms`` (population deviation) and ``log_linelength`` of each epoch's raw values."""
    sd = F.sqrt(squares_of(F.col("w")) / F.size("w"))
    steps = F.zip_with(F.slice("w", 2, F.size("w") - 1), F.slice("w", 1, F.size("w") - 1), lambda b, a: F.abs(b - a))
    return epochs.select(*EPOCH, F.log(sd + 1e-6).alias("log_rms"), F.log(mean_of(steps) + 1e-6).alias("log_linelength"))


def frames(samples: DataFrame, width: int, hop: int) -> DataFrame:
    """Each sample once in each frame that holds it: ``rec_id, frame, offset, sample_idx, value``; incomplete frames go."""
    sizes = samples.groupBy("rec_id").agg(F.count("*").alias("n"))
    last = F.floor((F.col("n") - width) / hop)
    low = F.greatest(F.lit(0), F.ceil((F.col("sample_idx") - width + 1) / hop))
    high = F.least(F.floor(F.col("sample_idx") / hop), last)
    held = samples.join(sizes, "rec_id").where((F.col("n") >= width) & (low <= high))
    return held.select("rec_id", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))).alias("frame"), "sample_idx", "value").withColumn("offset", F.col("sample_idx") - F.col("frame") * hop)


def overlap_add(framed: DataFrame, width: int) -> DataFrame:
    """Sum of the frames under a periodic Hann window: ``rec_id, sample_idx, value, cover``."""
    hann = 0.5 - 0.5 * F.cos(2 * F.pi() * F.col("offset") / width)
    return framed.groupBy("rec_id", "sample_idx").agg(F.sum(F.col("value") * hann).alias("value"), F.sum(hann).alias("cover"))


def robust_sigma(df: DataFrame, group: str, value: str) -> DataFrame:
    """1.4826 times the median distance from the median, by group."""
    centre = written(exact_percentiles(df, group, value, [0.5]), "centres")
    far = df.join(centre, group).select(group, F.abs(F.col(value) - F.col("p0")).alias("_far"))
    return exact_percentiles(far, group, "_far", [0.5]).select(group, (F.col("p0") * 1.4826).alias("sigma"))


def group_zscore(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds ``z`` by the group's mean and population deviation (1 where that is nothing)."""
    stats = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(stats, group).withColumn("z", (F.col(value) - F.col("_m")) / F.when(F.col("_s") <= 1e-12, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def step_rollup(windows: DataFrame, k: int, share: float = 0.6) -> DataFrame:
    """Steps of ``k`` windows of a recording (``epoch, valid, flag, x, t``): mean over valid ones, the remainder dropped."""
    steps = windows.groupBy("rec_id", F.floor(F.col("epoch") / k).cast("bigint").alias("step")).agg(
        F.count("*").alias("n"), F.sum(F.col("valid").cast("int")).alias("n_valid"), F.avg(F.when(F.col("valid"), F.col("x"))).alias("x"), F.bool_or("flag").alias("flag"), F.min_by("t", "epoch").alias("t")
    )
    return steps.where(F.col("n") == k).withColumn("valid", F.col("n_valid") >= F.ceil(F.lit(share * k))).drop("n")
