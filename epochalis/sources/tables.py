"""Readers of the tables and their roles as signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_index(df: DataFrame, key: str, bucket, *order: str) -> DataFrame:
    """Adds ``sample_idx``, the 0-based place of each row of its key in ``order``.

    ``bucket`` rises with the order. Rows are numbered inside (key, bucket), and
    bucket counts give the offsets, so that a key that holds a third of all rows
    is spread over its buckets instead of being sorted in one task.
    """
    held = df.withColumn("_b", bucket)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy(key, "_b").agg(F.count("*").alias("_n")).select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    return held.withColumn("_i", inside).join(offsets, [key, "_b"]).withColumn("sample_idx", (F.col("_o") + F.col("_i")).cast("bigint")).drop("_b", "_o", "_i")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one channel per user: ``rec_id, sample_idx, ms, channel, value``."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), "event_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_type").alias("channel"), "value")
    return ordered_index(events, "rec_id", F.to_date("ts"), "ts", "event_id").select("rec_id", "sample_idx", "ms", "channel", "value")


def atoms(spark: SparkSession, sf_dir: str, channels: int = 5, n_atoms: int = 12) -> DataFrame:
    """``embeddings`` as atoms: vectors in groups of ``channels``, five numbers an atom.

    ``epoch_id, ch_idx, atom_idx, t_s, f_hz, dur_s, rate_hz_s, energy``
    """
    e = read(spark, sf_dir, "embeddings").select((F.col("vec_id") / channels).cast("bigint").alias("epoch_id"), (F.col("vec_id") % channels).cast("int").alias("ch_idx"), F.col("embedding").cast("array<double>").alias("v"))
    full = F.count("*").over(Window.partitionBy("epoch_id"))
    e = e.withColumn("n", full).where(F.col("n") == channels)
    k = F.explode(F.sequence(F.lit(0), F.lit(n_atoms - 1))).alias("atom_idx")
    at = lambda i: F.element_at("v", F.col("atom_idx") * 5 + i)
    return e.select("epoch_id", "ch_idx", "v", k).select("epoch_id", "ch_idx", "atom_idx", (F.abs(at(1)) * 4).alias("t_s"), (F.abs(at(2)) * 120).alias("f_hz"), (F.abs(at(3)) * 4 + 0.05).alias("dur_s"), (at(4) * 20).alias("rate_hz_s"), (at(5) * at(5)).alias("energy"))
