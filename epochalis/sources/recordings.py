"""Recordings from files: EDF, headset CSV, annotation texts, manifests. All by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .edf import load_edf

#: fixed values: channel columns of the headset's CSV export
CSV_CHANNELS = ("TP9", "AF7", "AF8", "TP10")


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    """``path, channel, fs, start, values`` of the EDF files that can be read; ``load_edf`` also names the others."""
    return load_edf(spark, path).where("error is null").drop("error")


def verified(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (``name, sha256`` and others) whose SHA-256 the manifest (``name, sha256``) confirms."""
    known = manifest.select("name", F.lower("sha256").alias("sha256")).distinct()
    return digests.join(known, ["name", "sha256"], "left_semi")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headset CSV: ``label, path, ms, channel, value``; rows with a missing or non-numeric cell go.

    Each file is read by its own header, so columns may stand in any order; a
    file that lacks one, or has no header, gives no rows.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", '"', ""), r"\s*,\s*").alias("cells"))
    heads = lines.where(F.array_contains("cells", "ms_ELAPSED")).groupBy("path").agg(F.min("cells").alias("names"))
    cell = lambda name: F.get("cells", (F.array_position("names", name) - 1).cast("int")).try_cast("double")
    cells = lines.join(heads, "path").select("path", cell("ms_ELAPSED").alias("ms"), *[cell(f"{c}_RAW").alias(c) for c in CSV_CHANNELS]).dropna()
    long = cells.select("path", "ms", F.explode(F.create_map(*[x for c in CSV_CHANNELS for x in (F.lit(c), F.col(c))])).alias("channel", "value"))
    return long.withColumn("label", F.element_at(F.split("path", "/"), -2))


def seizure_spans(lines: DataFrame) -> DataFrame:
    """Summary lines (``doc, line_no, line``) to ``doc, file, k, start_s, end_s``: an end belongs to the earliest start before it that is open.

    A summary is lines of ``name: value``; a line ``File Name`` names the file
    that the lines below are about, until the next one. A file without a complete
    seizure has one row with nulls. A summary is small, so the carrying window is
    one summary's lines.
    """
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.substring(F.col("line"), F.instr("line", ":") + 1, 1 << 20))
    read_ = lines.withColumns({"key": key, "text": value})
    file = F.when((F.col("key") == "file name") & (F.col("text") != ""), F.substring_index("text", " ", 1))
    inside = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = read_.withColumn("file", F.last(file, True).over(inside)).where("file is not null")
    kind = F.when(F.col("key").startswith("seizure") & F.col("key").endswith("start time"), "start").when(F.col("key").startswith("seizure") & F.col("key").endswith("end time"), "end")
    marks = held.select("doc", "file", "line_no", kind.alias("kind"), F.substring_index("text", " ", 1).try_cast("double").alias("v")).where("kind is not null and v is not null")
    order = Window.partitionBy("doc", "file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # an end that finds no open start is void: ends so far less starts so far never rises above its last top
    excess = F.sum(F.when(F.col("kind") == "end", 1).otherwise(-1)).over(order)
    marks = marks.withColumn("excess", excess).withColumn("void", F.greatest(F.max("excess").over(order), F.lit(0)))
    starts = marks.withColumn("before", F.coalesce(F.max("void").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    real = starts.where((F.col("kind") == "start") | (F.col("void") == F.col("before")))
    ranked = real.withColumn("k", F.row_number().over(Window.partitionBy("doc", "file", "kind").orderBy("line_no")))
    pairs = ranked.groupBy("doc", "file", "k").agg(F.max(F.when(F.col("kind") == "start", F.col("v"))).alias("start_s"), F.max(F.when(F.col("kind") == "end", F.col("v"))).alias("end_s")).where("start_s is not null and end_s is not null")
    return held.select("doc", "file").distinct().join(pairs, ["doc", "file"], "left").select("doc", "file", "k", "start_s", "end_s")


def clock_seconds(text) -> F.Column:
    """Seconds since midnight of ``hh.mm.ss`` or ``hh:mm:ss`` anywhere in a text; null without one."""
    part = lambda k: F.regexp_extract(text, r"(\d{1,2})[.:](\d{2})[.:](\d{2})", k).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def clock_spans(blocks: DataFrame, longest: float = 1200.0) -> DataFrame:
    """Clock annotations (``registration, start, end`` texts) to seconds from the registration's start.

    Times before the registration belong to the next day; spans over ``longest``
    seconds are dropped.
    """
    reg, start, end = (clock_seconds(F.col(c)) for c in ("registration", "start", "end"))
    after = lambda t: F.pmod(t - reg, F.lit(86400)).cast("double")
    out = blocks.withColumns({"start_s": after(start), "end_s": after(end)})
    return out.withColumn("end_s", F.when(F.col("end_s") < F.col("start_s"), F.col("end_s") + 86400).otherwise(F.col("end_s"))).where(F.col("end_s") - F.col("start_s") <= longest)


def montage(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bipolar channels: ``rec_id, sample_idx, channel, value`` = anode less cathode; pairs (``channel, anode, cathode``) are a small table."""
    legs = pairs.select("channel", F.explode(F.array(F.struct(F.col("anode").alias("leg"), F.lit(1.0).alias("sign")), F.struct(F.col("cathode").alias("leg"), F.lit(-1.0).alias("sign")))).alias("l")).select("channel", "l.leg", "l.sign")
    signed = samples.withColumnRenamed("channel", "leg").join(F.broadcast(legs), "leg")
    return signed.groupBy("rec_id", "sample_idx", "channel").agg(F.sum(F.col("sign") * F.col("value")).alias("value"), F.count("*").alias("n")).where("n = 2").drop("n")
