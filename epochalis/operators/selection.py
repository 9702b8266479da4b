"""Choice of files, subjects and configurations, and joins that pair runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ordered_index


def of_quality(rows: DataFrame, marks: DataFrame, key: str, quality: str) -> DataFrame:
    """Rows whose key is marked with quality 1; a mark that is missing is none."""
    return rows.join(marks.where(F.col(quality) == 1).select(key), key, "left_semi")


def unmarked(files: DataFrame, key: str, *marked: DataFrame) -> DataFrame:
    """Files whose key is in none of the one-column sets."""
    union = marked[0].toDF(key)
    for more in marked[1:]:
        union = union.unionByName(more.toDF(key))
    return files.join(union.distinct(), key, "left_anti")


def subject_of(name: Column, same: dict[str, str] | None = None) -> Column:
    """A file's subject: the name without what follows its last underscore; ``same`` names subjects that are another one."""
    subject = F.regexp_replace(name, r"_[^_]*$", "")
    out = subject
    for alias, real in (same or {}).items():
        out = F.when(subject == alias, F.lit(real)).otherwise(out)
    return out


def file_place(name: Column) -> tuple[Column, Column]:
    """Sort key of a recording's files: the number after the last underscore, and whether it goes on (``+``); without a number last."""
    number = F.regexp_extract(name, r"_(\d+)\+?\.[^.]*$", 1).try_cast("int")
    return F.coalesce(number, F.lit(1_000_000)), F.coalesce(name.rlike(r"_\d+\+\.[^.]*$"), F.lit(False))


def plain_stem(name: Column) -> Column:
    """A file name without its ending, in lower case, with 0 for the letter o, and without dots and dashes at its end."""
    return F.regexp_replace(F.translate(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "o", "0"), r"[-.]+$", "")


def resolved(names: DataFrame, files: DataFrame, case: str) -> DataFrame:
    """``case, name, file``: the file of its case that an annotation's name means, null if none.

    In this order: the same name; the same plain stem (of several files the
    first); the only file whose plain stem begins with it; the case's only file.
    Beginnings are spelled out on the files' side, so that every step is an
    equality join, whatever the size of a case.
    """
    held = names.select(case, "name").distinct().withColumn("stem", plain_stem(F.col("name")))
    disk = files.select(case, "file").distinct().withColumn("stem", plain_stem(F.col("file")))
    same = disk.select(case, F.col("file").alias("name"), F.col("file").alias("f1"))
    stems = disk.groupBy(case, "stem").agg(F.min("file").alias("f2"))
    heads = disk.where("stem <> ''").select(case, "file", F.explode(F.expr("transform(sequence(1, length(stem)), k -> left(stem, k))")).alias("stem"))
    heads = heads.groupBy(case, "stem").agg(F.min("file").alias("f3"), F.count("*").alias("n")).where("n = 1").drop("n")
    only = disk.groupBy(case).agg(F.min("file").alias("f4"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = held.join(same, [case, "name"], "left").join(stems, [case, "stem"], "left").join(heads, [case, "stem"], "left").join(only, case, "left")
    return out.select(case, "name", F.coalesce("f1", "f2", "f3", "f4").alias("file"))


def whole_montage(samples: DataFrame, key: str) -> DataFrame:
    """Recordings that have all channels of the table."""
    seen = samples.groupBy(key).agg(F.countDistinct("channel").alias("n"))
    all_ = samples.agg(F.countDistinct("channel").alias("_all"))
    return samples.join(seen.join(F.broadcast(all_), F.col("n") == F.col("_all")).select(key), key, "left_semi")  # one row


def trimmed(samples: DataFrame, key: str, least: float) -> DataFrame:
    """Samples up to the last one of their recording above ``least`` in size."""
    last = samples.where(F.abs("value") > least).groupBy(key).agg(F.max("sample_idx").alias("_last"))
    return samples.join(last, key).where("sample_idx <= _last").drop("_last")


def quota_sample(rows: DataFrame, key: str, name: str, share: float) -> DataFrame:
    """The first ``ceil(share * n)`` rows of each key in the order of a hash of the name: a shuffle that any engine repeats.

    Places come from bucket counts, so that a key with a third of all rows is spread.
    """
    h = rows.withColumn("_h", F.md5(F.col(name).cast("string")))
    placed = ordered_index(h, key, F.substring("_h", 1, 2), "_h", name)
    quota = rows.groupBy(key).agg(F.ceil(F.count("*") * F.lit(share)).alias("_quota"))
    return placed.join(quota, key).where("sample_idx < _quota").drop("_h", "_quota", "sample_idx")


def best_config(scores: DataFrame, config: str, subject: str, score: str) -> DataFrame:
    """``config, n, score, best``: the median over subjects of their mean score; the smallest is the best, the first among equals."""
    by = scores.groupBy(config, subject).agg(F.avg(score).alias("s"))
    median = by.groupBy(config).agg(F.count("*").alias("n"), F.round(F.median("s"), 6).alias("score"))
    top = median.agg(F.min(F.struct("score", config)).alias("t"))  # configurations are few
    return median.crossJoin(F.broadcast(top)).select(config, "n", "score", (F.col(config) == F.col(f"t.{config}")).alias("best"))


def paired_runs(a: DataFrame, b: DataFrame, subject: str, score: str) -> DataFrame:
    """Subjects of both runs with either score and the difference."""
    both = a.select(subject, F.col(score).alias("a")).join(b.select(subject, F.col(score).alias("b")), subject)
    return both.withColumn("d", F.col("a") - F.col("b"))


def aligned(a: DataFrame, b: DataFrame, key: str, y: str) -> DataFrame:
    """``n, only_a, only_b, differ``: whether two sets of rows have the same keys and labels, by key and never by place."""
    both = a.select(key, F.col(y).alias("ya")).withColumn("in_a", F.lit(True)).join(b.select(key, F.col(y).alias("yb")).withColumn("in_b", F.lit(True)), key, "full")
    held = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return both.agg(F.count(F.when(held, 1)).alias("n"), F.count(F.when(F.col("in_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("only_b"), F.count(F.when(held & ~F.col("ya").eqNullSafe(F.col("yb")), 1)).alias("differ"))


def explained(atoms: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` atoms of most energy of each channel-epoch, with their share of its energy in percent; a channel-epoch has few atoms."""
    own = Window.partitionBy("epoch_id", "ch_idx")
    ranked = atoms.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("energy"), "atom_idx")), "percent": 100 * F.try_divide(F.col("energy"), F.sum("energy").over(own))})
    return ranked.where(F.col("rank") <= n)
