"""Whole studies: features to predictions, scores and decisions, written as they come and gone on with after a stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pursuit import atoms_of
from ..operators import statistics as S
from ..operators import validation as V
from ..sources.sinks import append_results, existing, result_line, save_missing, save_tagged


def save_atoms(signals: DataFrame, path: str, n: int, fs: float, order: int = 6, part: str = "rec_id", keys: tuple[str, ...] = ("rec_id", "epoch_id", "ch_idx")) -> int:
    """Atoms of all signals (``keys, w``) by recording; recordings that ``path`` has aren't decomposed again. Says how many were added."""
    done = existing(signals.sparkSession, path, part)
    left = signals if done is None else signals.join(done, part, "left_anti")
    return save_missing(atoms_of(left, n, fs, order, keys=keys), path, part)


def compare_sets(spark: SparkSession, sets: dict[str, tuple[DataFrame, list[str]]], label: str, group: str, row_id: str, configs: list[dict], root: str, ours: list[str], theirs: list[str], outer: int = 5, inner: int = 3, level: float = 0.01) -> DataFrame:
    """One nested search for each feature set (name: rows, features), and the decision between the best of two families.

    Under ``root``: ``features`` and ``predictions`` by set, ``results`` as JSON lines (a
    line a set, which a stopped study keeps), ``report`` as text. A set whose
    predictions are there isn't searched again.
    """
    there = existing(spark, f"{root}/predictions", "set")
    have = set() if there is None else {r["set"] for r in there.collect()}
    for name, (rows, features) in sets.items():
        if name in have:
            continue
        save_tagged(rows.select(row_id, group, label, *features), f"{root}/features/{name}", name)
        out, done = V.nested_search(rows, features, label, group, configs, outer, inner)
        told = out.select(F.lit(name).alias("set"), row_id, group, label, "fold", "config", "predicted", "score")
        save_missing(told, f"{root}/predictions", "set")
        mine = spark.read.parquet(f"{root}/predictions").where(F.col("set") == name)
        by = mine.groupBy(group).agg(F.avg((F.col(label) == F.col("predicted")).cast("int")).alias("a"))
        line = by.agg(F.avg("a").alias("accuracy"), F.stddev_samp("a").alias("spread")).crossJoin(S.roc_auc(mine, label, "score")).withColumn("set", F.lit(name))  # one row each
        append_results(line.crossJoin(done.agg(F.sort_array(F.collect_list(F.struct("fold", "config", "inner_accuracy", "outer_accuracy"))).alias("folds"))), f"{root}/results")
    results = spark.read.schema("set string, accuracy double, spread double, auc double").json(f"{root}/results")
    results.select(result_line(F.col("set"), F.col("accuracy"), F.col("spread"), F.col("auc")).alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(f"{root}/report")  # a line a set
    scores = spark.read.parquet(f"{root}/predictions").groupBy(F.col("set").cast("string").alias("model"), group).agg(F.avg((F.col(label) == F.col("predicted")).cast("int")).alias("score"))
    return V.decided(scores, group, ours, theirs, level)
