"""Results as tables: tagged feature sets, parts that a restarted job doesn't make again, results as they come, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_tagged(features: DataFrame, path: str, tag: str) -> None:
    """A feature set (ids, labels, groups and features, names being the columns') under its tag; the tag's old rows go, others stay."""
    features.withColumn("tag", F.lit(tag)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("tag").parquet(path)


def existing(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    """Values of the partition column that ``path`` has; None where nothing is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path).select(part).distinct()


def save_missing(rows: DataFrame, path: str, part: str) -> int:
    """Appends the parts (recordings, cases) that ``path`` lacks and says how many; a restarted job goes on where it ended.

    A part is there as a whole or not: Spark commits a write's files together.
    """
    done = existing(rows.sparkSession, path, part)
    left = rows if done is None else rows.join(done, part, "left_anti")
    n = left.select(part).distinct().count()
    if n:
        left.repartition(part).write.mode("append").partitionBy(part).parquet(path)
    return n


def append_results(results: DataFrame, path: str) -> None:
    """One more model's or size's results as JSON lines; those before stay."""
    results.write.mode("append").json(path)


def result_line(model: Column, accuracy: Column, spread: Column, auc: Column) -> Column:
    """Fixed-width line of a score table; what is null is a dash."""
    number = lambda c: F.lpad(F.coalesce(F.format_number(c, 3), F.lit("-")), 8, " ")
    return F.concat(F.rpad(model, 24, " "), number(accuracy), F.lit(" +- "), number(spread), number(auc))
