"""Windows against intervals: overlap, containment, guarded absence, risk; histories and horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucketed_overlap(windows: DataFrame, spans: DataFrame, key: str, bucket: float, how: str = "inner", guard: float = 0.0) -> DataFrame:
    """Windows (``t0, t1``) that meet spans (``s, e``) of the same key, widened by ``guard``: t0 < e + guard and t1 > s - guard.

    Both sides are dealt to time buckets, which makes the range join an equality
    join on (key, bucket): a key with very many windows is spread, and pairs are
    only formed inside a bucket. ``how``: ``semi`` keeps windows that meet a
    span, ``anti`` those that meet none. ``windows`` has a unique ``window_id``.
    """
    w = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t0") / bucket).cast("bigint"), F.floor(F.col("t1") / bucket).cast("bigint"))))
    s = spans.select(key, (F.col("s") - guard).alias("_s"), (F.col("e") + guard).alias("_e"))
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket).cast("bigint"), F.floor(F.col("_e") / bucket).cast("bigint"))))
    hit = w.join(s, [key, "_b"]).where((F.col("t0") < F.col("_e")) & (F.col("t1") > F.col("_s"))).select("window_id").distinct()
    return windows.join(hit, "window_id", "left_anti" if how == "anti" else "left_semi")


def contained_windows(spans: DataFrame, width: float) -> DataFrame:
    """Windows of ``width`` that lie wholly inside a span, counted from its start: adds ``t0``."""
    n = F.floor((F.col("e") - F.col("s")) / width)
    return spans.where(n >= 1).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint")))).withColumn("t0", F.col("s") + F.col("_k") * width).drop("_k")


def risk_labels(steps: DataFrame, onsets: DataFrame, key: str, risk: float, post: float) -> DataFrame:
    """Adds ``y`` (an onset in (t, t + risk]) and ``eligible`` (t in no (s, e + post]) to steps with a unique ``step_id``."""
    bucket = risk + post
    s = steps.withColumn("_b", F.floor(F.col("t") / bucket).cast("bigint"))
    o = onsets.select(key, "s", "e", F.explode(F.sequence(F.floor((F.col("s") - risk) / bucket).cast("bigint"), F.floor((F.col("e") + post) / bucket).cast("bigint"))).alias("_b"))
    flags = s.join(o, [key, "_b"]).groupBy("step_id").agg(F.bool_or((F.col("s") > F.col("t")) & (F.col("s") <= F.col("t") + risk)).alias("_y"), F.bool_or((F.col("t") >= F.col("s")) & (F.col("t") <= F.col("e") + post)).alias("_busy"))
    return steps.join(flags, "step_id", "left").withColumn("y", F.coalesce("_y", F.lit(False)).cast("int")).withColumn("eligible", ~F.coalesce("_busy", F.lit(False))).drop("_y", "_busy")


def lagged(df: DataFrame, key: str, idx: str, value: str, lags: list[int]) -> DataFrame:
    """Adds ``lag_k`` for each k (negative: ahead) by one equality join on (key, place), without sorting a key in one task."""
    # each row is sent to the places that look at it
    sent = df.select(key, F.explode(F.array(*[F.struct((F.col(idx) + k).alias(idx), F.lit(k).alias("_k")) for k in lags])).alias("_r"), F.col(value).alias("_v")).select(key, f"_r.{idx}", "_r._k", "_v")
    wide = sent.groupBy(key, idx).agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"lag_{k}".replace("-", "m")) for k in lags])
    return df.join(wide, [key, idx], "left")


def chronological_half(df: DataFrame, key: str, idx: str) -> DataFrame:
    """Adds ``half``: 0 for the first floor(n / 2) rows of a key, 1 for the rest."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    return df.join(n, key).withColumn("half", (F.col(idx) >= F.floor(F.col("_n") / 2)).cast("int")).drop("_n")


def valid_samples(df: DataFrame, key: str, idx: str, group: str, history: int, horizon: int) -> DataFrame:
    """Rows whose history and horizon lie in one group: the group ``history - 1`` before equals that ``horizon`` ahead."""
    ends = lagged(df, key, idx, group, [history - 1, -horizon])
    return ends.where(F.col(f"lag_{history - 1}") == F.col(f"lag_m{horizon}")).drop(f"lag_{history - 1}", f"lag_m{horizon}")


def first_after(onsets: DataFrame, steps: DataFrame, key: str, width: float, bucket: float) -> DataFrame:
    """Adds ``step`` and ``t`` to onsets (key, ``s``, unique ``onset_id``): the first step of the key (``t``, ``step``) that ends after the onset, t + width > s; null where there is none.

    Steps of equal time: the smallest. Onsets look into their time bucket by an
    equality join; where nothing follows there, the first step of the next bucket
    that has one is taken, from a table of one row a bucket.
    """
    o = onsets.withColumns({"_from": F.col("s") - width, "_b": F.floor((F.col("s") - width) / bucket).cast("bigint")})
    dealt = steps.select(key, F.struct("t", "step").alias("_p"), F.floor(F.col("t") / bucket).cast("bigint").alias("_b"))
    near = o.select("onset_id", key, "_b", "_from").join(dealt, [key, "_b"]).where(F.col("_p.t") > F.col("_from")).groupBy("onset_id").agg(F.min("_p").alias("_near"))
    firsts = dealt.groupBy(key, "_b").agg(F.min("_p").alias("_p"))
    later = Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    marked = firsts.join(o.select(key, "_b").distinct(), [key, "_b"], "full").withColumn("_next", F.last("_p", True).over(later)).select(key, "_b", "_next")
    found = o.join(near, "onset_id", "left").join(marked, [key, "_b"], "left").withColumn("_at", F.coalesce("_near", "_next"))
    return found.withColumns({"step": F.col("_at.step"), "t": F.col("_at.t")}).drop("_from", "_b", "_near", "_next", "_at")


def histories(df: DataFrame, key: str, idx: str, value: str, n: int) -> DataFrame:
    """Adds ``history``: the last ``n`` values of the key, the row's own last; null where it has fewer."""
    wide = lagged(df, key, idx, value, list(range(1, n)))
    lags = [f"lag_{k}" for k in range(1, n)]
    past = F.array(*[F.col(c) for c in reversed(lags)], F.col(value))
    return wide.withColumn("history", F.when(F.col(idx) >= n - 1, past)).drop(*lags)
