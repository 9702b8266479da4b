"""Validation by groups: folds balanced by class, and a nested search whose fits all come from sums of products.

A linear readout with a penalty and a choice of features follows from sums of
products of its training rows, and the sums of any set of groups are sums of
sums. So one pass gives what every outer and inner fold and every configuration
needs, one pass scores all of them on the rows they haven't seen, and one more
predicts; what reaches the driver is a few matrices of features squared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from ..sources.tables import ordered_index

#: groups balanced together, and ways that are all tried where there are no more
BLOCK, WAYS = 2048, 20_000


def imbalance(shares: np.ndarray) -> np.ndarray:
    """Sum of squares of each fold's share of each class (..., folds, classes): least where all folds are alike."""
    return (shares**2).sum((-2, -1))


def balanced(counts: np.ndarray, folds: int) -> np.ndarray:
    """Folds of groups with these counts by class (groups, classes).

    Large groups come first, each to the fold where it adds least imbalance; then
    single moves and swaps as long as they lower it. A few groups are tried in every way.
    """
    share = counts / np.maximum(counts.sum(0), 1)
    n = len(share)
    if folds ** max(n - 1, 0) <= WAYS:
        # the first group's fold is free
        ways = np.array([(0, *w) for w in itertools.product(range(folds), repeat=n - 1)])
        sums = np.stack([np.where((ways == f)[..., None], share, 0.0).sum(1) for f in range(folds)], 1)
        spread = imbalance(sums)
        rows = np.stack([np.where(ways == f, counts.sum(1), 0).sum(1) for f in range(folds)], 1)
        return ways[np.lexsort(((rows**2).sum(1), np.round(spread, 12)))[0]]
    fold = np.full(n, -1)
    sums = np.zeros((folds, share.shape[1]))
    for g in np.argsort(-share.sum(1), kind="stable"):
        f = int(np.argmin((2 * sums * share[g]).sum(1)))
        fold[g] = f
        sums[f] += share[g]
    for _ in range(50):
        moved = False
        for g in range(n):
            a = fold[g]
            gain = 2 * ((sums + share[g]) * share[g]).sum(1) - 2 * (sums[a] * share[g]).sum()
            gain[a] = 0.0
            b = int(np.argmin(gain))
            # or against a group of another fold: what changes hands is the difference
            d = share[g] - share
            swap = np.where(fold == a, 0.0, 2 * ((sums[fold] - sums[a] + d) * d).sum(1))
            h = int(np.argmin(swap))
            if min(gain[b], swap[h]) > -1e-12:
                continue
            moved = True
            if gain[b] <= swap[h]:
                sums[a], sums[b] = sums[a] - share[g], sums[b] + share[g]
                fold[g] = b
            else:
                b = fold[h]
                sums[a], sums[b] = sums[a] - d[h], sums[b] + d[h]
                fold[g], fold[h] = b, a
        if not moved:
            break
    return fold


def stratified_folds(df: DataFrame, group: str, label: str, folds: int, block: int = BLOCK) -> DataFrame:
    """``group, n, fold``: no group is split, and folds have nearly the same share of each class.

    Folds are no more than groups, two at least. Rows without a group or label don't
    count. Many groups are balanced in blocks of about ``block``, each by itself: what
    is balanced block by block is balanced as a whole.
    """
    counts = written(df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group, F.col(label).cast("string").alias("_y")).agg(F.count("*").alias("_n")), "fold-counts")
    n_groups = counts.select(group).distinct().count()
    k = max(2, min(folds, n_groups))
    blocks = -(-n_groups // block) or 1

    def run(part: pd.DataFrame) -> pd.DataFrame:
        table = part.pivot_table(index=group, columns="_y", values="_n", aggfunc="sum", fill_value=0).sort_index()
        return pd.DataFrame({group: table.index, "n": table.to_numpy().sum(1), "fold": balanced(table.to_numpy(float), k)})

    kind = df.schema[group].dataType.simpleString()
    return counts.withColumn("_b", F.pmod(F.xxhash64(group), F.lit(blocks))).groupBy("_b").applyInPandas(run, f"{group} {kind}, n bigint, fold int")


def stratified_rows(df: DataFrame, row_id: str, label: str, folds: int) -> DataFrame:
    """``df`` with ``fold``, where no groups are known: each class is dealt in turns in the order of a hash; folds are no more than rows of the rarest class."""
    rarest = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    k = max(2, min(folds, rarest))
    placed = ordered_index(df.where(F.col(label).isNotNull()).withColumn("_h", F.md5(F.col(row_id).cast("string"))), label, F.substring("_h", 1, 2), "_h", row_id)
    return placed.withColumn("fold", (F.col("sample_idx") % k).cast("int")).drop("_h", "sample_idx")


def fitted(sums: np.ndarray, alpha: float, k: int) -> np.ndarray:
    """Weights for (1, features) of a readout of labels -1 and 1 from sums of products of (1, features, label).

    Features are scaled by the training rows' mean and deviation, the ``k`` with the
    largest F value stay, and the penalty is ``alpha`` times the number of rows.
    """
    n, d = sums[0, 0], len(sums) - 2
    mean, y = sums[0, 1:-1] / max(n, 1), sums[0, -1] / max(n, 1)
    cov = sums[1:-1, 1:-1] / max(n, 1) - np.outer(mean, mean)
    cross = sums[1:-1, -1] / max(n, 1) - mean * y
    var = np.diag(cov)
    held = var > 1e-12 * (1 + mean**2)
    sd = np.where(held, np.sqrt(np.maximum(var, 0)), 1.0)
    # a feature's squared correlation with the label orders features as the F value of two classes does
    r2 = np.where(held, (cross / sd) ** 2, -1.0)
    keep = np.argsort(-np.round(r2, 12), kind="stable")[: max(1, min(k, int(held.sum()) or 1))]
    z, zy = cov[np.ix_(keep, keep)] / np.outer(sd[keep], sd[keep]), cross[keep] / sd[keep]
    w = np.zeros(d + 1)
    w[1 + keep] = np.linalg.solve(z + max(alpha, 1e-9) * np.eye(len(keep)), zy) / sd[keep]
    w[0] = y - w[1:] @ mean
    return w


def nested_search(rows: DataFrame, features: list[str], label: str, group: str, configs: list[dict], outer: int = 5, inner: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows with ``fold, config, score, predicted``, and what was decided: ``fold, config, inner_accuracy, outer_accuracy``.

    For each outer fold, configurations (``alpha``, ``k``) are compared on inner folds
    of its training groups by the mean over inner folds of their accuracy, the first
    of the best is fitted on all training groups and predicts the fold. No row is
    scored, inside or outside, by a model that saw a row of its group. Labels are 0
    and 1; rows with a null feature, label or group go.
    """
    whole = rows.dropna(subset=[*features, label, group])
    outside = written(stratified_folds(whole, group, label, outer).select(group, "fold"), "outer-folds")
    held = written(whole.join(outside, group), "nested-rows")
    k_out = held.agg(F.max("fold")).first()[0]
    if k_out is None or outside.select("fold").distinct().count() < 2:
        raise ValueError("a nested search needs two groups at least")
    cells = [stratified_folds(held.where(F.col("fold") != o), group, label, inner).select(group, F.struct(F.lit(o).alias("o"), F.col("fold").alias("i")).alias("cell")) for o in range(k_out + 1)]
    own = cells[0]
    for more in cells[1:]:
        own = own.unionByName(more)
    # of each row: the inner fold that it is in for every outer fold that it isn't in
    placed = held.join(own.groupBy(group).agg(F.collect_list("cell").alias("cells")), group)
    size = len(features) + 2
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features], (2 * F.col(label) - 1).cast("double"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                keys = [tuple((c["o"], c["i"]) for c in cell) for cell in batch.column(1).to_pylist()]
                for key in set(keys):  # few: groups of a batch that have their cells in common
                    part = values[np.array([k == key for k in keys])]
                    product = part.T @ part
                    for cell in key:
                        total[cell] = total.get(cell, 0) + product
        for (o, i), m in total.items():
            a, b = np.divmod(np.arange(size * size), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size * size, v, np.int64)) for v in (o, i)] + [pa.array(a), pa.array(b), pa.array(m.ravel())], ["o", "i", "a", "b", "v"])

    sums: dict[tuple, np.ndarray] = {}
    for r in placed.select(x.alias("x"), "cells").mapInArrow(summed, "o bigint, i bigint, a bigint, b bigint, v double").groupBy("o", "i", "a", "b").agg(F.sum("v").alias("v")).collect():
        sums.setdefault((r["o"], r["i"]), np.zeros((size, size)))[r["a"], r["b"]] = r["v"]
    train = {o: sum(m for (p, _), m in sums.items() if p == o) for o in range(k_out + 1)}
    tried = {(o, i): np.stack([fitted(train[o] - m, c["alpha"], c["k"]) for c in configs]) for (o, i), m in sums.items()}

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                cell = [[(c["o"], c["i"]) for c in cells] for cells in batch.column(1).to_pylist()]
                for key in {c for cs in cell for c in cs}:
                    part = values[np.array([key in cs for cs in cell])]
                    hit = ((part[:, :-1] @ tried[key].T > 0) == (part[:, -1:] > 0)).sum(0)
                    right[key] = right.get(key, 0) + np.append(hit, len(part))
        for (o, i), hits in right.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(hits), pa.int64()) for v in (o, i)] + [pa.array(range(len(hits)), pa.int64()), pa.array(hits.astype(np.int64))], ["o", "i", "c", "hits"])

    told: dict[tuple, dict] = {}
    for r in placed.select(x.alias("x"), "cells").mapInArrow(judged, "o bigint, i bigint, c bigint, hits bigint").groupBy("o", "i", "c").agg(F.sum("hits").alias("hits")).collect():
        told.setdefault((r["o"], r["i"]), {})[r["c"]] = r["hits"]
    decided = []
    for o in range(k_out + 1):
        inside = [h for (p, _), h in told.items() if p == o]
        score = [float(np.mean([h[c] / h[len(configs)] for h in inside])) for c in range(len(configs))]
        best = int(np.argmax(np.round(score, 12)))
        decided.append((o, best, score[best], fitted(train[o], configs[best]["alpha"], configs[best]["k"])))
    spark = rows.sparkSession
    chosen = spark.createDataFrame([(o, c, s, w.tolist()) for o, c, s, w in decided], "fold int, config int, inner_accuracy double, _w array<double>")
    guess = F.aggregate(F.zip_with(F.slice(x, 1, size - 1), "_w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    out = held.join(F.broadcast(chosen), "fold").withColumn("score", guess).withColumn("predicted", (F.col("score") > 0).cast("int"))  # a row a fold
    done = out.groupBy("fold", "config", "inner_accuracy").agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("outer_accuracy"))
    return out.drop("_w", "inner_accuracy"), done


def decided(scores: DataFrame, subject: str, ours: list[str], theirs: list[str], level: float = 0.01) -> DataFrame:
    """``ours, theirs, lead, n, p, verdict`` of the best of two families: scores (``model, subject, score``) by mean score, then the signed-rank test over subjects.

    ``verdict``: win (ahead and p below the level), ahead, or behind. Models are few; ties go to the first name.
    """
    from .statistics import signed_rank_test

    means = scores.groupBy("model").agg(F.avg("score").alias("m"))
    best = lambda names: means.where(F.col("model").isin(*names)).agg(F.min(F.struct((-F.col("m")).alias("m"), "model"))["model"].alias("model"))
    sides = [best(names).withColumn("side", F.lit(k)) for k, names in ((1.0, ours), (-1.0, theirs))]
    pair = sides[0].unionByName(sides[1])
    own = scores.join(F.broadcast(pair), "model")  # two rows
    d = own.groupBy(subject).agg(F.sum(F.col("side") * F.col("score")).alias("d"), F.count("*").alias("c")).where("c = 2")
    test = signed_rank_test(d, F.round("d", 12))
    lead = d.agg(F.avg("d").alias("lead"))
    names = pair.agg(F.max(F.when(F.col("side") == 1, F.col("model"))).alias("ours"), F.max(F.when(F.col("side") == -1, F.col("model"))).alias("theirs"))
    one = names.crossJoin(lead).crossJoin(test.select("n", "p"))  # one row each
    return one.withColumn("verdict", F.when((F.col("lead") > 0) & (F.col("p") < level), "win").when(F.col("lead") > 0, "ahead").otherwise("behind"))
