"""Ordered state along recordings: echo-state reservoirs and the ridge readout.

A recording's rows are sent to one task and sorted by place; the state is
carried from batch to batch, so a task holds one batch and one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EchoState:
    """Leaky tanh reservoir with a sparse recurrent matrix of a given spectral radius."""

    def __init__(self, d_in: int, n: int = 32, radius: float = 0.9, leak: float = 0.3, scale: float = 0.5, seed: int = 0):
        rng = np.random.default_rng(seed)
        w = rng.uniform(-1, 1, (n, n)) * (rng.random((n, n)) < 0.1 + 2 / n)
        top = np.abs(np.linalg.eigvals(w)).max()
        self.w, self.u, self.b = w * (radius / max(top, 1e-9)), rng.uniform(-scale, scale, (d_in, n)), rng.uniform(-0.1, 0.1, n)
        self.leak, self.n = leak, n

    def start(self):
        return np.zeros(self.n)

    def step(self, state, x):
        return (1 - self.leak) * state + self.leak * np.tanh(state @ self.w.T + x @ self.u + self.b)

    def read(self, state):
        return state


def run_reservoir(steps: DataFrame, make: Callable[[], object], key: str = "rec_id", order: str = "sample_idx", inputs: str = "u") -> DataFrame:
    """``key, order, state``: the readout after every step, from a fresh state for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last, state = make(), None, None
        for batch in batches:
            out = []
            for k, u in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is None or k != last:
                    last, state = k, model.start()
                state = model.step(state, np.array(u, float))
                out.append(model.read(state))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], [key, order, "state"])

    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}
    dealt = steps.select(key, order, inputs).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, state array<double>")


def normal_sums(rows: DataFrame, features: str, target: str) -> np.ndarray:
    """Sums of products of all pairs among the features and the target (last): partial sums of each task, one shuffle.

    What reaches the driver is a matrix of the number of features squared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = np.array(batch.column(0).to_pylist(), float), batch.column(1).to_numpy(zero_copy_only=False)
                both = np.column_stack((x, y))
                total = both.T @ both if total is None else total + both.T @ both
        if total is not None:
            size = len(total)
            i, j = np.divmod(np.arange(size * size), size)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    sums = rows.select(features, F.col(target).cast("double")).mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = max((r["i"] for r in sums), default=0) + 1
    m = np.zeros((size, size))
    for r in sums:
        m[r["i"], r["j"]] = r["v"]
    return m


def solved(sums: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(sums[:-1, :-1] + alpha * np.eye(len(sums) - 1), sums[:-1, -1])


def ridge(rows: DataFrame, features: str, target: str, alpha: float) -> np.ndarray:
    """Weights of a ridge readout."""
    return solved(normal_sums(rows, features, target), alpha)


def own_scale(rows: DataFrame, person: str, features: list[str]) -> DataFrame:
    """Adds ``x``: the features by the mean and sample deviation of the person's training rows (``part`` = 'trn'), 0 where they hardly vary, and a 1 as the last."""
    stats = rows.where("part = 'trn'").groupBy(person).agg(*[f(c).alias(f"_{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = [F.when(F.col(f"_s_{c}") > 1e-6, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in features]
    return rows.join(stats, person).withColumn("x", F.array(*z, F.lit(1.0))).drop(*[f"_{k}_{c}" for c in features for k in "ms"])


def pooled_readout(rows: DataFrame, person: str, features: list[str], target: str, alphas=(0.1, 1.0, 10.0, 100.0, 1000.0)) -> tuple[DataFrame, float]:
    """``person, skill`` on test rows, and the penalty: one readout trained on all people's training rows.

    ``part`` is trn, val or tst; the target is a deviation from the last value, so
    that predicting nothing is persistence. The penalty is the one with the best
    skill on validation rows, which the sums of products of those rows give
    without another pass.
    """
    held = own_scale(rows, person, features)
    train, val = (normal_sums(held.where(F.col("part") == p), "x", target) for p in ("trn", "val"))
    tried = [(a, solved(train, a)) for a in alphas]
    left = lambda w: np.append(w, -1) @ val @ np.append(w, -1) if len(val) > 1 else 0.0
    alpha, w = min(tried, key=lambda t: left(t[1]))
    weights = F.array(*[F.lit(float(v)) for v in w])
    guess = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    tests = held.where("part = 'tst'").withColumn("_d", guess - F.col(target))
    skill = 1 - F.sum(F.col("_d") * F.col("_d")) / F.greatest(F.sum(F.col(target) * F.col(target)), F.lit(1e-12))
    return tests.groupBy(person).agg(skill.alias("skill")), alpha
