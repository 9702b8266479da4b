"""Chirplet dictionaries and their search: small tables held against signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pursuit import orthonormal_parts


def grid(spark: SparkSession, **axes: list[float]) -> DataFrame:
    """Cartesian product of named axes (``name`` and place ``name_i``): constant arrays unfolded in one task, no join."""
    out = spark.range(0, 1, 1, 1)
    for name, values in axes.items():
        out = out.select(*[c for c in out.columns if c != "id"], F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias(f"{name}_i", name))
    return out


def quadratures(atoms: DataFrame, n: int, fs: float) -> DataFrame:
    """Dictionary atoms (``atom_id, tc, fc, dt, c``) by sample: windowed cosine and sine."""
    t = F.col("i") / fs - F.col("tc")
    env = F.exp(-0.5 * (t / F.greatest("dt", F.lit(1e-4))) * (t / F.greatest("dt", F.lit(1e-4))))
    phase = 2 * F.pi() * (F.col("fc") * t + 0.5 * F.col("c") * t * t)
    return atoms.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("atom_id", "i", (env * F.cos(phase)).alias("gc"), (env * F.sin(phase)).alias("gs"))


def search(signals: DataFrame, atoms: DataFrame, n: int, fs: float, digits: int = 9) -> DataFrame:
    """Best atom of each signal (``id, w``): the most energy that a cosine and a sine part can take.

    The dictionary (``atom_id, tc, fc, dt, c``) is a parameter and bounded; each
    batch of signals is scored by two matrix products and reduced at once, so that
    signals are never shuffled. Energies are compared rounded, the smaller atom
    first among equals. Signals that are null or not ``n`` long have none.
    """
    rows = sorted(tuple(r) for r in atoms.select("atom_id", "tc", "fc", "dt", "c").collect())
    names = np.array([r[0] for r in rows], np.int64)
    grid_ = np.array([r[1:] for r in rows], float).reshape(-1, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = orthonormal_parts(grid_, n, fs)
        for batch in batches:
            w = batch.column(1)
            whole = np.flatnonzero(w.value_lengths().fill_null(0).to_numpy() == n)
            part = batch.take(pa.array(whole))
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            for lo in range(0, len(x), 1024):
                e = np.round((x[lo : lo + 1024] @ first.T) ** 2 + (x[lo : lo + 1024] @ second.T) ** 2, digits)
                best = e.argmax(1)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, len(e)), pa.array(names[best]), pa.array(e[np.arange(len(e)), best])], ["id", "atom_id", "energy"])

    kind = signals.schema["id"].dataType.simpleString()
    return signals.select("id", F.col("w").cast("array<double>")).mapInArrow(run, f"id {kind}, atom_id bigint, energy double")
