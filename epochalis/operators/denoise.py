"""How well each of many artifact rules cleans recordings, without cleaning them once for each rule.

Atoms are grouped by the set of rules' parts that they meet; such a set is taken
out by a rule as a whole or not at all. One overlap-add gives each set's waveform,
and a batch of samples gives every rule's remaining error, since energies add up over
samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .atoms import parts_met, rule_grid
from .statistics import exact_percentiles

#: samples of a recording that are dealt together
STRETCH = 1 << 15
#: the artifact itself, as one more set that every rule has
_ARTIFACT = -1


def set_waves(found: DataFrame, sigma: DataFrame, axes: dict[str, list], width: int, hop: int, key: str = "rec_id") -> DataFrame:
    """``key, sample_idx, met, value``: waveforms of the atoms (``key, frame, f_hz, dur_s, wave``) of each set, overlapped and added under a periodic Hann window. Atoms that no rule takes go."""
    parts, _ = rule_grid(axes)
    amp = F.aggregate("wave", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    marked = found.join(sigma, key).withColumn("met", parts_met(F.col("f_hz"), F.col("dur_s"), amp, F.col("sigma"), parts)).where("met <> 0")
    hann = 0.5 - 0.5 * F.cos(2 * F.pi() * F.col("offset") / width)
    long = marked.select(key, "frame", "met", F.posexplode("wave").alias("offset", "v"))
    return long.groupBy(key, (F.col("frame") * hop + F.col("offset")).cast("bigint").alias("sample_idx"), "met").agg(F.sum(F.col("v") * hann).alias("value"))


def rule_scores(waves: DataFrame, artifact: DataFrame, axes: dict[str, list], key: str = "rec_id") -> DataFrame:
    """``key, <axes>, before, left, gain_db``: energy of the artifact (``key, sample_idx, value``), and of the error that a rule leaves: artifact less what it takes out.

    ``gain_db`` is null where nothing was there or nothing is left. Rows of a sample come
    together in stretches of ``STRETCH`` samples; a batch of samples is reduced to one
    row of energies a recording, an energy for each rule, and only those are shuffled
    and added. They are written, so that they are worked out once.
    """
    _, grid = rule_grid(axes)
    names = list(axes)
    masks = np.array([mask for mask, _ in grid], np.int64)
    rules = artifact.sparkSession.createDataFrame([(k, *(float(rule[n]) for n in names)) for k, (_, rule) in enumerate(grid)], "rule int, " + ", ".join(f"{n} double" for n in names))
    both = waves.select(key, F.col("sample_idx").cast("bigint").alias("sample_idx"), F.col("met").cast("int").alias("met"), "value").unionByName(artifact.select(key, F.col("sample_idx").cast("bigint").alias("sample_idx"), F.lit(_ARTIFACT).alias("met"), (-F.col("value").cast("double")).alias("value")))
    kind = both.schema[key].dataType.simpleString()
    dealt = both.withColumn("stretch", F.floor(F.col("sample_idx") / STRETCH)).repartition(key, "stretch").sortWithinPartitions(key, "sample_idx")

    def energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, keys in whole_runs(batches, 2):
            idx, met, value = (table.column(c).to_numpy() for c in (1, 2, 3))
            new = np.append(True, (keys[1:] != keys[:-1]) | (idx[1:] != idx[:-1]))
            sample = np.cumsum(new) - 1
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            own = np.searchsorted(sample[first], np.arange(sample[-1] + 1), "right") - 1
            energy = lambda use: np.bincount(own, np.bincount(sample, np.where(use, value, 0.0), len(own)) ** 2, len(first))
            out = np.stack([energy(met == _ARTIFACT), *(energy((met & mask) != 0) for mask in masks)], 1)  # the artifact has all bits
            yield pa.RecordBatch.from_arrays([table.column(0).take(pa.array(first)), pa.array(out.tolist(), pa.list_(pa.float64()))], [key, "e"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, keys in whole_runs(batches, 1):
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            e = np.add.reduceat(table.column(1).flatten().to_numpy().reshape(len(keys), -1), first, 0)
            yield pa.RecordBatch.from_arrays([table.column(0).take(pa.array(first)), pa.array(e.tolist(), pa.list_(pa.float64()))], [key, "e"])

    parts = dealt.select(key, "sample_idx", "met", "value").mapInArrow(energies, f"{key} {kind}, e array<double>")
    sums = written(parts.repartition(key).sortWithinPartitions(key).mapInArrow(added, f"{key} {kind}, e array<double>"), "energies")
    done = sums.select(key, F.get("e", F.lit(0)).alias("before"), F.posexplode(F.slice("e", 2, len(grid))).alias("rule", "left")).join(F.broadcast(rules), "rule").select(key, *names, "before", "left")
    return done.withColumn("gain_db", F.when((F.col("before") > 0) & (F.col("left") > 0), 10 * F.log10(F.col("before") / F.col("left"))))


def whole_runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches, with numbers for the first column, that no run of equal first ``columns`` crosses."""
    held: pa.Table | None = None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
        if held is None or not held.num_rows:
            continue
        held = held.combine_chunks()
        keys = held.column(0).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        same = keys == keys[-1]
        for c in range(1, columns):
            other = held.column(c).to_numpy()
            same &= other == other[-1]
        cut = len(keys) if batch is None else len(keys) - int(same[::-1].cumprod().sum())
        if cut:
            yield held.slice(0, cut).combine_chunks().to_batches()[0], keys[:cut]
        held = held.slice(cut)


def best_rule(scores: DataFrame, axes: dict[str, list], key: str = "rec_id") -> DataFrame:
    """``<axes>, n, gain_db, best``: the median gain of each rule over recordings; the largest is the best, the first in order of its thresholds among equals."""
    names = list(axes)
    gains = scores.where("gain_db is not null").select(F.struct(*names).alias("rule"), "gain_db")
    medians = exact_percentiles(gains, "rule", "gain_db", [0.5]).select("rule", F.round("p0", 9).alias("gain_db"))
    by = written(gains.groupBy("rule").agg(F.count("*").alias("n")).join(medians, "rule").select("rule.*", "n", "gain_db"), "gains")
    top = by.agg(F.min(F.struct((-F.col("gain_db")).alias("g"), *names)).alias("t"))  # one row of a few rules
    return by.crossJoin(F.broadcast(top)).select(*names, "n", "gain_db", F.expr(" and ".join(f"{n} = t.{n}" for n in names)).alias("best"))
