"""Long recordings in chunks: zero-phase recursive filters, rate changes, seeded projections.

No recording is one task: a chunk is a bounded stretch of samples, what it needs
from others is a filter state or a few samples of its neighbours, and states are
found by a scan over chunks in a tree whose nodes hold a bounded number each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import Recursive, sinc_bank
from ..scratch import written

CHUNK = 4096
#: children of a node of the scan's tree
FAN = 256


def sample_chunks(samples: DataFrame, key: str = "rec_id", size: int = CHUNK, value: str = "value") -> DataFrame:
    """``key, k, n, fit, w``: stretches of ``size`` samples in order, the number of the key's samples, and whether all of those are finite.

    ``samples`` has ``sample_idx`` from 0 without gaps; it is read once.
    """
    x = F.col("value")
    told = samples.select(key, F.col("sample_idx").cast("bigint").alias("sample_idx"), F.col(value).cast("double").alias("value"), F.floor(F.col("sample_idx") / size).cast("bigint").alias("k"))
    fit = F.bool_and(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    raw = written(told.groupBy(key, "k").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "value"))).alias("s"), fit.alias("own")).select(key, "k", "own", F.transform("s", lambda r: r["value"]).alias("w")), "chunks")
    return raw.join(raw.groupBy(key).agg(F.sum(F.size("w")).alias("n"), F.bool_and("own").alias("fit")), key).select(key, "k", "n", "fit", "w")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def affine_scan(maps: DataFrame, key: str, fan: int = FAN) -> DataFrame:
    """``key, k, z``: the state before each ``k`` where ``k`` takes the state ``z`` to ``m z + v`` (``m``: rows of the matrix in turn); the first state is zero.

    ``k`` counts from 0 without gaps. Maps are composed upwards in groups of ``fan``
    until a group is a whole key, then states are handed down: a task holds one
    group, whatever the length of a key.
    """
    kind = _kind(maps, key)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms, vs = [], []
            for rows in batch.column(2).to_pylist():
                v = np.array(rows[0]["v"])
                m = np.array(rows[0]["m"]).reshape(len(v), -1)
                for row in rows[1:]:
                    own = np.array(row["m"]).reshape(m.shape)
                    m, v = own @ m, own @ v + row["v"]
                ms.append(m.ravel())
                vs.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ms, pa.list_(pa.float64())), pa.array(vs, pa.list_(pa.float64()))], [key, "k", "m", "v"])

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents, ks, zs = [], [], []
            for i, (rows, z) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                z = np.zeros(len(rows[0]["v"])) if z is None else np.array(z)
                for row in rows:
                    parents.append(i)
                    ks.append(row["k"])
                    zs.append(z)
                    z = np.array(row["m"]).reshape(len(z), -1) @ z + row["v"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parents, pa.int64())), pa.array(ks, pa.int64()), pa.array(zs, pa.list_(pa.float64()))], [key, "k", "z"])

    top = maps.agg(F.max("k")).first()[0] or 0
    levels, level = [], maps
    while True:
        grouped = level.groupBy(key, F.floor(F.col("k") / fan).cast("bigint").alias("g")).agg(F.sort_array(F.collect_list(F.struct("k", "m", "v"))).alias("rows"))
        levels.append(grouped)
        top //= fan
        if top == 0:
            break
        level = grouped.mapInArrow(composed, f"{key} {kind}, k bigint, m array<double>, v array<double>")
    states = None
    for grouped in reversed(levels):
        held = grouped.withColumn("z", F.lit(None).cast("array<double>")) if states is None else grouped.join(states.withColumnRenamed("k", "g"), [key, "g"])
        states = held.select(key, "g", "rows", "z").mapInArrow(handed, f"{key} {kind}, k bigint, z array<double>")
    return states


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their values as a matrix."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for m in np.unique(sizes):
        rows = np.flatnonzero(sizes == m)
        yield rows, flat[starts[rows][:, None] + np.arange(m)]


def recursive_pass(chunks: DataFrame, b, a, key: str = "rec_id", fan: int = FAN) -> DataFrame:
    """``chunks`` (``key, k, w`` and others) with ``w`` filtered along each key, from the state in which the first sample has always been."""
    model = Recursive(b, a)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(1).to_numpy() == 0
            ms, vs = np.zeros((batch.num_rows, model.n**2)), np.zeros((batch.num_rows, model.n))
            for rows, x in _by_length(batch.column(2)):
                # of a key's first chunk the state before it is known, so its map is constant
                _, vs[rows] = model.run(x, np.where(first[rows, None], x[:, :1] * model.rest, 0.0))
                ms[rows] = np.where(first[rows, None], 0.0, model.power(x.shape[1]).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(ms), pa.list_(pa.float64())), pa.array(list(vs), pa.list_(pa.float64()))], [key, "k", "m", "v"])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, states = batch.column(1).to_numpy() == 0, np.array(batch.column(3).to_pylist(), float).reshape(batch.num_rows, model.n)
            out: list = [None] * batch.num_rows
            for rows, x in _by_length(batch.column(2)):
                y, _ = model.run(x, np.where(first[rows, None], x[:, :1] * model.rest, states[rows]))
                for row, values in zip(rows, y):
                    out[row] = values
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64())), *batch.columns[4:]], [key, "k", "w", *rest])

    rest = [c for c in chunks.columns if c not in (key, "k", "w")]
    maps = chunks.select(key, "k", "w").mapInArrow(mapped, f"{key} {_kind(chunks, key)}, k bigint, m array<double>, v array<double>")
    held = chunks.join(affine_scan(maps, key, fan), [key, "k"]).select(key, "k", "w", "z", *rest)
    return held.mapInArrow(filtered, ", ".join([f"{key} {_kind(chunks, key)}, k bigint, w array<double>", *(f"{c} {_kind(chunks, c)}" for c in rest)]))


def zero_phase(samples: DataFrame, b, a, key: str = "rec_id", value: str = "value", size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``key, sample_idx, filtered``: ``b / a`` run forward and then backward, so that nothing is delayed.

    Both ends are first continued by ``3 * max(len(a), len(b))`` samples turned about
    the end sample. A recording that is not longer than that has nulls; so has one
    with a null, NaN or infinite sample (whose effect would not end).
    """
    pad = Recursive(b, a).pad
    if size <= pad:
        raise ValueError(f"chunks must be longer than {pad} samples")
    raw = sample_chunks(samples, key, size, value)
    good = F.col("fit") & (F.col("n") > pad)
    # the last chunk takes the remainder too: none is shorter than the others unless it is the only one
    n_chunks = F.greatest(F.floor(F.col("n") / size), F.lit(1)).cast("bigint")
    parts = raw.where(good).groupBy(key, n_chunks.alias("n_chunks"), F.least("k", n_chunks - 1).alias("to")).agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("s"))
    chunks = parts.select(key, F.col("to").alias("k"), "n_chunks", F.flatten(F.transform("s", lambda r: r["w"])).alias("w"))
    turned = lambda part, end: F.transform(F.reverse(part), lambda x: 2 * end - x)
    n, last, none = F.size("w"), F.element_at("w", -1), F.array().cast("array<double>")
    left = F.when(F.col("k") == 0, turned(F.slice("w", 2, pad), F.get("w", F.lit(0)))).otherwise(none)
    right = F.when(F.col("k") == F.col("n_chunks") - 1, turned(F.slice("w", n - pad, F.lit(pad)), last)).otherwise(none)
    padded = chunks.withColumn("w", F.concat(left, "w", right))
    flip = lambda df: df.withColumns({"k": F.col("n_chunks") - 1 - F.col("k"), "w": F.reverse("w")})
    forward = written(recursive_pass(padded, b, a, key, fan), "forward")
    both = flip(recursive_pass(flip(forward), b, a, key, fan))
    before = F.when(F.col("k") == 0, pad).otherwise(0)
    after = F.when(F.col("k") == F.col("n_chunks") - 1, pad).otherwise(0)
    cut = both.select(key, (F.col("k") * size).alias("start"), F.slice("w", before + 1, F.size("w") - before - after).alias("w"))
    out = cut.select(key, "start", F.posexplode("w").alias("i", "filtered")).select(key, (F.col("start") + F.col("i")).alias("sample_idx"), "filtered")
    bad = raw.where(~good).select(key, (F.col("k") * size).alias("start"), F.posexplode("w").alias("i", "_")).select(key, (F.col("start") + F.col("i")).alias("sample_idx"), F.lit(None).cast("double").alias("filtered"))
    return out.unionByName(bad)


def resampled(samples: DataFrame, up: int, down: int, key: str = "rec_id", value: str = "value", size: int = CHUNK) -> DataFrame:
    """``key, sample_idx, value`` at ``up / down`` times the rate: ``ceil(n * up / down)`` samples of each key.

    A sample goes to its chunk and to the neighbours whose outputs reach it, by one
    shuffle; beyond the ends a recording is zero. Nulls and NaN spread over the
    outputs that reach them, as NaN.
    """
    bank, reach = sinc_bank(up, down)
    size = max(size, 2 * reach)
    n = samples.groupBy(key).agg(F.count("*").alias("n"))
    held = samples.select(key, F.col("sample_idx").cast("bigint").alias("j"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("x")).join(n, key)
    part = lambda c: F.floor(c / size).cast("bigint")
    low, high = F.greatest(part(F.col("j") - reach), F.lit(0).cast("bigint")), F.least(part(F.col("j") + reach), part(F.col("n") - 1))
    dealt = held.withColumn("k", F.explode(F.sequence(low, high))).groupBy(key, "k").agg(F.first("n").alias("n"), F.min("j").alias("j0"), F.sort_array(F.collect_list(F.struct("j", "x"))).alias("s"))
    rows = dealt.select(key, "k", "n", "j0", F.transform("s", lambda s: s["x"]).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, outs = [], []
            for k, n, j0, w in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), batch.column(4)):
                first, end = -(-k * size * up // down), min(-(-(k + 1) * size * up // down), -(-n * up // down))
                m = np.arange(first, max(first, end), dtype=np.int64)
                x = np.zeros(size + 2 * reach + 1)
                have = np.asarray(w.values)
                x[j0 - k * size + reach :][: len(have)] = have
                at = m * down // up - k * size
                starts.append(first)
                outs.append((x[at[:, None] + np.arange(2 * reach + 1)] * bank[m * down % up]).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(outs, pa.list_(pa.float64()))], [key, "start", "w"])

    kind = _kind(samples, key)
    done = rows.mapInArrow(run, f"{key} {kind}, start bigint, w array<double>")
    return done.select(key, "start", F.posexplode("w").alias("i", "value")).select(key, (F.col("start") + F.col("i")).alias("sample_idx"), "value")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of counters (the finaliser of a split-mix generator)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def projection_rows(seed: int, places: np.ndarray, dims: int) -> np.ndarray:
    """Rows ``places`` of an endless matrix of independent normal numbers, each made from a hash of its place and the seed."""
    with np.errstate(over="ignore"):
        base = _mixed(np.uint64(seed) + np.zeros(1, np.uint64))
        counter = places.astype(np.uint64)[:, None] * np.uint64(dims) + np.arange(dims, dtype=np.uint64)
        h = _mixed(_mixed(counter) ^ base)
        g = _mixed(h)
    u, v = (h >> np.uint64(11)).astype(float) / 2**53, (g >> np.uint64(11)).astype(float) / 2**53
    return np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)


def projected(samples: DataFrame, width: int, dims: int, seed: int = 0, key: str = "rec_id", value: str = "value", block: int = 1024) -> DataFrame:
    """``key, window, x``: windows of ``width`` samples, side by side, as ``dims`` random projections over the root of ``width``.

    Distances between windows become distances between projections over the root of
    ``width``, times the root of ``dims``, to within a few times ``1 / sqrt(dims)``.
    A block of samples makes its rows of the matrix from their places, so that none is
    sent anywhere; a window's blocks are added up. A window that isn't whole, or has a
    null or non-finite sample, is left out.
    """
    x = F.col("value")
    told = samples.select(key, F.floor(F.col("sample_idx") / width).cast("bigint").alias("window"), (F.col("sample_idx") % width).cast("bigint").alias("i"), F.col(value).cast("double").alias("value")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = told.groupBy(key, "window", F.floor(F.col("i") / block).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("s")).select(key, "window", F.transform("s", lambda r: r["i"]).alias("i"), F.transform("s", lambda r: r["value"]).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}  # the matrix's rows of one block, made once a task if a block comes again
        for batch in batches:
            out = []
            for i, v in zip(batch.column(2), batch.column(3)):
                at, values = np.asarray(i.values), np.asarray(v.values)
                b = int(at[0]) // block
                if b not in kept:
                    if len(kept) > 16:
                        kept.clear()
                    kept[b] = projection_rows(seed, np.arange(b * block, min((b + 1) * block, width)), dims)
                out.append(values @ kept[b][at - b * block] / np.sqrt(width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).value_lengths().cast(pa.int64()), pa.array(out, pa.list_(pa.float64()))], [key, "window", "n", "x"])

    parts = rows.mapInArrow(run, f"{key} {_kind(samples, key)}, window bigint, n bigint, x array<double>")
    if width <= block:
        return parts.where(F.col("n") == width).drop("n")
    sums = parts.select(key, "window", "n", F.posexplode("x").alias("j", "v")).groupBy(key, "window", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where(F.col("n") == width)
    return sums.groupBy(key, "window").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("s")).select(key, "window", F.transform("s", lambda r: r["v"]).alias("x"))
