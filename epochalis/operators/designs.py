"""Forecasts of many steps ahead from one pass of masked sums of products, by person and pooled.

Of each person, part and horizon the pass keeps the sums of products of the inputs,
of inputs and targets, and of targets with themselves, over the rows whose target is
valid. Scaling by a person's own training rows, readouts under any penalty, errors
on any part, and the pooled readout of all people follow from those sums alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: places of a person whose steps are sorted together
STRETCH = 1 << 15
ALPHAS = (1.0, 10.0, 100.0, 1e3, 1e4)


def horizon_rows(steps: DataFrame, horizons: list[int], history: int = 1, key: str = "person", idx: str = "idx") -> DataFrame:
    """``key, idx, file, x, y, m``: inputs of each step, and what changes until each horizon.

    ``steps``: ``key, idx, file, z, valid``. A step counts if it is valid and the
    ``history`` before it and all horizons lie in its file. ``x`` is z, ``y`` holds an
    array for each horizon (z there less z here), ``m`` whether that step is valid.
    Steps are dealt to stretches of ``STRETCH`` places and to the stretches that look
    at them from outside; no file is sorted in one task. A stretch's rows come out in
    order.
    """
    far = [-(history - 1), *horizons]
    home = lambda h: F.floor((F.col(idx) - h) / STRETCH).cast("bigint")
    told = steps.where(F.col(key).isNotNull() & F.col(idx).isNotNull()).select(key, F.col(idx).cast("bigint").alias(idx), "file", "z", "valid")
    dealt = told.select("*", home(0).alias("_home"), F.explode(F.array_distinct(F.array(home(0), *[home(h) for h in far]))).alias("_stretch"))
    place = Window.partitionBy(key, "_stretch").orderBy(idx)
    looked = F.array(*[F.collect_list(F.struct("file", "z", "valid")).over(place.rangeBetween(h, h)) for h in far])
    held = dealt.withColumn("s", looked).where(F.col("valid") & (F.col("_home") == F.col("_stretch")))
    held = held.where(F.forall("s", lambda s: F.size(s) == 1)).withColumn("s", F.transform("s", lambda s: s[0])).where(F.forall("s", lambda s: s["file"].eqNullSafe(F.col("file"))))
    ahead = F.slice("s", 2, len(horizons))
    y = F.transform(ahead, lambda s: F.zip_with(s["z"], F.col("z"), lambda a, b: (a - b).cast("double")))
    return held.select(key, idx, "file", F.transform("z", lambda v: v.cast("double")).alias("x"), y.alias("y"), F.transform(ahead, lambda s: s["valid"]).alias("m"))


def halves(rows: DataFrame, horizons: list[int], history: int = 1, key: str = "person", idx: str = "idx", val_share: float = 0.15) -> DataFrame:
    """Adds ``part``: trn and val end before the middle of the person's steps, tst has its history after it; rows across it go.

    A share of the files, by a hash of their names, is val. Without rows in both trn
    and val a person has no penalty to choose.
    """
    middle = rows.groupBy(key).agg((F.floor((F.max(idx) + F.min(idx) + max(horizons) - history + 2) / 2)).alias("_mid"))
    chosen = F.pmod(F.xxhash64(F.col("file").cast("string")), F.lit(1000)) < int(1000 * val_share)
    part = F.when(F.col(idx) + max(horizons) < F.col("_mid"), F.when(chosen, "val").otherwise("trn")).when(F.col(idx) - history + 1 >= F.col("_mid"), "tst")
    return rows.join(middle, key).withColumn("part", part).where("part is not null").drop("_mid")


def masked_sums(rows: DataFrame, key: str = "person", empty: bool = True) -> DataFrame:
    """``key, part, h, i, j, v``: sums of products of (1, x) with (1, x, y) and of y with itself, over the rows whose horizon ``h`` is valid.

    ``i`` and ``j`` count 1, then x, then y; of y with y only the squares are kept.
    Each task adds its rows first, one after another as they come, so that rows in
    order have the sums that SQL has; rows with a null or non-finite value go. Groups
    without a row are zeros, or go unless ``empty``.
    """

    def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of a key that follow each other come together, 65,536 at most."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            keys = table.column(0).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            last = len(keys) - int((keys[::-1] == keys[-1]).cumprod().sum()) if len(keys) else 0
            last = len(keys) if len(keys) - last > 1 << 16 else last
            held = table.slice(last)
            if last:
                yield table.slice(0, last).combine_chunks()
        if held is not None and held.num_rows:
            yield held.combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches):
            keys, parts = (table.column(k).combine_chunks() for k in (0, 1))
            codes = [c.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1 for c in (keys, parts)]
            _, first, group = np.unique(codes[0] * (codes[1].max() + 1) + codes[1], return_index=True, return_inverse=True)
            x, y, m = (table.column(k).combine_chunks() for k in (2, 3, 4))
            n_rows, n = len(group), len(first)
            x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n_rows, -1)
            m = m.flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(bool).reshape(n_rows, -1)
            y = y.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n_rows, m.shape[1], -1)
            width, d = 1 + x.shape[1], 1 + x.shape[1] + y.shape[2]
            own, part = keys.take(pa.array(first)), parts.take(pa.array(first))
            for h in range(m.shape[1]):
                both = np.column_stack((np.ones(n_rows), x, y[:, h]))
                at = np.flatnonzero(m[:, h] & np.isfinite(both).all(1))
                both, g = both[at], group[at]
                pairs = {(i, j): np.bincount(g, both[:, i] * both[:, j], n).astype(float) for i in range(d) for j in range(i, d) if i < width or i == j}
                use = np.flatnonzero(pairs[0, 0] > 0) if not empty else np.arange(n)
                if not len(use):
                    continue
                out = [(i, j, pairs[min(i, j), max(i, j)][use]) for i in range(d) for j in range(d) if i < width or i == j]
                named = [c.take(pa.array(np.tile(use, len(out)))) for c in (own, part)]
                i, j = (pa.array(np.repeat(np.array([o[k] for o in out], np.int32), len(use))) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*named, pa.array(np.full(len(i), h, np.int32)), i, j, pa.array(np.concatenate([o[2] for o in out]))], [key, "part", "h", "i", "j", "v"])

    sums = rows.select(key, "part", "x", "y", "m").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, part string, h int, i int, j int, v double")
    return sums.groupBy(key, "part", "h", "i", "j").agg(F.sum("v").alias("v"))


PARTS = ("trn", "val", "tst")


class Sums:
    """Sums of many people: by part and horizon each one's products of (1, x), scaled by their training rows, those with targets, and the targets' squares."""

    def __init__(self, flat: pa.Array, p: int, q: int, n_h: int):
        k, d = 1 + p, 1 + p + q
        who = np.repeat(np.arange(len(flat)), flat.value_lengths().to_numpy())
        part, h, i, j, v = (c.to_numpy(zero_copy_only=False) for c in flat.flatten().flatten())
        m = np.zeros((len(flat), len(PARTS), n_h, d, d))
        of = np.array([PARTS.index(c) if c in PARTS else -1 for c in part], int)
        use = of >= 0
        m[who[use], of[use], h[use], i[use], j[use]] = v[use]
        base = m[:, 0].sum(1)
        n = np.maximum(base[:, 0, 0], 1)[:, None]
        mean = base[:, 0, 1:k] / n
        sd = np.sqrt(np.maximum(np.einsum("bii->bi", base)[:, 1:k] / n - mean**2, 0))
        wide = sd > 1e-6
        scale = np.zeros((len(flat), 1, 1, k, k))
        scale[..., 0, 0] = 1.0
        one = np.where(wide, 1 / np.where(wide, sd, 1), 0.0)
        scale[:, 0, 0, np.arange(1, k), np.arange(1, k)] = one
        scale[:, 0, 0, 1:, 0] = -mean * one
        self.a = scale @ m[..., :k, :k] @ scale.swapaxes(-1, -2)
        self.b = scale @ m[..., :k, k:]
        self.c = np.einsum("...ii->...i", m)[..., k:]


def readout(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(a + alpha * np.eye(a.shape[-1]), b)


def squares(w: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared error of readouts, and of predicting no change, from sums."""
    return np.einsum("...iq,...ij,...jq->...", w, a, w) - 2 * (w * b).sum((-1, -2)) + c.sum(-1), c.sum(-1)


def skill(error: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 less the share of the error of no change that is left; NaN without targets."""
    some = whole > 1e-12
    return np.where(some, 1 - error / np.where(some, whole, 1), np.nan)


def nulls(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x))


def forecast_skills(rows: DataFrame, horizons: list[int], alphas=ALPHAS, key: str = "person") -> DataFrame:
    """``key, alpha, val_skill, skill, skill_h, pooled_alpha, pooled_skill``: readouts of each person, and one of all people's training rows, on each person's test rows.

    ``rows``: ``key, part, x, y, m``. Inputs are scaled by the person's training rows. A
    penalty is the one with the least error on val rows, the person's or all people's.
    ``skill_h`` has a value for each horizon. What has no rows to come from is null.
    A batch of people is solved at once.
    """
    sums = masked_sums(rows, key).groupBy(key).agg(F.collect_list(F.struct("part", "h", "i", "j", "v")).alias("s"))
    sums = written(sums, "masked-sums")
    size = sums.limit(1).select(F.array_max(F.transform("s", lambda s: F.when(s["i"] < s["j"], s["i"]))).alias("p"), F.array_max(F.transform("s", lambda s: s["j"])).alias("last")).first()
    p, q = (size["p"], size["last"] - size["p"]) if size else (0, 1)
    kind, n_h, k = rows.schema[key].dataType.simpleString(), len(horizons), 1 + p
    order = sorted(alphas)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Sums]]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                yield some.column(0), Sums(some.column(1), p, q, n_h)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, s in parts_of(batches):
            total = total + np.concatenate([x[:, :2].sum(0).ravel() for x in (s.a, s.b, s.c)])
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    flat = np.array([r["v"] for r in sums.mapInArrow(pool, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
    alpha, one = None, None
    if len(flat):
        shapes = [(2, n_h, k, k), (2, n_h, k, q), (2, n_h, q)]
        a, b, c = (x.reshape(shape) for x, shape in zip(np.split(flat, np.cumsum([math.prod(shape) for shape in shapes])[:-1]), shapes))
        if c[1].sum() > 0:
            tried = {al: readout(a[0], b[0], al) for al in order}
            alpha = min(order, key=lambda al: squares(tried[al], a[1], b[1], c[1])[0].sum())
            one = tried[alpha]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, s in parts_of(batches):
            n = len(names)
            least, best, own = np.full(n, np.inf), np.full(n, np.nan), np.zeros((n, n_h, k, q))
            for al in order:
                w = readout(s.a[:, 0], s.b[:, 0], al)
                error = squares(w, s.a[:, 1], s.b[:, 1], s.c[:, 1])[0].sum(1)
                better = error < least
                least[better], best[better], own[better] = error[better], al, w[better]
            some = (s.a[:, 0, :, 0, 0].sum(1) > 0) & (s.c[:, 1].sum((1, 2)) > 0)
            best[~some] = np.nan
            val, tst = (squares(own, s.a[:, part], s.b[:, part], s.c[:, part]) for part in (1, 2))
            by_h = np.where(some[:, None], skill(*tst), np.nan)
            columns = [np.where(some, skill(e.sum(1), c.sum(1)), np.nan) for e, c in (val, tst)]
            pooled = np.full(n, np.nan) if one is None else skill(*(x.sum(1) for x in squares(np.broadcast_to(one, own.shape), s.a[:, 2], s.b[:, 2], s.c[:, 2])))
            lists = pa.array([[None if np.isnan(v) else v for v in r] if ok else None for r, ok in zip(by_h.tolist(), some)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([names, nulls(best), *map(nulls, columns), lists, nulls(pooled)], [key, "alpha", "val_skill", "skill", "skill_h", "pooled_skill"])

    out = sums.mapInArrow(told, f"{key} {kind}, alpha double, val_skill double, skill double, skill_h array<double>, pooled_skill double")
    return out.select(key, "alpha", "val_skill", "skill", "skill_h", F.lit(alpha).cast("double").alias("pooled_alpha"), "pooled_skill")
