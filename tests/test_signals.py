"""Filters and rate changes against plain loops, cut into one chunk and into many."""

import numpy as np
import pytest

from epochalis.functions import filters
from epochalis.operators import signals

FS = 256.0


def lfilter(b, a, x, z):
    """One sample after the other, transposed direct form."""
    b, a, z = np.array(b) / a[0], np.array(a) / a[0], np.append(z, 0.0)
    y = np.empty(len(x))
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:] * v - a[1:] * y[i]
    return y


def filtfilt(b, a, x):
    """Forward and backward with ends turned about the end samples and steady first states."""
    pad, n = 3 * max(len(a), len(b)), len(b) - 1
    ext = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    companion = np.column_stack((-np.array(a[1:]) / a[0], np.eye(n)[:, :-1]))
    rest = np.linalg.solve(np.eye(n) - companion, (b[1:] - a[1:] * b[0] / a[0]) / a[0])
    y = lfilter(b, a, ext, rest * ext[0])
    return lfilter(b, a, y[::-1], rest * y[-1])[::-1][pad:-pad]


def gain(b, a, f):
    z = np.exp(-2j * np.pi * np.asarray(f) / FS)
    return np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


def test_designs_have_their_gains():
    b, a = filters.band_pass(1.0, 40.0, FS)
    assert len(b) == len(a) == 5 and np.all(np.abs(np.roots(a)) < 1)
    assert np.allclose(gain(b, a, [1.0, 40.0]), np.sqrt(0.5), atol=1e-9)
    assert gain(b, a, [0.0, 128.0]).max() < 1e-6 and gain(b, a, 7.0) > 0.99
    # an analogue Butterworth band-pass at the warped frequencies
    f = np.array([0.3, 2.0, 20.0, 90.0])
    warp = lambda x: np.tan(np.pi * np.asarray(x) / FS)
    s = (warp(f) ** 2 - warp(1.0) * warp(40.0)) / (warp(f) * (warp(40.0) - warp(1.0)))
    assert np.allclose(gain(b, a, f), 1 / np.sqrt(1 + s**4), atol=1e-9)
    b, a = filters.notch(50.0, FS)
    assert gain(b, a, 50.0) < 1e-9 and np.allclose(gain(b, a, [0.0, 128.0]), 1)
    low, high = (np.sqrt(1 + 1 / 3600) - 1 / 60) * 50, (np.sqrt(1 + 1 / 3600) + 1 / 60) * 50
    assert np.allclose(gain(b, a, [low, high]), np.sqrt(0.5), atol=2e-2)


def recordings(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    made = {f"r{i}": np.cumsum(rng.normal(size=n)) + 5 for i, n in enumerate(lengths)}
    frame = spark.createDataFrame([(r, i, float(v)) for r, x in made.items() for i, v in enumerate(x)], "rec_id string, sample_idx bigint, value double")
    return made, frame


def arrays(frame, value):
    out: dict = {}
    for r in frame.orderBy("rec_id", "sample_idx").collect():
        out.setdefault(r["rec_id"], []).append((r["sample_idx"], r[value]))
    assert all([i for i, _ in x] == list(range(len(x))) for x in out.values())
    return {k: np.array([v for _, v in x], float) for k, x in out.items()}


@pytest.mark.parametrize("size, fan", [(4096, 256), (40, 4), (40, 256)])
def test_zero_phase_equals_a_loop(spark, size, fan):
    """2,000 samples are one chunk or fifty, and fifty are one group of the scan or a tree of three levels."""
    made, frame = recordings(spark, [2000, 333, 41, 80])
    for b, a in (filters.band_pass(1.0, 40.0, FS), filters.notch(50.0, FS)):
        got = arrays(signals.zero_phase(frame, b, a, size=size, fan=fan), "filtered")
        for r, x in made.items():
            assert np.allclose(got[r], filtfilt(b, a, x), rtol=1e-7, atol=1e-7)


def test_zero_phase_of_odd_recordings(spark):
    rows = [("short", i, 1.0) for i in range(15)] + [("holes", i, None if i == 7 else 1.0) for i in range(60)] + [("nan", i, float("nan") if i == 7 else 1.0) for i in range(60)] + [("flat", i, 2.0) for i in range(60)]
    frame = spark.createDataFrame(rows, "rec_id string, sample_idx bigint, value double")
    b, a = filters.band_pass(1.0, 40.0, FS)
    got = arrays(signals.zero_phase(frame, b, a, size=20), "filtered")
    assert len(got) == 4 and all(np.isnan(got[r]).all() for r in ("short", "holes", "nan")) and np.abs(got["flat"]).max() < 1e-9
    assert signals.zero_phase(frame.limit(0), b, a, size=20).count() == 0
    with pytest.raises(ValueError):
        signals.zero_phase(frame, b, a, size=15)


def resample(x, up, down):
    """Zero stuffing, a whole convolution with the kernel, every down-th sample."""
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1) / max(up, down)
    h = np.sinc(t) * np.i0(5.0 * np.sqrt(np.maximum(0, 1 - (np.arange(-half, half + 1) / half) ** 2))) / np.i0(5.0)
    h = h / h.sum() * up
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, h)[half:][: len(wide)][::down]


@pytest.mark.parametrize("up, down", [(64, 125), (1, 2), (3, 1), (2, 3), (1, 1)])
def test_resampling_equals_a_convolution(spark, up, down):
    assert filters.ratio(256, 500) == (64, 125)
    made, frame = recordings(spark, [1000, 97, 1, 130], seed=3)
    for size in (64, 4096):
        got = arrays(signals.resampled(frame, up, down, size=size), "value")
        for r, x in made.items():
            want = resample(x, up, down)
            assert len(got[r]) == -(-len(x) * up // down) == len(want)
            assert np.allclose(got[r], want, atol=1e-9)


def test_a_slow_wave_survives_a_rate_change(spark):
    t = np.arange(3000) / 500
    frame = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(np.sin(2 * np.pi * 7 * t))], "rec_id string, sample_idx bigint, value double")
    got = arrays(signals.resampled(frame, 64, 125, size=200), "value")["a"]
    at = np.arange(len(got)) / 256
    assert np.abs(got - np.sin(2 * np.pi * 7 * at))[60:-60].max() < 2e-3


def test_projections_are_the_same_however_they_are_cut(spark):
    made, frame = recordings(spark, [3000, 700], seed=6)
    frame = frame.unionByName(spark.createDataFrame([("bad", i, None if i == 3 else 1.0) for i in range(600)], "rec_id string, sample_idx bigint, value double"))
    matrix = signals.projection_rows(7, np.arange(600), 256)
    assert abs(matrix.mean()) < 0.01 and abs(matrix.std() - 1) < 0.01 and np.abs(np.corrcoef(matrix.T) - np.eye(256)).max() < 0.25
    assert np.array_equal(matrix[100:200], signals.projection_rows(7, np.arange(100, 200), 256)) and not np.allclose(matrix, signals.projection_rows(8, np.arange(600), 256))
    runs = [{(r["rec_id"], r["window"]): np.array(r["x"]) for r in signals.projected(frame.repartition(parts), 600, 256, 7, block=block).collect()} for parts, block in ((1, 1024), (7, 100), (3, 64))]
    assert runs[0].keys() == {*(("r0", k) for k in range(5)), ("r1", 0)}
    for k, x in runs[0].items():
        want = made[k[0]][k[1] * 600 : k[1] * 600 + 600] @ matrix / np.sqrt(600)
        assert all(np.allclose(run[k], want, atol=1e-9) for run in runs) and len(x) == 256
    keys = sorted(runs[0])
    for a in keys:
        for b in keys:
            if a < b:
                true = np.linalg.norm(made[a[0]][a[1] * 600 : a[1] * 600 + 600] - made[b[0]][b[1] * 600 : b[1] * 600 + 600])
                assert abs(np.linalg.norm(runs[0][a] - runs[0][b]) * np.sqrt(600 / 256) / true - 1) < 4 / np.sqrt(256)
