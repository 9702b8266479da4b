"""Matching pursuit with Gaussian chirplets over Arrow batches of signals.

Rows are independent: a batch is scored against the dictionary by one matrix
product, its best atoms are refined together by damped least squares whose
gradients have a closed form, with steps that are kept where they raise a row's
energy, and the residual is what is orthogonal to all atoms so far. A row's result
doesn't depend on the rows beside it. An atom has one width, or its own on the right
of its centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: numbers in an array of signals that are worked on together, which fit into a processor's cache
BLOCK = 1 << 16


def _shape(p: np.ndarray, n: int, fs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times from the centres, those in widths of their side, and phases."""
    t = np.arange(n) / fs - p[..., 0:1]
    width = p[..., 2:3] if p.shape[-1] < 5 else np.where(t < 0, p[..., 2:3], p[..., 4:5])
    return t, t / np.maximum(width, 1e-4), 2 * np.pi * (p[..., 1:2] * t + 0.5 * p[..., 3:4] * t * t)


def chirplets(p: np.ndarray, n: int, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Windowed cosines and sines of atoms (centre s, Hz, width s, Hz/s, and the width on the right if it is another): arrays (..., n)."""
    _, u, phase = _shape(p, n, fs)
    env = np.exp(-0.5 * u**2)
    return env * np.cos(phase), env * np.sin(phase)


def orthonormal_parts(p: np.ndarray, n: int, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal pair that spans each atom's two parts; the second is zero where they are one direction."""
    return orthonormal(*chirplets(p, n, fs))


def orthonormal(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal pair that spans two rows; the second is zero where they are one direction."""
    first = first / np.maximum(np.linalg.norm(first, axis=-1, keepdims=True), 1e-15)
    whole = np.linalg.norm(second, axis=-1, keepdims=True)
    second = second - (first * second).sum(-1, keepdims=True) * first
    size = np.linalg.norm(second, axis=-1, keepdims=True)
    return first, np.where(size > 1e-3 * whole, second / np.maximum(size, 1e-15), 0.0)


def captured(x: np.ndarray, p: np.ndarray, fs: float) -> np.ndarray:
    """Energy of a row's projection on the plane of its atom."""
    return sum((x * part).sum(-1) ** 2 for part in orthonormal_parts(p, x.shape[-1], fs))


def dictionary(n: int, fs: float) -> np.ndarray:
    """Grid over width, chirp rate, centre and frequency. Centres and frequencies stand as far apart as the width resolves, so that every signal has an atom that overlaps with it."""
    span, out = n / fs, []
    for width in (0.05 * span, 0.15 * span, 0.4 * span):
        times = np.linspace(0.08, 0.92, max(3, int(np.ceil(0.84 * span / (1.2 * width))))) * span
        tones = np.linspace(0.01, 0.47, max(6, int(np.ceil(0.46 * fs * np.pi * width)))) * fs
        rates = np.array([-2.0, 0.0, 2.0]) / (2 * np.pi * width**2)
        out.append(np.stack(np.meshgrid(times, tones, [width], rates, indexing="ij"), -1).reshape(-1, 4))
    return np.concatenate(out)


class Tangents:
    """Energy of rows' projections on their atoms and, for some of the rows, its gradient and the curvature of least squares.

    Parameters are centre, frequency, log width, rate (and log width on the right).
    With w the projection and v the same atom a quarter of a turn on, each derivative
    of w is w or v times a polynomial of time; the gradient of the energy is twice the
    residual's product with it, since the residual is orthogonal to the atom's plane.
    """

    def __init__(self, x: np.ndarray, p: np.ndarray, n: int, fs: float):
        t, u, phase = _shape(p, n, fs)
        env = np.exp(-0.5 * u**2)
        c, s = env * np.cos(phase), env * np.sin(phase)
        parts = orthonormal(c, s)
        w = sum((x * part).sum(-1, keepdims=True) * part for part in parts)
        self.energy, self.held = (w * w).sum(-1), (x, p, t, u, c, s, *parts, w)

    def slopes(self, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        x, p, t, u, c, s, first, second, w = (a[rows] for a in self.held)
        # w in the atom's own parts, by their two by two normal equations
        cc, cs, ss, wc, ws = ((a * b).sum(-1, keepdims=True) for a, b in ((c, c), (c, s), (s, s), (w, c), (w, s)))
        det = cc * ss - cs * cs
        flat = det <= 1e-6 * cc * ss
        det = np.where(flat, 1.0, det)
        a, b = np.where(flat, wc / np.maximum(cc, 1e-300), (ss * wc - cs * ws) / det), np.where(flat, 0.0, (cc * ws - cs * wc) / det)
        v = b * c - a * s
        width = p[..., 2:3] if p.shape[-1] < 5 else np.where(t < 0, p[..., 2:3], p[..., 4:5])
        own = [w * u / width - 2 * np.pi * (p[..., 1:2] + p[..., 3:4] * t) * v, 2 * np.pi * t * v, w * u**2, np.pi * t * t * v]
        if p.shape[-1] > 4:
            own[2:3], last = [np.where(t < 0, w * u**2, 0.0)], np.where(t < 0, 0.0, w * u**2)
            own.append(last)
        jac = np.stack(own, 1)
        for part in (first, second):
            jac -= (jac * part[:, None]).sum(-1, keepdims=True) * part[:, None]
        return 2 * (jac * (x - w)[:, None]).sum(-1), jac @ jac.transpose(0, 2, 1)


def tangents(x: np.ndarray, p: np.ndarray, n: int, fs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Energy, gradient and curvature of all rows."""
    held = Tangents(x, p, n, fs)
    return held.energy, *held.slopes()


class Engine:
    def __init__(self, n: int, fs: float, order: int = 6, rounds: int = 24, min_amplitude: float = 0.0, asymmetric: bool = False):
        self.n, self.fs, self.order, self.rounds, self.min_amplitude = n, fs, order, rounds, min_amplitude
        self.grid = dictionary(n, fs)
        self.parts = orthonormal_parts(self.grid, n, fs)
        self.size = 5 if asymmetric else 4
        span = n / fs
        # a centre may lie outside by a quarter of the window; a width is half a sample to one and a half windows
        self.low, self.high = np.array([-0.25 * span, 0, 0.5 / fs, -fs * fs, 0.5 / fs])[: self.size], np.array([1.25 * span, 0.5 * fs, 1.5 * span, fs * fs, 1.5 * span])[: self.size]

    def best(self, r: np.ndarray) -> np.ndarray:
        energy = sum((r @ part.T) ** 2 for part in self.parts)
        found = self.grid[energy.argmax(1)]
        return np.column_stack((found, found[:, 2]))[:, : self.size]

    def refine(self, r: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Damped least squares: a row's damping falls with a step that raises its energy and rises with one that doesn't."""
        p, damping, going = p.copy(), np.full(len(p), 1e-2), np.arange(len(p))
        start = Tangents(r, p, self.n, self.fs)
        have, (slope, curve) = start.energy, start.slopes()
        for _ in range(self.rounds):
            if not len(going):
                break
            diagonal = np.einsum("bii->bi", curve[going])
            weight = damping[going, None] * (diagonal + 1e-12 * diagonal.max(1, keepdims=True) + 1e-300)
            step = np.linalg.solve(curve[going] + weight[:, :, None] * np.eye(self.size), 0.5 * slope[going][..., None])[..., 0]
            q = p[going] + step
            for axis in (2, 4)[: self.size - 3]:
                q[:, axis] = p[going, axis] * np.exp(np.clip(step[:, axis], -1.0, 1.0))
            q = np.clip(q, self.low, self.high)
            tried = Tangents(r[going], q, self.n, self.fs)
            energy = tried.energy
            better = energy > have[going]
            gain = energy - have[going]
            at = going[better]
            p[at], have[at] = q[better], energy[better]
            slope[at], curve[at] = tried.slopes(better)
            damping[going] *= np.where(better, 0.2, 5.0)
            going = going[np.where(better, gain > 1e-12 * energy, damping[going] < 1e6)]
        return p

    def decompose(self, x: np.ndarray):
        """Atoms (rows, order, 4 or 5), their waveforms (rows, order, n), kept flags and the residual.

        Each atom's plane is made orthogonal to the planes before it, and the
        residual loses its projection; amplitudes in the atoms' own parts come
        from one pseudo-inverse a row at the end.
        """
        rows = len(x)
        params = np.zeros((rows, self.order, self.size))
        kept = np.zeros((rows, self.order), bool)
        own = np.zeros((rows, 2 * self.order, self.n))
        span = np.zeros((rows, 2 * self.order, self.n))
        rest = x.copy()
        for k in range(self.order):
            p = self.refine(rest, self.best(rest))
            energy = captured(rest, p, self.fs)
            going = (energy > 1e-12) & (energy >= self.min_amplitude**2) & (kept[:, k - 1] if k else True)
            if not going.any():
                break
            params[going, k], kept[going, k] = p[going], True
            for axis, part in enumerate(chirplets(p, self.n, self.fs)):
                own[going, 2 * k + axis] = part[going]
                direction = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-15)
                for _ in range(2):  # once more, against rounding
                    direction = direction - np.einsum("bkn,bk->bn", span, np.einsum("bkn,bn->bk", span, direction))
                size = np.linalg.norm(direction, axis=1)
                use = going & (size > 1e-6)
                span[use, 2 * k + axis] = direction[use] / size[use, None]
            rest = x - np.einsum("bkn,bk->bn", span, np.einsum("bkn,bn->bk", span, x))
        amplitude = np.einsum("bnk,bn->bk", np.linalg.pinv(own, rcond=1e-6), x)
        waves = (amplitude[..., None] * own).reshape(rows, self.order, 2, self.n).sum(2)
        return params, waves, kept, rest


def atoms_of(signals: DataFrame, n: int, fs: float, order: int = 6, with_waves: bool = False, keys: tuple[str, ...] = ("epoch_id", "ch_idx"), asymmetric: bool = False) -> DataFrame:
    """``keys, atom_idx, t_s, f_hz, dur_s, rate_hz_s, energy, recon_err`` (and ``wave``, and ``right_s``, the width right of the centre) of signals ``keys, w``.

    Signals that are null or not ``n`` long have no atoms; energy is the
    waveform's. ``recon_err`` is the residual's share of the signal's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine(n, fs, order, asymmetric=asymmetric)
        for batch in batches:
            whole = np.flatnonzero((batch.column(len(keys)).is_valid().to_numpy(zero_copy_only=False)) & (batch.column(len(keys)).value_lengths().fill_null(0).to_numpy() == n))
            for lo in range(0, len(whole), rows):
                at = whole[lo : lo + rows]
                part = batch.take(pa.array(at))
                x = part.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                p, waves, kept, rest = engine.decompose(x)
                error = np.sqrt((rest**2).sum(1)) / np.maximum(np.sqrt((x**2).sum(1)), 1e-12)
                row, k = np.nonzero(kept)
                values = [*(p[row, k, j] for j in range(4)), (waves[row, k] ** 2).sum(1), error[row]]
                columns = [part.column(i).take(pa.array(row)) for i in range(len(keys))] + [pa.array(k.astype(np.int32))] + [pa.array(v) for v in values]
                if with_waves:
                    flat = waves[row, k]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, n, dtype=np.int32)), pa.array(flat.ravel())))
                if asymmetric:
                    columns.append(pa.array(p[row, k, 4]))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = min(max(BLOCK // n, 16), 2048)
    names = [*keys, "atom_idx", "t_s", "f_hz", "dur_s", "rate_hz_s", "energy", "recon_err"] + ["wave"] * with_waves + ["right_s"] * asymmetric
    kinds = ", ".join(f"{k} {signals.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, atom_idx int, t_s double, f_hz double, dur_s double, rate_hz_s double, energy double, recon_err double" + ", wave array<double>" * with_waves + ", right_s double" * asymmetric
    return signals.select(*keys, "w").mapInArrow(run, schema)
