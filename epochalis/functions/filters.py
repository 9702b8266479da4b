"""Digital filters as numpy kernels: design of recursive filters, their state as a linear map, windowed-sinc banks."""

from __future__ import annotations

from fractions import Fraction

import numpy as np


def band_pass(low: float, high: float, fs: float, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth band-pass ``b, a`` by the bilinear transform of the analogue prototype; ``2 * order`` poles."""
    edge = 4 * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre = edge[1] - edge[0], np.sqrt(edge[0] * edge[1])
    proto = -np.exp(1j * np.pi * np.arange(1 - order, order, 2) / (2 * order)) * width / 2
    root = np.sqrt(proto**2 - centre**2 + 0j)
    poles = np.concatenate((proto + root, proto - root))
    gain = width**order * np.real(4.0**order / np.prod(4 - poles))
    digital = (4 + poles) / (4 - poles)
    return gain * np.real(np.poly([1.0] * order + [-1.0] * order)), np.real(np.poly(digital))


def notch(at: float, fs: float, quality: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch ``b, a`` whose 3 dB width is ``at / quality``."""
    w = 2 * np.pi * at / fs
    gain = 1 / (1 + np.tan(w / quality / 2))
    return gain * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * gain * np.cos(w), 2 * gain - 1])


class Recursive:
    """``y = b / a x`` in state-space form (transposed direct form), run on rows of equal length at once.

    A stretch of samples is an affine map of the state: ``z -> A**m z + v``. Inside a
    stretch, blocks of samples are one matrix product each, so that Python steps once
    a block and not once a sample.
    """

    def __init__(self, b, a, block: int = 64):
        b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
        n = max(len(a), len(b))
        b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
        self.n, self.pad, self.block = n - 1, 3 * n, block
        self.step = np.column_stack((-a[1:], np.eye(n - 1)[:, :-1])) if n > 1 else np.zeros((0, 0))
        self.feed, self.direct = b[1:] - a[1:] * b[0], b[0]
        self.rest = np.linalg.solve(np.eye(n - 1) - self.step, self.feed)
        powers = [np.eye(n - 1)]
        for _ in range(block):
            powers.append(self.step @ powers[-1])
        self.powers = np.array(powers)
        self.seen = self.powers[:block, 0, :]  # what a state adds to the block's outputs
        self.response = np.concatenate(([self.direct], self.seen[: block - 1] @ self.feed))
        k = np.subtract.outer(np.arange(block), np.arange(block))
        self.toeplitz = np.where(k >= 0, self.response[np.maximum(k, 0)], 0.0)
        self.fed = (self.powers[:block] @ self.feed)[::-1].T  # of the block's inputs to its last state

    def power(self, m: int) -> np.ndarray:
        return np.linalg.matrix_power(self.step, m)

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of rows ``x`` from states ``z``, and the states after them."""
        y = np.empty_like(x)
        for lo in range(0, x.shape[1], self.block):
            part = x[:, lo : lo + self.block]
            m = part.shape[1]
            y[:, lo : lo + m] = part @ self.toeplitz[:m, :m].T + z @ self.seen[:m].T
            z = z @ self.powers[m].T + part @ self.fed[:, self.block - m :].T
        return y, z


def ratio(target: float, source: float, limit: int = 1000) -> tuple[int, int]:
    """``up, down`` of the rational rate change."""
    change = Fraction(target / source).limit_denominator(limit)
    return change.numerator, change.denominator


def sinc_bank(up: int, down: int, zeros: int = 10, beta: float = 5.0) -> tuple[np.ndarray, int]:
    """Windowed-sinc kernel of a rate change by phases: ``bank[p, t]``, and the number of input samples before the centre.

    Output ``m`` stands at input ``m * down / up``; with phase ``p = m * down % up`` and
    ``j = m * down // up`` it is the sum over t of ``bank[p, t] * x[j - reach + t]``.
    """
    half = zeros * max(up, down)
    k = np.arange(-half, half + 1)
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * k) * np.kaiser(2 * half + 1, beta)
    h *= up / h.sum()
    reach = half // up + 1
    at = np.arange(up)[:, None] - (np.arange(2 * reach + 1)[None, :] - reach) * up
    return np.where(np.abs(at) <= half, h[np.clip(at + half, 0, 2 * half)], 0.0), reach
