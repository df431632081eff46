"""Keys on shifted Hilbert curves through projected vectors."""

from __future__ import annotations

import numpy as np


def curve_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with ``bits`` bits an axis, as 64-bit integers.

    Works from the high bit down: at each level the axes are reflected and
    exchanged into the orientation of the cell, then the bits are Gray-decoded
    and interleaved.
    """
    axes = points.astype(np.int64).T.copy()
    count = len(axes)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(count):
            inside = (axes[i] & bit) != 0
            swap = np.where(inside, 0, (axes[0] ^ axes[i]) & below)
            axes[0] ^= np.where(inside, below, swap)
            axes[i] ^= swap
    for i in range(1, count):
        axes[i] ^= axes[i - 1]
    carry = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    axes ^= carry
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for i in range(count):
            key = (key << 1) | ((axes[i] >> level) & 1)
    return key


class Curves:
    """Several orderings, each with its own projection and shift.

    A random rotation is cut into groups of axes, one group a curve, so that
    the curves of one rotation see different parts of a vector and all of it
    together; then comes the next rotation.
    """

    def __init__(self, sample: np.ndarray, curves: int, axes: int, bits: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        axes = min(axes, width)
        self.bits, self.projections, self.centres, self.scales, self.shifts = bits, [], [], [], []
        for number in range(curves):
            group = number % (width // axes)
            if group == 0:
                rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
            basis = rotation[:, group * axes : (group + 1) * axes]
            on = sample @ basis
            self.projections.append(basis)
            self.centres.append(on.mean(0))
            self.scales.append(np.maximum(on.std(0), 1e-12))
            self.shifts.append(rng.random(axes))

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        """One array of keys per curve.  Logistic scaling spreads the points over the cube's half, the shift places it."""
        out = []
        for basis, centre, scale, shift in zip(self.projections, self.centres, self.scales, self.shifts, strict=True):
            unit = 1 / (1 + np.exp(-1.702 * np.clip((vectors @ basis - centre) / scale, -12, 12)))
            cells = np.minimum(((unit + shift) / 2 * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)
            out.append(curve_keys(cells, self.bits))
        return out
