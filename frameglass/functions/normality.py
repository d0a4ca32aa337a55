"""Shapiro-Wilk W and p-value after Royston (1995), algorithm AS R94."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()

# Polynomial coefficients published with the algorithm, lowest power first.
_TAIL_1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_TAIL_2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SMALL_LOGSD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_LOGSD = (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def _weights(n: int) -> np.ndarray:
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    scores = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total = float(scores @ scores)
    u = 1.0 / math.sqrt(n)
    last = scores[-1] / math.sqrt(total) + _poly(_TAIL_1, u)
    weights = np.empty(n)
    if n > 5:
        second = scores[-2] / math.sqrt(total) + _poly(_TAIL_2, u)
        phi = (total - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        weights[2:-2] = scores[2:-2] / math.sqrt(phi)
        weights[1], weights[-2] = -second, second
    else:
        phi = (total - 2 * scores[-1] ** 2) / (1 - 2 * last**2)
        weights[1:-1] = scores[1:-1] / math.sqrt(phi)
    weights[0], weights[-1] = -last, last
    return weights


def shapiro_wilk(values: np.ndarray) -> tuple[float | None, float | None]:
    """(W, p) of a sample; (None, None) below three values, (1, 1) for a constant."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3:
        return None, None
    centred = x - x.mean()
    spread = float(centred @ centred)
    if x[0] == x[-1] or spread == 0.0:
        return 1.0, 1.0
    w = min(float(_weights(n) @ x) ** 2 / spread, 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(max(p, 0.0), 1.0)
    if w >= 1.0:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = _poly(_GAMMA, n)
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mean, sd = _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_LOGSD, n))
    else:
        log_n = math.log(n)
        mean, sd = _poly(_LARGE_MEAN, log_n), math.exp(_poly(_LARGE_LOGSD, log_n))
    # The upper tail by erfc keeps its digits where 1 - cdf would round to 0.
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))
