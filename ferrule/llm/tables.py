"""Numbers of tables of restaurant cells, drawn from their exact conditional law.

A cell is a dish w of a context g with c customers.  Given the other cells, it has t tables with
probability in proportion to

    S(c, t) * prod_{j=1}^{t-1} (theta + d (T + j)) (o + j - d1) / (theta1 + R + j)

where T are the context's other tables, o the parent's other customers of the word and R all its
other customers; S are the generalised Stirling numbers: the weights of all seatings of c customers
at t tables together.  Cells of up to ``EXACT`` customers weigh every t.  For larger ones S is
a coefficient of a power series (``log_stirling``), and the grid of t narrows around the mode until it
is dense or resolves the law.  One uniform number a cell decides, so a draw
depends on nothing but the cell, its totals and that number.
"""

from __future__ import annotations

from functools import lru_cache
from math import lgamma, pi, sin

import numpy as np

EXACT = 1024
CHUNK = 1 << 20   # weights held at a time
GRID = 65
TERMS = 160        # powers of (1 - z)^d


@lru_cache(maxsize=2)
def stirling(d: float) -> np.ndarray:
    """log S(c, t) for 1 <= t <= c <= EXACT, row by row."""
    out = np.full(EXACT * (EXACT + 1) // 2, -np.inf)
    row = np.zeros(1)
    out[0] = 0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        new = np.full(c + 1, -np.inf)
        new[:-1] = row + np.log(c - d * t)
        new[1:] = np.logaddexp(new[1:], row)
        out[c * (c + 1) // 2:][:c + 1] = row = new
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: shifted by eight, then Stirling's series."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) - shift


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) - log c!, where S(c, t) / c! is the coefficient of z^c in ((1 - (1 - z)^d) / d)^t / t!:
    its powers of (1 - z)^d one by one up to t = 2 c^d, the saddle point beyond."""
    out = _by_powers(c, t, d)
    far = t > 2 * c.astype(float) ** d
    out[far] = _by_saddle(c[far], t[far], d)
    return out - t * np.log(d) - _log_gamma(t + 1.0)


def _by_powers(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    c, t = c.astype(float), np.minimum(t, 2 * c.astype(float) ** d)
    total, choose = np.zeros(t.shape), np.zeros(t.shape)
    whole = _log_gamma(c[:, :1] + 1)
    for j in range(1, TERMS):
        choose = choose + np.log(np.maximum(t - j + 1, 1e-300) / j)
        x = d * j
        size = choose + lgamma(1 + x) + _log_gamma(c[:, :1] - x) - whole
        size = np.exp(size)
        total += (-1) ** (j + 1) * sin(pi * x) / pi * size
        if j % 8 == 0 and (size < 1e-17 * np.abs(total)).all():
            break
    return np.log(np.maximum(total, 1e-300))


def _by_saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    c, t = c.astype(float), np.minimum(t, c - 0.5).astype(float)
    # z d (1 - z)^(d - 1) / (1 - (1 - z)^d) = c / t grows with z = 1 - e^-y; solved for log y
    lo, hi = np.full(c.shape, -40.0), np.full(c.shape, 5.0)
    for _ in range(45):
        mid = (lo + hi) / 2
        y = np.exp(mid)
        low = np.log(-np.expm1(-y)) + np.log(d) + (1 - d) * y - np.log(-np.expm1(-d * y)) < np.log(c / t)
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    y = np.exp((lo + hi) / 2)
    z, phi = -np.expm1(-y), -np.expm1(-d * y)
    a = z * d * np.exp((1 - d) * y) / phi                    # z phi' / phi
    spread = t * (a + a * z * (1 - d) * np.exp(y) - a * a)   # second derivative in log z
    return t * np.log(phi) - c * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-300))


def draw_tables(c, others, sent, root, u, d: float, strength: float, d1: float, root_strength: float) -> np.ndarray:
    """Tables of cells of ``c`` >= 1 customers.  ``others``: T; ``sent``: o; ``root``: R; ``u``: uniform numbers."""
    c = np.asarray(c, np.int64)
    others, sent, root = (np.broadcast_to(np.asarray(x, float), c.shape) for x in (others, sent, root))
    out = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    small = order[(c[order] > 1) & (c[order] <= EXACT)]
    ends = np.cumsum(c[small])
    table = stirling(d)
    a = 0
    while a < len(small):
        z = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")), a + 1)
        at = small[a:z]
        n = c[at]
        first = np.cumsum(n) - n
        j = np.arange(n.sum()) - np.repeat(first, n)         # t - 1
        cell = np.repeat(at, n)
        step = np.log((strength + d * (others[cell] + j)) * np.maximum(sent[cell] + j - d1, 1e-12) / (root_strength + root[cell] + j))
        step[first] = 0
        sums = np.cumsum(step)
        weight = table[np.repeat(n * (n - 1) // 2, n) + j] + sums - np.repeat(sums[first], n)
        weight = np.exp(weight - np.repeat(np.maximum.reduceat(weight, first), n))
        total = np.add.reduceat(weight, first)
        share = weight / np.repeat(total, n)
        sums = np.cumsum(share)
        before = sums[first] - share[first]
        out[at] = np.clip(np.searchsorted(sums, before + u[at], "right") - first + 1, 1, n)
        a = z
    large = order[c[order] > EXACT]
    for a in range(0, len(large), CHUNK // 64 // GRID):
        at = large[a:a + CHUNK // 64 // GRID]
        out[at] = _draw_large(c[at], others[at], sent[at], root[at], u[at], d, strength, d1, root_strength)
    return out


def _draw_large(c, others, sent, root, u, d, strength, d1, root_strength) -> np.ndarray:
    lo, hi = np.ones(len(c)), c.astype(float)
    rows = np.arange(len(c))

    def weights(t):
        n, T, o, R = (np.broadcast_to(x[:, None], t.shape) for x in (c, others, sent, root))
        return (log_stirling(n, t, d) + (t - 1) * np.log(d) + _log_gamma(strength / d + T + t) + _log_gamma(np.maximum(o - d1, 1e-12 - 1) + t)
                - _log_gamma(root_strength + R + t))

    first = True
    for _ in range(40):
        # narrows around the mode as long as the law is finer than the grid
        if (hi - lo).max() < GRID:
            t = np.minimum(lo[:, None] + np.arange(GRID), hi[:, None])
        elif first:
            t = np.round(np.exp(np.arange(GRID) / (GRID - 1) * np.log(hi)[:, None]))  # from 1, in equal ratios
        else:
            t = np.round(np.arange(GRID) / (GRID - 1) * (hi - lo)[:, None] + lo[:, None])
        w = weights(t)
        near = w > w.max(1, keepdims=True) - 40
        left = np.maximum(near.argmax(1) - 1, 0)
        right = np.minimum(GRID - near[:, ::-1].argmax(1), GRID - 1)
        new_lo, new_hi = t[rows, left], t[rows, right]
        done = ((right - left >= GRID // 3) & (not first)) | (hi - lo < GRID)
        if done.all():
            break
        first = False
        lo, hi = np.where(done, lo, new_lo), np.where(done, hi, new_hi)
    # weights stand for the stretch of t nearest to them; repeated t weigh nothing
    width = np.diff(t, axis=1, append=t[:, -1:])
    last = np.diff(t, axis=1, prepend=t[:, :1])
    width = np.where(width > 0, width, np.where(last > 0, last, 0))
    w = np.exp(w - w.max(1, keepdims=True)) * width
    sums = np.cumsum(w, axis=1)
    x = u * sums[:, -1]
    k = np.minimum((sums <= x[:, None]).sum(1), GRID - 1)
    inside = (x - (sums[rows, k] - w[rows, k])) / np.maximum(w[rows, k], 1e-300)
    return np.clip(np.floor(t[rows, k] + (np.clip(inside, 0, 1 - 1e-9) - 0.5) * np.maximum(width[rows, k], 1) + 0.5), 1, c).astype(np.int64)
