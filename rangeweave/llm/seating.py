"""Chinese restaurants by their table counts: the conditional that a Gibbs step draws from.

A dish with ``c`` customers in a restaurant of discount ``d`` and strength ``s``, where other dishes hold
``others`` tables and the parent serves the dish with probability ``p``, has t tables with probability in
proportion to S(c, t) * product over i < t of (s + d * (others + i)) * p. S are the generalised Stirling
numbers: the sum, over all ways to seat the c customers at t tables, of the seats' weights. So one
draw of t is one draw of the seats of all the customers of the dish, given all others, without naming seats.

S is exact by its recursion up to ``EXACT`` customers. Above, S(c, t) * gamma(t) * d ** t depends on t / c ** d
alone while t is far below c, so it is read from the exact numbers at ``EXACT``; for more tables, a saddle
point takes over, which is accurate there.
"""

from __future__ import annotations

import functools

import numpy as np

EXACT = 512
JOIN = EXACT // 4
GRID = 49
_TINY = 1e-300


@functools.lru_cache(8)
def log_ratios(d: float) -> np.ndarray:
    """[c, t] holds log(S(c, t + 1) / S(c, t)) for c up to EXACT, -inf from t = c on."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    row = np.full(EXACT + 2, -np.inf)
    row[1] = 0.0
    t = np.arange(EXACT + 2, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, EXACT + 1):
            out[c, 1:c] = row[2 : c + 1] - row[1:c]
            stay = row + np.log(np.maximum(c - t * d, _TINY))
            row[1:] = np.logaddexp(row[:-1], stay[1:])
    return out


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) up to a term of c, by the saddle point of the generating function."""
    c, t = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float))
    edge = t >= c - 0.5
    low, high = np.full(c.shape, -600.0), np.full(c.shape, -1e-12)  # of log(1 - z)
    for _ in range(38):
        y = (low + high) / 2
        z = -np.expm1(y)
        big = t * d * z * np.exp(y * (d - 1)) / -np.expm1(d * y) > c
        low, high = np.where(big, y, low), np.where(big, high, y)
    y = (low + high) / 2
    z, x = -np.expm1(y), np.exp(y)
    g = -np.expm1(d * y)
    h = t * d * z * x ** (d - 1) / g
    slope = np.maximum(h * (1 + z * (1 - d) / x - h / t), _TINY)
    out = t * np.log(g / d) - c * np.log1p(-x) - 0.5 * np.log(2 * np.pi * slope) - _lgamma(t + 1)
    # all customers alone: S(c, c) = 1, told by the same scale of log(c!)
    return np.where(edge, -_lgamma(c + 1), out)


@functools.lru_cache(8)
def _scaled(d: float) -> np.ndarray:
    """log(S(EXACT, t) * gamma(t) * d ** t) up to a constant, for t up to JOIN."""
    t = np.arange(1, JOIN + 1)
    out = np.concatenate(([0.0], np.cumsum(log_ratios(d)[EXACT, 1:JOIN]))) + _lgamma(t) + t * np.log(d)
    return np.concatenate(([2 * out[0] - out[1]], out))


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) up to a term of c, for more than EXACT customers."""
    c, t = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float))
    scale = (EXACT / c) ** d
    known = _scaled(d)

    def near(t):
        return np.interp(t * scale, np.arange(JOIN + 1), known) - _lgamma(t) - t * np.log(d)

    border = JOIN / scale
    out = near(np.minimum(t, border))
    far = t > border
    if far.any():
        out[far] = (_saddle(c[far], t[far], d) - _saddle(c[far], border[far], d)) + near(border)[far]
    return out


def _lgamma(x):
    x = np.array(x, float)
    shift = np.zeros_like(x)
    while (small := x < 8).any():
        shift[small] += np.log(np.maximum(x[small], _TINY))
        x[small] += 1
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) - shift


def _rising(a, t):
    """log of the product over i < t of (a + i)."""
    return _lgamma(a + t) - _lgamma(a)


def _few(c, others, s, d, p, u):
    """Dishes of up to EXACT customers, all t from 1 on, sorted by c from the largest."""
    ratios = log_ratios(d)
    order = np.argsort(-c, kind="stable")
    c, others, p, u = c[order], others[order], p[order], u[order]
    with np.errstate(divide="ignore"):
        logp = np.log(p)

    def walk(stop):
        """Calls ``stop(rows, t, log weight)`` for growing t; it tells which of the rows go on."""
        rows, now = np.arange(len(c)), np.zeros(len(c))
        t = 1
        while len(rows):
            go = stop(rows, t, now)
            go &= c[rows] > t
            rows, now = rows[go], now[go]
            now = now + ratios[c[rows], t] + np.log(s + d * (others[rows] + t)) + logp[rows]
            t += 1

    top, total = np.full(len(c), -np.inf), np.zeros(len(c))

    def add(rows, t, now):
        m = np.maximum(top[rows], now)
        total[rows] = total[rows] * np.exp(top[rows] - m) + np.exp(now - m)
        top[rows] = m
        return now > m - 40  # log weights have one peak: what is far below it after it adds nothing

    walk(add)
    found, seen = np.ones(len(c), np.int64), np.zeros(len(c))

    def take(rows, t, now):
        seen[rows] += np.exp(now - top[rows]) / total[rows]
        found[rows] = t
        return (seen[rows] < u[rows]) & (now > -np.inf) & ((now > top[rows] - 40) | (seen[rows] < 0.5))

    walk(take)
    out = np.empty(len(c), np.int64)
    out[order] = found
    return out


def _many(c, others, s, d, p, u):
    """Dishes of more customers: the peak by bisection, then a grid around it."""

    def weight(t, at=slice(None)):
        c_, o, p_ = c[at], others[at], p[at]
        if t.ndim > 1:
            c_, o, p_ = c_[:, None], o[:, None], p_[:, None]
        return log_stirling(c_, t, d) + t * np.log(d * np.maximum(p_, _TINY)) + _rising(s / d + o, t)

    low, high = np.ones(len(c)), c.astype(float)
    for _ in range(int(np.ceil(np.log2(max(2, c.max())))) + 1):
        mid = np.floor((low + high) / 2)
        up = weight(np.minimum(mid + 1, c)) > weight(mid)
        low, high = np.where(up & (mid < high), np.minimum(mid + 1, high), low), np.where(up, high, mid)
    peak = low
    best = weight(peak)
    reach = np.ones(len(c))
    for _ in range(48):  # how far the weights stay within e^-20 of the best
        above = np.where(peak + reach < c, weight(np.minimum(peak + reach, c)), -np.inf)
        far = np.maximum(above, np.where(peak - reach > 1, weight(np.maximum(peak - reach, 1)), -np.inf))
        grow = (far > best - 20) & (reach < c)
        if not grow.any():
            break
        reach = np.where(grow, reach * 2, reach)
    low, high = np.maximum(1, peak - reach), np.minimum(c, peak + reach)
    step = np.maximum(1, np.ceil((high - low) / (GRID - 1)))
    grid = low[:, None] + step[:, None] * np.arange(GRID)
    inside = grid <= high[:, None]
    w = weight(np.minimum(grid + (step[:, None] - 1) / 2, c[:, None]))
    w = np.where(inside, np.exp(w - np.where(inside, w, -np.inf).max(axis=1, keepdims=True)), 0)
    total = np.cumsum(w, axis=1)
    want = u * total[:, -1]
    at = np.minimum((total < want[:, None]).sum(axis=1), GRID - 1)
    rows = np.arange(len(c))
    rest = np.clip((total[rows, at] - want) / np.maximum(w[rows, at], _TINY), 1e-9, 1)
    return np.clip(grid[rows, at] + np.floor((1 - rest) * step), 1, c).astype(np.int64)


def draw(c, others, strength: float, discount: float, p, u) -> np.ndarray:
    """A number of tables for each dish, given uniform numbers ``u``; 0 for dishes without customers."""
    c = np.asarray(c, np.int64)
    t = np.minimum(c, 1)
    for rows, how in ((np.flatnonzero((c > 1) & (c <= EXACT)), _few), (np.flatnonzero(c > EXACT), _many)):
        for at in range(0, len(rows), 1 << 18 if how is _few else 1 << 12):
            some = rows[at : at + (1 << 18 if how is _few else 1 << 12)]
            t[some] = how(c[some], np.maximum(np.asarray(others)[some], 0).astype(float), strength, discount, np.asarray(p)[some], u[some])
    return t
