"""Tail probabilities of the F, t and Beta distributions on numpy arrays (no scipy here).

The regularised incomplete beta function uses its continued fraction (modified Lentz).
"""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _fraction(a, b, x, steps=300, tiny=1e-300, eps=1e-15):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps + 1):
        for num in (m * (b - m) * x / ((qam + 2 * m) * (a + 2 * m)), -(a + m) * (qab + m) * x / ((a + 2 * m) * (qap + 2 * m))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < eps):
            break
    return h


def beta_cdf(x, a, b):
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    swap = inner > (a + 1.0) / (a + b + 2.0)
    pa, pb, px = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - inner, inner)
    part = front * _fraction(pa, pb, px) / pa
    out = np.where(swap, 1.0 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def beta_quantile(q, a, b, steps=60):
    q, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (q, a, b)))
    low, high = np.zeros_like(q), np.ones_like(q)
    for _ in range(steps):
        mid = (low + high) / 2
        below = beta_cdf(mid, a, b) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def f_tail(f, d1, d2):
    """P(F > f)."""
    f = np.asarray(f, dtype=float)
    return np.where(f <= 0, 1.0, beta_cdf(d2 / (d2 + d1 * np.maximum(f, 0.0)), np.asarray(d2) / 2.0, np.asarray(d1) / 2.0))


def t_tail(t, df):
    """P(|T| > |t|)."""
    t = np.asarray(t, dtype=float)
    return beta_cdf(df / (df + t * t), np.asarray(df) / 2.0, 0.5)


def normal_tail(z):
    """P(|Z| > |z|)."""
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), otypes=[float])(np.asarray(z, dtype=float))


def t_quantile(p, df):
    """Two-sided critical value: P(|T| > c) = p."""
    x = beta_quantile(p, np.asarray(df, dtype=float) / 2.0, 0.5)
    return np.sqrt(df * (1.0 - x) / np.maximum(x, 1e-300))
