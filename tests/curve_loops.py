"""Plain numpy versions of the array expressions, for tests: filters that replicate the edges, peaks, noise."""

from __future__ import annotations

import numpy as np


def median_step(x: np.ndarray) -> float:
    d = np.diff(x)
    d = d[d > 0]
    return float(np.median(d)) if len(d) else 0.03


def noise_of(y: np.ndarray) -> float:
    """1.4826 MAD of first differences over the root of two, of the values where that is 0; 1 at least."""
    if len(y) < 3:
        return 1.0
    mad = lambda v: float(np.median(np.abs(v - np.median(v))))
    d = mad(np.diff(y))
    return max(1.4826 * d / np.sqrt(2.0), 1.0) if d > 0 else max(1.4826 * mad(y), 1.0)


def odd_points(width: float, step: float, least: int, most: int) -> int:
    """An odd number of points for a width in degrees, between two bounds (made odd upwards)."""
    n = min(max(int(round(width / max(step, 1e-6))), least), max(most, least))
    return n + 1 - n % 2


def _frames(y: np.ndarray, size: int) -> np.ndarray:
    left = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(y, (left, size - 1 - left), mode="edge"), size)


def rank_filter(y: np.ndarray, percent: float, size: int) -> np.ndarray:
    """The value of rank int(size * percent / 100) of the `size` values around every point."""
    rank = min(int(size * percent / 100), size - 1)
    parts = [np.partition(f, rank, axis=1)[:, rank] for f in np.array_split(_frames(y, size), max(1, len(y) * size // 4_000_000))]
    return np.concatenate(parts)


def gaussian_filter(y: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, cut at four sigma."""
    r = int(4.0 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(y, r, mode="edge"), w / w.sum(), mode="valid")


def quadratic_smooth(y: np.ndarray, window: int) -> np.ndarray:
    """Savitzky-Golay by quadratics over an odd window, with the fitted quadratic at the ends."""
    window = min(window, len(y) - 1 + len(y) % 2)
    if window < 5:
        return y.copy()
    r = window // 2
    basis = np.vander(np.arange(-r, r + 1.0), 3)
    fit = basis @ np.linalg.pinv(basis)  # row k: weights of the fitted value at place k
    out = y.astype(float)
    out[r : len(y) - r] = np.lib.stride_tricks.sliding_window_view(y, window) @ fit[r]
    out[:r], out[len(y) - r :] = fit[:r] @ y[:window], fit[r + 1 :] @ y[-window:]
    return out


def maxima(y: np.ndarray) -> np.ndarray:
    """Places of local maxima; of a plateau the middle one, the left of two."""
    start = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
    end, v = np.append(start[1:], len(y)) - 1, y[start]
    top = np.zeros(len(v), bool)
    top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    return (start[top] + end[top]) // 2


def prominence_and_width(y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prominence of every peak, and its width in points at half of that, between interpolated crossings."""
    prominence, width = np.zeros(len(at)), np.zeros(len(at))
    for k, p in enumerate(at):
        higher = np.flatnonzero(y > y[p])
        lo = higher[higher < p].max(initial=-1) + 1
        hi = higher[higher > p].min(initial=len(y))
        base = max(y[lo : p + 1].min(), y[p:hi].min())
        prominence[k] = y[p] - base
        level = y[p] - 0.5 * prominence[k]
        below = np.flatnonzero(y[lo : p + 1] <= level)
        l = lo + below[-1] if len(below) else lo  # noqa: E741
        below = np.flatnonzero(y[p:hi] <= level)
        r = p + below[0] if len(below) else hi - 1
        left = l + (level - y[l]) / (y[l + 1] - y[l]) if y[l] < level else float(l)
        right = r - (level - y[r]) / (y[r - 1] - y[r]) if y[r] < level else float(r)
        width[k] = right - left
    return prominence, width


def spaced(y: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """The peaks of which none lies within less than `distance` points of a higher one that stays, the later of equal ones first."""
    keep = np.ones(len(at), bool)
    for k in np.argsort(y[at], kind="stable")[::-1]:
        if keep[k]:
            keep &= (np.abs(at - at[k]) >= distance) | (np.arange(len(at)) == k)
    return at[keep]


def find_peaks(y: np.ndarray, prominence: float, distance: int, most_width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, prominences, widths) of maxima that are spaced, prominent, and between 1 and `most_width` points wide."""
    at = spaced(y, maxima(y), distance)
    p, w = prominence_and_width(y, at)
    ok = p >= prominence
    if most_width is not None:
        ok &= (w >= 1) & (w <= most_width)
    return at[ok], p[ok], w[ok]


def at_step(degrees: float, step: float, least: int) -> int:
    return max(least, int(round(degrees / max(step, 1e-6))))
