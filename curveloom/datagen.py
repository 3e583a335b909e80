"""Seeded point sets for tests and measurements."""

from __future__ import annotations

import numpy as np


def gaussian_clusters(k: int, dims: int, size: tuple[int, int], deviation: tuple[float, float] = (10, 30), top: int = 1000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Points and labels of k ellipsoidal clusters whose centres lie at least 3 deviations * sqrt(dims) apart, clamped to 0 .. top."""
    rng = np.random.default_rng(seed)
    apart, centres = 3 * deviation[1] * dims**0.5, []
    for _ in range(100 * k):
        c = rng.uniform(0.1 * top, 0.9 * top, dims)
        if all(np.linalg.norm(c - o) >= apart for o in centres):
            centres.append(c)
        if len(centres) == k:
            break
    x, y = [], []
    for i, c in enumerate(centres):
        n = int(rng.integers(size[0], size[1] + 1))
        x.append(c + rng.normal(size=(n, dims)) * rng.uniform(*deviation, dims))
        y.append(np.full(n, i))
    o = rng.permutation(sum(map(len, y)))
    return np.clip(np.rint(np.concatenate(x)), 0, top).astype(np.int64)[o], np.concatenate(y)[o]


def chain(segments: int, dims: int, per_segment: int, length: float, deviation: float, top: int = 10_000, seed: int = 0) -> np.ndarray:
    """Points strewn along a chain of random segments."""
    rng = np.random.default_rng(seed)
    at, out = np.full(dims, top / 2), []
    for _ in range(segments):
        u = rng.normal(size=dims)
        nxt = np.clip(at + length * u / np.linalg.norm(u), 0, top)
        out.append(at + (nxt - at) * rng.uniform(size=(per_segment, 1)) + rng.normal(size=(per_segment, dims)) * deviation)
        at = nxt
    return np.clip(np.rint(np.concatenate(out)), 0, top).astype(np.int64)


def uniform(n: int, dims: int, top: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, top + 1, size=(n, dims))


def filaments(x: np.ndarray, y: np.ndarray, per_link: int, deviation: float, top: int = 1000, seed: int = 0) -> np.ndarray:
    """Noise along the lines from each cluster's centre to the nearest other centre."""
    rng = np.random.default_rng(seed)
    names = np.unique(y)
    c = np.array([x[y == k].mean(axis=0) for k in names])
    d = np.square(c[:, None] - c[None]).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    out = [c[i] + (c[int(np.argmin(d[i]))] - c[i]) * rng.uniform(size=(per_link, 1)) + rng.normal(size=(per_link, x.shape[1])) * deviation for i in range(len(names) if len(names) > 1 else 0)]
    return np.clip(np.rint(np.concatenate(out)), 0, top).astype(np.int64) if out else np.zeros((0, x.shape[1]), np.int64)


def overlapping_pair(dims: int, size: int, overlap: float, deviation: float = 20, top: int = 1000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two round clusters whose centres are (1 - overlap) times four deviations * sqrt(dims) apart, and their labels."""
    rng = np.random.default_rng(seed)
    u = rng.normal(size=dims)
    shift = u / np.linalg.norm(u) * (1 - overlap) * 4 * deviation * dims**0.5
    x = np.concatenate([top / 2 + s * shift / 2 + rng.normal(size=(size, dims)) * deviation for s in (-1, 1)])
    return np.clip(np.rint(x), 0, top).astype(np.int64), np.repeat([0, 1], size)


def line(n: int, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Points strewn evenly at random along a line."""
    return np.rint(start + (np.asarray(end) - start) * np.random.default_rng(seed).uniform(size=(n, 1))).astype(np.int64)


def correlated(n: int, dims: int, correlation: float, deviation: float = 20, middle: float = 500, seed: int = 0) -> np.ndarray:
    """Points all of whose dimensions share a part, so that any two have about the given correlation."""
    rng = np.random.default_rng(seed)
    shared = rng.normal(size=(n, 1)) * correlation**0.5 + rng.normal(size=(n, dims)) * (1 - correlation) ** 0.5
    return np.maximum(np.rint(middle + deviation * shared), 0).astype(np.int64)


def linear_combinations(x: np.ndarray, extra: int, seed: int = 0) -> np.ndarray:
    """Points with further dimensions that are random weighted means of the given ones."""
    w = np.random.default_rng(seed).dirichlet(np.ones(x.shape[1]), extra)
    return np.concatenate([x, np.rint(x @ w.T).astype(np.int64)], axis=1)


def zipf(n: int, kinds: int, exponent: float, seed: int = 0) -> np.ndarray:
    """Draws from 1 .. kinds with probability in proportion to rank ** -exponent, by the inverse of the distribution."""
    p = np.arange(1, kinds + 1, dtype=float) ** -exponent
    return 1 + np.searchsorted(np.cumsum(p) / p.sum(), np.random.default_rng(seed).uniform(size=n), side="right").clip(0, kinds - 1)
