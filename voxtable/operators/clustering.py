"""Speakers from embeddings: k-means with soft refinement, merging of clusters, posteriors over time.

One session's chunks are clustered in one task (a session has thousands of chunks, not millions); sessions are spread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import ClusterSettings
from .decode import SESSION, matrix, per_session


def unit(x: np.ndarray, least: float = 1e-8) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), least)


def soft(x: np.ndarray, tau: float) -> np.ndarray:
    z = x / max(tau, 1e-8)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, seed: int, restarts: int, rounds: int = 100) -> np.ndarray:
    """The centres of the best of several k-means++ starts."""
    rng, best = np.random.default_rng(seed), (np.inf, x[:k])
    for _ in range(restarts):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            p = d / d.sum() if d.sum() > 0 else None
            centres = np.vstack((centres, x[rng.choice(len(x), p=p)]))
        for _ in range(rounds):
            d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
            own = d.argmin(axis=1)
            new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        loss = d.min(axis=1).sum()
        if loss < best[0] - 1e-12:
            best = (loss, centres)
    return best[1]


def wanted(n: int, s: ClusterSettings) -> int:
    """How many clusters n chunks are first parted into."""
    most = min(s.max_speakers, n)
    if s.target_speakers is not None:
        return max(1, min(s.target_speakers, most))
    return max(s.min_speakers, min(most, int((n / 2) ** 0.5) if n > 8 else 2))


def cluster(x: np.ndarray, s: ClusterSettings | None = None) -> tuple[np.ndarray, np.ndarray]:
    """V6 and V7: (centres, labels); labels come from the responsibilities before the last update of the centres."""
    s = (s or ClusterSettings()).normalised()
    if not len(x):
        return np.zeros((1, x.shape[1] if x.ndim > 1 else 0)), np.empty(0, int)
    if len(x) < s.min_speakers:
        return unit(x.mean(axis=0, keepdims=True)), np.zeros(len(x), int)
    k = min(wanted(len(x), s), len(x))
    centres, share = unit(kmeans(x, k, s.seed, s.restarts)), None
    for tau in s.em_schedule:
        share = soft(x @ centres.T, 0.75 * tau)
        centres = unit(share.T @ x)
    return tidy(x, centres, share.argmax(axis=1), s)


def tidy(x: np.ndarray, centres: np.ndarray, labels: np.ndarray, s: ClusterSettings) -> tuple[np.ndarray, np.ndarray]:
    """V7: empty clusters go, light ones give their chunks away, similar ones merge; never under the least number of speakers."""
    used, labels = np.unique(labels, return_inverse=True)
    centres, counts = centres[used], np.bincount(labels)
    heavy = counts / len(x) >= s.least_mass
    if s.least_mass > 0 and len(centres) > s.min_speakers and heavy.sum() >= s.min_speakers:
        centres = centres[heavy]
        labels = (x @ centres.T).argmax(axis=1)
        counts = np.bincount(labels, minlength=len(centres))
    while s.merge_similarity > 0 and len(centres) > s.min_speakers:
        alike = centres @ centres.T
        np.fill_diagonal(alike, -1.0)
        i, j = np.unravel_index(alike.argmax(), alike.shape)
        if alike[i, j] < s.merge_similarity:
            break
        both = counts[i] + counts[j]
        weights = (counts[i] / both, counts[j] / both) if both else (0.5, 0.5)
        centres[i] = unit(weights[0] * centres[i] + weights[1] * centres[j])
        counts[i] = both
        labels = np.where(labels == j, i, labels)
        labels = labels - (labels > j)
        centres, counts = np.delete(centres, j, axis=0), np.delete(counts, j)
    return centres, labels


def posteriors(x: np.ndarray, t: np.ndarray, valid: np.ndarray, centres: np.ndarray, grid: np.ndarray, tau: float = 0.28, power: float = 1.15,
               flat: float = 0.05, least_top: float = 0.55, most_entropy: float = 0.67, spill: float = 0.02) -> np.ndarray:
    """V8: speaker probabilities on the grid from chunk similarities: contrast where rows are flat, softmax and power,
    interpolation; posteriors that tell nothing become nearly hard ones. Fewer than two valid chunks: the one chunk's row, or uniform."""
    k = len(centres)
    if valid.sum() == 0:
        return np.full((len(grid), k), 1 / k)
    scores = x[valid] @ centres.T
    if valid.sum() == 1:
        return np.repeat(soft(scores, tau), len(grid), axis=0)
    if scores.std(axis=1).mean() < flat:
        z = (scores - scores.mean(axis=1, keepdims=True)) / (scores.std(axis=1, keepdims=True) + 1e-8)
        scores = np.tanh(3 * z)
    p = soft(scores, tau) ** power
    p = p / p.sum(axis=1, keepdims=True)

    def spread(q: np.ndarray) -> np.ndarray:
        out = np.stack([np.interp(grid, t[valid], q[:, j]) for j in range(k)], axis=1)
        out = np.clip(out, 1e-8, 1.0)
        return out / out.sum(axis=1, keepdims=True)

    out = spread(p)
    entropy = -(out * np.log(out)).sum(axis=1).mean()
    if k >= 2 and (out.max(axis=1).mean() < least_top or entropy > most_entropy):
        hard = np.full_like(p, spill / (k - 1))
        hard[np.arange(len(p)), scores.argmax(axis=1)] = 1 - spill
        out = spread(hard)
    return out


def clustered(vectors: DataFrame, s: ClusterSettings | None = None) -> DataFrame:
    """vectors (session, idx, v) -> session, idx, cluster of V6 and V7."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, labels = cluster(unit(matrix(pdf["v"])), s)
        return pd.DataFrame({"idx": pdf["idx"], "cluster": labels.astype("int32")})

    return per_session(vectors.select(SESSION, "idx", "v"), run, "idx long, cluster int", "idx")


def timelines(vectors: DataFrame, hz: float, s: ClusterSettings | None = None) -> DataFrame:
    """vectors (session, idx, t, v, valid) -> session, i, t, p: clusters, then posteriors on a grid of ``hz`` up to the last chunk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, t, valid = unit(matrix(pdf["v"])), pdf["t"].to_numpy(float), pdf["valid"].to_numpy(bool)
        centres, _ = cluster(x[valid], s)
        grid = np.arange(max(1, int(t.max() * hz))) / hz
        return pd.DataFrame({"i": np.arange(len(grid)), "t": grid, "p": list(posteriors(x, t, valid, centres, grid))})

    return per_session(vectors.select(SESSION, "idx", "t", "v", "valid"), run, "i long, t double, p array<double>", "idx")
