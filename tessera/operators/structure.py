"""Sections of a track from beat-wise features: spectral clustering of a recurrence graph, one group per track."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .temporal import absorb_short_runs


def kmeans(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Labels from farthest-first centres; the same for the same rows."""
    centres = [x[int(np.argmin(np.square(x - x.mean(0)).sum(1)))]]
    while len(centres) < k:
        centres.append(x[int(np.argmax(np.min([np.square(x - c).sum(1) for c in centres], axis=0)))])
    c = np.array(centres)
    for _ in range(rounds):
        label = np.argmin(np.square(x[:, None] - c[None]).sum(2), axis=1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


def segment(features: np.ndarray, beats_per_bar: int = 4, sections: int = 6, least_bars: int = 4) -> list[int]:
    """A cluster per beat: recurrence and path affinities, Laplacian eigenvectors, k-means, then short runs absorbed."""
    n = len(features)
    if n < 8:
        return [0] * n
    f = (features - features.mean(0)) / np.maximum(features.std(0), 1e-9)
    d = np.square(f[:, None] - f[None]).sum(2)
    near = np.sort(d, axis=1)[:, min(n - 1, max(2, int(np.sqrt(n))))]
    a = np.exp(-d / np.maximum(np.sqrt(near[:, None] * near[None]), 1e-9))
    away = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    a[away < 3] = 0
    path = np.zeros((n, n))
    step = np.exp(-np.square(np.diff(f, axis=0)).sum(1) / max(float(np.median(np.square(np.diff(f, axis=0)).sum(1))), 1e-9))
    path[np.arange(n - 1), np.arange(1, n)] = step
    path += path.T
    deg_a, deg_p = a.sum(1), path.sum(1)
    mu = float(deg_p @ (deg_a + deg_p) / max(((deg_a + deg_p) ** 2).sum(), 1e-9))
    w = mu * a + (1 - mu) * path
    root = 1 / np.sqrt(np.maximum(w.sum(1), 1e-9))
    _, vec = np.linalg.eigh(np.eye(n) - root[:, None] * w * root[None])
    k = min(sections, max(2, n // 6))
    v = vec[:, :k] / np.maximum(np.linalg.norm(vec[:, :k], axis=1, keepdims=True), 1e-9)
    half = max(5, 2 * beats_per_bar + 1) // 2
    raw = np.pad(kmeans(v, k), half, mode="edge")
    smooth = [int(np.median(raw[i : i + 2 * half + 1])) for i in range(n)]
    return absorb_short_runs(smooth, least_bars * beats_per_bar)


def segment_tracks(beats: DataFrame, track: str, order: str, features: str, **options) -> DataFrame:
    """track, order and cluster of every beat; a track's beats (a few hundred) are one group."""
    kinds = {f.name: f.dataType.simpleString() for f in beats.schema}

    def run(pdf):
        pdf = pdf.sort_values(order)
        return pdf[[track, order]].assign(cluster=segment(np.stack(list(pdf[features])).astype(float), **options))

    return beats.groupBy(track).applyInPandas(run, f"`{track}` {kinds[track]}, `{order}` {kinds[order]}, cluster int")
