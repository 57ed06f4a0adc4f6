"""Spectral repairs of one part: what a parent still has is put back, never more, and refusals are counted."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .kernels import EPS, istft, stft


@dataclass
class Report:
    """Counts of a repair: cells damaged, repaired and refused, and anything else worth saying."""

    damaged: int = 0
    repaired: int = 0
    refused: int = 0
    notes: dict = field(default_factory=dict)


def masks(part: np.ndarray, parent: np.ndarray, floor_db: float, share: float = 0.35) -> tuple[np.ndarray, np.ndarray]:
    """Cells of magnitudes where the part lives, and those where it is lost under a loud parent."""
    k = 10 ** (floor_db / 20)
    ratio = part / np.maximum(parent, EPS)
    return (part > k * part.max(initial=0)) & (ratio > share), (parent > k * parent.max(initial=0)) & (ratio <= share)


def fill_short_gaps(x: np.ndarray, parent: np.ndarray, sr: int, longest_ms: float = 250.0, n_fft: int = 4096) -> tuple[np.ndarray, Report]:
    """Lost runs of a bin between living cells, log-linear in magnitude and steady in phase, under the parent."""
    hop = n_fft // 4
    spec, ceiling = stft(x, n_fft), np.abs(stft(parent, n_fft))
    alive, lost = masks(np.abs(spec), ceiling, -60.0)
    longest, out, report = int(longest_ms / 1000 * sr / hop), spec.copy(), Report(damaged=int(lost.sum()))
    for b in np.flatnonzero(lost.any(1) & (alive.sum(1) >= 2)):
        at = np.flatnonzero(alive[b])
        for a, z in zip(at[:-1], at[1:], strict=True):
            gap = np.arange(a + 1, z)
            gap = gap[lost[b, gap]]
            if not len(gap):
                continue
            if z - a - 1 > longest:
                report.refused += len(gap)
                continue
            part = (gap - a) / (z - a)
            level = np.exp(np.log(abs(spec[b, a]) + EPS) * (1 - part) + np.log(abs(spec[b, z]) + EPS) * part)
            level = np.minimum(level, ceiling[b, gap])
            step = 2 * np.pi * hop * b / n_fft
            turn = np.angle(spec[b, z]) - np.angle(spec[b, a]) - step * (z - a)
            turn -= 2 * np.pi * np.round(turn / (2 * np.pi))
            up = level > np.abs(spec[b, gap])
            out[b, gap[up]] = (level * np.exp(1j * (np.angle(spec[b, a]) + (step + turn / (z - a)) * (gap - a))))[up]
            report.repaired += int(up.sum())
    return (istft(out, len(x), n_fft) if report.repaired else np.array(x, float)), report


def partial_bins(f0: float, n_fft: int, sr: int, most: int = 14) -> list[int]:
    """The bins of a note's partials below the limit."""
    found = [round(h * f0 * n_fft / sr) for h in range(1, most + 1) if h * f0 < 0.92 * sr / 2]
    return [b for b in found if 0 < b < n_fft // 2]


def harmonic_restore(x: np.ndarray, parent: np.ndarray, notes: list[tuple[float, float, int, float]], sr: int, n_fft: int = 4096, worst: float = 0.45, siblings: int = 3) -> tuple[np.ndarray, Report]:
    """Damaged partials of notes raised to the level that fits the clean ones of the same frame."""
    hop = n_fft // 4
    spec, ceiling = stft(x, n_fft), np.abs(stft(parent, n_fft))
    mag = np.abs(spec)
    alive, lost = masks(mag, ceiling, -48.0)
    out, report = spec.copy(), Report(damaged=int(lost.sum()))
    t = np.arange(spec.shape[1]) * hop / sr
    for start, end, midi, _ in notes:
        frames, bins = np.flatnonzero((t >= start) & (t < end)), partial_bins(440.0 * 2 ** ((midi - 69) / 12), n_fft, sr)
        if len(frames) < 2 or not bins:
            continue
        clean = alive[np.ix_(bins, frames)] & ~lost[np.ix_(bins, frames)]
        cells = mag[np.ix_(bins, frames)]
        ratio = np.array([np.median(cells[k][clean[k]]) if clean[k].sum() >= 2 else np.nan for k in range(len(bins))])
        if np.isfinite(ratio).sum() < 4 or np.isfinite(ratio[:4]).sum() < 3:
            report.refused += int(lost[np.ix_(bins, frames)].sum())
            continue
        known = np.isfinite(ratio)
        for j, f in enumerate(frames):
            use = clean[:, j] & known
            hurt = np.flatnonzero(~use & known & lost[bins, f])
            if not len(hurt):
                continue
            level = float(cells[use, j] @ ratio[use] / max(ratio[use] @ ratio[use], EPS)) if use.sum() >= siblings else 0.0
            error = float(np.abs(cells[use, j] - level * ratio[use]).sum() / max(cells[use, j].sum(), EPS)) if level else np.inf
            if error > worst:
                report.refused += len(hurt)
                continue
            for k in hurt:
                v = min(level * ratio[k], ceiling[bins[k], f])
                if v > cells[k, j]:
                    out[bins[k], f] = v * np.exp(1j * np.angle(spec[bins[k], f]))
                    report.repaired += 1
    return (istft(out, len(x), n_fft) if report.repaired else np.array(x, float)), report


def borrow_from_repeats(x: np.ndarray, parent: np.ndarray, sections: list[tuple[float, float, str]], sr: int, n_fft: int = 4096, least: float = 0.45, cells: int = 200) -> tuple[np.ndarray, Report]:
    """Lost cells of a section take the median of the same place in repeats that agree with it, under the parent."""
    hop = n_fft // 4
    spec, ceiling = stft(x, n_fft), np.abs(stft(parent, n_fft))
    mag = np.abs(spec)
    _, lost = masks(mag, ceiling, -55.0)
    out, report = spec.copy(), Report(damaged=int(lost.sum()))
    spans = [(int(a * sr / hop), int(z * sr / hop), label) for a, z, label in sections]
    for i, (a, z, label) in enumerate(spans):
        size = min(z, spec.shape[1]) - a
        if size < 4:
            continue
        donors = []
        for j, (c, d, other) in enumerate(spans):
            if i == j or other != label or d - c < 4:
                continue
            at = np.minimum(c + np.round(np.arange(size) * (d - c) / max(z - a, 1)).astype(int), spec.shape[1] - 1)
            both = ~lost[:, a : a + size] & ~lost[:, at] & (mag[:, a : a + size] > EPS) & (mag[:, at] > EPS)
            if both.sum() < cells:
                continue
            u, v = np.log(mag[:, a : a + size][both]), np.log(mag[:, at][both])
            if np.std(u) > 0 and np.std(v) > 0 and np.corrcoef(u, v)[0, 1] >= least:
                donors.append(np.where(lost[:, at], np.nan, mag[:, at]))
        hurt = lost[:, a : a + size]
        if not donors:
            report.refused += int(hurt.sum())
            continue
        with np.errstate(all="ignore"):
            lent = np.nanmedian(np.where(np.isfinite(donors), donors, np.nan), axis=0) if len(donors) > 1 else donors[0]
        lent = np.minimum(np.nan_to_num(lent), ceiling[:, a : a + size])
        take = hurt & (lent > mag[:, a : a + size])
        out[:, a : a + size][take] = (lent * np.exp(1j * np.angle(spec[:, a : a + size])))[take]
        report.repaired += int(take.sum())
        report.refused += int((hurt & ~take).sum())
    return (istft(out, len(x), n_fft) if report.repaired else np.array(x, float)), report


def learn_timbre(x: np.ndarray, notes: list[tuple[float, float, int, float]], sr: int, harmonics: int = 16, n_fft: int = 4096) -> np.ndarray:
    """The share of each partial: per note the median over its frames, then the median over notes; 1/h^1.2 without notes."""
    hop, mag = n_fft // 4, np.abs(stft(x, n_fft))
    t, seen = np.arange(mag.shape[1]) * hop / sr, []
    for start, end, midi, _ in notes:
        frames, bins = np.flatnonzero((t >= start) & (t < end)), partial_bins(440.0 * 2 ** ((midi - 69) / 12), n_fft, sr, harmonics)
        if len(frames) >= 2 and bins:
            p = np.zeros(harmonics)
            p[: len(bins)] = [np.median(mag[max(0, b - 1) : b + 2, frames].max(0)) for b in bins]
            if p.sum() > EPS:
                seen.append(p / p.sum())
    p = np.median(seen, axis=0) if seen else 1 / np.arange(1, harmonics + 1) ** 1.2
    return p / max(p.sum(), EPS)


def explain(x: np.ndarray, sr: int, transcribe, rounds: int = 3, least_gain: float = 0.01) -> tuple[np.ndarray, list, float]:
    """What notes and a learned timbre explain of a signal: synthesis, notes and share, over a few rounds.

    transcribe(signal) gives notes (start, end, midi, level); each round looks for more in what is left, and the
    best round is kept."""
    from .kernels import synthesize

    notes: list = []
    best, best_share = np.zeros(len(x)), 0.0
    power = max(float(np.mean(np.square(x))), EPS)
    for _ in range(rounds):
        known = {(round(n[0], 2), n[2]) for n in notes}
        fresh = [n for n in transcribe(x - best) if (round(n[0], 2), n[2]) not in known]
        if not fresh:
            break
        notes = notes + fresh
        p = learn_timbre(x, notes, sr)
        y = synthesize(notes, lambda count, f0, p=p: p[:count], len(x) / sr, sr)
        y = np.pad(y, (0, max(0, len(x) - len(y))))[: len(x)]
        y = y * float(x @ y / max(y @ y, EPS))
        share = 1 - float(np.mean(np.square(x - y))) / power
        if share < best_share + least_gain:
            break
        best, best_share = y, share
    return best, notes, best_share


def cap_to_mix(restored: dict[str, np.ndarray], exact: dict[str, np.ndarray], mix: np.ndarray, tolerance_db: float = 1.5, n_fft: int = 4096) -> tuple[dict[str, np.ndarray], Report]:
    """Restored parts whose additions, summed in each cell, stay within a tolerance over the mix."""
    added = {k: stft(restored[k], n_fft) - stft(exact[k], n_fft) for k in restored}
    excess, room = np.abs(sum(added.values())), np.abs(stft(mix, n_fft)) * (10 ** (tolerance_db / 20) - 1)
    scale = np.clip(room / np.maximum(excess, EPS), 0, 1)
    return {k: exact[k] + istft(a * scale, len(exact[k]), n_fft) for k, a in added.items()}, Report(damaged=int((excess > EPS).sum()), repaired=int(((scale < 1) & (excess > EPS)).sum()))


def restore(x: np.ndarray, parent: np.ndarray, sr: int, notes=(), sections=(), longest_ms: float = 250.0) -> tuple[np.ndarray, dict[str, Report]]:
    """Repeats first, then harmonics, then short gaps; a step that can't be made says so and changes nothing."""
    done: dict[str, Report] = {}
    for name, step in (
        ("repeats", lambda y: borrow_from_repeats(y, parent, list(sections), sr) if sections else (y, Report())),
        ("harmonics", lambda y: harmonic_restore(y, parent, list(notes), sr) if notes else (y, Report())),
        ("gaps", lambda y: fill_short_gaps(y, parent, sr, longest_ms)),
    ):
        try:
            x, done[name] = step(x)
        except (ValueError, FloatingPointError) as e:
            done[name] = Report(notes={"skipped": str(e)})
    return x, done
