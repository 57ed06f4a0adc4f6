"""Pursuit in rounds against its plain form; groups stop at different rounds."""

import numpy as np
import pytest

from tessera.operators import pursuit as pu


def brute(v, atoms, rounds, least):
    r, taken, total = v.copy(), [], max(float(v @ v), 1e-10)
    for _ in range(rounds):
        best = None
        for name in sorted(atoms):
            w = atoms[name]
            if name in [t for t, _ in taken] or w @ w <= 1e-10 or r @ w <= 0:
                continue
            gain = (r @ w) ** 2 / (w @ w)
            if best is None or round(gain, 9) > round(best[0], 9):
                best = (gain, name, (r @ w) / (w @ w))
        if best is None or best[0] / total < least:
            break
        taken.append(best[1:])
        r = r - best[2] * atoms[best[1]]
    return taken, r


def test_rounds_of_all_groups(spark):
    rng = np.random.default_rng(1)
    values, rows, want = [], [], {}
    for g in range(6):
        atoms = {f"a{k}": np.where(rng.uniform(size=40) < 0.3, rng.uniform(0.2, 2, 40), 0.0) for k in range(8)} | {"zero": np.zeros(40)}
        v = sum((rng.uniform(1, 3) * atoms[f"a{k}"] for k in range(g)), np.zeros(40)) + 0.001 * rng.standard_normal(40)
        name = f"g{g}"
        values += [(name, c, float(x)) for c, x in enumerate(v)]
        rows += [(name, a, c, float(x)) for a, w in atoms.items() for c, x in enumerate(w) if x]
        want[name] = (*brute(v, atoms, 4, 0.02), float(v @ v))
    values += [("silent", c, 0.0) for c in range(5)] + [("bare", 0, 1.0)]
    rows += [("silent", "a", c, 1.0) for c in range(5)]
    done = pu.explain(spark.createDataFrame(values, "g string, cell int, v double").repartition(4), spark.createDataFrame(rows, "g string, atom string, cell int, w double"), ["g"], "cell", "v", "atom", "w", 4, 0.02)
    found = {(r.g, r["round"]): (r.atom, r["size"]) for r in done.found.collect()}
    rest = {(r.g, r.cell): r.rest for r in done.rest.collect()}
    shares = {r.g: (r.explained, r.rounds) for r in done.shares.collect()}
    stops = set()
    for g, (taken, r, power) in want.items():
        assert [found[g, n + 1][0] for n in range(len(taken))] == [a for a, _ in taken], g
        assert all(found[g, n + 1][1] == pytest.approx(s) for n, (_, s) in enumerate(taken)) and (g, len(taken) + 1) not in found
        assert np.allclose([rest[g, c] for c in range(40)], r)
        assert shares[g] == (pytest.approx(1 - float(r @ r) / power, abs=1e-6), len(taken))
        stops.add(len(taken))
    assert len(stops) >= 3 and shares["silent"] == shares["bare"] == (0.0, 0) and rest["bare", 0] == 1.0


def test_empty(spark):
    done = pu.explain(spark.createDataFrame([], "g string, cell int, v double"), spark.createDataFrame([], "g string, atom string, cell int, w double"), ["g"], "cell", "v", "atom", "w")
    assert done.found.count() == done.rest.count() == done.shares.count() == 0
