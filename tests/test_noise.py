"""Noise independence on quads of patches, held against a plain computation."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from skyframe.plans import noise

SIZE, PATCH = 30, 12


def acf(a):
    a = a - a.mean()
    return ((a[:, :-1] * a[:, 1:]).mean() + (a[:-1] * a[1:]).mean()) / 2 / a.var()


def test_quads_attempts_and_figures(spark):
    rng = np.random.default_rng(3)
    shared = rng.normal(0, 0.3, (SIZE + 8, SIZE + 8))
    shift = {"e0": (0.0, 0.0), "e1": (1.05, -2.0), "e2": (0.0, 3.02), "e3": (-1.0, 1.0), "e4": (0.4, 0.0)}
    images = {}
    for f, (ty, tx) in shift.items():
        images[f] = rng.normal(0, 1, (SIZE, SIZE)) + shared[4 - round(ty) : 4 - round(ty) + SIZE, 4 - round(tx) : 4 - round(tx) + SIZE]
    images["e1"][:, :11] += 40 * (rng.random((SIZE, 11)) < 0.35)  # a side that is no background
    images["e2"][2, 3] = np.nan
    rows = [("g", r, f, shift[f][0] - shift[r][0], shift[f][1] - shift[r][1]) for r in shift for f in shift]
    quads = noise.quads(spark.createDataFrame(rows, "group string, ref string, file string, ty double, tx double")).cache()
    told = {}
    for r in quads.collect():
        told.setdefault(r.quad, {})[r.role] = (r.file, r.ty, r.tx)
    near = lambda r, f: f != r and all(abs(shift[f][k] - shift[r][k] - round(shift[f][k] - shift[r][k])) < 0.12 for k in (0, 1))
    assert set(told) == {"|".join((r, *three)) for r in shift for three in combinations(sorted(f for f in shift if near(r, f)), 3)} and len(told) == 4

    pixels = spark.createDataFrame([("g", f, y, x, None if np.isnan(v[y, x]) else float(v[y, x])) for f, v in images.items() for y in range(SIZE) for x in range(SIZE)], "group string, file string, y int, x int, v double")
    how = dict(size=PATCH, height=SIZE, width=SIZE, margin=1)
    tried = {}
    for r in noise.attempts(quads, most=40, **how).orderBy("turn").collect():
        tried.setdefault(r.quad, []).append((r.top, r.left))
    got = {r.quad: r for r in noise.patches(quads, pixels, most=40, grow=1, least=0.6, **how).collect()}
    late = 0
    for quad, roles in told.items():
        for turn, (top, left) in enumerate(tried[quad]):
            cut = [images[f][top + ty : top + ty + PATCH, left + tx : left + tx + PATCH] for f, ty, tx in (roles[k] for k in "abcd")]
            assert all(c.shape == (PATCH, PATCH) for c in cut)
            if not all(np.isfinite(c).all() for c in cut):
                continue
            bg = np.ones((PATCH, PATCH), bool)
            for c in cut:
                off = np.abs(c - np.median(c))
                for y, x in np.argwhere(off > 4 * 1.4826 * np.median(off)):
                    bg[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2] = False
            if bg.mean() >= 0.6:
                break
        else:
            assert quad not in got
            continue
        late += turn > 0
        a, b, c, d = (v[bg] for v in cut)
        r = got[quad]
        assert r.turn == turn and np.isclose(r.frac, bg.mean()) and np.isclose(r.rho, 2 * np.corrcoef(a - c, b - d)[0, 1]) and np.isclose(r.naive, np.corrcoef(a, b)[0, 1])
        assert np.isclose(r.vtest, np.var(a - b) / (np.var(a - c) + np.var(b - c) - np.var(a - b)))
        white = np.where(bg, cut[0] - cut[2] - (a - c).mean(), 0.0)
        assert np.isclose(r.acf1, acf(white))
    assert got and late


def test_line_and_ranges(spark):
    rng = np.random.default_rng(0)
    acf1 = rng.uniform(-0.1, 0.5, 60)
    rho = 0.07 + 0.9 * acf1 + rng.normal(0, 0.02, 60)
    df = spark.createDataFrame([("g" if k % 2 else "h", str(k), 0, float(rho[k]), float(acf1[k]), 0.1, 0.9, 1.0) for k in range(60)], "group string, quad string, turn int, rho double, acf1 double, naive double, frac double, vtest double")
    line, bins = noise.at_zero_whiteness(df)
    slope, at_zero = np.polyfit(acf1, rho, 1)
    (r,) = line.collect()
    assert np.isclose(r.slope, slope) and np.isclose(r.rho_at_zero, at_zero) and r.n == 60
    edges = (-1, 0.05, 0.15, 0.3, 1)
    for b in bins.collect():
        inside = (acf1 >= edges[b.bin]) & (acf1 < edges[b.bin + 1])
        assert b.n == inside.sum() and np.isclose(b.rho, np.median(rho[inside]))
    for s in noise.summary(df).collect():
        own = np.arange(60) % 2 == (s.group == "g")
        white = np.argsort(acf1[own])[: own.sum() // 3]
        assert np.isclose(s.rho, np.median(rho[own])) and np.isclose(s.rho_white, np.median(rho[own][white])) and np.isclose(s.acf1_white, np.median(acf1[own][white]))


def test_no_quads(spark):
    shifts = spark.createDataFrame([("g", "a", "b", 0.0, 0.0)], "group string, ref string, file string, ty double, tx double")
    pixels = spark.createDataFrame([], "group string, file string, y int, x int, v double")
    assert noise.patches(noise.quads(shifts), pixels, size=4, height=8, width=8, margin=0).count() == 0


def test_attempts_are_neither_dealt_nor_sorted(spark):
    """A quad's attempts, sixty rows of long keys, were sorted in a window; they are an array of the quad's own row, numbered from 0 without gaps."""
    df = spark.createDataFrame([("g", "q", r, r, k, -k) for k, r in enumerate("abcd")], "group string, quad string, role string, file string, ty int, tx int")
    got = noise.attempts(df, most=60, size=5, height=12, width=12, margin=0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange ") <= 1
    rows = got.collect()
    assert sorted(r.turn for r in rows) == list(range(len(rows))) and all(r.top + 3 + 5 <= 12 and r.left - 3 >= 0 for r in rows)
