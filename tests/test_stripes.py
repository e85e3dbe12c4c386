"""Stripe search on images with stripes at an odd angle, a trail and plain noise, held against whole-image computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.operators import stripes
from skyframe.session import Scratch

SIZE = 96
Y, X = np.mgrid[:SIZE, :SIZE].astype(float)
OPTIONS = dict(k=6.0, low=20.0, detrend=8.0, window=40.0, least_scan=10, least_field=5, least_strips=30, significance=8.0, rounds=2)


def oriented(angle):
    t, c = np.radians(angle), (SIZE - 1) / 2
    v = (Y - c) * np.cos(t) - (X - c) * np.sin(t) + c * (abs(np.cos(t)) + abs(np.sin(t)))
    return np.round(v, 9), np.round((X - c) * np.cos(t) + (Y - c) * np.sin(t), 9)


def images():
    rng = np.random.default_rng(2)
    clean = rng.normal(0, 0.3, (3, SIZE, SIZE))
    v = oriented(17.375)[0]
    striped = clean[0] + np.sin(2 * np.pi * v / 7) + 0.7 * np.sin(2 * np.pi * v / 11)
    trail = clean[2] + 1.2 * (np.abs(oriented(-40.0)[0] - 70) < 0.6)
    return {"striped": striped, "noise": clean[1], "trail": trail}, clean


@pytest.fixture(scope="module")
def searched(spark):
    made, clean = images()
    rows = [(k, y, x, float(v[y, x])) for k, v in made.items() for y in range(SIZE) for x in range(SIZE)]
    df = spark.createDataFrame(rows, "k string, y int, x int, v double")
    with Scratch(spark) as scratch:
        pixels, passes = stripes.destripe_search(df, ["k"], scratch, **OPTIONS)
        out = {k: np.zeros((3, SIZE, SIZE)) for k in made}
        for r in pixels.collect():
            out[r.k][:, r.y, r.x] = r.v, r.stripes, r.bg
        return made, clean, out, [tuple(r) for r in passes.orderBy("k", "turn").collect()]


def test_angle_between_the_coarse_ones(searched):
    made, clean, out, passes = searched
    first = next(p for p in passes if p[0] == "striped")
    assert first[1] == 0 and abs(first[2] - 17.375) <= 0.25 and first[2] % 1 and first[3] > 8 and not first[4]
    left, before = out["striped"][0] - clean[0], made["striped"] - clean[0]
    assert left.std() < 0.45 * before.std()
    assert np.allclose(out["striped"][0] + out["striped"][1], made["striped"])


def test_noise_is_left_alone(searched):
    made, _, out, passes = searched
    assert not [p for p in passes if p[0] == "noise"] and np.array_equal(out["noise"][0], made["noise"])


def test_a_trail_leaves_the_background_and_is_not_taken_away(searched):
    made, _, out, passes = searched
    first = next(p for p in passes if p[0] == "trail")
    assert abs(first[2] + 40) <= 0.5 and first[4]
    on = np.abs(oriented(-40.0)[0] - 70) < 0.6
    assert not out["trail"][2][on].any() and out["trail"][2].mean() > 0.8
    assert np.allclose(out["trail"][0], made["trail"], atol=0.2)


def blurred(a, sigma, mirrored):
    """One axis, sum by sum."""
    reach, n = int(4 * sigma + 0.5), len(a)
    d = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (d / sigma) ** 2)
    out = np.zeros_like(a)
    for i in range(n):
        j = (i + d) % (2 * n)
        j = np.where(j >= n, 2 * n - 1 - j, j) if mirrored else np.clip(i + d, 0, n - 1)
        out[i] = np.tensordot(w / w.sum(), a[j], 1)
    return out


def known(a, sigma):
    ok = np.isfinite(a)
    weight = blurred(ok.astype(float), sigma, False)
    return np.where(weight > 1e-3, blurred(np.where(ok, a, 0.0), sigma, False) / np.maximum(weight, 1e-8), np.nan)


def test_first_pass_by_whole_images(spark):
    """Background, scores, and both fields of one image, strip by strip."""
    made, _ = images()
    image, mask = made["striped"], (Y * 7 + X * 3) % 11 > 1
    low = blurred(blurred(np.where(mask, image, 0.0), 20.0, True).T, 20.0, True).T / blurred(blurred(mask.astype(float), 20.0, True).T, 20.0, True).T
    hp = image - low
    df = spark.createDataFrame([("a", y, x, float(image[y, x]), bool(mask[y, x])) for y in range(SIZE) for x in range(SIZE)], "k string, y int, x int, v double, bg boolean")
    residue = df.join(stripes.background(df, ["k"], 20.0), ["k", "y", "x"]).withColumn("hp", F.when(F.col("bg"), F.col("v") - F.col("low"))).cache()
    assert all(np.isclose(r.low, low[r.y, r.x]) for r in residue.collect())

    sigma, angles = 0.7, [0.0, -33.5, 17.375, 90.0]
    candidates = spark.createDataFrame([("a", SIZE, SIZE, sigma, angles)], "k string, height int, width int, sigma double, angles array<double>")
    got = {r.angle: r.score for r in stripes.scan(residue, candidates, ["k"], least=10, least_strips=30, detrend=8.0).collect()}
    for angle in angles:
        strip = np.floor(oriented(angle)[0]).astype(int)
        n = np.array([(mask & (strip == i)).sum() for i in range(strip[mask].max() + 1)])
        mean = np.array([np.clip(hp[mask & (strip == i)], -4 * sigma, 4 * sigma).mean() if n[i] >= 10 else np.nan for i in range(len(n))])
        rest = mean - known(mean, 8.0)
        ok = np.isfinite(rest)
        assert np.isclose(got[angle], np.mean(rest[ok] ** 2 / sigma**2 - 1 / n[ok]))

    angle, window = 17.375, 40.0
    v, u = oriented(angle)
    half = (SIZE - 1) / 2 * (np.cos(np.radians(angle)) + np.sin(np.radians(angle)))
    tall = int(round(2 * half)) + 1
    for win, along in ((None, 0.0), (window, 2.0)):
        centres = np.array([0.0]) if win is None else np.arange(window / 2 - half, half - window / 2 + 1e-9, window / 2)
        med, n = np.full((tall, len(centres)), np.nan), np.zeros((tall, len(centres)))
        for j, c in enumerate(centres):
            for i in range(tall):
                inside = mask & (np.rint(v) == i) & (True if win is None else np.abs(u - c) <= win / 2 + 1e-9)
                n[i, j] = inside.sum()
                med[i, j] = np.median(hp[inside]) if n[i, j] >= 5 else np.nan
        p = med - known(med, 8.0)
        worth = 1.0
        if along:
            p, worth = known(p.T, along).T, max(1, np.sqrt(2 * np.pi) * along / 2)
        noise = (1.2533 * sigma) ** 2 / np.maximum(n * worth, 1)
        ok = np.isfinite(p)
        signal = max((p[ok] ** 2).mean() - noise[ok].mean(), 0)
        p = p * signal / (signal + noise)
        for j in range(len(centres)):
            p[:, j] = np.interp(np.arange(tall), np.flatnonzero(ok[:, j]), p[ok[:, j], j])
        i0 = np.clip(v, 0, tall - 1)
        j0 = np.zeros_like(u) if win is None else np.clip((u - centres[0]) / (window / 2), 0, len(centres) - 1)
        i, j = i0.astype(int), j0.astype(int)
        i1, j1, fi, fj = np.minimum(i + 1, tall - 1), np.minimum(j + 1, len(centres) - 1), i0 - i, j0 - j
        field = (p[i, j] * (1 - fi) + p[i1, j] * fi) * (1 - fj) + (p[i, j1] * (1 - fi) + p[i1, j1] * fi) * fj
        found = spark.createDataFrame([("a", SIZE, SIZE, sigma, angle)], "k string, height int, width int, sigma double, angle double")
        cells = stripes._profiles(residue, found, ["k"], window=win, least=5, detrend=8.0, smooth=along, few=10, few_share=0.01)
        rows = stripes._field(df, found, cells, ["k"], win, "s").collect()
        assert len(rows) == SIZE * SIZE and all(np.isclose(r.s, field[r.y, r.x], atol=1e-9) for r in rows)


def test_nulls_flat_and_empty_images(spark):
    rows = [("flat", y, x, 1.0) for y in range(4) for x in range(4)] + [("null", y, x, None) for y in range(3) for x in range(3)] + [("one", 0, 0, 2.0)]
    df = spark.createDataFrame(rows, "k string, y int, x int, v double")
    with Scratch(spark) as scratch:
        pixels, passes = stripes.destripe_search(df, ["k"], scratch)
        assert sorted((r.k, r.y, r.x, str(r.v)) for r in pixels.collect()) == sorted((k, y, x, str(v)) for k, y, x, v in rows) and passes.count() == 0
        pixels, passes = stripes.destripe_search(df.limit(0), ["k"], scratch)
        assert pixels.count() == passes.count() == 0


def test_profiles_are_scored_together(spark, monkeypatch):
    """Many small images are few calls of numpy: a call for each profile of each image took hours on a million images."""
    from skyframe.operators import stripes

    lengths = np.array([3, 5, 3, 3, 5])
    assert [(n, p.tolist()) for n, p in stripes._alike(lengths, 6)] == [(3, [0, 2]), (3, [3]), (5, [1]), (5, [4])]
    a = np.random.default_rng(0).normal(size=(9, 40))
    a[np.random.default_rng(1).random(a.shape) < 0.2] = np.nan
    assert np.allclose(stripes._blurred_known(a, 2.0), np.array([stripes._blurred_known(c, 2.0) for c in a.T]).T, equal_nan=True)
