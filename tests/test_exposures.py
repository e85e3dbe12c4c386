"""Coordinates with polynomial distortion, and the partner channel, held against plain computations."""

import numpy as np
from pyspark.sql import functions as F

from skyframe.functions import wcs as W
from skyframe.operators import align
from skyframe.plans import exposures

KINDS = "file string, ver int, p int, height int, width int, wcs struct<crval1:double,crval2:double,crpix1:double,crpix2:double,cd11:double,cd12:double,cd21:double,cd22:double>, sip struct<a:array<double>,b:array<double>>"


def coefficients(**given):
    return [float(given.get(f"c{p}{q}", 0)) for p, q in W.terms()]


def polynomial(c, u, v):
    return sum(k * u**p * v**q for k, (p, q) in zip(c, W.terms(), strict=True))


def sky(wcs, sip, x, y):
    u, v = x + 1 - wcs[2], y + 1 - wcs[3]
    if sip:
        u, v = u + polynomial(sip[0], u, v), v + polynomial(sip[1], u, v)
    xi, eta = np.radians(wcs[4] * u + wcs[5] * v), np.radians(wcs[6] * u + wcs[7] * v)
    d0 = np.radians(wcs[1])
    den = np.cos(d0) - eta * np.sin(d0)
    return wcs[0] + np.degrees(np.arctan2(xi, den)), np.degrees(np.arctan2(np.sin(d0) + eta * np.cos(d0), np.hypot(den, xi)))


def pixel(wcs, sip, ra, dec):
    """By Newton steps on ``sky`` with numerical slopes: another way than the operator's."""
    p = np.array([wcs[2] - 1, wcs[3] - 1], float)
    for _ in range(30):
        f = np.array(sky(wcs, sip, *p)) - (ra, dec)
        j = np.array([(np.array(sky(wcs, sip, *(p + e))) - np.array(sky(wcs, sip, *(p - e)))) / 2e-3 for e in np.eye(2) * 1e-3]).T
        p = p - np.linalg.solve(j, f)
    return p


A = (10.0, 5.0, 32.0, 30.0, 1e-5, 1e-7, -1e-7, 1e-5)
B = (10.00003, 5.00002, 31.0, 33.0, 1e-5, -2e-7, 2e-7, 1e-5)
SIP_A = (coefficients(c20=1e-4, c11=-5e-5), coefficients(c02=2e-4, c30=1e-6))
SIP_B = (coefficients(c20=-2e-4, c12=1e-6), coefficients(c11=1e-4, c50=1e-10))


def test_project_with_distortion(spark):
    rng = np.random.default_rng(0)
    places = rng.uniform(0, 63, (40, 2))
    df = spark.createDataFrame([(*map(float, p), A, B, SIP_A, SIP_B, None) for p in places], f"x double, y double, a {KINDS.split('wcs ')[1].split(', sip')[0]}, b {KINDS.split('wcs ')[1].split(', sip')[0]}, sa {KINDS.split('sip ')[1]}, sb {KINDS.split('sip ')[1]}, none {KINDS.split('sip ')[1]}")
    both = W.project(F.col("a"), F.col("b"), F.col("x"), F.col("y"), F.col("sa"), F.col("sb"))
    half = W.project(F.col("a"), F.col("b"), F.col("x"), F.col("y"), F.col("none"), F.col("sb"))
    plain = W.project(F.col("a"), F.col("b"), F.col("x"), F.col("y"))
    bare = W.project(F.col("a"), F.col("b"), F.col("x"), F.col("y"), F.col("none"), F.col("none"))
    for r in df.select("x", "y", both.alias("both"), half.alias("half"), plain.alias("plain"), bare.alias("bare")).collect():
        assert np.allclose(r.both, pixel(B, SIP_B, *sky(A, SIP_A, r.x, r.y)), atol=1e-5)
        assert np.allclose(r.half, pixel(B, SIP_B, *sky(A, None, r.x, r.y)), atol=1e-5)
        assert np.allclose(r.plain, r.bare, atol=1e-9) and np.allclose(r.plain, pixel(B, None, *sky(A, None, r.x, r.y)), atol=1e-5)


def test_coefficients_from_header(spark):
    df = spark.createDataFrame([({"h1_A_ORDER": "2", "h1_B_ORDER": "3", "h1_A_2_0": "1e-4", "h1_B_0_3": "-2"},), ({"h1_A_ORDER": "2"},), ({"h1_A_ORDER": "9", "h1_B_ORDER": "2"},)], "h map<string,string>")
    first, *rest = [r[0] for r in df.select(W.sip_from_header(F.col("h"))).collect()]
    assert list(first.a) == coefficients(c20=1e-4) and list(first.b) == coefficients(c03=-2) and rest == [None, None]


def test_samples_with_edges(spark):
    image = np.arange(12.0).reshape(3, 4) ** 2
    pixels = spark.createDataFrame([("a", y, x, None if (y, x) == (2, 3) else float(image[y, x])) for y in range(3) for x in range(4)], "k string, y int, x int, v double")
    image[2, 3] = 0  # a missing value counts as nothing
    places = [(-1.0, -1.0), (0.0, 0.0), (0.5, 1.25), (2.0, 3.0), (1.75, 2.5), (9.0, 1.0), (1.0, 9.0)]
    df = spark.createDataFrame([("a", k, *p) for k, p in enumerate(places)], "k string, n int, py double, px double")
    got = {r.n: r.sampled for r in align.sample_at(df, align.quads(pixels, ["k"]), ["k"], F.lit(3), F.lit(4)).collect()}
    for n, (py, px) in enumerate(places):
        py, px = min(max(py, 0), 2), min(max(px, 0), 3)
        y, x = int(py), int(px)
        y1, x1 = min(y + 1, 2), min(x + 1, 3)
        fy, fx = py - y, px - x
        assert np.isclose(got[n], (image[y, x] * (1 - fx) + image[y, x1] * fx) * (1 - fy) + (image[y1, x] * (1 - fx) + image[y1, x1] * fx) * fy)


def scene(shift, seed, size=64):
    """A field of round stars as an exposure sees it that is shifted by (dy, dx)."""
    rng = np.random.default_rng(5)
    stars = rng.uniform(2, size - 2, (60, 2))
    y, x = np.mgrid[:size, :size]
    image = sum(40 * np.exp(-0.5 * ((y - sy - shift[0]) ** 2 + (x - sx - shift[1]) ** 2) / 1.8) for sy, sx in stars)
    return image + np.random.default_rng(seed).normal(0, 0.2, (size, size))


def test_partner_channel_with_refinement(spark):
    """Three exposures: one right, one 0.6 pixel off where its coordinates say nothing of it (to be refined), one 2.5 pixels off (not to be)."""
    wcs = (10.0, 5.0, 32.0, 32.0, 1e-5, 0.0, 0.0, 1e-5)
    images = {"a": scene((0, 0), 1), "b": scene((0.6, -0.4), 2), "c": scene((2.4, 0.9), 3)}
    chips = spark.createDataFrame([(f, 1, 1, 64, 64, wcs, None) for f in images], KINDS)
    pixels = spark.createDataFrame([(f, 1, y, x, float(image[y, x])) for f, image in images.items() for y in range(64) for x in range(64)], "file string, ver int, y int, x int, v double")
    cells = align.quads(pixels, exposures.CHIP).withColumnRenamed("file", "partner")
    found = {(r.file, r.partner): (r.dy, r.dx, r.applied) for r in exposures.residual_shifts(exposures.pairs_of(chips, ["p"]), pixels, cells, crop=64).collect()}
    assert len(found) == 6 and found["a", "b"][2] and not found["a", "c"][2]
    assert np.allclose(found["a", "b"][:2], (0.6, -0.4), atol=0.15) and np.allclose(found["b", "a"][:2], (-0.6, 0.4), atol=0.15) and np.allclose(found["a", "c"][:2], (2.4, 0.9), atol=0.2)

    def sampled(image, dy, dx):
        y, x = np.clip(np.mgrid[:64, :64][0] + dy, 0, 63), np.clip(np.mgrid[:64, :64][1] + dx, 0, 63)
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        y1, x1 = np.minimum(y0 + 1, 63), np.minimum(x0 + 1, 63)
        fy, fx = y - y0, x - x0
        return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy

    plain = {(r.y, r.x): r for r in exposures.partner_channel(chips, pixels, ["p"]).where("file = 'a'").collect()}
    refined = {(r.y, r.x): r for r in exposures.partner_channel(chips, pixels, ["p"], refine=True, crop=64).where("file = 'a'").collect()}
    dy, dx, _ = found["a", "b"]
    assert len(plain) == len(refined) == 64 * 64
    for (y, x), r in plain.items():
        assert np.isclose(r.partner, (images["b"][y, x] + images["c"][y, x]) / 2) and r.covered == 2
    moved = (sampled(images["b"], dy, dx) + images["c"]) / 2
    assert all(np.isclose(r.partner, moved[y, x]) for (y, x), r in refined.items())
    alone = np.abs(sampled(images["b"], dy, dx) - images["a"])[8:-8, 8:-8].mean()
    assert alone < 0.5 * np.abs(images["b"] - images["a"])[8:-8, 8:-8].mean()


def test_partner_of_a_dithered_pair_covers_part(spark):
    here, there = (10.0, 5.0, 32.0, 32.0, 1e-5, 0.0, 0.0, 1e-5), (10.0, 5.0, 26.5, 32.0, 1e-5, 0.0, 0.0, 1e-5)
    chips = spark.createDataFrame([("a", 1, 1, 8, 8, here, None), ("b", 1, 1, 8, 8, there, None), ("alone", 1, 2, 8, 8, here, None)], KINDS)
    pixels = spark.createDataFrame([(f, 1, y, x, float(x * x + y)) for f in ("a", "b", "alone") for y in range(8) for x in range(8)], "file string, ver int, y int, x int, v double")
    got = {(r.file, r.y, r.x): (r.covered, r.partner) for r in exposures.partner_channel(chips, pixels, ["p"]).collect()}
    for y in range(8):
        for x in range(8):
            assert got["alone", y, x] == (0, x * x + y)
            covered = x - 5.5 >= 0
            assert got["a", y, x][0] == covered and np.isclose(got["a", y, x][1], ((x - 6) ** 2 + (x - 5) ** 2) / 2 + y if covered else x * x + y, atol=1e-6)


def test_places_in_runs_of_lines(spark):
    """Places of pairs by arrays, in runs of lines across chips of unlike sizes, against the plain computation; few pairs are spread over tasks."""
    chips = spark.createDataFrame([("a", 1, 1, 6, 5, A, SIP_A), ("b", 1, 1, 7, 9, B, SIP_B), ("bare", 1, 1, 3, 4, A, None), ("none", 1, 1, 3, 4, None, None)], KINDS)
    pairs = exposures.pairs_of(chips, ["p"]).withColumns({"sy": F.lit(0.25), "sx": F.lit(-0.5)})
    places = exposures.places_of(pairs, at_once=20)
    assert places.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r.file, r.partner, r.y, r.x): (r.px, r.py) for r in places.collect()}
    sides = {"a": (A, SIP_A, 6, 5), "b": (B, SIP_B, 7, 9), "bare": (A, None, 3, 4)}
    assert len(got) == sum(h * w * 2 for _, _, h, w in sides.values())
    for (f, p, y, x), at in got.items():
        assert np.allclose(at, pixel(*sides[p][:2], *sky(*sides[f][:2], x, y)) + (-0.5, 0.25), atol=1e-5)
    cut = {(r.file, r.partner, r.y, r.x) for r in exposures.places_of(pairs, 4).where("file = 'b' AND partner = 'a'").collect()}
    assert cut == {("b", "a", y, x) for y in range(1, 5) for x in range(2, 6)}
