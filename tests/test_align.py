"""Coordinates, resampling and shifts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import wcs
from skyframe.operators import align


def struct(ra=184.7, dec=47.3, x=2048.0, y=1024.0, roll=0.3, scale=1.4e-5):
    c, s = np.cos(roll) * scale, np.sin(roll) * scale
    return F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((ra, dec, x, y, -c, s, s, c), wcs.FIELDS)])


def test_pixels_to_sky_and_back(spark):
    df = spark.range(50).select((F.col("id") * 83.7).alias("x"), (F.col("id") * 41.1).alias("y")).withColumn("w", struct())
    sky = df.withColumn("s", wcs.pixel_to_sky(F.col("w"), F.col("x"), F.col("y")))
    back = sky.withColumn("p", wcs.sky_to_pixel(F.col("w"), F.col("s.ra"), F.col("s.dec")))
    assert back.agg(F.max(F.hypot(F.col("p.x") - F.col("x"), F.col("p.y") - F.col("y")))).first()[0] < 1e-6
    centre = spark.range(1).select(wcs.pixel_to_sky(struct(), F.lit(2047.0), F.lit(1023.0)).alias("s")).first().s
    assert centre.ra == pytest.approx(184.7) and centre.dec == pytest.approx(47.3)
    away = spark.range(1).select(wcs.sky_to_pixel(struct(), F.lit(4.7), F.lit(-47.3)).alias("p")).first().p
    assert away is None


def test_translation_and_overlap(spark):
    a, b = struct(roll=0.0), struct(roll=0.0, x=2038.0, y=1029.0)
    t = spark.range(1).select(wcs.translation(a, b, F.lit(100.0), F.lit(50.0)).alias("t"), wcs.overlap(a, b, 4096, 2048).alias("o"), wcs.overlap(a, struct(dec=50.0), 4096, 2048).alias("none")).first()
    assert (t.t.tx, t.t.ty) == (pytest.approx(-10, abs=1e-6), pytest.approx(5, abs=1e-6))
    assert (t.o.x0, t.o.y0) == (20, 5) and t.none is None


def test_resample_between_pixels(spark):
    image = np.random.default_rng(0).normal(size=(8, 9))
    px = spark.createDataFrame([(1, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(image)], "chip int, y int, x int, v double")
    places = px.select("chip", "y", "x", (F.col("y") + 0.25).alias("py"), (F.col("x") - 0.5).alias("px"))
    got = {(r.y, r.x): r.v for r in align.resample(places, px, ["chip"]).collect()}
    row = lambda y, x: (image[y, x - 1] + image[y, x]) / 2
    assert set(got) == {(y, x) for y in range(7) for x in range(1, 9)}
    assert all(v == pytest.approx(0.75 * row(y, x) + 0.25 * row(y + 1, x)) for (y, x), v in got.items())


def test_phase_shift_of_tiles(spark):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:64, :64]

    def sky(dy, dx):
        stars = np.random.default_rng(7).uniform(4, 60, (40, 2))
        return sum(np.exp(-((y - a - dy) ** 2 + (x - b - dx) ** 2) / 4.0) for a, b in stars)

    rows = [(k, sky(0, 0).ravel().tolist(), (sky(dy, dx) + rng.normal(scale=0.01, size=(64, 64))).ravel().tolist(), dy, dx) for k, (dy, dx) in enumerate([(0.0, 0.0), (1.3, -0.7), (-2.1, 2.4)])]
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>, ty double, tx double")
    got = {r.k: r for r in align.tile_shifts(df, ["k", "ty", "tx"], size=64).collect()}
    assert all(abs(r.dy - r.ty) < 0.15 and abs(r.dx - r.tx) < 0.15 for r in got.values())
