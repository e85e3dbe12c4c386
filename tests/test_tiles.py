"""Points and pixels that meet in tiles, against plain loops; no pixel is in a join."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe import queries_files
from skyframe.operators import stats as S
from skyframe.operators import tiles
from skyframe.plans import offsets

KEYS = ["group", "file"]


def plain_centre(image, y, x):
    near = [(image[y + dy, x + dx], y + dy, x + dx) for dy in range(-3, 4) for dx in range(-3, 4) if image.get((y + dy, x + dx)) is not None]
    if not near:
        return None
    ordered = sorted((v for v, _, _ in near), key=lambda v: (math.isnan(v), v))
    mid = 0.5 * ordered[(len(near) - 1) // 2] + 0.5 * ordered[len(near) // 2]
    weights = [v - mid if math.isnan(v - mid) or v > mid else 0.0 for v, _, _ in near]
    whole = sum(weights)
    return None if whole == 0 else tuple(sum(w * p[k] for w, p in zip(weights, near, strict=True)) / whole for k in (1, 2))


@pytest.mark.parametrize("made", [False, True])
def test_centres_across_borders(spark, made):
    """Tiles of 16, so boxes cross their borders; pixels that are missing, null, undefined or at negative places; as rows, and made from sources."""
    rng = np.random.default_rng(3)
    points = {(f, int(y), int(x)) for f in "ab" for y, x in rng.integers(-20, 50, (60, 2))}
    if made:
        sources = [("g", f, int(y), int(x), float(a), k) for f in "ab" for k, (y, x, a) in enumerate(zip(rng.integers(-20, 50, 40), rng.integers(-20, 50, 40), rng.uniform(1, 9, 40), strict=True))]
        images = {f: {} for f in "ab"}
        for _, f, y, x, a, _ in sources:
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    images[f][y + dy, x + dx] = images[f].get((y + dy, x + dx), 0.0) + a / (1 + abs(dy) + 2 * abs(dx))
        df = spark.createDataFrame(sources, "group string, file string, y int, x int, a double, k int")
        light = tiles.Sources(df, 2, ["k"], lambda y, x, s: s["a"] / (1 + abs(y - s["y"]) + 2 * abs(x - s["x"])))
    else:
        images = {f: {(y, x): float(rng.normal()) for y in range(-24, 54) for x in range(-24, 54) if rng.random() < 0.9} for f in "ab"}
        for f in "ab":
            for place in list(images[f])[::50]:
                images[f][place] = None
            images[f][5, 5] = math.nan
        rows = [("g", f, y, x, v) for f in "ab" for (y, x), v in images[f].items()] + [(None, "a", 0, 0, 1.0)]
        light = tiles.Pixels(spark.createDataFrame(rows, "group string, file string, y int, x int, v double"))
    want = {p: c for p in points if (c := plain_centre(images[p[0]], *p[1:]))}
    df = spark.createDataFrame([("g", *p) for p in points] + [(None, "a", 0, 0)], "group string, file string, y int, x int")
    got = {(r.file, r.y, r.x): (r.cy, r.cx) for r in tiles.centroid(df, KEYS, light, size=16).collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[p], want[p], equal_nan=True) for p in want) and (made or any(math.isnan(c[0]) for c in want.values()))


def test_pixels_are_in_no_join(spark, data, monkeypatch):
    """Few bytes of stars make very many places about them, which Spark took for small and sent through the driver."""
    plans, keep = [], queries_files.Scratch.keep
    monkeypatch.setattr(queries_files.Scratch, "keep", lambda self, df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df, *more))
    queries_files.two_pass_offsets(spark, data)
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line or "Broadcast" in line]
    assert joins and not any(re.search(r"\b_y#", line) for line in joins)


def test_clipping_is_that_of_stats(spark):
    rng = np.random.default_rng(6)
    groups = {k: np.round(rng.normal(0, 1, rng.integers(1, 30)), int(rng.integers(0, 4))) for k in range(60)}
    groups |= {60: np.array([1.0, 1.0, 1.0, 9.0]), 61: np.array([math.nan, 1.0, 2.0]), 62: np.array([math.nan]), 63: np.array([0.0, 0.0, 5.0, 1e-7])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k int, x double")
    want = {r.k: (r.n_used, r.med, r.sigma) for r in S.clipped_median(df, ["k"], "x", k=3.0, rounds=4, floor=1e-6, narrowing=False).collect()}
    got = {k: c for k, v in groups.items() if (c := offsets.clipped(v, 3.0, 4, 1e-6))[0]}
    assert {k: tuple(map(float, c)) for k, c in got.items()} == {k: tuple(map(float, c)) for k, c in want.items()}


def test_exposures_of_nothing(spark):
    none = spark.createDataFrame([], "group string, file string, rx double, ry double")
    assert offsets._middle(none, 3.0, 4).withColumn("one", F.lit(1)).count() == 0
