"""Image operators against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.operators import images as I
from skyframe.operators import stats as S


def frame(spark, image, **columns):
    rows = [(int(y), int(x), None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(image)]
    df = spark.createDataFrame(rows, "y int, x int, v double").withColumn("chip", F.lit(1))
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def grid(df, value, shape, y="y", x="x"):
    out = np.full(shape, np.nan)
    for r in df.select(y, x, value).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(3).normal(size=(12, 14))


def test_max_filter(spark, image):
    got = grid(I.max_filter(frame(spark, image), ["chip"], 2), "box_max", image.shape)
    want = np.array([[image[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].max() for x in range(14)] for y in range(12)])
    assert np.allclose(got, want)


def test_constant_image_is_all_maxima_and_has_no_scatter(spark):
    flat = frame(spark, np.ones((6, 6)))
    assert I.local_maxima(flat, ["chip"], 1, 0, 6, 6, F.lit(0.5)).count() == 36
    assert S.clipped_median(flat, ["chip"], "v").first().asDict() == {"chip": 1, "n_used": 36, "med": 1.0, "sigma": 0.0}


def test_clipped_median_narrowing_and_not(spark):
    v = np.concatenate([np.random.default_rng(0).normal(size=200), [30.0, 50.0, -40.0]])

    def loop(narrow):
        live = np.ones(len(v), bool)
        for _ in range(5):
            m = np.median(v[live])
            s = 1.4826 * np.median(np.abs(v[live] - m))
            if s == 0:
                break
            inside = np.abs(v - m) < 3 * s
            live = live & inside if narrow else inside
        return live.sum(), np.median(v[live])

    df = spark.createDataFrame([(1, float(x)) for x in v], "chip int, v double")
    for narrow in (True, False):
        got = S.clipped_median(df, ["chip"], "v", narrowing=narrow).first()
        n, m = loop(narrow)
        assert got["n_used"] == n and got["med"] == pytest.approx(m)


def test_median_fill_mirrors_and_grows(spark, image):
    bad = np.zeros(image.shape, bool)
    bad[0, 0] = bad[5, 5] = True
    bad[6:11, 6:11] = True
    df = frame(spark, image)
    marks = spark.createDataFrame([(int(y), int(x), True) for y, x in zip(*np.nonzero(bad))], "y int, x int, bad boolean")
    got = grid(I.median_fill(df.join(marks, ["y", "x"], "left"), ["chip"], "bad", 1, 3, 12, 14), "v", image.shape)
    want, left = image.copy(), bad.copy()
    for _ in range(3):
        padded, mask = np.pad(want, 1, mode="reflect"), np.pad(left, 1, mode="reflect")
        filled = []
        for y, x in zip(*np.nonzero(left)):
            good = padded[y : y + 3, x : x + 3][~mask[y : y + 3, x : x + 3]]
            if len(good):
                filled.append((y, x, np.median(good)))
        for y, x, m in filled:
            want[y, x], left[y, x] = m, False
    assert np.allclose(got, want)


def test_components_match_flood_fill(spark):
    mask = np.random.default_rng(5).random((16, 16)) < 0.55
    pts = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(mask))], "chip int, y int, x int")
    got = {(r.y, r.x): (r.label_y, r.label_x) for r in I.label_components(pts, ["chip"]).collect()}
    want, seen = {}, set()
    for start in sorted(map(tuple, np.argwhere(mask).tolist())):
        if start in seen:
            continue
        todo, part = [start], []
        seen.add(start)
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n not in seen and 0 <= n[0] < 16 and 0 <= n[1] < 16 and mask[n]:
                    seen.add(n)
                    todo.append(n)
        want |= {p: min(part) for p in part}
    assert got == want


def test_tall_components_get_one_label(spark):
    column = [(1, y, 3) for y in range(300)]
    stairs = [(2, y, y + d) for y in range(300) for d in (0, 1)]
    fork = [(2, y, x) for x in (700, 702) for y in range(200)] + [(2, 199, 701)]
    pts = spark.createDataFrame(column + stairs + fork, "chip int, y int, x int")
    got = {(r.chip, r.y, r.x): (r.label_y, r.label_x) for r in I.label_components(pts, ["chip"]).collect()}
    want = {p: (0, 3) for p in column} | {p: (0, 0) for p in stairs} | {p: (0, 700) for p in fork}
    assert got == want


def test_shift_and_drizzle_keep_flux(spark, image):
    df = frame(spark, image)
    got = grid(I.shift_bilinear(df, ["chip"], 0.25, 0.5), "v", image.shape)
    want = 0.75 * (image[:-1, :-1] + image[:-1, 1:]) / 2 + 0.25 * (image[1:, :-1] + image[1:, 1:]) / 2
    assert np.allclose(got[:-1, :-1], want)
    dropped = I.drizzle(df.withColumns({"dy": F.lit(0.3), "dx": F.lit(-0.2), "w": F.lit(2.0)}), ["chip"], scale=1.0, dy="dy", dx="dx", weight="w", pixfrac=0.8)
    total = dropped.agg(F.sum(F.col("v") * F.col("weight")), F.sum("weight")).first()
    assert total[0] == pytest.approx(2 * 0.64 * image.sum()) and total[1] == pytest.approx(2 * 0.64 * image.size)


def test_smooth_and_lowpass(spark, image):
    r = 8
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / 2.0) ** 2)
    got = grid(I.lowpass(frame(spark, image), ["chip"], 2.0), "low", image.shape)
    padded, ones = np.pad(image, r), np.pad(np.ones(image.shape), r)
    box = lambda a, y, x: (a[y : y + 2 * r + 1, x : x + 2 * r + 1] * w[:, None] * w[None, :]).sum()
    assert np.allclose(got, [[box(padded, y, x) / box(ones, y, x) for x in range(14)] for y in range(12)])
    profile = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(image[0])], "chip int, b int, p double")
    got = {x.b: x.p_smooth for x in I.smooth(profile, ["chip"], "b", "p", 2.0).collect()}
    near = np.pad(image[0], r, mode="edge")
    assert np.allclose([got[i] for i in range(14)], [(near[i : i + 2 * r + 1] * w).sum() / w.sum() for i in range(14)])


def test_destripe_takes_row_offsets_away(spark):
    rng = np.random.default_rng(1)
    image = rng.normal(scale=0.05, size=(24, 40)) + rng.normal(size=(24, 1))
    df = frame(spark, image)
    before = I.stripe_metric(df, ["chip"], 1e9).first()["stripe"]
    after = I.stripe_metric(I.destripe(df, ["chip"], detrend=200.0, least=5), ["chip"], 1e9).first()["stripe"]
    assert after < 0.25 * before


def test_augment_is_numpy(spark):
    image = np.arange(16.0).reshape(4, 4)
    for fy, fx, t in ((False, False, 1), (True, False, 3), (False, True, 2), (True, True, 0)):
        got = grid(I.augment(frame(spark, image), 4, 4, flip_y=F.lit(fy), flip_x=F.lit(fx), turns=F.lit(t)), "v", (4, 4))
        want = image[::-1] if fy else image
        want = want[:, ::-1] if fx else want
        assert (got == np.rot90(want, t)).all()


def test_stack_mean_takes_one_sided_outliers_away(spark):
    rng = np.random.default_rng(2)
    stack = rng.normal(1.0, 0.01, size=(5, 6, 6))
    stack[2, 3, 3] += 10
    df = None
    for k, image in enumerate(stack):
        one = frame(spark, image).withColumn("file", F.lit(k))
        df = one if df is None else df.unionByName(one)
    got = grid(I.stack_mean(df, ["chip"], "file"), "v", (6, 6))
    assert abs(got[3, 3] - 1) < 0.05
    two = df.where("file in (1, 2)")
    assert grid(I.stack_mean(two, ["chip"], "file"), "v", (6, 6))[3, 3] == pytest.approx(stack[1, 3, 3])


def test_source_mask_grows_by_a_diamond(spark):
    image = np.random.default_rng(0).normal(scale=0.01, size=(15, 15))
    image[7, 7] = 5
    got = {(r.y, r.x) for r in I.source_mask(frame(spark, image), ["chip"], k=6).where("masked").collect()}
    assert {(7 + dy, 7 + dx) for dy, dx in I.diamond(2)} == got


def test_tiles(spark, image):
    got = I.to_tiles(frame(spark, image[:8, :8]), ["chip"], 4).orderBy("ty", "tx").collect()
    assert len(got) == 4 and np.allclose(got[1]["data"], image[:4, 4:8].ravel(), atol=1e-6)
    assert I.tile_scale(frame(spark, image[:3, :3]), ["chip"], 4, 3, 3).count() == 0
