"""Curation, quality, production and sample plans on hand-written records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import exprs as E
from skyframe.functions import names as N
from skyframe.operators import catalog as C
from skyframe.plans import curation, production, qc, samples

RECORD = "file string, size long, root string, rootname string, targname string, proposid int, filter string, exptime double, ra_targ double, dec_targ double, postarg1 double, postarg2 double, date_obs string, cd_angle double"


def record(name, dec, roll=0.0, post=0.0, date="2003-01-01", rootname=None):
    return (f"/d/X/F814W/{name}", 1000, name[:8], rootname or name, "X", 1, "F814W", 400.0, 10.0, dec, post, 0.0, date, roll)


@pytest.fixture(scope="module")
def records(spark):
    step = 6 / 3600  # a chain: neighbours are near, the ends are not
    rows = [
        record("hst_1_01_acs_wfc_f814w_aaaa_flc.fits", 1.0, rootname="aaaa"), record("aaaa_flc.fits", 1.0, rootname="aaaa"),
        record("b_flc.fits", 1.0 + step, date="2003-01-02"), record("c_flc.fits", 1.0 + 2 * step, roll=0.3), record("d_flc.fits", 5.0),
        record("e_flc.fits", 1.0, post=10.0), record("f_flc.fits", 1.0, post=10.5),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_curate_keeps_or_rejects_every_file(spark, records):
    catalog, rejects = curation.curate(records)
    reasons = {N_(r.file): r.reason for r in rejects.collect()}
    assert reasons == {"aaaa_flc.fits": "doublon", "f_flc.fits": "postarg", "d_flc.fits": "groupe_trop_petit"}
    rows = catalog.collect()
    assert [(r.n_exposures, r.n_pairs) for r in rows] == [(4, 6)]  # the first by name stands in the middle of the chain
    assert sum(r.n_exposures for r in rows) + len(reasons) == records.count()


def N_(path):
    return path.rsplit("/", 1)[-1]


def test_anchor_and_complete_groups_differ_on_a_chain(records):
    some = records.where("rootname in ('b_flc.fits', 'c_flc.fits', 'aaaa')").where("file not like '%/aaaa%'")
    anchored = curation.group_by_pointing(some, order=("dec_targ",)).groupBy("run", "group_no").count()
    assert sorted(r["count"] for r in anchored.collect()) == [1, 2]
    rolled = curation.group_complete(some, order=("dec_targ",), roll=0.1).groupBy("run", "group_no").count()
    assert sorted(r["count"] for r in rolled.collect()) == [1, 2]
    middle_first = some.withColumn("k", F.when(F.col("rootname") == "b_flc.fits", 0).otherwise(1))
    assert curation.group_by_pointing(middle_first, order=("k", "file")).groupBy("run", "group_no").count().count() == 1
    assert curation.group_complete(middle_first, order=("k", "file"), roll=9.0).groupBy("run", "group_no").count().count() == 2


def test_near_pairs_match_all_pairs(records):
    got = {(N_(r.file_a), N_(r.file_b)) for r in curation.near_pairs(records).collect()}
    rows = records.collect()
    want = {tuple(sorted((N_(a.file), N_(b.file)))) for a in rows for b in rows if a.file < b.file and abs(a.dec_targ - b.dec_targ) * 3600 < 10}
    assert {tuple(sorted(p)) for p in got} == want


def test_names(spark):
    df = spark.createDataFrame(
        [("/d/NGC_1/F814W/hst_9810_01_acs_wfc_f814w_j8r001s0_flc.fits", "CLEAR1L", "F814W"), ("/d/NGC_1/F606W/J8R001S0Q_flc.fits", "F606W", "CLEAR2L"), ("x", "", None)], "p string, a string, b string"
    )
    rows = df.select(
        N.root8(F.col("p")).alias("root"), N.filter_first_clear(F.col("a"), F.col("b")).alias("f1"), N.filter_second_if_clear(F.col("a"), F.col("b")).alias("f2"), N.visit(F.col("p"), True).alias("v"),
        N.galaxy_from_path(F.col("p")).alias("g"), N.chip_path(F.col("p"), 2).alias("c"),
    ).collect()
    assert [r.root for r in rows] == ["j8r001s0", "j8r001s0", "x"]
    assert [r.f1 for r in rows] == ["F814W", "F606W", "UNKNOWN"] and [r.f2 for r in rows][:2] == ["F814W", "F606W"]
    assert [r.v for r in rows] == ["9810_01", "?", "?"] and rows[0].g == "NGC 1" and rows[0].c.endswith("_flc_chip2.fits")


def test_expressions(spark):
    row = spark.range(1).select(
        E.psnr(F.lit(0.01)).alias("psnr"), E.psnr(F.lit(0.0)).alias("inf"), E.pixel_snap(F.lit(2.5)).alias("snap"), E.ordinal_day(F.lit("2003-12-05")).alias("day"), E.rate(F.lit(6.0), F.lit(0)).alias("rate"),
        E.asinh_restore(E.asinh_stretch(F.lit(3.0), F.lit(0.7)), F.lit(0.7)).alias("back"), E.is_gradient(F.lit(None).cast("double"), F.lit(0.1)).alias("grad"), E.tier(F.lit(30.0), [10, 30, 100]).alias("tier"),
        E.separation_arcsec(F.lit(10.0), F.lit(60.0), F.lit(10.001), F.lit(60.0)).alias("sep"), E.no_nan(F.lit(float("nan"))).alias("zero"), E.wiener(F.lit(1.0), F.lit(0.0), F.lit(10)).alias("w"),
    ).first()
    import datetime

    assert row.psnr == pytest.approx(20) and row.inf == float("inf") and row.snap == 2 and row.day == datetime.date(2003, 12, 5).toordinal()
    assert row.rate == 6 and row.back == pytest.approx(3) and row.grad is False and row.tier == 1 and row.sep == pytest.approx(1.8) and row.zero == 0 and row.w == 1


def test_upsert_and_budget(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    assert {(r.k, r.v) for r in C.upsert(a, b, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "b")}
    sizes = spark.createDataFrame([(i, 10) for i in range(30)], "k int, size int")
    assert [r.k for r in C.budget_prefix(sizes, ["k"], "size", 95).orderBy("k").collect()] == list(range(9))


def test_tightest_window_of_small_groups_is_whole(spark):
    df = spark.createDataFrame([("a", i, d) for i, d in enumerate([0, 50, 51, 52, 200])] + [("b", 1, 1), ("b", 2, 900)], "g string, i int, day int")
    got = C.tightest_window(df, ["g"], ["day", "i"], "day", 3).collect()
    assert sorted(r.day for r in got if r.g == "a") == [50, 51, 52] and len([r for r in got if r.g == "b"]) == 2


def test_units_and_pair_rules(spark):
    rows = [("g", i, f"f{i}", roll, 400.0, 1.0, f"r{i}") for i, roll in enumerate([0.0, 0.05, 0.1, 0.15, 0.9])]
    ex = spark.createDataFrame(rows, "group string, pos int, file string, cd_angle double, exptime double, sky double, root string")
    kept, census = qc.units(ex)
    assert {r.file for r in kept.collect()} == {"f0", "f1", "f2"}
    assert {(r.size, r.clusters, r.used) for r in census.collect()} == {(3, 1, True), (1, 2, False)}
    rules = qc.pair_rules(ex)
    assert rules.where("valid").count() == sum(abs(a[3] - b[3]) <= 0.1 for i, a in enumerate(rows) for b in rows[i + 1 :])


def test_clusters_of_one_long_run_are_a_fold(spark):
    rng = np.random.default_rng(1)
    # key 1 has no gap at all, key 2 has steps at which rounding decides, key 3 has gaps, key 4 odd values, and a null value is left out
    sets = {1: np.round(np.arange(4000) * 0.3, 1), 2: np.round(np.arange(-60, 60) * 0.1, 1), 3: rng.uniform(-300, 300, 200), 4: np.array([-np.inf, 0.0, 0.5, np.inf, np.nan])}
    rows = [(k, i, float(v)) for k, x in sets.items() for i, v in enumerate(np.concatenate([x, x[:3]]))]
    df = spark.createDataFrame([*rows, (3, -1, None)], "k int, i int, v double")
    for tolerance, at_once in ((0.6, 1000), (0.3, 0), (5.0, 0), (5.0, 10_000), (0.0, 0)):
        want = []
        for k in sets:
            anchor, cluster, of = None, 0, {}
            for v in sorted({r[2] for r in rows if r[0] == k and r[2] == r[2]}):
                if anchor is None or v - anchor > tolerance:
                    anchor, cluster = v, cluster + 1
                of[v] = (anchor, cluster)
            want += [(k, i, *(of[v] if v == v else ("nan", cluster + 1))) for g, i, v in rows if g == k]
        got = [(r.k, r.i, r.anchor if r.anchor == r.anchor else "nan", r.cluster) for r in C.anchor_clusters(df, ["k"], "v", tolerance, "i", at_once=at_once).collect()]
        assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert C.anchor_clusters(df.limit(0), ["k"], "v", 1.0, "i").count() == 0


def test_greedy_groups_by_rounds_are_those_of_the_fold(spark):
    rng = np.random.default_rng(2)
    # key 1 has ids without order, key 2 ids that follow the values, key 3 steps of the tolerance itself, key 4 odd values
    sets = {1: rng.uniform(-40, 40, 1500).round(2), 2: np.arange(0, 6, 0.25), 3: rng.permutation(np.arange(-20, 20) * 0.1), 4: np.array([0.0, -0.0, 0.3, np.inf, -np.inf, np.nan, 0.3])}
    rows = [(k, 100_000 * k + i, float(v)) for k, x in sets.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (4, -1, None)], "k int, id int, x double")
    for tolerance, choices in ((1.0, (1000, 10_000)), (0.1, (0,))):
        want = []
        for k in sets:
            starts: list[tuple[int, float]] = []
            for _, i, v in (r for r in rows if r[0] == k and np.isfinite(r[2])):
                at = next((j for j, s in starts if abs(s - v) < tolerance), i)
                starts += [(i, v)] if at == i else []
                want.append((k, i, at))
        for at_once in choices:
            got = [(r.k, r.id, r.anchor_id) for r in C.anchor_groups(df, ["k"], "id", "x", tolerance, at_once=at_once).collect()]
            assert sorted(got) == sorted(want)
    assert C.anchor_groups(df.limit(0), ["k"], "id", "x", 1.0).count() == 0


def test_misalignment_has_a_total(spark):
    df = spark.createDataFrame([("a", i, float(x), 0.0) for i, x in enumerate([0, 0.05, 0.6])] + [("b", 0, 0.0, 0.0), ("b", 1, 2.0, 0.0)], "group string, pos int, off_x double, off_y double")
    rows = {r.group: r for r in qc.pair_misalignment(df).collect()}
    assert rows["TOTAL"].n_pairs == 4 and rows["TOTAL"].bin0 == 1 and rows["TOTAL"].bin4 == 1 and rows["a"].bin3 == 2


def test_plane_recovers_a_gradient(spark):
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0, 100, 300), rng.uniform(0, 100, 300)
    v = 1 + 0.02 * x - 0.01 * y + rng.normal(scale=0.01, size=300)
    v[:3] += 50
    df = spark.createDataFrame([("g", float(a), float(b), float(c)) for a, b, c in zip(x, y, v)], "group string, x double, y double, dx double")
    got = qc.robust_plane(df, ["group"], "dx").first()
    assert got.slope_x == pytest.approx(0.02, abs=1e-3) and got.slope_y == pytest.approx(-0.01, abs=1e-3) and got.ptp > 5 * got.err and got.n < 300


def pixels(spark, image, **more):
    rows = [("t", int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(image)]
    df = spark.createDataFrame(rows, "chip string, y int, x int, v double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()}) if more else df


def test_cosmic_ray_goes_and_star_stays(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(scale=1, size=(24, 24)), rng.normal(scale=1, size=(24, 24))
    for image in (a, b):
        image[6, 6] += 300
    a[15, 15] += 300
    got = production.clean(pixels(spark, a), pixels(spark, b), ["chip"])
    values = {(r.y, r.x): r.v for r in got.collect()}
    assert values[6, 6] > 250 and abs(values[15, 15]) < 5 and len(values) == 576


def test_denoise_blends_and_leaves_uncovered_pixels(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(10, 10)), rng.normal(size=(10, 10))
    partner = pixels(spark, b).where("x < 8")
    got = {(r.y, r.x): r for r in production.denoise(pixels(spark, a), partner, ["chip"], alpha=0.9).collect()}
    assert got[3, 9].v == pytest.approx(a[3, 9]) and got[3, 9].covered == 0
    inner = np.array([[got[y, x].v for x in range(8)] for y in range(10)])
    assert inner.std() < 0.85 * a[:, :8].std()


def test_mosaic_leaves_flagged_pixels_out(spark):
    a = np.full((6, 6), 5.0)
    a[2, 2] = 1000
    df = pixels(spark, a, exposure="e1", dq=0, exptime=100.0, dy=0.0, dx=0.0).withColumn("dq", F.when((F.col("y") == 2) & (F.col("x") == 2), 4).otherwise(16))
    got = production.mosaic(df, ["chip"], ["exposure"])
    assert got.where("oy = 2 AND ox = 2").count() == 0 and got.agg(F.max(F.abs("v"))).first()[0] == pytest.approx(0)


def test_samples_fit_and_have_no_zeros(spark):
    units = spark.createDataFrame([(u, f"{u}-{i}") for u in ("u1", "u2", "u3") for i in range(5)], "unit string, file string")
    boxes = spark.createDataFrame([(f"{u}-{i}", i, 0, 20 + i, 20) if u != "u3" else (f"{u}-{i}", 0, 0, 5, 5) for u in ("u1", "u2", "u3") for i in range(5)], "file string, y0 int, x0 int, y1 int, x1 int")
    drawn = samples.draw(units, samples=2, attempts=3)
    corners = samples.positions(drawn, boxes, 8)
    assert {r.unit for r in corners.collect()} == {"u1", "u2"} and corners.count() == 4
    px = units.select("file").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("v", (F.xxhash64("file", "y", "x") % 1000) / 100.0)
    cut = samples.patches(drawn, corners, px, 8)
    assert cut.groupBy("unit", "sample", "file").count().select(F.min("count"), F.max("count")).first() == (64, 64)
    turned = samples.augmented(cut, 8)
    assert turned.groupBy("unit", "sample", "file", "y", "x").count().where("count > 1").count() == 0
    assert samples.targets(cut).groupBy("unit", "sample").count().where("count <> 64").count() == 0


def test_best_epoch(spark):
    df = spark.createDataFrame([("r", 1, 0.5, 8), ("r", 1, 0.3, 8), ("r", 2, 0.2, 8), ("r", 3, 0.2, 8)], "run string, epoch int, loss double, n int")
    assert samples.best_epoch(df).first().epoch == 2


def test_product_plans(spark):
    products = spark.createDataFrame([("a", "hst_a_flc.fits", "FLC"), ("a", "hst_a_flt.fits", "FLT"), ("b", "hst_b_flt.fits", "FLT"), ("b", "x_drc.fits", "DRC")], "obs_id string, productFilename string, productSubGroupDescription string")
    got = curation.products_of(products, products.select("obs_id"))
    assert {(r.obs_id, r.productSubGroupDescription) for r in got.collect()} == {("a", "FLC"), ("b", "FLT")}
    listing = spark.createDataFrame([("t", "a_flc.fits"), ("t", "b_flc.fits"), ("t", "c_drc.fits"), ("u", "a_flc.fits")], "target string, name string")
    assert {(r.target, r.status) for r in curation.ready_targets(listing).collect()} == {("t", "ready"), ("u", "SKIP")}
