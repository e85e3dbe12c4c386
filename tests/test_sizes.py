"""What larger tables show: boundaries that only many rows meet, and plans that have to stay spread."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from skyframe import queries_files, queries_images, queries_records  # noqa: F401
from skyframe.operators import catalog as C
from skyframe.operators import images as I
from skyframe.operators import stats as S
from skyframe.plans import curation
from skyframe.queries import QUERIES, SQL
from skyframe.sources import fits


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_on_the_limit(spark, tmp_path):
    """Places whose distance in arcseconds is the limit, or a hair under it, as the differences of decimals are."""
    values = [round(-5 + 0.01 * k, 2) for k in range(1000)]
    rows = [(50 * i, 1, v) for i, v in enumerate(values)] + [(50 * (i + 1000), 1, round(v + 36, 2)) for i, v in enumerate(values)]
    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/*.parquet'")
    want = {tuple(r) for r in con.execute(SQL["near_pairs"]).fetchall()}
    assert {tuple(r) for r in QUERIES["near_pairs"](spark, str(tmp_path)).collect()} == want


def test_band_join_is_spread(spark):
    """Few bytes, but many pairs: neither side is broadcast, and the join runs in as many tasks as the session has partitions."""
    rows = spark.range(4000).select((F.col("id") % 2).alias("k"), F.col("id"), (F.col("id") % 100).cast("double").alias("v"))
    side = lambda s: rows.select("k", F.col("id").alias(f"id_{s}"), F.col("v").alias(f"v_{s}"))
    out = C.band_join(side("a"), side("b"), ["k"], "v_a", "v_b", 1.0)
    assert out.count() == 4000 * 40
    assert "Broadcast" not in plan_of(out)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_band_join_of_repeated_values(spark):
    """Thousands of rows of one value, zeros of both signs, rows without a value and undefined or infinite ones, against all pairs."""
    rng = random.Random(8)
    odd = [0.0, -0.0, None, math.nan, math.inf, -math.inf, 0.5, -0.25, 1.0]
    rows = {s: [("k", i, 3.0) for i in range(n)] + [(rng.choice("kl"), 5000 + i, rng.choice(odd)) for i in range(300)] + [("l", 6000 + i, rng.uniform(-3, 3)) for i in range(100)] for s, n in (("a", 2500), ("b", 7))}
    side = lambda s: spark.createDataFrame(rows[s], f"k string, id_{s} int, v_{s} double")
    got = C.band_join(side("a"), side("b"), ["k"], "v_a", "v_b", 1.0, F.col("id_a") != F.col("id_b"), {"gap": F.col("v_a") - F.col("v_b")})
    assert got.columns == ["k", "id_a", "v_a", "id_b", "v_b", "gap"]
    want = [(k, i, x, j, y, x - y) for k, i, x in rows["a"] for h, j, y in rows["b"] if k == h and i != j and x is not None and y is not None and abs(x - y) < 1]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_band_join_leaves_in_runs(spark, tmp_path):
    """The pairs' number is quadratic, so their bytes count: rows of one value and their distance stand in runs."""
    rows = spark.range(3000).select(F.lit("k").alias("k"), F.col("id"), (F.hash("id") % 5 / 10.0).alias("v"))
    side = lambda s: rows.select("k", F.col("id").alias(f"id_{s}"), F.col("v").alias(f"v_{s}"))
    out = C.band_join(side("a"), side("b"), ["k"], "v_a", "v_b", 1.0, F.col("id_a") < F.col("id_b"))
    out.select("id_a", "id_b", F.abs(F.col("v_a") - F.col("v_b")).alias("gap")).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000 * 2999 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 3000 * 2999 // 2


def test_detail_score_broadcasts_no_pixels(spark, data):
    """Pixels come from arrays, whose files' bytes tell nothing of their number."""
    assert "Broadcast" not in plan_of(QUERIES["detail_score"](spark, data))


def test_median_fill_broadcasts_no_pixels(spark, tmp_path):
    pixels = spark.range(64).select(F.lit("f").alias("file"), F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.col("id").cast("double").alias("v"), (F.col("id") % 5 == 0).alias("bad"))
    pixels.write.parquet(str(tmp_path / "px"))
    filled = I.median_fill(spark.read.parquet(str(tmp_path / "px")), ["file"], "bad", 2, 1, 8, 8)
    assert filled.where("NOT unfilled").count() == 64 and "Broadcast" not in plan_of(filled)


def test_brackets_leave_rows_where_they_lie(spark):
    """The rows of a few large groups are not dealt by group: that sends each group to one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the groups' figures were thought large, which they are on large tables
    try:
        got = S.selected_percentile(spark.range(1000).withColumn("k", F.col("id") % 2), ["k"], F.col("id"), 0.5)
        assert {(r.k, r.p) for r in got.collect()} == {(0, 499.0), (1, 500.0)} and "SortMergeJoin" not in plan_of(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clipping_few_groups_leaves_rows_where_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
        got = S.clipped_median(rows, ["k"], "v", rounds=1, few_groups=True)
        assert "SortMergeJoin [k" not in plan_of(got.select("med")) or plan_of(got).count("SortMergeJoin") <= 1  # groups' figures, a row each, may meet so
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_complete_groups_of_many_places(spark):
    """Thousands of places in a run, against a plain fold; a fold over arrays of structs takes minutes for these."""
    rng = random.Random(5)
    rows = [(i, "a", f"r{i:05}", rng.choice([10.0, 10.0, 10.0 + rng.random() * 4e-3]), rng.random() * 5e-3, rng.randrange(40) / 100.0) for i in range(6000)]
    df = spark.createDataFrame(rows, "file int, filter string, root string, ra_targ double, dec_targ double, cd_angle double").withColumn("date_obs", F.lit("d"))
    got = {r.file: r.group_no for r in curation.group_complete(df).collect()}
    groups, want = [], {}
    ra, dec, angle = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
    for i in range(len(rows)):
        for g, m in enumerate(groups):
            if np.all(np.hypot((ra[i] - ra[m]) * np.cos(np.radians(dec[m])) * 3600, (dec[i] - dec[m]) * 3600) < 10) and np.all(np.abs(angle[m] - angle[i]) <= 0.1):
                break
        else:
            g = len(groups)
            groups.append([])
        groups[g].append(i)
        want[i] = g
    assert got == want


def test_fits_batches_are_bounded(spark):
    """A batch of 10,000 files, as Spark makes them by itself, is over 100 MB in each Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    chips = spark.range(130).select(F.concat(F.lit("f"), F.col("id")).alias("path"), F.array_repeat(F.lit(1.0), 64).alias("data"))
    rows = fits.image_rows(fits.encode_images(chips, "path", "data", 8, {}, {}))
    assert rows.count() == 130 * 8
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
