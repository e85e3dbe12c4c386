"""FITS round trips, catalogs, and streams."""

import json

import numpy as np
from pyspark.sql import functions as F

from skyframe.sources import catalogs, fits
from skyframe.streaming import ingest

HEADER = {
    "ROOTNAME": "j8r001s0q", "TARGNAME": "NGC4258-INNER", "RA_TARG": 184.6982916667, "DEC_TARG": 47.3385, "PROPOSID": 9810, "EXPTIME": 400.0, "POSTARG1": 0.0, "POSTARG2": 0.0, "FILTER1": "CLEAR1L", "FILTER2": "F814W",
    "DATE-OBS": "2003-12-05", "CD1_1": -4.4e-06, "CD1_2": -1.35e-05,
}


def test_fits_headers_and_pixels(spark, tmp_path):
    image = np.random.default_rng(0).normal(size=(7, 9)).astype("f4")
    image[2, 3] = np.nan
    (tmp_path / "ok" / "_excluded").mkdir(parents=True)
    (tmp_path / "ok" / "hst_9810_01_acs_wfc_f814w_j8r001s0_flc.fits").write_bytes(fits.encode_image(image, HEADER))
    (tmp_path / "ok" / "b_flc.fits").write_bytes(fits.encode_image(image, {k: v for k, v in HEADER.items() if k != "CD1_1"}))
    (tmp_path / "ok" / "_excluded" / "c_flc.fits").write_bytes(b"junk")
    (tmp_path / "ok" / "short_flc.fits").write_bytes(b"SIMPLE")
    files = fits.files(spark, str(tmp_path / "ok"))
    assert files.count() == 3
    heads = files.join(fits.headers(files), "path", "left")
    rows = fits.typed(heads).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.root, r.filter, r.proposid, r.naxis1, r.naxis2, r.date_obs) == ("j8r001s0", "F814W", 9810, 9, 7, "2003-12-05")
    for most in (fits.HEADER_BYTES, 2 * fits.BLOCK):  # only the ranges asked for, and the same headers
        ranges = fits.heads(spark, f"file://{tmp_path / 'ok'}", most=most)
        assert {x.path: (x.length, bytes(x.content)) for x in ranges.collect()} == {x.path: (x.length, bytes(x.content)[:most]) for x in files.collect()}
        assert fits.typed(ranges.join(fits.headers(ranges), "path", "left")).collect() == rows
    px = fits.image_pixels(fits.image_rows(files.where("path like '%j8r001s0%'"))).collect()
    got = np.full((7, 9), np.nan)
    for p in px:
        got[p.y, p.x] = np.nan if p.v is None else p.v
    assert np.array_equal(got.astype("f4"), image, equal_nan=True)


def test_catalogs(spark, tmp_path):
    groups = [{"galaxy": "X", "filter": "F814W", "chip": 1, "files": ["a", "b"], "n_exposures": 2}, {"galaxy": "Y", "filter": "F606W", "files": ["c"]}]
    (tmp_path / "pairs.json").write_text(json.dumps(groups, indent=1))
    (tmp_path / "offsets.json").write_text(json.dumps({"a": [0.5, -1.0], "z": [1, 2]}))
    catalog = catalogs.read_catalog(spark, str(tmp_path / "pairs.json"))
    files = catalogs.exposures(catalog)
    off = catalogs.read_offsets(spark, str(tmp_path / "offsets.json"))
    got = {r.file: (r.x, r.pos) for r in files.join(off, "file", "left").select("file", "pos", F.coalesce("off_x", F.lit(0.0)).alias("x")).collect()}
    assert got == {"a": (0.5, 0), "b": (0.0, 1), "c": (0.0, 0)}
    assert catalogs.subset(catalog, ["galaxy"], [1]).first().galaxy == "Y"
    catalogs.write_catalog(catalog, str(tmp_path / "out"))
    catalogs.write_catalog(catalog, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    catalogs.quarantine(files.select("file", F.lit("postarg").alias("reason")), str(tmp_path / "q"))
    assert (tmp_path / "q" / "reason=postarg").is_dir()
    assert catalogs.not_done(files, off, ["file"]).count() == 2


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.arrivals(spark, str(tmp_path / "in"), events.schema, 1)
    q = ingest.write_each(ingest.once(stream, "event_id", "ts", "3650 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    again = ingest.write_each(ingest.once(stream, "event_id", "ts", "3650 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    batch = ingest.rates(events, "ts", "value", window="1 day")
    assert batch.agg(F.sum("n")).first()[0] == events.count() and ingest.stalls(batch, 1e12).count() == batch.count()


def test_running_anchor_is_a_fold(spark, tmp_path):
    rows = [("a", float(v), i) for i, v in enumerate([0, 1, 2, 9, 10, 30])]
    df = spark.createDataFrame(rows, "k string, v double, i int").withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("i")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.arrivals(spark, str(tmp_path / "in"), df.schema)
    q = ingest.running_anchor(stream, "k", "v", "ts", 5.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.value, r.cluster) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0.0, 1), (1.0, 1), (2.0, 1), (9.0, 2), (10.0, 2), (30.0, 3)]
