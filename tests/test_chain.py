"""Chains from files to files: one channel, and cleaning as files arrive."""

import numpy as np
from pyspark.sql import functions as F
from test_fits_source import made

from skyframe.plans import exposures
from skyframe.sources import fits_source as FS
from skyframe.streaming import ingest


def image_of(rows, file, ver, name="v"):
    found = {(r.y, r.x): r[name] for r in rows if r.file == file and r.ver == ver}
    return np.array([[found[y, x] for x in range(max(k[1] for k in found) + 1)] for y in range(max(k[0] for k in found) + 1)])


def test_one_channel(spark, tmp_path):
    images = made(spark, str(tmp_path / "in"), n_files=2, width=12, height=10)
    made_ = exposures.one_channel(spark, str(tmp_path / "in"), str(tmp_path / "out"), alpha=0.75, note="a note", step=2)
    rows = made_.collect()
    for (file, hdu), image in images.items():
        if hdu == 2:
            continue
        v = image.astype(float)
        near = np.array([[np.median([v[b, a] for b in range(max(0, y - 1), min(10, y + 2)) for a in range(max(0, x - 1), min(12, x + 2)) if (b, a) != (y, x)]) for x in range(12)] for y in range(10)])
        den = (v + near) / 2
        diff = (v - den).ravel()
        keep = np.ones(diff.size, bool)
        for _ in range(5):
            m = np.median(diff[keep])
            s = 1.4826 * np.median(np.abs(diff[keep] - m))
            keep &= np.abs(diff - m) < 3 * s
        want = 0.75 * (den + np.median(diff[keep])) + 0.25 * v
        got = image_of(rows, file, 1 if hdu == 1 else 2)
        assert np.allclose(got, want, atol=1e-9)
        lines = {r.y: r.data for r in FS.read_rows(spark, str(tmp_path / "out")).where((F.col("file") == file) & (F.col("hdu") == hdu)).collect()}
        assert np.array_equal(np.array([lines[y] for y in range(10)], "f4"), want.astype("f4"))
    before, after = ({(r.file, r.hdu): r for r in FS.read_units(spark, str(tmp_path / p)).collect()} for p in ("in", "out"))
    assert set(before) == set(after)
    for key, r in after.items():
        assert [c for c in r.cards if not c.startswith("HISTORY")] == before[key].cards and any("a note" in c for c in r.cards) == (r.name == "SCI")


def test_files_are_cleaned_once_as_they_arrive(spark, tmp_path):
    source, out, report, landing = (str(tmp_path / p) for p in ("in", "out", "report", "landing"))
    images = made(spark, source, n_files=3, width=6, height=5)
    asked = []

    def clean(files):
        asked.append(sorted(r.file for r in files.collect()))
        rows = FS.read_rows(files.sparkSession, source, names="SCI").join(files, "file", "left_semi").select("file", "ver", "y", F.posexplode("data").alias("x", "v"))
        ray = F.col("v") > 1
        return rows.select("file", "ver", "y", "x", F.when(ray, 0.0).otherwise(F.col("v")).alias("v"), ray.alias("ray"))

    catalog = spark.createDataFrame([("g", ["f0.fits", "f1.fits"]), ("h", ["f2.fits"])], "group string, files array<string>")

    def run():
        stream = spark.readStream.schema("file string").option("maxFilesPerTrigger", 1).parquet(landing)
        query = ingest.clean_arrivals(stream, source, out, report, str(tmp_path / "state"), clean, catalog=catalog, rerooted=str(tmp_path / "catalog"), threshold=0.75)
        query.awaitTermination()

    land = lambda *files: spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.mode("append").parquet(landing)
    land("f0.fits", "f1.fits")
    run()
    assert asked == [["f0.fits", "f1.fits"]]
    land("f1.fits", "f2.fits")
    run()
    land("f0.fits")
    run()
    run()
    assert asked == [["f0.fits", "f1.fits"], ["f2.fits"]]
    told = {(r.file, r.ver): (r.n_rays, r.n_pixels) for r in ingest.read_report(spark, report).collect()}
    assert told == {(f, 1 if hdu == 1 else 2): ((image > 1).sum(), 30) for (f, hdu), image in images.items() if hdu != 2}
    for r in FS.read_rows(spark, out, names="SCI").collect():
        image = images[r.file, r.hdu][r.y]
        assert np.array_equal(np.array(r.data, "f4"), np.where(image > 1, np.float32(0), image))
    for r in FS.read_units(spark, out).where("name = 'SCI'").collect():
        assert r.header["CRCLEAN"] == "T" and float(r.header["CRTHRESH"]) == 0.75 and int(r.header["NCRPIX"]) == told[r.file, r.ver][0]
    assert {r.group: list(r.files) for r in spark.read.json(str(tmp_path / "catalog")).collect()} == {"g": [f"{out}/f0.fits", f"{out}/f1.fits"], "h": [f"{out}/f2.fits"]}
