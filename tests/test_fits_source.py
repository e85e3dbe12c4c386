"""The FITS data source: literal bytes, ranges, versions, commits, stripped files and history."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.sources import fits_source as FS


def block(*cards):
    text = "".join(c.ljust(80) for c in (*cards, "END"))
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


# A file by the standard, written out: empty primary unit, a 3 by 2 image of 16-bit integers with offset, scale and blank, and one of 4-byte floats.
LITERAL = (
    block("SIMPLE  =                    T / conforms", "BITPIX  =                    8", "NAXIS   =                    0", "EXTEND  =                    T", "OBJECT  = 'O''Neil / M 31'     / a name", "EXPTIME =                400.0", "COMMENT = not a value", "HISTORY made by hand")
    + block("XTENSION= 'IMAGE   '", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    3", "NAXIS2  =                    2", "PCOUNT  =                    0", "GCOUNT  =                    1", "BSCALE  =                  0.5", "BZERO   =                100.0", "BLANK   =               -32768", "EXTNAME = 'SCI     '", "EXTVER  =                    1")
    + bytes.fromhex("0000 0001 ffff 0100 8000 7fff".replace(" ", "")).ljust(2880, b"\0")
    + block("XTENSION= 'IMAGE   '", "BITPIX  =                  -32", "NAXIS   =                    2", "NAXIS1  =                    2", "NAXIS2  =                    1", "PCOUNT  =                    0", "GCOUNT  =                    1", "EXTNAME = 'DQ      '", "EXTVER  =                    1")
    + bytes.fromhex("3fc00000 7fc00000".replace(" ", "")).ljust(2880, b"\0")
)


def test_literal_bytes(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.fits").write_bytes(LITERAL)
    (tmp_path / "in" / "junk.fits").write_bytes(b"\1" * 5000)
    (tmp_path / "in" / "empty.fits").write_bytes(b"")
    path = f"file:{tmp_path / 'in'}"
    units = {r.hdu: r for r in FS.read_units(spark, path).where("file = 'sub/a.fits'").collect()}
    assert [units[k].name for k in range(3)] == ["PRIMARY", "SCI", "DQ"] and FS.read_units(spark, path).count() == 3
    assert units[0].header["OBJECT"] == "O'Neil / M 31" and units[0].header["EXPTIME"] == "400.0" and "COMMENT" in units[0].header and "HISTORY" not in units[0].header
    assert (units[1].data_at, units[1].data_bytes, units[2].data_at) == (5760, 12, 11520)
    rows = {(r.name, r.y): r.data for r in FS.read_rows(spark, path).collect()}
    assert rows == {("SCI", 0): [100.0, 100.5, 99.5], ("SCI", 1): [228.0, None, 16483.5], ("DQ", 0): [1.5, None]}
    assert [r.name for r in FS.read_rows(spark, path, firstWithData="true").select("name").distinct().collect()] == ["SCI"]
    # written anew from what was read, the bytes are the same
    FS.write_files(FS.read_units(spark, path), FS.read_rows(spark, path), str(tmp_path / "out"))
    assert (tmp_path / "out" / "sub" / "a.fits").read_bytes() == LITERAL
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["sub"]


def made(spark, folder, n_files=3, width=40, height=300, dq=True):
    rng = np.random.default_rng(0)
    images = {(f"f{k}.fits", hdu): rng.normal(size=(height, width)).astype("f4") for k in range(n_files) for hdu in (1, 3)}
    cards = lambda name, ver: ["XTENSION= 'IMAGE   '", "BITPIX  =                  -32", "NAXIS   =                    2", f"NAXIS1  = {width:>20}", f"NAXIS2  = {height:>20}", f"EXTNAME = '{name}'", f"EXTVER  = {ver:>20}"]
    units = [(f"f{k}.fits", 0, ["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "EXPTIME =                 10.0"]) for k in range(n_files)]
    units += [(f"f{k}.fits", hdu, cards(name, ver)) for k in range(n_files) for hdu, name, ver in ((1, "SCI", 1), (2, "DQ", 1), (3, "SCI", 2)) if dq or name == "SCI"]
    images |= {(f"f{k}.fits", 2): np.zeros((height, width), "f4") for k in range(n_files) if dq}
    lines = [(f, hdu, y, image[y].astype(float).tolist()) for (f, hdu), image in images.items() for y in range(height)]
    FS.write_files(spark.createDataFrame(units, "file string, hdu int, cards array<string>"), spark.createDataFrame(lines, "file string, hdu int, y int, data array<double>"), folder)
    return images


def test_ranges_versions_and_columns(spark, tmp_path):
    folder = str(tmp_path / "x")
    images = made(spark, folder)
    units = FS.read_units(spark, folder)
    assert max(r.fetched for r in units.collect()) < 60_000 < 3 * 300 * 40 * 4  # headers alone, data are stepped over
    heads = FS.head_units(spark, folder)
    assert {(r.file, r.hdu) for r in heads.collect()} == {(f"f{k}.fits", h) for k in range(3) for h in (0, 1, 2)}  # the last header lies beyond 64 KiB
    assert max(r.fetched for r in heads.collect()) <= 65536
    one = FS.read_rows(spark, folder, names="SCI", versions="2")
    assert one.rdd.getNumPartitions() == 3 and {r.hdu for r in one.collect()} == {3}
    assert FS.read_rows(spark, folder, names="SCI", versions="1,2").rdd.getNumPartitions() == 6
    for r in one.collect():
        assert np.array_equal(np.array(r.data, "f4"), images[r.file, 3][r.y])
    FS.register(spark)
    bare = spark.read.format("fits").schema("file string, y int").options(table="rows", names="SCI").load(folder)
    assert bare.columns == ["file", "y"] and bare.count() == 3 * 2 * 300


def test_strip_and_history(spark, tmp_path):
    folder, out = str(tmp_path / "x"), str(tmp_path / "y")
    images = made(spark, folder, n_files=2, height=20)
    done = FS.strip_files(spark, folder, out)
    assert {tuple(r) for r in done.collect()} == {("f0.fits", 4, 3), ("f1.fits", 4, 3)}
    units = FS.read_units(spark, out)
    assert {(r.hdu, r.name, r.ver) for r in units.collect()} == {(0, "PRIMARY", 1), (1, "SCI", 1), (2, "SCI", 2)}
    for r in FS.read_rows(spark, out).collect():
        assert np.array_equal(np.array(r.data, "f4"), images[r.file, 2 * r.hdu - 1][r.y])
    assert FS.strip_files(spark, out, str(tmp_path / "z")).count() == 0 and not list((tmp_path / "z").glob("*.fits"))
    noted = units.withColumn("cards", FS.with_card(FS.with_history("cards", F.lit("a note " * 20)), "ERRSTALE", F.lit(True), "logical"))
    noted = noted.withColumn("cards", FS.with_card(F.col("cards"), "EXPTIME", F.lit(2.5)))
    FS.write_files(noted, FS.read_rows(spark, out), out)  # over themselves
    for r in FS.read_units(spark, out).collect():
        assert sum(c.startswith("HISTORY") for c in r.cards) == 2 and r.header["ERRSTALE"] == "T" and float(r.header["EXPTIME"]) == 2.5 and all(len(c) == 80 for c in r.cards)


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    folder = tmp_path / "x"
    made(spark, str(folder), n_files=1, height=5)
    before = (folder / "f0.fits").read_bytes()
    units, lines = FS.read_units(spark, str(folder)), FS.read_rows(spark, str(folder)).where("NOT (hdu = 3 AND y = 4)")
    with pytest.raises(Exception, match="4 lines instead of 5"):
        FS.write_files(units, lines, str(folder))
    assert (folder / "f0.fits").read_bytes() == before and [x.name for x in folder.iterdir()] == ["f0.fits"]
