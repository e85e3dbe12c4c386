"""FITS files as DataFrames: headers from the first blocks, images as pixels, and images written back.

Files come through ``binaryFile``, so listing, globbing and splitting are Spark's.  Cards are cut with
SQL functions; only the decoding of an image's bytes is Python, one block of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs, names
from ..session import bound_batches

BLOCK, CARD = 2880, 80
HEADER_BYTES = 65536
DTYPES = {-32: ">f4", -64: ">f8", 8: "u1", 16: ">i2", 32: ">i4", 64: ">i8"}


def files(spark: SparkSession, path: str, pattern: str = "*_flc.fits", excluded: str = "_excluded") -> DataFrame:
    """(path, length, content) of all files under ``path`` that match, except those with an ``excluded`` folder in their path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.where(~F.array_contains(F.split("path", "/"), excluded)).select("path", "length", "content")


def heads(spark: SparkSession, path: str, pattern: str = "*_flc.fits", excluded: str = "_excluded", most: int = HEADER_BYTES) -> DataFrame:
    """Like ``files``, but content is only the first ``most`` bytes of each file, which is all that is read of it.

    The listing is Spark's, without contents; each task then reads one range of each of its files, through Arrow's file systems (local folders, HDFS,
    and object stores it knows).  For other stores there is ``files``.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    found = found.where(~F.array_contains(F.split("path", "/"), excluded)).select("path", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # so that a batch holds at most 64 ranges
                part = batch.slice(start, 64)
                yield pa.RecordBatch.from_arrays([part["path"], part["length"], pa.array([_range(p, most) for p in part["path"].to_pylist()], pa.binary())], ["path", "length", "content"])

    return found.mapInArrow(read, "path string, length long, content binary")


def store_of(path: str):
    """(Arrow's file system, the place in it) of a path that Spark names, with or without a scheme."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, inner = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
    return system, f"{base.rstrip('/')}/{inner}"


def _range(path: str, most: int) -> bytes:
    """The first ``most`` bytes of a file that Spark names ``path``."""
    system, place = store_of(path)
    with system.open_input_file(place) as file:
        return file.read_at(min(most, file.size()), 0)


def cards(content: Column, most: int = HEADER_BYTES) -> Column:
    """Cards of the first ``most`` bytes, as strings of 80 characters.  The image that follows reads as Latin-1 noise, which END cuts off."""
    head = F.decode(F.substring(content, 1, most), "ISO-8859-1")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(head) / CARD).cast("int") - 1, F.lit(0))), lambda i: F.substring(head, i * CARD + 1, F.lit(CARD)))
    return F.when(F.length(head) >= CARD, cut).otherwise(F.array().cast("array<string>"))


def header_rows(df: DataFrame, keys: Sequence[str] = ("path",), content: str = "content", hdus: int = 2) -> DataFrame:
    """(keys, hdu, key, value) of the cards of the first ``hdus`` headers; it stops after that many END cards.  Values are text, without quotes or comments."""
    each = df.select(*keys, F.posexplode(cards(F.col(content))).alias("_n", "_card"))
    key = F.rtrim(F.left("_card", F.lit(8)))
    w = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    numbered = each.withColumn("hdu", F.coalesce(F.sum((key == "END").cast("int")).over(w), F.lit(0)).cast("int")).where(F.col("hdu") < hdus)
    raw = F.substring("_card", 11, 70)
    quoted = F.rtrim(F.replace(F.regexp_extract(raw, r"^\s*'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'")))
    value = F.when(raw.rlike(r"^\s*'"), quoted).otherwise(F.trim(F.regexp_extract(raw, r"^([^/]*)", 1)))
    return numbered.where((F.substring("_card", 9, 1) == "=") & (key != "")).select(*keys, "hdu", key.alias("key"), value.alias("value"))


def headers(df: DataFrame, keys: Sequence[str] = ("path",), content: str = "content") -> DataFrame:
    """One map ``h{hdu}_{KEY}`` to text per file."""
    rows = header_rows(df, keys, content)
    name = F.concat(F.lit("h"), F.col("hdu").cast("string"), F.lit("_"), F.col("key"))
    first = rows.groupBy(*keys, name.alias("k")).agg(F.first("value").alias("v"))
    return first.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("header"))


def clean_wcs(header: Column) -> Column:
    """The header without lookup-table distortions."""
    return F.map_filter(header, lambda k, v: ~k.rlike("D2IM|CPDIS|DP"))


def typed(df: DataFrame, file: str = "path", header: str = "header", size: str = "length") -> DataFrame:
    """Exposure records from header maps; a file without its matrix keys, or with a value that doesn't parse, is left out."""
    h = lambda k: F.try_element_at(F.col(header), F.lit(k))
    number = lambda k: h(k).try_cast("double")
    whole = lambda k: number(k).cast("int")
    out = df.select(
        F.col(file).alias("file"), F.col(size).alias("size"), names.root8(F.col(file)).alias("root"), F.lower(h("h0_ROOTNAME")).alias("rootname"), h("h0_TARGNAME").alias("targname"),
        whole("h0_PROPOSID").alias("proposid"), names.filter_second_if_clear(h("h0_FILTER1"), h("h0_FILTER2")).alias("filter"), number("h0_EXPTIME").alias("exptime"),
        number("h0_RA_TARG").alias("ra_targ"), number("h0_DEC_TARG").alias("dec_targ"), F.coalesce(number("h0_POSTARG1"), F.lit(0.0)).alias("postarg1"), F.coalesce(number("h0_POSTARG2"), F.lit(0.0)).alias("postarg2"),
        h("h0_DATE-OBS").alias("date_obs"), exprs.roll_angle(number("h1_CD1_1"), number("h1_CD1_2")).alias("cd_angle"), whole("h1_NAXIS1").alias("naxis1"), whole("h1_NAXIS2").alias("naxis2"),
    )
    needed = ("proposid", "exptime", "ra_targ", "dec_targ", "cd_angle", "naxis1", "naxis2")
    return out.where(F.forall(F.array(*[F.col(c).isNull() for c in needed]), lambda missing: ~missing))


def _units(content: bytes) -> Iterator[tuple[int, dict[str, str], int, int]]:
    """(hdu, its cards, where its data begin, their bytes) of a file."""
    at, hdu = 0, 0
    while at + BLOCK <= len(content):
        head: dict[str, str] = {}
        done = False
        while not done and at + BLOCK <= len(content):
            block = content[at : at + BLOCK].decode("latin-1")
            at += BLOCK
            for i in range(0, BLOCK, CARD):
                card = block[i : i + CARD]
                if card[:8].rstrip() == "END":
                    done = True
                    break
                if card[8:10] == "= ":
                    head[card[:8].rstrip()] = card[10:].split("/")[0].strip().strip("'").rstrip()
        axes = [int(head.get(f"NAXIS{k + 1}", 0)) for k in range(int(head.get("NAXIS", 0)))]
        size = abs(int(head.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0
        yield hdu, head, at, size
        at += -(-size // BLOCK) * BLOCK
        hdu += 1


def image_rows(df: DataFrame, *, key: str = "path", content: str = "content", extension: str | None = "SCI", version: int | None = None) -> DataFrame:
    """(path, hdu, y, data) of the images named ``extension`` (None: all that have data): a row of pixels per row, so an image never is one value."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch[key].to_pylist(), batch[content], strict=True):
                view = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                for hdu, head, at, size in _units(view):
                    if not size or head.get("NAXIS") != "2" or (extension is not None and head.get("EXTNAME") != extension) or (version is not None and int(head.get("EXTVER", 1)) != version):
                        continue
                    width, height = int(head["NAXIS1"]), int(head["NAXIS2"])
                    image = np.frombuffer(view, DTYPES[int(head["BITPIX"])], width * height, at).reshape(height, width)
                    scale, zero = float(head.get("BSCALE", 1)), float(head.get("BZERO", 0))
                    for a in range(0, height, 256):
                        part = image[a : a + 256].astype(np.float64) * scale + zero
                        n = len(part)
                        offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
                        flat = pa.array(part.ravel(), mask=~np.isfinite(part.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([hdu] * n, pa.int32()), pa.array(np.arange(a, a + n, dtype=np.int32)), pa.ListArray.from_arrays(offsets, flat)], [key, "hdu", "y", "data"])

    bound_batches(df.sparkSession)
    return df.select(key, content).mapInArrow(decode, f"{key} string, hdu int, y int, data array<double>")


def image_pixels(rows: DataFrame, keys: Sequence[str] = ("path", "hdu")) -> DataFrame:
    return rows.select(*keys, "y", F.posexplode("data").alias("x", "v"))


def _card(key: str, value) -> str:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, float)):
        text = f"{value!r:>20}"
    else:
        text = f"'{str(value):<8}'"
    return f"{key:<8}= {text}"[:CARD].ljust(CARD)


def encode_image(image: np.ndarray, header: dict | None = None, extension: str = "SCI") -> bytes:
    """A file with an empty primary unit and one float image; ``header`` adds cards to the image's."""

    def block(cards_: list[str]) -> bytes:
        text = "".join([*cards_, "END".ljust(CARD)])
        return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("latin-1")

    primary = block([_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0), _card("EXTEND", True), *[_card(k, v) for k, v in (header or {}).items()]])
    unit = block([_card("XTENSION", "IMAGE"), _card("BITPIX", -32), _card("NAXIS", 2), _card("NAXIS1", image.shape[1]), _card("NAXIS2", image.shape[0]), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("EXTNAME", extension), _card("EXTVER", 1), *[_card(k, v) for k, v in (header or {}).items()]])
    data = np.ascontiguousarray(image, dtype=">f4").tobytes()
    return primary + unit + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


def encode_images(df: DataFrame, key: str, array: str, width: int, cards: dict[str, str], fixed: dict) -> DataFrame:
    """(key, content): a FITS file of each row's image, a row-major array ``width`` wide.

    ``cards`` names the columns that give header values, ``fixed`` gives those that all files share.  A row is a file, so files are made where the rows lie.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # so that no more files than these are held at once
                part, made = batch.slice(start, 64), []
                for i, values in enumerate(part[array].to_pylist()):
                    own = {k: part[c][i].as_py() for k, c in cards.items()}
                    made.append(encode_image(np.asarray(values, dtype=np.float64).reshape(-1, width), fixed | own))
                yield pa.RecordBatch.from_arrays([part[key], pa.array(made, pa.binary())], [key, "content"])

    bound_batches(df.sparkSession)
    return df.select(key, array, *dict.fromkeys(c for c in cards.values() if c not in (key, array))).mapInArrow(run, f"{key} {kind}, content binary")
