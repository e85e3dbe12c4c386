"""FITS files as a Spark data source: units and image rows read by ranges, files written with a commit.

``spark.dataSource.register(FitsSource)`` (or ``register(spark)``) makes ``spark.read.format("fits")`` and ``df.write.format("fits")`` known.
Reading plans one task for a group of files, or for one extension of one file, and each task fetches only the bytes it needs: the headers' blocks, and
the lines of the images asked for.  Nothing holds a whole file.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .fits import BLOCK, CARD, DTYPES, HEADER_BYTES, store_of

UNITS = "path string, file string, hdu int, name string, ver int, cards array<string>, header map<string,string>, data_at long, data_bytes long, fetched long"
ROWS = "path string, file string, hdu int, name string, ver int, y int, data array<double>"
LINES = 256


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)


def read_units(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row per unit of each file: its place in the file, its cards as they stand, and their values as text."""
    register(spark)
    return spark.read.format("fits").options(table="units", **options).load(path)


def read_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row per line of each two-dimensional image; blanks and values that are no numbers are null."""
    register(spark)
    return spark.read.format("fits").options(table="rows", **options).load(path)


def card_value(card: str) -> str | None:
    """The value of a card as text, without quotes and comment; None for cards that have none."""
    if card[8:10] != "= ":
        return None
    body = card[10:].strip()
    if not body.startswith("'"):
        return body.partition("/")[0].strip()
    end = 1
    while (end := body.find("'", end)) >= 0 and body[end + 1 : end + 2] == "'":
        end += 2
    return body[1 : end if end > 0 else None].replace("''", "'").rstrip()


@dataclass
class Unit:
    hdu: int
    cards: list[str]
    header: dict[str, str]
    at: int
    size: int

    @property
    def name(self) -> str:
        return "PRIMARY" if not self.hdu else self.header.get("EXTNAME", "")

    @property
    def ver(self) -> int:
        return int(self.header.get("EXTVER", 1))

    @property
    def shape(self) -> tuple[int, int] | None:
        """(lines, columns) of a two-dimensional image with data."""
        if not self.size or self.header.get("NAXIS") != "2" or self.header.get("XTENSION", "IMAGE") != "IMAGE":
            return None
        return int(self.header["NAXIS2"]), int(self.header["NAXIS1"])


class Ranged:
    """A file of which ranges are fetched, and how many bytes that has been."""

    def __init__(self, path: str, most: int | None = None):
        system, place = store_of(path)
        self.file = system.open_input_file(place)
        self.size = self.file.size() if most is None else min(most, self.file.size())
        self.fetched, self.start, self.held = 0, 0, b""

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def get(self, at: int, n: int, ahead: int = 0) -> bytes:
        """``n`` bytes at a place (fewer at the end); a range that has to be fetched is fetched with ``ahead`` bytes, which serve later calls."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.start <= at and at + n <= self.start + len(self.held)):
            want = min(max(n, ahead), self.size - at)
            self.start, self.held = at, self.file.read_at(want, at)
            self.fetched += len(self.held)
        return self.held[at - self.start : at - self.start + n]

    def units(self) -> Iterator[Unit]:
        """Units whose headers lie within reach, in order; data are stepped over and not fetched."""
        at, hdu = 0, 0
        while at + BLOCK <= self.size:
            cards: list[str] = []
            done = False
            while not done and at + BLOCK <= self.size:
                block = self.get(at, BLOCK, 4 * BLOCK).decode("latin-1")
                at += BLOCK
                for card in (block[k : k + CARD] for k in range(0, BLOCK, CARD)):
                    if card[:8].rstrip() == "END":
                        done = True
                        break
                    cards.append(card)
            if not done or (not hdu and not cards[:1][0].startswith("SIMPLE")):
                return
            header: dict[str, str] = {}
            for card in cards:
                value = card_value(card)
                if value is not None:
                    header.setdefault(card[:8].rstrip(), value)
            try:
                axes = [int(header.get(f"NAXIS{k + 1}", 0)) for k in range(int(header.get("NAXIS", 0)))]
                cells = int(np.prod(axes)) if axes else 0
                size = abs(int(header.get("BITPIX", 8))) // 8 * int(header.get("GCOUNT", 1)) * (int(header.get("PCOUNT", 0)) + cells) if cells else 0
            except ValueError:
                return
            yield Unit(hdu, cards, header, at, size)
            at += -(-size // BLOCK) * BLOCK
            hdu += 1


@dataclass
class Part(InputPartition):
    paths: list[str]
    ver: int | None


class FitsReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.columns = dict(options), [f.name for f in schema.fields]
        self.arrow = to_arrow_schema(schema)
        given = lambda key: [v.strip() for v in options.get(key, "").split(",") if v.strip()]
        self.names, self.versions, self.rows = given("names"), [int(v) for v in given("versions")], options.get("table", "units") == "rows"
        self.most = int(options["headbytes"]) if options.get("headbytes") else None
        self.first = options.get("firstwithdata", "false").lower() == "true"
        self.root = options["path"].rstrip("/")

    def partitions(self):
        """The listing alone is the planner's; a task has one version of one file where ``versions`` names them, a file where rows are read, and else a group of files."""
        from pyarrow import fs

        system, place = store_of(self.root)
        pattern, excluded = self.options.get("pattern", "*.fits"), self.options.get("excluded", "_excluded")
        prefix = self.root[: len(self.root) - len(place)] if self.root.endswith(place) else ""
        if system.get_file_info(place).type == fs.FileType.File:
            found = [place]
        else:
            found = sorted(x.path for x in system.get_file_info(fs.FileSelector(place, recursive=True)) if x.type == fs.FileType.File)
            inner = lambda p: p[len(place) :].strip("/").split("/")
            found = [p for p in found if fnmatch.fnmatch(os.path.basename(p), pattern) and excluded not in inner(p) and not any(x[:1] in "._" for x in inner(p))]
        paths = [prefix + p for p in found]
        if self.rows and self.versions:
            return [Part([p], v) for p in paths for v in self.versions]
        each = int(self.options.get("filesperpartition", 1 if self.rows else 64))
        return [Part(paths[k : k + each], None) for k in range(0, len(paths), each)]

    def _wanted(self, file: Ranged, ver: int | None) -> Iterator[Unit]:
        for unit in file.units():
            if (self.names and unit.name not in self.names) or (ver is not None and unit.ver != ver) or (self.versions and unit.ver not in self.versions) or (self.first and not unit.size):
                continue
            yield unit
            if self.first:
                return

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        base = len(store_of(self.root)[1].rstrip("/"))
        for path in partition.paths:
            place = store_of(path)[1]
            file = place[base:].lstrip("/") or os.path.basename(place)
            with Ranged(path, self.most) as ranged:
                rows = []
                for unit in self._wanted(ranged, partition.ver):
                    told = {"path": path, "file": file, "hdu": unit.hdu, "name": unit.name, "ver": unit.ver}
                    if self.rows:
                        yield from self._lines(ranged, unit, told)
                    else:
                        rows.append(told | {"cards": unit.cards, "header": list(unit.header.items()), "data_at": unit.at, "data_bytes": unit.size, "fetched": ranged.fetched})
                if rows:
                    yield self._batch({c: [r[c] for r in rows] for c in self.columns}, len(rows))

    def _batch(self, columns: dict, n: int) -> pa.RecordBatch:
        arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in self.arrow]
        return pa.RecordBatch.from_arrays(arrays, schema=self.arrow) if arrays else pa.RecordBatch.from_struct_array(pa.array([{}] * n, pa.struct([])))

    def _lines(self, ranged: Ranged, unit: Unit, told: dict) -> Iterator[pa.RecordBatch]:
        if unit.shape is None:
            return
        height, width = unit.shape
        kind = np.dtype(DTYPES[int(unit.header["BITPIX"])])
        scale, zero, blank = float(unit.header.get("BSCALE", 1)), float(unit.header.get("BZERO", 0)), unit.header.get("BLANK")
        for y in range(0, height, LINES):
            n = min(LINES, height - y)
            columns = {k: [v] * n for k, v in told.items()} | {"y": list(range(y, y + n))}
            if "data" in self.columns:  # else no pixel is fetched
                raw = np.frombuffer(ranged.get(unit.at + y * width * kind.itemsize, n * width * kind.itemsize), kind)
                if len(raw) < n * width:
                    raise ValueError(f"{told['path']} ends within unit {unit.hdu}")
                values = raw.astype(np.float64) * scale + zero
                missing = ~np.isfinite(values) if kind.kind == "f" else (raw == int(blank) if blank is not None else np.zeros(len(raw), bool))
                columns["data"] = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values, mask=missing)).cast(self.arrow.field("data").type)
            yield self._batch({c: columns[c] for c in self.columns}, n)


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class FitsWriter(DataSourceArrowWriter):
    """Files from rows (file, hdu, y, cards, data): a unit begins with a row without y that has its cards, and its lines follow.

    All rows of a file have to be in one partition, in order of hdu and y with nulls first; ``write_files`` sees to it.  Tasks write into a
    folder of the attempt's own; the commit moves whole files to their names, so a reader sees the old file or the new one, and the abort deletes.
    """

    def __init__(self, options, schema):
        self.root = options["path"].rstrip("/")
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = store_of(self.root)
        folder = f"{root}/{self.pending}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        moves: list[tuple[str, str]] = []
        out, name, unit, lines, kind, written = None, None, None, 0, None, set()

        def ended() -> None:
            if unit is not None:
                if lines != unit.get("lines", 0):
                    raise ValueError(f"{name}: a unit has {lines} lines instead of {unit.get('lines', 0)}")
                size = lines * unit.get("bytes", 0)
                out.write(b"\0" * (-size % BLOCK))

        for batch in iterator:
            columns = [batch[c] for c in ("file", "y", "cards", "data")]
            for k in range(batch.num_rows):
                file, y = columns[0][k].as_py(), columns[1][k].as_py()
                if file != name:
                    ended()
                    if out is not None:
                        out.close()
                    if file in written:
                        raise ValueError(f"the rows of {file} don't stand together")
                    written.add(file)
                    place = f"{folder}/{len(moves)}"
                    out, name, unit = system.open_output_stream(place), file, None
                    moves.append((place, f"{root}/{file}"))
                elif y is None:
                    ended()
                if y is None:
                    cards = [c[:CARD].ljust(CARD) for c in columns[2][k].as_py()]
                    head = {c[:8].rstrip(): card_value(c) for c in cards}
                    text = "".join([*cards, "END".ljust(CARD)])
                    out.write(text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("latin-1"))
                    unit, lines = {}, 0
                    if head.get("NAXIS") == "2":
                        kind = np.dtype(DTYPES[int(head["BITPIX"])])
                        unit = {"lines": int(head["NAXIS2"]), "width": int(head["NAXIS1"]), "bytes": int(head["NAXIS1"]) * kind.itemsize, "scale": float(head.get("BSCALE", 1)), "zero": float(head.get("BZERO", 0)), "blank": int(head.get("BLANK") or 0)}
                else:
                    if not unit or y != lines:
                        raise ValueError(f"{name}: line {y} stands where {lines} is due")
                    given = columns[3][k].values
                    values = (np.asarray(given.cast(pa.float64()).fill_null(np.nan)) - unit["zero"]) / unit["scale"]
                    if len(values) != unit["width"]:
                        raise ValueError(f"{name}: a line has {len(values)} values instead of {unit['width']}")
                    if kind.kind != "f":
                        values = np.where(np.isfinite(values), np.rint(values), unit["blank"])
                    out.write(values.astype(kind).tobytes())
                    lines += 1
        ended()
        if out is not None:
            out.close()
        return Written(moves)

    def commit(self, messages) -> None:
        system, root = store_of(self.root)
        for made, final in (m for w in messages if w is not None for m in w.moves):
            system.create_dir(os.path.dirname(final), recursive=True)
            system.move(made, final)
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, root = store_of(self.root)
        if system.get_file_info(f"{root}/{self.pending}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.pending}")


class FitsSource(DataSource):
    """Options of reads: ``table`` (units or rows), ``pattern`` of file names, ``excluded`` folder, ``names`` and ``versions`` of extensions (comma-separated),
    ``firstWithData`` (only the first unit of each file that has data), ``headBytes`` (nothing beyond so many bytes is fetched), ``filesPerPartition``
    (64 for units, 1 for rows).

    A schema given to the reader is what is made: without ``data`` no pixel is fetched.  Files that are no FITS have no units, nor have those of no bytes.
    """

    @classmethod
    def name(cls):
        return "fits"

    def schema(self):
        return ROWS if self.options.get("table", "units") == "rows" else UNITS

    def reader(self, schema):
        return FitsReader(self.options, schema)

    def writer(self, schema, overwrite):
        return FitsWriter(self.options, schema)


# ------------------------------------------------------------------ headers as columns


def make_card(key: str, value: Column, kind: str = "number") -> Column:
    """A card of fixed form: numbers (and ``logical`` T or F) end in column 30, text is quoted."""
    if kind == "text":
        text = F.concat(F.lit("'"), F.rpad(F.replace(value.cast("string"), F.lit("'"), F.lit("''")), 8, " "), F.lit("'"))
    elif kind == "logical":
        text = F.lpad(F.when(value, "T").otherwise("F"), 20, " ")
    else:
        plain = value.cast("string")
        text = F.when(F.length(plain) < 20, F.lpad(plain, 20, " ")).otherwise(plain)
    return F.rpad(F.concat(F.rpad(F.lit(key), 8, " "), F.lit("= "), text), CARD, " ")


def with_card(cards: Column, key: str, value: Column, kind: str = "number") -> Column:
    """``cards`` with the value of ``key`` replaced where it stands, or added at the end."""
    made = make_card(key, value, kind)
    same = lambda c: F.rtrim(F.left(c, F.lit(8))) == key
    return F.when(F.exists(cards, same), F.transform(cards, lambda c: F.when(same(c), made).otherwise(c))).otherwise(F.concat(cards, F.array(made)))


def with_history(cards: Column, text: Column) -> Column:
    """``cards`` with HISTORY cards of 72 characters each at the end."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / 72).cast("int") - 1, F.lit(0)))
    return F.concat(cards, F.transform(starts, lambda k: F.rpad(F.concat(F.lit("HISTORY "), F.substring(text, k * 72 + 1, F.lit(72))), CARD, " ")))


def write_files(units: DataFrame, lines: DataFrame, path: str) -> None:
    """Write files from ``units`` (file, hdu, cards) and ``lines`` (file, hdu, y, data); the units' cards tell the sizes.

    A file's rows meet in one task and pass through it line by line; files that are there are replaced whole.
    """
    register(units.sparkSession)
    head = units.select("file", F.col("hdu").cast("int").alias("hdu"), F.lit(None).cast("int").alias("y"), "cards", F.lit(None).cast("array<double>").alias("data"))
    body = lines.select("file", F.col("hdu").cast("int").alias("hdu"), F.col("y").cast("int").alias("y"), F.lit(None).cast("array<string>").alias("cards"), F.col("data").cast("array<double>").alias("data"))
    rows = head.unionByName(body).repartition("file").sortWithinPartitions("file", "hdu", "y")
    rows.write.format("fits").mode("append").save(path)


def strip_files(spark: SparkSession, path: str, out: str, *, name: str = "SCI", **options) -> DataFrame:
    """Write each file anew with its primary unit and its ``name`` units alone; (file, before, after) units of the files written.

    Files without such units, and files that have nothing else, stay as they are and are not written.
    """
    units = read_units(spark, path, **options)
    sizes = units.groupBy("file").agg(F.count(F.lit(1)).alias("before"), (F.count(F.when(F.col("name") == name, 1)) + 1).alias("after"))
    todo = sizes.where("after > 1 AND before <> after")
    nth = (F.row_number().over(Window.partitionBy("file").orderBy("hdu")) - 1).alias("_new")
    kept = units.where((F.col("hdu") == 0) | (F.col("name") == name)).join(todo, "file", "left_semi").select("file", "hdu", "cards", nth)
    places = kept.select("file", "hdu", "_new")
    lines = read_rows(spark, path, names=name, **options).select("file", "hdu", "y", "data").join(places, ["file", "hdu"])
    write_files(kept.select("file", F.col("_new").alias("hdu"), "cards"), lines.select("file", F.col("_new").alias("hdu"), "y", "data"), out)
    return todo


def head_units(spark: SparkSession, path: str, **options) -> DataFrame:
    """The units that the first 64 KiB of each file tell of; nothing beyond is fetched."""
    return read_units(spark, path, headBytes=HEADER_BYTES, **options)
