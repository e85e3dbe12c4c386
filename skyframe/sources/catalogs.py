"""JSON catalogs: groups, targets, offsets and header caches, read with schemas and written as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import chip_path
from ..operators.catalog import numbered

GROUP = (
    "galaxy string, filter string, ra_targ double, dec_targ double, n_exposures int, n_pairs int, proposals array<string>, date_range string, chip int, files array<string>, note string, scope string"
)
TARGET = "galaxy string, filter string, obsids array<string>, n_exposures int, n_pairs int, ra double, dec double"


def read_catalog(spark: SparkSession, path: str, schema: str = GROUP) -> DataFrame:
    """A JSON array of records, or JSON lines as ``write_catalog`` leaves them; keys that some records lack are null."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return spark.read.schema(schema).option("multiLine", first is None or first[0].lstrip().startswith("[")).json(path)


def read_map(spark: SparkSession, path: str, value: str = "array<double>") -> DataFrame:
    """A JSON object as (key, value) rows."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    return read_map(spark, path).select(F.col("key").alias("file"), F.col("value")[0].alias("off_x"), F.col("value")[1].alias("off_y"))


def exposures(catalog: DataFrame) -> DataFrame:
    """One row per file of a catalog, with its place in the group."""
    return catalog.select("*", F.posexplode("files").alias("pos", "file")).drop("files")


def subset(catalog: DataFrame, order: Sequence[str], places: Sequence[int]) -> DataFrame:
    """Groups by their place in the given order, counted from 0."""
    ranked = numbered(catalog, order, F.lit(1), "_place")
    return ranked.where((F.col("_place") - 1).isin(list(places))).drop("_place")


def write_catalog(df: DataFrame, path: str) -> None:
    """JSON lines, swapped in by Spark's commit; a failed write leaves the old ones."""
    df.write.mode("overwrite").json(path)


def quarantine(df: DataFrame, path: str, reason: str = "reason") -> None:
    """Rejected rows, a folder for each reason; nothing is deleted."""
    df.write.mode("append").partitionBy(reason).parquet(path)


def write_per_chip(df: DataFrame, path: str, chip: str = "chip") -> None:
    df.write.mode("overwrite").partitionBy(chip).parquet(path)


def split_paths(files: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, chip1, chip2): where a file's chips lie; a file without an entry in ``splits`` has them beside itself."""
    known = splits.select("file", F.col("chip1").alias("_1"), F.col("chip2").alias("_2"))
    both = files.select("file").join(known, "file", "left")
    return both.select("file", *[F.coalesce(f"_{k}", chip_path(F.col("file"), k)).alias(f"chip{k}") for k in (1, 2)])


def probe(work: DataFrame, cache: DataFrame, keys: Sequence[str], read) -> DataFrame:
    """The cache with what it lacked: ``read`` makes a row of each key of ``work`` that isn't in it, and rows it gives up on (null ``value``) aren't kept."""
    fresh = read(not_done(work.select(*keys).distinct(), cache, keys))
    return cache.unionByName(fresh.where("value IS NOT NULL").select(*cache.columns))


def not_done(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What has no output yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
