"""Structured Streaming: exposures as they arrive, each once; transfer rates and stalls over event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import exposures
from ..session import Scratch
from ..sources import catalogs, fits_source


def arrivals(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Rows of Parquet files that land in a folder; the query's checkpoint remembers which files it has had."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once, as far back as the watermark keeps state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def rates(stream: DataFrame, time: str, amount: str, *, keys: tuple[str, ...] = (), window: str = "25 seconds", late: str = "1 minute") -> DataFrame:
    """Amount per second in tumbling windows."""
    size = F.window(time, window)
    got = stream.withWatermark(time, late).groupBy(size, *keys).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("n"))
    seconds = F.col("window.end").cast("timestamp").cast("double") - F.col("window.start").cast("timestamp").cast("double")
    return got.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "amount", "n", (F.col("amount") / seconds).alias("rate"))


def stalls(windows: DataFrame, least: float = 400_000.0) -> DataFrame:
    return windows.where(F.col("rate") < least)


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Bursts of one key, ended by a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_anchor(stream: DataFrame, key: str, value: str, time: str, tolerance: float, late: str = "1 day", keep: timedelta = timedelta(days=1)) -> DataFrame:
    """Clusters of a key's values in order of arrival: a value over ``tolerance`` from the anchor starts the next.

    The state of a key is its anchor and cluster number; it goes when nothing has come for ``keep`` of event time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, cluster = state.get if state.exists else (None, 0)
        for rows in batches:
            out = []
            for v in rows.sort_values([time, value])[value]:
                if anchor is None or abs(v - anchor) > tolerance:
                    anchor, cluster = float(v), cluster + 1
                out.append((k[0], float(v), anchor, cluster))
            if out:
                yield pd.DataFrame(out, columns=[key, "value", "anchor", "cluster"])
        state.update((anchor, cluster))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + int(keep.total_seconds() * 1000))

    kind = stream.schema[key].dataType.simpleString()
    marked = stream.withWatermark(time, late).select(key, value, time)
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, value double, anchor double, cluster int", "anchor double, cluster int", "append", GroupStateTimeout.EventTimeTimeout)


def write_each(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A query that takes what there is, commits it exactly once, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def clean_arrivals(arrivals: DataFrame, source: str, out: str, report: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame], *, catalog: DataFrame | None = None, rerooted: str | None = None, threshold: float = 0.5, **options):
    """A query that cleans the files that ``arrivals`` (file) name, batch by batch, takes what there is and ends.

    ``clean`` gets a batch's files that the report does not have yet and gives (file, ver, y, x, v, ray).  Their science images are written anew under ``out``, with
    cards that tell so, the threshold and how many pixels were rays; then the batch's part of the report (file, ver, n_rays, n_pixels), named by the batch's
    id, is put in place whole.  A batch that is run again after a failure thus leaves the same files and the same part.  With ``catalog`` (its files as an
    array) a catalog of the same groups with their files under ``out`` is written to ``rerooted`` after each batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = f"{report}/batch={number}"
        done = read_report(spark, report)
        files = batch.select("file").distinct() if done is None else batch.select("file").distinct().join(done.where(F.col("batch") != number).select("file").distinct(), "file", "left_anti")
        with Scratch(spark) as scratch:
            files = scratch.keep(files)
            if files.isEmpty():
                return
            pixels = scratch.keep(clean(files))
            counts = scratch.keep(pixels.groupBy("file", "ver").agg(F.count(F.when(F.col("ray"), 1)).alias("n_rays"), F.count(F.lit(1)).alias("n_pixels")))
            marks = {"CRCLEAN": (F.lit(True), "logical"), "CRTHRESH": (F.lit(threshold), "number"), "NCRPIX": (F.col("n_rays"), "number")}

            def change(name: Column, cards: Column) -> Column:
                marked = cards
                for key, (value, kind) in marks.items():
                    marked = fits_source.with_card(marked, key, value, kind)
                return F.when(name == "SCI", marked).otherwise(cards)

            exposures.write_changed(spark, source, out, pixels, change, counts, **options)
            counts.write.mode("overwrite").parquet(part)
            if catalog is not None and rerooted is not None:
                catalogs.write_catalog(catalog.withColumn("files", F.transform("files", lambda f: F.concat(F.lit(out.rstrip("/") + "/"), f))), rerooted)

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_report(spark: SparkSession, report: str) -> DataFrame | None:
    """The parts of all batches with their number, or None before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(report)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place) or not store.listStatus(place):
        return None
    return spark.read.option("basePath", report).schema("file string, ver int, n_rays long, n_pixels long, batch long").parquet(report)
