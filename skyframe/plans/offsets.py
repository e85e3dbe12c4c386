"""How far exposures of a group are apart: stars matched twice, and groups measured anew where their reference was badly chosen."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MAD_SCALE
from ..operators import catalog as C
from ..operators import tiles as T
from ..session import Scratch, bound_batches, checkpoint

PAIR = ["group", "file"]


def _pass(places: DataFrame, light: T.Pixels | T.Sources, levels: DataFrame, *, window: int, margin: int, height: int, width: int, least: float, low: float, high: float) -> DataFrame:
    """(group, file, y, x, rx, ry): how far each star lies from its place, matched within ``window`` of the place as shifted by (off_x, off_y).

    Mates, their rings and centres are found in tiles (``tiles.about``), so pixels meet the stars once and are in no join, which Spark could plan as a broadcast.
    """
    reads, looked, about = ["sky", "sigma", "fcy", "fcx"], T.square(window), T.square(3)
    beside = np.abs(about).sum(axis=0) == 1

    def work(tile: T.Tile, y: np.ndarray, x: np.ndarray, star: dict[str, np.ndarray]):
        near, there = tile.near(y, x, looked)
        near = np.where(there, near, -np.inf)
        best, line = near.argmax(axis=1), np.arange(len(y))  # the first in row order of equals
        peak, (dy, dx) = near[line, best], looked[:, best]
        light = peak - star["sky"]
        stands = (peak > -np.inf) & (light >= least * star["sigma"]) & (light > 0)
        my, mx = y + dy, x + dx
        box, there = tile.near(my, mx, about)
        ring_there = there & beside
        ring = np.where(ring_there, box - star["sky"][:, None], 0.0).sum(axis=1) / np.maximum(ring_there.sum(axis=1), 1)
        ratio = ring / np.maximum(light, 1e-6)
        found, cy, cx = T.centre(tile, my, mx, about)
        stay = np.nonzero(stands & ring_there.any(axis=1) & (ratio > low) & (ratio < high) & found)[0]
        return stay, {"rx": (cx - star["fcx"])[stay], "ry": (cy - star["fcy"])[stay]}

    aimed = places.withColumns({"py": F.bround(F.col("fy") + F.col("off_y")).cast("int"), "px": F.bround(F.col("fx") + F.col("off_x")).cast("int")}).join(levels, PAIR)
    inside = F.col("py").between(margin, height - 1 - margin) & F.col("px").between(margin, width - 1 - margin)
    asked = aimed.where(inside).select(*PAIR, "y", "x", "py", "px", *reads)
    return T.about(asked, PAIR, light, window + 3, ("py", "px"), reads, work, ["rx", "ry"]).select(*PAIR, "y", "x", "rx", "ry")


FIGURES = ["off_x", "off_y", "scat_x", "scat_y", "med_abs_r", "med_scatter"]


def _mid(v: np.ndarray) -> float:
    ordered = np.sort(v)
    return 0.5 * ordered[(len(v) - 1) // 2] + 0.5 * ordered[len(v) // 2]


def clipped(v: np.ndarray, k: float, rounds: int, floor: float) -> tuple[int, float, float]:
    """(n, median, sigma) as by ``stats.clipped_median`` that isn't narrowing; (0, NaN, NaN) where no value is left."""
    low, high = -np.inf, np.inf
    for turn in range(rounds + 1):
        live = v[(v > low) & (v < high)] if turn else v
        if not len(live):
            return 0, np.nan, np.nan
        mid = _mid(live)
        sigma = MAD_SCALE * _mid(np.abs(live - mid))
        if sigma != 0:  # else the group is frozen
            reach = k * (sigma + floor)
            low, high = mid - reach, mid + reach
    return len(live), mid, sigma


def _middle(matches: DataFrame, k: float, rounds: int) -> DataFrame:
    """(group, file, n_match, n_used, FIGURES): clipped medians of both axes, medians of the distances from nothing and from them; n_used is 0 where none are left.

    An exposure's matches, two numbers each and no more than its stars, meet in one row; a step for each round of clipping would be a job of its own.
    """
    bound_batches(matches.sparkSession)
    n = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = matches.repartition(n, *PAIR).groupBy(*PAIR).agg(F.collect_list(F.struct("rx", "ry")).alias("_m"))
    schema = matches.select(*PAIR, F.lit(0).cast("long").alias("n_match"), F.lit(0).cast("long").alias("n_used"), *[F.lit(0.0).alias(c) for c in FIGURES]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, lines = batch.column("_m"), []
            ends = lists.offsets.to_numpy()
            rx, ry = (lists.values.field(c).to_numpy() for c in (0, 1))
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                x, y = rx[a:b], ry[a:b]
                (nx, mx, sx), (ny, my, sy) = (clipped(v, k, rounds, 1e-6) for v in (x, y))
                lines.append((b - a, min(nx, ny), mx, my, sx, sy, _mid(np.hypot(x, y)), _mid(np.hypot(x - mx, y - my))))
            figures = [pa.array(c, f) for c, f in zip(zip(*lines, strict=True), [pa.int64()] * 2 + [pa.float64()] * 6, strict=True)]
            if lines:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in PAIR], *figures], names=schema.names)

    return held.mapInArrow(run, schema)


def two_pass_offsets(
    stars: DataFrame, pixels: DataFrame | T.Sources, levels: DataFrame, project: Callable[[Column, Column], Column], *, height: int, width: int, margin: int = 12, least: float = 20.0, least_matches: int = 8, windows: tuple[int, int] = (2, 1),
    low: float = 0.20, high: float = 0.95, k: float = 3.0, rounds: int = 4,
) -> DataFrame:
    """(group, file, n_cand, n_match, n_used, off_x, off_y, off_r, scat_x, scat_y, med_abs_r, med_scatter, passes) of each exposure against its group's reference.

    ``stars`` (group, file, y, x, cy, cx, and what ``project`` reads): the reference's stars with their centres, a row for each other exposure of the group;
    ``project(x, y)`` gives the struct (x, y) of a place of the reference in that exposure.  ``pixels`` (group, file, y, x, v), or sources that make them; ``levels`` (group, file, sky, sigma).

    A star's mate is the brightest pixel within the first window of its place, if it stands ``least`` sigmas over the sky and is round (the ring's ratio between
    ``low`` and ``high``); their centres' distance is one measurement.  The second pass looks again, in the second window, about the places shifted by the
    exposure's own first result, and counts where it has ``least_matches`` mates too; exposures with fewer in the first pass have no row.
    """
    there, centre = project(F.col("x").cast("double"), F.col("y").cast("double")), project(F.col("cx"), F.col("cy"))
    with Scratch(stars.sparkSession) as scratch:
        places = stars.withColumns({"_t": there, "_c": centre}).where("_t IS NOT NULL AND _c IS NOT NULL")
        places = scratch.keep(places.select(*PAIR, "y", "x", F.col("_t.y").alias("fy"), F.col("_t.x").alias("fx"), F.col("_c.y").alias("fcy"), F.col("_c.x").alias("fcx")))
        light = pixels if isinstance(pixels, T.Sources) else T.Pixels(pixels)
        how = dict(margin=margin, height=height, width=width, least=least, low=low, high=high)
        zero = places.withColumns({"off_y": F.lit(0.0), "off_x": F.lit(0.0)})
        first = _pass(zero, light, levels, window=windows[0], **how)
        middle = scratch.keep(_middle(first, k, rounds).where((F.col("n_match") >= least_matches) & (F.col("n_used") > 0)))
        again = _pass(places.join(middle.select(*PAIR, "off_x", "off_y"), PAIR), light, levels, window=windows[1], **how)
        enough = scratch.keep(_middle(again, k, rounds).where(F.col("n_match") >= least_matches))
        final = enough.withColumn("passes", F.lit(2)).unionByName(middle.join(enough, PAIR, "left_anti").withColumn("passes", F.lit(1))).where("n_used > 0")
        counts = places.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_cand"))
        done = final.join(counts, PAIR).withColumn("off_r", F.hypot("off_x", "off_y"))
        return checkpoint(done.select(*PAIR, "n_cand", "n_match", "n_used", "off_x", "off_y", "off_r", "scat_x", "scat_y", "med_abs_r", "med_scatter", "passes"))


def measured_units(exposures: DataFrame, measure: Callable[[DataFrame], DataFrame], bad: Column, *, share: float = 0.5) -> DataFrame:
    """(group, file, reference, anchored, bad, and what ``measure`` gives) of all exposures but each group's reference.

    A group is first measured against the exposure whose roll is nearest to its median.  Where ``bad`` (over the measurements, null for what could not be
    measured, which counts as bad) holds for more than ``share`` of the others, and the group has over two exposures, the reference itself is suspect: these groups
    alone are measured again, against their first exposure (their second, if the first was it), and that result stands.  ``exposures``: group, file, pos, cd_angle;
    ``measure`` gets those of the groups asked for with their reference, and gives (group, file, and its figures).
    """
    scratch = Scratch(exposures.sparkSession)
    with scratch:
        first = scratch.keep(C.nearest_to_median(exposures, ["group"], "cd_angle", "file").select("group", F.col("file").alias("reference")))

        def against(references: DataFrame) -> DataFrame:
            asked = exposures.join(references, "group")
            others = asked.where(F.col("file") != F.col("reference")).select("group", "file", "reference")
            return others.join(measure(asked), PAIR, "left").withColumn("bad", F.coalesce(bad, F.lit(True)))

        once = scratch.keep(against(first))
        counts = once.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("n_bad"))
        suspect = counts.where((F.col("n_bad") > share * F.col("n")) & (F.col("n") >= 2)).select("group")
        turn = exposures.join(suspect, "group").join(first, "group").where(F.col("file") != F.col("reference"))
        second = scratch.keep(turn.groupBy("group").agg(F.min_by("file", "pos").alias("reference")))
        twice = against(second)
        kept = once.join(second.select("group"), "group", "left_anti").withColumn("anchored", F.lit(1)).unionByName(twice.withColumn("anchored", F.lit(2)))
        return checkpoint(kept)
