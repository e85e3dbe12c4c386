"""Exposures from files, and the partner channel: what the other exposures of a pointing show at each pixel of one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import wcs as W
from ..operators import align
from ..operators import images as I
from ..operators import stats as S
from ..session import checkpoint
from ..sources import fits_source as FS

GOOD_BITS = 16 | 64 | 256 | 2048
CHIP = ["file", "ver"]
EDGE = 1e-6  # pixels that a place on the very edge may miss it by, as coordinates are rounded


def chips_of(units: DataFrame) -> DataFrame:
    """(file, ver, exptime, height, width, wcs, sip) of each science image; the exposure time is the primary header's, 1 where missing or 0."""
    known = F.map_from_arrays(F.transform(F.map_keys("header"), lambda k: F.concat(F.lit("h1_"), k)), F.map_values("header"))
    times = units.where("hdu = 0").select("file", F.coalesce(F.nullif(F.try_element_at("header", F.lit("EXPTIME")).try_cast("double"), F.lit(0.0)), F.lit(1.0)).alias("exptime"))
    number = lambda k: F.try_element_at("header", F.lit(k)).try_cast("int")
    chips = units.where("name = 'SCI'").select(*CHIP, number("NAXIS2").alias("height"), number("NAXIS1").alias("width"), W.from_header(known).alias("wcs"), W.sip_from_header(known).alias("sip"))
    return chips.join(times, "file")


def load(spark: SparkSession, path: str, *, good_bits: int = GOOD_BITS, radius: int = 2, step: int = 8, **options) -> tuple[DataFrame, DataFrame]:
    """(chips, pixels) of all exposures under ``path``: ``chips_of`` with the sky, and (file, ver, y, x, elec, v).

    ``elec`` are the values, where pixels flagged by other than good bits have the median of their good neighbours, mirrored at the edges and
    filled inwards until nothing is left to fill; an exposure without flags stays as it is.  ``v`` is the rate less the sky, the median of every
    ``step``-th pixel of every ``step``-th line.  A task reads one image of one file, by lines.
    """
    chips = checkpoint(chips_of(FS.read_units(spark, path, **options)))
    lines = FS.read_rows(spark, path, names="SCI", **options).join(chips.select(*CHIP, "height", "width").hint("merge"), CHIP)
    values = lines.select(*CHIP, "height", "width", "y", F.posexplode("data").alias("x", "v"))
    flags = FS.read_rows(spark, path, names="DQ", **options).select(*CHIP, "y", F.posexplode("data").alias("x", "dq"))
    bad = flags.where(E.bad_quality(F.col("dq").cast("int"), good_bits)).select(*CHIP, "y", "x", F.lit(True).alias("bad"))
    filled = I.median_fill(values.join(bad.hint("merge"), [*CHIP, "y", "x"], "left"), CHIP, "bad", radius, None, "height", "width")
    rates = filled.join(chips.select(*CHIP, "exptime").hint("merge"), CHIP).select(*CHIP, "y", "x", F.col("v").alias("elec"), E.rate(F.col("v"), F.col("exptime")).alias("v"))
    sky = rates.where((F.col("y") % step == 0) & (F.col("x") % step == 0)).groupBy(*CHIP).agg(F.median("v").alias("sky"))
    return chips.join(sky, CHIP, "left"), rates.join(sky.hint("merge"), CHIP).withColumn("v", F.col("v") - F.col("sky")).drop("sky")


def pairs_of(chips: DataFrame, pointing: Sequence[str]) -> DataFrame:
    """Each chip with each other exposure's chip of the same version and pointing: (file, ver, partner) and both sides' coordinates."""
    here = chips.select(*pointing, *CHIP, F.col("wcs").alias("wcs_a"), F.col("sip").alias("sip_a"), "height", "width")
    there = chips.select(*pointing, F.col("file").alias("partner"), "ver", F.col("wcs").alias("wcs_b"), F.col("sip").alias("sip_b"), F.col("height").alias("height_b"), F.col("width").alias("width_b"))
    return here.join(there, [*pointing, "ver"]).where(F.col("file") != F.col("partner"))


def places_of(pairs: DataFrame, crop: int | None = None, inside: bool = False, *, at_once: int = 1 << 16) -> DataFrame:
    """(file, ver, partner, y, x, py, px, height_b, width_b): where each pixel of a pair's first chip (of its central ``crop`` squared) falls in the partner.

    A row for each pixel is made from a row for each pair, ``at_once`` pixels in a run of whole lines, so a task never holds a chip.  ``py`` and ``px`` are
    moved by the pair's (sy, sx); ``inside`` keeps those that lie in the partner before they are moved.  Pairs without coordinates have no places.
    """
    kinds = dict(pairs.dtypes)
    none = F.array(*[F.lit(0.0)] * (2 * len(W.terms())))
    both = lambda sip: F.coalesce(F.concat(f"{sip}.a", f"{sip}.b"), none)
    flat = pairs.dropna(subset=["wcs_a", "wcs_b", "height", "width", "height_b", "width_b"]).select(*CHIP, "partner", "height", "width", "height_b", "width_b", "sy", "sx", *[F.array(*[f"{w}.{n}" for n in W.FIELDS]).alias(w) for w in ("wcs_a", "wcs_b")], both("sip_a").alias("sip_a"), both("sip_b").alias("sip_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            height, width = b["height"].to_numpy(), b["width"].to_numpy()
            top, left = (np.zeros_like(height), np.zeros_like(width)) if crop is None else (height // 2 - crop // 2, width // 2 - crop // 2)
            bottom, right = (height, width) if crop is None else (np.minimum(top + crop, height), np.minimum(left + crop, width))
            top, left = np.maximum(top, 0), np.maximum(left, 0)
            tall, wide = np.maximum(bottom - top, 0), np.maximum(right - left, 0)
            sides = [np.array(b[c].tolist(), float).T for c in ("wcs_a", "wcs_b", "sip_a", "sip_b")]
            pair = np.repeat(np.arange(len(b)), tall)
            line = np.arange(len(pair)) - np.repeat(np.cumsum(tall) - tall, tall) + top[pair]
            ends = np.cumsum(wide[pair])
            start = 0
            while start < len(pair):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, side="right")))
                many = wide[pair[start:stop]]
                k, y = np.repeat(pair[start:stop], many), np.repeat(line[start:stop], many)
                x = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + left[k]
                wcs_a, wcs_b, sip_a, sip_b = ([row[k] if row.any() else zero for row in side] for side in sides for zero in (np.zeros(len(k)),))
                n = len(W.terms())
                px, py = W.project_arrays(wcs_a, wcs_b, x.astype(float), y.astype(float), (sip_a[:n], sip_a[n:]), (sip_b[:n], sip_b[n:]))
                kept = np.isfinite(py) & np.isfinite(px)
                if inside:
                    h, w = b["height_b"].to_numpy()[k], b["width_b"].to_numpy()[k]
                    kept &= (py >= -EDGE) & (py <= h - 1.0 + EDGE) & (px >= -EDGE) & (px <= w - 1.0 + EDGE)
                k = k[kept]
                out = b[[*CHIP, "partner"]].iloc[k].reset_index(drop=True)
                yield out.assign(y=y[kept], x=x[kept], py=py[kept] + b["sy"].to_numpy()[k], px=px[kept] + b["sx"].to_numpy()[k], height_b=b["height_b"].to_numpy()[k], width_b=b["width_b"].to_numpy()[k])
                start = stop

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return flat.repartition(n, *CHIP, "partner").mapInPandas(run, f"file {kinds['file']}, ver {kinds['ver']}, partner {kinds['partner']}, y int, x int, py double, px double, height_b int, width_b int")


def residual_shifts(pairs: DataFrame, pixels: DataFrame, cells: DataFrame, *, crop: int, least: float = 0.05, most: float = 2.0, reach: float = 3.0) -> DataFrame:
    """(file, ver, partner, dy, dx, peak, applied): how far each pair is still apart in its central ``crop`` squared, and whether that is to be applied.

    A shift is applied where it is over ``least`` and at most ``most`` pixels: less is noise, more says that the coordinates are wrong.
    """
    near = places_of(pairs.withColumns({"sy": F.lit(0.0), "sx": F.lit(0.0)}), crop)
    seen = align.sample_at(near, cells, ["partner", "ver"], F.col("height_b"), F.col("width_b")).join(pixels.select(*CHIP, "y", "x", "v").hint("merge"), [*CHIP, "y", "x"])
    tiles = seen.groupBy(*CHIP, "partner").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v", "sampled"))).alias("_r"))
    tiles = tiles.where(F.size("_r") == crop * crop).select(*CHIP, "partner", F.col("_r.v").alias("a"), F.col("_r.sampled").alias("b"))
    found = align.tile_shifts(tiles, [*CHIP, "partner"], size=crop, reach=reach)
    size = F.hypot("dy", "dx")
    return found.withColumn("applied", (size > least) & (size <= most))


def partner_channel(chips: DataFrame, pixels: DataFrame, pointing: Sequence[str], *, refine: bool = False, crop: int = 1024) -> DataFrame:
    """(file, ver, y, x, v, partner, covered): each pixel with the mean of what the partners that cover its place show there, and how many do.

    Places go through both chips' coordinates with their polynomials; a partner's value is bilinear.  Where no partner has looked, the pixel is its own
    partner.  With ``refine`` the pairs' residual shifts are measured on their centres and those between the limits are applied, each to its pair alone.
    ``pixels`` are read several times, so they should be written ones; places are worked out from the chips' sizes, a run of lines at a time.
    """
    keys = [*CHIP, "partner"]
    cells = align.quads(pixels, CHIP).withColumnRenamed("file", "partner")
    pairs = pairs_of(chips, pointing)
    if refine:
        shifts = checkpoint(residual_shifts(pairs, pixels, cells, crop=crop)).where("applied").select(*keys, F.col("dy").alias("sy"), F.col("dx").alias("sx"))
        pairs = pairs.join(shifts, keys, "left").withColumns({"sy": F.coalesce("sy", F.lit(0.0)), "sx": F.coalesce("sx", F.lit(0.0))})
    else:
        pairs = pairs.withColumns({"sy": F.lit(0.0), "sx": F.lit(0.0)})
    seen = align.sample_at(places_of(pairs, inside=True), cells, ["partner", "ver"], F.col("height_b"), F.col("width_b"))
    mean = seen.groupBy(*CHIP, "y", "x").agg(F.avg("sampled").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    joined = pixels.select(*CHIP, "y", "x", "v").join(mean.hint("merge"), [*CHIP, "y", "x"], "left")
    return joined.select(*CHIP, "y", "x", "v", F.coalesce("_mean", "v").alias("partner"), F.coalesce("_n", F.lit(0)).alias("covered"))


def gap_weight(pixels: DataFrame, keys: Sequence[str], height: int | str, width: int | str, sigma: float = 8.0) -> DataFrame:
    """``pixels`` (with covered) and ``weight``: 1 where partners are near all around, falling to 0 into what none covers, as a Gaussian of ``sigma`` rounds the mask.

    Only the pixels without cover spread, along lines and then along columns, mirrored at the edges, so the cost goes with the gap and not with the image.
    """
    reach = int(4 * sigma + 0.5)
    weights = [2.718281828459045 ** (-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / sum(weights)).alias("w")) for d, w in zip(range(-reach, reach + 1), weights, strict=True)])
    sizes = {s: (F.col(s) if isinstance(s, str) else F.lit(s)) for s in (height, width)}

    def spread(rows: DataFrame, axis: str, size: Column) -> DataFrame:
        periods = F.sequence(-F.ceil(F.lit(reach) / (2 * size)).cast("int"), F.ceil(F.lit(reach) / (2 * size)).cast("int"))
        images = F.flatten(F.transform(periods, lambda j: F.array(F.col(axis) + 2 * size * j, 2 * size * j - 1 - F.col(axis))))  # mirrored at the edges, whose pixels count twice
        each = rows.withColumn("_m", F.explode(images)).withColumn("_k", F.explode(kernel)).withColumn(axis, (F.col("_m") + F.col("_k.d")).cast("int"))
        inside = each.where((F.col(axis) >= 0) & (F.col(axis) < size))
        return inside.groupBy(*keys, "y", "x", *[s for s in sizes if isinstance(s, str)]).agg(F.sum(F.col("_g") * F.col("_k.w")).alias("_g"))

    gaps = pixels.where("covered = 0").select(*keys, "y", "x", *[s for s in sizes if isinstance(s, str)], F.lit(1.0).alias("_g"))
    blurred = spread(spread(gaps, "x", sizes[width]), "y", sizes[height]).select(*keys, "y", "x", "_g")
    return pixels.join(blurred, [*keys, "y", "x"], "left").withColumn("weight", 1 - F.coalesce("_g", F.lit(0.0))).drop("_g")


def write_changed(spark: SparkSession, source: str, out: str, pixels: DataFrame, change: Callable[[Column, Column], Column], extra: DataFrame | None = None, **options) -> None:
    """Write the files of ``pixels`` (file, ver, y, x, v) anew under ``out``: their science images have the new values, all other units their old bytes.

    ``change(name, cards)`` gives each unit's cards, which are the source's own otherwise; ``extra`` (file, ver, and columns that ``change`` reads) is joined to the
    science units.  Files appear under their names when all are written, see ``write_files``.
    """
    files = pixels.select("file").distinct()
    units = FS.read_units(spark, source, **options).join(files, "file", "left_semi")
    science = F.col("name") == "SCI"
    places = units.where(science).select(*CHIP, "hdu")
    told = units if extra is None else units.join(extra.withColumn("name", F.lit("SCI")), ["file", "name", "ver"], "left")
    lines = pixels.groupBy(*CHIP, "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("_r")).select(*CHIP, "y", F.col("_r.v").alias("data"))
    others = FS.read_rows(spark, source, **options).where(~science).join(files, "file", "left_semi").select("file", "hdu", "y", "data")
    FS.write_files(told.select("file", "hdu", change(F.col("name"), F.col("cards")).alias("cards")), lines.join(places, CHIP).select("file", "hdu", "y", "data").unionByName(others), out)


def one_channel(spark: SparkSession, source: str, out: str, *, alpha: float = 0.9, model: Column | None = None, note: str = "denoised by one channel", **options) -> DataFrame:
    """The one-channel chain from files to files: flags repaired, denoised, put back on the exposure's own level, blended, written; (file, ver, y, x, v) as written.

    ``model`` is a column over v (the repaired value) and near (the median of the pixels around); without one, their mean.  The denoised image is shifted by
    the clipped median of its difference from the exposure.  Science units get a HISTORY card, error units ERRSTALE, and all else stays as it was.
    """
    _, loaded = load(spark, source, **options)
    own = loaded.select(*CHIP, "y", "x", F.col("elec").alias("v"))
    ring = I.at_neighbours(own.select(*CHIP, "y", "x"), CHIP, own, I.ring(1), {"v": "_n"}).groupBy(*CHIP, "y", "x").agg(F.median("_n").alias("near"))
    den = own.join(ring, [*CHIP, "y", "x"]).withColumn("den", model if model is not None else (F.col("v") + F.col("near")) / 2)
    shift = S.clipped_median(den.withColumn("diff", F.col("v") - F.col("den")), CHIP, "diff").select(*CHIP, F.col("med").alias("shift"))
    done = checkpoint(den.join(shift, CHIP).select(*CHIP, "y", "x", E.blend(F.col("den") + F.col("shift"), F.col("v"), alpha).alias("v")))
    change = lambda name, cards: F.when(name == "SCI", FS.with_history(cards, F.lit(note))).when(name == "ERR", FS.with_card(cards, "ERRSTALE", F.lit(True), "logical")).otherwise(cards)
    write_changed(spark, source, out, done, change, **options)
    return done
