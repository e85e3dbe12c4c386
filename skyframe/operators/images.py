"""Image operators on pixels in long form (keys, y, x, v): filters, sources, profiles, matches, fills, stacks.

A chip is one value of the keys; pixels are rows, so chips and tiles spread over tasks, and neighbours
meet by windows or by joins on (keys, y, x).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import MAD_SCALE, ring_ratio_ok
from ..session import Scratch, checkpoint
from .graph import connected_components
from .stats import clipped_median


def to_pixels(df: DataFrame, keys: Sequence[str], array: str, width: int) -> DataFrame:
    """A row-major array per chip as pixels."""
    each = df.select(*keys, F.posexplode(array).alias("_p", "_v"))
    return each.select(*keys, F.floor(F.col("_p") / width).cast("int").alias("y"), (F.col("_p") % width).cast("int").alias("x"), F.col("_v").cast("double").alias("v"))


def to_tiles(pixels: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Square tiles with their pixels as a row-major array of floats; a tile is what one group holds at most."""
    ty, tx = F.floor(F.col("y") / size).cast("int"), F.floor(F.col("x") / size).cast("int")
    rows = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    tiled = pixels.groupBy(*keys, ty.alias("ty"), tx.alias("tx")).agg(rows.alias("_r"))
    return tiled.select(*keys, "ty", "tx", F.transform("_r.v", lambda v: v.cast("float")).alias("data"))


def square(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def ring(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy, dx in square(radius) if max(abs(dy), abs(dx)) == radius]


CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def diamond(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy, dx in square(radius) if abs(dy) + abs(dx) <= radius]


def offsets(pairs: Sequence[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in pairs])


def at_neighbours(points: DataFrame, keys: Sequence[str], pixels: DataFrame, shape: Sequence[tuple[int, int]], columns: dict[str, str]) -> DataFrame:
    """Each point with each pixel of the shape about it; ``columns`` names the pixels' columns in the result."""
    spread = points.withColumn("_o", F.explode(offsets(shape))).withColumns({"_y": F.col("y") + F.col("_o.dy"), "_x": F.col("x") + F.col("_o.dx")}).drop("_o")
    other = pixels.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), *[F.col(c).alias(n) for c, n in columns.items()])
    return spread.join(other, [*keys, "_y", "_x"])


# ------------------------------------------------------------------ filters


def max_filter(pixels: DataFrame, keys: Sequence[str], radius: int, name: str = "box_max") -> DataFrame:
    """Greatest value in the square about each pixel: first along rows, then along columns."""
    along_x = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-radius, radius)
    along_y = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-radius, radius)
    return pixels.withColumn("_m", F.max("v").over(along_x)).withColumn(name, F.max("_m").over(along_y)).drop("_m")


def local_maxima(pixels: DataFrame, keys: Sequence[str], radius: int, edge: int, height: int, width: int, threshold: Column) -> DataFrame:
    """Pixels at their square's maximum and over the threshold, off the edges; a plateau gives several."""
    inside = F.col("y").between(edge, height - 1 - edge) & F.col("x").between(edge, width - 1 - edge)
    return max_filter(pixels, keys, radius).where((F.col("v") >= F.col("box_max")) & (F.col("v") > threshold) & inside)


def smooth(df: DataFrame, keys: Sequence[str], position: str, value: str, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing of a profile in which missing values have no weight; the ends are the nearest values'."""
    r = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    table = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in zip(range(-r, r + 1), weights, strict=True)])
    ends = df.groupBy(*keys).agg(F.min(position).alias("_lo"), F.max(position).alias("_hi"))
    asked = df.join(ends, list(keys)).select(*keys, F.col(position).alias("_at"), "_lo", "_hi", F.explode(table).alias("_t"))
    asked = asked.withColumn(position, F.greatest("_lo", F.least("_hi", F.col("_at") + F.col("_t.d"))))
    got = asked.join(df.select(*keys, position, F.col(value).alias("_v")), [*keys, position]).where("_v IS NOT NULL")
    return got.groupBy(*keys, F.col("_at").alias(position)).agg((F.sum(F.col("_v") * F.col("_t.w")) / F.sum("_t.w")).alias(f"{value}_smooth"))


def lowpass(pixels: DataFrame, keys: Sequence[str], sigma: float, mask: Column | None = None, truncate: float = 4.0) -> DataFrame:
    """Two-dimensional Gaussian low-pass normalised by its mask: weighted sums along rows, then along columns, at places within the image alone.

    Pixels are many more than their files' bytes tell, so no side of a join is broadcast.
    """
    r = int(truncate * sigma + 0.5)
    w = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(math.exp(-0.5 * (d / sigma) ** 2)).alias("w")) for d in range(-r, r + 1)])
    good = pixels if mask is None else pixels.where(mask)
    ends = pixels.groupBy(*keys).agg(*[f(c).alias(f"_{c}{n}") for c in ("y", "x") for f, n in ((F.min, 0), (F.max, 1))])
    limits = ["_y0", "_y1", "_x0", "_x1"]
    rows = good.select(*keys, "y", "x", F.col("v").alias("a"), F.lit(1.0).alias("b")).join(ends.hint("merge"), list(keys))
    for axis in ("x", "y"):
        other = "y" if axis == "x" else "x"
        near = F.filter(w, lambda t: (F.col(axis) + t.d).between(F.col(f"_{axis}0"), F.col(f"_{axis}1")))  # noqa: B023
        spread = rows.withColumn("_t", F.explode(near)).withColumn(axis, F.col(axis) + F.col("_t.d"))
        rows = spread.groupBy(*keys, *limits, other, axis).agg(F.sum(F.col("a") * F.col("_t.w")).alias("a"), F.sum(F.col("b") * F.col("_t.w")).alias("b"))
    return pixels.join(rows.drop(*limits).hint("merge"), [*keys, "y", "x"], "left").withColumn("low", F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).drop("a", "b")


def interpolate(df: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """Missing values of a profile on the line between their neighbours; flat beyond the ends."""
    back = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*keys).orderBy(position).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(position))
    out = df.withColumns({"_v0": F.last(value, True).over(back), "_p0": F.last(known, True).over(back), "_v1": F.first(value, True).over(on), "_p1": F.first(known, True).over(on)})
    line = F.when(F.col("_p0") == F.col("_p1"), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(position) - F.col("_p0")) / F.nullif(F.col("_p1") - F.col("_p0"), F.lit(0)))
    return out.withColumn(f"{value}_filled", F.coalesce(line, "_v0", "_v1")).drop("_v0", "_v1", "_p0", "_p1")


# ------------------------------------------------------------------ sources


def ring_ratio(peaks: DataFrame, keys: Sequence[str], pixels: DataFrame, shape: Sequence[tuple[int, int]] = tuple(CROSS), name: str = "ratio") -> DataFrame:
    """Mean of the pixels of a ring over the peak's value (at least 1e-6)."""
    got = at_neighbours(peaks.select(*keys, "y", "x", "v"), keys, pixels, shape, {"v": "_n"})
    return got.groupBy(*keys, "y", "x", "v").agg((F.avg("_n") / F.greatest(F.first("v"), F.lit(1e-6))).alias(name))


def psf_like(peaks: DataFrame, keys: Sequence[str], pixels: DataFrame, low: float = 0.15, high: float = 0.95) -> DataFrame:
    return ring_ratio(peaks, keys, pixels).where(ring_ratio_ok(F.col("ratio"), low, high))


def aperture_flux(peaks: DataFrame, keys: Sequence[str], pixels: DataFrame, radius: int, sky: str) -> DataFrame:
    """Sum over the square about each source, less the sky under it."""
    got = at_neighbours(peaks.select(*keys, "y", "x", F.col(sky).alias("_sky")), keys, pixels, square(radius), {"v": "_n"})
    return got.groupBy(*keys, "y", "x").agg((F.sum("_n") - F.count("_n") * F.first("_sky")).alias("flux"), F.count("_n").alias("n_pix"))


def centroid(peaks: DataFrame, keys: Sequence[str], pixels: DataFrame, radius: int = 3) -> DataFrame:
    """Centre of weight about each source, of values over their median; null without any."""
    got = at_neighbours(peaks.select(*keys, "y", "x"), keys, pixels, square(radius), {"v": "_n"})
    each = got.groupBy(*keys, "y", "x").agg(F.median("_n").alias("_mid"), F.collect_list(F.struct("_n", "_y", "_x")).alias("_r"))
    return each.select(*keys, "y", "x", *centre_of("_r", "_mid"))


def centre_of(box: str, middle: str) -> tuple[Column, Column]:
    """Columns cy and cx: the centre of weight of an array of (_n, _y, _x), weighted by what each value has over the middle; null without any."""
    weight = lambda p: F.greatest(p["_n"] - F.col(middle), F.lit(0.0))
    total = lambda value: F.aggregate(F.filter(box, lambda p: p["_n"].isNotNull()), F.lit(0.0), lambda s, p: s + weight(p) * value(p))
    whole = F.nullif(total(lambda p: F.lit(1.0)), F.lit(0.0))
    return (total(lambda p: p["_y"]) / whole).alias("cy"), (total(lambda p: p["_x"]) / whole).alias("cx")


def hit_map(hits: DataFrame, image: str, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pixels hit in at least ``least`` images: marks of the detector, not of the sky."""
    return hits.groupBy(*keys, "y", "x").agg(F.countDistinct(image).alias("images")).where(F.col("images") >= least)


def near_map(points: DataFrame, marks: DataFrame, radius: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Points that have a mark in the square about them."""
    spread = marks.select(*keys, "y", "x").withColumn("_o", F.explode(offsets(square(radius))))
    near = spread.select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")).distinct()
    return points.join(near, [*keys, "y", "x"], "left_semi")


def column_counts(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hot pixels of each column, and their median, 99th percentile and maximum over columns."""
    per = hits.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.median("n").alias("med"), F.percentile("n", 0.99).alias("p99"), F.max("n").alias("most"), F.count(F.lit(1)).alias("columns"))


def cross_match(sources: DataFrame, pixels: DataFrame, keys: Sequence[str], reach: int, least: Column, margin: int, height: int, width: int) -> DataFrame:
    """For each source, at its rounded place (py, px) in the partner, the brightest pixel within ``reach``; the first in row order of equals.

    Sources whose place is within ``margin`` of the edges, or whose best pixel isn't over ``least``, have no match.
    """
    inside = F.col("py").between(margin, height - 1 - margin) & F.col("px").between(margin, width - 1 - margin)
    placed = sources.where(inside).withColumns({"_sy": F.col("y"), "_sx": F.col("x"), "y": F.col("py"), "x": F.col("px")})
    near = at_neighbours(placed, keys, pixels, square(reach), {"v": "_n"})
    best = F.max(F.struct(F.col("_n").alias("v"), (-F.col("_y")).alias("ny"), (-F.col("_x")).alias("nx"))).alias("_b")
    got = near.groupBy(*keys, F.col("_sy").alias("y"), F.col("_sx").alias("x"), "py", "px").agg(best)
    got = got.select(*keys, "y", "x", "py", "px", (-F.col("_b.ny")).alias("my"), (-F.col("_b.nx")).alias("mx"), F.col("_b.v").alias("peak"))
    return got.where(F.col("peak") > least).withColumns({"dy": F.col("my") - F.col("py"), "dx": F.col("mx") - F.col("px")})


def confirmed(matches: DataFrame, keys: Sequence[str], partner: str, least: int = 2) -> DataFrame:
    """Sources that at least ``least`` partners show."""
    return matches.groupBy(*keys, "y", "x").agg(F.countDistinct(partner).alias("votes")).where(F.col("votes") >= least)


def votes_of_others(sources: DataFrame, hits: DataFrame, group: Sequence[str], keys: Sequence[str], partner: str, least: int = 2) -> DataFrame:
    """``confirmed`` where all images of a group share one grid: the images of the group with a hit at the source's pixel, less the source's own.

    Hits are counted once for each pixel of the group, so nothing meets pair by pair.  ``sources``: group, keys, y, x; ``hits``: group, partner, y, x, one row each.
    """
    at = [*group, "y", "x"]
    counts = hits.groupBy(*at).agg(F.count(F.lit(1)).alias("_all"))
    own = hits.select(*at, F.col(partner).alias(keys[-1]), F.lit(1).alias("_own"))
    both = sources.join(counts, at).join(own, [*at, keys[-1]], "left").withColumn("votes", F.col("_all") - F.coalesce("_own", F.lit(0)))
    return both.where(F.col("votes") >= least).select(*keys, "y", "x", "votes")


def partner_ratio(sources: DataFrame, pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The partner's value at the source's rounded place over the source's own; null out of bounds."""
    other = pixels.select(*keys, F.col("y").alias("py"), F.col("x").alias("px"), F.col("v").alias("_n"))
    return sources.join(other, [*keys, "py", "px"], "left").withColumn("partner_ratio", F.col("_n") / F.greatest("v", F.lit(1e-6))).drop("_n")


# ------------------------------------------------------------------ profiles


def row_profile(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*keys, "y").agg(F.median("v").alias("row_med"))


def stripe_metric(pixels: DataFrame, keys: Sequence[str], k: float = 3.0) -> DataFrame:
    """Scatter of the rows' medians over pixels under the median and k MAD sigmas."""
    mid = pixels.groupBy(*keys).agg(F.median("v").alias("_m"))
    sig = pixels.join(mid, list(keys)).groupBy(*keys).agg(F.first("_m").alias("_m"), (MAD_SCALE * F.median(F.abs(F.col("v") - F.col("_m")))).alias("_s"))
    quiet = pixels.join(sig, list(keys)).where(F.col("v") < F.col("_m") + k * F.col("_s"))
    return row_profile(quiet, keys).groupBy(*keys).agg(F.stddev_pop("row_med").alias("stripe"), F.count(F.lit(1)).alias("rows"))


def angle_profile(pixels: DataFrame, keys: Sequence[str], angles: Sequence[float], least: int) -> DataFrame:
    """Mean value in strips of unit width across each angle; a strip needs ``least`` pixels.

    A pixel goes to one strip for each angle, summed map-side, so the rows that move are strips.
    """
    table = F.array(*[F.struct(F.lit(float(a)).alias("angle"), F.lit(math.cos(math.radians(a))).alias("c"), F.lit(math.sin(math.radians(a))).alias("s")) for a in angles])
    each = pixels.select(*keys, "y", "x", "v", F.explode(table).alias("_a"))
    each = each.select(*keys, F.col("_a.angle").alias("angle"), F.floor(F.round(F.col("y") * F.col("_a.c") - F.col("x") * F.col("_a.s"), 9)).cast("int").alias("bin"), "v")
    return each.groupBy(*keys, "angle", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).where(F.col("n") >= least)


def angle_scan(pixels: DataFrame, keys: Sequence[str], angles: Sequence[float], least: int, detrend: float) -> DataFrame:
    """Power of each angle's profile after its trend and its noise are taken away."""
    profile = angle_profile(pixels, keys, angles, least)
    flat = smooth(profile, [*keys, "angle"], "bin", "mean", detrend)
    sigma = pixels.groupBy(*keys).agg(F.var_pop("v").alias("_var"))
    off = profile.join(flat, [*keys, "angle", "bin"]).join(sigma, list(keys)).withColumn("_d", F.pow(F.col("mean") - F.col("mean_smooth"), 2) - F.col("_var") / F.col("n"))
    return off.groupBy(*keys, "angle").agg(F.avg("_d").alias("power"), F.count(F.lit(1)).alias("bins"))


def windowed_profile(pixels: DataFrame, keys: Sequence[str], window: int, step: int, least: int, across: str = "y", along: str = "x") -> DataFrame:
    """Median across the stripes in overlapping windows along them: each pixel counts in every window whose centre is at most half a window away."""
    half = window / 2
    first, last = F.ceil((F.col(along) - half) / step), F.floor((F.col(along) + half) / step)
    each = pixels.withColumn("centre", F.explode(F.sequence(first, last))).withColumn("centre", F.col("centre") * step).where("centre >= 0")
    return each.groupBy(*keys, across, "centre").agg(F.count("v").alias("n"), F.when(F.count("v") >= least, F.median("v")).alias("med"))


def destripe(pixels: DataFrame, keys: Sequence[str], *, detrend: float, least: int, mask: Column | None = None) -> DataFrame:
    """Take each row's median, less the rows' own trend and shrunk by its noise, away from the pixels of the row."""
    good = pixels if mask is None else pixels.where(mask)
    rows = good.groupBy(*keys, "y").agg(F.count("v").alias("n"), F.when(F.count("v") >= least, F.median("v")).alias("med"), F.var_pop("v").alias("var"))
    trend = smooth(rows, keys, "y", "med", detrend)
    off = rows.join(trend, [*keys, "y"]).withColumn("off", F.col("med") - F.col("med_smooth"))
    signal = off.groupBy(*keys).agg(F.greatest(F.var_pop("off") - F.avg(F.pow(F.lit(1.2533), 2) * F.col("var") / F.col("n")), F.lit(0.0)).alias("_s"))
    noise = F.pow(F.lit(1.2533), 2) * F.col("var") / F.greatest("n", F.lit(1))
    kept = off.join(signal, list(keys)).withColumn("off", F.coalesce(F.col("off") * F.col("_s") / F.nullif(F.col("_s") + noise, F.lit(0.0)), F.lit(0.0)))
    return pixels.join(kept.select(*keys, "y", "off"), [*keys, "y"], "left").withColumn("v", F.col("v") - F.coalesce("off", F.lit(0.0))).drop("off")


def destripe_along(pixels: DataFrame, keys: Sequence[str], *, least: int, detrend: float, mask: Column | None = None, amount: Column | None = None) -> DataFrame:
    """Take the median of each strip of unit width across the image's ``angle`` (a column, in degrees), less the strips' own trend, away from its pixels.

    Pixels without an angle (null), and strips with under ``least`` pixels, stay as they are; ``amount`` (a column over n) scales what is taken.
    """
    turn = F.radians("angle")
    placed = pixels.withColumn("_bin", F.floor(F.round(F.col("y") * F.cos(turn) - F.col("x") * F.sin(turn), 9)))
    good = placed.where(F.col("_bin").isNotNull() if mask is None else F.col("_bin").isNotNull() & mask)
    strips = good.groupBy(*keys, "_bin").agg(F.count("v").alias("n"), F.when(F.count("v") >= least, F.median("v")).alias("med"))
    trend = smooth(strips, keys, "_bin", "med", detrend)
    off = (F.col("med") - F.col("med_smooth")) * (F.lit(1.0) if amount is None else amount)
    kept = strips.join(trend, [*keys, "_bin"]).select(*keys, "_bin", off.alias("_off"))
    return placed.join(kept, [*keys, "_bin"], "left").withColumn("v", F.col("v") - F.coalesce("_off", F.lit(0.0))).drop("_bin", "_off")


def linear_rows(profile: DataFrame, keys: Sequence[str], power: str, position: str, share: float, few: int) -> DataFrame:
    """Rows of a profile that alone hold ``share`` of its power: a trail or an edge, no stripes."""
    w = Window.partitionBy(*keys).orderBy(F.desc(power), position)
    ranked = profile.withColumns({"_rank": F.row_number().over(w), "_all": F.sum(power).over(Window.partitionBy(*keys))})
    top = ranked.where(F.col("_rank") <= few)
    held = top.groupBy(*keys).agg((F.sum(power) / F.nullif(F.first("_all"), F.lit(0.0))).alias("held")).where(F.col("held") >= share)
    return top.join(held, list(keys)).select(*keys, position, power, "held")


def autocorrelation(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag-1 autocorrelation of the values less their mean, the average of both axes."""
    mean = pixels.groupBy(*keys).agg(F.avg("v").alias("_m"))
    d = pixels.join(mean, list(keys)).withColumn("_d", F.col("v") - F.col("_m"))
    right = F.lead("_d").over(Window.partitionBy(*keys, "y").orderBy("x"))
    down = F.lead("_d").over(Window.partitionBy(*keys, "x").orderBy("y"))
    both = d.withColumns({"_r": right, "_u": down})
    var = F.avg(F.col("_d") * F.col("_d"))
    return both.groupBy(*keys).agg(((F.avg(F.col("_d") * F.col("_r")) + F.avg(F.col("_d") * F.col("_u"))) / 2 / F.nullif(var, F.lit(0.0))).alias("acf1"))


def tile_scale(pixels: DataFrame, keys: Sequence[str], size: int, height: int, width: int) -> DataFrame:
    """Median over full tiles of p99 - p1; null where the image has no full tile."""
    ty, tx = F.floor(F.col("y") / size), F.floor(F.col("x") / size)
    full = pixels.where((F.col("y") < height // size * size) & (F.col("x") < width // size * size))
    tiles = full.groupBy(*keys, ty.alias("ty"), tx.alias("tx")).agg(F.percentile("v", [0.01, 0.99]).alias("_p"))
    return tiles.groupBy(*keys).agg(F.median(F.col("_p")[1] - F.col("_p")[0]).alias("scale"), F.count(F.lit(1)).alias("tiles"))


# ------------------------------------------------------------------ repairs and stacks


def reflected(c: Column, size: int) -> Column:
    """A place beyond an edge, mirrored at the edge's pixel."""
    return F.when(c < 0, -c).when(c > size - 1, 2 * (size - 1) - c).otherwise(c)


def reflect_pad(pixels: DataFrame, height: int, width: int, multiple: int = 32) -> DataFrame:
    """Images grown on all sides, by mirroring, to the next size that ``multiple`` divides; what is odd goes to the bottom and the right.

    A pixel goes to the few places that mirror it, so no image is put together.
    """

    def places(c: Column, size: int) -> Column:
        more = -size % multiple
        low, high = -(more // 2), size - 1 + more - more // 2
        mirrored = F.array(c, -c, 2 * (size - 1) - c)
        return F.explode(F.array_distinct(F.filter(mirrored, lambda p: p.between(low, high))))

    return pixels.withColumn("y", places(F.col("y"), height)).withColumn("x", places(F.col("x"), width))


def unpad(pixels: DataFrame, height: int, width: int, multiple: int = 32) -> DataFrame:
    """The image that reflect_pad has grown; its own places were kept."""
    return pixels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def median_fill(pixels: DataFrame, keys: Sequence[str], bad: str, radius: int = 2, rounds: int | None = 1, height: int | str | None = None, width: int | str | None = None) -> DataFrame:
    """Bad pixels get the median of the good ones in the square about them, mirrored at the edges where the size is given (a number, or a column's name).

    Each round fills what has a good neighbour and calls it good; values under repair are never read.  With ``rounds`` None rounds go on until one fills
    nothing, each written to the shared folder, so a hole of any width closes from its rim.  Pixels, packed well in these files, are never broadcast.
    """
    sizes = [s for s in (height, width) if isinstance(s, str)]
    mirror = lambda c, size: c if size is None else reflected(c, F.col(size) if isinstance(size, str) else size)

    def fill(rows: DataFrame) -> DataFrame:
        holes = rows.where("_bad").select(*keys, "y", "x", *sizes).withColumn("_o", F.explode(offsets(square(radius))))
        asked = holes.select(*keys, "y", "x", mirror(F.col("y") + F.col("_o.dy"), height).alias("_y"), mirror(F.col("x") + F.col("_o.dx"), width).alias("_x"))
        good = rows.where("NOT _bad AND v IS NOT NULL").select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("_n"))
        found = asked.join(good.hint("merge"), [*keys, "_y", "_x"]).groupBy(*keys, "y", "x").agg(F.median("_n").alias("_fill"))
        return rows.join(found.hint("merge"), [*keys, "y", "x"], "left").select(*keys, "y", "x", *sizes, F.when(F.col("_bad"), F.coalesce("_fill", "v")).otherwise(F.col("v")).alias("v"), (F.col("_bad") & F.col("_fill").isNull()).alias("_bad"))

    rows = pixels.select(*keys, "y", "x", *sizes, "v", F.coalesce(bad, F.lit(False)).alias("_bad"))
    if rounds is not None:
        for _ in range(rounds):
            rows = fill(rows)
        return rows.drop(*sizes).withColumnRenamed("_bad", "unfilled")
    with Scratch(pixels.sparkSession) as scratch:
        rows = scratch.keep(rows)
        left = rows.where("_bad").count()
        while left:
            last, rows = rows, scratch.keep(fill(rows))
            scratch.drop(last)
            before, left = left, rows.where("_bad").count()
            if left == before:
                break
        return checkpoint(rows.drop(*sizes).withColumnRenamed("_bad", "unfilled"))


def stack_mean(stack: DataFrame, keys: Sequence[str], image: str, *, k: float = 5.0, signal: float = 0.5) -> DataFrame:
    """Mean over the images of each pixel, without what stands too far over the others.

    One sigma serves the whole stack: the MAD of all residuals from their pixels' medians.  Two images: the lesser where they
    disagree; three or more: a value too far over the median gives way to it.
    """
    mid = stack.groupBy(*keys, "y", "x").agg(F.median("v").alias("_m"), F.count("v").alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    both = stack.join(mid, [*keys, "y", "x"])
    sigma = both.groupBy(*keys).agg((MAD_SCALE * F.median(F.abs(F.col("v") - F.col("_m")))).alias("_s"))
    limit = k * F.col("_s") + signal * F.abs(F.col("_m"))
    v = F.when((F.col("_n") >= 3) & (F.col("v") - F.col("_m") > limit), F.col("_m")).when((F.col("_n") == 2) & (F.col("_hi") - F.col("_lo") > limit), F.col("_lo")).otherwise(F.col("v"))
    return both.join(sigma, list(keys)).groupBy(*keys, "y", "x").agg(F.avg(v).alias("v"), F.count("v").alias("n"))


def coverage_mean(reference: DataFrame, partners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the partners that cover a pixel; the reference itself where none does."""
    mean = partners.where("v IS NOT NULL").groupBy(*keys, "y", "x").agg(F.avg("v").alias("_p"), F.count("v").alias("covered"))
    out = reference.join(mean, [*keys, "y", "x"], "left")
    return out.withColumn("partner", F.coalesce("_p", "v")).withColumn("covered", F.coalesce("covered", F.lit(0))).drop("_p")


def others_mean(pixels: DataFrame, field: Sequence[str], covers: Column) -> DataFrame:
    """For every pixel of every exposure, the mean of the other exposures of its field that cover the place (``partner``), and how many do (``covered``).

    Sums and counts of a place are one aggregate; each exposure then takes its own value out, so no exposure meets all others.  Where no other covers the place, the
    exposure's own value stands.
    """
    mine = F.coalesce(covers, F.lit(False))
    sums = pixels.groupBy(*field, "y", "x").agg(F.sum(F.when(mine, F.col("v"))).alias("_s"), F.count(F.when(mine, 1)).alias("_n"))
    both = pixels.join(sums, [*field, "y", "x"])
    left = F.col("_n") - mine.cast("long")
    rest = (F.col("_s") - F.when(mine, F.col("v")).otherwise(0.0)) / F.nullif(left, F.lit(0))
    return both.withColumns({"partner": F.coalesce(rest, "v"), "covered": left}).drop("_s", "_n")


def drizzle(pixels: DataFrame, keys: Sequence[str], *, scale: float, dy: str, dx: str, weight: str, pixfrac: float = 0.8) -> DataFrame:
    """Drop each pixel, shrunk to ``pixfrac``, on a grid ``scale`` times as fine, by the areas it covers there; weighted mean per output pixel.

    dy and dx name the columns of the pixel's exposure shift; a weight of 0 or less drops nothing.
    """
    half = 0.5 * pixfrac
    cy, cx = (F.col("y") + F.col(dy)) * scale, (F.col("x") + F.col(dx)) * scale
    box = pixels.where((F.col(weight) > 0) & F.col("v").isNotNull()).select(*keys, "v", F.col(weight).alias("_w"), (cy - half * scale).alias("_t"), (cy + half * scale).alias("_b"), (cx - half * scale).alias("_l"), (cx + half * scale).alias("_r"))
    cell = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) + 0.5).cast("int"), F.floor(F.col(hi) + 0.5).cast("int")))
    cells = box.withColumn("oy", cell("_t", "_b")).withColumn("ox", cell("_l", "_r"))
    overlap = lambda lo, hi, at: F.greatest(F.least(F.col(hi), F.col(at) + 0.5) - F.greatest(F.col(lo), F.col(at) - 0.5), F.lit(0.0))
    area = cells.withColumn("_a", overlap("_t", "_b", "oy") * overlap("_l", "_r", "ox") * F.col("_w")).where("_a > 1e-12")
    return area.groupBy(*keys, "oy", "ox").agg((F.sum(F.col("v") * F.col("_a")) / F.sum("_a")).alias("v"), F.sum("_a").alias("weight"))


def shift_bilinear(pixels: DataFrame, keys: Sequence[str], dy: float, dx: float) -> DataFrame:
    """The image read at (y + dy, x + dx), from its four neighbours; pixels that lack one are left out."""
    fy, fx = math.floor(dy), math.floor(dx)
    wy, wx = dy - fy, dx - fx
    corners = [((fy + j, fx + i), (wy if j else 1 - wy) * (wx if i else 1 - wx)) for j in (0, 1) for i in (0, 1)]
    used = [(o, w) for o, w in corners if w > 0]
    table = F.array(*[F.struct(F.lit(o[0]).alias("dy"), F.lit(o[1]).alias("dx"), F.lit(w).alias("w")) for o, w in used])
    spread = pixels.where("v IS NOT NULL").withColumn("_o", F.explode(table))
    got = spread.groupBy(*keys, (F.col("y") - F.col("_o.dy")).alias("y"), (F.col("x") - F.col("_o.dx")).alias("x")).agg(F.sum(F.col("v") * F.col("_o.w")).alias("v"), F.count(F.lit(1)).alias("_n"))
    return got.where(F.col("_n") == len(used)).drop("_n")


def augment(pixels: DataFrame, height: int, width: int, *, flip_y: Column, flip_x: Column, turns: Column) -> DataFrame:
    """Flips, then quarter turns, as a change of indices; all images of a sample that share the columns turn alike (square images for odd turns)."""
    y = F.when(flip_y, height - 1 - F.col("y")).otherwise(F.col("y"))
    x = F.when(flip_x, width - 1 - F.col("x")).otherwise(F.col("x"))
    flipped = pixels.withColumns({"_y": y, "_x": x, "_t": turns % 4})
    ny = F.when(F.col("_t") == 1, width - 1 - F.col("_x")).when(F.col("_t") == 2, height - 1 - F.col("_y")).when(F.col("_t") == 3, F.col("_x")).otherwise(F.col("_y"))
    nx = F.when(F.col("_t") == 1, F.col("_y")).when(F.col("_t") == 2, width - 1 - F.col("_x")).when(F.col("_t") == 3, height - 1 - F.col("_y")).otherwise(F.col("_x"))
    return flipped.withColumns({"y": ny, "x": nx}).drop("_y", "_x", "_t")


def source_mask(pixels: DataFrame, keys: Sequence[str], *, k: float = 3.0, rounds: int = 5, grow: int = 2) -> DataFrame:
    """Pixels over the clipped background, and those within ``grow`` steps of one."""
    base = clipped_median(pixels, keys, "v", k=k, rounds=rounds, narrowing=False)
    high = pixels.join(base, list(keys)).where(F.abs(F.col("v") - F.col("med")) >= k * F.col("sigma")).select(*keys, "y", "x")
    spread = high.withColumn("_o", F.explode(offsets(diamond(grow)))).select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")).distinct()
    return pixels.join(spread.withColumn("masked", F.lit(True)), [*keys, "y", "x"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


def label_components(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """4-connected components of marked pixels: the least (y, x) that steps between marked pixels reach, as ``label``.

    Runs along rows are nodes, and runs that touch in the next row are linked; star contraction settles in about
    the logarithm of the runs a component has, however tall it is, and raises if it doesn't settle.
    """
    w = Window.partitionBy(*keys, "y").orderBy("x")
    run = mask.select(*keys, "y", "x").distinct().withColumn("_i", F.col("x") - F.row_number().over(w))
    runs = run.groupBy(*keys, "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = checkpoint(runs.select(*keys, "y", "x0", "x1", F.struct(*keys, "y", F.col("x0").alias("x")).alias("_node")))
    touching = runs.alias("a").join(runs.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.y") + 1 == F.col("b.y"), F.col("a.x0") <= F.col("b.x1"), F.col("b.x0") <= F.col("a.x1")])
    parts = connected_components(touching.select(F.col("b._node").alias("src"), F.col("a._node").alias("dst")))
    told = runs.join(parts, F.col("_node") == F.col("id"), "left").withColumn("label", F.coalesce("component", "_node"))
    return told.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.col("label.y").alias("label_y"), F.col("label.x").alias("label_x"))
