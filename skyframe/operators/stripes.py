"""Stripes at any angle: found by scans whose angles are data, measured on what is background, and taken away until no direction stands out.

An image is all pixels of one value of the keys, from (0, 0) on.  Its lines and its profiles (a value for each strip across an angle, so about as
many as the image's diagonal has pixels) are the largest things a task holds; pixels stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MAD_SCALE
from ..session import Scratch
from .images import diamond, offsets
from .stats import clipped_median


def _blurred(a: np.ndarray, sigma: float, edge: str) -> np.ndarray:
    """Gaussian means along the first axis, cut at four sigmas; ``edge`` is how numpy's pad goes on beyond the ends."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    padded = np.pad(a, [(reach, reach)] + [(0, 0)] * (a.ndim - 1), mode=edge)
    size = len(padded) + 2 * reach
    kernel = np.fft.rfft(kernel, size).reshape(-1, *[1] * (a.ndim - 1))
    return np.fft.irfft(np.fft.rfft(padded, size, axis=0) * kernel, size, axis=0)[2 * reach : 2 * reach + len(a)]


def _blurred_known(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means of what is known along the first axis; unknown where nothing known is near."""
    known = np.isfinite(a)
    weight = _blurred(known.astype(float), sigma, "edge")
    return np.where(weight > 1e-3, _blurred(np.where(known, a, 0.0), sigma, "edge") / np.maximum(weight, 1e-8), np.nan)


def _alike(lengths: np.ndarray, at_once: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of rows of one length, so many that they have at most about ``at_once`` values: numpy works on these together."""
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        many = max(1, at_once // max(int(n), 1))
        for start in range(0, len(places), many):
            yield int(n), places[start : start + many]


def background(pixels: DataFrame, keys: Sequence[str], sigma: float, value: str = "v", mask: str = "bg") -> DataFrame:
    """(keys, y, x, low): Gaussian means of the pixels under ``mask``, by lines and then by columns, mirrored at the edges.

    Each pass has a line of pixels a row, so the cost of a pixel does not depend on ``sigma``.
    """
    kinds = dict(pixels.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def along(rows: DataFrame, line: str, place: str) -> DataFrame:
        lines = rows.groupBy(*keys, line).agg(F.array_sort(F.collect_list(F.struct(place, "_a", "_b"))).alias("_r")).select(*keys, line, F.col(f"_r.{place}").alias("_p"), F.col("_r._a").alias("_a"), F.col("_r._b").alias("_b"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name in ("_a", "_b"):
                    values = batch[name].tolist()
                    for _, places in _alike(np.fromiter(map(len, values), int, len(values))):
                        for k, v in zip(places, _blurred(np.array([values[k] for k in places], float).T, sigma, "symmetric").T, strict=True):
                            values[k] = v
                    batch[name] = values
                yield batch

        done = lines.mapInPandas(run, f"{head}, {line} int, _p array<int>, _a array<double>, _b array<double>")
        each = done.select(*keys, line, F.explode(F.arrays_zip("_p", "_a", "_b")).alias("_e"))
        return each.select(*keys, line, F.col("_e._p").alias(place), F.col("_e._a").alias("_a"), F.col("_e._b").alias("_b"))

    good = F.col(mask) & F.col(value).isNotNull()
    rows = pixels.select(*keys, "y", "x", F.when(good, F.col(value)).otherwise(0.0).alias("_a"), F.when(good, 1.0).otherwise(0.0).alias("_b"))
    both = along(along(rows, "y", "x"), "x", "y")
    return both.select(*keys, "y", "x", (F.col("_a") / F.greatest("_b", F.lit(1e-8))).alias("low"))


def across(angle: str = "angle") -> Column:
    """How far a pixel lies across an angle (a column, degrees; 0 is along lines), from the image's first corner on; needs height and width."""
    t, cy, cx = F.radians(angle), (F.col("height") - 1) / 2, (F.col("width") - 1) / 2
    return F.round((F.col("y") - cy) * F.cos(t) - (F.col("x") - cx) * F.sin(t) + cy * F.abs(F.cos(t)) + cx * F.abs(F.sin(t)), 9)


def along(angle: str = "angle") -> Column:
    """How far a pixel lies along an angle, from the image's centre on."""
    t, cy, cx = F.radians(angle), (F.col("height") - 1) / 2, (F.col("width") - 1) / 2
    return F.round((F.col("x") - cx) * F.cos(t) + (F.col("y") - cy) * F.sin(t), 9)


def scan(residue: DataFrame, candidates: DataFrame, keys: Sequence[str], *, least: int, least_strips: int, detrend: float, clip: float = 4.0) -> DataFrame:
    """(keys, angle, score): how much power the strips' means have beyond noise at each candidate angle of each image.

    ``residue`` has the pixels' ``hp``, null where they are no background; ``candidates`` (keys, height, width, sigma, angles) has a list of angles for
    each image.  Values are clipped at ``clip`` sigmas, strips need ``least`` pixels and profiles ``least_strips`` strips, else the score is null.
    Strips are summed where the pixels lie; only sums are shuffled.  Scores are in squared sigmas.
    """
    kinds = dict(candidates.dtypes)
    asked = residue.where("hp IS NOT NULL").join(candidates, list(keys)).withColumn("angle", F.explode("angles"))
    value = F.greatest(F.least(F.col("hp"), clip * F.col("sigma")), -clip * F.col("sigma"))
    strips = asked.groupBy(*keys, "sigma", "angle", F.floor(across()).cast("int").alias("strip")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    profiles = strips.groupBy(*keys, "sigma", "angle").agg(F.array_sort(F.collect_list(F.struct("strip", "n", "s"))).alias("_r"))
    lists = profiles.select(*keys, "sigma", "angle", F.col("_r.strip").alias("strip"), F.col("_r.n").alias("n"), F.col("_r.s").alias("s"))

    def scores(strip: list[np.ndarray], n: list[np.ndarray], s: list[np.ndarray], sigma: np.ndarray) -> np.ndarray:
        out = np.full(len(strip), np.nan)
        for size, places in _alike(np.fromiter((x.max() + 1 for x in strip), int, len(strip))):
            at = np.concatenate([strip[k] for k in places]), np.repeat(np.arange(len(places)), [len(strip[k]) for k in places])
            profile, counts = np.full((size, len(places)), np.nan), np.ones((size, len(places)))
            counts[at] = np.concatenate([n[k] for k in places])
            profile[at] = np.where(counts[at] >= least, np.concatenate([s[k] for k in places]) / counts[at], np.nan)
            rest = profile - _blurred_known(profile, detrend)
            known = np.isfinite(rest)
            enough = (known.sum(axis=0) >= least_strips) & (sigma[places] != 0)
            over = np.where(known, rest**2 / np.where(enough, sigma[places], 1.0) ** 2 - 1 / counts, 0.0).sum(axis=0)
            out[places] = np.where(enough, over / np.maximum(known.sum(axis=0), 1), np.nan)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = scores(*([np.asarray(v) for v in b[c]] for c in ("strip", "n", "s")), b["sigma"].to_numpy(float))
            yield b[[*keys, "angle"]].assign(score=[None if np.isnan(v) else v for v in found])

    return lists.mapInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "angle double, score double"]))


def strongest(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, angle, significance): each image's best angle, the least of equal ones to nine digits, and how many MAD sigmas it stands over the median."""
    middle = scores.groupBy(*keys).agg(F.median("score").alias("_m"))
    spread = scores.join(middle, list(keys)).groupBy(*keys, "_m").agg((MAD_SCALE * F.median(F.abs(F.col("score") - F.col("_m")))).alias("_s"), F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("angle")).alias("angle"))).alias("_b"))
    return spread.where("_b.score IS NOT NULL").select(*keys, (-F.col("_b.angle")).alias("angle"), ((F.col("_b.score") - F.col("_m")) / F.greatest("_s", F.lit(1e-12))).alias("significance"))


def _profiles(residue: DataFrame, found: DataFrame, keys: Sequence[str], *, window: float | None, least: int, detrend: float, smooth: float, few: int, few_share: float) -> DataFrame:
    """(keys, linear, rows, i, j, s00, s10, s01, s11): the stripes' cells of each image at its angle, with the cells next to each.

    Strips are medians of their pixels, in windows along the stripe if ``window`` is given; less their own trend, shrunk by their noise, and filled
    between.  ``linear`` tells, of profiles without windows, that few strong strips hold most of the power, which is a trail, and ``rows`` which these are.
    """
    kinds = dict(found.dtypes)
    step = (window or 0) / 2
    t, cy, cx = F.radians("angle"), (F.col("height") - 1) / 2, (F.col("width") - 1) / 2
    half = cx * F.abs(F.cos(t)) + cy * F.abs(F.sin(t))
    tall = F.bround(2 * (cy * F.abs(F.cos(t)) + cx * F.abs(F.sin(t)))).cast("int") + 1
    if window is None:
        n_windows, first = F.lit(1), F.lit(0.0)
    else:
        n_windows = F.greatest(F.floor((2 * half - window + 1e-9) / step).cast("int") + 1, F.lit(1))
        first = F.when(2 * half - window + 1e-9 >= 0, window / 2 - half).otherwise(0.0)
    images = found.select(*keys, "angle", "height", "width", "sigma", tall.alias("_tall"), n_windows.alias("_wide"), first.alias("_first"))
    placed = residue.where("hp IS NOT NULL").join(images, list(keys)).withColumn("_i", F.bround(across()).cast("int"))
    if window is None:
        placed = placed.withColumn("_j", F.lit(0))
    else:
        low = F.ceil(F.round((along() - window / 2 - F.col("_first")) / step, 9)).cast("int")
        high = F.floor(F.round((along() + window / 2 - F.col("_first")) / step, 9)).cast("int")
        within = F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.col("_wide") - 1))
        placed = placed.where((F.least(high, F.col("_wide") - 1) >= F.greatest(low, F.lit(0)))).withColumn("_j", F.explode(within))
    strips = placed.groupBy(*keys, "sigma", "_tall", "_wide", "_i", "_j").agg(F.count(F.lit(1)).alias("n"), F.median("hp").alias("med"))
    lists = strips.groupBy(*keys, "sigma", "_tall", "_wide").agg(F.collect_list("_i").alias("_i"), F.collect_list("_j").alias("_j"), F.collect_list("n").alias("n"), F.collect_list("med").alias("med"))

    def cells(i, j, n, med, sigma, tall, wide) -> tuple[np.ndarray, bool, list[int]]:
        profile, counts = np.full((tall, wide), np.nan), np.zeros((tall, wide))
        counts[i, j] = n
        profile[i, j] = np.where(n >= least, med, np.nan)
        profile = profile - _blurred_known(profile, detrend)
        worth = 1.0
        if smooth > 0 and wide > 2:
            profile = _blurred_known(profile.T, smooth).T
            worth = max(1.0, np.sqrt(2 * np.pi) * smooth / 2)
        noise = (1.2533 * sigma) ** 2 / np.maximum(counts * worth, 1)
        known = np.isfinite(profile)
        signal = max(np.mean(profile[known] ** 2) - np.mean(noise[known]), 0.0) if known.any() else 0.0
        profile = profile * signal / np.maximum(signal + noise, 1e-30)
        column, ok = profile[:, 0], known[:, 0]
        strong = np.zeros(tall, bool)
        strong[ok] = np.abs(column[ok]) > 5 * np.sqrt(noise[ok, 0])
        top = np.sort(column[ok] ** 2)[::-1][: max(3, int(strong.sum()))]
        linear = bool(window is None and ok.sum() >= 50 and strong.any() and strong.sum() < max(few, few_share * ok.sum()) and top.sum() > 0.5 * max(np.sum(column[ok] ** 2), 1e-30))
        places = np.arange(tall)
        for c in range(wide):
            ok = known[:, c]
            profile[:, c] = np.interp(places, places[ok], profile[ok, c]) if ok.any() else 0.0
        return profile, linear, np.flatnonzero(strong).tolist() if linear else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, size = [], 0
            for k, r in enumerate(zip(*(b[c] for c in ("_i", "_j", "n", "med", "sigma", "_tall", "_wide")), strict=True)):
                p, linear, rows = cells(*map(np.asarray, r[:3]), np.asarray(r[3], float), *r[4:])
                held.append((k, p, linear, rows))
                size += p.size
                if size > 1 << 16:  # images go on together, many small ones or one large one
                    yield table(b, held)
                    held, size = [], 0
            if held:
                yield table(b, held)

    def table(b: pd.DataFrame, held: list) -> pd.DataFrame:
        columns = {c: [] for c in ("i", "j", "s00", "s10", "s01", "s11")}
        for _, p, _, _ in held:
            down = np.vstack([p[1:], p[-1:]])
            right = lambda a: np.hstack([a[:, 1:], a[:, -1:]])
            for c, v in zip(columns, (*np.indices(p.shape), p, down, right(p), right(down)), strict=True):
                columns[c].append(v.ravel())
        sizes = [p.size for _, p, _, _ in held]
        out = b[keys].iloc[np.repeat([k for k, *_ in held], sizes)].reset_index(drop=True).assign(**{c: np.concatenate(v) for c, v in columns.items()})
        return out.assign(linear=np.repeat([x[2] for x in held], sizes), rows=[x[3] for x, n in zip(held, sizes, strict=True) for _ in range(n)])[[*keys, "linear", "rows", "i", "j", "s00", "s10", "s01", "s11"]]

    return lists.mapInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "linear boolean, rows array<int>, i int, j int, s00 double, s10 double, s01 double, s11 double"]))


def _field(pixels: DataFrame, found: DataFrame, profiles: DataFrame, keys: Sequence[str], window: float | None, name: str) -> DataFrame:
    """``pixels`` with the stripes' value at each, between strips and windows in proportion; 0 for images that have none."""
    step = (window or 2) / 2
    t, cy, cx = F.radians("angle"), (F.col("height") - 1) / 2, (F.col("width") - 1) / 2
    half = cx * F.abs(F.cos(t)) + cy * F.abs(F.sin(t))
    tall = F.bround(2 * (cy * F.abs(F.cos(t)) + cx * F.abs(F.sin(t)))) + 1
    first = F.lit(0.0) if window is None else F.when(2 * half - window + 1e-9 >= 0, window / 2 - half).otherwise(0.0)
    wide = F.lit(1) if window is None else F.greatest(F.floor((2 * half - window + 1e-9) / step) + 1, F.lit(1))
    at_v = F.least(F.greatest(across(), F.lit(0.0)), tall - 1.0)
    at_u = F.least(F.greatest((along() - first) / step, F.lit(0.0)), wide - 1.0)
    placed = pixels.join(found.select(*keys, "angle", "height", "width"), list(keys), "left").withColumns({"_v": at_v, "_u": at_u})
    placed = placed.withColumns({"_i": F.floor("_v").cast("int"), "_j": F.floor("_u").cast("int")}).drop("angle", "height", "width")
    cells = profiles.where("NOT linear").select(*keys, F.col("i").alias("_i"), F.col("j").alias("_j"), "s00", "s10", "s01", "s11")
    fv, fu = F.col("_v") - F.col("_i"), F.col("_u") - F.col("_j")
    value = (F.col("s00") * (1 - fv) + F.col("s10") * fv) * (1 - fu) + (F.col("s01") * (1 - fv) + F.col("s11") * fv) * fu
    return placed.join(cells, [*keys, "_i", "_j"], "left").withColumn(name, F.coalesce(value, F.lit(0.0))).drop("_v", "_u", "_i", "_j", "s00", "s10", "s01", "s11")


def destripe_search(
    pixels: DataFrame, keys: Sequence[str], scratch: Scratch, *, rounds: int = 12, significance: float = 5.0, low: float = 100.0, k: float = 3.0, detrend: float = 25.0, window: float | None = 1024, smooth: float = 2.0,
    coarse: float = 1.0, fine: float = 0.125, reach: float = 1.5, least_scan: int = 300, least_field: int = 100, least_strips: int = 50, few: int = 10, few_share: float = 0.01,
) -> tuple[DataFrame, DataFrame]:
    """(pixels with v corrected, stripes and bg; passes with each image's angle, significance and whether it was a line).

    Each round takes every image's large-scale background off, scans its angles by ``coarse`` degrees, and again by ``fine`` ones within ``reach`` of its
    own best.  The stripes at that angle are taken away, first as one profile, then as one that varies along the stripe in windows.  If a few strips
    hold the power, it is a trail: its strips, grown by two pixels, leave the background instead.  An image is done when no angle stands
    ``significance`` MAD sigmas over the others; the loop ends with the last image, or after ``rounds``.

    Both tables live in ``scratch``.  Nulls in v are no background and stay null; images without pixels or of one value have no stripes.
    """
    keys = list(keys)
    level = clipped_median(pixels, keys, "v", k=k, rounds=5, narrowing=False).select(*keys, "med", "sigma")
    sizes = pixels.groupBy(*keys).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    images = scratch.keep(sizes.join(level, keys).where("sigma > 0"))
    source = pixels.join(images.select(*keys, "med", "sigma"), keys).where(F.col("v").isNull() | (F.abs(F.col("v") - F.col("med")) >= k * F.col("sigma")))
    grown = source.withColumn("_o", F.explode(offsets(diamond(2)))).select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")).distinct()
    state = pixels.select(*keys, "y", "x", F.col("v").cast("double").alias("v")).join(grown.withColumn("_s", F.lit(True)), [*keys, "y", "x"], "left")
    state = scratch.keep(state.select(*keys, "y", "x", "v", F.lit(0.0).alias("stripes"), F.col("_s").isNull().alias("bg")))
    live, passes = images, None
    whole = [float(a) for a in np.arange(-90, 90, coarse)]
    for turn in range(rounds):
        current = state.join(live.select(*keys), keys, "left_semi")
        residue = scratch.keep(current.join(background(current, keys, low), [*keys, "y", "x"]).select(*keys, "y", "x", F.when(F.col("bg"), F.col("v") - F.col("low")).alias("hp")))
        asked = dict(least=least_scan, least_strips=least_strips, detrend=detrend)
        first = strongest(scan(residue, live.withColumn("angles", F.array(*map(F.lit, whole))), keys, **asked), keys).where(F.col("significance") >= significance)
        first = scratch.keep(first.withColumnRenamed("angle", "_coarse"))
        if first.isEmpty():
            scratch.drop(residue, first)
            break
        n = round(reach / fine)
        near = F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda d: F.col("_coarse") + d * fine)
        second = strongest(scan(residue, live.join(first, keys).withColumn("angles", near).drop("_coarse", "significance"), keys, **asked), keys).select(*keys, "angle")
        found = scratch.keep(live.join(first, keys).join(second, keys).select(*keys, "height", "width", "med", "sigma", "angle", "significance"))
        fit = dict(least=least_field, detrend=detrend, few=few, few_share=few_share)
        plain = scratch.keep(_profiles(residue, found, keys, window=None, smooth=0.0, **fit))
        field = scratch.keep(_field(state, found, plain, keys, None, "_s1"))
        kept = field
        if window is not None:
            rest = residue.join(field.select(*keys, "y", "x", "_s1"), [*keys, "y", "x"]).withColumn("hp", F.col("hp") - F.col("_s1"))
            stripes = plain.where("NOT linear").select(*keys).distinct()
            windowed = _profiles(rest.join(stripes, keys, "left_semi"), found, keys, window=window, smooth=smooth, **fit)
            kept = _field(field, found, windowed, keys, window, "_s2")
        else:
            kept = kept.withColumn("_s2", F.lit(0.0))
        lines = plain.where("linear AND i = 0 AND j = 0").select(*keys, "rows")
        struck = state.select(*keys, "y", "x").join(found, keys).join(lines, keys).where(F.array_contains("rows", F.bround(across()).cast("int")))
        struck = struck.withColumn("_o", F.explode(offsets(diamond(2)))).select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")).distinct()
        moved = kept.join(struck.withColumn("_t", F.lit(True)), [*keys, "y", "x"], "left")
        taken = F.col("_s1") + F.col("_s2")
        last, state = state, scratch.keep(moved.select(*keys, "y", "x", (F.col("v") - taken).alias("v"), (F.col("stripes") + taken).alias("stripes"), (F.col("bg") & F.col("_t").isNull()).alias("bg")))
        told = scratch.keep(found.join(lines.withColumn("_l", F.lit(True)), keys, "left").select(*keys, F.lit(turn).alias("turn"), "angle", "significance", F.col("_l").isNotNull().alias("line")))
        passes = told if passes is None else passes.unionByName(told)
        gone = live
        live = scratch.keep(found.select(*keys, "height", "width", "med", "sigma"))
        scratch.drop(last, residue, first, found, plain, field, *([] if gone is images else [gone]))
    none = images.select(*keys, F.lit(0).alias("turn"), F.lit(0.0).alias("angle"), F.lit(0.0).alias("significance"), F.lit(False).alias("line")).limit(0)
    return state, none if passes is None else passes
