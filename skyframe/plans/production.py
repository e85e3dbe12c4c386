"""The image chain on pixels: cosmic-ray repair with a partner's veto, destriping, partner means, blending, drizzling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import images as I
from ..operators import stats as S


def prepare(pixels: DataFrame, keys: Sequence[str], exptime: Column, step: int = 8) -> DataFrame:
    """Rates less the sky, which is the median of every ``step``-th pixel of every ``step``-th row (a part of its definition)."""
    rated = pixels.withColumn("v", E.rate(F.col("v"), exptime))
    sky = rated.where((F.col("y") % step == 0) & (F.col("x") % step == 0)).groupBy(*keys).agg(F.median("v").alias("sky"))
    return rated.join(sky, list(keys)).withColumn("v", F.col("v") - F.col("sky"))


def residual_scorer(radius: int = 1) -> Column:
    """A stand-in for a trained cosmic-ray model: how far a pixel stands over its neighbours' median, in sigmas, squeezed to 0..1."""
    z = (F.col("v") - F.col("near")) / F.greatest("sigma", F.lit(1e-6))
    return 1 / (1 + F.exp(-(z - 8)))


def cosmic_rays(pixels: DataFrame, keys: Sequence[str], *, threshold: float = 0.5, scorer: Column | None = None) -> DataFrame:
    """Pixels that the scorer (a column over v, near and sigma) puts over the threshold."""
    ring = I.at_neighbours(pixels.select(*keys, "y", "x"), keys, pixels, I.ring(1), {"v": "_n"}).groupBy(*keys, "y", "x").agg(F.median("_n").alias("near"))
    sigma = S.mad_sigma(pixels, keys, "v").select(*keys, "sigma")
    scored = pixels.join(ring, [*keys, "y", "x"]).join(sigma, list(keys))
    return scored.withColumn("prob", scorer if scorer is not None else residual_scorer()).where(F.col("prob") > threshold)


def veto(hits: DataFrame, pixels: DataFrame, partner: DataFrame, keys: Sequence[str], *, ratio: float = 0.3, k: float = 3.0) -> DataFrame:
    """Hits without those in components whose flux the partner confirms: over ``ratio`` of it and over k sigma of the sum."""
    parts = I.label_components(hits, keys)
    sigma = S.mad_sigma(partner, keys, "v").select(*keys, "sigma")
    own = parts.join(pixels.select(*keys, "y", "x", "v"), [*keys, "y", "x"]).join(partner.select(*keys, "y", "x", F.col("v").alias("p")), [*keys, "y", "x"], "left")
    sums = own.groupBy(*keys, "label_y", "label_x").agg(F.sum("v").alias("flux"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("flux_partner"), F.count(F.lit(1)).alias("n_pix"))
    star = (F.col("flux_partner") > ratio * F.col("flux")) & (F.col("flux_partner") > k * F.col("sigma") * F.sqrt("n_pix"))
    rays = sums.join(sigma, list(keys)).where(~star).select(*keys, "label_y", "label_x")
    return parts.join(rays, [*keys, "label_y", "label_x"]).select(*keys, "y", "x")


def clean(pixels: DataFrame, partner: DataFrame, keys: Sequence[str], *, threshold: float = 0.5, rounds: int | None = None) -> DataFrame:
    """Pixels with cosmic rays, less confirmed stars, filled from good neighbours, round by round until nothing can be filled."""
    bad = veto(cosmic_rays(pixels, keys, threshold=threshold), pixels, partner, keys).withColumn("bad", F.lit(True))
    marked = pixels.join(bad, [*keys, "y", "x"], "left")
    return I.median_fill(marked, keys, "bad", 2, rounds)


def destriped(pixels: DataFrame, keys: Sequence[str], *, detrend: float = 25.0, least: int = 300) -> DataFrame:
    """Row offsets taken away, measured on what isn't a source."""
    quiet = I.source_mask(pixels, keys)
    rest = I.destripe(quiet, keys, detrend=detrend, least=least, mask=~F.col("masked"))
    return rest.drop("masked")


def denoise(reference: DataFrame, partners: DataFrame, keys: Sequence[str], *, alpha: float = 0.9, model: Column | None = None) -> DataFrame:
    """Blend of each pixel and a denoised one.

    ``model`` is a column over v (the exposure) and partner (the mean of those that cover it); without one, their mean.
    The denoised image is put back on the exposure's background by the clipped median of their difference.
    """
    return denoise_with(I.coverage_mean(reference, partners, keys), keys, alpha=alpha, model=model)


def denoise_with(both: DataFrame, keys: Sequence[str], *, alpha: float = 0.9, model: Column | None = None) -> DataFrame:
    """``denoise`` of pixels that have their partner and how many cover them already."""
    den = both.withColumn("den", model if model is not None else (F.col("v") + F.col("partner")) / 2)
    base = S.clipped_median(den.withColumn("diff", F.col("v") - F.col("den")), keys, "diff").select(*keys, F.col("med").alias("anchor"))
    put = den.join(base, list(keys)).withColumn("den", F.col("den") + F.col("anchor"))
    gap = F.col("covered") == 0
    return put.withColumn("v", F.when(gap, F.col("v")).otherwise(E.blend(F.col("den"), F.col("v"), alpha))).select(*keys, "y", "x", "v", "covered")


def pooled_sky(chips: DataFrame, exposure: Sequence[str]) -> DataFrame:
    """One clipped sky for all chips of an exposure; medians are bracketed first, as an exposure has tens of millions of pixels."""
    return S.clipped_median(chips, exposure, "v", few_groups=True).select(*exposure, F.col("med").alias("sky"))


def mosaic(chips: DataFrame, target: Sequence[str], exposure: Sequence[str], *, good_bits: int = 16 | 64 | 256 | 2048, pixfrac: float = 0.8, scale: float = 1.0) -> DataFrame:
    """All exposures of a target on one grid, less their skies, by exposure time; flagged pixels weigh nothing.

    ``chips``: target, exposure, y, x, v, dq, exptime, dy, dx.
    """
    level = chips.join(pooled_sky(chips, exposure), list(exposure)).withColumn("v", F.col("v") - F.col("sky"))
    weighed = level.withColumn("w", F.when(E.bad_quality(F.coalesce("dq", F.lit(0)), good_bits), F.lit(0.0)).otherwise(F.col("exptime").cast("double")))
    return I.drizzle(weighed, target, scale=scale, dy="dy", dx="dx", weight="w", pixfrac=pixfrac)


def blend_mosaics(denoised: DataFrame, original: DataFrame, target: Sequence[str], alpha: float = 0.75) -> DataFrame:
    other = original.select(*target, "oy", "ox", F.col("v").alias("_o"))
    return denoised.join(other, [*target, "oy", "ox"]).select(*target, "oy", "ox", E.blend(F.col("v"), F.col("_o"), alpha).alias("v"))
