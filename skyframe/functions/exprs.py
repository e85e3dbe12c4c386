"""Numeric column expressions: sky geometry, rounding, scaling, predicates.  Missing numbers are null, never NaN."""

from __future__ import annotations

import math
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MAD_SCALE = 1.4826


def roll_angle(cd1_1: Column, cd1_2: Column) -> Column:
    return F.degrees(F.atan2(cd1_2, cd1_1))


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column, unit: float = 3600.0) -> Column:
    """Small-angle separation, with the first point's declination (so it isn't symmetric); ``unit``: how many arcseconds the places' unit has."""
    return F.hypot((ra2 - ra1) * F.cos(F.radians(dec1 / (3600 / unit))) * unit, (dec2 - dec1) * unit)


def haversine_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    a = F.pow(F.sin(F.radians((dec2 - dec1) / 2)), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians((ra2 - ra1) / 2)), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def pairs_of(n: Column) -> Column:
    """How many pairs n things make."""
    return F.floor(n * (n - 1) / 2).cast("long")


def half_away(x: Column, digits: int = 0, signed_zero: bool = False) -> Column:
    """What SQL engines and C give for doubles: ``x`` times the power of ten as a double, rounded half away from zero, and divided again; ``x`` itself where the product is infinite.

    Spark's ``round`` with digits looks at the shortest decimals of ``x`` instead, and differs where the product falls on a half or off it.
    ``signed_zero``: what is rounded to zero keeps its sign, as in C; sums in no fixed order have no sign to keep.
    """
    power = float(10**digits)
    rounded = F.round(x * power, 0) / power
    if signed_zero:
        rounded = F.when(rounded == 0, x * 0.0).otherwise(rounded)
    return F.when(F.abs(x * power) == math.inf, x.cast("double")).otherwise(rounded)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def python_round(x: Column, digits: int = 5) -> Column:
    """What Python's ``round`` gives: the binary value rounded, half to even only where it lies on the half exactly.

    ``x`` times the power of ten is followed exactly, as two products of half as many binary digits each, so one subtraction tells on which side of
    the half it lies.  For values under 2^31 and up to six digits; null, infinite and undefined values stay.
    """
    if digits == 0:
        return F.rint(x)
    power, size = float(10**digits), F.abs(x)
    floor = F.floor(size * power).cast("double")
    far = size * (2.0**27 + 1)
    high = far - (far - size)  # the upper 26 binary digits
    over = (high * power - (floor + 0.5)) + (size - high) * power
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(floor % 2)
    rounded = (floor + up) / power
    odd = x.isNull() | F.isnan(x) | (size == float("inf"))
    return F.when(odd | (x == 0), x).otherwise(F.when(x < 0, -rounded).otherwise(rounded))


def pixel_snap(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def ordinal_day(date: Column) -> Column:
    """Days since the first of January of year one, counted as day 1."""
    return F.unix_date(date.cast("date")) + 719163


def bad_quality(dq: Column, good_bits: int) -> Column:
    """Whether any bit outside ``good_bits`` is set."""
    return dq.bitwiseAND(F.lit(~good_bits)) != 0


def rate(v: Column, exptime: Column) -> Column:
    return v / F.coalesce(F.nullif(exptime.cast("double"), F.lit(0.0)), F.lit(1.0))


def _of_c(f):
    """A function of Python's ``math``, which is the C library's, on doubles; infinite where it overflows.

    Spark's own ``asinh`` is log(x + sqrt(x * x + 1)), which loses digits under zero (at -1e8 it is minus infinity) and near it.
    """

    def one(x: float) -> float:
        try:
            return f(x)
        except OverflowError:
            return math.copysign(math.inf, x)

    @F.arrow_udf(DoubleType())
    def run(xs: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x) for x in xs.to_pylist()], pa.float64())

    return run


_asinh, _sinh = _of_c(math.asinh), _of_c(math.sinh)


def asinh_stretch(x: Column, scale: Column, beta: float = 1.0) -> Column:
    return _asinh((x / scale / beta).cast("double")) * beta


def asinh_restore(y: Column, scale: Column, beta: float = 1.0) -> Column:
    return _sinh((y / beta).cast("double")) * beta * scale


def guarded_ratio(a: Column, b: Column, least: float = 1e-6) -> Column:
    return a / F.greatest(b, F.lit(least))


def clip(x: Column, limit: float) -> Column:
    return F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))


def blend(denoised: Column, original: Column, alpha: float) -> Column:
    return alpha * denoised + (1 - alpha) * original


def roll_displacement(roll_difference: Column, arm: float = 2290.0) -> Column:
    """Pixels that a chip's corner moves under a roll."""
    return arm * F.abs(F.radians(roll_difference))


def wiener(signal: Column, sigma: Column, n: Column, efficiency: float = 1.0) -> Column:
    """Share of a profile's power that is signal, given the noise of a median of n pixels; for whole n, n times the efficiency is taken in decimals."""
    noise = F.pow(1.2533 * sigma, 2) / F.greatest((n * F.lit(Decimal(str(efficiency)))).cast("double"), F.lit(1.0))
    return signal / (signal + noise)


def psnr(mse: Column) -> Column:
    """Undefined under zero, as logarithms are in C; Spark's are null there."""
    return F.when(mse == 0, F.lit(math.inf)).when(mse < 0, F.lit(math.nan)).otherwise(10 * F.log10(1 / mse))


def no_nan(x: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(default))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)


def near_integer(shift: Column, tolerance: float) -> Column:
    return F.abs(shift - F.bround(shift, 0)) < tolerance


def in_box(a: Column, b: Column, limit: float) -> Column:
    return (F.abs(a) <= limit) & (F.abs(b) <= limit)


def ring_ratio_ok(ratio: Column, low: float = 0.15, high: float = 0.95) -> Column:
    """The open interval in which a peak's neighbours look like those of a star."""
    return (ratio > low) & (ratio < high)


def _or_missing(verdict: Column, missing: bool | None) -> Column:
    """``missing`` is the verdict where a missing number leaves it open; None: null, as in SQL."""
    return verdict if missing is None else F.coalesce(verdict, F.lit(missing))


def in_range(v: Column, low: float, high: float, missing: bool | None = False) -> Column:
    """Both ends count, as for the exposure times that are used (300 to 1300 s)."""
    return _or_missing(v.between(low, high), missing)


def unsaturated(peak: Column, limit: float = 60000.0, missing: bool | None = False) -> Column:
    return _or_missing(peak < limit, missing)


def enough_background(quiet: Column, all_: Column, share: float = 0.15, missing: bool | None = False) -> Column:
    """Whether at least ``share`` of the pixels are background."""
    return _or_missing(quiet / F.greatest(all_, F.lit(1)) >= share, missing)


def same_setup(width: Column, height: Column, exptime: Column, reference: Column, *, full: tuple[int, int] = (4096, 2048), tolerance: float = 1.0, missing: bool | None = False) -> Column:
    """A full frame whose exposure time is less than ``tolerance`` from the reference's."""
    return _or_missing((width == full[0]) & (height == full[1]) & (F.abs(exptime - reference) < tolerance), missing)


def is_gradient(ptp: Column, err: Column, missing: bool | None = False) -> Column:
    """A gradient is real if its range is over half a pixel and over five times an error of at most 0.15."""
    return _or_missing((err <= 0.15) & (ptp > 0.5) & (ptp > 5 * err), missing)


def mixed_edge_bin(v: Column, edges=(0.1, 0.3, 0.5, 1.0)) -> Column:
    """Number of the bin: at most the first edge is 0, then (edge, next edge], over the last is len(edges)."""
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(v <= edges[k], F.lit(k)).otherwise(out)
    return F.when(v.isNotNull(), out)


def tier(v: Column, edges) -> Column:
    """Number of the half-open tier [edge, next edge); null under the first."""
    out = F.lit(None).cast("int")
    for k, low in enumerate(edges):
        out = F.when(v >= low, F.lit(k)).otherwise(out)
    return out
