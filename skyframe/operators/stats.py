"""Robust statistics per group: exact medians, MAD, clipping, percentiles, tiers, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import MAD_SCALE
from ..session import checkpoint


def selected_percentile(df: DataFrame, keys: Sequence[str], value: Column, share: float, *, precision: int = 10_000) -> DataFrame:
    """Exact percentile (linear interpolation) of a few very large groups, as (keys, n, p).

    Spark's own exact percentile holds all of a group's distinct values in one task.  Here a mergeable sketch first brackets the rank; the second
    pass counts what lies below the bracket and keeps, of each group, only the values inside it with
    their counts: about 6 / ``precision`` of the rows, in partial aggregates throughout.  The groups' brackets, some 40 bytes each, are broadcast, so that
    the rows of a group stay where they lie; a group's sketch, which each task holds anyway, is thousands of times as large.
    """
    rows = df.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL")
    near = 2.0 / precision
    sketch = F.percentile_approx("v", [max(0.0, share - near), min(1.0, share + near)], precision)
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch.alias("_e"))
    # the bracket is wider than a rank only in groups of over ``precision`` rows; smaller ones are taken whole (nothing is over NaN)
    few = F.col("n") <= 2 * precision
    ends = ends.select(*keys, "n", F.when(few, float("-inf")).otherwise(F.col("_e")[0]).alias("lo"), F.when(few, float("nan")).otherwise(F.col("_e")[1]).alias("hi"))
    # everything under the bracket is one value, that above it is not needed
    where = F.when(F.col("v") < F.col("lo"), F.lit(None).cast("double")).otherwise(F.col("v"))
    met = _with(rows, keys, F.broadcast(ends))
    counted = met.where("v <= hi").groupBy(*keys, "n", where.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn("last", F.sum("c").over(w) - 1)  # rank of the last row with this value
    at = F.lit(float(share)) * (F.col("n") - 1)
    low, high = F.floor(at), F.ceil(at)
    picked = ranked.groupBy(*keys, "n").agg(F.min(F.when(F.col("last") >= low, F.col("v"))).alias("a"), F.min(F.when(F.col("last") >= high, F.col("v"))).alias("b"))
    return picked.select(*keys, "n", (F.col("a") + (F.col("b") - F.col("a")) * (at - low)).alias("p"))


def _with(df: DataFrame, keys: Sequence[str], figures: DataFrame) -> DataFrame:
    """``df`` with the figures of its groups, null where there are none; a null key is a group of its own."""
    own = figures.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(own[f"_k_{k}"])
    return df.join(own, on, "left").drop(*[f"_k_{k}" for k in keys])


def mad_sigma(df: DataFrame, keys: Sequence[str], value: str, *, few_groups: bool = False) -> DataFrame:
    """n, median and 1.4826 times the median absolute deviation of each group; ``few_groups``: by selected_percentile."""
    if few_groups:
        # a row for each group, read three times below: without the cut each would scan the table twice more
        mid = checkpoint(selected_percentile(df, keys, F.col(value), 0.5).select(*keys, "n", F.col("p").alias("med")))
        off = selected_percentile(df.join(F.broadcast(mid), list(keys)), keys, F.abs(F.col(value) - F.col("med")), 0.5)
        return mid.join(off.select(*keys, (MAD_SCALE * F.col("p")).alias("sigma")), list(keys))
    mid = df.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("med"))
    off = df.join(mid, list(keys)).groupBy(*keys).agg(F.first("n").alias("n"), F.first("med").alias("med"), (MAD_SCALE * F.median(F.abs(F.col(value) - F.col("med")))).alias("sigma"))
    return off


def clipped_median(df: DataFrame, keys: Sequence[str], value: str, *, k: float = 3.0, rounds: int = 5, narrowing: bool = True, floor: float = 0.0, least: int = 0, few_groups: bool = False) -> DataFrame:
    """Median and MAD sigma after iterative clipping at k sigma (strictly less).

    ``narrowing``: each round tests the survivors only; else all values against the survivors' figures, so that one may come back.  A group is
    frozen once its sigma is 0 or under ``least`` values survive.  What survives lies in one interval, so a round's state
    is two numbers a group; the rows are read again, never rewritten.  ``few_groups``: medians by selected_percentile, for a few very large groups.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col(value).isNotNull())
    bounds = None

    def figures() -> DataFrame:
        live = rows if bounds is None else rows.join(F.broadcast(bounds) if few_groups else bounds, list(keys)).where("v > lo AND v < hi").select(*keys, "v")
        if few_groups:
            return mad_sigma(live, keys, "v", few_groups=True).select(*keys, F.col("med").alias("m"), F.col("n").alias("c"), F.col("sigma").alias("s"))
        mid = live.groupBy(*keys).agg(F.median("v").alias("m"), F.count(F.lit(1)).alias("c"))
        return live.join(mid, list(keys)).groupBy(*keys).agg(F.first("m").alias("m"), F.first("c").alias("c"), (MAD_SCALE * F.median(F.abs(F.col("v") - F.col("m")))).alias("s"))

    for _ in range(rounds):
        new = figures()
        reach = k * (F.col("s") + floor)
        lo, hi = F.col("m") - reach, F.col("m") + reach
        if bounds is None:
            old_lo, old_hi = F.lit(float("-inf")), F.lit(float("inf"))
        else:
            new = new.join(bounds.withColumnsRenamed({"lo": "lo0", "hi": "hi0"}), list(keys))
            old_lo, old_hi = F.col("lo0"), F.col("hi0")
        if narrowing:
            lo, hi = F.greatest(lo, old_lo), F.least(hi, old_hi)
        frozen = (F.col("s") == 0) | (F.col("c") < least)
        bounds = checkpoint(new.select(*keys, F.when(frozen, old_lo).otherwise(lo).alias("lo"), F.when(frozen, old_hi).otherwise(hi).alias("hi")))
    return figures().select(*keys, F.col("c").alias("n_used"), F.col("m").alias("med"), F.col("s").alias("sigma"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column for each share."""
    out = df.select(*keys).distinct()
    for s in shares:
        name = f"p{str(round(100 * s, 3)).rstrip('0').rstrip('.').replace('.', '_')}"
        out = _with(out, keys, selected_percentile(df, keys, F.col(value), s).select(*keys, F.col("p").alias(name)))
    return out


def joint_scale(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Common scale of several arrays of a group: p99 - p1, and a hair, so it is never 0."""
    ends = [selected_percentile(df, keys, F.col(value), share).select(*keys, F.col("p").alias(name)) for share, name in ((low, "_a"), (high, "_b"))]
    return _with(_with(df.select(*keys).distinct(), keys, ends[0]), keys, ends[1]).select(*keys, (F.col("_b") - F.col("_a") + 1e-8).alias("scale"))


def histogram(df: DataFrame, keys: Sequence[str], bin_: Column, bins: int) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count(F.when(bin_ == k, 1)).alias(f"bin{k}") for k in range(bins)], F.count(F.lit(1)).alias("n"))


def tier_census(df: DataFrame, keys: Sequence[str], tier: Column, measure: str, least: int = 5) -> DataFrame:
    """Per group and tier: rows, and the measure's median where there are enough of them."""
    rows = df.withColumn("tier", tier).where("tier IS NOT NULL")
    mid = selected_percentile(rows, [*keys, "tier"], F.col(measure), 0.5).select(*keys, "tier", F.col("p").alias("_m"))
    got = _with(rows.groupBy(*keys, "tier").agg(F.count(F.lit(1)).alias("n")), [*keys, "tier"], mid)
    return got.withColumn("med", F.when(F.col("n") >= least, F.col("_m"))).drop("_m")


def trend(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("corr"), F.count(F.lit(1)).alias("n"))


def noise_independence(df: DataFrame, keys: Sequence[str], a: str, b: str, c: str, d: str) -> DataFrame:
    """From four images of one field: twice the correlation of A-C and B-D, and the ratio of variances of A-B and the means."""
    p, q = F.col(a) - F.col(c), F.col(b) - F.col(d)
    return df.groupBy(*keys).agg((2 * F.corr(p, q)).alias("rho"), F.var_pop(F.col(a) - F.col(b)).alias("var_ab"), F.var_pop((F.col(a) + F.col(b)) / 2).alias("var_mean"), F.count(F.lit(1)).alias("n"))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias("mean"), F.sum(weight).alias("weight"))


def two_stage_median(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """Median over a field of the medians of its parts; fields may have any number of parts."""
    parts = df.groupBy(*outer, *inner).agg(F.median(value).alias("_m"))
    return selected_percentile(parts, outer, F.col("_m"), 0.5).select(*outer, F.col("p").alias("med"), F.col("n").alias("parts"))


def scan_significance(df: DataFrame, keys: Sequence[str], angle: str, power: str) -> DataFrame:
    """How far the strongest angle of a scan stands over the others, in MAD sigmas, and which it is."""
    base = mad_sigma(df, keys, power)
    peak = df.groupBy(*keys).agg(F.max(F.struct(power, angle)).alias("_p"))
    out = base.join(peak, list(keys))
    return out.select(*keys, F.col(f"_p.{angle}").alias("best"), ((F.col(f"_p.{power}") - F.col("med")) / F.greatest(F.col("sigma"), F.lit(1e-12))).alias("significance"))


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, least: int) -> DataFrame:
    """Median of each bin that has at least ``least`` values, else null."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.when(F.count(value) >= least, F.median(value)).alias("med"))
