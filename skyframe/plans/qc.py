"""Quality reports over catalogs, pixels and sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import catalog as C
from ..operators import images as I
from ..operators import stats as S
from ..session import Scratch, checkpoint


def integrity(files: DataFrame, pixels: DataFrame, height: int, width: int, needed: Sequence[str]) -> DataFrame:
    """Per file: pixel counts, missing values, and the list of what is wrong (empty where nothing is)."""
    seen = pixels.groupBy("file").agg(F.count(F.lit(1)).alias("n_pix"), F.count(F.when(F.col("v").isNull(), 1)).alias("n_missing"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    got = files.join(seen, "file", "left")
    lacks = [F.when(F.try_element_at("header", F.lit(k)).isNull(), F.lit(f"missing {k}")) for k in needed]
    problems = F.array_compact(F.array(
        F.when(F.col("n_pix").isNull(), F.lit("no image")), F.when((F.col("y1") != height - 1) | (F.col("x1") != width - 1), F.lit("shape")),
        F.when(F.col("n_missing") > 0, F.lit("missing values")), F.when(~(F.coalesce(F.col("exptime"), F.lit(0.0)) > 0), F.lit("exptime")), *lacks,
    ))
    return got.select("file", "n_pix", "n_missing", problems.alias("problems"))


def pair_rules(exposures: DataFrame, *, roll: float = 0.1, sky_ratio: float = 4.0) -> DataFrame:
    """Pairs of a group replayed: which are valid, and which break a rule (severity, rule)."""
    pairs = C.pair_join(exposures, ["group"], "pos", ["file", "cd_angle", "exptime", "sky", "root"])
    d = F.abs(F.col("cd_angle_a") - F.col("cd_angle_b"))
    ratio = F.greatest("sky_a", "sky_b") / F.greatest(F.least("sky_a", "sky_b"), F.lit(1e-6))
    rules = F.array_compact(F.array(
        F.when(F.col("root_a") == F.col("root_b"), F.lit("BLOQUANT same exposure")), F.when(d > roll, F.lit("attention roll")),
        F.when(ratio > sky_ratio, F.lit("attention sky ratio")), F.when(F.abs(F.col("exptime_a") - F.col("exptime_b")) >= 1, F.lit("info exptime")),
    ))
    return pairs.select("group", "file_a", "file_b", (d <= roll).alias("valid"), rules.alias("rules"))


def shared_exposures(exposures: DataFrame) -> DataFrame:
    """Exposures that several groups of one filter and chip hold."""
    return exposures.groupBy("filter", "chip", "root").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("group")).alias("groups")).where("n > 1")


def pair_misalignment(offsets: DataFrame) -> DataFrame:
    """Per group and in total: pairs by the distance between their exposures' offsets, and the median distance.

    A group is the exposures of one field and filter, so its own pairs meet; the median of all pairs is selected by
    a sketch's bracket, and the other totals are sums of the groups' rows.
    """
    pairs = C.pair_join(offsets, ["group"], "pos", ["off_x", "off_y"])
    pairs = pairs.select(F.col("group").cast("string").alias("group"), F.hypot(F.col("off_x_a") - F.col("off_x_b"), F.col("off_y_a") - F.col("off_y_b")).alias("gap"))
    bins = [f"bin{k}" for k in range(5)]
    each = pairs.groupBy("group").agg(F.count(F.lit(1)).alias("n_pairs"), *[F.count(F.when(E.mixed_edge_bin(F.col("gap")) == k, 1)).alias(b) for k, b in enumerate(bins)], F.median("gap").alias("med_gap"), F.max("gap").alias("max_gap"))
    mid = S.selected_percentile(pairs.withColumn("group", F.lit("TOTAL")), ["group"], F.col("gap"), 0.5).select("group", F.col("p").alias("med_gap"))
    total = each.agg(*[F.sum(c).alias(c) for c in ("n_pairs", *bins)], F.max("max_gap").alias("max_gap")).withColumn("group", F.lit("TOTAL"))
    return each.unionByName(total.join(mid, "group"))


def offsets(matches: DataFrame, *, k: float = 3.0, rounds: int = 4, least: int = 5) -> DataFrame:
    """Offset of each exposure from matched sources: clipped medians of dx and dy, and their scatter."""
    out = None
    for axis in ("dx", "dy"):
        one = S.clipped_median(matches, ["group", "file"], axis, k=k, rounds=rounds, narrowing=False, floor=1e-6, least=least)
        one = one.select("group", "file", F.col("n_used").alias(f"n_{axis}"), F.col("med").alias(f"off_{axis[1]}"), F.col("sigma").alias(f"scat_{axis[1]}"))
        out = one if out is None else out.join(one, ["group", "file"])
    return out.withColumn("off_r", F.hypot("off_x", "off_y"))


def survival(sources: DataFrame, *, edges: Sequence[float] = (10, 30, 100, 300), least: int = 5) -> DataFrame:
    """Per field and tier of significance: sources, median share of flux that a cleaning left, shares lost and damaged.

    ``sources``: group, peak_sig, raw, clean, sigma.
    """
    rows = sources.withColumns({"tier": E.tier(F.col("peak_sig"), list(edges)), "surv": E.guarded_ratio(F.col("clean"), F.col("raw"))}).where("tier IS NOT NULL")
    enough = F.count(F.lit(1)) >= least
    mid = S.selected_percentile(rows, ["group", "tier"], F.col("surv"), 0.5).select(F.col("group").alias("_g"), F.col("tier").alias("_t"), "p")
    got = rows.groupBy("group", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.when(enough, F.avg((F.col("surv") < 0.5).cast("double"))).alias("lost"),
        F.when(enough, F.avg((F.abs(F.col("raw") - F.col("clean")) > 5 * F.col("sigma")).cast("double"))).alias("damaged"),
    )
    got = got.join(mid, F.col("group").eqNullSafe(F.col("_g")) & (F.col("tier") == F.col("_t")), "left")
    return got.select("group", "tier", "n", F.when(F.col("n") >= least, F.col("p")).alias("surv"), "lost", "damaged")


def census(sources: DataFrame, *, edges: Sequence[float] = (10, 30, 100, 300), star: float = 0.3) -> DataFrame:
    """Per field and tier: peaks, and how many the partner confirms as stars (the rest are cosmic rays)."""
    rows = sources.withColumn("tier", E.tier(F.col("peak_sig"), list(edges))).where("tier IS NOT NULL")
    stars = F.count(F.when(F.col("partner_ratio") > star, 1))
    return rows.groupBy("group", "tier").agg(F.count(F.lit(1)).alias("n"), stars.alias("stars"), (stars / F.count(F.lit(1))).alias("share"))


def saturation(pixels: DataFrame, sources: DataFrame, keys: Sequence[str], plateau: Column, share: float = 0.6) -> DataFrame:
    """Length of the bright run down a source's column, and whether it bleeds."""
    runs = C.runs_through(pixels, [*keys, "x"], "y", F.col("v") > share * plateau)
    hit = sources.join(runs, [*keys, "x"], "left").where(F.col("run_start").isNull() | F.col("y").between(F.col("run_start"), F.col("run_end")))
    return hit.groupBy(*keys, "y", "x").agg(F.coalesce(F.max("run_length"), F.lit(0)).alias("bleed"))


def units(exposures: DataFrame, *, roll: float = 0.1, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, census): exposures of a group in clusters of roll; clusters under ``least`` don't train."""
    members = C.anchor_clusters(exposures, ["group"], "cd_angle", roll, "file")
    sizes = members.groupBy("group", "cluster").agg(F.count(F.lit(1)).alias("size"))
    kept = members.join(sizes.where(F.col("size") >= least), ["group", "cluster"])
    return kept, sizes.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"), F.max((F.col("size") >= least).cast("int")).cast("boolean").alias("used"))


def closure(direct: DataFrame, stored: DataFrame, n: int = 4) -> DataFrame:
    """Directly measured offsets of sampled pairs less the difference of stored ones: median, p90 and greatest distance per group."""
    sampled = C.sample_per_group(direct, ["group"], ["file_a", "file_b"], n)
    one = lambda s: stored.select("group", F.col("file").alias(f"file_{s}"), F.col("off_x").alias(f"x_{s}"), F.col("off_y").alias(f"y_{s}"))
    both = sampled.join(one("a"), ["group", "file_a"]).join(one("b"), ["group", "file_b"])
    gap = F.hypot(F.col("dx") - (F.col("x_b") - F.col("x_a")), F.col("dy") - (F.col("y_b") - F.col("y_a")))
    return both.withColumn("gap", gap).groupBy("group").agg(F.median("gap").alias("med"), F.percentile("gap", 0.9).alias("p90"), F.max("gap").alias("most"))


def plane(residuals: DataFrame, keys: Sequence[str], value: str, *, means: bool = False) -> DataFrame:
    """Least-squares plane through residuals at (x, y): its slopes, range over the 5-95 % corners, and scatter.

    Normal equations from sums, so a group is never in one place.
    """
    s = lambda e: F.sum(e)
    x, y, v = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my"), F.col(value) - F.col("_mv")
    mid = residuals.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.avg(value).alias("_mv"))
    sums = residuals.join(mid, list(keys)).groupBy(*keys).agg(
        s(x * x).alias("xx"), s(x * y).alias("xy"), s(y * y).alias("yy"), s(x * v).alias("xv"), s(y * v).alias("yv"), s(v * v).alias("vv"), F.count(F.lit(1)).alias("n"),
        F.percentile("x", [0.05, 0.95]).alias("px"), F.percentile("y", [0.05, 0.95]).alias("py"), *[F.first(c).alias(c) for c in ("_mx", "_my", "_mv")],
    )
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    a, b = (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / det, (F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / det
    fit = sums.withColumns({"slope_x": a, "slope_y": b, "_dx": F.col("px")[1] - F.col("px")[0], "_dy": F.col("py")[1] - F.col("py")[0], "_det": det})
    left = F.greatest(F.col("vv") - F.col("slope_x") * F.col("xv") - F.col("slope_y") * F.col("yv"), F.lit(0.0)) / F.greatest(F.col("n") - 3, F.lit(1))
    var = left * (F.col("yy") * F.pow("_dx", F.lit(2)) + F.col("xx") * F.pow("_dy", F.lit(2)) + 2 * F.abs(F.col("xy")) * F.col("_dx") * F.col("_dy")) / F.col("_det")
    return fit.select(*keys, "n", "slope_x", "slope_y", (F.abs(F.col("slope_x")) * F.col("_dx") + F.abs(F.col("slope_y")) * F.col("_dy")).alias("ptp"), F.sqrt(var).alias("err"), F.sqrt(left).alias("scatter"), *(("_mx", "_my", "_mv") if means else ()))


def robust_plane(residuals: DataFrame, keys: Sequence[str], value: str, *, k: float = 3.0, rounds: int = 6) -> DataFrame:
    """``plane`` after rounds in which residuals over k times the scatter leave; it ends early when none does.

    Each round's survivors are written to the shared folder, so a round reads its rows twice, whatever came before.
    """
    with Scratch(residuals.sparkSession) as scratch:
        rows = scratch.keep(residuals)
        left = rows.count()
        for _ in range(rounds):
            fit = plane(rows, keys, value, means=True).select(*keys, "slope_x", "slope_y", "_mx", "_my", "_mv", "scatter")
            off = F.col(value) - F.col("_mv") - F.col("slope_x") * (F.col("x") - F.col("_mx")) - F.col("slope_y") * (F.col("y") - F.col("_my"))
            last, rows = rows, scratch.keep(rows.join(fit, list(keys)).where(F.abs(off) <= k * F.col("scatter") + 1e-12).select(*residuals.columns))
            scratch.drop(last)
            before, left = left, rows.count()
            if left == before:
                break
        return checkpoint(plane(rows, keys, value))


def detail_score(a: DataFrame, b: DataFrame, keys: Sequence[str], sigma: float = 4.0, limit: float = 1e9, keep: DataFrame | None = None) -> DataFrame:
    """Correlation of two images' clipped high-pass, at the places of ``keep`` (keys, y, x) alone where it is given."""
    high = lambda px, n: I.lowpass(px, keys, sigma).select(*keys, "y", "x", E.clip(F.col("v") - F.col("low"), limit).alias(n))
    both = high(a, "ha").join(high(b, "hb").hint("merge"), [*keys, "y", "x"])
    both = both if keep is None else both.join(keep.select(*keys, "y", "x").hint("merge"), [*keys, "y", "x"], "left_semi")
    return both.groupBy(*keys).agg(F.corr("ha", "hb").alias("detail"), F.count(F.lit(1)).alias("n"))


def stamps(pixels: DataFrame, cleaned: DataFrame, centres: DataFrame, keys: Sequence[str], radius: int = 3) -> DataFrame:
    """Raw and cleaned pixels about each centre."""
    got = I.at_neighbours(centres.select(*keys, "y", "x"), keys, pixels, I.square(radius), {"v": "raw"})
    other = cleaned.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("clean"))
    return got.join(other, [*keys, "_y", "_x"], "left").select(*keys, "y", "x", (F.col("_y") - F.col("y")).alias("dy"), (F.col("_x") - F.col("x")).alias("dx"), "raw", "clean")


def reference_exposure(exposures: DataFrame) -> DataFrame:
    """Of each group the exposure whose roll is nearest to the group's median."""
    return C.nearest_to_median(exposures, ["group"], "cd_angle", "file")


def needs_new_anchor(exposures: DataFrame, limit: float) -> DataFrame:
    """Per group: exposures, those rolled over ``limit`` from the median, and whether these are more than half, so that another reference must be taken."""
    mid = exposures.groupBy("group").agg(F.median("cd_angle").alias("_mid"))
    far = F.abs(F.col("cd_angle") - F.col("_mid")) > limit
    got = exposures.join(mid, "group").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(far, 1)).alias("n_far"))
    return got.withColumn("re_anchor", F.col("n_far") * 2 > F.col("n"))


def control(offsets_: DataFrame, limit: float = 0.3, share: float = 0.5) -> DataFrame:
    """Groups known to be sound, replayed: the share of pairs over ``limit`` apart, and whether it is at most ``share``.  Pairs stay inside a group of exposures."""
    pairs = C.pair_join(offsets_, ["group"], "pos", ["off_x", "off_y"])
    gap = F.hypot(F.col("off_x_a") - F.col("off_x_b"), F.col("off_y_a") - F.col("off_y_b"))
    got = pairs.groupBy("group").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg((gap > limit).cast("double")).alias("over"))
    return got.withColumn("passes", F.col("over") <= share)
