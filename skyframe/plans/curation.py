"""From exposure records to a catalog of groups: deduplication, pointing, grouping, merging, planning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import names as N
from ..operators import catalog as C

# The filters whose images are searched for.
FILTERS = ("F435W", "F475W", "F555W", "F606W", "F625W", "F775W", "F814W")


def dec_runs(df: DataFrame, keys: Sequence[str], dec: str, tolerance_deg: float) -> DataFrame:
    """Number the stretches of declination that no gap of ``tolerance_deg`` cuts; no group reaches across one.

    Distinct declinations are ranked, not rows, so a field observed very often is one value.
    """
    values = df.select(*keys, dec).distinct()
    w = Window.partitionBy(*keys).orderBy(dec)
    gap = F.coalesce(F.col(dec) - F.lag(dec).over(w) >= tolerance_deg, F.lit(False)).cast("int")
    runs = values.withColumn("_gap", gap).withColumn("run", F.sum("_gap").over(w)).drop("_gap")
    return df.join(runs, [*keys, dec])


def _fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], place: Sequence[str], joins) -> DataFrame:
    """Add ``group_no``: rows in order, each put into the first group that ``joins(group, row)`` lets it join, else into a new one.

    Rows at one place join one group, so only the first of each distinct place is folded, in the part of a key that no gap cuts.
    """
    kinds = dict(df.dtypes)
    row = "struct<" + ", ".join(f"{c}: {kinds[c]}" for c in place) + ">"
    first = df.groupBy(*keys, *place).agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])).alias("_first"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_first", F.struct(*place).alias("r")))), lambda s: s.r)

    def step(groups: Column, x: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: joins(g, x)), F.lit(True))
        grown = F.transform(groups, lambda g, i: F.when(i == at - 1, F.concat(g, F.array(x))).otherwise(g))
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(F.array(x))))

    folded = first.groupBy(*keys).agg(F.aggregate(rows, F.array().cast(f"array<array<{row}>>"), step).alias("_g"))
    each = folded.select(*keys, F.posexplode("_g").alias("group_no", "_rows")).select(*keys, "group_no", F.explode("_rows").alias("_r"))
    return df.join(each.select(*keys, "group_no", *[F.col(f"_r.{c}").alias(c) for c in place]), [*keys, *place])


def group_by_pointing(records: DataFrame, *, tolerance: float = 10.0, keys: Sequence[str] = ("filter",), order: Sequence[str] = ("file",)) -> DataFrame:
    """Greedy groups around their first exposure: a record joins the first group whose first member is less than ``tolerance`` arcseconds away."""
    runs = dec_runs(records, keys, "dec_targ", tolerance / 3600)
    near = lambda g, x: E.separation_arcsec(g[0].ra_targ, g[0].dec_targ, x.ra_targ, x.dec_targ) < tolerance
    return _fold(runs, [*keys, "run"], list(order), ["ra_targ", "dec_targ"], near)


def group_complete(records: DataFrame, *, tolerance: float = 10.0, roll: float = 0.1, keys: Sequence[str] = ("filter",), order: Sequence[str] = ("date_obs", "root")) -> DataFrame:
    """Groups in which each member is near all others in position and roll: rows in order, each put into the first group whose members all are near it.

    Only the first row of each distinct place is folded, a run between gaps at a time.  A group's ends in declination and roll rule out most groups at once, and
    decide where all right ascensions are one, so a row costs as many steps as there are groups; members are looked through where these leave it open.
    """
    runs = dec_runs(records, keys, "dec_targ", tolerance / 3600)
    by, place, first = [*keys, "run"], ["ra_targ", "dec_targ", "cd_angle"], [f"_o{i}" for i in range(len(order))]
    least = F.min(F.struct(*[F.col(c).alias(o) for c, o in zip(order, first, strict=True)])).alias("_first")
    distinct = runs.groupBy(*by, *place).agg(least).select(*by, *place, "_first.*")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*first, *place], na_position="first", kind="stable")
        number = _complete(*[rows[c].to_numpy(dtype=np.float64) for c in place], tolerance, roll)
        return rows[[*by, *place]].assign(group_no=number)

    kinds = dict(distinct.dtypes)
    each = distinct.groupBy(*by).applyInPandas(fold, ", ".join([*[f"`{c}` {kinds[c]}" for c in (*by, *place)], "group_no int"]))
    return runs.join(each, [*by, *place])


def _complete(ra: np.ndarray, dec: np.ndarray, angle: np.ndarray, tolerance: float, roll: float) -> np.ndarray:
    """The group of each place, in order: the first whose members all are near it."""
    number = np.zeros(len(ra), np.int32)
    ends = np.empty((6, 16))  # of each group: least and greatest ra, dec, angle
    members: list[list[int]] = []
    for k, here in enumerate(zip(ra, dec, angle, strict=True)):
        n = len(members)
        low, high = ends[0::2, :n], ends[1::2, :n]
        far = np.maximum(np.abs(high - np.array(here)[:, None]), np.abs(low - np.array(here)[:, None]))  # from the farthest member, along each axis
        chosen = n
        for g in np.flatnonzero((far[1] * 3600 < tolerance * (1 + 1e-9)) & (far[2] <= roll)):
            if far[0, g] == 0:
                fits = far[1, g] * 3600 < tolerance
            else:
                m = np.array(members[g])
                fits = np.all(np.hypot((here[0] - ra[m]) * np.cos(np.radians(dec[m])) * 3600, (here[1] - dec[m]) * 3600) < tolerance)
            if fits:
                chosen = int(g)
                break
        if chosen == n:
            if n == ends.shape[1]:
                ends = np.hstack([ends, np.empty_like(ends)])
            members.append([])
            ends[:, n] = np.repeat(here, 2)
        else:
            ends[0::2, chosen], ends[1::2, chosen] = np.minimum(ends[0::2, chosen], here), np.maximum(ends[1::2, chosen], here)
        members[chosen].append(k)
        number[k] = chosen
    return number


def near_pairs(records: DataFrame, *, tolerance: float = 10.0, roll: float | None = None, keys: Sequence[str] = ("filter",), unit: float = 3600.0) -> DataFrame:
    """All pairs of exposures closer than ``tolerance`` arcseconds, by a band join on declination.

    ``unit``: how many arcseconds the places' unit has; places in arcseconds (1) are compared as they stand, without rounding to degrees and back.
    """
    side = lambda s: records.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("file", "ra_targ", "dec_targ", "cd_angle")])
    close = E.separation_arcsec(F.col("ra_targ_a"), F.col("dec_targ_a"), F.col("ra_targ_b"), F.col("dec_targ_b"), unit) < tolerance
    if roll is not None:
        close = close & (F.abs(F.col("cd_angle_a") - F.col("cd_angle_b")) <= roll)
    return C.band_join(side("a"), side("b"), list(keys), "dec_targ_a", "dec_targ_b", tolerance / unit, (F.col("file_a") < F.col("file_b")) & close)


def curate(records: DataFrame, *, most_offset: float = 10.0, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(catalog, rejects): duplicates, large offsets and too small groups leave with their reason."""
    marked = C.prefer(records, ["rootname"], [F.desc(N.basename(F.col("file")).startswith("hst_")), F.col("file")], "_first")
    inside = E.in_box(F.col("postarg1"), F.col("postarg2"), most_offset)
    reason = F.when(~F.col("_first"), "doublon").when(~F.coalesce(inside, F.lit(False)), "postarg")
    judged = marked.withColumn("reason", reason).drop("_first")
    grouped = group_by_pointing(judged.where("reason IS NULL").drop("reason"))
    keys = ["filter", "run", "group_no"]
    sizes = grouped.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    small = grouped.join(sizes.where(F.col("_n") < least), keys, "left_semi").select("file", F.lit("groupe_trop_petit").alias("reason"))
    catalog = C.catalog(grouped, keys, "file", "date_obs", "proposid", "ra_targ", "dec_targ", least=least)
    rejects = judged.where("reason IS NOT NULL").select("file", "reason").unionByName(small)
    return catalog.drop("run", "group_no").orderBy(F.desc("n_pairs"), "filter", F.col("files")[0]), rejects


def per_chip(catalog: DataFrame, chips: Sequence[int] = (1, 2)) -> DataFrame:
    """A group for each chip, its files renamed to the chip's."""
    split = catalog.withColumn("chip", F.explode(F.array(*[F.lit(c) for c in chips])))
    renamed = F.transform("files", lambda f: F.regexp_replace(f, F.lit(r"_flc\.fits$"), F.concat(F.lit("_flc_chip"), F.col("chip").cast("string"), F.lit(".fits"))))
    return split.withColumn("files", renamed)


def select_fields(observations: DataFrame, *, instrument: str, filters: Sequence[str] = FILTERS, target: str | None = None, name_length: int = 9) -> DataFrame:
    """Calibrated images of an instrument, in a list of filters, of targets whose name begins so (a regular expression, any case)."""
    fine = (F.col("instrument_name") == instrument) & (F.col("dataproduct_type") == "image") & (F.col("intentType") == "science") & F.col("filters").isin(list(filters))
    fine = fine & (F.length("obs_id") == name_length)
    return observations.where(fine if target is None else fine & F.col("target_name").rlike(f"(?i)^(?:{target})"))


def cone(observations: DataFrame, ra: float, dec: float, arcmin: float = 3.0) -> DataFrame:
    """Observations within a radius; the box on declination can be pushed down to the files."""
    reach = arcmin / 60
    box = F.col("s_dec").between(dec - reach, dec + reach)
    return observations.where(box).where(E.haversine_deg(F.lit(ra), F.lit(dec), F.col("s_ra"), F.col("s_dec")) <= reach)


def products_of(products: DataFrame, observations: DataFrame, subgroups: Sequence[str] = ("FLC", "FLT")) -> DataFrame:
    """Products of the observations: of each, those of the first subgroup it has."""
    own = products.join(observations.select("obs_id").distinct(), "obs_id", "left_semi")
    return C.fallback(own, ["obs_id"], "productSubGroupDescription", subgroups)


def select_products(products: DataFrame, obs_id: str) -> DataFrame:
    """Single exposures whose name begins with the observation's, and its combined image."""
    sub = F.col("productSubGroupDescription")
    mine = (sub == "FLC") & F.col("obs_id").startswith(obs_id) | (sub == "DRC") & (F.col("obs_id") == obs_id)
    return products.where(F.col("productFilename").startswith("hst_") & mine)


def ready_targets(listing: DataFrame, derived: str = "_(clean|destriped|denoised)") -> DataFrame:
    """Target folders with just two single exposures (without those that ``derived`` marks as made from others) and a combined image."""
    single = F.col("name").endswith("_flc.fits") & ~F.col("name").rlike(derived)
    combined = F.col("name").endswith("_drc.fits") & ~F.col("name").contains("skycell")
    got = listing.groupBy("target").agg(F.count(F.when(single, 1)).alias("n_single"), F.count(F.when(combined, 1)).alias("n_combined"))
    return got.withColumn("status", F.when((F.col("n_single") == 2) & (F.col("n_combined") >= 1), "ready").otherwise("SKIP"))


def download_plan(files: DataFrame, budget: float, done: DataFrame | None = None) -> DataFrame:
    """Files to fetch, in order of group size, until their sizes would go over the budget."""
    work = files if done is None else files.join(done.select("file").distinct(), "file", "left_anti")
    return C.budget_prefix(work.withColumn("_turn", -F.col("n_pairs")), ["_turn", "file"], "size", budget).drop("_turn")


def merge(full: DataFrame, new: DataFrame, verdicts: DataFrame, listing: DataFrame, offsets: DataFrame) -> dict[str, DataFrame]:
    """The merged catalog: new groups by verdict, what they lose, which files are missing, and the offsets that stay in use."""
    label = N.group_label(F.col("galaxy"), F.col("filter"), F.col("chip"))
    judged = new.withColumn("label", label).join(verdicts.select("label", "keep", "reason"), "label", "left")
    kept, dropped = C.split_by(judged, F.col("keep"))
    catalog = full.unionByName(kept.drop("label", "keep", "reason"), allowMissingColumns=True)
    files = catalog.select(F.explode("files").alias("file")).distinct()
    lost = dropped.select(F.explode("files").alias("file"), N.reject_slug(F.coalesce("reason", F.lit(""))).alias("reason")).join(files, "file", "left_anti")
    return {"catalog": catalog, "excluded": lost, "missing": files.join(listing.select("file"), "file", "left_anti"), "offsets": offsets.join(files, "file", "left_semi")}
