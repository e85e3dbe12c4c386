"""Independence of noise between exposures, from patches of four that fit on one grid, and what is left of it at zero whiteness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MAD_SCALE
from ..operators import catalog as C
from ..operators import stats as S
from ..session import Scratch, bound_batches, checkpoint
from .samples import uniform

ROLES = ("a", "b", "c", "d")
QUAD = ["group", "quad"]
PATCH = [*QUAD, "turn"]
FIGURES = ("rho", "acf1", "naive", "frac", "vtest")
WHITENESS = (-1.0, 0.05, 0.15, 0.3, 1.0)


def quads(shifts: DataFrame, tolerance: float = 0.12) -> DataFrame:
    """(group, quad, role, file, ty, tx): each reference with each three partners that are shifted against it by whole pixels, to ``tolerance``.

    ``shifts``: group, ref, file, ty, tx, for the exposures of one pointing.  The reference has role a, the partners in order of files b to d.
    """
    whole = lambda c: F.bround(c).cast("int")
    near = shifts.where((F.col("ref") != F.col("file")) & (F.abs(F.col("ty") - whole("ty")) < tolerance) & (F.abs(F.col("tx") - whole("tx")) < tolerance))
    near = near.select("group", "ref", F.struct("file", whole("ty").alias("ty"), whole("tx").alias("tx")).alias("p"))
    one = lambda name: near.select("group", "ref", F.col("p").alias(name))
    three = one("p1").join(one("p2"), ["group", "ref"]).where("p1.file < p2.file").join(one("p3"), ["group", "ref"]).where("p2.file < p3.file")
    own = F.struct(F.col("ref").alias("file"), F.lit(0).alias("ty"), F.lit(0).alias("tx"))
    name = F.concat_ws("|", "ref", "p1.file", "p2.file", "p3.file")
    each = three.select("group", name.alias("quad"), F.posexplode(F.array(own, "p1", "p2", "p3")).alias("k", "p"))
    return each.select(*QUAD, F.element_at(F.array(*map(F.lit, ROLES)), F.col("k") + 1).alias("role"), "p.file", "p.ty", "p.tx")


def _reach(quads_: DataFrame) -> DataFrame:
    """A row for each quad: how far its exposures are shifted."""
    return quads_.groupBy(*QUAD).agg(*[f(c).alias(n) for c in ("ty", "tx") for f, n in ((F.min, f"{c}_low"), (F.max, f"{c}_high"))])


def _tried(reach: DataFrame, *, most: int, size: int, height: int, width: int, margin: int) -> DataFrame:
    """``reach`` with ``tried``, the attempts (top, left) of each quad in order; an array of its own row, so nothing is dealt, sorted or written for them."""
    place = lambda axis, k, room: (margin + F.floor(uniform(F.lit(axis), F.col("group"), F.col("quad"), k) * room)).cast("int")
    all_ = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.struct(place("y", k, height - size - 2 * margin).alias("top"), place("x", k, width - size - 2 * margin).alias("left")))
    inside = lambda p: (p.top + F.col("ty_low") >= 0) & (p.left + F.col("tx_low") >= 0) & (p.top + F.col("ty_high") + size <= height) & (p.left + F.col("tx_high") + size <= width)
    return reach.withColumn("tried", F.filter(all_, inside))


def attempts(quads_: DataFrame, *, most: int, size: int, height: int, width: int, margin: int) -> DataFrame:
    """(group, quad, turn, top, left): hashed places of a quad's patch at which it lies in all four exposures, numbered from 0 in order of the attempts."""
    each = _tried(_reach(quads_), most=most, size=size, height=height, width=width, margin=margin)
    return each.select(*QUAD, F.posexplode("tried").alias("turn", "_p")).select(*QUAD, "turn", "_p.top", "_p.left")


def _middle(a: np.ndarray) -> np.ndarray:
    """Medians of the rows, undefined values last, as Spark orders them."""
    a = np.sort(a, axis=1)
    return (a[:, (a.shape[1] - 1) // 2] + a[:, a.shape[1] // 2])[:, None] / 2


def _figures(v: np.ndarray, size: int, clip: float, grow: int, least: float) -> tuple | None:
    """(rho, acf1, naive, frac, vtest) of four patches of ``size`` squared; none where too little is background, or differences don't vary."""
    off = np.abs(v - _middle(v))
    high = ~(off <= clip * MAD_SCALE * _middle(off)).all(axis=0)
    bg = np.ones((size, size), bool)
    for y, x in np.argwhere(high.reshape(size, size)):
        bg[max(0, y - grow) : y + grow + 1, max(0, x - grow) : x + grow + 1] = False
    frac = float(bg.mean())
    if frac < least or not bg.any():
        return None
    a, b, c, d = (x[bg.ravel()] for x in v)
    if not ((a - c).std() > 0 and (b - d).std() > 0):
        return None
    corr = lambda p, q: float(((p - p.mean()) * (q - q.mean())).mean() / (p.std() * q.std())) if p.std() * q.std() > 0 else None
    rest = np.where(bg, (v[0] - v[2]).reshape(size, size) - (a - c).mean(), 0.0)
    rest = rest - rest.mean()
    var = (rest * rest).mean()
    acf1 = float(((rest[:, :-1] * rest[:, 1:]).mean() + (rest[:-1] * rest[1:]).mean()) / 2 / var) if var else None
    return 2 * corr(a - c, b - d), acf1, corr(a, b), frac, float((a - b).var() / max((a - c).var() + (b - c).var() - (a - b).var(), 1e-12))


def _measured(tried: DataFrame, quads_: DataFrame, lines: DataFrame, size: int, *, clip: float, grow: int, least: float) -> DataFrame:
    """One row for each patch that is whole, has a background of at least ``least``, and differences that vary.

    ``lines``: group, file, _y, _line (x and v of a line's pixels).  Patches meet lines, not pixels, and a patch's four parts become one row.
    """
    bound_batches(quads_.sparkSession)
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    asked = tried.join(quads_, QUAD).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    asked = asked.select(*PATCH, "file", (role * size + F.col("_k")).cast("int").alias("_k"), (F.col("top") + F.col("ty") + F.col("_k")).alias("_y"), (F.col("left") + F.col("tx")).alias("_x"))
    part = F.transform(F.filter("_line", lambda p: p.x.between(F.col("_x"), F.col("_x") + size - 1)), lambda p: p.v)
    met = asked.join(lines.hint("merge"), ["group", "file", "_y"]).select(*PATCH, "_k", part.alias("_v")).where(F.size("_v") == size)
    whole = met.groupBy(*PATCH).agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_r")).where(F.size("_r") == 4 * size)
    kinds = dict(whole.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_figures(np.asarray(v, float).reshape(4, -1), size, clip, grow, least) for v in batch["_v"]]
            kept = [k for k, f in enumerate(found) if f is not None]
            yield pd.concat([batch[PATCH].iloc[kept].reset_index(drop=True), pd.DataFrame([found[k] for k in kept], columns=list(FIGURES), dtype=object)], axis=1)

    return whole.select(*PATCH, F.flatten("_r._v").alias("_v")).mapInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in PATCH], *[f"{f} double" for f in FIGURES]]))


def patches(quads_: DataFrame, pixels: DataFrame, *, size: int, height: int, width: int, margin: int = 96, most: int = 60, clip: float = 4.0, grow: int = 4, least: float = 0.05) -> DataFrame:
    """(group, quad, turn, rho, acf1, naive, frac, vtest): the first attempt of each quad that passes, of at most ``most``; quads whose attempts all fail have no row.

    Pixels within ``grow`` of one that stands ``clip`` sigmas off in any of the four are no background, and an attempt passes with a share of background of
    ``least``.  rho is twice the correlation of a - c and b - d, acf1 the lag-1 autocorrelation of a - c.  Attempts go in waves: each wave cuts the
    next patch of the quads that have none yet, and ends when all have one.
    """
    with Scratch(quads_.sparkSession) as scratch:
        quads_ = scratch.keep(quads_)
        where = dict(most=most, size=size, height=height, width=width, margin=margin)
        found: list[DataFrame] = []
        left = scratch.keep(_reach(quads_))
        lines = pixels.where("v IS NOT NULL").groupBy("group", "file", F.col("y").alias("_y")).agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("_line"))
        for turn in range(most):
            wave = _tried(left, **where).where(F.size("tried") > turn).select(*QUAD, F.lit(turn).alias("turn"), F.col("tried")[turn]["top"].alias("top"), F.col("tried")[turn]["left"].alias("left"))
            if wave.isEmpty():
                break
            found.append(scratch.keep(_measured(wave, quads_, lines, size, clip=clip, grow=grow, least=least)))
            last, left = left, scratch.keep(left.join(found[-1].select(*QUAD), QUAD, "left_anti"))
            scratch.drop(last)
        if not found:
            return quads_.sparkSession.createDataFrame([], f"`group` {dict(quads_.dtypes)['group']}, quad string, turn int, rho double, acf1 double, naive double, frac double, vtest double")
        return checkpoint(reduce(DataFrame.unionByName, found))


def summary(patches_: DataFrame) -> DataFrame:
    """Per group: patches, medians of their figures, and those of the third with the least autocorrelation."""
    median = lambda *names: [F.median(c).alias(c) for c in names]
    whole = patches_.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("frac").alias("frac"), *median("acf1", "rho", "naive", "vtest"))
    white = C.lowest_share(patches_, ["group"], ["acf1", "quad"], 3).groupBy("group").agg(F.median("rho").alias("rho_white"), F.median("acf1").alias("acf1_white"))
    return whole.join(white, "group")


def at_zero_whiteness(patches_: DataFrame, keys: Sequence[str] = (), bounds: Sequence[float] = WHITENESS) -> tuple[DataFrame, DataFrame]:
    """(the line of rho over acf1 with its value at 0, medians of rho by range of acf1): what correlation is left when the differences are white."""
    line = S.trend(patches_.withColumn("_all", F.lit("all")), [*keys, "_all"], "rho", "acf1").drop("_all").withColumnRenamed("intercept", "rho_at_zero")
    place: Column = F.lit(None).cast("int")
    for k in range(len(bounds) - 1):
        place = F.when((F.col("acf1") >= bounds[k]) & (F.col("acf1") < bounds[k + 1]), k).otherwise(place)
    bins = patches_.withColumn("bin", place).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.median("rho").alias("rho"))
    return line, bins
