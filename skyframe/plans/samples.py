"""Training samples: slots split into sides, two inputs and their partners, positions, scales, augmentation.

A slot whose positions all fail is left out; no sample is made of zeros.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import catalog as C
from ..operators import images as I
from ..operators import stats as S


def uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def draw(units: DataFrame, *, samples: int, attempts: int = 8, inputs: int = 2, partners: int = 12) -> DataFrame:
    """(unit, split, sample, attempt, role, file): two inputs and at most ``partners`` others of a unit, in hash order."""
    slots = C.split_slots(units.select("unit").distinct(), "unit", 0.8, samples)
    each = slots.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).join(units.select("unit", "file"), "unit")
    order = [F.md5(F.concat_ws("|", F.col("unit").cast("string"), F.col("sample").cast("string"), F.col("file"))), F.col("file")]
    ranked = C.top_per_group(each, ["unit", "sample", "attempt"], order, inputs + partners)
    return ranked.withColumn("role", F.when(F.col("rank") <= inputs, F.lit("input")).otherwise("partner"))


def overlap(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Common box of several footprints; groups without one are left out."""
    got = boxes.groupBy(*keys).agg(F.max("y0").alias("y0"), F.max("x0").alias("x0"), F.min("y1").alias("y1"), F.min("x1").alias("x1"))
    return got.where("y1 > y0 AND x1 > x0")


def positions(drawn: DataFrame, boxes: DataFrame, size: int) -> DataFrame:
    """A corner for each attempt inside the common box; the first attempt that fits is the sample's."""
    common = overlap(drawn.join(boxes, "file"), ["unit", "split", "sample", "attempt"])
    room = common.where((F.col("y1") - F.col("y0") >= size) & (F.col("x1") - F.col("x0") >= size))
    at = lambda lo, hi, k: (F.col(lo) + F.floor(uniform(F.lit(k), F.col("unit"), F.col("sample"), F.col("attempt")) * (F.col(hi) - F.col(lo) - size + 1))).cast("int")
    placed = room.select("unit", "split", "sample", "attempt", at("y0", "y1", "y").alias("top"), at("x0", "x1", "x").alias("left"))
    return C.first_by_aggregate(placed, ["unit", "split", "sample"], F.col("attempt"), ["attempt", "top", "left"])


def patches(drawn: DataFrame, corners: DataFrame, pixels: DataFrame, size: int) -> DataFrame:
    """Pixels of every file of a sample in its square, stretched by a common scale."""
    files = drawn.join(corners, ["unit", "split", "sample", "attempt"])
    inside = F.col("y").between(F.col("top"), F.col("top") + size - 1) & F.col("x").between(F.col("left"), F.col("left") + size - 1)
    cut = files.join(pixels, "file").where(inside).withColumns({"y": F.col("y") - F.col("top"), "x": F.col("x") - F.col("left")})
    keys = ["unit", "split", "sample"]
    scale = S.joint_scale(cut, keys, "v")
    return cut.join(scale, keys).select(*keys, "file", "role", "y", "x", E.asinh_stretch(F.col("v"), F.col("scale")).alias("v"), "scale")


def targets(patches_: DataFrame) -> DataFrame:
    """The robust mean of a sample's partners, pixel by pixel."""
    return I.stack_mean(patches_.where("role = 'partner'"), ["unit", "split", "sample"], "file")


def augmented(patches_: DataFrame, size: int) -> DataFrame:
    """All images of a sample flipped and turned alike."""
    u = lambda k: uniform(F.lit(k), F.col("unit"), F.col("sample"))
    return I.augment(patches_, size, size, flip_y=u("fy") < 0.5, flip_x=u("fx") < 0.5, turns=F.floor(u("t") * 4).cast("int"))


def best_epoch(metrics: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """The epoch of least validation loss, the first of equals; losses are weighted by batch."""
    loss = S.weighted_mean(metrics, [*run, "epoch"], "loss", "n")
    return loss.groupBy(*run).agg(F.min(F.struct(F.col("mean").alias("loss"), "epoch")).alias("_b")).select(*run, "_b.epoch", "_b.loss", E.psnr(F.col("_b.loss")).alias("psnr"))
