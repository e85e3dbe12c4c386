"""File, filter and group names of the exposure catalogs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in a rejection reason, the first of which that occurs names the quarantine folder.
REJECT_SLUGS = (("gradient", "gradient_wcs"), ("roulis", "roulis_relatif"), ("mesure", "mesure_wcs_impossible"))
REJECT_DEFAULT = "groupe_trop_petit"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column, suffix: str = "_flc.fits") -> Column:
    name = basename(path)
    return F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise(name)


def root8(path: Column) -> Column:
    """The eight-letter root of an exposure's file name, short or long form."""
    s = stem(path)
    return F.lower(F.left(F.when(s.startswith("hst_"), F.element_at(F.split(s, "_"), -1)).otherwise(s), F.lit(8)))


def rootname(path: Column) -> Column:
    """The last but one of the name's parts; null where there is but one."""
    parts = F.split(basename(path), "_")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def filter_first_clear(f1: Column, f2: Column) -> Column:
    """The first filter that isn't empty or clear, else either, else UNKNOWN."""
    real = lambda c: F.when((F.trim(c) != "") & ~F.trim(c).startswith("CLEAR"), F.trim(c))
    any_ = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(real(f1), real(f2), any_(f1), any_(f2), F.lit("UNKNOWN"))


def filter_second_if_clear(f1: Column, f2: Column) -> Column:
    """The second filter where the first is clear, else the first (not the same as filter_first_clear)."""
    return F.when(F.coalesce(f1, F.lit("")).startswith("CLEAR"), f2).otherwise(f1)


def visit(path: Column, joined: bool = False, pattern: str = r"hst_(\d+)_(\w+?)_acs") -> Column:
    """The visit in a long file name, or proposal_visit; a question mark where the name has none.  The pattern's two groups are proposal and visit."""
    prop, vis = F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)
    found = F.concat_ws("_", prop, vis) if joined else vis
    return F.when(path.rlike(pattern), found).otherwise(F.lit("?"))


def galaxy_from_path(path: Column, depth: int = 3) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= depth, F.replace(F.element_at(parts, -depth), F.lit("_"), F.lit(" ")))


def group_label(galaxy: Column, filt: Column, chip: Column) -> Column:
    return F.concat(galaxy, F.lit("/"), filt, F.lit("/chip"), chip.cast("string"))


def chip_path(path: Column, chip: int) -> Column:
    return F.regexp_replace(path, r"_flc\.fits$", f"_flc_chip{chip}.fits")


def reroot(path: Column, old: str, new: str) -> Column:
    return F.replace(path, F.lit(old), F.lit(new))


def reject_slug(reason: Column, slugs=REJECT_SLUGS, default: str = REJECT_DEFAULT) -> Column:
    """Folder of a rejection: that of the first word found in the reason."""
    out = F.lit(default)
    for word, slug in reversed(slugs):
        out = F.when(reason.contains(word), F.lit(slug)).otherwise(out)
    return out


def date_range(low: Column, high: Column) -> Column:
    return F.concat_ws(" → ", low, high)


def size_estimate(files: Column, megabytes: float = 170.0) -> Column:
    """How much so many files will take, as text: the count, and gigabytes with one decimal."""
    return F.format_string("%d files, about %.1f GB", files.cast("long"), F.bround(files * megabytes / 1024, 1))
