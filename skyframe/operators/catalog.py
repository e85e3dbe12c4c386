"""Catalog operators: preferring, grouping, pairing, budgets, clusters, merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pairs_of
from ..session import Scratch, checkpoint


# ------------------------------------------------------------------ one row of each key


def prefer(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: str = "kept") -> DataFrame:
    """Flag the first row of each key in the given order; the others are the removed ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(flag, F.row_number().over(w) == 1)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return prefer(df, keys, order, "_kept").where("_kept").drop("_kept")


def first_by_aggregate(df: DataFrame, keys: Sequence[str], rank: Column, columns: Sequence[str]) -> DataFrame:
    """The row of least rank of each key by a partial aggregate, so that a key of very many rows is reduced before the shuffle."""
    best = F.min(F.struct(rank.alias("_rank"), *columns)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in columns])


def upsert(base: DataFrame, override: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, of which ``override`` wins where keys meet."""
    both = base.withColumn("_turn", F.lit(1)).unionByName(override.withColumn("_turn", F.lit(0)), allowMissingColumns=True)
    return first_of(both, keys, [F.col("_turn"), *[F.col(k) for k in keys]]).drop("_turn")


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): a condition that is null removes."""
    fine = F.coalesce(condition, F.lit(False))
    return df.where(fine), df.where(~fine)


def fallback(df: DataFrame, keys: Sequence[str], kind: str, order: Sequence[str]) -> DataFrame:
    """All rows of the first kind, in the given order, of which a key has any."""
    turn = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in order]), F.col(kind)), F.lit(0))
    ranked = df.withColumn("_turn", turn).where("_turn > 0")
    best = ranked.groupBy(*keys).agg(F.min("_turn").alias("_best"))
    return ranked.join(best, list(keys)).where("_turn = _best").drop("_turn", "_best")


# ------------------------------------------------------------------ groups and pairs


def having(df: DataFrame, keys: Sequence[str], least: int, most: int | None = None) -> DataFrame:
    """Rows of the groups that have at least ``least`` (and at most ``most``) rows."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join((n if most is None else n.where(F.col("_n") <= most)).drop("_n"), list(keys), "left_semi")


def pair_join(df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str] = ()) -> DataFrame:
    """All pairs of rows of one group with a.position < b.position, as position_a, position_b and columns of both."""
    side = lambda s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in (position, *columns)])
    return side("a").join(side("b"), list(keys)).where(F.col(f"{position}_a") < F.col(f"{position}_b"))


def catalog(df: DataFrame, keys: Sequence[str], file: str, date: str, proposal: str, ra: str, dec: str, *, centre: str = "first", least: int = 2) -> DataFrame:
    """One row per group: exposures, pairs, proposals, date range, files in order of date; the centre is the first row's or the mean."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(file).alias("f"), F.col(ra).alias("ra"), F.col(dec).alias("dec"))))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_exposures"), F.array_sort(F.collect_set(proposal)).alias("proposals"),
        F.concat_ws(" → ", F.min(date), F.max(date)).alias("date_range"), ordered.alias("_rows"), F.avg(ra).alias("_ra"), F.avg(dec).alias("_dec"),
    ).where(F.col("n_exposures") >= least)
    first = centre == "first"
    return out.select(
        *keys, (F.col("_rows")[0]["ra"] if first else F.col("_ra")).alias("ra_targ"), (F.col("_rows")[0]["dec"] if first else F.col("_dec")).alias("dec_targ"),
        "n_exposures", pairs_of(F.col("n_exposures")).alias("n_pairs"), "proposals", "date_range", F.col("_rows.f").alias("files"),
    )


def band_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, tolerance: float, condition: Column | None = None, measures: dict[str, Column] | None = None
) -> DataFrame:
    """Pairs with equal keys and values less than ``tolerance`` apart; ``measures``: further columns, made of keys and the two values alone.

    The right side is filed in the buckets of width ``tolerance`` (and a hair, for rounding) on either side of its own, so the join is an equi-join on keys
    and bucket that spreads a key of very many rows over its buckets; the true distance is tested last.  There may be thousands of pairs a row, so both
    sides are dealt by keys and bucket to the session's number of partitions, however few bytes they have; they are never broadcast to few tasks.

    Rows of one value meet others as one: their distance and measures are computed once, and the pairs, whose number is quadratic by nature, leave in runs of equal values
    and repeated rows, which files hold in a fraction of the bytes.
    """
    keys = list(keys)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = lambda c: F.floor(F.col(c) / (tolerance * (1 + 2.0**-30))).cast("long")
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")  # noqa: E731  # nothing else has pairs
    a = left.where(finite(left_value)).withColumn("_bucket", bucket(left_value)).repartition(n, *keys, "_bucket")
    b = right.where(finite(right_value)).withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(right_value) + d))).repartition(n, *keys, "_bucket")
    a, b = _by_value(a, keys, left_value, "_a"), _by_value(b, keys, right_value, "_b")
    met = a.join(b.hint("merge"), [*keys, "_bucket"]).where(F.abs(F.col(left_value) - F.col(right_value)) < tolerance)
    measures = measures or {}
    pairs = met.withColumns(measures).withColumn("_x", F.explode("_a")).withColumn("_y", F.explode("_b"))
    given = lambda df, value, row: [F.col(c) if c == value else F.col(f"{row}.{c}") for c in df.columns if c not in keys]
    out = pairs.select(*keys, *given(left, left_value, "_x"), *given(right, right_value, "_y"), *measures)
    return out if condition is None else out.where(condition)


def _by_value(df: DataFrame, keys: list[str], value: str, name: str, most: int = 1000) -> DataFrame:
    """(keys, _bucket, value, name): up to ``most`` rows of one value as an array of what else they hold, where they lie."""
    others = [c for c in df.columns if c not in (*keys, "_bucket", value)]
    minus = (F.col(value) == 0) & F.col(value).cast("string").startswith("-")  # grouping gives both zeros one sign
    parts = df.sortWithinPartitions(*keys, "_bucket", value).withColumns({"_minus": minus, "_part": F.floor(F.monotonically_increasing_id() / most)})
    held = parts.groupBy(*keys, "_bucket", value, "_minus", "_part").agg(F.collect_list(F.struct(*others) if others else F.struct(F.lit(1))).alias(name))
    return held.withColumn(value, F.when(F.col("_minus"), -F.col(value)).otherwise(F.col(value))).drop("_minus", "_part")


# ------------------------------------------------------------------ ordered folds


def anchor_clusters(df: DataFrame, keys: Sequence[str], value: str, tolerance: float, row_id: str, *, at_once: int = 1000) -> DataFrame:
    """Clusters of sorted values: one ends where a value is over ``tolerance`` from its first.

    Keys of at most ``at_once`` distinct values are folded in order, each on its own; those of more by ``_by_links``, for the same rows.
    Null values are left out; missing and infinite ones are clusters of their own.  Only the numbering of a key's clusters, one row each,
    sorts a key in one task.
    """
    keys = list(keys)
    distinct = df.select(*keys, F.col(value).alias("v")).where(F.col("v").isNotNull()).distinct()
    with Scratch(df.sparkSession) as scratch:
        values = scratch.keep(distinct.join(distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys))
        few, many = (values.where(c).drop("_n") for c in (F.col("_n") <= at_once, F.col("_n") > at_once))
        given = _by_fold(few, keys, tolerance)
        given = checkpoint(given if many.isEmpty() else given.unionByName(_by_links(many, keys, tolerance, scratch)))
    number = given.where("v = anchor").select(*keys, "anchor", F.row_number().over(Window.partitionBy(*keys).orderBy("anchor")).alias("cluster"))
    found = given.join(number, [*keys, "anchor"]).withColumnRenamed("v", value)
    return df.join(found, [*keys, value]).select(*keys, row_id, value, "anchor", "cluster")


def _by_fold(values: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, v, anchor) of keys whose distinct values fit one array."""
    kind = values.schema["v"].dataType.simpleString()

    def step(state: Column, v: Column) -> Column:
        anchor = F.when(v - state.anchor > tolerance, v).otherwise(state.anchor)
        return F.struct(anchor.alias("anchor"), F.concat(state.out, F.array(F.struct(v.alias("v"), anchor.alias("a")))).alias("out"))

    ordered = F.array_sort(F.collect_list("v"))
    start = F.struct(ordered[0].alias("anchor"), F.array().cast(f"array<struct<v: {kind}, a: {kind}>>").alias("out"))
    folded = values.groupBy(*keys).agg(F.aggregate(ordered, start, step, lambda s: s.out).alias("_out"))
    return folded.select(*keys, F.explode("_out").alias("_o")).select(*keys, F.col("_o.v").alias("v"), F.col("_o.a").alias("anchor"))


def _by_links(values: DataFrame, keys: list[str], tolerance: float, scratch: Scratch) -> DataFrame:
    """(keys, v, anchor) of keys of any number of distinct values.

    What the fold visits is known beforehand: each value points at the first one over ``tolerance`` above it, and the anchors are
    what can be reached from the values after a gap.  Pointers are found inside buckets of twice the tolerance and followed by joins that double
    their reach, so a key of very many values without a gap is spread over its buckets and takes as many rounds as
    its number of clusters has binary digits.
    """
    at = F.col("v").cast("double")
    split = values.withColumn("_own", (F.abs(at) == float("inf")) | F.isnan(at) | F.lit(tolerance <= 0))
    split = scratch.keep(split.withColumn("b", F.when(~F.col("_own"), F.floor(at / (2 * (tolerance or 1.0))))))
    own, places = split.where("_own").select(*keys, "v"), split.where("NOT _own").drop("_own")
    ends = places.groupBy(*keys, "b").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    starts, links = _starts(places, ends, keys, tolerance, scratch)
    reached = scratch.keep(_follow(starts, links, keys, scratch).withColumn("_anchor", F.col("v")))
    # the anchor of a value is the last one at or below it, in its own bucket or the one before
    w = Window.partitionBy(*keys, "b").orderBy("v")
    tops = reached.join(places, [*keys, "v"]).groupBy(*keys, "b").agg(F.max("v").alias("_before")).withColumn("b", F.col("b") + 1)
    inside = places.join(reached, [*keys, "v"], "left").withColumn("anchor", F.last("_anchor", ignorenulls=True).over(w))
    return inside.join(tops, [*keys, "b"], "left").select(*keys, "v", F.coalesce("anchor", "_before").alias("anchor")).unionByName(own.withColumn("anchor", F.col("v")))


def _starts(places: DataFrame, ends: DataFrame, keys: list[str], tolerance: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(values after a gap, links from a value to the first one over ``tolerance`` above it where that is no value after a gap)."""
    before = ends.select(*keys, (F.col("b") + 1).alias("b"), F.col("last").alias("_last"))
    last = F.coalesce(F.lag("v").over(Window.partitionBy(*keys, "b").orderBy("v")), F.col("_last"))
    starts = scratch.keep(places.join(before, [*keys, "b"], "left").withColumn("_p", last).where(F.col("_p").isNull() | (F.col("v") - F.col("_p") > tolerance)).select(*keys, "v"))
    # ask from a hair below v + tolerance; where the subtraction then says no, as rounding may have it, ask again from the value found
    at = F.col("v").cast("double")
    ask, found = places.select(*keys, "v", (at + tolerance - (F.abs(at) + tolerance) * 2.0**-50).alias("p")), None
    after = ends.select(*keys, (F.col("b") - 1).alias("b"), F.col("first").alias("_first"))
    w = Window.partitionBy(*keys, "b").orderBy(F.col("p").desc(), F.col("v").isNull().cast("int"))
    while True:
        both = ask.withColumn("b", F.floor(F.col("p") / (2 * tolerance))).withColumn("_next", F.lit(None).cast(places.schema["v"].dataType))
        both = both.unionByName(places.select(*keys, F.lit(None).cast(places.schema["v"].dataType).alias("v"), at.alias("p"), "b", F.col("v").alias("_next")))
        met = both.withColumn("_next", F.last("_next", ignorenulls=True).over(w)).where("v IS NOT NULL").join(after, [*keys, "b"], "left")
        met = scratch.keep(met.select(*keys, "v", F.coalesce("_next", "_first").alias("next")).where("next IS NOT NULL"))
        far = F.col("next") - F.col("v") > tolerance
        good = met.where(far)
        found = good if found is None else found.unionByName(good)
        ask = met.where(~far).select(*keys, "v", F.col("next").cast("double").alias("p"))
        if ask.isEmpty():
            return starts, found.join(starts.select(*keys, F.col("v").alias("next")), [*keys, "next"], "left_anti").select(*keys, "v", "next")


def _follow(starts: DataFrame, links: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """All values that can be reached from ``starts``: each round follows links of twice the length from all that has been reached."""
    reached, links = starts, scratch.keep(links)
    while True:
        new = scratch.keep(reached.join(links, [*keys, "v"]).select(*keys, F.col("next").alias("v")))
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        then = links.select(*keys, F.col("v").alias("next"), F.col("next").alias("_then"))
        last, links = links, scratch.keep(links.join(then, [*keys, "next"]).select(*keys, "v", F.col("_then").alias("next")))
        scratch.drop(last)


def anchor_groups(df: DataFrame, keys: Sequence[str], row_id: str, value: str, tolerance: float, *, at_once: int = 1000) -> DataFrame:
    """Greedy groups in order of ``row_id``: a row joins the first group whose first row is less than ``tolerance`` away, else starts one.

    Which rows start groups depends on the order, and only the first row of each distinct value can.  Keys of at most ``at_once`` distinct values are
    folded, run by run between gaps; those of more by ``_by_rounds``, for the same rows.  Rows are then matched to the
    anchors by a band join.  Null, missing and infinite values are in no group.
    """
    keys = list(keys)
    first = df.where(F.abs(F.col(value).cast("double")) < float("inf")).groupBy(*keys, F.col(value).alias("v")).agg(F.min(row_id).alias("i"))
    with Scratch(df.sparkSession) as scratch:
        first = scratch.keep(first)
        sized = first.join(first.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
        few, many = (sized.where(c).drop("_n") for c in (F.col("_n") <= at_once, F.col("_n") > at_once))
        anchors = _first_by_fold(few, keys, tolerance)
        anchors = checkpoint(anchors if many.isEmpty() else anchors.unionByName(_by_rounds(many, keys, tolerance, scratch)))
    each = anchors.select(*keys, F.col("i").alias("anchor_id"), F.col("v").alias("anchor_value"))
    near = band_join(df, each, keys, value, "anchor_value", tolerance).where(F.col("anchor_id") <= F.col(row_id))
    return near.groupBy(*keys, row_id).agg(F.min("anchor_id").alias("anchor_id"))


def _first_by_fold(first: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, i, v) of the rows that start groups, of keys whose distinct values fit one array."""
    w = Window.partitionBy(*keys).orderBy("v")
    gap = F.coalesce(F.col("v") - F.lag("v").over(w) >= tolerance, F.lit(False)).cast("int")
    runs = first.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w))
    rows = F.array_sort(F.collect_list(F.struct("i", "v")))
    kind = {c: first.schema[c].dataType.simpleString() for c in ("i", "v")}

    def step(state: Column, x: Column) -> Column:
        return F.when(F.exists(state, lambda a: F.abs(a.v - x.v) < tolerance), state).otherwise(F.concat(state, F.array(x)))

    folded = runs.groupBy(*keys, "_run").agg(F.aggregate(rows, F.array().cast(f"array<struct<i: {kind['i']}, v: {kind['v']}>>"), step).alias("_a"))
    return folded.select(*keys, F.explode("_a").alias("_a")).select(*keys, F.col("_a.i").alias("i"), F.col("_a.v").alias("v"))


def _by_rounds(first: DataFrame, keys: list[str], tolerance: float, scratch: Scratch) -> DataFrame:
    """(keys, i, v) of the rows that start groups, of keys of any number of distinct values.

    A row starts a group as soon as no earlier one that is still open is near; it closes those near it.  Only the earliest open row of a bucket
    can be next, so a round asks one row of each bucket of half the tolerance, and the rows meet them in equi-joins on keys and bucket.  Where
    ids don't follow values a few rounds settle nearly all; where they do, each takes one group of a run.
    """
    bucket = F.floor(F.col("v").cast("double") / (tolerance / 2))
    reach = F.explode(F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda d: F.col("_own") + d))  # two buckets, and one for rounding
    earlier = (F.col("i") < F.col("_i")) | ((F.col("i") == F.col("_i")) & (F.col("v") < F.col("_v")))
    near = F.abs(F.col("v") - F.col("_v")) < tolerance

    def filed(anchors: DataFrame) -> DataFrame:
        return anchors.withColumn("_b", reach).withColumnsRenamed({k: f"_k_{k}" for k in keys})

    met = F.col("b") == F.col("_b")
    for k in keys:
        met = met & (F.col(k) == F.col(f"_k_{k}"))
    started, left = [], scratch.keep(first.withColumn("b", bucket))
    while not left.isEmpty():
        least = left.groupBy(*keys, F.col("b").alias("_own")).agg(F.min(F.struct("i", "v")).alias("_l"))
        least = scratch.keep(least.select(*keys, "_own", F.col("_l.i").alias("_i"), F.col("_l.v").alias("_v")))
        late = left.join(filed(least), met & near & earlier).select(*keys, "_own").distinct()
        new = scratch.keep(least.join(late, [*keys, "_own"], "left_anti"))
        last, left = left, scratch.keep(left.join(filed(new), met & near, "left_anti"))
        scratch.drop(last, least)
        started.append(new)
    return reduce(DataFrame.unionByName, started).select(*keys, F.col("_i").alias("i"), F.col("_v").alias("v"))


def tightest_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], day: str, n: int) -> DataFrame:
    """Per group the run of ``n`` rows, in order, that spans the fewest days; the first of equals; groups of at most n rows whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    size = Window.partitionBy(*keys)
    ranked = df.withColumns({"_pos": F.row_number().over(w), "_size": F.count(F.lit(1)).over(size), "_first": F.lag(day, n - 1).over(w)})
    spans = ranked.where(F.col("_first").isNotNull() & (F.col("_size") > n)).groupBy(*keys).agg(F.min(F.struct((F.col(day) - F.col("_first")).alias("span"), F.col("_pos").alias("end"))).alias("_best"))
    out = ranked.join(spans, list(keys), "left")
    inside = F.col("_best").isNull() | F.col("_pos").between(F.col("_best.end") - n + 1, F.col("_best.end"))
    return out.where(inside).drop("_pos", "_size", "_first", "_best")


def numbered(df: DataFrame, order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Rows with the running total of ``amount`` in the given order.

    Rows are dealt in ranges of the order, as many as the session's shuffle partitions, and written, so that a range keeps its rows when an executor is
    lost.  The totals of the ranges, one row each, are summed first; then each range runs from the total before it, so no task sees all rows.
    """
    dealt = checkpoint(df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), "_amount": amount}))
    sums = dealt.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.sum("_amount").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_run", run).join(F.broadcast(before), "_part").withColumn(name, F.col("_run") + F.col("_before")).drop("_part", "_amount", "_run", "_before")


def budget_prefix(df: DataFrame, order: Sequence[str], amount: str, budget: float) -> DataFrame:
    """Rows, in order, until the running total would go over the budget."""
    return numbered(df, order, F.col(amount), "running").where(F.col("running") <= budget)


def take_targets(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows in order: a top-k that each partition cuts before the rows meet."""
    return df.orderBy(*order).limit(most)


def first_occurrences(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once, with the first place it has; sorted by it, that is the order of first appearance."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def unroll(df: DataFrame, keys: Sequence[str], array: str, name: str) -> DataFrame:
    """A list column as rows with their place."""
    return df.select(*keys, F.posexplode(array).alias("pos", name))


def total_line(df: DataFrame, key: str, aggregates: dict[str, Column], total: str = "TOTAL") -> DataFrame:
    """Rows of each group and one over all; aggregates that aren't sums are worked out again over all rows."""
    return df.rollup(key).agg(*[c.alias(n) for n, c in aggregates.items()], F.grouping(key).alias("_all")).withColumn(key, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(key).cast("string"))).drop("_all")


def fixed_width(columns: dict[str, str], gap: str = "  ") -> Column:
    """A row as one line of a report: each column in its own printf form, such as %-12s, %6d or %10.2f, with nulls as dashes of the same width."""
    parts = [F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c))), F.rpad(F.lit("-"), int("".join(x for x in form.split(".")[0] if x.isdigit())), " ")) for c, form in columns.items()]
    return F.rtrim(F.concat_ws(gap, *parts))


def placed(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """Rows with their place, from 0, in a stable order: the last of ``order`` is the input's own position, so ties keep it.  No task sees all rows."""
    return numbered(df, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


# ------------------------------------------------------------------ order, choice, splits


def hash_order(*columns: str) -> Column:
    """A reproducible stand-in for a seeded random order."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def sample_per_group(df: DataFrame, keys: Sequence[str], row_id: Sequence[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(hash_order(*row_id), *row_id)
    return df.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= n).drop("_turn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def lowest_share(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int) -> DataFrame:
    """The first 1 / ``parts`` of each group in the given order, at least one row."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    sizes = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / parts)).alias("_most"))
    return ranked.join(sizes, list(keys)).where("_rank <= _most").drop("_rank", "_most")


def split_slots(df: DataFrame, slot: str, share: float = 0.8, per_slot: int = 1) -> DataFrame:
    """Slots in hash order, of which the first share trains; each slot then gives ``per_slot`` samples of its own side."""
    slots = df.select(slot).distinct()
    unit = F.conv(F.left(F.md5(F.col(slot).cast("string")), F.lit(8)), 16, 10).cast("long") / float(1 << 32)
    sides = slots.withColumn("split", F.when(unit < share, "train").otherwise("valid"))
    return sides.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(per_slot - 1))))


def nearest_to_median(df: DataFrame, keys: Sequence[str], value: str, row_id: str) -> DataFrame:
    """The row whose value is nearest to its group's median; the least row_id of equals, to six digits, as an even group's median lies between two."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("_mid"))
    near = df.join(mid, list(keys)).withColumn("_off", F.round(F.abs(F.col(value) - F.col("_mid")), 6))
    return near.groupBy(*keys).agg(F.min(F.struct("_off", row_id, value)).alias("_b")).select(*keys, F.col(f"_b.{row_id}").alias(row_id), F.col(f"_b.{value}").alias(value))


def first_enough(df: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[float], enough: int) -> DataFrame:
    """Per group the rows over the first threshold, of a falling list, that leaves at least ``enough``; the last one else."""
    counts = df.groupBy(*keys).agg(*[F.count(F.when(F.col(value) > t, 1)).alias(f"_n{k}") for k, t in enumerate(thresholds)])
    chosen = F.lit(float(thresholds[-1]))
    for k in range(len(thresholds) - 2, -1, -1):
        chosen = F.when(F.col(f"_n{k}") >= enough, F.lit(float(thresholds[k]))).otherwise(chosen)
    return df.join(counts.select(*keys, chosen.alias("threshold")), list(keys)).where(F.col(value) > F.col("threshold"))


def runs_through(df: DataFrame, keys: Sequence[str], position: str, condition: Column) -> DataFrame:
    """Runs of neighbouring positions for which the condition holds: start, end and length of each."""
    hit = df.where(F.coalesce(condition, F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(position)
    island = hit.withColumn("_island", F.col(position) - F.row_number().over(w))
    return island.groupBy(*keys, "_island").agg(F.min(position).alias("run_start"), F.max(position).alias("run_end"), F.count(F.lit(1)).alias("run_length")).drop("_island")
