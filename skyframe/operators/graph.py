"""Operators on graphs whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, checkpoint, freed_shuffles


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph as (id, component): the least id that can be reached, for every node but the least ones.

    ``edges`` has the columns src and dst (long, or another type that can be ordered).  Alternates the
    large-star and small-star steps: every node's neighbours are hung on the least of
    them, until each tree is a star.  All of it is joins and partial aggregates, so a node with
    very many neighbours is summed map-side and its join partition can be split.  A round's edges are
    written to the shared folder and those of the round before dropped; the result is a checkpoint.
    """

    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()

    def stars(e: DataFrame) -> bool:
        """Whether every node has one edge up and none of those it leads to has one."""
        ends = e.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        with freed_shuffles(e.sparkSession):
            return each.where("up > 1 OR up = 1 AND down = 1").agg(F.count("*").alias("n")).first()["n"] == 0

    with Scratch(edges.sparkSession) as scratch:
        current = scratch.keep(directed(edges))
        for _ in range(max_rounds):
            if stars(current):
                return checkpoint(current.select(F.col("src").alias("id"), F.col("dst").alias("component")))
            # large star: hang the larger neighbours of a node on the least one
            both = current.select("src", "dst").unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            least = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("u"), F.least("src", "m").alias("m"))
            large = both.where("dst > src").join(least, F.col("src") == F.col("u")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            # small star: hang a node and its lesser neighbours on the least of them
            least = large.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("u"), "m")
            hung = large.join(least, F.col("src") == F.col("u")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            last, current = current, scratch.keep(directed(hung.unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))))
            scratch.drop(last)
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
