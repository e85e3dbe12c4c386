"""A Merkle manifest of a dataset: digests of rows, trees over them, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, crc_mod

TOP = -1  # the tree whose leaves are the roots of all others
NODE = ["tree", "level", "at", "size", "digest"]
PROOF = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def leaf_digest(*columns: Column) -> Column:
    """SHA-256, as hex text, over all values in turn: each its length in bytes, a colon and the value as text, or a dash for a null."""
    framed = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*framed), 256)


class Climb:
    """Parents that are open: each gathers its children's digests, by place, until it has as many as the size of its tree gives it.

    A node is an event: it joins its parent, and a parent that is whole is digested and becomes an event in turn, from a tree's root on in the
    top tree.  ``up`` keeps, for each node whose parent is whole, that parent and the digests before and after the node: the links that proofs
    are read from.  A tree's root links to its leaf of the top tree, with None and its digest.
    """

    def __init__(self, arity: int, trees: int):
        self.arity, self.open, self.up = arity, {}, {}
        self.sizes, self.widths = {TOP: trees}, {}
        self.root: str | None = None

    def width(self, tree: int, level: int) -> int:
        """The nodes of a level."""
        n = self.widths.get((tree, level))
        if n is None:
            n = self.widths[tree, level] = self.sizes[tree] if not level else -(-self.width(tree, level - 1) // self.arity)
        return n

    def add(self, tree: int, level: int, at: int, digest: str) -> None:
        while True:
            n = self.width(tree, level)
            if n == 1 and tree == TOP:
                self.root = digest
                return
            if n == 1:
                self.up[tree, level, at] = ((TOP, 0, tree), None, digest)
                tree, level, at = TOP, 0, tree
                continue
            parent = (tree, level + 1, at // self.arity)
            children = self.open.setdefault(parent, {})
            children[at] = digest
            if len(children) < min(self.arity, n - self.arity * parent[2]):
                return
            del self.open[parent]
            ordered = [children[p] for p in sorted(children)]
            for k, p in enumerate(sorted(children)):
                self.up[tree, level, p] = (parent, "".join(ordered[:k]), "".join(ordered[k + 1 :]))
            (tree, level, at), digest = parent, hashlib.sha256("".join(ordered).encode("ascii")).hexdigest()

    def left(self) -> Iterator[tuple[int, int, int, str]]:
        """Nodes whose parents are not whole yet."""
        for (tree, level, _), children in self.open.items():
            for at, digest in children.items():
                yield tree, level - 1, at, digest

    def proof(self, node: tuple[int, int, int]) -> tuple[list[tuple[str, str]], str | None, tuple[int, int, int]]:
        """(steps up from the node, its tree's root where it is passed, the node where the steps end)."""
        steps, subroot = [], None
        while node in self.up:
            above, before, after = self.up[node]
            if before is None:
                subroot = after
            else:
                steps.append((before, after))
            node = above
        return steps, subroot, node


def _climbed(nodes: pa.Table, arity: int, trees: int) -> Climb:
    climb = Climb(arity, trees)
    for tree, level, at, size, digest in zip(*(nodes[c].to_pylist() for c in NODE), strict=True):
        if tree != TOP:
            climb.sizes[tree] = size
        climb.add(tree, level, at, digest)
    return climb


def _placed(leaves: DataFrame, scratch: Scratch, rows_per_part: int) -> tuple[DataFrame, int]:
    """(the leaves with part, tree, level, at and size instead of _tree and _order, number of trees).

    Leaves are dealt in ranges of (tree, order, digest, number of the row as written before), which split trees of any size, and even rows that
    repeat.  What is counted are then rows for each tree of each range, and what meets are these counts.
    """
    keys = ["_tree", "_order", "digest", "_row"]
    parts = max(1, -(-leaves.count() // rows_per_part))
    dealt = leaves.repartitionByRange(parts, *keys) if parts > 1 else leaves.coalesce(1)
    dealt = scratch.keep(dealt.sortWithinPartitions(*keys).withColumns({"part": F.spark_partition_id().cast("long"), "_nth": F.monotonically_increasing_id()}))
    counts = scratch.keep(dealt.groupBy("part", "_tree").agg(F.count(F.lit(1)).alias("n"), F.min("_nth").alias("_first")))
    trees = counts.groupBy("_tree").agg(F.sum("n").alias("size"), F.min("part").alias("part"), F.min("_first").alias("_begin"))
    # ranges are in order of trees: a tree's number counts the trees that begin in earlier ranges, and those before it in its own
    begun = trees.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = begun.select("part", (F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("_begin")) - 1
    ranked = scratch.keep(trees.join(before, "part").select(F.col("_tree").alias("_name"), (F.col("_before") + nth).alias("tree"), "size"))
    run = Window.partitionBy("_tree").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(F.col("part").alias("_part"), "_tree", "_first", (F.sum("n").over(run) - F.col("n")).alias("_start"))
    starts = starts.join(ranked, F.col("_tree").eqNullSafe(F.col("_name"))).drop("_tree")
    placed = dealt.join(starts, (F.col("part") == F.col("_part")) & F.col("_tree").eqNullSafe(F.col("_name")))
    placed = placed.withColumns({"at": F.col("_start") + F.col("_nth") - F.col("_first"), "level": F.lit(0)})
    kept = scratch.keep(placed.drop("_part", "_name", "_nth", "_first", "_start", "_order", "_row", "_tree"))
    total = ranked.count()
    scratch.drop(dealt, counts, ranked)
    return kept, total


def _proven(leaves: DataFrame, trees: int, arity: int, fan_in: int, scratch: Scratch) -> DataFrame:
    """``leaves`` (part, tree, level, at, size, digest and others) with proof, subroot and root.

    Each part climbs as far as its own nodes reach.  What is left goes into one part of ``fan_in`` neighbouring ones, and so on until nothing is
    left; the proofs of what was handed on then come back the same way.
    """

    def rise(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by([("tree", "ascending"), ("level", "ascending"), ("at", "ascending")])
        climb = _climbed(nodes, arity, trees)
        left = list(climb.left())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*left, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)] if left else [pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.string())]
        sizes = pa.array([climb.sizes[n[0]] for n in left], pa.int64())
        part = pa.array([nodes["part"][0].as_py()] * len(left), pa.int64())
        return pa.table([part, *columns[:3], sizes, columns[3]], names=["part", *NODE])

    def descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by([("tree", "ascending"), ("level", "ascending"), ("at", "ascending")])
        climb = _climbed(nodes, arity, trees)
        known = {(t, v, a): ([(s["before"], s["after"]) for s in p], s, r) for t, v, a, p, s, r in zip(*(above[c].to_pylist() for c in ("tree", "level", "at", "proof", "subroot", "root")), strict=True)}
        proofs, subroots, roots = [], [], []
        for node in zip(nodes["tree"].to_pylist(), nodes["level"].to_pylist(), nodes["at"].to_pylist(), strict=True):
            steps, subroot, end = climb.proof(node)
            rest, passed, root = known.get(end, ([], None, climb.root))
            proofs.append([{"before": b, "after": a} for b, a in steps + rest])
            subroots.append(subroot or passed)
            roots.append(root)
        for name, column in (("proof", pa.array(proofs, PROOF)), ("subroot", pa.array(subroots, pa.string())), ("root", pa.array(roots, pa.string()))):
            nodes = nodes.append_column(name, column)
        return nodes

    simple = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    found = "proof array<struct<before:string,after:string>>, subroot string, root string"
    rounds = [leaves]
    while True:
        nodes = rounds[-1].select("part", *NODE)
        left = scratch.keep(nodes.groupBy("part").applyInArrow(rise, "part long, tree long, level int, at long, size long, digest string"))
        if left.isEmpty():
            break
        rounds.append(left.withColumns({"origin": F.col("part"), "part": F.floor(F.col("part") / fan_in).cast("long")}))
    above = leaves.sparkSession.createDataFrame([], f"part long, tree long, level int, at long, {found}")
    for nodes in reversed(rounds[1:]):
        proven = nodes.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(descend, f"{simple(nodes)}, {found}")
        above = scratch.keep(proven.select(F.col("origin").alias("part"), "tree", "level", "at", "proof", "subroot", "root"))
    return leaves.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(descend, f"{simple(leaves)}, {found}")


def manifest(rows: DataFrame, *, tree: Column, order: Column, digest: Column, keep: dict[str, Column] | None = None, arity: int = 3, rows_per_part: int = 10_000, fan_in: int = 64) -> DataFrame:
    """(leaf, subroot, root, proof, and the columns of ``keep``) of every row.

    The leaves of a tree ascend by ``order``; every ``arity`` nodes in a row (the last run may be shorter) have one parent, the SHA-256 of their digests
    as hex text, until one node is left, the subroot.  The subroots, in order of ``tree`` (null first, then by bytes), are leaves of the same kind up to
    the root.  ``proof`` has the levels from the leaf to the root, each with the digests before and after; ``folded`` rebuilds a root from it.

    Rows are dealt in ranges, which split trees of any size.  Each range combines what lies in it, and only the partial parents at its borders meet again:
    a task holds ``rows_per_part`` rows, or the borders of ``fan_in`` ranges.  Null orders come first, rows of one order stand by their digests, and
    repeated rows are leaves each, of which any order gives the same digests.  Null and empty values differ, long ones are hashed whole.  An empty table
    gives no rows.  Columns of ``rows`` that are not named play no part, whatever their names.
    The written tables stay in the shared folder until the driver's Python ends, as the result reads them.
    """
    scratch = Scratch(rows.sparkSession).until_exit()
    carried = {f"keep_{k}": c for k, c in (keep or {}).items()}
    leaves = scratch.keep(rows.select(tree.alias("_tree"), order.alias("_order"), digest.alias("digest"), F.monotonically_increasing_id().alias("_row"), *(c.alias(k) for k, c in carried.items())))
    placed, trees = _placed(leaves, scratch, rows_per_part)
    scratch.drop(leaves)
    proven = _proven(placed, trees, arity, fan_in, scratch)
    return proven.select(*(F.col(k).alias(k.removeprefix("keep_")) for k in carried), F.col("digest").alias("leaf"), "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all digests of a proof, from the leaf's level to the root's."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda step: F.array(step["before"], step["after"]))), ""), 256)


def verified_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document, where texts of even crc32(doc_id) lose their line feeds first.

    A tree for each source, over leaves of (doc_id, source, lang, n_chars, text).  ``folded_root`` is rebuilt from the leaf as tampered with, and the
    proof of the untampered one, so a text that has lost something does not verify.  Null texts and texts without line feeds stay as they are, and so do
    rows with a null id.  See ``manifest`` for repeated rows and empty tables.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    text = F.when(crc_mod("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    keep = {"doc_id": F.col("doc_id").cast("long"), "tampered": leaf_digest(*columns[:4], text)}
    made = manifest(docs, tree=F.col("source"), order=F.col("doc_id"), digest=leaf_digest(*columns), keep=keep, **options)
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
