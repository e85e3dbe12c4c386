"""The Merkle manifest, held against trees that are built whole."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from skyframe.llm import merkle

KINDS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, arity=3):
    """(root, for each leaf the (before, after) of its levels)."""
    proofs, nodes, owners = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(nodes) > 1:
        runs = [range(k, min(k + arity, len(nodes))) for k in range(0, len(nodes), arity)]
        for run in runs:
            for k in run:
                for owner in owners[k]:
                    proofs[owner].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        nodes, owners = [digest("".join(nodes[k] for k in run)) for run in runs], [sum((owners[k] for k in run), []) for run in runs]
    return nodes[0], proofs


def plainly(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    made, subroots = [], []
    for source in sources:
        group = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, proofs = tree([leaf(r) for r in group])
        subroots.append(subroot)
        made.append((group, proofs))
    out = []
    root, upper = tree(subroots)
    for (group, proofs), subroot, rest in zip(made, subroots, upper, strict=True):
        for row, proof in zip(group, proofs, strict=True):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            folded = leaf(row[:4] + (row[4].replace("\n", ""),)) if changed else leaf(row)
            for before, after in proof + rest:
                folded = digest(before + folded + after)
            out.append((row[0], leaf(row), subroot, root, digest("".join(b + a for b, a in proof + rest)), folded, folded == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def asked(spark, rows, **options):
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    return order(tuple(r) for r in merkle.verified_documents(df, **options).collect())


EDGES = [(1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (1, "a", "en", 4, "x\ny"), (2, None, None, None, None), (3, "", "", 0, ""), (None, "é", "en", 1, "\n"), (None, None, None, None, None), (5, "z", "fr", 9, "a\nb" * 20000), (6, "Z", "fr", 9, "ü")]


@pytest.mark.parametrize("per_part", [2, 4, 10_000])
def test_edges(spark, per_part):
    assert asked(spark, EDGES, rows_per_part=per_part, fan_in=2) == order(plainly(EDGES))


@pytest.mark.parametrize(("n", "per_part", "fan_in"), [(1, 10, 2), (3, 1, 2), (4, 2, 2), (200, 7, 3), (200, 50, 64)])
def test_sizes_and_borders(spark, n, per_part, fan_in):
    rows = [(k * 7 % 1000, "hot" if k % 3 else f"s{k % 11}", "en", k, f"text\n{k}") for k in range(n)]
    assert asked(spark, rows, rows_per_part=per_part, fan_in=fan_in) == order(plainly(rows))


def test_repeated_rows_are_split(spark):
    rows = [(7, "hot", "en", 1, "the same\n")] * 90 + [(k, "cold", "en", k, str(k)) for k in range(30)]
    assert asked(spark, rows, rows_per_part=10, fan_in=4) == order(plainly(rows))
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    with merkle.Scratch(spark) as scratch:
        leaves = scratch.keep(df.select(F.col("source").alias("_tree"), F.col("doc_id").alias("_order"), merkle.leaf_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("_row")))
        placed, trees = merkle._placed(leaves, scratch, 10)
        assert trees == 2 and max(r["count"] for r in placed.groupBy("part").count().collect()) < 40


def test_empty_table(spark):
    assert asked(spark, []) == []


def test_other_columns_play_no_part(spark):
    rows = [(k, "s", "en", k, str(k)) for k in range(5)]
    df = spark.createDataFrame(rows, KINDS).withColumns({"part": F.lit("x"), "tree": F.lit(1), "_tree": F.lit(2), "digest": F.lit(None), "at": F.lit(0)})
    assert order(tuple(r) for r in merkle.verified_documents(df).collect()) == order(plainly(rows))


def test_proofs_of_other_arities(spark):
    df = spark.range(23).select((F.col("id") % 2).cast("string").alias("s"), "id")
    made = merkle.manifest(df, tree=F.col("s"), order=F.col("id"), digest=merkle.leaf_digest(F.col("id")), keep={"id": F.col("id")}, arity=2, rows_per_part=5)
    assert made.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    (root,) = {r["root"] for r in made.collect()}
    assert root == tree([tree([leaf((k,)) for k in range(s, 23, 2)], 2)[0] for s in (0, 1)], 2)[0]
