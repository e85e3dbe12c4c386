"""Near-duplicate documents: ProbMinHash signatures of word shingles, bands, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpoint, connected_components, fresh, hash_strings, mix, shingle_hashes, small, split_words

SHINGLE_WORDS = 5
BANDS, ROWS = 28, 6  # a pair at similarity 0.8 shares a band with probability 0.9998
FINE = 512  # registers of the second signature, of those documents only whose buckets stay crowded
GOLDEN = 0x9E3779B97F4A7C15


def probminhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures (texts x registers) of weighted sets, many sets at once.

    Element d of weight w arrives as a Poisson process of rate w: step by step the time
    grows by an exponential draw over w, and each arrival falls into a random register,
    which keeps the element that came first.  An element is done when its next arrival
    is later than the latest register of its set.  All draws come from the
    element's hash and the step, so two sets agree in a register with probability equal to their
    probability Jaccard similarity.  A set without elements keeps zeros.
    """
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    live, when, step = np.arange(len(element)), np.zeros(len(element)), 0
    while len(live):
        draw = mix(element[live] + np.uint64((GOLDEN * (step + 1)) % 2**64))
        u = ((draw >> np.uint64(20)).astype(np.float64) + 0.5) * 2.0**-44
        when = when - np.log(u) / weight[live]
        mine = owner[live]
        go = when < latest[mine]
        live, when, draw, mine = live[go], when[go], draw[go], mine[go]
        spot = mine * registers + (draw & np.uint64(0xFFFFF)).astype(np.int64) % registers
        better = when < first[spot]
        spot, t, who = spot[better], when[better], element[live[better]]
        order = np.argsort(-t, kind="stable")  # the earliest is written last
        first[spot[order]], winner[spot[order]] = t[order], who[order]
        step += 1
        if step < 12 or step % 8 == 0:
            some = np.unique(mine)
            latest[some] = first.reshape(texts, registers)[some].max(1)
    return winner.reshape(texts, registers)


def shingle_counts(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, times) of the distinct shingles of each text, sorted by text and hash."""
    offsets, codes, vocabulary = split_words(texts)
    owner, h = shingle_hashes(offsets, hash_strings(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64), k)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new], np.diff(np.append(np.flatnonzero(new), len(h)))


def weights(times: np.ndarray) -> np.ndarray:
    """The weight of a shingle that stands so many times in a text."""
    return 1 + np.log(times)


def probability_jaccard(ha: np.ndarray, x: np.ndarray, hb: np.ndarray, y: np.ndarray) -> float:
    """The exact probability Jaccard similarity of two weighted sets, elements ascending.

    It is the sum over shared elements d of 1 / sum over e of max(x_e / x_d, y_e / y_d).  In the order of x / y
    the first quotient is the greater one from d on and the second before d, so two running sums give all of them.
    """
    at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
    both = ha[at] == hb
    p, q = x[at[both]], y[both]
    only_x, only_y = x.sum() - p.sum(), y.sum() - q.sum()
    if (p == q).all():
        return float(p.sum() / max(only_x + only_y + p.sum(), 1e-300))
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    from_here, before = np.cumsum(p[::-1])[::-1], np.cumsum(q) - q
    return float((1 / ((only_x + from_here) / p + (only_y + before) / q)).sum())


def _even(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """For each set its weight in units of its heaviest element, the fewest elements of any set that has all of it."""
    heaviest = np.zeros(n)
    np.maximum.at(heaviest, owner, weight)
    return np.bincount(owner, weight, minlength=n) / np.maximum(heaviest, 1)


def _sketches(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct shingles, ``_even``, two fingerprints of the weighted set, and the signature cut to 16 bits a register."""
    n = len(texts)
    owner, h, times = shingle_counts(texts, k)
    weight = weights(times)
    sizes = np.bincount(owner, minlength=n)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)) * times.astype(np.uint64), dtype=np.uint64)]) for salt in (11, 23)]
    fp1, fp2 = (s[ends[1:]] - s[ends[:-1]] for s in sums)
    sketch = np.zeros((n, BANDS * ROWS), np.uint16)
    _, one = np.unique(fp1, return_index=True)  # copies have one signature; it is computed once
    one = one[np.argsort(sizes[one], kind="stable")]
    small = int(np.searchsorted(sizes[one], 24))
    cuts = [0, small]
    load = np.cumsum(sizes[one[small:]])
    while cuts[-1] < len(one):
        done = load[cuts[-1] - small - 1] if cuts[-1] > small else 0
        cuts.append(max(cuts[-1] + 1, small + int(np.searchsorted(load, done + 150_000))))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = np.sort(one[a:b])
        if not len(part):
            continue
        rank = np.full(n, -1)
        rank[part] = np.arange(len(part))
        mine = rank[owner] >= 0
        z = probminhash(rank[owner[mine]], h[mine], weight[mine], len(part), BANDS * ROWS)
        sketch[part] = (mix(z) >> np.uint64(48)).astype(np.uint16)
    _, back = np.unique(fp1, return_inverse=True)
    first = np.zeros(back.max() + 1 if n else 0, np.int64)
    first[back[one]] = one
    return sizes, _even(owner, weight, n), fp1, fp2, sketch[first[back]] if n else sketch


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    width = data.itemsize * data.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 1024) -> DataFrame:
    """One row per document: doc_id, class_id, n_shingles, kept.

    Two documents are linked if the probability Jaccard similarity of their weighted ``k``-word shingles
    (lower case, split at white space; a shingle that stands t times weighs 1 + ln t) is at least ``threshold``; where no shingle is
    repeated that is the Jaccard similarity of the sets.  class_id is the least
    doc_id that links reach, and the document with that id is kept.

    1. One pass makes each document's ProbMinHash signature, whose agreement estimates that similarity, cut to
       16 bits a register, and a 128-bit fingerprint of its shingles and their times.  Documents with one fingerprint are copies: one of them stands for all from here on.
    2. A bucket holds the documents that agree in one band.  Every member is verified against the
       bucket's least member; then, where a bucket still has several components, against its
       member with most links.  So no bucket is ever expanded into all its pairs.
    3. Buckets that still have several components are compared signature by signature, in blocks of ``block_rows``; only pairs
       of unlike components that both the signatures and a second, finer signature of these documents put within four deviations of the threshold go on.
    Each verification is exact (``probability_jaccard``).  Pairs of too unlike sizes are left out before it: the similarity is at most
    the weight that two sets share once each weighs 1 in all, which is at most the elements of one over ``_even`` of the other.

    A text of fewer than ``k`` words is one shingle of all its words.  Null and empty texts have
    no shingle, link with nothing and are kept.  Very long texts are read whole; a task holds at least its longest text and the two sets of the pair it verifies.  Rows that share a doc_id count as one document.  A null doc_id is kept unless it is a copy of a
    document that has one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            sizes, even, fp1, fp2, sketch = _sketches(batch["text"], k)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes.astype(np.int64)), pa.array(even), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), _binary(sketch)], ["id", "n", "even", "fp1", "fp2", "sketch"]
            )

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            owner, h, times = shingle_counts(batch["text"], k)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(values)) for values in (h.view(np.int64), times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(_even(owner, weights(times), batch.num_rows)), *lists], ["rep", "even", "shingles", "times"])

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, weight = batch["shingles"].flatten().to_numpy().view(np.uint64), weights(batch["times"].flatten().to_numpy())
            ends = np.asarray(batch["shingles"].offsets)
            ends = ends - ends[0]
            fine = np.zeros((batch.num_rows, FINE), np.uint8)
            for a in range(0, batch.num_rows, 64):
                b = min(a + 64, batch.num_rows)
                part = slice(ends[a], ends[b])
                owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                fine[a:b] = (mix(probminhash(owner, mix(h[part] ^ np.uint64(FINE)), weight[part], b - a, FINE)) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["rep"], _binary(fine)], ["rep", "fine"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: (np.asarray(batch[c].offsets), np.asarray(batch[c].values)) for c in ("sa", "ta", "sb", "tb")}

            def at(c: str, i: int) -> np.ndarray:
                ends, values = lists[c]
                return values[ends[i] : ends[i + 1]]

            near = [
                probability_jaccard(at("sa", i).view(np.uint64), weights(at("ta", i)), at("sb", i).view(np.uint64), weights(at("tb", i))) >= threshold - 1e-9
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["src", "dst"]).filter(pa.array(near, pa.bool_()))

    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.keep(source.mapInArrow(sign, f"id {kind}, n long, even double, fp1 long, fp2 long, sketch binary"))
        copies = scratch.keep(signed.select("id", "n", "fp1", "fp2"))
        classes = copies.where("n > 0").groupBy("fp1", "fp2").agg(F.min("id").alias("rep"))
        lead = classes.select("rep", F.col("fp1").alias("f1"), F.col("fp2").alias("f2")).where("rep IS NOT NULL")
        reps = signed.join(lead, (F.col("id") == F.col("rep")) & (F.col("fp1") == F.col("f1")) & (F.col("fp2") == F.col("f2")))
        reps = scratch.keep(reps.select("rep", "n", "even", "sketch", "fp1").dropDuplicates(["rep", "fp1"]))
        scratch.drop(signed)

        # A bucket's key is a hash of its band's registers; buckets that share one only have more to verify.
        width = 2 * ROWS
        band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.struct(j.cast("byte").alias("band"), F.xxhash64(j, F.substring("sketch", j * width + 1, F.lit(width))).alias("bucket")))
        rows = reps.select("rep", F.explode(band).alias("b")).select("b.band", "b.bucket", "rep")
        # Aggregates over buckets are joined back as plain shuffles, so the part of one bucket that very many
        # documents share is summed before it moves and can be split between tasks.
        buckets = rows.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("bucket", "least")
        members = scratch.keep(rows.join(buckets, "bucket"))  # bucket, band, rep, least
        pairs = scratch.keep(members.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct())
        busy = members.select("rep").distinct()
        sets = source.join(busy.hint("shuffle_hash"), F.col("id") == F.col("rep"), "left_semi").mapInArrow(to_sets, f"rep {kind}, even double, shingles array<long>, times array<int>")
        sets = scratch.keep(sets)

        def verified(pairs: DataFrame) -> DataFrame:
            a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"), F.col("times").alias("ta"), F.col("even").alias("ea"))
            b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"), F.col("times").alias("tb"), F.col("even").alias("eb"))
            both = pairs.join(b, "b").where(F.size("sb") > 0).join(a, "a").where(F.size("sa") > 0)
            both = both.where((F.size("sa") >= threshold * F.col("eb") - 1e-6) & (F.size("sb") >= threshold * F.col("ea") - 1e-6))
            return scratch.keep(both.select("a", "b", "sa", "ta", "sb", "tb").mapInArrow(similar, f"src {kind}, dst {kind}"))

        def joined(parts: DataFrame, edges: DataFrame) -> DataFrame:
            """The components of those known and of more edges."""
            return connected_components(parts.select(F.col("rep").alias("src"), F.col("component").alias("dst")).unionByName(edges)).select(F.col("id").alias("rep"), "component")

        def mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
            """The members of buckets that still hold several components."""
            known = members.select("bucket", "band", "rep").join(parts, "rep", "left").select("bucket", "band", "rep", F.coalesce("component", "rep").alias("c"))
            several = known.groupBy("bucket").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("bucket")
            return scratch.keep(known.join(several, "bucket"))

        edges = verified(pairs)
        parts = connected_components(edges).select(F.col("id").alias("rep"), "component")
        apart = mixed(members, parts)
        scratch.drop(pairs, members)

        degree = edges.select(F.col("src").alias("rep")).unionByName(edges.select(F.col("dst").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        ranked = apart.join(degree, "rep", "left").withColumn("rank", F.coalesce("links", F.lit(0)) * 1_000_000 + F.pmod(F.xxhash64("rep"), F.lit(1_000_000)))
        hubs = ranked.groupBy("bucket").agg(F.max_by("rep", "rank").alias("a"), F.max_by("c", "rank").alias("ca"))
        pairs = scratch.keep(apart.join(hubs, "bucket").where("c <> ca AND rep <> a").select("a", F.col("rep").alias("b")).distinct())
        parts = joined(parts, verified(pairs))
        last, apart = apart, mixed(apart, parts)
        scratch.drop(pairs, edges, last)

        cut, fine_cut = (threshold - 4 * float(np.sqrt(threshold * (1 - threshold) / registers)) for registers in (BANDS * ROWS, FINE))
        fine = scratch.keep(sets.join(apart.select("rep").distinct(), "rep", "left_semi").mapInArrow(finer, f"rep {kind}, fine binary"))
        blocks = apart.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        dealt = apart.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.join(reps.select("rep", "n", "even", "sketch"), "rep").join(fine, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("bucket", "band", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "rep", "c", "n", "even", "sketch", "fine")

        def compare(group: pa.Table) -> pa.Table:
            band, two = group["band"][0].as_py(), group["b1"][0].as_py() != group["b2"][0].as_py()
            rep, c, n, even, own = (group[x].to_numpy() for x in ("rep", "c", "n", "even", "own"))
            z = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint16).reshape(len(rep), BANDS, ROWS)
            fine = np.frombuffer(b"".join(group["fine"].to_pylist()), np.uint8).reshape(len(rep), FINE)
            left, right = [], []
            for i in range(len(rep) - 1):
                j = np.arange(i + 1, len(rep))
                j = j[(c[j] != c[i]) & ((own[j] != own[i]) | (not two)) & (n[j] >= threshold * even[i] - 1e-6) & (n[i] >= threshold * even[j] - 1e-6)]
                if not len(j):
                    continue
                same = z[j] == z[i]
                j, same = j[(near := same.mean((1, 2)) >= cut)], same[near]
                j, same = j[(near := (fine[j] == fine[i]).mean(1) >= fine_cut)], same[near]
                j = j[~same[:, :band].all(2).any(1)]  # told in an earlier band
                left += [rep[i]] * len(j)
                right += rep[j].tolist()
            return pa.table({"a": pa.array(left, group.schema.field("rep").type), "b": pa.array(right, group.schema.field("rep").type)})

        dealt = dealt.repartition("bucket", "b1", "b2")  # else the join's partitions, which hold a bucket whole, would do
        pairs = scratch.keep(dealt.groupBy("bucket", "b1", "b2").applyInArrow(compare, f"a {kind}, b {kind}").distinct())
        parts = joined(parts, verified(pairs))

        found = classes.join(parts, "rep", "left").select(F.col("fp1").alias("f1"), F.col("fp2").alias("f2"), F.coalesce("component", "rep").alias("class_id"))
        linked = copies.where("n > 0").join(found, (F.col("fp1") == F.col("f1")) & (F.col("fp2") == F.col("f2"))).select("id", "class_id", "n")
        out = linked.unionByName(copies.where("n = 0").select("id", F.col("id").alias("class_id"), "n"))
        kept = F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull())
        return checkpoint(out.select(F.col("id").alias("doc_id"), "class_id", F.col("n").alias("n_shingles"), kept.alias("kept")))


def keep_one(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, all columns as they were; one row of each repeated id.

    Rows without an id, and null and empty texts, stay.  An empty table gives an empty one.
    """
    gone, again = fresh(docs, "gone"), fresh(docs, "again")
    away = near_duplicates(docs, threshold=threshold, id_col=id_col, text_col=text_col).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(away, F.col(id_col) == F.col(gone), "left_anti")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(again)).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(again)
    if repeated.isEmpty():
        return left
    twice = left.join(repeated, F.col(id_col) == F.col(again), "left_semi").dropDuplicates([id_col])
    return left.join(repeated, F.col(id_col) == F.col(again), "left_anti").unionByName(twice)
