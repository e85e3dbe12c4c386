"""Quality: ordinal cumulative-link regression on hashed text, from graded ratings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash_strings, mix, small, split_words
from .sample import labelled_sample


def _shape(word: str) -> str:
    """The kinds of characters in a word, runs of one kind told once."""
    out, last = [], ""
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "w" if c.isalpha() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


def hashed(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the features of a batch of texts.

    Each word counts in the buckets of its lower-case form and of its shape, with the square root of
    its count, the vector scaled to length one.  Buckets of their own hold, in steps, the text's length,
    share of distinct words, mean word length, and share of its most frequent word.
    """
    offsets, codes, vocabulary = split_words(texts, lower=False)
    n, sizes, v = len(offsets) - 1, np.diff(offsets), len(vocabulary)
    mask = np.uint64((1 << bits) - 1)
    owner = np.repeat(np.arange(n), sizes)
    pair, counts = np.unique(owner * max(v, 1) + codes, return_counts=True)
    text, word = pair // max(v, 1), pair % max(v, 1)
    names = vocabulary.to_pylist()
    word_bucket = (hash_strings(pa.array([w.lower() for w in names], pa.string())) & mask).astype(np.int64)
    shape_bucket = (mix(hash_strings(pa.array([_shape(w) for w in names], pa.string()))) & mask).astype(np.int64)
    value = np.sqrt(counts)
    scale = 1 / np.sqrt(np.maximum(np.bincount(text, value**2, n), 1))
    value = value * scale[text]
    lengths = np.fromiter(map(len, names), np.int64, v)
    distinct = np.bincount(text, minlength=n) / np.maximum(sizes, 1)
    mean = np.bincount(text, counts * lengths[word], n) / np.maximum(sizes, 1) if v else np.zeros(n)
    top = np.zeros(n)
    np.maximum.at(top, text, counts)
    top = top / np.maximum(sizes, 1)
    # the share of words that repeat the word, or the pair of words, before them
    same = np.zeros(n)
    if len(codes) > 1:
        again = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        same = np.bincount(owner[1:][again], minlength=n) / np.maximum(sizes, 1)
    steps = np.stack([np.log2(sizes + 1).astype(np.int64), (distinct * 10).astype(np.int64), np.minimum(mean, 30).astype(np.int64), (top * 10).astype(np.int64), (same * 10).astype(np.int64)], 1)
    doc_bucket = (mix(steps.astype(np.uint64) + np.arange(1, 6, dtype=np.uint64)[None, :] * np.uint64(1 << 32)) & mask).astype(np.int64)
    return (
        np.concatenate([text, text, np.repeat(np.arange(n), 5)]),
        np.concatenate([word_bucket[word], shape_bucket[word], doc_bucket.ravel()]) if v else doc_bucket.ravel(),
        np.concatenate([value, value, np.full(5 * n, 0.5)]),
    )


class Model:
    """Grades in order, thresholds between them, and one weight per bucket for all of them."""

    def __init__(self, grades: list, thresholds: np.ndarray, weights: np.ndarray, bits: int):
        self.grades, self.thresholds, self.weights, self.bits = grades, thresholds, weights, bits

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """P(grade) of each text, one column per grade."""
        text, bucket, value = hashed(texts, self.bits)
        latent = np.bincount(text, value * self.weights[bucket], len(texts))
        under = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - latent[:, None], -40, 40)))
        full = np.hstack([np.zeros((len(texts), 1)), under, np.ones((len(texts), 1))])
        return np.diff(full, axis=1)


def fit(text: np.ndarray, bucket: np.ndarray, value: np.ndarray, level: np.ndarray, levels: int, bits: int, *, ridge: float = 2e-4, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, weights) of the cumulative logit model P(y <= k) = s(threshold_k - w.x), by Adam on all rows.

    The first threshold and the logarithms of the gaps are free, so the order always holds.
    """
    n, gaps = len(level), levels - 2
    order = np.argsort(bucket, kind="stable")
    text, bucket, value = text[order], bucket[order], value[order]
    used, starts = np.unique(bucket, return_index=True)
    place = np.repeat(np.arange(len(used)), np.diff(np.append(starts, len(bucket))))
    share = np.cumsum(np.bincount(level, minlength=levels))[:-1] / n
    cuts = np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3)), np.zeros(len(used))])
    m1, m2 = np.zeros_like(free), np.zeros_like(free)
    rows = np.arange(n)
    for t in range(1, rounds + 1):
        steps = np.exp(free[1 : 1 + gaps])
        theta = free[0] + np.concatenate([[0], np.cumsum(steps)])
        w = free[1 + gaps :]
        latent = np.bincount(text, value * w[place], n)
        edges = np.hstack([np.full((n, 1), -40.0), np.clip(theta[None, :] - latent[:, None], -40, 40), np.full((n, 1), 40.0)])
        s = 1 / (1 + np.exp(-edges))
        slope = s * (1 - s)
        slope[:, 0] = slope[:, -1] = 0
        p = np.maximum(s[rows, level + 1] - s[rows, level], 1e-12)
        up, low = slope[rows, level + 1] / p, slope[rows, level] / p
        grad_latent = (up - low) / n
        grad_theta = np.bincount(level, -up / n, levels)[:-1] + np.bincount(level, low / n, levels)[1:]
        grad = np.empty_like(free)
        grad[0] = grad_theta.sum()
        grad[1 : 1 + gaps] = steps * np.cumsum(grad_theta[::-1])[::-1][1:]
        grad[1 + gaps :] = np.add.reduceat(value * grad_latent[text], starts) + ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        free -= 0.12 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8) * min(1.0, 4 * (1 - t / (rounds + 1)))
    weights = np.zeros(1 << bits)
    weights[used] = free[1 + gaps :]
    return free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1 : 1 + gaps]))]), weights


def train(docs: DataFrame, labels: DataFrame, *, held_out: Column, sample_rows: int = 6000, bits: int = 16, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample_rows`` rated documents outside ``held_out`` (the bound of what reaches the driver)."""
    train_rows = ~F.coalesce(held_out, F.lit(False))
    sample = labelled_sample(docs, labels, label_col, rows=sample_rows, train=train_rows, id_col=id_col, text_col=text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            text, bucket, value = hashed(batch["text"], bits)
            order = np.argsort(text, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order])) for x in (bucket.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch["label"], *lists], ["label", "buckets", "amounts"])

    got = sample.mapInArrow(rows, "label long, buckets array<int>, amounts array<float>").toArrow()
    grades = sorted(set(got["label"].to_pylist()))
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(0), np.zeros(1 << bits), bits)
    level = np.searchsorted(np.array(grades), np.asarray(got["label"]))
    buckets = got["buckets"].combine_chunks()
    text = np.repeat(np.arange(len(level)), np.asarray(buckets.value_lengths()))
    thresholds, weights = fit(text, np.asarray(buckets.flatten(), dtype=np.int64), np.asarray(got["amounts"].combine_chunks().flatten(), dtype=np.float64), level, len(grades), bits)
    # every label had an equal share of the sample: move the thresholds back to the labels' own shares
    known = {r["g"]: r["n"] for r in labels.where(train_rows & F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("long").alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = np.bincount(level, minlength=len(grades))
    logit = lambda counts: (lambda c: np.log(np.maximum(c, 0.5) / np.maximum(counts.sum() - c, 0.5)))(np.cumsum(counts)[:-1])
    true = np.array([known.get(g, 1) for g in grades], float)
    return Model(grades, np.maximum.accumulate(thresholds + logit(true) - logit(drawn.astype(float))), weights, bits)


def default_held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 5) == 0


def quality(docs: DataFrame, labels: DataFrame, *, grade: int | None = None, tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, selected) of every document.

    ``tail_probability`` is that of ``grade`` (default: the second of the grades in order) or better, and a document is selected where it
    reaches ``tail``.  Learned from rated rows whose crc32(doc_id) mod 5 is not 0.  Whole texts are read where they
    lie; only the weights travel.  Null and empty texts are scored as texts without words; with no ratings,
    or one grade only, every document has that grade for certain.  Repeated rows are scored each.
    """
    model = train(docs, labels, held_out=default_held_out(id_col), label_col=label_col, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    grades = np.array(model.grades, float)
    at = int(np.searchsorted(grades, grade)) if grade is not None else min(1, len(grades) - 1)
    shared = docs.sparkSession.sparkContext.broadcast((model.grades, model.thresholds, model.weights, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for batch in small(batches, 1):
            p = fitted.probabilities(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ grades), pa.array(p[:, at:].sum(1))], ["doc_id", "expected_grade", "tail_probability"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double")
    return scored.select("doc_id", F.coalesce(default_held_out("doc_id"), F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= tail).alias("selected"))
