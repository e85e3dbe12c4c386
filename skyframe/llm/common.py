"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components as connected_components
from ..session import Scratch as Scratch
from ..session import bound_batches as bound_batches
from ..session import checkpoint as checkpoint
from ..session import freed_shuffles as freed_shuffles
from ..session import shared_folder as shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def small(batches: Iterable[pa.RecordBatch], column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text; a longer text is a batch of its own.

    An Arrow batch is cut by rows, so its size depends on the texts; this bounds what a task holds at once.
    """
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Split a batch of texts at ASCII white space.

    Returns (offsets, codes, vocabulary): the words of text i are
    ``vocabulary[codes[offsets[i]:offsets[i + 1]]]``; a null text has none.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) and np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]:  # the lower-case kernel misreads arrays that are cut from others
        texts = texts.take(pa.array(np.arange(len(texts))))
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool)
    if not keep.all():
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat = flat.filter(pa.array(keep))
    coded = flat.dictionary_encode()
    return offsets, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


_MULTIPLIERS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= _MULTIPLIERS[0]
    x ^= x >> np.uint64(27)
    x *= _MULTIPLIERS[1]
    x ^= x >> np.uint64(31)
    return x


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same on every machine and in every process."""
    values = values.cast(pa.large_string())
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + n + 1]
    size = np.diff(offsets)
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
    out = mix(size.astype(np.uint64))
    # eight bytes at a time, over the strings that still have some
    live, at = np.arange(n), offsets[:-1].copy()
    left = size.copy()
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    while len(live := live[left[live] > 0]):
        word = np.zeros(len(live), np.uint64)
        for k in range(8):
            inside = left[live] > k
            word |= np.where(inside, padded[np.minimum(at[live] + k, len(padded) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
        out[live] = mix(out[live] ^ word)
        at[live] += 8
        left[live] -= 8
    return out


def shingle_hashes(offsets: np.ndarray, word_hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, text by text.

    A text with fewer than ``k`` words but at least one has a single shingle of all of them.
    Returns (text index, hash) of each shingle, in the order of the texts.
    """
    sizes = np.diff(offsets)
    n = len(word_hashes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if not n:
        return owner, np.zeros(0, np.uint64)
    place = np.arange(n) - offsets[:-1][owner]
    full = sizes[owner] - place >= k
    starts = np.flatnonzero(full)
    h = np.zeros(len(starts), np.uint64)
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + word_hashes[starts + j]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = sizes[short] > j
            extra[has] = extra[has] * np.uint64(0x100000001B3) + word_hashes[offsets[:-1][short][has] + j]
        h = np.concatenate([h, mix(extra) ^ np.uint64(1)])
        owners = np.concatenate([owner[starts], short])
        order = np.argsort(owners, kind="stable")
        return owners[order], mix(h)[order]
    return owner[starts], mix(h)
