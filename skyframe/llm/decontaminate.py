"""Benchmark decontamination by greedy string tiling with Karp-Rabin matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_strings, small, split_words

SEED_WORDS = 5
MODULUS = (1 << 61) - 1
BASE = 1_000_003


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, word hashes) of lower-case words without the punctuation around them; words of punctuation alone go."""
    offsets, codes, vocabulary = split_words(texts)
    words = [w.lower() if w.isalnum() else "".join(c for c in w.lower() if c.isalnum()) for w in vocabulary.to_pylist()]
    keep = np.fromiter((bool(w) for w in words), bool, len(words))
    hashes = hash_strings(pa.array(words, pa.large_string()))
    kept = keep[codes] if len(codes) else np.zeros(0, bool)
    return np.concatenate([[0], np.cumsum(kept)])[offsets], hashes[codes][kept] if len(codes) else np.zeros(0, np.uint64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words in one flat array (runs may cross texts; callers mask those)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + h[j : len(h) - k + 1 + j]
    out ^= out >> np.uint64(29)
    return out


def tile(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in a, start in b, length) of the tiles.

    Rounds of falling search length: a Karp-Rabin hash of every unmarked run of that length in
    ``b`` is looked up for ``a``, hits are extended as far as both sides are unmarked and
    equal, and maximal matches are marked longest first, so none overlaps another.  Words
    are compared themselves, so a hash collision can't make a match.
    """
    free_a, free_b = [True] * len(a), [True] * len(b)
    tiles: list[tuple[int, int, int]] = []

    def runs(free: list[bool], x: list[int], size: int) -> Iterator[tuple[int, int]]:
        top = pow(BASE, size - 1, MODULUS)
        begin, n = 0, len(x)
        while begin < n:
            if not free[begin]:
                begin += 1
                continue
            end = begin
            while end < n and free[end]:
                end += 1
            if end - begin >= size:
                h = 0
                for i in range(begin, begin + size):
                    h = (h * BASE + x[i]) % MODULUS
                yield begin, h
                for i in range(begin + 1, end - size + 1):
                    h = ((h - x[i - 1] * top) * BASE + x[i + size - 1]) % MODULUS
                    yield i, h
            begin = end

    size = max(least, min(len(a), len(b), 20))
    while True:
        seen: dict[int, list[int]] = defaultdict(list)
        for j, h in runs(free_b, b, size):
            seen[h].append(j)
        matches: list[tuple[int, int, int]] = []
        for i, h in runs(free_a, a, size) if seen else ():
            for j in seen.get(h, ()):
                if a[i : i + size] != b[j : j + size]:
                    continue
                if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                    continue  # inside a longer match
                k = size
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                matches.append((-k, i, j))
        if matches and -min(matches)[0] > 2 * size:
            size = -min(matches)[0]
            continue
        for k, i, j in sorted(matches):
            k = -k
            if all(free_a[i : i + k]) and all(free_b[j : j + k]):
                free_a[i : i + k] = free_b[j : j + k] = [False] * k
                tiles.append((i, j, k))
        if size > least:
            size = max(least, size // 2)
        elif not matches:  # else what a longer tile has cut may still hold runs of the least length
            return tiles


class _Index:
    """The seeds of some benchmark items: every run of ``least`` words, with item and place; and items of fewer words, whole."""

    def __init__(self, ids: pa.Array, texts: pa.Array, least: int):
        offsets, words = normal_words(texts)
        self.least, self.ids = least, ids
        self.items = [words[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for k, item in enumerate(self.items):
            if 0 < len(item) < least:
                self.short[tuple(item)].append(k)
        h = windows(words, least)
        owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
        inside = owner[: len(h)] == owner[least - 1 :] if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        order = np.argsort(h[at], kind="stable")
        at = at[order]
        self.seeds, self.first, self.count = np.unique(h[at], return_index=True, return_counts=True)
        self.item, self.place = owner[at], at - offsets[owner[at]]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.seeds & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def scan(self, texts: pa.Array, coverage: float) -> list[tuple[int, int, int, int, float]]:
        """(text, item, tiles, longest tile, coverage) of each text and item that reach ``coverage``."""
        offsets, words = normal_words(texts)
        found = []
        if self.short:
            sizes = np.diff(offsets)
            for text in np.flatnonzero((sizes > 0) & (sizes < self.least)):
                same = self.short.get(tuple(words[offsets[text] : offsets[text + 1]].tolist()), ())
                found += [(int(text), item, 1, int(sizes[text]), 1.0) for item in same]
        h = windows(words, self.least)
        if not len(h) or not len(self.seeds):
            return found
        hits = np.flatnonzero(self.sieve[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.seeds, h[hits]), len(self.seeds) - 1)
        hits, at = hits[real := self.seeds[at] == h[hits]], at[real]
        owner = np.searchsorted(offsets, hits, side="right") - 1
        hits, at, owner = hits[whole := hits + self.least <= offsets[owner + 1]], at[whole], owner[whole]
        for text in np.unique(owner):
            mine = owner == text if len(owner) < 4096 else slice(*np.searchsorted(owner, [text, text + 1]))
            spots: dict[int, tuple[set[int], list[int]]] = defaultdict(lambda: (set(), []))
            for pos, seed in zip(hits[mine].tolist(), at[mine].tolist(), strict=True):
                for k in range(self.first[seed], self.first[seed] + self.count[seed]):
                    places, positions = spots[int(self.item[k])]
                    places.add(int(self.place[k]))
                    if not positions or positions[-1] != pos:
                        positions.append(pos)
            for item, (places, positions) in spots.items():
                b = self.items[item]
                covered, last = 0, -1
                for p in sorted(places):
                    covered += p + self.least - max(p, last)
                    last = p + self.least
                if covered < coverage * len(b):
                    continue  # no tiling can reach it
                a: list[int] = []  # the runs of the text that hold seeds, with unequal marks between them
                end = -1
                for p in positions:
                    if p > end and a:
                        a.append(-len(a))
                    a.extend(words[max(p, end) : p + self.least].tolist())
                    end = p + self.least
                tiles = tile(a, b, self.least)
                share = sum(k for _, _, k in tiles) / len(b)
                if share >= coverage:
                    found.append((int(text), item, len(tiles), max(k for _, _, k in tiles), share))
        return found


def _slices(benchmark: DataFrame, item_col: str, text_col: str, bytes_at_once: int) -> list[DataFrame]:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(size) // bytes_at_once))
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _shared(docs: DataFrame, part: DataFrame, least: int):
    got = part.toArrow()
    return docs.sparkSession.sparkContext.broadcast((got["item"].combine_chunks(), got["text"].combine_chunks(), least))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, coverage: float = 0.5, least: int = SEED_WORDS, bytes_at_once: int = 32 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row (doc_id, item_id, n_tiles, longest_tile, coverage) for each document that holds a benchmark item.

    Runs of ``least`` words that a document shares with an item are its seeds; where the
    seeds could cover ``coverage`` of the item, greedy string tiling measures what does, so
    passages in another order still count in full.  Case and the punctuation around words are ignored.  The seeds
    travel to the documents, which never move: the benchmark's size is measured first, and
    one over ``bytes_at_once`` is taken in slices of that size, each in a scan of its own.

    Null and empty texts hold nothing; an item under ``least`` words is found in a document that has its words and no others; a repeated document row is
    told once for each row; equal items are told each under its own id.  Ids may be of any type; an empty table gives an empty result.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, n_tiles int, longest_tile int, coverage double"
    out = None
    for part in _slices(benchmark, item_col, item_text_col, bytes_at_once):
        shared = _shared(docs, part, least)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _Index(*shared.value)
            for batch in small(batches, 1):
                rows = index.scan(batch.column(1), coverage)
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), index.ids.take(pa.array(columns[1], pa.int64())),
                     pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.float64())],
                    ["doc_id", "item_id", "n_tiles", "longest_tile", "coverage"],
                )

        one = docs.select(id_col, text_col).mapInArrow(scan, schema)
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, coverage: float = 0.5, least: int = SEED_WORDS, bytes_at_once: int = 32 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which ``find_leaks`` finds nothing, all columns as they were, without a shuffle; with no benchmark, all of them."""
    for part in _slices(benchmark, item_col, item_text_col, bytes_at_once):
        shared = _shared(docs, part, least)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _Index(*shared.value)
            for batch in small(batches, text_col):
                clean = np.ones(batch.num_rows, bool)
                clean[[row[0] for row in index.scan(batch.column(text_col), coverage)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
