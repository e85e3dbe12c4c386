"""Alignment of two tokenizers over a corpus: where their tokens end together, which tokens overlap, and how often each pair does."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, shared_folder, small
from .packing import _encoder

SHIFT = 32  # a pair's key: the first vocabulary's id above, the second's below


def byte_entries(vocabulary: str) -> list[bytes]:
    """The bytes of each entry of a byte-level ``tokenizers`` file, by id."""
    from tokenizers import Tokenizer

    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    back = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    entries = Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True)
    out = [b""] * (max(entries.values()) + 1)
    for entry, k in entries.items():
        out[k] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
    return out


def piece_entries(model_file: str) -> list[bytes]:
    """The bytes of each piece of a sentencepiece model, by id: word marks are spaces, byte pieces their byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [(k, model.id_to_piece(k)) for k in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in pieces]


def _width(entries: int) -> str:
    return "<u2" if entries <= 1 << 16 else "<u4"


def encode(docs: DataFrame, a_vocabulary: str, b_vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b): each text's ids by both tokenizers, as packed little-endian numbers of two bytes (four for vocabularies over 65,536).

    The first is a byte-level ``tokenizers`` file and sees the text behind one space, the second a sentencepiece model that adds the space
    itself.  Null and empty texts, and texts whose bytes either tokenizer's tokens don't give back, have no ids.  A text is never cut.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        ids, pieces = _encoder(a_vocabulary), sentencepiece.SentencePieceProcessor(model_file=b_vocabulary)
        a_bytes, b_bytes = np.array(byte_entries(a_vocabulary), object), piece_entries(b_vocabulary)
        a_kind, b_kind = _width(len(a_bytes)), _width(len(b_bytes))
        for batch in small(batches, 1):
            out: tuple[list[bytes], list[bytes]] = ([], [])
            for text in batch.column(1).to_pylist():
                found = b"", b""
                if text:
                    a, b, whole = ids(" " + text), pieces.encode(text), b" " + text.encode()
                    if b"".join(a_bytes[a].tolist()) == whole and b"".join([b_bytes[k] for k in b]) == whole:
                        found = a.astype(a_kind).tobytes(), np.array(b, b_kind).tobytes()
                for column, value in zip(out, found, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in out)], ["doc_id", "a", "b"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, a binary, b binary")


class Aligner:
    """Links and groups of two id sequences that spell the same bytes."""

    def __init__(self, a_vocabulary: str, b_vocabulary: str):
        a, b = byte_entries(a_vocabulary), piece_entries(b_vocabulary)
        self.a_kind, self.b_kind = _width(len(a)), _width(len(b))
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        # an id's decimal form with what follows it: a comma or bar in the first half of a group, a comma or semicolon in the second
        self.marked = [f"{k}{mark}" for n, marks in ((len(a), ",|"), (len(b), ",;")) for mark in marks for k in range(n)]

    def ids(self, a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(a, self.a_kind).astype(np.int64), np.frombuffer(b, self.b_kind).astype(np.int64)

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in a, place in b, whether both end there) of each pair of tokens that overlap, in order.

        Every byte where a token ends closes one pair, so there are as many pairs as places where either ends.
        """
        ends = np.zeros(int(self.a_size[a].sum()) + 1, np.uint8)
        ends[np.cumsum(self.a_size[a])] = 1
        ends[np.cumsum(self.b_size[b])] += 2
        ends = ends[np.flatnonzero(ends)]
        first, second = (ends & 1).astype(np.int64), (ends >> 1).astype(np.int64)
        return np.cumsum(first) - first, np.cumsum(second) - second, ends == 3

    def groups(self, a: np.ndarray, b: np.ndarray, links: tuple[np.ndarray, np.ndarray, np.ndarray]) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        at_a, at_b, both = links
        a_ends, b_ends = at_a[both] + 1, at_b[both] + 1
        n_a, n_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        out = np.empty(len(a) + len(b), np.int64)
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[a_ends - 1], b_last[b_ends - 1] = len(self.a_size), len(self.b_size)
        out[np.arange(len(a)) + np.repeat(b_ends - n_b, n_a)] = a + a_last
        out[np.arange(len(b)) + np.repeat(a_ends, n_b)] = b + b_last + 2 * len(self.a_size)
        return "".join([self.marked[k] for k in out.tolist()])[:-1]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def partial_counts(encoded: DataFrame, a_vocabulary: str, b_vocabulary: str, *, held: int = 4_000_000) -> DataFrame:
    """(key, n): for each pair of ids that some text holds linked, in how many texts of one partition it is.

    A task holds at most about ``held`` distinct keys; beyond, it hands out what it has and begins anew, as the counts are summed later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, loose, size = Aligner(a_vocabulary, b_vocabulary), [], 0
        keys = counts = np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
        for batch in small(batches, 0):
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if a:
                    a, b = aligner.ids(a, b)
                    at_a, at_b, _ = aligner.links(a, b)
                    loose.append(np.unique(a[at_a] << SHIFT | b[at_b]))
                    size += len(loose[-1])
                if size > 1_000_000:
                    keys, counts = summed(np.concatenate([keys, *loose]), np.concatenate([counts, np.ones(size, np.int64)]))
                    loose, size = [], 0
                    if len(keys) > held:
                        yield out()
                        keys = counts = np.zeros(0, np.int64)
        keys, counts = summed(np.concatenate([keys, *loose]), np.concatenate([counts, np.ones(size, np.int64)]))
        for start in range(0, len(keys), 1 << 18):
            yield out().slice(start, 1 << 18)

    return encoded.select("a", "b").mapInArrow(run, "key long, n long")


def _put(folder: str, values: np.ndarray) -> str:
    """Write an array to a new file in ``folder``; its place."""
    store, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
    store.create_dir(root, recursive=True)
    path = f"{root}/{uuid.uuid4().hex}"
    with store.open_output_stream(path) as f:
        f.write(memoryview(values).cast("B") if len(values) else b"")
    return path


def _mapped(folder: str, path: str, n: int) -> np.ndarray:
    """The array in a file of ``_put``, mapped and not read; of other stores than folders, from a local copy that goes with the mapping."""
    store, _ = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
    if isinstance(store, pa.fs.LocalFileSystem):
        return np.memmap(path, np.int64, "r", shape=(n,))
    with tempfile.NamedTemporaryFile() as copy:
        with store.open_input_stream(path) as f:
            while block := f.read(8 << 20):
                copy.write(block)
        copy.flush()
        return np.memmap(copy.name, np.int64, "r", shape=(n,))


@dataclass
class Shards:
    """Files of sorted pair keys and their counts in the shared folder, in order of keys, and the highest count of each id of the first vocabulary.

    What the driver holds is a line for each file and a number for each id.
    """

    folder: str
    firsts: np.ndarray  # the first key of each file
    sizes: list[int]
    keys: list[str]
    counts: list[str]
    best: np.ndarray

    def opened(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(_mapped(self.folder, k, n), _mapped(self.folder, c, n)) for k, c, n in zip(self.keys, self.counts, self.sizes, strict=True)]

    def look_up(self, opened: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> np.ndarray:
        """The counts of keys that are in order and all there."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.append(np.searchsorted(keys, self.firsts), len(keys))
        for k in np.flatnonzero(np.diff(cuts)):
            there, counts = opened[k]
            part = slice(cuts[k], cuts[k + 1])
            out[part] = counts[np.searchsorted(there, keys[part])]
        return out


def count_shards(partial: DataFrame, folder: str, entries: int) -> Shards:
    """Sum the counts of ``partial_counts``: keys are dealt in ranges and sorted, and each range sums runs of equal keys and writes one pair of files.

    A file has a new name in each attempt of its task, and only those of attempts that counted are used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:  # in order of keys, so that what is summed only grows by distinct keys
            if batch.num_rows:
                keys, n = summed(np.asarray(batch["key"]), np.asarray(batch["n"]))
                if parts and parts[-1][0][-1] == keys[0]:
                    parts[-1][1][-1] += n[0]
                    keys, n = keys[1:], n[1:]
                if len(keys):
                    parts.append((keys, n.copy()))
        if parts:
            keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids, starts = np.unique(keys >> SHIFT, return_index=True)
            columns = [int(keys[0]), len(keys), _put(folder, keys), _put(folder, counts), ids.tobytes(), np.maximum.reduceat(counts, starts).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], ["first", "size", "keys", "counts", "ids", "best"])

    dealt = partial.repartitionByRange("key").sortWithinPartitions("key")
    files = sorted(dealt.mapInArrow(run, "first long, size long, keys string, counts string, ids binary, best binary").collect(), key=lambda r: r["first"])
    best = np.zeros(entries, np.int64)
    for r in files:
        np.maximum.at(best, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["best"], np.int64))
    return Shards(folder, np.array([r["first"] for r in files], np.int64), [r["size"] for r in files], [r["keys"] for r in files], [r["counts"] for r in files], best)


def align(docs: DataFrame, a_vocabulary: str, b_vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document.

    Bytes where tokens of both end cut them into groups, written ``a1,a2|b1;a3|b2,b3``.  A link is a pair of tokens whose bytes overlap; an
    id pair's count is the number of documents that hold it linked.  ``n_best`` are the links whose count is the highest of their first id,
    ties included, and ``count_sum`` sums the counts of all links.  Texts are encoded once and written as ids; distinct pairs are counted by
    partition, sorted by ranges and summed into files, which the last pass maps and searches.

    Null and empty texts, and texts that their tokens don't spell, have zeros and no groups.  Repeated rows are documents each, and count so;
    null ids stay.  Very long texts are encoded whole.  An empty table gives an empty result, and other columns play no part.
    The written tables stay in the shared folder until the driver's Python ends, as the result reads them.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark).until_exit()
    encoded = scratch.keep(encode(docs, a_vocabulary, b_vocabulary, id_col=id_col, text_col=text_col), compression="zstd")
    partial = scratch.keep(partial_counts(encoded, a_vocabulary, b_vocabulary))
    entries = len(byte_entries(a_vocabulary))
    shards = count_shards(partial, f"{scratch.folder}/counts", entries)
    scratch.drop(partial)
    shared = spark.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, shards = Aligner(a_vocabulary, b_vocabulary), shared.value
        opened = shards.opened()
        for batch in small(batches, 1, 2 << 20):
            numbers, groups, keys, times, owner = np.zeros((6, batch.num_rows), np.int64), [], [], [], []
            for k, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not a:
                    groups.append("")
                    continue
                a, b = aligner.ids(a, b)
                links = aligner.links(a, b)
                numbers[:4, k] = len(a), len(b), links[2].sum(), len(links[0])
                pairs, n = np.unique(a[links[0]] << SHIFT | b[links[1]], return_counts=True)
                groups.append(aligner.groups(a, b, links))
                keys.append(pairs)
                times.append(n)
                owner.append(np.full(len(pairs), k))
            if keys:
                distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
                count = shards.look_up(opened, distinct)
                times, owner = np.concatenate(times), np.concatenate(owner)
                np.add.at(numbers[4], owner, times * (count == shards.best[distinct >> SHIFT])[back])
                np.add.at(numbers[5], owner, times * count[back])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, numbers), pa.array(groups, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def digests(aligned: DataFrame) -> DataFrame:
    """The same rows with the SHA-256 of the groups in their place, empty where there are none."""
    return aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
