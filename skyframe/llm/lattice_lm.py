"""Language-model scores: every segmentation of a text into pieces of an existing vocabulary counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod, small, split_words

START = "▁"  # the mark that a piece begins a word
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LN10 = float(np.log(10.0))


def vocabulary(model_file: str) -> tuple[list[str], np.ndarray]:
    """(pieces, initial probabilities) of a sentencepiece vocabulary, with the 256 bytes and one end among them.

    The stored scores order the pieces; a model of merges stores ranks, so they are read
    as such: a piece starts with a probability in inverse proportion to its rank.  Pieces
    with a word mark inside are left out; no token holds white space.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    scored = [(model.get_score(k), model.id_to_piece(k)) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    pieces = [p for _, p in sorted(scored, key=lambda x: (-x[0], x[1])) if p and START not in p[1:]]
    prior = 1.0 / (np.arange(len(pieces)) + 10.0)
    pieces = pieces + [f"<0x{b:02X}>" for b in range(256)] + ["</s>"]
    prior = np.concatenate([prior, np.full(257, prior.min())])
    return pieces, prior / prior.sum()


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words with the mark before each, offsets)."""
    text = START + START.join(words) if words else ""
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return flat, np.concatenate([[0], np.cumsum(sizes)])


class Lattice:
    """Log-space forward and backward recursions over all segmentations of words."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        self.n = len(pieces) - 257
        real = pieces[: self.n]
        self.longest = max(map(len, real), default=1)
        heads = [self._keys(p) for p in real]
        keys = np.array([h[-1] for h in heads], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], order
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one key")
        slots = lambda k: (k >> np.uint64(42)).astype(np.int64)
        self.goes_on = np.zeros(1 << 22, bool)  # whether some longer piece begins so
        self.goes_on[slots(np.array(sorted({k for h in heads for k in h[:-1]}), np.uint64))] = True
        # the piece of each slot; pieces that share a slot are looked up in the sorted keys
        self.slot = np.full(1 << 22, -1, np.int32)
        self.slot[slots(keys)] = np.arange(len(keys))
        taken = np.bincount(slots(keys), minlength=1 << 22)
        self.slot[np.flatnonzero(taken > 1)] = -2
        self.own = np.concatenate([keys, np.zeros(2, np.uint64)])
        self.set(probabilities)

    def set(self, probabilities: np.ndarray) -> None:
        self.log = np.log(np.maximum(probabilities, 1e-300))
        self.bytes, self.end = self.log[self.n : self.n + 256], float(self.log[-1])

    @staticmethod
    def _keys(piece: str) -> list[int]:
        """The key of each beginning of a piece, the whole of it last."""
        h, out = 0, []
        for c in map(ord, piece):
            h = ((h + c + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
            out.append(h)
        return out

    def _spelled(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each character spelled in bytes."""
        distinct, back = np.unique(codes, return_inverse=True)
        costs = np.array([self.bytes[list(chr(int(c)).encode("utf-8", "surrogatepass"))].sum() for c in distinct]) if len(distinct) else np.zeros(0)
        return costs[back]

    def arcs(self, flat: np.ndarray, rest: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: where pieces of that length begin in the flat text, and which; ``rest``: characters left in each one's word."""
        found = []
        live, h = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
        for size in range(1, self.longest + 1):
            inside = rest[live] >= size
            live, h = live[inside], h[inside]
            if not len(live):
                break
            h = (h + flat[live + size - 1] + np.uint64(1)) * MULTIPLIER
            h ^= h >> np.uint64(29)
            slot = (h >> np.uint64(42)).astype(np.int64)
            piece = self.slot[slot]
            hit = (piece >= 0) & (self.own[piece] == h)
            at, ids = live[hit], piece[hit]
            if len(shared := np.flatnonzero(piece == -2)):
                k = np.minimum(np.searchsorted(self.keys, h[shared]), len(self.keys) - 1)
                real = self.keys[k] == h[shared]
                at, ids = np.concatenate([at, live[shared[real]]]), np.concatenate([ids, self.ids[k[real]]])
            found.append((at, ids))
            on = self.goes_on[slot]
            live, h = live[on], h[on]
        return found

    def run(self, words: list[str], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(log probability of each word, expected uses of each piece if ``counts`` weighs the words)."""
        out = np.zeros(len(words))
        uses = None if counts is None else np.zeros(self.n + 257)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):  # words of about one length together, at most half a million characters
            stop = start + max(1, min(len(order) - start, 500_000 // (int(sizes[order[start]]) + 1)))
            while stop > start + 1 and (sizes[order[stop - 1]] + 1) * (stop - start) > 500_000:
                stop = start + max(1, (stop - start) // 2)
            part = order[start:stop]
            out[part] = self._block([words[i] for i in part], None if counts is None else counts[part], uses)
            start = stop
        return out, uses

    def _block(self, words: list[str], counts: np.ndarray | None, uses: np.ndarray | None) -> np.ndarray:
        flat, offsets = _characters(words)
        n, length = len(words), np.diff(offsets)
        width = int(length.max())
        owner = np.repeat(np.arange(n), length)
        place = np.arange(len(flat)) - offsets[:-1][owner]
        arcs = self.arcs(flat, length[owner] - place)
        spelled = np.full((n, width), -np.inf)
        spelled[owner, place] = self._spelled(flat)
        arc = np.full((len(arcs), n, width), -np.inf)  # by length, word and start
        for k, (at, ids) in enumerate(arcs):
            arc[k, owner[at], place[at]] = self.log[ids]
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(1, width + 1):
                ways = [alpha[j - 1] + spelled[:, j - 1]]
                ways += [alpha[j - k - 1] + arc[k, :, j - k - 1] for k in range(min(len(arcs), j))]
                alpha[j] = _logsum(np.stack(ways))
        total = alpha[length, np.arange(n)]
        if counts is not None:
            beta = np.full((width + 1, n), -np.inf)
            with np.errstate(divide="ignore", invalid="ignore"):
                for i in range(width, -1, -1):
                    ways = []
                    if i < width:
                        ways = [beta[i + 1] + spelled[:, i]]
                        ways += [beta[i + k + 1] + arc[k, :, i] for k in range(min(len(arcs), width - i))]
                        beta[i] = _logsum(np.stack(ways))
                    beta[i, length == i] = 0.0
                for k, (at, ids) in enumerate(arcs):
                    w, i = owner[at], place[at]
                    share = np.exp(alpha[i, w] + self.log[ids] + beta[i + k + 1, w] - total[w]) * counts[w]
                    uses += np.bincount(ids, share, len(uses))
                share = np.exp(alpha[place, owner] + spelled[owner, place] + beta[place + 1, owner] - total[owner]) * counts[owner]
            code, back = np.unique(flat, return_inverse=True)
            for c, s in zip(code, np.bincount(back, share, len(code)), strict=True):
                if s > 0:
                    np.add.at(uses, [self.n + b for b in chr(int(c)).encode("utf-8", "surrogatepass")], s)
        return total


def _logsum(ways: np.ndarray) -> np.ndarray:
    top = ways.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    return safe + np.log(np.exp(ways - safe).sum(0))


def train(counts: DataFrame, texts: int, model_file: str, *, rounds: int = 4) -> tuple[list[str], np.ndarray]:
    """Pieces and their probabilities, by expectation-maximisation over all distinct words of ``counts`` (token, c).

    Each task sums what its words expect of each piece, so what reaches the driver is at most the vocabulary.  Every round takes every word.
    """
    pieces, p = vocabulary(model_file)
    sc = counts.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast((pieces, p))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            uses = np.zeros(len(shared.value[0]))
            for batch in batches:
                uses += lattice.run(batch["token"].to_pylist(), np.asarray(batch["c"], dtype=np.float64))[1]
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(uses[at])], ["piece", "uses"])

        got = counts.select("token", "c").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros(len(pieces))
        uses[np.asarray(got["piece"])] = np.asarray(got["uses"])
        uses[-1] = texts
        p = uses + 0.1
        p /= p.sum()
    return pieces, p


def default_held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 7) == 2


def score_documents(docs: DataFrame, model_file: str, *, held_out: Column | None = None, hot_share: float = 5e-7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A-Z in lower case, and one end.  ``score`` is the log10 probability of the
    tokens under the piece model: pieces are drawn one after another until the end, a word begins with a marked
    piece, and a word's probability is the sum over all ways to spell it in pieces (characters may
    be spelled in bytes, so every text has one).  ``base_score`` is that of the add-one word model.  Both are learned
    from all documents that aren't held out.

    Words are counted over all training documents.  Those with a share of at least ``hot_share`` of the tokens, of which there can be no more than
    1 / hot_share, are sent to every task; the rest are joined by shuffle, which the frequent words thus never enter.
    Null and empty texts have the end alone.  Repeated rows are scored each (and count each in training); a null
    doc_id counts as training.
    """
    held = F.coalesce(default_held_out(id_col) if held_out is None else held_out, F.lit(False))
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        rows = texts = 0
        for batch in small(batches, "text"):
            _, codes, words = split_words(batch["text"])
            texts += batch.num_rows
            waiting.append(pa.table({"token": words.cast(pa.string()), "c": pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))}))
            rows += len(words)
            if rows > 1_500_000:
                yield from _summed(waiting).to_batches(50_000)
                waiting, rows = [], 0
        if waiting:
            yield from _summed(waiting).to_batches(50_000)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(["\n"]), pa.array([texts], pa.int64())], ["token", "c"])  # the end, under a name that no word has

    counts = source.where(~F.col("held")).select("text").mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))
    counts = checkpoint(counts)
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("token") == "\n", F.col("c"))), F.lit(0)).alias("texts")).first()
    n, v, texts = size["n"], size["v"], size["texts"]
    words = counts.where(F.col("token") != "\n")
    model = train(words, texts, model_file)
    sc = docs.sparkSession.sparkContext
    fitted = sc.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*fitted.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["token"], batch["c"], pa.array(lattice.run(batch["token"].to_pylist())[0] / LN10)], ["token", "c", "own"])

    # frequent words are run through the lattice once, here, and not again in every batch that has them
    hot = words.where(F.col("c") >= max(1, n * hot_share)).select("token", "c").mapInArrow(rate, "token string, c long, own double").toArrow()
    shared = sc.broadcast((hot["token"].combine_chunks(), np.asarray(hot["c"], dtype=np.float64), np.asarray(hot["own"], dtype=np.float64)))
    unseen = float(np.log10(n + (v + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*fitted.value)
        tokens, c, rated = shared.value
        known = np.log10(c + 1)
        names = ["row", "token", "tf", "own"]
        for batch in small(batches, "text"):
            offsets, codes, words = split_words(batch["text"])
            rows, sizes = batch.num_rows, np.diff(offsets)
            owner = np.repeat(np.arange(rows), sizes)
            at = np.asarray(pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=tokens.cast(pa.string())), -1), dtype=np.int64) if len(tokens) else np.full(len(words), -1)
            base, log10 = np.zeros(len(words)), np.zeros(len(words))
            met, other = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            base[met], log10[met] = known[at[met]], rated[at[met]]
            log10[other] = lattice.run(words.take(pa.array(other)).to_pylist())[0] / LN10
            own = pa.StructArray.from_arrays(
                [batch["id"], batch["held"], pa.array(sizes + 1), pa.array(np.bincount(owner, at[codes] >= 0, rows).astype(np.int64)),
                 pa.array(np.bincount(owner, base[codes], rows).astype(np.float64)), pa.array(np.bincount(owner, log10[codes], rows) + lattice.end / LN10)],
                names=["id", "held", "tokens", "known", "base", "score"],
            )
            # one row for each document, under a token that no word can be; then one for each document and rare word
            places = pa.array([f"\n{x}" for x in batch["row"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["row"], places, pa.array(np.zeros(rows, np.int64)), own], names)
            rare = at[codes] < 0
            pair, times = np.unique(owner[rare] * max(len(words), 1) + codes[rare], return_counts=True)
            text, word = pair // max(len(words), 1), pair % max(len(words), 1)
            for a in range(0, len(pair), 100_000):
                b = min(a + 100_000, len(pair))
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].take(pa.array(text[a:b])), words.cast(pa.string()).take(pa.array(word[a:b])), pa.array(times[a:b]), pa.nulls(b - a, own.type)], names
                )

    schema = f"row long, token string, tf long, own struct<id: {kind}, held: boolean, tokens: long, known: long, base: double, score: double>"
    told = source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, schema)
    rare = words.where(F.col("c") < max(1, n * hot_share)).select(F.col("token").alias("t"), "c")
    met = told.join(rare, F.col("token") == F.col("t"), "left")
    sums = met.groupBy("row").agg(
        F.max("own.id").alias("doc_id"), F.max("own.held").alias("held_out"), F.sum("own.tokens").alias("n_tokens"),
        (F.coalesce(F.sum("own.known"), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("tf"))), F.lit(0)) + F.lit(1 if texts else 0)).alias("n_known"),
        (F.sum("own.base") + F.coalesce(F.sum(F.col("tf") * F.log10(F.col("c") + 1)), F.lit(0.0))).alias("sure"), F.sum("own.score").alias("score"),
    )
    base = F.col("sure") + float(np.log10(texts + 1)) - F.col("n_tokens") * unseen
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("token").aggregate([("c", "sum")]).rename_columns(["token", "c"])
