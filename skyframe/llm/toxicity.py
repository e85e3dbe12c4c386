"""Toxicity: a mined lexicon, Levenshtein automata over its trie, and context windows that tell quotation from abuse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small, split_words
from .sample import labelled_sample

# Words that report speech, words that address someone, and marks that open and close a quotation.
REPORTS = frozenset(
    "said says say saying called calls quoted quote quotes wrote writes term terms word words phrase reported reports mentioned alleged titled "
    "sagte sagt nannte zitat zitierte schrieb wort begriff dit disait appelle citation mot terme cita dijo dice palabra escribió".split()
)
ADDRESS = frozenset("you your you're youre u ur yourself du dich dir dein ihr euch tu toi ton te vous votre usted ustedes tú eres".split())
# For each mark that opens a quotation, the marks that close it.
QUOTATIONS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", "'": "'’"}
_CORE = re.compile(r"^[\W_]+|[\W_]+$")


class Automaton:
    """A trie of terms, searched with the Levenshtein automaton of a word.

    The automaton's states are kept as bits: for each number of errors, the prefixes of the word that
    the path taken in the trie spells with at most so many.  It is stepped along each trie edge, and a subtree in which no state is
    left is not entered.  A term that ends in ``*`` is a stem; it matches every word that begins with it, without edits.
    """

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for k, term in enumerate(terms):
            node = self.root
            for c in term.removesuffix("*"):
                node = node.setdefault(c, {})
            node["*" if term[-1] == "*" else ""] = k
        self.terms = terms
        self.allow = [allowed(len(t)) for t in terms]
        terms = [t for t in terms if t[-1] != "*"]
        # A word within d edits of a term holds one of the term's d + 1 parts, at most d places off.
        self.parts: dict[int, dict[int, set[str]]] = {1: {}, 2: {}}
        for term in terms:
            d = allowed(len(term))
            cuts = [round(len(term) * j / (d + 1)) for j in range(d + 2)] if d else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=False):
                for e in range(-d, d + 1):
                    if a + e >= 0:
                        self.parts[d].setdefault(a + e << 8 | b - a, set()).add(term[a:b])
        # for each length of a word: the most errors of terms about as long, and the parts to look for, by place
        self.limits: dict[int, int] = {}
        for t in terms:
            d = allowed(len(t))
            for n in range(len(t) - d, len(t) + d + 1):
                self.limits[n] = max(self.limits.get(n, 0), d)
        self.checks = [(key >> 8, (key >> 8) + (key & 255), parts) for by in self.parts.values() for key, parts in by.items()]

    def near(self, word: str) -> tuple[int, int] | None:
        """(term, distance) of the nearest term within its own allowance, or None."""
        node, stem = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            stem = node.get("*", stem)
        if node is not None and "" in node:
            return node[""], 0
        if stem is not None:
            return stem, 0
        limit = self.limits.get(len(word), 0)
        if not limit:
            return None
        for a, b, parts in self.checks:
            if word[a:b] in parts:
                break
        else:
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end, full = 1 << len(word), (2 << len(word)) - 1
        best: tuple[int, int] | None = None
        stack = [(self.root, 1, 3 & full, (7 if limit > 1 else 0) & full)]
        while stack:
            node, r0, r1, r2 = stack.pop()
            k = node.get("")
            if k is not None:
                off = 0 if r0 & end else 1 if r1 & end else 2 if r2 & end else 3
                if off <= self.allow[k] and (best is None or (off, k) < best):
                    best = (off, k)
            for c, child in node.items():
                if c == "" or c == "*":
                    continue
                m = masks.get(c, 0)
                n0 = (r0 & m) << 1
                n1 = ((r1 & m) << 1 | r0 | r0 << 1 | n0 << 1) & full
                n2 = ((r2 & m) << 1 | r1 | r1 << 1 | n1 << 1) & full if limit > 1 else 0
                if n2 or n1:
                    stack.append((child, n0, n1, n2))
        return best and (best[1], best[0])


def allowed(length: int) -> int:
    """Edits that a term of this length may be off."""
    return 0 if length < 5 else 1 if length < 8 else 2


def core(word: str) -> str:
    """A word in lower case, letters beyond ASCII too, without the marks around it."""
    word = word.lower()
    return word if word.isalnum() else _CORE.sub("", word)


FEATURES = ("unquoted", "fuzzy", "quoted", "any", "distinct", "density", "addressed", "mean_weight")


class Scorer:
    """The features of a batch of texts; hits inside quotations count in a feature of their own only.

    Made for a lexicon of weighted terms and a set of plain words that only look like one."""

    def __init__(self, terms: list[str], weights: list[float], plain: list[str], window: int):
        self.find = Automaton(terms)
        self.weights, self.plain, self.window = weights, frozenset(plain), window
        self.known: dict[str, tuple[int, int] | None] = {}  # verdicts of words met before, so that a task judges a frequent word once

    def hits(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        term, distance = np.full(len(vocabulary), -1), np.zeros(len(vocabulary), np.int64)
        near, plain = self.find.near, self.plain
        if len(self.known) > 200_000:
            self.known.clear()
        for k, word in enumerate(vocabulary):
            got = self.known.get(word, self)
            if got is self:
                whole, word = word, core(word)
                got = near(word) if word else None
                if got is None and not word.isalnum() and len(word) > 4:
                    got = near("".join(c for c in word if c.isalnum()))
                if got is not None and word in plain and (got[1] or self.find.terms[got[0]][-1] == "*"):
                    got = None
                self.known[whole] = got
            if got is not None:
                term[k], distance[k] = got
        return term, distance

    @staticmethod
    def quoted(words: list[str]) -> np.ndarray:
        """For each word of a whole text, whether it stands between a mark that opens a quotation and the next one that closes it.

        Marks count at the borders of words only, and none without its partner: an apostrophe that opens nothing or is never closed is no quotation.
        """
        steps, waiting = np.zeros(len(words) + 1, np.int64), {}
        for i, word in enumerate(words):
            if word.isalnum():
                continue
            word = word.strip(".,;:!?()[]")
            if not word:
                continue
            alone = len(word) == 1
            if word[0] in QUOTATIONS and not (alone and any(word in QUOTATIONS[m] for m in waiting)):
                waiting[word[0]] = i
                if alone:
                    continue
            for mark in [m for m in waiting if word[-1] in QUOTATIONS[m]]:
                steps[waiting.pop(mark)] += 1
                steps[i + 1] -= 1
        return np.cumsum(steps[:-1]) > 0

    @staticmethod
    def reported(words: list[str], at: int) -> bool:
        """Whether a word that reports speech stands just before."""
        return any(core(x) in REPORTS for x in words[max(0, at - 3) : at])

    def features(self, texts: pa.Array) -> np.ndarray:
        offsets, codes, vocabulary = split_words(texts)
        names = vocabulary.to_pylist()
        term, distance = self.hits(names)
        x = np.zeros((len(offsets) - 1, len(FEATURES)))
        places = np.flatnonzero(term[codes] >= 0) if len(codes) else np.zeros(0, np.int64)
        owner = np.searchsorted(offsets, places, side="right") - 1
        for text in np.unique(owner):
            a, b = offsets[text], offsets[text + 1]
            words = [names[c] for c in codes[a:b]]
            seen: set[int] = set()
            heavy = unquoted = fuzzy = quoted = addressed = 0.0
            inside = self.quoted(words)
            for p in places[np.searchsorted(owner, text) : np.searchsorted(owner, text, side="right")] - a:
                code = codes[a + p]
                if inside[p] or self.reported(words, int(p)):
                    quoted += 1
                    continue
                near = words[max(0, p - self.window) : p + self.window + 1]
                seen.add(int(term[code]))
                heavy += self.weights[term[code]]
                fuzzy += distance[code] > 0
                unquoted += distance[code] == 0
                addressed += any(core(w) in ADDRESS for w in near)
            n = max(unquoted + fuzzy, 1)
            x[text] = (np.log1p(unquoted), np.log1p(fuzzy), np.log1p(quoted), len(seen) > 0, np.log1p(len(seen)), np.log1p(100 * (unquoted + fuzzy) / (b - a)), addressed / n, heavy / n)
        return x


def mine(sample: DataFrame, *, least_odds: float = 8.0) -> tuple[list[str], list[float], list[str]]:
    """(terms, weights, plain words) from labelled texts.

    A word's support is the number of distinct pairs of neighbours it has in toxic and in
    other texts, so copies of one text count once.  It is a term if its odds are ``least_odds`` times the
    average and so far over it that, by Chernoff's bound, chance would hardly bring that about in any word.  Plain words are those near a term, or with
    a stem, that other texts use.  All of both are kept; they are words of the sample, whose rows are bounded.  Stems of four to six letters that
    begin four terms or more, and whose words are as toxic taken together, stand for all words that begin so.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            offsets, codes, vocabulary = split_words(batch["text"])
            if not len(codes):
                continue
            names = pa.array([core(w) for w in vocabulary.to_pylist()], pa.string())
            edge = np.full(1, -1)
            before, after = np.concatenate([edge, codes[:-1]]), np.concatenate([codes[1:], edge])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            before[offsets[:-1][np.diff(offsets) > 0]] = -1
            after[offsets[1:][np.diff(offsets) > 0] - 1] = -1
            words = pa.concat_arrays([names, pa.array([""], pa.string())])
            pick = lambda c: words.take(pa.array(np.where(c < 0, len(words) - 1, c)))
            toxic = np.asarray(batch["label"]) > 0
            yield pa.RecordBatch.from_arrays([pick(codes), pick(before), pick(after), pa.array(toxic[owner].astype(np.int64))], ["word", "before", "after", "toxic"])

    seen = sample.mapInArrow(contexts, "word string, before string, after string, toxic long").where("length(word) > 1")
    seen = seen.groupBy("word", F.xxhash64("before", "after").alias("context")).agg(F.max("toxic").alias("toxic"))
    words = seen.groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).cache()
    total = words.agg(F.sum("a").alias("a"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    if not total["a"]:
        words.unpersist()
        return [], [], []
    q = min(0.999, max(total["a"] / total["n"], 1e-9))
    p = F.col("a") / F.col("n")
    sure = F.col("n") * (p * F.log(p / q) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0))
    odds = (F.col("a") + 0.5) / (F.col("n") - F.col("a") + 0.5) / (q / (1 - q))
    needed = float(np.log(max(total["v"], 2)) + 1)
    own = (F.col("a") >= 5) & (odds >= least_odds) & (sure >= needed)
    terms = words.where(own).withColumn("sure", sure)
    found = terms.orderBy(F.desc("sure"), "word").collect()
    ends = F.explode(F.transform(F.sequence(F.lit(4), F.lit(6)), lambda k: F.substring("word", F.lit(1), k)))
    begins = words.where("length(word) >= 4").select("a", "n", own.cast("int").alias("own"), ends.alias("word"))
    begins = begins.groupBy("word").agg(F.sum("a").alias("a"), F.sum("n").alias("n"), F.sum("own").alias("own"))
    begins = begins.where((F.col("own") >= 4) & (odds >= least_odds)).withColumn("sure", sure)
    stems: list = []
    for r in begins.orderBy(F.desc("own"), F.desc(F.length("word")), "word").collect():
        if not any(r["word"].startswith(x["word"]) or x["word"].startswith(r["word"]) for x in stems):
            stems.append(r)
    heads = tuple(r["word"] for r in stems)
    found = [r for r in found if not r["word"].startswith(heads)] if heads else found
    names = [r["word"] for r in found] + [f"{r['word']}*" for r in stems]
    find = Automaton(names)

    def lookalikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [bool((near := find.near(w)) and (near[1] or names[near[0]][-1] == "*")) for w in batch["word"].to_pylist()]
            yield batch.filter(pa.array(alike, pa.bool_()))

    alike = words.where((F.col("n") - F.col("a") >= 1) & (odds < least_odds)).select("word", "n").mapInArrow(lookalikes, "word string, n long")
    plain = [r["word"] for r in alike.orderBy(F.desc("n"), "word").collect()]
    words.unpersist()
    weights = [float(np.log((r["a"] + 0.5) / (r["n"] - r["a"] + 0.5)) - np.log(q / (1 - q))) for r in [*found, *stems]]
    return names, weights, plain


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(h, x1.T @ (weight * (p - y)) + penalty * w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: list[str], weights: list[float], plain: list[str], window: int, coefficients: np.ndarray):
        self.parts, self.coefficients = (terms, weights, plain, window), coefficients

    def scorer(self):
        made = Scorer(*self.parts)
        w = self.coefficients
        return lambda texts: 1 / (1 + np.exp(-np.clip(made.features(texts) @ w[:-1] + w[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, *, held_out: Column, sample_rows: int = 12_000, window: int = 6, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``sample_rows`` labelled documents outside ``held_out``; rows are weighted back to the labels' true shares.

    Null labels and ids teach nothing, and null texts count as texts without words; without any labelled row every score is 0.5,
    and with labels of one kind only no term is mined.
    """
    train_rows = ~F.coalesce(held_out, F.lit(False))
    sample = labelled_sample(docs, labels, label_col, rows=sample_rows, train=train_rows, id_col=id_col, text_col=text_col)
    terms, weights, plain = mine(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, weights, plain, window)
        for batch in small(batches, "text"):
            x = scorer.features(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["label"], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["label", "x"])

    got = sample.mapInArrow(rows, "label long, x array<double>").toArrow()
    y = (np.asarray(got["label"]) > 0).astype(float)
    shares = {r["y"]: r["n"] for r in labels.where(train_rows & F.col(label_col).isNotNull()).groupBy((F.col(label_col) > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not len(y):
        return Model([], [], [], window, np.zeros(len(FEATURES) + 1))
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(len(y), -1)
    true = np.where(y > 0, shares.get(1, 1), shares.get(0, 1)) / sum(shares.values())
    drawn = np.where(y > 0, max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9))
    return Model(terms, weights, plain, window, fit_logistic(x, y, true / drawn))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """Add each row's probability of being toxic, read from its whole text; a null or empty text gets that of a text without hits.

    Repeated rows are scored each, an empty table gives an empty one, and an input column with the result's name is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in small(batches, text_col):
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(scorer(batch[text_col]))], [*kept, name])

    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add(name, "double"))


def default_held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 5) == 0


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels are learned from rows that aren't held out."""
    held_out = default_held_out(id_col)
    model = train(docs, labels, held_out=held_out, id_col=id_col, text_col=text_col)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), model, text_col="_text")
    return scored.select("doc_id", F.coalesce(default_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` under ``threshold``, all columns as they were, without a shuffle.

    Null and empty texts score as texts without hits, repeated rows are judged each, and an empty table gives an empty one.
    With no labelled rows nothing is known to be toxic, and all rows stay.
    """
    model = train(docs, labels, held_out=default_held_out(id_col), id_col=id_col, text_col=text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in small(batches, text_col):
            yield batch.filter(pa.array(scorer(batch[text_col]) < threshold)) if model.parts[0] else batch

    return docs.mapInArrow(keep, docs.schema)
