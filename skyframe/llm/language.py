"""Language identification in two steps: the family first, then linear support vector machines between the languages of that family."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, lists, small

UNKNOWN = "und"
BITS = 13
SLICE = 1 << 20

# Families of languages by their ISO 639-1 codes; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "semitic": "am ar he mt",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "malayo-polynesian": "id jv mg mi ms tl",
}


def family_of(language: str, families: dict[str, str]) -> str:
    code = language.replace("_", "-").split("-")[0].lower()
    return next((name for name, codes in families.items() if code in codes.split()), language)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, square roots of their shares) of all runs of one to three characters in a text, or None if it has no letter.

    Letters are lower-cased and whatever stands between them is one blank, also at both ends.  The values have a norm of 1.  Long texts are
    counted in slices that overlap by two characters.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes[letter | np.concatenate([[False], letter[:-1]])]])
    if codes[-1] != 32:
        codes = np.append(codes, np.uint32(32))
    counts, shift = np.zeros(1 << bits, np.int64), np.uint32(32 - bits)
    for start in range(0, len(codes), SLICE):
        one = codes[start : start + SLICE + 2]
        h = one * np.uint32(0x9E3779B1) + np.uint32(1)
        for n in (1, 2, 3):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[n - 1 :] * np.uint32(0xC2B2AE35)
            counts += np.bincount((h[:SLICE] ^ (h[:SLICE] >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> shift, minlength=1 << bits)
    used = np.flatnonzero(counts)
    return used.astype(np.int32), np.sqrt(counts[used] / counts.sum()).astype(np.float32)


def separate(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-3, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the offset) of a linear support vector machine with squared hinge loss between y = 1 and y = -1.

    Newton steps on the rows inside the margin, each solved by conjugate gradients, until these rows stay the same.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))  # both sides weigh the same
    w, inside = np.zeros(x.shape[1]), np.ones(len(y), bool)
    for _ in range(rounds):
        rows, weight = x[inside], share[inside]
        matrix = lambda v: ridge * v + rows.T @ (weight * (rows @ v))  # noqa: B023, E731
        r = rows.T @ (weight * y[inside]) - matrix(w)
        p, rr = r.copy(), r @ r
        for _ in range(60):
            if rr < 1e-14:
                break
            q = matrix(p)
            step = rr / (p @ q)
            w += step * p
            r -= step * q
            p, rr = r + p * ((r @ r) / rr), r @ r
        now = y * (x @ w) < 1
        if not now.any() or (now == inside).all():
            break
        inside = now
    return w


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic curve from margins to probabilities, with targets drawn in by one row a side."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.stack([margin, np.ones_like(margin)], 1)
    ab = np.array([2.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2), z.T @ (target - p))
        ab += np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return max(float(ab[0]), 0.1), float(ab[1])


class Model:
    """Machines between families, and between the languages of each family: one for each pair."""

    def __init__(self, groups: dict[str, list[str]], bits: int):
        self.groups, self.bits = groups, bits
        self.contests = [sorted(groups), *(sorted(v) for v in groups.values())]  # the families, then the languages of each
        self.pairs = [(k, a, b) for k, names in enumerate(self.contests) for a, b in combinations(range(len(names)), 2)]
        self.weights = np.zeros((1 << bits, len(self.pairs)), np.float32)
        self.offset, self.curve = np.zeros(len(self.pairs)), np.tile([1.0, 0.0], (len(self.pairs), 1))

    def fit(self, x: np.ndarray, languages: np.ndarray, fitted: np.ndarray) -> Model:
        """Machines from the rows where ``fitted``, their curves from the others (from the same, where a side has no others)."""
        of = {lang: name for name, langs in self.groups.items() for lang in langs}
        family = np.array([of[lang] for lang in languages], object)
        for j, (k, a, b) in enumerate(self.pairs):
            names, values = self.contests[k], family if k == 0 else languages
            y = np.where(values == names[a], 1, np.where(values == names[b], -1, 0))
            rows = np.flatnonzero((y != 0) & fitted)
            w = separate(np.hstack([x[rows], np.ones((len(rows), 1), np.float32)]), y[rows])
            self.weights[:, j], self.offset[j] = w[:-1], w[-1]
            rest = np.flatnonzero((y != 0) & ~fitted)
            rest = rest if (y[rest] > 0).any() and (y[rest] < 0).any() else rows
            self.curve[j] = calibrate(x[rest] @ w[:-1] + w[-1], y[rest])
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability): each contest goes to the name with most duels won, ties to the greater sum of probabilities."""
        found = features(text, self.bits)
        if found is None or not self.groups:
            return UNKNOWN, 0.0
        used, values = found
        margin = values @ self.weights[used] + self.offset
        p = 1 / (1 + np.exp(-np.clip(margin * self.curve[:, 0] + self.curve[:, 1], -30, 30)))

        def winner(k: int) -> tuple[str, float]:
            names = self.contests[k]
            won, total, least = np.zeros(len(names)), np.zeros(len(names)), np.ones(len(names))
            for j, (contest, a, b) in enumerate(self.pairs):
                if contest == k:
                    for name, share in ((a, p[j]), (b, 1 - p[j])):
                        won[name] += share > 0.5
                        total[name] += share
                        least[name] = min(least[name], share)
            best = max(range(len(names)), key=lambda n: (won[n], total[n], -n))
            return names[best], float(least[best])

        family, sure = winner(0)
        language, share = winner(1 + list(self.groups).index(family))
        return language, sure * share


def train(docs: DataFrame, *, held_out: Column, families: dict[str, str] | None = None, sample_rows: int = 2400, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most about ``sample_rows`` documents outside ``held_out`` with a language and letters, an equal share of each language.

    The share is picked by the hash of the id; ids that repeat count once for each language.  Only the picked documents' features travel to the driver.
    """
    known = docs.where(~F.coalesce(held_out, F.lit(True)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    counts = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError(f"{lang_col} has over 1000 values; it is no language")
    if not counts:
        return Model({}, bits)
    cuts = {lang: min(1.0, sample_rows / len(counts) / n) for lang, n in counts.items()}
    cut = F.create_map(*(F.lit(v) for pair in cuts.items() for v in pair))[F.col("_lang")]
    picked = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < cut * (1 << 30)).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            found = [features(t, bits) for t in batch.column(1).to_pylist()]
            have = [k for k, f in enumerate(found) if f is not None]
            ends = np.concatenate([[0], np.cumsum([len(found[k][0]) for k in have])])
            flat = [np.concatenate([found[k][c] for k in have]) if have else np.zeros(0, kind) for c, kind in ((0, np.int32), (1, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(have, pa.int64())), batch.column(2).take(pa.array(have, pa.int64())), *(lists(f, ends) for f in flat)], ["turn", "lang", "buckets", "amounts"])

    got = picked.select(F.xxhash64("_id", F.lit(1)).alias("_id"), "_text", "_lang").mapInArrow(rows, "turn long, lang string, buckets array<int>, amounts array<float>").toArrow().sort_by([("turn", "ascending"), ("lang", "ascending")])
    languages = np.array(got["lang"].to_pylist(), object)
    if not len(languages):
        return Model({}, bits)
    x = np.zeros((len(languages), 1 << bits), np.float32)
    buckets, amounts = got["buckets"].combine_chunks(), got["amounts"].combine_chunks()
    x[np.repeat(np.arange(len(x)), np.asarray(buckets.value_lengths())), np.asarray(buckets.flatten())] = np.asarray(amounts.flatten())
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(languages)):
        groups.setdefault(family_of(lang, FAMILIES if families is None else families), []).append(lang)
    fitted = np.ones(len(languages), bool)
    for lang in set(languages):  # a quarter of each language shapes the curves
        fitted[np.flatnonzero(languages == lang)[3::4]] = False
    return Model(groups, bits).fit(x, languages, fitted)


def default_held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 4) == 2


def identify(docs: DataFrame, *, held_out: Column | None = None, families: dict[str, str] | None = None, sample_rows: int = 2400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    Learned from texts and languages of rows outside ``held_out`` (crc32(doc_id) mod 4 is 2), where ``sample_rows`` is the bound of what is fitted on;
    rows with a null id, language or text teach nothing.  A text is read whole, whatever its length, and alone decides: one that is null or without a
    letter is ``und`` with a score of 0, and so is every text where nothing could be learned.  ``score`` is the least probability among the duels that the family has won, times that among those of
    the language.  Repeated rows are judged each, an empty table gives an empty result, and other columns play no part.
    """
    bound_batches(docs.sparkSession)
    rule = default_held_out(id_col) if held_out is None else held_out
    model = train(docs, held_out=rule, families=families, sample_rows=sample_rows, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches, 2):
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(rule, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return asked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
