"""Personal data by weak supervision, in DataFrame functions alone.

Regular expressions propose spans; regex, checksum, gazetteer and context labelers vote on each;
expectation-maximisation estimates how reliable each labeler is from the counts of the vote patterns;
a logistic span classifier is trained on the resulting probabilities, and it alone decides the spans that no strict pattern vouches for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

KINDS = ("email", "ip", "card", "phone")
# The strict patterns, written so that they neither backtrack nor recurse on long runs; they match what these do:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+        ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+, of which those of 13 to 19 digits  phone \+[0-9][\x20().0-9-]+[0-9]
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Looser shapes: addresses spelled out, addresses of eight groups, numbers without a country code.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?(?:\[at\]|\(at\)) ?[a-z0-9-]{1,63}+(?:\.[a-z0-9-]{1,63}+| ?(?:\[dot\]|\(dot\)) ?[a-z0-9-]{1,63}+){1,8}| at [a-z0-9-]{1,63}+ dot [a-z]{2,10}(?![a-z0-9]))",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(.-])(?<![0-9+] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])(?![ .-][0-9])",
}
# Gazetteers of the labelers.
ENDINGS = "com org net edu gov mil int info io dev app co uk de fr es it nl be ch at eu us ca au jp cn in br mx ru pl se no dk fi pt ie nz za".split()
COUNTRY = r"^\+?(?:1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9])"
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[0-8]|6)"
CONTEXT = {
    "email": "mail|contact|write|kontakt|schreib|contacte|correo|courriel|adresse|address|reach",
    "ip": "ip|server|host|address|adresse|login|client|from|dirección|connection",
    "card": "card|visa|master|amex|credit|debit|karte|kredit|carte|tarjeta|payment|zahlung|pago",
    "phone": "phone|tel|call|mobile|cell|fax|ruf|nummer|numéro|teléfono|llame|appel|handy|whatsapp|contact",
}
AGAINST = {
    "email": "example of|such as|image|retina",
    "ip": "version|release|build|section|chapter|v\\.? ?$|kapitel",
    "card": "isbn|issn|order|invoice|tracking|serial|barcode|ean|id[:=# ]|token|hash|timestamp|number of",
    "phone": "isbn|issn|order|invoice|version|serial|part no|zip|score|id[:=# ]",
}
LABELERS = ("strict", "check", "gazetteer", "context", "against")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often lambdas in the body read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found, before, after), in code points: the pattern's leftmost non-overlapping matches.

    ``split`` and ``regexp_extract_all`` walk the same matches, so the pieces between them give the
    places; running sums are taken in steps of 128, so very many matches stay cheap.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("s"))

    def with_steps(t: Column) -> Column:
        steps = F.zip_with(F.slice(t.s, F.lit(1), F.size(t.m)), t.m, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        return F.struct(t.m.alias("m"), t.s.alias("s"), steps.alias("step"))

    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def with_sums(t: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(t.m) / 128).cast("int")), lambda c: total(F.slice(t.step, F.lit(1), c * 128)))
        return F.struct(t.m.alias("m"), t.s.alias("s"), t.step.alias("step"), sums.alias("sums"))

    def placed(t: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            block = F.floor(k / 128).cast("int")
            start = F.get(t.sums, block) + total(F.slice(t.step, block * 128 + 1, k % 128)) + F.length(F.get(t.s, k)).cast("long")
            return F.struct(
                start.alias("start"), (start + F.length(x)).alias("end"), x.alias("found"),
                F.lower(F.right(F.get(t.s, k), F.lit(40))).alias("before"), F.lower(F.left(F.get(t.s, k + 1), F.lit(8))).alias("after"),
            )

        return F.transform(t.m, one)

    return _let(found, lambda t: _let(with_steps(t), lambda u: _let(with_sums(u), placed)))


def _none() -> Column:
    return F.array().cast("array<struct<start: bigint, end: bigint, found: string, before: string, after: string>>")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, 2 * d).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 2) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255"))
        return F.forall(F.split(found, r"\."), small)
    if kind == "card":
        return luhn(_digits(found))
    return F.length(_digits(found)).between(9, 15)


def _gazetteer(kind: str, found: Column) -> Column:
    """Whether the kind's list of known endings, ranges, issuers or country codes has it."""
    if kind == "email":
        return F.regexp_extract(F.lower(found), r"([a-z]+)$", 1).isin(ENDINGS)
    if kind == "ip":
        return ~found.rlike(r"^(?:0+\.|0*(?:22[4-9]|2[3-9][0-9])\.)")
    if kind == "card":
        return _digits(found).rlike(ISSUER)
    return F.when(found.startswith("+"), found.rlike(COUNTRY)).otherwise(found.rlike(r"^\(?[2-9][0-9]{2}"))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1, or 0 where the labeler abstains."""
    return F.when(yes, 1).when(no if no is not None else ~yes, -1).otherwise(0).cast("int")


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, base, votes): all proposed spans of a text."""
    dots, at = text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), text.contains("@")
    chain = text.rlike(r"[0-9](?:[ -]?[0-9]){12}")
    spelled = text.contains("at]") | text.contains("at)") | text.contains("AT]") | text.contains("AT)") | (text.contains(" at ") & text.contains(" dot "))
    groups = text.contains(":") & text.rlike(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]")
    local = text.rlike(r"[0-9]{3}[) .-] ?[0-9]{3}[ .-][0-9]{4}")
    guards = {("email", 1): at, ("ip", 1): dots, ("card", 1): chain, ("phone", 1): text.contains("+"), ("email", 0): spelled, ("ip", 0): groups, ("phone", 0): local}

    def proposed(kind: str, strict: bool) -> Column:
        spans = F.when(guards[kind, int(strict)], matches(text, (STRICT if strict else LOOSE)[kind])).otherwise(_none())

        def judged(x: Column) -> Column:
            good = _valid(kind, x.found) if strict else F.lit(False)
            check = _vote(good) if strict else _vote(F.length(_digits(x.found)).between(9, 15) if kind == "phone" else F.lit(True))
            votes = F.array(
                _vote(good, F.lit(False) if kind != "card" else None),
                check,
                _vote(_gazetteer(kind, x.found)),
                # a number without a word that says what it is speaks against itself; an address says so itself
                _vote(x.before.rlike(CONTEXT[kind]), F.lit(False) if kind == "email" else None),
                F.when(x.before.rlike(AGAINST[kind]), -1).otherwise(0).cast("int"),
            )
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x.start.alias("start"), x.end.alias("end"), good.alias("base"), votes.alias("votes"))

        return F.transform(spans, judged)

    return F.concat(*[proposed(k, True) for k in KINDS], *[proposed(k, False) for k in LOOSE])


class Labels:
    """What expectation-maximisation and the span classifier have learned."""

    def __init__(self, weights: dict[int, list[float]], reliabilities: dict[int, dict]):
        self.weights, self.reliabilities = weights, reliabilities


def learn(patterns: list[tuple[int, tuple[int, ...], bool, int]], rounds: int = 30) -> Labels:
    """From (kind, votes, base, times) of every vote pattern: at most four kinds times three to the number of labelers.

    Dawid and Skene's model: given whether a span is personal data, labelers vote independently, each
    with its own probabilities of yes, no and abstaining.  Base spans are known to be right and need no model; they look unlike the others (whose
    shapes are looser), so reliabilities are those of the others alone.  The classifier is a logistic regression of the posterior on the votes,
    weighted by how often a pattern occurs; where there is little to learn from, a vote counts one and a span needs more for than against.
    """
    weights: dict[int, list[float]] = {}
    tables: dict[int, dict] = {}
    n = len(LABELERS)
    start = [1.0] * n + [-1.0]
    # pseudo-counts say what the labelers are for: a vote of yes is likelier on personal data, and so on.  They grow with half the spans,
    # so that very many spans of one look can't turn a labeler's meaning round
    smooth = {1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.1, 0: 0.3, -1: 0.6}}
    for kind in range(len(KINDS)):
        rows = [(v, t) for k, v, base, t in patterns if k == kind and not base]
        good = [min(0.9, max(0.1, 0.3 + 0.2 * sum(v))) for v, _ in rows]
        table: dict = {}
        trust = 50 + 0.5 * sum(t for _, t in rows)
        for _ in range(rounds if rows else 1):
            mass = {c: sum((g if c else 1 - g) * t for g, (_, t) in zip(good, rows, strict=True)) for c in (0, 1)}
            prior = (mass[1] + 0.25 * trust) / (mass[0] + mass[1] + trust)
            for c in (0, 1):
                for j in range(n):
                    for vote in (-1, 0, 1):
                        seen = sum((g if c else 1 - g) * t for g, (v, t) in zip(good, rows, strict=True) if v[j] == vote)
                        table[c, j, vote] = (seen + trust * smooth[c][vote]) / (mass[c] + trust)
            for i, (v, _) in enumerate(rows):
                odds = math.log(prior / (1 - prior)) + sum(math.log(table[1, j, v[j]] / table[0, j, v[j]]) for j in range(n))
                good[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        tables[kind] = dict(table)
        w = list(start)
        total = sum(math.log1p(t) for _, t in rows) or 1.0
        for _ in range(400 if rows else 0):
            grad = [0.05 * (a - b) for a, b in zip(w, start, strict=True)]
            for (v, t), g in zip(rows, good, strict=True):
                z = sum(a * b for a, b in zip(w, v, strict=False)) + w[-1]
                e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - g) * math.log1p(t) / total
                for j in range(n):
                    grad[j] += e * v[j]
                grad[-1] += e
            w = [a - 0.5 * b for a, b in zip(w, grad, strict=True)]
        weights[kind] = w
    return Labels(weights, tables)


def vote_patterns(spans: DataFrame) -> list[tuple[int, tuple[int, ...], bool, int]]:
    """Counts of all vote patterns over all rows of a column ``spans``."""
    each = spans.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.votes", "x.base").agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["kind"], tuple(r["votes"]), r["base"], r["n"]) for r in each.collect())


def accepted(spans: Column, labels: Labels) -> Column:
    """The base spans, and the others that the classifier takes and that overlap none before them; in order of kind and start."""

    def taken(x: Column) -> Column:
        score = F.lit(None)
        for kind, w in labels.weights.items():
            z = F.lit(float(w[-1]))
            for j in range(len(LABELERS)):
                z = z + F.get(x.votes, F.lit(j)) * float(w[j])
            score = F.when(x.kind == kind, z).otherwise(score)
        return score >= 0

    meets = lambda x, y: (x.start < y.end) & (y.start < x.end)

    def decide(all_: Column) -> Column:
        base = F.filter(all_, lambda x: x.base)
        more = F.filter(all_, lambda x: ~x.base & taken(x))

        def add(kept: Column, x: Column) -> Column:
            return F.when(F.exists(kept, lambda y: meets(x, y)), kept).otherwise(F.concat(kept, F.array(x)))

        out = F.when(F.size(more) == 0, base).otherwise(F.aggregate(more, base, add))
        return F.array_sort(F.transform(out, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))))

    return _let(spans, decide)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the strict spans, of which each kind has its leftmost non-overlapping matches that pass
    its check; ``spans`` adds those the span classifier takes.  Offsets are code points,
    ends exclusive.  Null and empty texts have no spans.  Rows are read where they lie; only vote counts are summed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = checkpoint(docs.select(F.col(id_col).alias("doc_id"), candidates(text).alias("spans")))
    labels = learn(vote_patterns(found))
    base = F.array_sort(F.transform(F.filter("spans", lambda x: x.base), lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))))
    rows = found.select("doc_id", base.alias("base"), accepted(F.col("spans"), labels).alias("all"))
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every span in the text replaced by its kind in brackets, and the length brought up to date.

    Null texts stay null, empty ones empty; repeated rows are rewritten each; an empty table gives an empty one.
    """
    text = F.col(text_col)
    labels = learn(vote_patterns(docs.select(candidates(F.coalesce(text, F.lit(""))).alias("spans"))))
    cover = F.transform(accepted(candidates(text), labels), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rewritten(spans: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            fresh = x.start >= state.at
            between = F.substring(text, (state.at + 1).cast("int"), (x.start - state.at).cast("int"))
            out = F.when(fresh, F.concat(state.out, F.array(between, F.get(names, x.kind)))).otherwise(state.out)
            return F.struct(F.greatest(state.at, x.end).alias("at"), out.alias("out"))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
        end = F.aggregate(F.array_sort(spans), start, step, lambda s: F.concat(s.out, F.array(F.substring(text, (s.at + 1).cast("int"), F.length(text)))))
        return F.array_join(end, "")

    new = F.when(text.isNull(), text).otherwise(_let(cover, lambda spans: F.when(F.size(spans) == 0, text).otherwise(rewritten(spans))))
    out = docs.withColumn(text_col, new)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col and length_col in docs.columns else out
