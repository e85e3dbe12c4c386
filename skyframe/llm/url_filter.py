"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

# Fixed values: (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# One strict term rejects a url.
STRICT = (
    "adult", "bdsm", "camgirl", "casino", "erotic", "escort", "fetish", "hentai", "malware", "milf", "nude", "phishing",
    "poker", "porn", "porno", "sex", "spam", "viagra", "cialis", "warez", "webcam", "xxx",
)
# Several distinct soft terms reject a url.
SOFT = (
    "ad", "ads", "bet", "bets", "betting", "bonus", "cam", "cheap", "click", "coupon", "crack", "deal", "deals", "discount",
    "download", "farm", "free", "gamble", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "meds", "pharma",
    "pharmacy", "pill", "pills", "popup", "promo", "serial", "slots", "torrent", "track", "tracker", "win", "winner",
)


def _hits(strict: Sequence[str], soft: Sequence[str]):
    finder = ahocorasick.Automaton()
    for term, kind in [*((t.lower(), 1) for t in soft), *((t.lower(), 2) for t in strict)]:
        if term:
            finder.add_word(term, (term, kind))
    if len(finder):
        finder.make_automaton()
    word = re.compile(r"[0-9a-z]").match

    def count(url: str) -> tuple[int, int]:
        """Distinct strict and soft terms that stand between boundaries, anywhere in the url."""
        found: dict[int, set[str]] = {1: set(), 2: set()}
        for last, (term, kind) in finder.iter(url) if len(finder) else ():
            first = last - len(term) + 1
            if not (first and word(url[first - 1])) and not (last + 1 < len(url) and word(url[last + 1])):
                found[kind].add(term)
        return len(found[2]), len(found[1])

    return count


def judge_urls(
    pages: DataFrame, *, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT, soft_needed: int = 2,
) -> DataFrame:
    """Add host, path, rule, strict_hits, soft_hits and verdict to every row.

    The longest rule that fits decides; without one, a url is blocked if it holds one strict
    term or ``soft_needed`` distinct soft ones (short terms count only between boundaries:
    the neighbours are not ASCII letters or digits).  A null url, or one without ``://``,
    has an empty host and path, fits no rule, and is judged by its terms alone (null: allow).
    Columns of the input with one of these names are replaced.  No shuffle; rules and terms
    are parameters, not data, and travel with the tasks.  An empty table gives an empty one; repeated rows are judged each.
    """
    url = F.col(url_col)
    inside = F.coalesce(url.contains("://"), F.lit(False))
    part = lambda g: F.when(inside, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", g)).otherwise("")
    df = pages.withColumns({"host": ascii_lower(part(1)), "path": part(2)})

    def fits(host: str, path: str) -> Column:
        h = F.col("host")
        return ((h == host) | h.endswith(f".{host}")) & F.col("path").startswith(path)

    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    none = F.lit(None).cast("string")
    rule = F.coalesce(*[F.when(fits(h, p), F.lit(h + p)) for _, h, p in ordered], none)
    by_rule = F.coalesce(*[F.when(fits(h, p), F.lit(v)) for v, h, p in ordered], none)

    @F.pandas_udf("struct<strict: int, soft: int>")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = _hits(strict, soft)
        for urls in batches:
            yield pd.DataFrame([count(u) if u else (0, 0) for u in urls], columns=["strict", "soft"])

    met = fresh(df, "terms")
    df = df.withColumn(met, terms(ascii_lower(F.coalesce(url, F.lit("")))))
    hits = F.col(met)
    bad = (hits.strict > 0) | (hits.soft >= soft_needed)
    return df.withColumns({
        "rule": rule, "strict_hits": hits.strict, "soft_hits": hits.soft,
        "verdict": F.coalesce(by_rule, F.when(bad, "block").otherwise("allow")),
    }).drop(met)
