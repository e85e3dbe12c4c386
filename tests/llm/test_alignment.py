"""Alignment of two tokenizers, held against the plain definition."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from skyframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Plain words, and some more words.", "", None, "a", " ", "  two  blanks ", "über élève ñandú 漢字 😀😀", "tab\tline\n\n\nnext\r\n", "a mark ▁ inside", "<s> </s> <0x0A> <|endoftext|> <unk>",
    "naïve naïve naïve", "Plain words, and some more words.", "x" * 3000, "the cat " * 2000, "\x00 nul", "don't we'll I'd", "1234567890 3.14159", "  odd blanks　", "é combining", "ﬁ ligature Ⅷ",
]


def plainly(rows):
    """The rows of the operator by its definition: bytes, ends, overlaps and counts one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    a_bytes, b_bytes = alignment.byte_entries(A), alignment.piece_entries(B)
    held, made = Counter(), []
    for key, text in rows:
        a, b, links, groups = [], [], [], ""
        if text:
            whole = b" " + text.encode()
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            if b"".join(a_bytes[k] for k in a) != whole or b"".join(b_bytes[k] for k in b) != whole:
                a, b = [], []
        spans = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            ends = np.cumsum([len(table[k]) for k in ids]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=False)) if ids else [])
        j = 0
        for start, end, x in spans[0]:
            while spans[1][j][1] <= start:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < end:
                links.append((x, spans[1][k][2]))
                k += 1
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        last, parts = 0, []
        for c in common:
            parts.append("|".join(",".join(str(k) for s, e, k in side if last < e <= c) for side in spans))
            last = c
        groups = ";".join(parts)
        held.update(set(links))
        made.append((key, len(a), len(b), len(common), links, hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    best: dict[int, int] = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [(key, na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha) for key, na, nb, ng, links, sha in made]


def asked(spark, rows, **kinds):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = alignment.digests(alignment.align(df, A, B))
    return [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def test_every_number_by_definition(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "a"), (None, "of no id"), (None, None)]
    assert order(asked(spark, rows)) == order(plainly(rows))


def test_documents_by_definition(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()][:60]
    assert order(asked(spark, rows)) == order(plainly(rows))


def test_empty_table_and_other_columns(spark):
    assert asked(spark, []) == []
    df = spark.createDataFrame([(1, "word", 5, "x")], "doc_id long, text string, key long, a string")
    assert alignment.align(df, A, B).first().asDict() | {"groups": ""} == {"doc_id": 1, "n_a": 1, "n_b": 1, "n_groups": 1, "n_links": 1, "n_best": 1, "count_sum": 1, "groups": ""}


def test_counts_are_the_same_however_tasks_hand_them_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    encoded = alignment.encode(docs, A, B).cache()
    sums = lambda held, n: sorted(tuple(r) for r in alignment.partial_counts(encoded.repartition(n), A, B, held=held).groupBy("key").sum("n").collect())
    assert sums(10, 7) == sums(4_000_000, 1)


@pytest.mark.parametrize("folder", ["", "file:", "file://"])
def test_files_in_order_of_keys(spark, tmp_path, folder):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 50, 3000) << alignment.SHIFT | rng.integers(0, 60, 3000)
    df = spark.createDataFrame([(int(k), 1) for k in keys], "key long, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = alignment.count_shards(df, f"{folder}{tmp_path}/counts", 50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    distinct, n = np.unique(keys, return_counts=True)
    opened = shards.opened()
    assert len(opened) > 1 and all(isinstance(k, np.memmap) for k, _ in opened)
    assert (shards.look_up(opened, distinct) == n).all()
    assert (shards.look_up(opened, distinct[5:90:7]) == n[5:90:7]).all()
    assert all(shards.best[a] == n[distinct >> alignment.SHIFT == a].max() for a in range(50))
