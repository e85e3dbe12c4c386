"""The operators' queries against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from skyframe.llm import common, decontaminate, html_text, lattice_lm, near_dedup, packing, pii, quality, toxicity, vector_dedup
from skyframe.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def run(spark, data, prefix):
    name = next(n for n in QUERIES if n.startswith(prefix + "_"))
    return QUERIES[name](spark, data)


# ------------------------------------------------------------------ near duplicates


def shingles(text, k=5):
    w = text.lower().split()
    found = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (Counter([tuple(w)]) if w else Counter())
    return {s: 1 + math.log(times) for s, times in found.items()}


def jaccard(a, b):
    """The probability Jaccard similarity as it is defined, quotient by quotient."""
    if a.keys() == b.keys() and all(a[e] == b[e] for e in a):
        return 1.0
    both = a.keys() | b.keys()
    x, y = (np.array([s.get(e, 0) for e in both]) for s in (a, b))
    return sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in np.flatnonzero((x > 0) & (y > 0)))


def classes(sets, threshold=0.8):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a].keys() & sets[b].keys()) > 0 and jaccard(sets[a], sets[b]) >= threshold - 1e-9:
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates_of_documents(spark, data, texts):
    got = {r.doc_id: (r.class_id, r.kept) for r in run(spark, data, "op2").collect()}
    want = classes({i: shingles(t) for i, t in texts.items()})
    assert got == {i: (c, c == i) for i, c in want.items()}


def test_near_duplicates_in_one_large_group(spark):
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(260):  # a group whose pairs lie on both sides of the threshold, in which no one document links all
        w = list(base)
        for p in rng.choice(150, rng.integers(0, 9), replace=False):
            w[p] = f"x{i}_{p}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(60)])) for i in range(80)]  # share a passage only
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, block_rows=64).collect()}
    assert got == classes({i: shingles(t) for i, t in docs})


def test_near_duplicates_with_unequal_repetition(spark):
    docs, often = [], {}
    for i in range(100):  # a passage stands several times in one copy and once or twice in the other; how often decides
        base, passage = [f"b{i}_{j}" for j in range(85)], [f"p{i}_{j}" for j in range(10)]
        often[i] = 2 + 2 * (i % 50)
        docs += [(2 * i, " ".join([f"x{i}", *base, *passage * often[i]])), (2 * i + 1, " ".join([f"u{i}", *base, *passage * 2]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == classes({i: shingles(t) for i, t in docs})
    linked = [often[i] for i in range(100) if got[2 * i + 1] == 2 * i]
    apart = [often[i] for i in range(100) if got[2 * i + 1] != 2 * i]
    assert linked and apart and max(linked) < min(apart)


def test_probability_jaccard_is_exact_and_bounded_by_sizes():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ({int(e): 1 + math.log(int(t)) for e, t in zip(rng.choice(14, n, replace=False), rng.integers(1, 4, n), strict=True)} for n in rng.integers(1, 13, 2))
        (ha, x), (hb, y) = ((np.array(sorted(s), np.uint64), np.array([s[e] for e in sorted(s)])) for s in (a, b))
        got = near_dedup.probability_jaccard(ha, x, hb, y)
        assert got == pytest.approx(jaccard(a, b) if a.keys() & b.keys() else 0.0, abs=1e-12)
        assert got <= min(len(a) / (y.sum() / y.max()), len(b) / (x.sum() / x.max())) + 1e-12


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_near_duplicates_recall(spark, similarity):
    """Pairs of texts just over a similarity, each pair alone, so that no chain helps; some of their shingles are repeated."""

    def pair(i, changed):
        words = [f"w{i}_{j}" for j in range(180)]
        other = [f"z{i}_{j}" if j % 6 == 3 and j < 6 * changed else w for j, w in enumerate(words)]
        again = words[150:170] * 2
        return " ".join(words + again), " ".join(other + again)

    truth = {c: jaccard(*map(shingles, pair(0, c))) for c in range(1, 12)}
    changed = max(c for c, t in truth.items() if t >= similarity)
    assert truth[changed] < similarity + 0.05
    pairs = 400
    docs = [(2 * i + side, t) for i in range(pairs) for side, t in enumerate(pair(i, changed))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dedup.near_duplicates(df).where("doc_id % 2 = 1 AND class_id = doc_id - 1").count()
    assert got >= 0.99 * pairs


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = {int(x): float(w) for x, w in zip(range(40), rng.uniform(0.5, 4, 40))}, {int(x): float(w) for x, w in zip(range(10, 50), rng.uniform(0.5, 4, 40))}
    truth = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a | b) for d in a.keys() & b.keys())
    elements = common.mix(np.arange(50, dtype=np.uint64))
    owner = np.repeat([0, 1], [40, 40])
    z = near_dedup.probminhash(owner, elements[list(a) + list(b)], np.array(list(a.values()) + list(b.values())), 2, 8000)
    assert (z[0] == z[1]).mean() == pytest.approx(truth, abs=0.025)


# ------------------------------------------------------------------ decontamination


def greedy_tiles(a, b, least):
    """String tiling by its definition: mark all longest unmarked matches, again and again."""
    fa, fb, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        for i, j in found:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                fa[i : i + best] = fb[j : j + best] = [False] * best
                tiles.append((i, j, best))
        if not found:
            return tiles


def test_tiling_matches_its_definition():
    rng = np.random.default_rng(0)
    for _ in range(60):
        b = rng.integers(0, 6, 40).tolist()
        cuts = sorted(rng.choice(40, 3, replace=False))
        parts = [b[i:j] for i, j in zip([0, *cuts], [*cuts, 40])]
        rng.shuffle(parts)
        a = list(itertools.chain(rng.integers(0, 6, 15).tolist(), *parts, rng.integers(0, 6, 10).tolist()))
        got = decontaminate.tile(a, b, 3)
        assert all(a[i : i + k] == b[j : j + k] for i, j, k in got)
        for which in (0, 1):
            marked = [p + d for t in got for p in [t[which]] for d in range(t[2])]
            assert len(marked) == len(set(marked))
        assert sum(k for _, _, k in got) >= 0.9 * sum(k for _, _, k in greedy_tiles(a, b, 3))
    assert sum(k for _, _, k in decontaminate.tile([7] * 3000, [7] * 50, 5)) == 50


def test_leaks_are_found_in_another_order_and_case(spark):
    rng = np.random.default_rng(2)
    item = [f"t{i}" for i in range(40)]
    other = lambda n: [f"o{x}" for x in rng.integers(0, 500, n)]
    docs = [
        (0, other(200) + item + other(50)), (1, other(60) + item[20:] + other(30) + item[:20] + other(9)), (2, other(60) + [w.upper() + "," for w in item]), (3, other(300)), (4, item[:10] + other(80)), (5, item[5:30] + other(5)),
    ]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, " ".join(other(30)))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(got) == {0, 1, 2, 5} and got[0].coverage == 1 and got[1].n_tiles == 2 and got[5].coverage == pytest.approx(25 / 40)


def test_leaks_of_documents(spark, data, texts):
    words = lambda t: [x for x in ("".join(c for c in w if c.isalnum()) for w in t.lower().split()) if x]
    bench = {r.item_id: words(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    want = set()
    for i, t in texts.items():
        w = words(t)
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for item, b in bench.items():
            if any(tuple(b[k : k + 5]) in grams for k in range(len(b) - 4)) and sum(k for _, _, k in greedy_tiles(w, b, 5)) >= 0.5 * len(b):
                want.add((i, item))
    assert {(r.doc_id, r.item_id) for r in run(spark, data, "op3").collect()} == want


# ------------------------------------------------------------------ language model


def test_base_score_and_counts(spark, data, texts):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) + [None]
    train = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    rows = run(spark, data, "op4").collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(t), sum(train[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_rare_words_by_shuffle_give_the_same_as_by_broadcast(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    path = public_tokenizers.path("piece_bpe_32k.model")
    a = {r.doc_id: r for r in lattice_lm.score_documents(docs, path, hot_share=1e-9).collect()}
    b = {r.doc_id: r for r in lattice_lm.score_documents(docs, path, hot_share=1e-3).collect()}
    assert all(a[k].n_known == b[k].n_known and a[k].base_score == pytest.approx(b[k].base_score) for k in a)


def test_rare_words_count_in_every_round(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    path = public_tokenizers.path("piece_bpe_32k.model")
    a = {r.doc_id: r.score for r in lattice_lm.score_documents(docs, path, hot_share=1e-9).collect()}
    b = {r.doc_id: r.score for r in lattice_lm.score_documents(docs, path, hot_share=1e-3).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)
    # the rounds by themselves, over all distinct words at once
    train = docs.where(~F.coalesce(lattice_lm.default_held_out(), F.lit(False))).select("text").collect()
    words = Counter(w for r in train for w in re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)))
    pieces, p = lattice_lm.vocabulary(path)
    for _ in range(4):
        uses = lattice_lm.Lattice(pieces, p).run(list(words), np.array(list(words.values()), float))[1]
        uses[-1] = len(train)
        p = (uses + 0.1) / (uses + 0.1).sum()
    counts = spark.createDataFrame(list(words.items()), "token string, c long")
    assert np.allclose(lattice_lm.train(counts, len(train), path)[1], p, rtol=1e-9)
    # and the scores by a plain recursion over the segmentations of each word
    table = dict(zip(pieces, p.tolist()))
    longest, known = max(map(len, pieces)), {}

    def likelihood(word):
        if word not in known:
            w, alpha = "▁" + word, [1.0]
            for j in range(1, len(w) + 1):
                spelled = math.prod(table[f"<0x{b:02X}>"] for b in w[j - 1].encode())
                alpha.append(alpha[j - 1] * spelled + sum(alpha[i] * table[w[i:j]] for i in range(max(0, j - longest), j) if w[i:j] in table))
            known[word] = math.log10(alpha[-1])
        return known[word]

    for r in docs.limit(50).collect():
        tokens = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER))
        if all(len(w) < 40 for w in tokens):
            assert a[r.doc_id] == pytest.approx(sum(map(likelihood, tokens)) + math.log10(p[-1]), rel=1e-7)


def test_lattice_sums_all_segmentations():
    pieces, p = ["▁a", "a", "b", "ab", "▁ab", "ba", "▁"], np.full(7 + 257, 0.001)
    p[:7] = [0.2, 0.1, 0.15, 0.05, 0.07, 0.03, 0.02]
    lattice = lattice_lm.Lattice(pieces + [f"<0x{b:02X}>" for b in range(256)] + ["</s>"], p)
    table = dict(zip(pieces, p))

    def total(s):
        if not s:
            return 1.0
        out = sum(q * total(s[len(k) :]) for k, q in table.items() if s.startswith(k))
        return out + 0.001 ** len(s[0].encode()) * total(s[1:])

    words = ["ab", "aba", "b", "c", "é", "abababab", "東"]
    got, uses = lattice.run(words, np.ones(len(words)))
    assert np.allclose(np.exp(got), [total("▁" + w) for w in words])
    lattice.set(p * 1.0)
    # expected uses are the gradient of the log probability
    for k in range(7):
        bumped = p.copy()
        bumped[k] *= 1 + 1e-6
        lattice.set(bumped)
        assert (lattice.run(words)[0].sum() - got.sum()) / 1e-6 == pytest.approx(uses[k], abs=1e-4)


# ------------------------------------------------------------------ pages, toxicity, quality


def test_pages_give_their_articles(spark, data):
    import html as h

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in run(spark, data, "op5").collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br|ul|li|div)\b[^>]*>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_hostile_pages_take_linear_time():
    import time

    tree = html_text.train()
    for page in ("<a '", "<b>", "<a '>' ", "<!", "<p x='<a b=\"c\">"):
        whole = page * 30_000 + '</i>"' * 5
        began = time.time()
        html_text.main_text(whole, tree)
        assert time.time() - began < 20, page
    cut = lambda page: [page[a:b] for a, b in itertools.pairwise(itertools.accumulate(_ends(page), initial=0))]

    def _ends(page):
        tokens, at = html_text.Tokens(page), 0
        while at < len(page):
            end = tokens.next(at)
            yield end - at
            at = end

    assert cut("a<b c='>'>d<!-- x > -->e<") == ["a", "<b c='>'>", "d", "<!-- x > -->", "e", "<"]
    assert cut("<a '>x</a>") == ["<a '>", "x", "</a>"] and cut("<1> <a b") == ["<", "1> ", "<", "a b"]


def test_tree_fits_its_table_and_pages_without_article():
    tree = html_text.train()
    table = np.asarray(html_text.LABELLED, float)
    assert all((html_text.judge(tree, row[:-1]) >= 0.5) == bool(row[-1]) for row in table)
    body = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(3))
    page = f"<html><body><div id='menu'><a href='/'>Home</a> <a href='/x'>News</a></div><ul><li><a href='a'>One</a></li><li><a href='b'>Two</a></li></ul>{body}<form>Name <input><button>Go</button></form><div class='sidebar'><p>{'side ' * 30}</p></div><div class='user-comments'><p>{'I think ' * 20}</p></div><footer>(c) us</footer>"
    got = html_text.main_text(page, tree)
    assert got.count("\n\n") == 2 and "side" not in got and "think" not in got and "Home" not in got and "(c)" not in got


def test_toxic_documents_are_found(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in run(spark, data, "op6").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    known = [(rows[i].predicted, y) for i, y in labels.items() if y is not None and rows[i].held_out]
    wrong = sum(p and not y for p, y in known)
    assert wrong <= 0.01 * len(known) and sum(p and y for p, y in known) >= 0.6 * sum(y for _, y in known)


def test_automaton_finds_what_edit_distance_finds():
    terms = ["moron", "idiot", "worthless", "scum", "disgusting", "achk*"]
    find = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(0)
    words = ["moron", "m0ron", "morn", "mooron", "moroon", "orsthless", "wrthles", "worthlessss", "scam", "disgustin", "dsgustin", "achkeit", "achx", ""]
    for t in terms[:-1]:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.integers(0, 4)):
                p = int(rng.integers(0, len(w) + 1))
                what = rng.integers(0, 3)
                w[p:p] = ["q"] if what == 0 else []
                if what and p < len(w):
                    w[p : p + 1] = ["z"] if what == 1 else []
            words.append("".join(w))
    for w in words:
        near = [(distance(w, t), k) for k, t in enumerate(terms[:-1]) if distance(w, t) <= toxicity.allowed(len(t))]
        want = (min(near)[1], min(near)[0]) if near else (5, 0) if w.startswith("achk") else None
        assert find.near(w) == want, w


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_toxicity_scores_by_plain_rules(spark, data, texts):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.train(docs, labels, held_out=toxicity.default_held_out())
    (terms, weights, plain, window), w = model.parts, model.coefficients
    assert terms
    whole, known = [(k, t) for k, t in enumerate(terms) if t[-1] != "*"], {}

    def nearest(word):
        if word in terms:
            return terms.index(word), 0
        stems = [t for t in terms if t[-1] == "*" and word.startswith(t[:-1])]
        if stems:
            return terms.index(max(stems, key=len)), 0
        close = [(edits(word, t), k) for k, t in whole if abs(len(t) - len(word)) <= toxicity.allowed(len(t))]
        close = [(d, k) for d, k in close if d <= toxicity.allowed(len(terms[k]))]
        return (min(close)[1], min(close)[0]) if close else None

    def hit(word):
        if word not in known:
            c = toxicity.core(word)
            got = nearest(c) if c else None
            if got is None and not c.isalnum() and len(c) > 4:
                got = nearest("".join(x for x in c if x.isalnum()))
            known[word] = None if got and c in plain and (got[1] or terms[got[0]][-1] == "*") else got
        return known[word]

    rows = {r.doc_id: r.score for r in run(spark, data, "op6").collect()}
    some = sorted(texts)[:80]
    for i in some:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i].translate(LOWER))
        inside = toxicity.Scorer.quoted(words)
        found, quoted = [], 0
        for p, word in enumerate(words):
            if hit(word):
                if inside[p] or any(toxicity.core(x) in toxicity.REPORTS for x in words[max(0, p - 3) : p]):
                    quoted += 1
                else:
                    near = [toxicity.core(x) in toxicity.ADDRESS for x in words[max(0, p - window) : p + window + 1]]
                    found.append((*hit(word), any(near)))
        n = max(len(found), 1)
        x = [0.0] * 8
        if found or quoted:
            kinds = {k for k, _, _ in found}
            x = [math.log1p(sum(d == 0 for _, d, _ in found)), math.log1p(sum(d > 0 for _, d, _ in found)), math.log1p(quoted), bool(kinds), math.log1p(len(kinds)),
                 math.log1p(100 * len(found) / len(words)), sum(a for _, _, a in found) / n, sum(weights[k] for k, _, _ in found) / n]
        assert rows[i] == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, w)) + w[-1]))), rel=1e-9)


def test_quotations_have_partners():
    def inside(text):
        words = text.split()
        return [w for w, q in zip(words, toxicity.Scorer.quoted(words)) if q]

    assert not inside("'tis plain that you are a moron") and not inside('a "b c d') and not inside("rock and the dogs' owner")
    assert inside("x \"the dogs' owner is a moron\" y") == ['"the', "dogs'", "owner", "is", "a", 'moron"']
    assert inside("„du bist“ so « a b » and 'c' (“d e”).") == ["„du", "bist“", "«", "a", "b", "»", "'c'", "(“d", "e”)."]
    assert len(inside('say "a ' + "b " * 500 + 'c" d')) == 502


def test_quotation_is_told_from_abuse():
    scorer = toxicity.Scorer(["moron"], [3.0], [], 6)
    x = scorer.features(pa.array(["you are a moron", 'he wrote "what a moron" there', "the word moron is old", "you m0ron", "nothing"]))
    names = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert (x[:, names["unquoted"]] > 0).tolist() == [True, False, False, False, False]
    assert (x[:, names["quoted"]] > 0).tolist() == [False, True, True, False, False] and x[3, names["fuzzy"]] > 0 and x[4].sum() == 0
    assert (x[:, names["any"]] > 0).tolist() == [True, False, False, True, False]


def test_quality_on_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [(r.selected, labels[r.doc_id]) for r in run(spark, data, "op1").collect() if r.held_out and r.doc_id in labels]
    assert np.mean([s == bool(y) for s, y in rows]) > 0.93


def test_quality_scores_by_plain_rules(spark, data, texts):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = quality.train(docs, labels, held_out=quality.default_held_out())
    mask = (1 << model.bits) - 1
    bucket = lambda x: int(common.hash_strings(pa.array([x], pa.string()))[0])
    finish = lambda x: int(common.mix(np.array([x], np.uint64))[0])
    kinds = lambda w: "".join(k for k, _ in itertools.groupby("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "w" if c.isalpha() else c for c in w))
    rows = {r.doc_id: r for r in run(spark, data, "op1").collect()}
    for i in sorted(texts)[:60]:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i])
        counts, n = Counter(words), max(len(words), 1)
        length = math.sqrt(max(sum(counts.values()), 1))
        latent = sum(math.sqrt(c) / length * (model.weights[bucket(w.lower()) & mask] + model.weights[finish(bucket(kinds(w))) & mask]) for w, c in counts.items())
        again = sum(a == b for a, b in zip(words, words[1:]))
        steps = [math.log2(len(words) + 1), 10 * len(counts) / n, min(sum(map(len, words)) / n, 30), 10 * max(counts.values(), default=0) / n, 10 * again / n]
        for k, x in enumerate(steps):
            latent += 0.5 * model.weights[finish(int(x) + ((k + 1) << 32)) & mask]
        under = [1 / (1 + math.exp(-(t - latent))) for t in model.thresholds]
        assert rows[i].expected_grade == pytest.approx(model.grades[0] + sum((b - a) * (1 - u) for a, b, u in zip(model.grades, model.grades[1:], under)), abs=1e-6)
        assert rows[i].tail_probability == pytest.approx(1 - under[0], abs=1e-6)


def test_ordinal_model_orders_five_grades():
    rng = np.random.default_rng(0)
    n, rows = 600, []
    latent = rng.normal(size=n)
    level = np.digitize(latent + rng.logistic(scale=0.2, size=n), [-1.5, -0.5, 0.5, 1.5])
    text, bucket, value = np.repeat(np.arange(n), 2), np.tile([3, 900], n), np.stack([latent, rng.normal(size=n)], 1).ravel()
    thresholds, weights = quality.fit(text, bucket, value, level, 5, 10)
    assert (np.diff(thresholds) > 0).all() and weights[3] > 5 * abs(weights[900])
    model = quality.Model([1, 2, 3, 4, 5], thresholds, weights, 10)
    p = 1 / (1 + np.exp(-(thresholds[None] - (weights[3] * latent)[:, None])))
    expected = 1 + (1 - p).sum(1)
    assert np.corrcoef(expected, level)[0, 1] > 0.9 and model.grades[-1] == 5


# ------------------------------------------------------------------ personal data


E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0
    return [
        [m.span() for m in E.finditer(t)], [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))], [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15],
    ]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, s in zip(pii.KINDS, spans) for a, b in s)


HARD = [
    "a@b.c_d@e.f", "x@y", "a@b..c a@b.c. é🙂 a.b%c+d@e-f.g-h.ij@k.l", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.256 01.002.3.4 1.2.3", "999.1.2.3.4.5", "4111 1111-1111 1111", "4111  1111 1111 1111", "5 -4111111111111111", "41111111111111111111",
    "+1 (377) 555-0271x", "+12345", "+1))))2(((((3 4 5 6 7 8 9 0", "++49 30 123456 +49 30 1234567 8901234567", "0445617099674829 a", "12 34 56 78 90 12 34 56 7", "1-2-3-4-5-6-7-8-9-0-1-2-8", "a@b.co@d.ef@g.hi", "%%%@x.yz", "..@..", "-" * 99 + "@a.b",
    "1" * 400, "1 " * 400, "1." * 400, "a" * 3000 + "@", "a@" * 500, "+1" * 300, "@" * 300, "a.b" * 2000 + "@c.d",
]


def test_base_spans_on_hard_texts(spark):
    rng = np.random.default_rng(0)
    texts = HARD + ["".join(rng.choice(list("0123456789 -.+()@ab%_🙂"), 80)) for _ in range(1500)] + ["x 4111111111111111 " * 400 + "a@b.cd " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        spans = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in spans], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest(), texts[r.doc_id]
        assert set(written(spans).split(",")) <= set(r.spans.split(",")) or not written(spans)


def test_personal_data_of_documents(spark, data, texts):
    for r in run(spark, data, "op8").collect():
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()


def test_labelers_add_spans_and_leave_plain_numbers_alone(spark):
    texts = ["please call me, phone (555) 555-0271 today", "mail: john [at] example [dot] com", "order 555 555 0271 of parts", "the sum 123 456 7890 was", "card number 4111111111111112 visa", "nothing", "jane.d(at)mail.example.org. Next day", "we met at noon dot that", "the desk (212) 555-0143 stands"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert got[0] == "phone:22:36" and got[1].startswith("email:6:") and not got[2] and not got[3] and not got[5] and got[6] == "email:0:26" and not got[7] and got[8] == "phone:9:23"


def test_redaction_is_what_the_spans_say(spark, data, texts):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    for i, t in texts.items():
        cover = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans[i].split(",") if s))
        new, at = [], 0
        for a, b, k in cover:
            if a >= at:
                new += [t[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        assert out[i].text == "".join(new) + t[at:] and out[i].n_chars == len(out[i].text)


# ------------------------------------------------------------------ packing


def test_packing_is_a_round_trip(spark, data, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = run(spark, data, "op9").collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 2048) and all(r.length == 2048 for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    counts = np.bincount([r.length for r in rows], minlength=2049)
    assert len(sequences) == sum(n for _, n in packing.plan(counts, 2048)) <= 1.01 * packing.lower_bound(counts, 2048) + 1


def test_both_encoders_give_equal_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ids = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(0)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[a : a + 64])) for a in range(0, len(points), 64)] + [" ".join(map(chr, points[a : a + 64])) for a in range(0, len(points), 64)]
    texts += ["".join(chr(points[k]) for k in rng.integers(0, 600, 60)) for _ in range(500)] + ["<|endoftext|> it's  \n\n x'll", " " * 70, "\t\n" * 40, "a" * 5000]
    bad = [t for t in texts if tok.encode(t, add_special_tokens=False).ids != ids(t).tolist()]
    assert not bad, [t[:20] for t in bad[:5]]


def best_packing(sizes, cap):
    """Fewest bins by trying all assignments, largest first."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {tuple([b]): j for j, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= cap:
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_plan_is_optimal_on_small_cases():
    rng = np.random.default_rng(0)
    worse = 0
    for _ in range(60):
        sizes = rng.integers(4, 40, rng.integers(4, 11)).tolist()
        runs = packing.plan(np.bincount(sizes, minlength=61), 60)
        assert Counter(s for p, n in runs for s in p * n) == Counter(sizes) and all(sum(p) <= 60 for p, _ in runs)
        n = sum(n for _, n in runs)
        worse += n - best_packing(sizes, 60)
        assert n >= packing.lower_bound(np.bincount(sizes, minlength=61), 60)
    assert worse == 0


def test_completion_beats_best_fit():
    def bins(runs):
        return sum(n for _, n in runs)

    counts = np.bincount([10, 8, 22, 19, 35, 12, 18, 13, 33, 17, 21, 32], minlength=61)
    assert (bins(packing.best_fit(counts, 60)), bins(packing.plan(counts, 60)), packing.lower_bound(counts, 60)) == (5, 4, 4)
    rng, better = np.random.default_rng(5), 0
    for _ in range(150):
        sizes = rng.integers(6, 40, rng.integers(8, 14)).tolist()
        counts = np.bincount(sizes, minlength=61)
        n = bins(packing.plan(counts, 60))
        assert n == best_packing(sizes, 60)
        better += n < bins(packing.best_fit(counts, 60))
    assert better


def test_undominated_fillings():
    left = np.bincount([30, 20, 10, 10, 5, 5], minlength=61)
    found = packing.fillings(left, 30, 30, 10_000)
    assert found[0] == (30,) and all(sum(f) <= 30 for f in found)
    assert not any(packing.dominates(a, b) for a in found for b in found if a != b)
    every = {tuple(sorted(c, reverse=True)) for k in range(7) for c in itertools.combinations([30, 20, 10, 10, 5, 5], k) if sum(c) <= 30}
    assert all(any(packing.dominates(f, e) for f in found) for e in every)
    assert packing.dominates((20, 10), (10, 10, 5, 5)) and not packing.dominates((10, 10, 5, 5), (20, 10)) and not packing.dominates((20, 10), (15, 15))


# ------------------------------------------------------------------ vectors


def brute_links(ids, x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], len(ids)).min(1))
        new = new[new]
        if (new == label).all():
            return {int(i): (int(hit[k].sum()), int(ids[label[k]])) for k, i in enumerate(ids)}
        label = new


def test_vectors_in_many_cells_and_blocks(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 32))
    x = centres[rng.integers(0, 6, 500)] * 0.4 + rng.normal(size=(500, 32))
    near = x[rng.integers(0, 500, 250)] + rng.normal(size=(250, 32)) * rng.uniform(0.02, 0.45, (250, 1))
    dense = x[0] + rng.normal(size=(150, 32)) * 0.1
    allx = np.concatenate([x, near, dense, x[:40]]).astype("f4")
    ids = np.arange(len(allx)) * 3 + 1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, allx)], "vec_id long, embedding array<float>")
    want = brute_links(ids, allx.astype(float))
    exact = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.link_vectors(df, rows_per_cell=60, block_rows=32, deviations=99.0).collect()}
    assert exact == want
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.link_vectors(df, rows_per_cell=60, block_rows=32).collect()}
    assert all(got[i][0] <= want[i][0] for i in want) and sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_vectors_of_embeddings(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute_links(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    assert {r.vec_id: (r.n_links, r.component_id) for r in run(spark, data, "op10").collect()} == want


# ------------------------------------------------------------------ helpers


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(500, 499), (499, 500)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.component for r in common.connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 180)) and got[500] == 499


def test_words_of_sliced_arrays():
    texts = [None, "", " A  b\tC\n", "x" * 50, "ÄB é", "\x0b\x0cq\x1c z"]
    for a in range(len(texts)):
        offsets, codes, words = common.split_words(pa.array(texts).slice(a))
        names = words.to_pylist()
        for k, t in enumerate(texts[a:]):
            assert [names[c] for c in codes[offsets[k] : offsets[k + 1]]] == re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def test_hashes_and_batches():
    h = common.hash_strings(pa.array(["a", "b", "a", "", "abcdefgh", "abcdefghi"]))
    assert h[0] == h[2] and len(set(h.tolist())) == 5 and (common.hash_strings(pa.array(["z", "a"]).slice(1)) == h[:1]).all()
    batch = pa.record_batch({"t": pa.array(["x" * 10] * 7 + [None, "y" * 100, "z"])})
    parts = list(common.small([batch], "t", 25))
    assert sum(p.num_rows for p in parts) == 10 and max(p.num_rows for p in parts) <= 3
