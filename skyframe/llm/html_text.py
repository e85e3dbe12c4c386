"""Main text of web pages: flat text blocks, classified by a decision tree over block and neighbour features."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, small

# Elements that begin and end a block, and elements whose content is never text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button option title head".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements and words in class, id or role that speak for or against main text.
OUTER_TAGS = frozenset("nav header footer aside form menu dialog search".split())
MAIN_TAGS = frozenset("article main".split())
OUTER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "discussion disclaimer dialog footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promoted promotion reader-comments related replies respond responses search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar tooltip alert complementary contentinfo "
    "hidden widget reactions reviews".split()
)
MAIN_WORDS = frozenset("article body content entry main maincontent post story text articlebody".split())

_TAG = re.compile(r"</?[a-zA-Z]")
_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s>=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_SPACE = re.compile(r"\s+")



class Tokens:
    """Cuts a page into tags, comments and text in one pass, whatever it holds.

    A tag ends at the first ``>`` outside its quotation marks.  Once a mark turns out never to be closed, tags up to it end at their first
    ``>``, so no stretch of a page is searched again and again; a ``<`` that nothing ends is text.
    """

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.unclosed = -1  # tags that begin before this place don't heed quotation marks
        self.none: dict[str, int] = {}  # for each mark, the place from which the page has none

    def find(self, mark: str, at: int) -> int:
        if at >= self.none.get(mark, self.size + 1):
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.none[mark] = at
        return found

    def tag_end(self, at: int) -> int:
        """The place after the tag that begins at ``at``, or -1."""
        if self.find(">", at) < 0:
            return -1
        begin = at
        while begin >= self.unclosed:
            stop = _STOP.search(self.page, at)
            if stop is None:
                self.unclosed = self.size
            elif stop.group() == ">":
                return stop.end()
            else:
                close = self.find(stop.group(), stop.end())
                if close < 0:
                    self.unclosed = stop.end()
                at = close + 1
        return self.find(">", begin) + 1

    def next(self, at: int) -> int:
        """The place after the token that begins at ``at``."""
        page = self.page
        if page[at] != "<":
            end = self.find("<", at)
            return self.size if end < 0 else end
        if page.startswith("<!--", at):
            end = self.find("-->", at + 4)
            return self.size if end < 0 else end + 3
        if page.startswith(("<!", "<?"), at):
            return self.find(">", at) + 1 or at + 1
        if _TAG.match(page, at):
            end = self.tag_end(at)
            return at + 1 if end < 0 else end
        return at + 1


Block = tuple[str, int, int, bool, bool, bool]  # text, words, words in links, heading, in a main element, in an outer element


def _side(name: str, tag: str) -> int:
    """-1 for an element that holds what isn't main text, 1 for one that holds the main text, else 0."""
    if name in OUTER_TAGS:
        return -1
    side = 1 if name in MAIN_TAGS else 0
    if "=" in tag:
        if _HIDDEN.search(tag):
            return -1
        for groups in _MARKS.findall(tag):
            words = set(re.split(r"[\s_]+", "".join(groups).lower()))
            words |= {w for x in words for w in x.split("-")}
            if words & OUTER_WORDS and name not in ("body", "html") and not (side == 1):
                return -1
            if words & MAIN_WORDS:
                side = 1
    return side


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order.  Markup that isn't closed is closed by the elements around it."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    open_: Counter = Counter()  # how often each name is on the stack
    tokens = Tokens(page)
    parts: list[str] = []
    linked = 0
    links: list[str] = []
    silent = outer = main = anchors = heading = 0
    head = False

    def flush() -> None:
        nonlocal parts, links, head
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                in_links = len(html.unescape(" ".join(links)).split()) if links else 0
                out.append((text, len(text.split()), in_links, head, main > 0, outer > 0))
            parts, links = [], []
        head = heading > 0

    def leave(name: str, side: int) -> None:
        nonlocal silent, outer, main, anchors, heading
        open_[name] -= 1
        silent -= name in SILENT_TAGS
        outer -= side < 0
        main -= side > 0
        anchors -= name == "a"
        heading -= name in _HEADINGS

    raw, at, end = "", 0, len(page)
    while at < end:
        if raw:
            close = re.compile(rf"</{raw}(?=[\s>/]|\Z)", re.I).search(page, at)
            at, raw = (close.start() if close else end), ""
            continue
        begin, at = at, tokens.next(at)
        token = page[begin:at]
        if token[0] != "<" or token == "<":
            if not silent:
                if not parts:
                    head = heading > 0
                parts.append(token)
                if anchors:
                    links.append(token)
            continue
        name = _NAME.match(token)
        if not name:
            continue
        name = name[1].lower()
        if name in BLOCK_TAGS:
            flush()
        elif name == "br" and not silent:  # one is white space, several end a block
            if parts and parts[-1] == "\n":
                flush()
            elif parts:
                parts.append("\n")
        if token[1] == "/":
            while open_[name]:
                n, side = stack.pop()
                leave(n, side)
                if n == name:
                    break
        elif name not in VOID_TAGS and not token.endswith("/>"):
            if name in ("p", "li", "option", "a") and stack and stack[-1][0] == name:
                leave(*stack.pop())
            side = _side(name, token)
            stack.append((name, side))
            open_[name] += 1
            silent += name in SILENT_TAGS
            outer += side < 0
            main += side > 0
            anchors += name == "a"
            heading += name in _HEADINGS
            if name in RAW_TAGS:
                raw = name
    flush()
    return out


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "heading", "in_main", "in_outer", "page_has_main")


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block: its own figures, those of its neighbours, and the elements around it."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words = np.array([b[1] for b in found], float)
    density = np.array([b[2] for b in found], float) / np.maximum(words, 1)
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
    x[:, 6] = [b[3] for b in found]
    x[:, 7] = [b[4] for b in found]
    x[:, 8] = [b[5] for b in found]
    x[:, 9] = any(b[4] and not b[5] for b in found)
    return x


# A small labelled table: blocks of pages as people mark them, (FEATURES..., is main text).
# Fixed values.
LABELLED = (
    # menus, link lists and bread crumbs
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 1, 1, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 8, 0.0, 0, 0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 40, 0.0, 0, 0, 0, 1, 0), (6, 0.9, 4, 1.0, 5, 1.0, 0, 0, 0, 0, 0), (9, 0.8, 30, 0.0, 7, 1.0, 0, 0, 0, 1, 0), (12, 1.0, 45, 0.0, 10, 1.0, 0, 1, 1, 1, 0),
    (8, 1.0, 60, 0.1, 9, 1.0, 0, 0, 1, 0, 0), (14, 0.9, 12, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    # adverts, notices, forms and sign-up boxes
    (8, 0.0, 1, 1.0, 10, 0.0, 0, 0, 1, 1, 0), (12, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 1, 0), (30, 0.1, 5, 0.0, 12, 0.0, 0, 0, 1, 1, 0), (45, 0.0, 10, 0.0, 80, 0.0, 0, 0, 1, 1, 0),
    (25, 0.0, 60, 0.0, 70, 0.0, 0, 1, 1, 1, 0), (6, 0.0, 50, 0.0, 45, 0.0, 0, 1, 1, 1, 0), (15, 0.0, 40, 0.0, 3, 0.0, 1, 1, 1, 1, 0), (9, 0.3, 0, 0.0, 1, 1.0, 0, 0, 0, 1, 0),
    (22, 0.0, 0, 0.0, 6, 1.0, 0, 0, 0, 1, 0), (18, 0.1, 0, 0.0, 50, 0.0, 0, 0, 1, 0, 0), (35, 0.0, 2, 1.0, 90, 0.0, 0, 0, 1, 0, 0),
    # reader comments, side bars and related stories
    (40, 0.0, 3, 0.0, 35, 0.0, 0, 0, 1, 1, 0), (60, 0.0, 2, 1.0, 2, 1.0, 0, 1, 1, 1, 0), (28, 0.0, 40, 0.0, 33, 0.0, 0, 0, 1, 0, 0), (90, 0.0, 28, 0.0, 2, 0.0, 0, 0, 1, 0, 0),
    (5, 0.0, 60, 0.0, 40, 0.0, 1, 0, 1, 1, 0), (50, 0.2, 4, 0.0, 20, 0.5, 0, 0, 1, 0, 0), (30, 0.0, 80, 0.0, 25, 0.0, 0, 0, 0, 1, 0), (120, 0.0, 8, 0.0, 5, 0.0, 0, 0, 0, 1, 0),
    # footers
    (7, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 1, 0), (11, 0.0, 4, 0.0, 0, 0.0, 0, 0, 1, 1, 0), (9, 0.2, 70, 0.0, 0, 0.0, 0, 0, 1, 0, 0), (5, 0.6, 30, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (6, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0), (4, 0.0, 10, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (10, 0.1, 2, 1.0, 0, 0.0, 0, 0, 0, 1, 0),
    # headings and paragraphs inside article or main elements, however short
    (8, 0.0, 9, 0.0, 30, 0.0, 1, 1, 0, 1, 1), (10, 0.0, 1, 1.0, 60, 0.0, 1, 1, 0, 1, 1), (60, 0.0, 8, 0.0, 45, 0.0, 0, 1, 0, 1, 1), (1, 0.0, 50, 0.0, 70, 0.0, 0, 1, 0, 1, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1, 1), (2, 0.0, 90, 0.0, 8, 0.0, 0, 1, 0, 1, 1), (30, 0.5, 40, 0.0, 35, 0.0, 0, 1, 0, 1, 1), (3, 1.0, 40, 0.0, 50, 0.0, 0, 1, 0, 1, 1),
    (150, 0.05, 3, 0.0, 9, 0.0, 0, 1, 0, 1, 1), (20, 0.1, 120, 0.0, 7, 0.0, 0, 1, 0, 1, 1), (5, 0.0, 60, 0.0, 10, 0.3, 0, 1, 0, 1, 1), (4, 0.8, 5, 0.8, 6, 0.8, 0, 1, 0, 1, 1),
    (7, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1, 1), (12, 0.0, 8, 0.0, 0, 0.0, 0, 1, 0, 1, 1), (3, 0.0, 5, 0.0, 60, 0.0, 1, 1, 0, 1, 1),
    # paragraphs of pages without such elements
    (80, 0.0, 9, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (45, 0.1, 80, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (30, 0.0, 8, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 1, 1.0, 60, 0.0, 1, 0, 0, 0, 1), (6, 0.0, 3, 1.0, 45, 0.0, 1, 0, 0, 0, 1), (25, 0.0, 60, 0.0, 8, 0.0, 0, 0, 0, 0, 1),
    (20, 0.0, 25, 0.0, 18, 0.0, 0, 0, 0, 0, 1), (110, 0.02, 5, 0.0, 5, 0.0, 0, 0, 0, 0, 1), (60, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 1), (16, 0.0, 14, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
)

Tree = tuple  # (feature, threshold, tree at or under it, tree over it), or (share of main text,)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 1) -> Tree:
    """A classification tree: at each node the split with the least Gini impurity."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return (share,)
    best = (len(y) * share * (1 - share) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            n = int(low.sum())
            if n < least or len(y) - n < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            cost = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if cost < best[0] - 1e-12:
                best = (cost, f, cut)
    _, f, cut = best
    if f is None:
        return (share,)
    low = x[:, f] <= cut
    return (f, float(cut), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def judge(tree: Tree, row: np.ndarray) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def train(labelled=LABELLED) -> Tree:
    table = np.asarray(labelled, dtype=float)
    return grow(table[:, :-1], table[:, -1])


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    rows = features(found)
    return "\n\n".join(b[0] for b, row in zip(found, rows, strict=True) if judge(tree, row) >= 0.5)


def extract_text(pages: DataFrame, *, html_col: str = "html", labelled=LABELLED, name: str = "text") -> DataFrame:
    """Add the main text of every page, and its length in code points as ``n_chars``.

    The tree is trained from the labelled table (a parameter of a few dozen rows) on the
    driver and travels with the tasks; pages are read whole and don't move.  Null and empty
    pages, and pages without main text, have an empty text.  Repeated rows are read each, an empty table gives an empty one, and an input
    column that has one of the two names, in whatever case, is replaced.
    """
    tree = train(labelled)
    kept = [c for c in pages.columns if c.lower() not in (name.lower(), "n_chars")]
    page = fresh(pages, "page")
    source = pages.select(*kept, pages[html_col].alias(page))
    schema = source.drop(page).schema.add(name, "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, page):
            texts = [main_text(page_, tree) for page_ in batch.column(page).to_pylist()]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, name, "n_chars"])

    return source.mapInArrow(run, schema)
