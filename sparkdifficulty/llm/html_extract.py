"""Main text of web pages: flat text blocks, classified by a decision tree on word counts and link densities.

A page is cut into flat blocks at block-level tags. A block's features are its number of words and share of linked
words, the same of the blocks before and after it, what it stands in (an article, nothing that tells, something that may
be boilerplate such as a form or a page's header, or boilerplate by its tag, role or class) and whether it is a heading.
A decision tree tells main text from boilerplate; it is fitted on the labelled blocks of the small pages in SAMPLES,
measured as any page is.

Cases: null html is as empty html and gives an empty text with 0 characters. Broken markup (unclosed tags or quotes, a cut
tag at the end) is read as far as it goes. White space inside a block is one space; blocks are joined by one newline in
page order. Repeated rows are kept; columns beside the html pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, map_rows

#: Tags that end a block. Fixed values of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: Tags whose content is never text of the page, and tags that never hold content.
SILENT_TAGS = frozenset("script style template noscript svg math iframe object textarea select head title button canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What tells boilerplate, by tag, by role, and by words of a class or id; and what may be boilerplate.
BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
DOUBTFUL_TAGS = frozenset("form header".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar widget cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login sharing social related recommended comment comments respond reply replies disqus pagination pager".split())
DOUBTFUL_WORDS = frozenset("header masthead footer foot aside banner notice notices alert form search share copyright legal disclaimer toolbar skip".split())
#: Words of a class or id beside which doubtful ones say nothing.
MAIN_WORDS = frozenset("article post entry story content main body text title headline".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Tags that a new one of the same kind ends, where the old one was left open.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

# a quoted value ends at a quote before white space, slash or end; one that holds a tag is taken as unclosed beyond 1,000 characters
_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"(?:[^\"<]*|[^\"]{0,1000})\"(?=[\s/>])|'(?:[^'<]*|[^']{0,1000})'(?=[\s/>]))*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_attr = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_words = re.compile(r"[a-z]+")
_ends = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title")}
_headings = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

ARTICLE, NEUTRAL, DOUBTFUL, BOILER = 3, 2, 1, 0
#: Features of a block, in order.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "container", "heading")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    container: int
    heading: bool


def container_of(tag: str, attrs: str, inside: int) -> int:
    """What the tag's content stands in, inside a container of kind `inside`."""
    if inside == BOILER or tag in BOILER_TAGS:
        return BOILER
    doubt = tag in DOUBTFUL_TAGS
    for kind, *values in _attr.findall(attrs):
        value = "".join(values).lower()
        if kind.lower() == "role":
            if value.strip() in BOILER_ROLES:
                return BOILER
            if value.strip() in ("main", "article"):
                inside = ARTICLE
        elif tag not in ("body", "html", "article", "main"):
            for name in value.split():
                said = set(_words.findall(name))
                if said & BOILER_WORDS:
                    return BOILER
                doubt |= bool(said & DOUBTFUL_WORDS) and not said & MAIN_WORDS
    if tag in MAIN_TAGS:
        return ARTICLE
    return DOUBTFUL if doubt and inside != ARTICLE else inside


def blocks(page: str) -> list[Block]:
    """The page's flat text blocks, in order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # of each tag's open elements on the stack
    barriers: list[int] = []  # places of open block elements but paragraphs: an end left out reaches no further
    inside, silent, links, heading = NEUTRAL, 0, 0, 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(entities.unescape("".join(x for x, _ in parts)).split())
            if text:
                linked = sum(len(x.split()) for x, a in parts if a)
                out.append(Block(text, len(text.split()), linked, inside, heading > 0))
            parts = []

    def close(upto: int) -> None:
        nonlocal inside, silent, links, heading
        while len(stack) > upto:
            tag, before = stack.pop()
            inside = before
            places[tag].pop()
            if barriers and barriers[-1] == len(stack):
                barriers.pop()
            silent -= tag in SILENT_TAGS
            links -= tag == "a"
            heading -= tag in _headings

    at, n = 0, len(page)
    while at < n:
        m = _token.search(page, at)
        start = m.start() if m else n
        if start > at and not silent:
            parts.append((page[at:start], links > 0))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            elif tag == "br" and not silent:
                parts.append((" ", False))
            continue
        is_block = tag in BLOCK_TAGS
        if is_block:
            flush()
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if m[3].endswith("/") and (m[3] == "/" or m[3][-2] in " \t\n\"'") and not is_block:
            continue  # a slash after an unquoted value is the value's
        if is_block:
            last = barriers[-1] if barriers else -1
            if tag in SELF_CLOSING and tag != "p" and last >= 0 and stack[last][0] == tag:
                close(last)
            elif (tag == "p" or tag in _headings) and places.get("p") and places["p"][-1] > last:
                close(places["p"][-1])
            elif tag in _headings and last >= 0 and stack[last][0] == tag:
                close(last)
        places.setdefault(tag, []).append(len(stack))
        if is_block and tag != "p":
            barriers.append(len(stack))
        stack.append((tag, inside))
        inside = container_of(tag, m[3], inside)
        silent += tag in SILENT_TAGS
        links += tag == "a"
        heading += tag in _headings
        if tag in _ends:
            end = _ends[tag].search(page, at)
            at = end.end() if end else n
            close(len(stack) - 1)
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([(b.words, min(1.0, b.linked / max(b.words, 1))) for b in found], dtype=float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.array([(b.container, b.heading) for b in found], dtype=float).reshape(-1, 2)])


#: The labelled pages, made for this operator. name(...) is an element, name.word one of that class; a letter and a number
#: is a block of so many words: p a paragraph, h a heading, i a list's item, l an item that is a link, m a paragraph of which a
#: third is linked. Capitals mark main text.
SAMPLES = (
    "nav(l2 l1 l3) article(H6 P40 P25 P3 P60) footer(p12)",
    "header(p4 nav(l1 l1 l2)) main(H8 P80 P12 I5 I4 I6 P30) aside(h2 l6 l5 l7) footer(p20 l1 l2)",
    "nav(l1 l1 l2 l1) div.ad(p9) article(H9 P120 P1 P2 P70 P5) footer(p14)",
    "nav(l1 l2) div.ad(p24) article(P2 P1 P33) div.comments(p20 p31) footer(p9)",
    "article(H4 P60 l3 l4 l2 l5 P35) section.comments(p30 p50 p22)",
    "article(H5 P28 l2 l1 l2 l2 P31)",
    "main(P90 P24 l1 l2 l1 P40 l3 l1 l4)",
    "article(H4 P60 I3 I4 I2 I5 P35)",
    "article(H3 P2 M20 P15 P1) aside(p40 p55 p38)",
    "nav(l1 l1) article(P1) footer(p10)",
    "header(h3 p6) article(H5 P18 M30 P44) div.related(l6 l7 l5) footer(p8 l2)",
    "article(header(H7 P3) P52 l2 l3 l2 l4 P61 P8) div.newsletter(p18 p3)",
    "main(H5 M12 P26 I3 I2 P41) aside(p12 l3 l3)",
    "div(l1 l2 l1) div(H7 P50 P45 P9 P70) div(l4 l5 l3) div(p5)",
    "div(H5 P26 P30 P14 P44) div.comments(h2 p25 p40 p18) div(l2 l2)",
    "div(l3 l4 l2) div(p4 l2 p3 l1) div(H5 P35 P28 P16) div(l1 l1)",
    "div(p2 l1 l1) div(P65 P48 M60 P80) div(l6 l7 l5)",
    "div(l2 l2 l3) div(P22 P31 P18)",
    "div(P14)",
    "P1",
    "P4",
    "div(P2)",
    "div(P8 P30)",
    "form(div(H6 P70 P55 P62 P48) p2 p3) footer(p7)",
    "form(H3 P50 P52 P47 p1)",
    "div.notice(p25) div(H6 P40 P60 P35) form(p3 p2 p4)",
    "header(p3 p8) div.banner(p16) div(P65 P48 P80) form(p2 p5 l2)",
    "div.page-form(H5 P90 P75 P64) div.legal(p28 l2)",
)


def expand(sample: str) -> tuple[str, list[bool]]:
    """The page that a sample stands for, and which of its blocks are main text."""
    out, marks, open_ = [], [], []
    words = lambda n: " ".join(["word"] * n)
    for name, kind, leaf, n, end in re.findall(r"([a-z]+)((?:\.[a-z-]+)?)\(|([A-Za-z])(\d+)|(\))", sample):
        if end:
            out.append(f"</{open_.pop()}>")
        elif name:
            open_.append(name)
            out.append(f"<{name} class='{kind[1:]}'>")
        else:
            marks.append(leaf.isupper())
            tag, text, linked = {"p": "p", "m": "p", "h": "h2"}.get(leaf.lower(), "li"), words(int(n)), int(n) // 3
            text = {"l": f"<a href='/'>{text}</a>", "m": f"<a href='/'>{words(linked)}</a> {words(int(n) - linked)}"}.get(leaf.lower(), text)
            out.append(f"<{tag}>{text}</{tag}>")
    return "".join(out), marks


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    main: bool = False


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A binary tree that splits where the Gini impurity falls most; ties go to the first feature and smallest cut."""
    if depth == 0 or y.min() == y.max():
        return Node(main=bool(y.mean() >= 0.5))

    def impurity(part: np.ndarray) -> float:
        p = part.mean()
        return len(part) * p * (1 - p)

    best = (impurity(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            best = min(best, (impurity(y[low]) + impurity(y[~low]), f, cut), key=lambda b: b[0])
    _, f, cut = best
    if f < 0:
        return Node(main=bool(y.mean() >= 0.5))
    low = x[:, f] <= cut
    return Node(f, cut, fit_tree(x[low], y[low], depth - 1), fit_tree(x[~low], y[~low], depth - 1))


def is_main(tree: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=bool)

    def go(node: Node, rows: np.ndarray) -> None:
        if node.low is None or not len(rows):
            out[rows] = node.main
            return
        low = x[rows, node.feature] <= node.cut
        go(node.low, rows[low])
        go(node.high, rows[~low])

    go(tree, np.arange(len(x)))
    return out


def labelled(samples: tuple[str, ...] = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the samples' blocks."""
    pages = [expand(x) for x in samples]
    return np.vstack([features(blocks(page)) for page, _ in pages]), np.concatenate([marks for _, marks in pages]).astype(float)


def train(samples: tuple[str, ...] = SAMPLES) -> Node:
    return fit_tree(*labelled(samples))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text string and n_chars long (its code points) in place of the html."""
    at, tree = pages.columns.index(html), train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, at):
            found = [blocks(h or "") for h in b.column(at).to_pylist()]
            # neighbours are of the same page, and all blocks are classified at once
            main = is_main(tree, np.vstack([np.zeros((0, len(FEATURES))), *[features(f) for f in found]]))
            texts, k = [], 0
            for f in found:
                texts.append("\n".join(x.text for x, m in zip(f, main[k : k + len(f)], strict=True) if m))
                k += len(f)
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*[b.schema.names[i] for i in keep], "text", "n_chars"])

    return map_rows(pages, run, "text string, n_chars long", html)
