"""Main text of web pages by minimum cuts.

A page is read once, by one pattern for tags, comments and references; every stretch of text between two block tags is a
block. A linear classifier gives each block the odds of being content: learnt weights of the text itself (length, links,
punctuation, kind, place), and stated weights of what its ancestors say of themselves (element names, roles, class words).
The odds are the capacities of the block's edges to the two terminals. Smoothness edges join blocks that follow each other
and blocks that follow each other within one parent; they are the heavier the nearer the blocks are in the tree. The minimum
cut of that graph separates content from the rest.

The learnt weights come from blocks whose ancestors leave no doubt (inside an article or the main part; inside a menu, a
footer, a form and the like), on a sample of about ``FIT_PAGES`` pages; logistic regression, bounded so that the text alone
never outweighs a clear ancestor, and drawn to stated weights, which stand where no page teaches.

A null or empty page has an empty text. Rows without an id or an address and repeated rows give a row each; an empty table
gives no rows; further columns are not looked at. Work per page grows with its length but for the cut of undecided blocks.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landlens.llm.common import map_rows, table

#: About so many pages, chosen by a hash of their text, fit the classifier.
FIT_PAGES = 2_000
#: The text's own evidence is bounded by this many units of log odds.
TEXT_BOUND = 2.5
#: Capacity of an edge between neighbours with one parent; it falls with the steps between them in the tree.
NEAR = 1.2

# Element names of the page format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset("script style template noscript head title iframe noembed noframes svg math canvas object audio video map datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FORM = frozenset("form button select option optgroup textarea input fieldset legend".split())
#: start tag -> open elements that it ends
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: an element's end tag or an implied end never reaches beyond these
SCOPE = frozenset("table td th ul ol dl article section main nav aside header footer div body html".split())

# What ancestors say of their text, in units of log odds.
BY_TAG = {"nav": -8.0, "footer": -8.0, "aside": -7.0, "form": -7.0, "dialog": -8.0, "menu": -7.0, "article": 5.0, "main": 4.0}
BY_ROLE = {
    "navigation": -8.0, "banner": -8.0, "contentinfo": -8.0, "complementary": -7.0, "search": -8.0, "form": -7.0, "dialog": -8.0, "alertdialog": -8.0,
    "alert": -7.0, "menu": -8.0, "menubar": -8.0, "toolbar": -8.0, "main": 4.0, "article": 5.0,
}
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertisment sponsor sponsored sponsors promo promos promoted promotion banner banners "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager paging sidebar sidebars sidenav rail aside widget widgets "
    "footer footers foot masthead topbar toolbar cookie cookies consent gdpr ccpa notice notices notification notifications alert alerts "
    "popup popups modal overlay lightbox newsletter subscribe subscription signup signin login register paywall "
    "comment comments commentlist disqus reply replies respond responses discussion social share sharing sharebar "
    "related recommend recommended recommendations outbrain taboola trending popular search searchbox skip copyright disclaimer "
    "hidden invisible".split()
)
GOOD_WORDS = frozenset("article post story entry main maincontent content body text prose articlebody postbody entrycontent postcontent".split())
BAD_CLASS, GOOD_CLASS, HEADING = -6.0, 2.5, 3.0
#: Blocks whose ancestors sum to this or more either way teach the classifier.
CLEAR = 4.0

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|</[^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")
_HEADING = re.compile(r"h[1-6]\Z")

#: Weights where no page teaches, and what the fit is drawn to: long texts with sentences, few links.
STATED = (-0.5, 1.0, -2.0, 0.3, 0.5, 0.0, 0.3, -0.5, 0.8, -0.8, -0.5, 0.5)
PAGE_SCHEMA = "page_id long, url string, text string, n_chars long"
FEATURES = len(STATED)


class Node:
    """An open element: its parent among the elements that are no inline ones, and what it and its ancestors say."""

    __slots__ = ("tag", "parent", "depth", "prior", "silent", "link")

    def __init__(self, tag: str, parent: Node | None, prior: float, silent: bool, link: bool):
        self.tag, self.parent, self.prior, self.silent, self.link = tag, parent, prior, silent, link
        self.depth = parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("parts", "node", "linked", "text")

    def __init__(self, node: Node):
        self.parts: list[str] = []
        self.node, self.linked, self.text = node, 0, ""


def _said(tag: str, attributes: str, inside: float) -> float:
    """Log odds of an element's text, from what its ancestors and itself say. What speaks against it outweighs all praise."""
    odds = _own(tag, attributes, inside)
    if odds < 0:
        return max(-20.0, min(inside, 1.0) + odds)
    if inside < -3:
        return inside
    if tag == "header":  # of an article: its headings belong to it
        return min(inside, 0.5)
    return min(12.0, inside + odds)


def _own(tag: str, attributes: str, inside: float) -> float:
    odds = BY_TAG.get(tag, 0.0)
    if tag == "header":
        odds = 0.0 if inside > 0 else -8.0
    elif tag in FORM:
        odds = -8.0
    elif _HEADING.match(tag) and inside > 0:
        odds = HEADING
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return odds
    words: set[str] = set()
    for name, *value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = value[0] or value[1] or value[2]
        if name in ("class", "id"):
            for one in value.split():
                words.update(w.lower() for w in _WORDS.findall(one))
                words.add(re.sub(r"[^a-z]", "", one.lower()))
        elif name == "role":
            odds += BY_ROLE.get(value.strip().lower(), 0.0)
        elif name == "itemprop":
            odds += GOOD_CLASS if value.strip().lower() == "articlebody" else 0.0
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            odds -= 8.0
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            odds -= 8.0
    # what frames the whole page says little by its class
    if tag not in ("html", "body"):
        if words & BAD_WORDS:
            odds += BAD_CLASS
        elif words & GOOD_WORDS:
            odds += GOOD_CLASS
    return odds


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order: text between two block tags, with references decoded."""
    found: list[Block] = []
    root = Node("", None, 0.0, False, False)
    stack = [(root, root)]  # open elements, each with the nearest one that is no inline element
    opened: Counter[str] = Counter()
    at, block = 0, None
    last = page.rfind(">")  # what starts behind it ends no tag

    def add(text: str) -> None:
        nonlocal block
        node, near = stack[-1]
        if node.silent or not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(near)
            found.append(block)
        text = html.unescape(text) if "&" in text else text
        block.parts.append(text)
        if node.link:
            block.linked += len(text.split())

    def close(k: int) -> None:
        for node, _ in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    while True:
        token = _TOKEN.search(page, at) if at <= last or "<!--" in page[at:] else None
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            block = None
        if token[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                name = stack[k][0].tag
                if name == tag:
                    close(k)
                    break
                if name in SCOPE and (tag in INLINE or tag in ("p", "li")):
                    break
            continue
        if tag not in INLINE:
            # a block ends an open paragraph and what that left open; some elements end others of their kind
            ends = ENDS.get(tag, frozenset())
            for k in range(len(stack) - 1, 0, -1) if opened["p"] or any(opened[x] for x in ends) else ():
                name = stack[k][0].tag
                if name == "p" or name in ends:
                    close(k)
                elif name in SCOPE:
                    break
        elif tag == "br":
            add(" ")
        if tag in VOID:
            continue
        outer, near = stack[-1]
        # only foreign elements close themselves
        if token[3].endswith("/") and tag in ("svg", "math"):
            continue
        node = Node(tag, near, _said(tag, token[3], outer.prior), outer.silent or tag in SILENT, outer.link or tag == "a")
        stack.append((node, near if tag in INLINE else node))
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            close(len(stack) - 1)
            at = end.end() if end else len(page)
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text]


def features(blocks: list[Block]) -> np.ndarray:
    """The classifier's view of each block: its text, not its ancestors."""
    out = np.zeros((len(blocks), FEATURES))
    n = len(blocks)
    total = sum(len(b.text) for b in blocks) or 1
    for k, b in enumerate(blocks):
        text = b.text
        words = text.split()
        ends = sum(w[-1] in ".!?…。！？" for w in words)
        out[k] = (
            1.0,
            math.log1p(len(words)) / 4,
            min(1.0, b.linked / len(words)),
            min(1.0, 8 * ends / len(words)),
            float(text[-1] in ".!?…。！？\"'”»"),
            min(2.0, len(text) / len(words) / 8),
            float(bool(_HEADING.match(b.node.tag))),
            float(b.node.tag == "li"),
            float(b.node.tag == "p"),
            float(any(c in text for c in "©®|»›")),
            4 * (k / max(1, n - 1) - 0.5) ** 2 if n > 1 else 0.0,
            min(1.0, 4 * len(text) / total),
        )
    return out


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side: gain > 0 ties a node to the source, gain < 0 to the sink.

    Nodes whose tie outweighs all their edges keep their side; their edges become ties of their neighbours. What is left goes
    through augmenting paths, shortest first. Nodes of no tie at all are on the sink's side.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    tie = list(gain)
    side: list[bool | None] = [None] * n
    weight = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if side[v] is None and (abs(tie[v]) > weight[v] or not near[v]):
            side[v] = tie[v] > 0
            for u, w in near[v].items():
                if side[u] is None:
                    del near[u][v]
                    weight[u] -= w
                    tie[u] += w if side[v] else -w
                    todo.append(u)
    left = [v for v in range(n) if side[v] is None]
    if not left:
        return [bool(x) for x in side]
    # residual capacities between nodes; ties are what is left of the terminals' edges
    room = {v: dict(near[v]) for v in left}
    give = {v: max(0.0, tie[v]) for v in left}
    take = {v: max(0.0, -tie[v]) for v in left}
    least = 1e-9
    while True:
        came: dict[int, int] = {v: v for v in left if give[v] > least}
        queue = deque(came)
        paths = []
        while queue:  # breadth first from every node that can still give
            v = queue.popleft()
            if take[v] > least:
                paths.append(v)
            for u, w in room[v].items():
                if w > least and u not in came:
                    came[u] = v
                    queue.append(u)
        moved = False
        for v in paths:
            path = [v]
            while came[path[-1]] != path[-1]:
                path.append(came[path[-1]])
            flow = min([take[v], give[path[-1]], *[room[b][a] for a, b in zip(path, path[1:], strict=False)]])
            if flow <= least:
                continue
            moved = True
            take[v] -= flow
            give[path[-1]] -= flow
            for a, b in zip(path, path[1:], strict=False):
                room[b][a] -= flow
                room[a][b] += flow
        if not moved:
            break
    for v in left:
        side[v] = v in came
    return [bool(x) for x in side]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges of following blocks, by their distance in the tree, and of following blocks of one parent."""
    out = []
    last: dict[Node, int] = {}
    for k, b in enumerate(blocks):
        if k:
            x, y, steps = blocks[k - 1].node, b.node, 0
            while x is not y:
                if x.depth < y.depth:
                    x, y = y, x
                x, steps = x.parent, steps + 1
            out.append((k - 1, k, NEAR / (steps + 1)))
        parent = b.node.parent or b.node
        if parent in last:
            out.append((last[parent], k, NEAR / 3))
        last[parent] = k
    return out


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The page's content blocks, one a line."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    own = np.clip(features(blocks) @ weights, -TEXT_BOUND, TEXT_BOUND)
    gain = (own + [b.node.prior for b in blocks]).tolist()
    kept = minimum_cut(gain, smoothness(blocks))
    return "\n".join(b.text for b, yes in zip(blocks, kept, strict=True) if yes)


def _teach() -> Callable[[dict[str, list]], dict[str, list]]:
    """Features of the blocks whose ancestors leave no doubt, with that verdict, a row a page."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        seen, verdict = [], []
        for page in rows["html"]:
            blocks = blocks_of(page or "")
            clear = [k for k, b in enumerate(blocks) if abs(b.node.prior) >= CLEAR]
            seen.append(features(blocks)[clear].ravel().tolist())
            verdict.append([1.0 if blocks[k].node.prior > 0 else 0.0 for k in clear])
        return {"features": seen, "verdict": verdict}

    return run


def fit_weights(pages: DataFrame, least_pages: int = FIT_PAGES) -> np.ndarray:
    """Weights of the text's features, from about ``least_pages`` different pages that a hash of the text chooses."""
    total = pages.select(F.count("html")).first()[0]
    scale = 1 << 40
    share = scale if total <= least_pages else max(1, scale * least_pages // total)
    some = pages.select("html").where(F.col("html").isNotNull() & (F.pmod(F.xxhash64("html"), F.lit(scale)) < share)).dropDuplicates()
    rows = map_rows(some, _teach, "features array<double>, verdict array<double>").collect()
    x = np.array([v for r in rows for v in r.features]).reshape(-1, FEATURES)
    y = np.array([v for r in rows for v in r.verdict])
    if len(y) == 0 or y.min() == y.max():
        return np.array(STATED)
    # both verdicts weigh alike; order of rows does not matter beyond the last digits, which are rounded off
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, stated = np.array(STATED), np.array(STATED)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.01 * len(y) * (w - stated)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * len(y) * np.eye(FEATURES)
        w -= np.linalg.solve(curve, slope)
    return np.round(w, 6)


def extract_main_text(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def make() -> Callable[[dict[str, list]], dict[str, list]]:
        def run(rows: dict[str, list]) -> dict[str, list]:
            texts = [main_text(page, weights) for page in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return run

    return map_rows(pages.select("page_id", "url", "html"), make, PAGE_SCHEMA)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; one pass to fit on a sample, one over all pages, no shuffle but the sample's."""
    pages = table(spark, sf_dir, "pages")
    return extract_main_text(pages, fit_weights(pages))
