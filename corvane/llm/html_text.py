"""Main text of HTML pages: flat text blocks, features of a block and its neighbours, and a decision tree.

A page becomes a flat row of blocks: runs of text between block-level tags, with the number of words and the share of words in
links. The tree sees a block's words and link density and those of its two neighbours. Besides, it sees weak marks: how an
element around the block is named (a landmark of menus and the like, or a class or id that names one), whether the block is in an article,
how much other text is in one, the share of the page's plain words in the block's region, and whether it is a heading or in a list. No mark decides alone: an element that holds the page's article is a wrapper, whatever its name,
and a name around most of the words counts for less. The tree is grown by Gini impurity on the hand-labelled block table
`html_blocks.tsv` beside this module. Blocks that it calls main text are joined in page order.

Each page is handled by itself, in time linear in its length; nothing is shuffled or broadcast but the tree.

Defined results: a null or empty html, and one without main text, give the empty text. Markup that is never closed ends with
the page. Repeated rows and null ids give rows of their own. Further columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from html import unescape
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

TABLE = Path(__file__).with_name("html_blocks.tsv")
#: A comment, a tag with its attributes, or another declaration; each also ends with the page, so no place is tried twice.
TOKEN = re.compile(r"<!--(?:.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>\"']++))?")
#: Elements whose text is never shown as text of the page; of the second kind, one that is never closed holds nothing.
RAW = frozenset("script style noscript template iframe title textarea head".split())
UNSHOWN = frozenset("svg math object canvas audio video select datalist button".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HELD = frozenset("html body article main section div nav header footer aside form menu dialog ul ol li dl dd dt table tbody thead tfoot tr td th figure blockquote fieldset details search".split())
#: Elements that count as the container of their own text; lists, tables, quotations and parts of an article belong to what is around them.
CONTAINERS = frozenset("html body article main section div nav header footer aside form menu dialog fieldset details search".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
LANDMARKS = frozenset("nav footer aside menu dialog search".split())
#: Words in a class, id or role that name what is not main text, those of readers' comments apart.
NAMES = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar aside nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs footer foot footnav header masthead topbar toolbar widget widgets pagination pager copyright legal login signin search skip contentinfo complementary dialog hidden".split())
REPLIES = frozenset("comment comments commentlist reply replies respond responses disqus discussion".split())
#: Words beside a name that say what an element has or lacks, not what it is.
STATES = frozenset("has have no not with without is are open opened closed free off on active enabled disabled visible toggled loaded ready fixed sticky aware less js".split())
FEATURES = ("words", "density", "before_words", "before_density", "after_words", "after_density", "mark", "article", "rival", "region", "heading", "item")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    element: int
    heading: bool
    item: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class Page:
    """Blocks in order, and the elements around them: parent, mark (0 to 3), kind (1 article, 2 main), nearest container."""

    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    container: list[int] = field(default_factory=list)

    def opened(self, parent: int, mark: int, kind: int, contains: bool) -> int:
        at = len(self.parent)
        self.parent.append(parent)
        self.mark.append(mark)
        self.kind.append(kind)
        self.container.append(at if contains else self.container[parent])
        return at


def named(value: str) -> int:
    """How strongly a class, id or role names what isn't main text: 3 readers' comments, 2 a name, 1 a name with further words, 0 none."""
    found = 0
    for token in value.split():
        parts = [x.lower() for x in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", token) if x]
        if not parts or STATES & set(parts):
            continue
        if REPLIES & {parts[0], parts[-1]}:
            return 3
        if NAMES & set(parts):
            found = max(found, 2 if token.lower() in NAMES else 1)
    return found


def _marks(tag: str, attributes: str, inside: bool) -> tuple[int, int]:
    """mark, kind of an element that opens, `inside` an article or not."""
    mark = 3 if tag in LANDMARKS else 2 if tag == "form" or (tag == "header" and not inside) else 0
    kind = 2 if tag == "main" else 1 if tag == "article" else 0
    if attributes and tag not in ("html", "body"):
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                mark = max(mark, 2)
            elif key == "role" and value.lower() == "main":
                kind = 2
            elif key in ("class", "id", "role") and not (inside and value.lower() in ("header", "foot")) and not kind:
                mark = max(mark, named(value))
    return mark, kind


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)" + (r"|(?=<body\b)" if tag == "head" else ""), re.I)


def parsed(html: str) -> Page:
    """The text blocks of a page in order, and the elements around them."""
    page = Page()
    page.parent, page.mark, page.kind, page.container = [0], [0], [0], [0]
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    unclosed: set[str] = set()
    held: list[tuple[str, bool]] = []
    links, heading, here, line, articles = 0, False, 0, None, 0

    def close() -> None:
        if held:
            text = " ".join(unescape("".join(x for x, _ in held)).split())
            if text:
                words = text.count(" ") + 1
                linked = sum(len(unescape(x).split()) for x, inside in held if inside)
                page.blocks.append(Block(text, words, min(words, linked), here if line is None else line, heading, bool(opened.get("li"))))
            held.clear()

    def leave() -> str:
        nonlocal here, articles
        tag, at = stack.pop()
        opened[tag] -= 1
        articles -= page.kind[at] > 0
        here = stack[-1][1] if stack else 0
        return tag

    at = 0
    while at < len(html):
        found = TOKEN.search(html, at)
        if not found:
            held.append((html[at:], links > 0))
            break
        if found.start() > at:
            held.append((html[at : found.start()], links > 0))
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                links = 0
            elif tag in BLOCKS:
                close()
                heading, line = False, None
                if opened.get(tag):
                    while leave() != tag:
                        pass
                    links = 0
        elif tag in RAW or (tag in UNSHOWN and tag not in unclosed):
            if tag in ("script", "style", "noscript", "template", "iframe", "canvas", "audio", "video", "datalist", "textarea"):
                held.append((" ", False))
            if not (tag in UNSHOWN and found[3].endswith("/")):
                end = _end_of(tag).search(html, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    break
                else:
                    unclosed.add(tag)
        elif tag == "a":
            links = 1
        elif tag == "br":
            held.append((" ", False))
        elif tag in BLOCKS:
            close()
            heading, line = tag in LINES and tag != "p", None
            if tag in HELD:
                links = 0
                if tag == "li" and stack and stack[-1][0] == "li":
                    leave()
                mark, kind = _marks(tag, found[3], articles > 0)
                here = page.opened(here, mark, kind, tag in CONTAINERS and not (articles and not kind))
                stack.append((tag, here))
                opened[tag] = opened.get(tag, 0) + 1
                articles += kind > 0
            elif tag in LINES and found[3] and (mark := _marks(tag, found[3], articles > 0)[0]):
                line = page.opened(here, mark, 0, False)
    close()
    return page


def features(page: Page) -> np.ndarray:
    """One row for each block, by FEATURES."""
    blocks, n, m = page.blocks, len(page.blocks), len(page.parent)
    own = np.array([(x.words, x.density) for x in blocks], dtype=np.float64).reshape(n, 2)
    before, after = np.zeros((n, 2)), np.zeros((n, 2))
    before[1:], after[:-1] = own[:-1], own[1:]

    # Plain words of each element, those in articles of it, and of the outermost article that it is in.
    plain, stories, mains = [0] * m, [0] * m, [x == 2 for x in page.kind]
    article, closed = [0] * m, [False] * m
    for e in range(1, m):
        p = page.parent[e]
        closed[e] = closed[p] or page.mark[e] == 3
        article[e] = article[p] or (e if page.kind[e] and not closed[e] else 0)
    for x in blocks:
        plain[x.element] += x.words - x.linked
        stories[x.element] += (x.words - x.linked) if article[x.element] else 0
    for e in range(m - 1, 0, -1):
        p = page.parent[e]
        plain[p] += plain[e]
        stories[p] += stories[e]
        mains[p] = mains[p] or mains[e]
    every, told = max(plain[0], 1), stories[0]

    # The strongest mark around a block, of elements that don't hold the article, and the share of words in the outermost such element.
    mark, share = [0] * m, [0.0] * m
    for e in range(1, m):
        p = page.parent[e]
        mark[e], share[e] = mark[p], share[p]
        holds = mains[e] or (page.mark[e] < 3 and told and 2 * stories[e] >= told and 4 * stories[e] >= every)
        if page.mark[e] > mark[e] and not holds:
            mark[e], share[e] = page.mark[e], max(share[p], plain[e] / every)

    direct = [0] * m
    inside, unmarked = 0, 1
    for x in blocks:
        if not mark[x.element]:
            direct[page.container[x.element]] += x.words - x.linked
            unmarked += x.words - x.linked
            inside += (x.words - x.linked) if article[x.element] else 0
    # A block's region: the outermost element that marks it, else its container, or what the container's parent has in small
    # containers side by side, whichever holds more words; as a share of all words, or of those without a mark.
    spread = [0] * m
    small = [4 * x <= unmarked for x in direct]
    for e in range(1, m):
        if page.container[e] == e and small[e] and not mark[e]:
            spread[page.container[page.parent[e]]] += direct[e]
    rows = []
    for x in blocks:
        e, at = x.element, page.container[x.element]
        region = share[e] if mark[e] else min(1.0, max(direct[at], spread[page.container[page.parent[at]]] if small[at] else 0) / unmarked)
        rows.append((mark[e], article[e] > 0, 0.0 if article[e] else inside / unmarked, region, x.heading, x.item))
    return np.hstack([own, before, after, np.array(rows, dtype=np.float64).reshape(n, 6)])


class Tree:
    """A binary decision tree grown by Gini impurity: nodes (feature, threshold, left, right), or (-1, share of label 1)."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 12, least: int = 2) -> None:
        self.nodes: list[tuple] = []
        self._grow(rows, labels.astype(np.float64), depth, least)

    def _grow(self, rows: np.ndarray, labels: np.ndarray, depth: int, least: int) -> int:
        place, best = len(self.nodes), None
        self.nodes.append((-1, float(labels.mean())))
        if depth and 0 < labels.sum() < len(labels):
            for f in range(rows.shape[1]):
                order = np.argsort(rows[:, f], kind="stable")
                x, y = rows[order, f], labels[order]
                n = np.arange(1, len(y))
                ones = np.cumsum(y)[:-1]
                left, right = ones / n, (y.sum() - ones) / (len(y) - n)
                impurity = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
                valid = (x[1:] > x[:-1]) & (n >= least) & (len(y) - n >= least)
                if valid.any():
                    i = int(np.argmin(np.where(valid, impurity, np.inf)))
                    if best is None or impurity[i] < best[0] - 1e-12:
                        best = (impurity[i], f, (x[i] + x[i + 1]) / 2)
        if best:
            go = rows[:, best[1]] <= best[2]
            self.nodes[place] = (best[1], best[2], self._grow(rows[go], labels[go], depth - 1, least), self._grow(rows[~go], labels[~go], depth - 1, least))
        return place

    def share(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 in each row's leaf."""
        out = np.empty(len(rows))
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if len(self.nodes[node]) == 2:
                out[at] = self.nodes[node][1]
            else:
                f, threshold, left, right = self.nodes[node]
                go = rows[at, f] <= threshold
                todo += [(left, at[go]), (right, at[~go])]
        return out


def table_pages() -> list[tuple[str, list[int]]]:
    """The labelled table's pages as html, with the labels of their blocks. A row has a label, the path of elements down to the
    block's own, its words and how many of them are linked; rows of one page that follow each other share what their paths share."""
    pages: list[tuple[str, list[int]]] = []
    out, labels, path = [], [], []

    def tags(part: str) -> str:
        tag, *marks = re.split(r"(?=[.#])", part)
        classes = " ".join(x[1:] for x in marks if x[0] == ".")
        ids = "".join(f' id="{x[1:]}"' for x in marks if x[0] == "#")
        return f"<{tag}" + (f' class="{classes}"' if classes else "") + ids + ">"

    def finish() -> None:
        if labels:
            pages.append(("".join(out), list(labels)))
        out.clear()
        labels.clear()
        path.clear()

    for row in TABLE.read_text(encoding="utf-8").splitlines():
        if not row or row.startswith("#"):
            finish()
            continue
        label, parts, words, linked = row.split("\t")
        parts = parts.split(">")
        keep = 0
        while keep < min(len(path), len(parts) - 1) and path[keep] == parts[keep]:
            keep += 1
        out.append("".join(f"</{re.split('[.#]', x)[0]}>" for x in reversed(path[keep:])) + "".join(map(tags, parts[keep:])))
        path[:] = parts
        a, b = int(linked), int(words) - int(linked)
        out.append(f'<a href="#">{"w " * a}</a> ' * (a > 0) + "w " * b)
        labels.append(int(label))
    finish()
    return pages


def trained() -> Tree:
    """The tree of the labelled table's blocks."""
    rows, labels = [], []
    for html, wanted in table_pages():
        page = parsed(html)
        if len(page.blocks) != len(wanted):
            raise ValueError(f"{len(page.blocks)} blocks for {len(wanted)} rows: {html[:200]}")
        rows.append(features(page))
        labels += wanted
    return Tree(np.vstack(rows), np.array(labels))


def main_text(html: str, tree: Tree) -> str:
    page = parsed(html)
    if not page.blocks:
        return ""
    return "\n\n".join(x.text for x, share in zip(page.blocks, tree.share(features(page)), strict=True) if share >= 0.5)


def extracted(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = tree or trained()

    def step(batch: dict) -> dict:
        texts = [main_text(x.as_py(), tree) for x in batch["html"]]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]}

    own = common.pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return common.per_batch(own, step, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"))
