"""HTML extraction by tag-path ratios.

Every text node has a path of tags from the root. Per path, text length and punctuation per node are summed up; the two
ratios are smoothed along the page, fused and held against a threshold, which selects the content nodes. Class and id
names only vote: they weigh a node's ratio up or down before the threshold. The main text is that of the smallest subtree
that holds all selected nodes and the title (h1), or the article around it, without nodes that are neither selected nor
free of a vote against them. Menus, footers, forms' controls and the like are told by their tags or ARIA roles.

The parser reads a page once: paths have numbers, elements nested deeper than DEEPEST are read as siblings, as browsers do.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import lean

#: Fixed values of HTML and ARIA.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul center caption option select button".split())
NOT_TEXT = frozenset("head nav footer aside menu button select option svg math canvas audio video object dialog label input".split()) | RAW
ROLES_NOT_TEXT = frozenset("navigation menu menubar toolbar search contentinfo complementary dialog alertdialog alert button listbox".split())
#: A new one of these ends an open p.
ENDS_P = BLOCK - frozenset("button option select caption tbody thead tfoot tr td th legend summary".split())
ENDS_SAME = frozenset("li dt dd option tr td th p".split())
SCOPE = frozenset("ul ol dl table div article section body blockquote".split())
DEEPEST = 512
#: Words of class, id and role names that vote against a node, and for it. Elements that vote by their tag alone.
AGAINST = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside complementary footer contentinfo comment comments respond replies reply disqus cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget masthead topbar toolbar search pagination pager skip hidden legal copyright".split())
IN_FAVOUR = frozenset("article main content post entry story body text page".split())
WEAK_TAGS = frozenset("form fieldset header".split())
#: What a vote multiplies the ratio by: for article and main; against by a whole name, by a part of one, and by a tag.
ARTICLE, NAMED, PARTLY, TAGGED = 2.0, 0.05, 0.4, 0.1
#: Share of the mean fused ratio from which a node counts as content.
THRESHOLD = 0.5
CONTAINER = BLOCK - frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote td tr ul ol dd dt".split())
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
NEXT = re.compile(r"[\"'>]")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…¿¡。，、；：！？]")


class Node:
    __slots__ = ("tag", "path", "parent", "depth", "not_text", "in_article", "vote", "number", "last")

    def __init__(self, tag: str, path: int, parent: "Node | None", number: int):
        self.tag, self.path, self.parent, self.number, self.last = tag, path, parent, number, 1 << 60
        self.depth = parent.depth + 1 if parent else 0
        self.not_text, self.in_article, self.vote = (parent.not_text, parent.in_article, parent.vote) if parent else (False, False, 1.0)

    def holds(self, other: "Node") -> bool:
        return self.number <= other.number <= self.last


def _judge(node: Node, attributes: str) -> None:
    """What an element's tag, roles and names say about the text in it."""
    tag = node.tag
    if tag in NOT_TEXT:
        node.not_text = True
    if tag in ("article", "main"):
        node.in_article = True
        node.vote *= ARTICLE if not node.parent.in_article else 1.0
    elif tag in WEAK_TAGS and not (tag == "header" and node.in_article):
        node.vote *= TAGGED
    if not attributes or tag in ("html", "body"):
        return
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            names.update(value.split())
        if name == "role" and value in ROLES_NOT_TEXT or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            node.not_text = True
    parts = {x for n in names for x in re.split("[_-]+", n)}
    if not parts & IN_FAVOUR:
        node.vote *= NAMED if names & AGAINST else PARTLY if parts & AGAINST else 1.0


def blocks(page: str) -> list[tuple[Node, str]]:
    """The text blocks of a page in order: (innermost block element, text), for all parts of the page. One pass."""
    root = Node("#root", 0, None, 0)
    paths: dict[tuple[int, str], int] = {}
    opened: Counter = Counter()
    at = holder = root
    out: list[tuple[Node, str]] = []
    buffer: list[str] = []
    n, pos, size = 0, 0, len(page)
    last_of = {c: page.rfind(c) for c in "\"'>"}
    strict = True

    def flush():
        nonlocal buffer
        if buffer:
            text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                out.append((holder, text))
            buffer = []

    def say(text: str):
        nonlocal holder
        if text:
            if not buffer:
                holder = at
            buffer.append(text)

    def close():
        nonlocal at
        if at.tag in BLOCK or at.tag in NOT_TEXT:
            flush()
        opened[at.tag] -= 1
        at.last = n
        at = at.parent

    def tag_end(start: int) -> int:
        """Where the tag ends whose attributes begin here: at the first > outside quotes, or the first one at all."""
        nonlocal strict
        i = start
        while strict and i <= last_of[">"]:
            m = NEXT.search(page, i)
            if m[0] == ">":
                return m.start()
            if last_of[m[0]] <= m.start():  # a quote that nothing closes
                i = m.end()
                continue
            i = page.find(m[0], m.end()) + 1
        strict = strict and start > last_of[">"]  # a quote stays open to the end: from here on, tags end at their first >
        return page.find(">", start)

    while pos < size:
        lt = page.find("<", pos)
        if lt < 0:
            say(page[pos:])
            break
        say(page[pos:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = end + 3 if end >= 0 else size
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            pos = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            pos = end + 1 if end >= 0 else size
            continue
        m = NAME.match(page, lt + 1)
        end = tag_end(m.end()) if m else -1
        if end < 0:
            say("<")
            pos = lt + 1
            continue
        pos = end + 1
        tag, attributes = m[2].lower(), page[m.end() : end]
        if m[1]:
            if opened[tag]:
                while at.tag != tag:
                    close()
                close()
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK or tag in NOT_TEXT:
            flush()
        if tag in ENDS_P or tag in ENDS_SAME:
            ends = {tag} if tag in ENDS_SAME else set()
            if tag in ENDS_P:
                ends.add("p")
            if tag in ("dt", "dd"):
                ends |= {"dt", "dd"}
            if any(opened[e] for e in ends):
                up = at
                while up.parent is not None and up.tag not in ends and up.tag not in SCOPE:
                    up = up.parent
                if up.parent is not None and up.tag in ends:
                    while at is not up:
                        close()
                    close()
        if tag == "br":
            if buffer:
                buffer.append(" ")
            continue
        if tag in VOID:
            continue
        if at.depth >= DEEPEST:
            close()
        n += 1
        at = Node(tag, paths.setdefault((at.path, tag), len(paths) + 1), at, n)
        opened[tag] += 1
        _judge(at, attributes)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            pos = found.end() if found else size
            close()
        elif attributes.endswith("/") and tag not in BLOCK:
            close()
    flush()
    while at.parent is not None:
        close()
    return out


def scores(nodes: list[tuple[Node, str]], spread: float = 1.0) -> np.ndarray:
    """Length ratio times punctuation ratio of each node's path, both smoothed along the page by a Gaussian, times the vote."""
    total: dict[int, list[int]] = {}
    for node, text in nodes:
        t = total.setdefault(node.path, [0, 0, 0])
        t[0] += 1
        t[1] += len(text)
        t[2] += len(PUNCTUATION.findall(text))
    length = np.array([total[x.path][1] / total[x.path][0] for x, _ in nodes])
    points = np.array([(1 + total[x.path][2]) / total[x.path][0] for x, _ in nodes])
    reach = int(np.ceil(spread))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * spread * spread))
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, reach, mode="edge"), kernel, mode="valid")
    return smooth(length) * smooth(points) * np.array([x.vote for x, _ in nodes])


def main_text(page: str, threshold: float = THRESHOLD) -> str:
    """The main text of a page; empty where there is none."""
    nodes = [(x, t) for x, t in blocks(page) if not x.not_text]
    if not nodes:
        return ""
    fused = scores(nodes)
    chosen = fused >= threshold * fused.mean()
    held = np.flatnonzero(chosen | np.array([x.tag == "h1" for x, _ in nodes]))
    first, last = nodes[held[0]][0], nodes[held[-1]][0]
    top = first
    while not (top.holds(first) and top.holds(last)):  # nodes are numbered in page order, so all between are held too
        top = top.parent
    around = top
    while around is not None and around.tag != "article":
        around = around.parent
    if around is None:
        around = top
        while around is not None and around.tag != "main":
            around = around.parent
    if around is not None:
        top = around
    while top.parent is not None and top.tag not in CONTAINER:
        top = top.parent
    lo, hi = (0, len(nodes)) if top.tag not in ("body", "html", "#root") else (held[0], held[-1] + 1)
    return "\n".join(t for i, (x, t) in enumerate(nodes) if lo <= i < hi and top.holds(x) and (chosen[i] or x.tag == "h1" or x.vote >= top.vote))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row; null and empty html give an empty text; repeated rows a row each; a null
    page_id or url stays null; an empty table gives no rows; other columns are ignored. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                texts = [main_text(h) if h else "" for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
