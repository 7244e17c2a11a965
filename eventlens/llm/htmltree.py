"""Main text of HTML pages by a tree-structured graphical model.

Every element and every text block of a page is a node that is content or not. A node's features (what its tag and its
class say, how much text it has, how much of it is links) depend on its label, and its label depends on its parent's.
Messages go up from the leaves and down from the root (sum-product), which gives the exact probability of content for
each block. The potentials are smoothed counts over labelled pages: pages that name their main part (``article`` or
``main``) label their own nodes, and every other page is read with what was learned from them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages used in training, at most about so many (all when there are fewer).
TRAIN_PAGES = 2_000
#: Attributes as HTML has them: a quote opens a value only behind an equals sign; one that is never closed is a letter.
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(" + _ATTRIBUTES + r")(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none")
# Fixed values of the format: elements without content, without text, with raw text, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg annotation".split())
NESTED = frozenset("svg template".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr object
math semantics mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose""".split())
#: A start tag of the value's set ends an open element of the key.
ENDS = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
        "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr", "tbody"]),
        "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option", "optgroup"])}
#: What a list item or cell never reaches beyond.
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "p": ("div", "article", "section", "main", "td", "li", "body", "aside", "blockquote")}
#: Words of tags, classes, ids and roles that speak for one side (fixed values).
ASIDE = frozenset("""ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs button comment comments consent cookie cookies copyright dialog disqus
disclaimer feedback foot footer form header hidden login masthead menu menubar modal nav navbar navigation navigationmenu newsletter notice notices pager pagination popup promo promotion
promoted recommend recommended register related replies reply respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets
complementary contentinfo reader select fieldset""".split())
MAIN = frozenset("article articlebody body content entry main maincontent post story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose size and links say something about them; of boxes only the hint counts.
SPEAKING = HEADINGS | frozenset("p blockquote pre li dt dd td th tr ul ol dl table tbody thead".split())


class Node:
    __slots__ = ("tag", "parent", "children", "text", "size", "linked", "hint", "label")

    def __init__(self, tag: str, parent: "Node | None", hint: str = "none"):
        self.tag, self.parent, self.children, self.text, self.size, self.linked, self.hint, self.label = tag, parent, [], None, 0, 0, hint, 0
        if parent is not None:
            parent.children.append(self)


def hint_of(tag: str, attributes: str) -> str:
    """What the tag, class, id and role say: ``aside``, ``main`` or ``none``."""
    if tag in ("html", "body"):
        return "none"
    words, hidden = {tag}, False
    if "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role"):
                words.update(_TOKEN.findall(value))
            hidden = hidden or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(_NO_DISPLAY.search(value))
    if hidden or words & ASIDE:
        return "aside"
    return "main" if tag in ("article", "main") or len(words) > 1 and words & MAIN else "none"


def raw_ends(page: str, tag: str) -> dict[int, int]:
    """Place behind a start tag -> place behind its end tag, for the closed elements ``tag`` of a page, in one reading.

    svg and template may hold others of their kind; any other one ends with the first end tag.
    """
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in re.compile(f"<(/?){tag}(?=[\\s/>]|\\Z){_ATTRIBUTES}(?:>|\\Z)", re.I).finditer(page):
        if not m[1]:
            open_.append(m.end())
        elif tag in NESTED:
            if open_:
                out[open_.pop()] = m.end()
        else:
            out.update(dict.fromkeys(open_, m.end()))
            open_.clear()
    return out


def raw_stop(page: str, pos: int, tag: str, parent: Node) -> int:
    """Where an element that is never closed ends: with an element that it lies in, svg also where a paragraph, heading, list or table begins, or with the page."""
    ends = "|".join(sorted({x.tag for x in _line(parent) if x.parent is not None and x.tag.isalnum()}))
    stops = ([f"</(?:{ends})(?=[\\s>])"] if ends else []) + [r"<(?:p|div|h[1-6]|ul|ol|dl|table|pre|blockquote)(?=[\s>])"] * (tag == "svg")
    stop = re.compile("|".join(stops), re.I).search(page, pos) if stops else None
    return stop.start() if stop else len(page)


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first. Text blocks are leaves; lines broken only by inline elements are one block."""
    root = Node("html", None)
    nodes, at = [root], root
    parts: list[str] = []
    linked, link = 0, 0
    raw: dict[str, dict[int, int]] = {}

    def close_block():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                leaf = Node("#text", at)
                leaf.text, leaf.size, leaf.linked = text, len(text), min(linked, len(text))
                nodes.append(leaf)
            parts, linked = [], 0

    pos, n = 0, len(page)
    while pos < n:
        start = page.find("<", pos)
        if start < 0:
            start = n
        if start > pos:
            data = page[pos:start]
            data = entities.unescape(data) if "&" in data else data
            parts.append(data)
            linked += len(data.strip()) if link else 0
        if start == n:
            break
        m = _PIECE.match(page, start)
        if not m:  # a bare sign
            parts.append("<")
            pos = start + 1
            continue
        pos = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            if tag in ("br", "img"):
                parts.append(" ")
            continue
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                if tag not in raw:
                    raw[tag] = raw_ends(page, tag)
                pos = raw[tag].get(pos) or raw_stop(page, pos, tag, at)
            continue
        close_block()
        if tag in VOID:
            continue
        if closing:
            link = 0
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            continue
        if tag in ("html", "body") and tag == "html":
            continue
        up = at
        while up.parent is not None:
            if tag in ENDS.get(up.tag, ()):
                at = up.parent
                break
            if up.tag in SCOPE.get(tag, ()) or up.tag not in ENDS and tag not in ("li", "dt", "dd", "tr", "td", "th", "option"):
                break
            up = up.parent
        hint = hint_of(tag, m[3])
        if tag == "header" and any(x.hint == "main" for x in _line(at)):
            hint = "none"  # the head of the article itself
        at = Node(tag, at, hint)
        nodes.append(at)
        if m[3].endswith("/"):
            at = at.parent
    close_block()
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.linked += x.linked
    return nodes


def _line(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def features(x: Node) -> tuple[str, ...]:
    if x.tag != "#text" and x.tag not in SPEAKING:
        return (f"hint={x.hint}",)
    kind = ("text" if x.tag == "#text" else "heading" if x.tag in HEADINGS else "paragraph" if x.tag in ("p", "blockquote", "pre") else "item" if x.tag in ("li", "dt", "dd", "td", "th", "tr") else "list")
    size = "0" if not x.size else "s" if x.size < 40 else "m" if x.size < 200 else "l"
    share = x.linked / x.size if x.size else 0
    return (f"{kind}:size={size}", f"{kind}:links={'none' if share < 0.1 else 'some' if share < 0.5 else 'most'}", f"hint={x.hint}")


def label(nodes: list[Node]) -> bool:
    """Mark the nodes of a page that names its main part; False for a page that does not."""
    if not any(x.tag in ("article", "main") for x in nodes):
        return False
    for x in nodes:
        above = x.parent.label if x.parent is not None else 0
        x.label = 0 if x.hint == "aside" else 1 if above or x.hint == "main" else 0
    return True


def counts_of(nodes: list[Node]) -> Counter:
    """What a labelled page adds to the potentials."""
    out: Counter = Counter()
    for x in nodes:
        for f in features(x):
            out[("f", f, x.label)] += 1
        out[("n", "", x.label)] += 1
        if x.parent is not None:
            out[("e", str(x.parent.label), x.label)] += 1
    return out


#: Pseudo-counts that give the hints a meaning before any page is seen: (kind, name, label) -> count.
PRIOR = {("f", "hint=aside", 0): 200, ("f", "hint=aside", 1): 0.02, ("f", "hint=main", 1): 20, ("f", "hint=main", 0): 1, ("f", "hint=none", 0): 20, ("f", "hint=none", 1): 20,
         ("e", "0", 0): 200, ("e", "0", 1): 10, ("e", "1", 1): 200, ("e", "1", 0): 4, ("n", "", 0): 10, ("n", "", 1): 10}


#: Strength of the priors: what labelled pages say about transitions and hints weighs at most so many observations against
#: the pseudo-counts above, since pages label themselves by those same hints. ``LOOKS``: weight of looks among siblings.
SAY, LOOKS = 400, 0.5


class TreeModel:
    """Potentials from counts: log P(feature | label) and log P(label | parent's label)."""

    def __init__(self, counts: dict[tuple[str, str, int], float]):
        total = Counter(PRIOR)
        for kind, name in {(k[0], k[1] if k[0] == "e" else k[1].split("=")[0]) for k in counts}:
            for y in (0, 1):  # so that the priors keep a say, transitions and hints count at most ``SAY`` times for each label
                own = {k: v for k, v in counts.items() if k[0] == kind and (kind == "e" and k[1] == name or kind != "e" and k[1].split("=")[0] == name and k[2] == y)}
                if kind == "e" and y:
                    continue
                scale = min(1.0, SAY / max(sum(own.values()), 1)) if kind == "e" or name == "hint" else 1.0
                for k, v in own.items():
                    total[k] += v * scale
        names = sorted({k[1] for k in total if k[0] == "f"})
        groups: dict[str, list[str]] = {}
        for f in names:
            groups.setdefault(f.split("=")[0], []).append(f)
        self.unary: dict[str, tuple[float, float]] = {}
        for members in groups.values():
            sums = [sum(total[("f", f, y)] + 1 for f in members) for y in (0, 1)]
            for f in members:
                self.unary[f] = tuple(log((total[("f", f, y)] + (0.02 if f.startswith("hint") else 1)) / sums[y]) for y in (0, 1))
        self.edge = [[log((total[("e", str(p), y)] + 1) / (total[("e", str(p), 0)] + total[("e", str(p), 1)] + 2)) for y in (0, 1)] for p in (0, 1)]
        self.root = [log(0.95), log(0.05)]

    def own(self, x: Node) -> list[float]:
        """Log potentials of a node by itself, for both labels.

        Looks count less among many siblings, or a long run of like blocks would outvote what names their parent. A node
        without a name says nothing: its label follows its parent's and its own looks.
        """
        a = b = 0.0
        weight = LOOKS / len(x.parent.children) if x.parent is not None else 0.0
        for f in features(x):
            if f == "hint=none":
                continue
            u = self.unary.get(f, (0.0, 0.0))
            w = 1.0 if f[:5] == "hint=" else weight
            a, b = a + w * u[0], b + w * u[1]
        return [a, b]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node, by one pass of messages up and one down."""
        at = {id(x): k for k, x in enumerate(nodes)}
        own = [self.own(x) for x in nodes]
        up = [[0.0, 0.0] for _ in nodes]  # what a node tells its parent, by the parent's label
        for k in range(len(nodes) - 1, 0, -1):
            p = at[id(nodes[k].parent)]
            for y in (0, 1):
                up[k][y] = _add(self.edge[y][0] + own[k][0], self.edge[y][1] + own[k][1])
            own[p][0] += up[k][0]
            own[p][1] += up[k][1]
        down = [[0.0, 0.0] for _ in nodes]
        down[0] = list(self.root)
        out = []
        for k, x in enumerate(nodes):
            if k:
                p = at[id(x.parent)]
                rest = [down[p][y] + own[p][y] - up[k][y] for y in (0, 1)]
                down[k] = [_add(rest[0] + self.edge[0][y], rest[1] + self.edge[1][y]) for y in (0, 1)]
            a, b = (down[k][y] + own[k][y] for y in (0, 1))
            out.append(1 / (1 + exp(min(700.0, max(-700.0, a - b)))))
        return out

    def blocks(self, page: str) -> list[tuple[str, float]]:
        """(block, probability of content) in page order."""
        nodes = parse(page)
        return [(x.text, p) for x, p in zip(nodes, self.marginals(nodes)) if x.text is not None]

    def text(self, page: str) -> str:
        return "\n".join(t for t, p in self.blocks(page) if p >= 0.5)


def _add(a: float, b: float) -> float:
    """log(exp a + exp b)."""
    return a + log(1 + exp(b - a)) if a >= b else b + log(1 + exp(a - b))


def train(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> TreeModel:
    """Potentials from about ``train_pages`` pages, drawn by a hash of the page, that name their main part.

    Each task counts for itself; the counts of a few dozen features reach the driver. Without such pages the priors hold.
    """
    rows = pages.select(F.col(html_col).alias("html")).where("html IS NOT NULL")
    total = rows.count()
    if total > train_pages:
        rows = rows.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < int(1_000_000 * train_pages / total))

    def run(batches):
        sums: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                nodes = parse(x.as_py())
                if label(nodes):
                    sums.update(counts_of(nodes))
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()),
                                          pa.array([sums[k] for k in keys], pa.int64())], ["kind", "name", "label", "n"])

    counts = rows.mapInArrow(run, "kind string, name string, label int, n long").groupBy("kind", "name", "label").agg(F.sum("n").alias("n"))
    return TreeModel({(r.kind, r.name, r.label): r.n for r in counts.collect()})


def main_text(pages: DataFrame, html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page from its whole html.

    Null html counts as empty and gives an empty text; repeated rows give repeated rows; other columns are not read; an
    empty table gives an empty one.
    """
    fitted = model or train(pages, html_col)

    def run(batches):
        for b in batches:
            texts = [fitted.text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(html_col, F.lit("")).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
