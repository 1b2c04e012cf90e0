"""Main-text extraction by composite text density.

A page becomes a tree. Elements and roles that are never article text (menus,
page headers and footers, sidebars, scripts, hidden parts) are left out as they
are read. Names of classes and ids are no more than a prior: a part whose name
marks it (or a form) goes if the page has its text elsewhere, and stays if it
holds the article, or nearly all that is outside such parts.

Each remaining node gets its link-adjusted density: characters outside links
per tag outside links. The block whose children's densities have the largest
sum is the core; the smallest density on its path to the body is the threshold.
A core in an article element stands for that element. Elsewhere it is joined by
what stands beside it and isn't mostly links, and by blocks farther up that
reach the threshold and are of a size with it; lists of links in it go.
"""

from __future__ import annotations

import heapq
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, table, text_or_empty

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*>""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
FOREIGN = frozenset({"svg", "math"})
DROPPED = RAW | frozenset("head nav footer aside button select option input object embed canvas audio video dialog menu label fieldset datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot dd dt li".split()) | {"li", "dd", "dt", "table"}
#: A start tag ends an open element of the first set, looked for up to an element of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: An end tag doesn't close anything beyond these.
WALLS = frozenset("article body main td th table".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark a part as no article text (fixed values).
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner"
    " nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager"
    " sidebar aside rail widget widgets footer masthead topbar"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall disclaimer"
    " comment comments commentlist respond replies reply disqus discussion"
    " share sharing social related recommended recommendations newsletter subscribe subscription signup login"
    " form search skip".split()
)
#: A name that is one of these words alone is never article text unless an article element is inside (fixed values).
CERTAIN = frozenset(
    "ad ads advert adverts advertisement advertising adsense navbar breadcrumb breadcrumbs pagination pager cookie cookies gdpr"
    " comment comments commentlist disqus newsletter share sharing".split()
)
#: Words that may follow a marking word in a name (fixed values).
AFTER = frozenset(
    "area bar block body bottom box button buttons column container content copy display dialog group header heading holder icon icons inner"
    " item items layer left link links list main message outer panel placeholder policy popup posts right row section short slot space"
    " stories strip text thread title top tray unit unit widget wrap wrapper zone".split()
)
#: Words of names that tell of a part's layout or state, not of what it holds (fixed values).
STATES = frozenset("has no not with without is on off open closed enabled disabled allow hide show layout for".split())
ROOTS = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of text: they stand with what is around them and are never the core.
TEXTUAL = HEADINGS | frozenset("p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption details summary address hr".split())
#: A part stays in spite of its name if it has so many times the text outside such parts.
OUTWEIGHS = 10
#: A block farther up counts as content if it has this share of the core's text; an article element, of the page's.
SHARE = 0.2
#: A block is a list of links from so many links on, if they hold half of its text.
LINKS = 3


def marking(name: str) -> bool:
    """If a class or id, as a whole, names a part that is no article text."""
    parts = [w.lower() for w in PART.findall(name)]
    if not parts or STATES.intersection(parts):
        return False
    return parts[-1] in MARKS or parts[0] in MARKS and all(w in AFTER or w in MARKS or w.isdigit() for w in parts[1:])


def judge(tag: str, attributes: str, in_article: bool) -> tuple[bool, tuple[str, ...], bool]:
    """Of a start tag: if its part is dropped for certain, the names that speak against it, and if it is an article's root."""
    against: list[str] = ["<form>"] if tag == "form" else []
    root = tag in ROOTS
    if tag in DROPPED or tag == "header" and not in_article:
        return True, (), False
    if tag in ("html", "body") or not attributes or attributes.isspace():
        return False, tuple(against), root
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names = value.split()
            against += [w for w in names if marking(w) or not in_article and w.lower() in ("header", "site-header", "page-header")]
        elif name == "role":
            role = value.lower()
            if role in ROLES and not root:
                return True, (), False
            root |= role in ROOTS
            against += ["<form>"] if role == "form" else []
        elif name == "itemprop" and value == "articleBody":
            root = True
        elif (
            name == "hidden"
            or name == "aria-hidden" and value.lower() == "true"
            or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)
        ):
            return True, (), False
    if tag in ROOTS:
        # An element that says it is the article, against its name: only a reader's comment is none.
        against = [w for w in against if {"comment", "comments", "reply", "replies"}.intersection(x.lower() for x in PART.findall(w))]
    return False, tuple(against), root and not against


class Node:
    __slots__ = ("against", "chars", "children", "density", "free", "inside", "links", "link_tags", "parent", "plain", "root", "skip", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, inside: bool, against: tuple[str, ...] = (), root: bool = False):
        self.tag, self.parent, self.inside, self.against, self.root, self.children = tag, parent, inside, against, root, []
        self.chars = self.links = self.tags = self.link_tags = self.free = self.plain = 0
        self.density = self.sum = 0.0
        self.skip = False

    @property
    def linked(self) -> bool:
        """Mostly links."""
        return self.link_tags >= LINKS and 2 * self.links >= self.chars


def parse(page: str) -> Node:
    """The tree of what isn't dropped for certain. Children are nodes, and texts that are decoded already."""
    root = now = Node("body", None, False)
    at = 0
    lost: Node | None = None  # the innermost dropped element that is open
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at and lost is None:
            now.children.append(unescape(page[at:end]))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = lost or now
            walls = WALLS - {tag}
            while node is not None and node.tag != tag and node.tag not in walls:
                node = node.parent
            if node is not None and node.tag == tag and node.parent is not None:
                inner = lost
                while inner is not None and inner is not node and inner.parent is not now:
                    inner = inner.parent
                if lost is not None and inner is node:
                    lost = node.parent if node.parent is not now else None
                elif lost is None or tag in ("body", "article", "main"):
                    lost, now = None, node.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            if tag in FOREIGN and m[3].rstrip().endswith("/"):
                continue
            close = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            at = close.start() if close else size
            at = page.find(">", at) + 1 or size
            continue
        if tag in VOID:
            if lost is None and tag == "hr":
                now = _imply(now, tag)
                now.children.append(Node(tag, now, now.inside))
            elif lost is None and tag in ("br", "wbr"):
                now.children.append(" " if tag == "br" else "")
            continue
        if lost is None:
            now = _imply(now, tag)
            gone, against, is_root = judge(tag, m[3], now.inside)
            if gone:
                lost = Node(tag, now, now.inside)
            else:
                node = Node(tag, now, now.inside or is_root, against, is_root)
                now.children.append(node)
                now = node
        else:
            if lost.tag == "head" and tag in BLOCK:  # a head that isn't closed
                lost = None
                at = m.start()
                continue
            lost = Node(tag, lost, False)
    return root


def _imply(now: Node, tag: str) -> Node:
    node = now
    if tag in IMPLIED:
        ends, walls = IMPLIED[tag]
        while node is not None and node.tag not in walls and node.tag not in ends:
            node = node.parent
        if node is not None and node.tag in ends:
            now = node.parent
    if tag in CLOSES_P:
        node = now
        while node is not None and node.tag != "p" and (node.tag not in BLOCK):
            node = node.parent
        if node is not None and node.tag == "p":
            now = node.parent
    return now


def _preorder(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return order


def resolve(root: Node) -> None:
    """Take out the parts that are named as no article text, but for those that hold it."""
    order = _preorder(root)
    if not any(n.against for n in order):
        return
    context: dict[int, Node] = {}  # the body, or the root around a node
    above: dict[int, list[Node]] = {}  # named parts around a node
    for n in order:
        up = n.parent
        context[id(n)] = root if up is None else up if up.root else context[id(up)]
        above[id(n)] = [] if up is None else [*above[id(up)], up] if up.against else above[id(up)]
    for n in reversed(order):
        if n.tag != "a":
            for c in n.children:
                n.plain += sum(map(len, c.split())) if isinstance(c, str) else c.plain
                n.free += sum(map(len, c.split())) if isinstance(c, str) else 0 if c.against else c.free
    roots = [n for n in order if n.root]
    declared = [n for n in roots if not above[id(n)]]
    holds = {id(s) for n in roots for s in above[id(n)] if context[id(s)] is root} if not declared else set()
    rest = {id(n): n.free for n in [root, *roots]}
    cleared: set[str] = set()
    inner: dict[int, list[Node]] = {}
    for n in order:
        if n.against:
            inner.setdefault(id(above[id(n)][-1]) if above[id(n)] else 0, []).append(n)
    place_of = {id(n): k for k, n in enumerate(order)}
    heap = [(-n.plain, place_of[id(n)], n) for n in inner.get(0, [])]
    heapq.heapify(heap)
    gone: set[int] = set()
    while heap:
        _, _, n = heapq.heappop(heap)
        place = context[id(n)]
        if id(n) in holds:
            stays = True
        elif place is root and roots or any(w.lower() in CERTAIN for w in n.against):
            stays = False
        else:
            stays = cleared.issuperset(n.against) or OUTWEIGHS * rest[id(place)] < n.plain
        if stays:
            cleared.update(w for w in n.against if w != "<form>")
            rest[id(place)] += n.free
            for x in inner.get(id(n), []):
                heapq.heappush(heap, (-x.plain, place_of[id(x)], x))
        else:
            gone.add(id(n))
    for n in order:
        if any(id(c) in gone for c in n.children):
            n.children = [c for c in n.children if id(c) not in gone]


def measure(root: Node) -> list[Node]:
    """Give each node its density and its children's sum; the nodes, parents first."""
    order = _preorder(root)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += sum(map(len, c.split()))
            else:
                node.chars += c.chars
                node.links += c.links
                node.tags += c.tags + 1
                node.link_tags += c.link_tags
                node.sum += c.density
        if node.tag == "a":
            node.links, node.link_tags = node.chars, node.tags + 1
        node.density = (node.chars - node.links) / max(1, node.tags - node.link_tags)
    return order


def select(root: Node) -> list[Node]:
    """The nodes that hold the main text, in page order; lists of links in them are marked to be skipped."""
    order = measure(root)
    text = lambda n: n.chars - n.links
    roots = [n for n in order if n.root and n.chars and text(n) >= SHARE * text(root)]
    inside = {id(n) for n in roots}
    for n in order:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
    may = [n for n in order if n.parent is None or n.tag in BLOCK and n.tag not in TEXTUAL]
    if roots:
        may = [n for n in may if id(n) in inside] or roots
    core = max(may, key=lambda n: n.sum)  # the first of equals: the outermost
    path, node = [], core
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(n.density for n in path)
    around = [n for n in path if n.root]
    article = next((n for n in reversed(around) if n.tag != "main"), None)
    if article is not None:
        # The article; others beside it are content if they are of a size with it.
        beside = [n for n in article.parent.children if isinstance(n, Node) and n.root and n.density >= threshold and text(n) >= SHARE * text(article)]
        return beside if article in beside else [article]
    if around:
        _skip_links(around[-1])
        return [around[-1]]
    chosen = [core]
    for k, (child, parent) in enumerate(zip(path, path[1:], strict=False)):
        before = True
        for n in parent.children:
            if n is child:
                before = False
            elif isinstance(n, Node) and n.chars and not n.linked:
                near = k == 0 and (n.tag in TEXTUAL or n.density >= threshold)
                title = before and n.tag in HEADINGS
                if near or title or n.density >= threshold and text(n) >= SHARE * text(core):
                    chosen.append(n)
    place = {id(n): k for k, n in enumerate(order)}
    chosen.sort(key=lambda n: place[id(n)])
    for n in chosen:
        _skip_links(n)
    return chosen


def _skip_links(node: Node) -> None:
    """Mark the lists of links among a node's blocks, outside articles."""
    todo = [node]
    while todo:
        n = todo.pop()
        for c in n.children:
            if isinstance(c, Node) and c.tag in BLOCK and not c.root:
                if c.linked:
                    c.skip = True
                else:
                    todo.append(c)


def blocks(root: Node) -> list[str]:
    found: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(now).split()):
            found.append(line)
        now.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif not x.skip:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return found


def main_text(page: str) -> str:
    """The main text of a page: its blocks, one a line. Text without markup is one block; no text gives an empty string."""
    root = parse(page)
    resolve(root)
    return "\n".join(line for node in select(root) for line in blocks(node))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page: ``page_id, url, text, n_chars``, a row for each row of the input.

    A null or empty page gives an empty text; null ids and addresses stay null;
    repeated rows stay; an empty table gives no rows. One pass, no shuffle.
    """

    def start():
        def step(columns):
            ids, urls, pages = columns
            texts = [main_text(p) for p in pages]
            return ids, urls, texts, list(map(len, texts))

        return step

    columns = [F.col(id_col).cast("bigint"), F.col(url_col), text_or_empty(html_col)]
    return map_arrow(df, columns, "page_id bigint, url string, text string, n_chars bigint", start)


def query(spark, sf_dir):
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
