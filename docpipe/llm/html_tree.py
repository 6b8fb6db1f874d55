"""Main text of web pages by tree scoring.

Paragraphs give points for length and commas to their ancestors, less with distance and with link density. The best
container, widened to the article around it, is kept with those siblings that read like text; without an article, all of
the body that is not mostly links is kept with it. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are left out wherever they stand.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html title legend summary figcaption li dd dt".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = frozenset("ul ol dl table div section article main body td th blockquote".split())
# Choices of this operator.
GROUPS = frozenset("div section ul ol dl table center details".split())
DROPPED_TAGS = frozenset(
    "head title script style noscript template nav footer aside form button input select textarea iframe object embed svg canvas menu dialog "
    "audio video search".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup "
    "promo promotion related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
# Words that may stand beside one of these in a name without changing what it says: a place or a shape on the page.
COMPANIONS = frozenset(
    "area bar block body bottom box btn button buttons card col column container content cta divider entry flex footer form frame global grid group head "
    "header heading hero icons inline inner item items layout left link links list main mini module outer overlay page panel post posts primary "
    "right row secondary section site slot small sticky story text title top unit wrap wrapper zone article articles bottom blog email user users".split()
)
# Blocks of running text and headings are judged by what they hold, never by a name: ids of headings are made from their words.
UNNAMED = frozenset("h1 h2 h3 h4 h5 h6 dt dd tr tbody pre blockquote figure figcaption code".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "score", "chars", "linked")

    def __init__(self, tag: str, parent, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list = []  # nodes and texts, in page order
        self.score, self.chars, self.linked = 0.0, 0, 0


class Tree(HTMLParser):
    """A lenient tree: omitted end tags of paragraphs, items and cells are supplied, stray end tags ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, SCOPES)
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES - CLOSES[tag])
        if tag in VOID:
            self.at.children.append(Node(tag, self.at, tag in DROPPED_TAGS))
            return
        node = Node(tag, self.at, is_boilerplate(tag, attrs, self.at))
        self.at.children.append(node)
        self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash has no meaning in HTML

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root:
            if node.tag == tag:
                self.at = node.parent
                return
            if tag not in BLOCK and node.tag in BLOCK:
                return  # an inline end tag closes no block
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def _close(self, tags, scope):
        node, last = self.at, None
        while node is not self.root and node.tag not in scope:
            if node.tag in tags:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent


def _inside(node, tags) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def is_boilerplate(tag: str, attrs: list, parent) -> bool:
    """Judged by tag, role, visibility and the words of class and id. A header inside an article is part of it."""
    if tag in DROPPED_TAGS:
        return True
    if tag in ("html", "body", "article", "main", "b", "i", "em", "strong", "a", "br", "p") and not attrs:
        return False
    if tag == "header" and not _inside(parent, ("article", "main")):
        return True
    given = dict(attrs)
    if "hidden" in given or given.get("aria-hidden") == "true" or _HIDDEN.search((given.get("style") or "").lower()):
        return True
    if (given.get("role") or "").lower() in DROPPED_ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        names = [given.get("class")] if tag == "article" else []  # a reader's comment may be an article of its own
        return any(w.lower() in ("comment", "comments", "reply") for n in names if n for w in _NAME.findall(n))
    if tag in UNNAMED:
        return False
    names = DROPPED_NAMES - {"header"} if _inside(parent, ("article", "main")) else DROPPED_NAMES
    return any(_says(part, names) for n in ("class", "id") if given.get(n) for part in given[n].split())


def _says(name: str, words: frozenset) -> bool:
    """Whether one class or id is made of the given words, companions and numbers: ``ad-slot-2``, not ``related-work``."""
    parts = [w.lower() for w in _NAME.findall(name)]
    return any(w in words for w in parts) and all(w in words or w in COMPANIONS or w.isdigit() for w in parts)


def _in_order(root: Node):
    """Kept nodes, parents first, without recursion (pages may be nested deeply)."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        node.chars = own + sum(c.chars for c in below)
        node.linked = node.chars if node.tag == "a" else sum(c.linked for c in below)


def _plain(node: Node) -> float:
    return 1 - node.linked / node.chars if node.chars else 0.0


def _commas(node: Node) -> int:
    return sum(c.count(",") for n in _in_order(node) for c in n.children if isinstance(c, str))


def look_through_forms(root: Node) -> None:
    """Keep a form that holds half of the page's text or more: some pages are one form."""
    forms = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.dropped and node.tag != "form":
            continue
        if node.tag == "form":
            forms.append(node)
            node.dropped = False
        todo.extend(c for c in node.children if isinstance(c, Node))
    if not forms:
        return
    _measure(list(_in_order(root)))
    for form in forms:
        form.dropped = 2 * form.chars < root.chars


def best_container(root: Node) -> Node | None:
    look_through_forms(root)
    nodes = list(_in_order(root))
    _measure(nodes)
    for node in nodes:
        if node.tag not in ("p", "pre", "blockquote", "td", "li", "dd") or node.chars < 20:
            continue
        points = (1 + node.chars / 100 + _commas(node)) * _plain(node)
        above, weight = node.parent, 1.0
        while above is not None and above.tag != "#root":
            above.score += points * weight
            above, weight = above.parent, weight / 2
    scored = [n for n in nodes if n.score > 0]
    if scored:
        best = max(scored, key=lambda n: n.score * _plain(n))
        while best.tag in ("p", "li", "td", "th", "tr", "tbody", "ul", "ol", "dl", "dd", "blockquote") and best.parent.tag not in ("#root", "html"):
            best = best.parent
        around = best
        while around is not None and around.tag not in ("article", "main"):
            around = around.parent
        return around or widened(best)
    named = [n for n in nodes if n.tag in ("article", "main") and n.chars]
    return max(named, key=lambda n: n.chars, default=next((n for n in nodes if n.tag == "body"), root))


def widened(best: Node) -> Node:
    """The body around ``best``, without what is mostly links beside the way up to it."""
    while best.tag not in ("body", "html") and best.parent is not None:
        best, path = best.parent, best
        kept, run = [], []
        for c in [*best.children, None]:
            if isinstance(c, str) or (c is not None and c is not path and c.tag not in BLOCK):
                run.append(c)
                continue
            kept += run if not _mostly_links(run) else [" "]
            run = []
            if c is not None:
                kept.append(c)
                if c is not path:
                    _drop_links(c)
        best.children = kept
    return best


def _mostly_links(run: list) -> bool:
    """Whether texts and inline nodes that follow each other have half of their characters or more in links."""
    parts = [c for c in run if isinstance(c, Node) and not c.dropped]
    chars = sum(c.chars for c in parts) + sum(len(" ".join(c.split())) for c in run if isinstance(c, str))
    return chars > 0 and 2 * sum(c.linked for c in parts) >= chars


def _drop_links(top: Node) -> None:
    """Mark blocks that are mostly links as dropped; single items, cells and headings within others are not judged."""
    for node in _in_order(top):
        if node.tag in (GROUPS if node is not top else GROUPS | {"p", "li", "td", "dd", "figure"}) and node.chars and _plain(node) <= 0.5:
            node.dropped = True


def kept_parts(best: Node) -> list[Node]:
    """The container, and siblings that read like text: a good score of their own, or headings and text with few links."""
    if best.parent is None or best.tag in ("body", "html", "main"):
        return [best]
    parts = []
    for c in best.parent.children:
        if not isinstance(c, Node) or c.dropped or not c.chars:
            continue
        text_like = c.tag in ("p", "pre", "blockquote", "h1", "h2", "h3") and _plain(c) > 0.75 and best.parent.tag not in ("body", "html")
        if c is best or text_like or (c.score * _plain(c) >= max(3.0, 0.2 * best.score) and c.tag in ("div", "section", "article", "main", "td")):
            parts.append(c)
    return parts


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node``, white space joined."""
    out, run, todo = [], [], [node]

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif not item.dropped:
            if item.tag == "br":
                run.append(" ")
                continue
            if item.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(item.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    best = best_container(tree.root)
    return "\n".join(b for part in kept_parts(best) for b in blocks(part)) if best is not None else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``. Null or empty html gives an empty text; other columns are ignored."""

    def of_batch(batches):
        for frame in batches:
            text = frame["html"].map(main_text)
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": text.map(len).astype("int64")})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(of_batch, f"page_id {kind}, url string, text string, n_chars long")
