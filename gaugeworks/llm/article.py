"""Main text of web pages by tree scoring.

Paragraphs pass points (one each, one per comma, up to three for length) to the
elements above them, less with every level; an element's points are discounted by
its share of text in links.  The best element is the core.  If it lies in an article
element, that one, articles beside it and other worthy siblings are kept.  Otherwise the container is the
main element or else the nearest one named as content, or else the core's parent;
it is kept with all its parts that are not mostly links.  What is no article goes
in any case: menus, headers, footers, side bars, notices, adverts, forms, reader
comments.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

SCHEMA = "page_id long, url string, text string, n_chars long"

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none")
_WORDS = re.compile(r"[a-z]+")
#: A form that holds these up to the next form tag is a frame round the page.
_FORM_EDGE = re.compile(r"</?form\b", re.I)
_FRAMED = re.compile(r"<(?:article|main)\b|\bid\s*=\s*[\"']?(?:content|main|article)\b|(?:<p\b.*?){3}", re.I | re.S)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul").split())
#: A start tag that ends an open element of these, up to the tags behind which it may not reach.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)), "option": (("option",), ("select",))}
CLOSES_P = BLOCK - {"body", "caption", "head", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Deeper elements become children of the last one at this depth, as in browsers.
MAX_DEPTH = 512
P_STOPS = frozenset("td th caption table button html body".split())

NOT_ARTICLE = frozenset("nav footer aside form head menu dialog button select input label search option".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words of class and id that mark what is no article; the second list gives way to words that name the content.
MARKED = frozenset(("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted promotion "
                    "cookie cookies consent gdpr notice notices popup modal overlay breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus "
                    "discussion login signin signup subscribe subscription newsletter share sharing sharebar social related recommended recommendations pagination "
                    "pager toolbar skip masthead topbar copyright").split())
WEAK = frozenset("sidebar sidebars side aside menu nav navbar navigation header footer foot widget widgets banner form search alert rail".split())
CONTENT = frozenset("article articles content main post entry story body text page".split())


class _Node:
    __slots__ = ("tag", "parent", "out", "hint", "points", "chars", "linked", "depth")

    def __init__(self, tag, parent, out, hint):
        self.tag, self.parent, self.out, self.hint = tag, parent, out, hint
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.depth = 0 if parent is None else parent.depth + 1


#: Class names that only say how a page is laid out.
STATES = ("no", "has", "is", "with", "without", "not"), ("open", "closed", "enabled", "disabled", "count", "on", "off")
#: Elements of running text; only a whole class name out of these marks one as no article.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption li td".split())
MARKED_ALONE = frozenset(("ad ads advert adverts advertisement advertisements advertising sponsor sponsored cookie cookies notice breadcrumb breadcrumbs comment comments "
                          "reply replies newsletter share sharing pager pagination copyright skip").split())


def _marks(names: list[str]) -> tuple[bool, bool, bool]:
    """Whether class and id names say no article, maybe none, or content.

    A name counts by its first or last word ("comment-list", "post-comments"); names of a
    state ("no-comments", "comments-open", "has-sidebar") do not count.
    """
    marked = weak = content = False
    for name in names:
        words = _WORDS.findall(name)
        if not words or words[0] in STATES[0] or (len(words) > 1 and words[-1] in STATES[1]):
            continue
        ends = {words[0], words[-1]}
        marked |= bool(ends & MARKED)
        weak |= bool(ends & WEAK)
        content |= bool(set(words) & CONTENT)
    return marked, weak, content


def _look(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether an element is no article by its name and attributes, and a bonus for those that say they are."""
    bonus = {"article": 25, "main": 20}.get(tag, 0)
    if tag in NOT_ARTICLE:
        return True, 0
    if not attrs or attrs.isspace():
        return False, bonus
    names, role = [], ""
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value.strip() == "true") or (name == "style" and _UNSEEN.search(value)):
            return True, 0
        if name in ("class", "id"):
            names += value.split()
        elif name == "role":
            role = value
    if tag in RUNNING:
        return bool(MARKED_ALONE.intersection(names)), 0
    marked, weak, content = _marks(names)
    if tag not in ("body", "html", "article", "main"):
        if role in ROLES or (marked and not {"content", "main", "article"}.intersection(names)) or (weak and not content):
            return True, 0
    elif tag == "article" and {"comment", "comments", "reply"}.intersection(names):
        return True, 0
    return False, bonus + (15 if content else 0)


def _blocks(page: str) -> list[tuple[str, int, _Node]]:
    """Blocks in page order: text, its characters in links, the block element that holds it (outside of what is no article)."""
    root = _Node("html", None, False, 0)
    open_tags: dict[str, int] = {}
    stack, blocks, chunk, state = [root], [], [], {"links": 0, "linked": 0}

    def end_block():
        text = " ".join("".join(chunk).split())
        if text:
            node = stack[-1]
            while node.tag not in BLOCK and node.parent is not None:
                node = node.parent
            if not node.out:
                blocks.append((text, min(state["linked"], len(text)), node))
        chunk.clear()
        state["linked"] = 0

    def say(text: str):
        if text and not stack[-1].out:
            text = entities.unescape(text) if "&" in text else text
            chunk.append(text)
            if state["links"]:
                state["linked"] += len(text.strip())

    def pop():
        node = stack.pop()
        open_tags[node.tag] -= 1
        if node.tag == "a":
            state["links"] -= 1

    def close_first(tags, stops):
        if not any(open_tags.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                end_block()
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in stops:
                return

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in BLOCK:
                end_block()
            if not open_tags.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in P_STOPS and tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html", "caption"):
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at) if not m["attrs"].endswith("/") else None
            if end is None and not m["attrs"].endswith("/"):
                at = size if tag in ("script", "style", "textarea", "title") else at
            elif end is not None:
                at = end.end()
            continue
        if tag in BLOCK:
            end_block()
            if tag in CLOSES_P:
                close_first(("p",), P_STOPS)
        if tag in ENDS:
            close_first(*ENDS[tag])
        if tag == "br":
            say(" ")
        if tag in VOID:
            continue
        if tag in ("html", "body") and len(stack) > 1 and open_tags.get(tag):
            continue
        top = stack[-1]
        out, hint = (True, 0) if top.out else _look(tag, m["attrs"])
        if tag == "form" and not top.out:
            edge = _FORM_EDGE.search(page, at)
            out = _FRAMED.search(page, at, edge.start() if edge else size) is None
        if tag == "header" and not top.out:
            out = not any(n.tag in ("article", "main") for n in stack[-4:])
        above = top if top.tag in BLOCK or top.parent is None else top.parent  # inline elements hold no others
        node = _Node(tag, above.parent if above.depth >= MAX_DEPTH else above, out, hint)
        if tag == "a":
            state["links"] += 1
        if m["attrs"].endswith("/") and tag not in BLOCK and tag != "a":
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        stack.append(node)
    end_block()
    return blocks


def _share(node: _Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _container(best: _Node) -> _Node | None:
    """The main element round the core, the nearest element named as content, or the parent."""
    named, up = None, best
    while up is not None:
        if up.tag == "main":
            return up
        if named is None and up is not best and up.hint and up.tag not in ("body", "html"):
            named = up
        up = up.parent
    return named or best.parent


def _part(node: _Node, path: set[int], container: _Node, text: str, linked: int) -> bool:
    """Whether a block lies in the container and the part of it beside the way to the core is not mostly links."""
    top, up = None, node
    while up is not None and id(up) not in path:
        top, up = up, up.parent
    if up is None:
        return False
    if top is None or not top.chars:  # text in an element on the way itself, or a paragraph there
        return linked * 2 <= len(text)
    return top.linked * 2 <= top.chars


def extract(page: str | None) -> str:
    """The article of a page as lines, empty if there is none."""
    blocks = _blocks(page or "")
    if not blocks:
        return ""
    scored = {}
    for text, linked, node in blocks:
        points = 1 + text.count(",") + min(len(text) // 100, 3) if len(text) >= 25 else 0
        holder = node if node.tag not in ("p", "pre", "blockquote", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6") else node.parent or node
        level, up = 0, holder
        while up is not None:
            if level < 6:
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up.chars += len(text)
            up.linked += linked
            scored[id(up)] = up
            up, level = up.parent, level + 1
    nodes = list(scored.values())
    best = max(nodes, key=lambda n: ((n.points + (n.hint if n.chars else 0)) * (1 - _share(n)), n.depth))
    up = best
    while up is not None:
        if up.tag == "article":
            best = up
        up = up.parent
    worth = best.points * (1 - _share(best))
    kept = {id(best)}
    for n in nodes:
        if n.parent is best.parent and n is not best and best.parent is not None:
            if n.points * (1 - _share(n)) >= max(3.0, 0.2 * worth) or (n.tag == best.tag == "article" and n.linked * 2 <= n.chars):
                kept.add(id(n))
    container = None if best.tag == "article" else _container(best)
    path = set()
    up = best
    while container is not None and up is not None:
        path.add(id(up))
        up = None if up is container else up.parent
    lines = []
    for text, linked, node in blocks:
        if container is not None and _part(node, path, container, text, linked):
            lines.append(text)
            continue
        up = node
        while up is not None and id(up) not in kept:
            up = up.parent
        beside = node.parent is best.parent and best.parent is not None and node.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and linked * 4 <= len(text)
        if up is not None or beside:
            lines.append(text)
    return "\n".join(lines)


def _pages(batches):
    for batch in batches:
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                              names=["page_id", "url", "text", "n_chars"])


def extract_articles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row; null and empty pages have an empty text."""
    rows = pages.selectExpr(f"cast(`{page_id}` as long) as page_id", f"cast(`{url}` as string) as url", f"cast(`{html}` as string) as html")
    return rows.mapInArrow(_pages, SCHEMA)


def op10_extract_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages"))
