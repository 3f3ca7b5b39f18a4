"""Main text of web pages by composite text density.

The page becomes a tree; elements that are no article by their kind (menus, footers, sidebars, scripts, styles) are taken
out with all below them, and then, where the page's structure allows it, those whose names say so (page headers, notices,
adverts, forms, reader comments). For every element that is left the composite density is the characters per tag, scaled by a
logarithm that falls with the share of link characters and link tags. The element with the
greatest sum of its children's densities heads the main text; the least density on the path from it
up to the body is the threshold at which other subtrees belong to it too.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split())
_HEAD = frozenset("base link meta title style script noscript template head".split())

#: An open element (key) ends when one of these starts, unless a scope that holds it began since.
_ENDS_BEFORE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table td th div article section main aside nav header footer form blockquote body html "
                   "foreignobject".split())
_FOREIGN = ("svg", "math", "select")  # a block that starts in one of these ends it

#: Element kinds that are never article text; a form that wraps the page is judged by what it holds.
_NOT_TEXT = frozenset("nav footer aside button input menu dialog head noscript template svg select".split()) | _RAW
#: Words of classes and ids. A name counts where all its words are of one kind, layout or object words and at least one of the kind.
_COMMENT_WORDS = frozenset("comment comments commenter commentlist commenting disqus respond reply replies livefyre".split())
_SURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion cookie cookies "
    "consent gdpr newsletter subscribe paywall popup modal sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "toolbar share sharing related recommended recommendations pagination pager skip".split())
_ROLE_WORDS = frozenset(
    "banner notice notices alert alerts overlay subscription side menu social widget widgets search topbar complementary contentinfo "
    "header".split())
_LAYOUT = frozenset(
    "site page top bottom left right primary secondary global main wrapper wrap container box bar block area list links link slot "
    "section sections body content text item items inner outer button buttons icon icons thread reader user fb form panel unit layout "
    "row col column group holder signup".split())
_OBJECTS = frozenset("post posts article articles story stories entry".split())
_NEVER = frozenset("has no with without is not".split())  # first words of names that tell of other elements
_ROLES = frozenset("navigation complementary contentinfo search banner dialog alertdialog menu menubar toolbar".split())
_CONTAINERS = frozenset("div section ul ol dl table article details center".split())  # whose id may name a part of the page
_WHOLE = frozenset("html body main".split())

#: What an element's names say of it. Comments go everywhere; the others only where they hold no article.
_PLAIN, _ROLE, _SURE, _COMMENT = range(4)

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}


class _Tree:
    """Elements in page order: parent's number, tag, whether it is dropped, what its names say."""

    def __init__(self) -> None:
        self.parent, self.tag, self.dropped, self.mark = [-1], ["html"], [False], [_PLAIN]
        self.written = ["html"]  # the tag as it is written; tag is "main" where the role says so
        self.order: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends

    def add(self, parent: int, tag: str, kind: str, dropped: bool, mark: int) -> int:
        self.parent.append(parent)
        self.tag.append(kind)
        self.written.append(tag)
        self.dropped.append(dropped)
        self.mark.append(mark)
        return len(self.parent) - 1


def _attributes(written: str) -> dict[str, str]:
    given: dict[str, str] = {}
    for found in _ATTRIBUTE.finditer(written):
        given.setdefault(found[1].lower(), found[2] or found[3] or found[4] or "")  # of repeated names the first counts
    return given


def _not_shown(given: dict[str, str]) -> bool:
    return ("hidden" in given or given.get("aria-hidden", "").strip().lower() == "true"
            or bool(_NOT_SHOWN.search(given.get("style", ""))))


def _name_says(name: str) -> int:
    """What a class or an id says, by its words; a name with any other word says nothing."""
    words = [w.rstrip("0123456789") for w in re.split(r"[_-]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())]
    words = [w for w in words if w]
    if not words or words[0] in _NEVER:
        return _PLAIN
    for kind, own in ((_COMMENT, _COMMENT_WORDS), (_SURE, _SURE_WORDS), (_ROLE, _ROLE_WORDS | _SURE_WORDS)):
        objects = frozenset() if kind == _ROLE and "header" in words else _OBJECTS  # the header of a post is the post's
        if not own.isdisjoint(words) and all(w in own or w in _LAYOUT or w in objects or w in _ROLE_WORDS and kind == _SURE for w in words):
            return kind
    return _PLAIN


def _says(tag: str, given: dict[str, str]) -> int:
    """What the classes, the id and the role of an element say of it."""
    if tag in _WHOLE or given.get("role", "").lower() == "main":
        return _PLAIN
    names = given.get("class", "").split()
    said = max(map(_name_says, names), default=_PLAIN)
    if said == _ROLE and any(_name_says(n) == _PLAIN and not (_OBJECTS | _LAYOUT).isdisjoint([n.lower()]) for n in names):
        said = _PLAIN  # "content sidebar-right", "post alert": the other class names the text itself
    if tag in _CONTAINERS and "id" in given:
        by_id = _name_says(given["id"])
        said = max(said, by_id if by_id == _COMMENT else min(by_id, _ROLE))  # ids made from headings: not sure
    if not _ROLES.isdisjoint(given.get("role", "").lower().split()):
        said = max(said, _SURE)
    return max(said, _ROLE) if tag in ("header", "form") else said


def parse(page: str) -> _Tree:
    """The tree of a page, however broken: unclosed, crossing and unknown tags included."""
    tree, stack, at, n = _Tree(), [0], 0, len(page)
    tags = tree.written
    seen: dict[str, int] = {}  # open elements by tag

    def text(part: str) -> None:
        if part and not tree.dropped[stack[-1]]:
            tree.order.append((stack[-1], entities.unescape(part)))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            gone = tags[stack.pop()]
            seen[gone] -= 1
            if gone in _BLOCK:
                tree.order.append((stack[-1], None))

    def close(wanted: tuple[str, ...]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = tags[stack[depth]]
            if tag in wanted:
                pop_to(depth)
                return
            if tag in _SCOPE:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        found = _TAG.match(page, lt)
        if not found:
            end = page.find(">", lt)
            if lt + 1 < n and (page[lt + 1] in "!?/" or page[lt + 1].isalpha()):
                at = n if end < 0 else end + 1
            else:
                text("<")
                at = lt + 1
            continue
        at = found.end()
        tag, attributes = found[2].lower(), found[3]
        if found[1]:
            if tag == "br":
                tree.order.append((stack[-1], None))
            elif seen.get(tag):
                barrier = tag not in _BLOCK or tag == "p"
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == tag:
                        pop_to(depth)
                        break
                    if barrier and tags[stack[depth]] in _SCOPE:
                        break
            continue
        if tag in ("html", "body") and seen.get(tag):
            continue
        if seen.get("head") and tag not in _HEAD and (tag == "body" or not (seen.get("noscript") or seen.get("template"))):
            close(("head",))
        if tag in _BLOCK and any(seen.get(t) for t in _FOREIGN):
            close(_FOREIGN)
        if tag in _BLOCK and seen.get("p"):
            close(("p",))
        if tag in _ENDS_BEFORE:
            close(_ENDS_BEFORE[tag])
        parent = stack[-1]
        if tag in _BLOCK or tag == "br":
            tree.order.append((parent, None))
        given = _attributes(attributes) if attributes else {}
        if given.get("role", "").lower() == "main" and tag in _CONTAINERS:
            kind = "main"
        else:
            kind = tag
        number = tree.add(parent, tag, kind, tree.dropped[parent] or tag in _NOT_TEXT or tag not in _WHOLE and _not_shown(given),
                          _says(tag, given))
        if tag in _RAW and not attributes.endswith("/"):
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
        elif tag not in _VOID and not attributes.endswith("/"):
            stack.append(number)
            seen[tag] = seen.get(tag, 0) + 1
    return tree


def densities(tree: _Tree) -> tuple[list[float], list[float]]:
    """Composite density and sum of the children's densities, by element."""
    n = len(tree.parent)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
    for i, piece in tree.order:
        if piece is not None:
            size = len("".join(piece.split()))
            chars[i] += size
            links[i] += size * in_link[i]
    for i in range(n - 1, 0, -1):
        if not tree.dropped[i]:
            up = tree.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (tree.tag[i] == "a")
    body = links[0] / max(chars[0], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if chars[i] and not tree.dropped[i]:
            c, t, lc, lt = chars[i], max(tags[i], 1), max(links[i], 1), max(link_tags[i], 1)
            base = math.log(c / max(c - links[i], 1) * links[i] + body * c + math.e)
            density[i] = (c / t * math.log1p(c / lc * t / lt) / math.log(base + 1))
        if i:
            total[tree.parent[i]] += density[i]
    return density, total


def _shown_chars(tree: _Tree) -> list[int]:
    """Characters outside links, by element with all below it."""
    n = len(tree.parent)
    in_link, chars = [False] * n, [0] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
    for i, piece in tree.order:
        if piece is not None and not in_link[i]:
            chars[i] += len("".join(piece.split()))
    for i in range(n - 1, 0, -1):
        if not tree.dropped[i]:
            chars[tree.parent[i]] += chars[i]
    return chars


def _pass_down(tree: _Tree) -> None:
    for i in range(1, len(tree.parent)):
        tree.dropped[i] = tree.dropped[i] or tree.dropped[tree.parent[i]]


def _head(tree: _Tree) -> int:
    """The first element with the greatest sum of its children's densities."""
    _, total = densities(tree)
    return max((i for i in range(len(total)) if not tree.dropped[i]), key=lambda i: (total[i], -i))


def settle(tree: _Tree) -> None:
    """Drop what the names of elements tell to be no article text, unless the page's structure speaks against it.

    Comments go wherever they are. Of the others none goes that holds an article or main. Inside an article only sure
    names count. On a page without article and main, one that holds half of the text stays, and so does one
    that holds the greatest density sum if its name is not a sure one."""
    n, parent, mark = len(tree.parent), tree.parent, tree.mark
    if not any(mark):
        return
    in_comment, holds = [False] * n, [0] * n
    for i in range(1, n):
        in_comment[i] = in_comment[parent[i]] or mark[i] == _COMMENT
    whole = [i for i in range(n) if tree.tag[i] in ("article", "main") and not tree.dropped[i]
             and (tree.tag[i] == "main" or not in_comment[i])]
    anchors = [i for i in whole if mark[i] < _SURE] or whole
    for i in anchors:
        holds[i] = 1
    for i in range(n - 1, 0, -1):
        holds[parent[i]] += holds[i]
    for i in range(1, n):
        if mark[i] == _COMMENT and not holds[i]:
            tree.dropped[i] = True
    _pass_down(tree)
    if anchors:
        sure_only, in_main = [False] * n, [False] * n
        for i in range(1, n):
            up = parent[i]
            sure_only[i] = sure_only[up] or tree.tag[up] == "article"
            in_main[i] = in_main[up] or tree.tag[up] == "main"
            least = _SURE if sure_only[i] or in_main[i] and tree.tag[i] == "header" else _ROLE
            if tree.tag[i] == "form":
                least = _ROLE
            if not holds[i] and mark[i] >= least:
                tree.dropped[i] = True
        _pass_down(tree)
        return
    chars = _shown_chars(tree)
    for kind in (_SURE, _ROLE):
        held = set()
        if kind == _ROLE:
            if _ROLE not in mark:
                break
            at = _head(tree)
            while at >= 0:
                held.add(at)
                at = parent[at]
        for i in range(1, n):
            if mark[i] == kind and 2 * chars[i] < chars[0] and i not in held:
                tree.dropped[i] = True
        _pass_down(tree)


def main_elements(tree: _Tree) -> list[bool]:
    """Which elements belong to the main text."""
    density, total = densities(tree)
    n = len(density)
    best = list(range(n))  # in the subtree, the first element with the greatest sum
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if not tree.dropped[i] and (total[best[i]], -best[i]) > (total[best[up]], -best[up]):
            best[up] = best[i]
    head, threshold = best[0], math.inf
    while head >= 0:
        threshold = min(threshold, density[head])
        head = tree.parent[head]
    chosen = [False] * n
    for i in range(n):
        if not tree.dropped[i] and density[i] >= threshold and density[i] > 0:
            chosen[best[i]] = True
    # An article is one piece: what it holds is main text where any of its elements is.
    for i in range(n - 1, 0, -1):
        if chosen[i]:
            up = i
            while up > 0 and tree.tag[up] not in ("article", "main"):
                up = tree.parent[up]
            if up > 0:
                chosen[up] = True
    def pass_down() -> None:
        for i in range(1, n):
            chosen[i] = not tree.dropped[i] and (chosen[i] or chosen[tree.parent[i]])

    pass_down()
    # A page's only headline belongs to the main text that follows it, also from a block of its own.
    headlines = [i for i in range(n) if tree.tag[i] == "h1" and not tree.dropped[i]]
    if len(headlines) == 1 and headlines[0] < next((i for i in range(n) if chosen[i]), 0) and _shown_chars(tree)[headlines[0]]:
        chosen[headlines[0]] = True
        pass_down()
    return chosen


def main_text(page: str | None) -> str:
    """The main text: references decoded, white space of a block one space, blocks joined by one space."""
    tree = parse(page or "")
    shown = list(tree.dropped)
    settle(tree)
    if not any(piece and piece.strip() and not tree.dropped[i] for i, piece in tree.order):
        tree.dropped = shown  # the names would leave nothing
    chosen = main_elements(tree)
    pieces = [" " if piece is None else piece for i, piece in tree.order if piece is None or chosen[i]]
    return " ".join("".join(pieces).split())


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages (page_id, url, html).

    A NULL or empty page, and one without main text, has an empty text. Repeated rows each give a row;
    other columns are not read. An empty table gives no rows."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long")
