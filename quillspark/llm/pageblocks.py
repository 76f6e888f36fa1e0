"""From a page's HTML to blocks of text: what stands between two boundaries of block-level elements, with its place in the page's tree.

One pass of one pattern over the page; work is linear in its length, however deep or broken it is. Elements that HTML closes without an
end tag are closed here too.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<![^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)[^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio".split()
)
CLOSES_P = BLOCK - frozenset("button caption head html body legend noscript object optgroup option select svg tbody td template tfoot th thead tr video audio".split())
#: Which open element a new one of this name ends, and what keeps it from reaching further up.
ITEMS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select", "optgroup", "datalist"}),
}
_KINDS = {name: kind for kind, (own, stops) in ITEMS.items() for name in own | stops}

#: Marks of an element: what a page says about its own parts.
APART, ASIDE, PLAIN, MAIN, ARTICLE = -2, -1, 0, 1, 2
_APART_TAGS = frozenset("aside audio button datalist dialog footer menu nav noscript object option search select svg template textarea video".split())
_APART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
_APART_NAMES = re.compile(r"ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies|disqus|discussion|disclaimer|gdpr|login|modal|newsletter|notice|notices|notification|pager|paginat\w*|paywall|popup|promo|promoted|promotion|recommend\w*|related|replies|reply|respond|share|sharing|sidebar|signup|skyscraper|social|sponsor\w*|subscribe|subscription|teaser\w*|toc|toolbar|trending|warning|widget\w*")
_ASIDE_NAMES = re.compile(r"bottom\w*|copyright|footer|header|masthead|menu\w*|meta|metadata|nav\w*|search\w*|tags|top\w*bar|topnav")
_CONTENT_NAMES = re.compile(r"(?:article|blog|entry|main|news|page|post|story)[-_]?(?:body|content|text)|article|articlebody|hentry|story|body[-_]?(?:content|text)|content|maincontent", re.I)
_LAYOUT = frozenset("container grid has layout no page row site with without wrap wrapper".split())


def attributes(text: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def mark(name: str, attrs: dict[str, str], above: int) -> int:
    """The mark of an element below one marked `above`. What stands apart stays so, whatever is in it."""
    if above == APART or name in _APART_TAGS or attrs.get("role", "").lower() in _APART_ROLES:
        return APART
    style = attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return APART
    found = above
    if name == "form" or (name == "header" and above != ARTICLE):
        found = min(found, ASIDE)
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    if name not in ("html", "body"):
        for one in names:
            parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", one)
            parts = [p.lower() for p in parts]
            if _LAYOUT.intersection(parts):
                continue
            if name not in ("article", "main") and any(_APART_NAMES.fullmatch(p) for p in parts):
                return APART
            if above != ARTICLE and name not in ("article", "main") and any(_ASIDE_NAMES.fullmatch(p) for p in parts):
                found = min(found, ASIDE)
        if name in ("article", "main") and any(_APART_NAMES.fullmatch(p.lower()) for one in names for p in [one]):
            return APART
    if name == "article" or attrs.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    if name == "main" or attrs.get("role", "").lower() in ("main", "article"):
        return max(MAIN, found)
    if found == PLAIN and name in ("div", "section", "td") and any(_CONTENT_NAMES.fullmatch(one) for one in names):
        return MAIN
    return found


class Block(NamedTuple):
    text: str
    tag: str
    element: int
    mark: int
    words: int
    linked: float


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks in order of the page, and the parent of each block-level element (-1: none)."""
    out: list[Block] = []
    parents: list[int] = [-1]
    stack: list[tuple[str, int, int]] = [("", 0, PLAIN)]  # name, block-level element, mark
    opened: dict[str, int] = {}
    scopes: dict[str, list[tuple[int, bool]]] = {}
    parts: list[str] = []
    linked, in_links, at = 0, 0, 0
    end = len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                text = " ".join(words)
                _, element, own = stack[-1]
                out.append(Block(text, block_tag[element], element, own, len(words), min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal in_links
        while len(stack) > depth:
            name, _, _ = stack.pop()
            opened[name] -= 1
            if name == "a":
                in_links -= 1
            if name in _KINDS:
                scopes[_KINDS[name]].pop()

    def depth_of(name: str) -> int:
        depth = len(stack) - 1
        while stack[depth][0] != name:
            depth -= 1
        return depth

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_links:
                linked += len(text)

    block_tag = [""]
    while at < end:
        found = TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            if opened.get(name):
                depth = depth_of(name)
                if name in BLOCK:
                    flush()
                close(depth)
            elif name in BLOCK:
                flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            stop = RAW[name].search(page, at)
            at = stop.start() if stop else end
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P and opened.get("p"):
                close(depth_of("p"))
            if name in ITEMS:
                scope = scopes.get(_KINDS[name], [])
                if scope and scope[-1][1]:
                    close(scope[-1][0])
        if name == "a" and in_links:
            close(depth_of("a"))
        _, element, own = stack[-1]
        if found[3] or name in _APART_TAGS or name in ("article", "main", "form", "header"):
            own = mark(name, attributes(found[3]), own)
        if name in BLOCK:
            parents.append(element)
            element = len(parents) - 1
            block_tag.append(name)
        if found[3].endswith("/") and name not in BLOCK:
            continue
        if name == "a":
            in_links += 1
        if name in _KINDS:
            scopes.setdefault(_KINDS[name], []).append((len(stack), name in ITEMS[_KINDS[name]][0]))
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, element, own))
    flush()
    return out, parents
