"""Main text of web pages by composite text density.

Every DOM node gets a link-adjusted number of characters per tag; each node's children's densities are summed. The
least density on the path from the node of the largest sum up to the body is the threshold: every node that
reaches it contributes the subtree of the largest sum below it. Boilerplate that its tag, role or class names
(menus, adverts, forms, comments) is taken out before densities are computed.

Pages are read where they lie, one at a time inside Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wardline.llm.texts import map_texts

# Names of elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table select body div section article".split())
NOISE_TAGS = frozenset("head nav footer aside form script style textarea title template noscript iframe svg math button select object canvas dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe signup login social share sharing related recommended recommendations widget toolbar "
    "pagination pager header masthead skip hidden".split()
)
COMMENT_NAMES = frozenset("comment comments disqus respond reply replies discussion".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
_NAME = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}


@dataclass
class Dom:
    """Nodes in page order; ``runs`` are texts with their node, or None where a block begins or ends."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    noise: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])  # noise by class and id only
    shielded: list[bool] = field(default_factory=lambda: [True])
    runs: list[tuple[int, str | None]] = field(default_factory=list)


def _names(attributes: str) -> tuple[set[str], set[str], bool]:
    """Words of class and id, of the role, and whether the element is not shown."""
    names, roles, unseen = set(), set(), False
    if attributes.strip(" /"):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                names.update(_NAME.findall(value))
            elif key == "role":
                roles.add(value)
            elif key == "style":
                unseen |= "display:none" in value.replace(" ", "")
            else:
                unseen |= key == "hidden" or value == "true"
    return names, roles, unseen


def parse(html: str) -> Dom:
    """A forgiving parse: implied ends of paragraphs and list items, raw text elements, stray end tags ignored."""
    dom, stack, at, last = Dom(), [0], 0, html.rfind(">")
    while at < len(html):
        if at > last:  # no tag ends here any more
            dom.runs.append((stack[-1], html[at:]))
            break
        token = _TOKEN.match(html, at)
        at = token.end()
        text = token[0]
        tag = token[2] or token[5]
        if tag is None:
            if text[0] != "<" or text == "<":
                dom.runs.append((stack[-1], text))
            continue
        tag = tag.lower()
        if token[1] or token[4]:
            _close(dom, stack, tag)
            continue
        if tag == "br":
            dom.runs.append((stack[-1], None))
        if tag in CLOSES_P:
            _close_implied(dom, stack, {"p"}, frozenset({"button", "table", "td"}))
        if tag in SIBLINGS:
            _close_implied(dom, stack, SIBLINGS[tag], SCOPES)
        node = len(dom.tags)
        names, roles, unseen = _names(token[3] or token[6] or "")
        comment = bool(names & COMMENT_NAMES)
        named, role = bool(names & NOISE_NAMES), bool(roles & NOISE_ROLES)
        inside = any(dom.tags[n] in ("article", "main") for n in stack)
        body = tag in ("article", "main", "body", "html")
        sure = unseen or tag in NOISE_TAGS or (tag == "header" and not inside) or (role and not body)
        noise = sure or comment or (named and not body)
        dom.tags.append(tag)
        dom.parents.append(stack[-1])
        dom.noise.append(noise and tag not in ("body", "html"))
        dom.named.append(noise and not sure and tag not in ("body", "html"))
        dom.shielded.append(False)
        if tag in ("article", "main") and not comment:  # what wraps the article is not boilerplate, whatever its class
            for n in reversed(stack):
                if dom.shielded[n] or dom.tags[n] in ("nav", "aside", "footer"):
                    break
                dom.shielded[n] = not comment
        if comment:
            dom.tags[node] = "#comment"
        if tag not in INLINE and tag != "br":
            dom.runs.append((node, None))
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else len(html)
            if end:
                stack.append(node)
        elif tag not in VOID and not (token[3] or token[6] or "").endswith("/"):
            stack.append(node)
    for n in range(1, len(dom.tags)):
        if dom.shielded[n] and dom.tags[n] != "#comment":
            dom.noise[n] = dom.named[n] = False
    for n in _most_text(dom):
        dom.noise[n] = False
    for n in range(1, len(dom.tags)):
        dom.noise[n] = dom.noise[n] or dom.noise[dom.parents[n]]
    return dom


def _most_text(dom: Dom) -> list[int]:
    """Nodes that are noise by name only and yet hold most of the page's text that tags and roles leave and links do not.

    A page with an article tells its text from long comments by that.
    """
    if not any(dom.named) or any(t in ("article", "main") and not x for t, x in zip(dom.tags, dom.noise, strict=True)):
        return []
    n, chars = len(dom.tags), [0] * len(dom.tags)
    out = [False] * n
    for i in range(1, n):
        out[i] = out[dom.parents[i]] or (dom.noise[i] and not dom.named[i]) or dom.tags[i] == "a"
    for i, text in dom.runs:
        if text is not None and not out[i]:
            chars[i] += len(" ".join(text.split()))
    for i in range(n - 1, 0, -1):
        chars[dom.parents[i]] += chars[i]
    return [i for i in range(1, n) if dom.named[i] and 2 * chars[i] > chars[0]]


def _close(dom: Dom, stack: list[int], tag: str) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        own = dom.tags[stack[depth]]
        if own == tag or (own == "#comment" and tag not in INLINE and depth == _last_block(dom, stack)):
            if tag not in INLINE:
                dom.runs.append((stack[depth], None))
            del stack[depth:]
            return
        if tag in INLINE and own not in INLINE:
            return  # an inline end tag does not close blocks


def _last_block(dom: Dom, stack: list[int]) -> int:
    return next((d for d in range(len(stack) - 1, 0, -1) if dom.tags[stack[d]] not in INLINE), 0)


def _close_implied(dom: Dom, stack: list[int], tags: set[str], scopes: frozenset[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        own = dom.tags[stack[depth]]
        if own in tags:
            del stack[depth:]
            return
        if own in scopes:
            return


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Characters per tag, lowered as more of them are link text; ``ratio`` is the link share of the whole body."""
    if not chars:
        return 0.0
    tags, links, linked = max(1, tags), max(1, link_tags), max(1, link_chars)
    base = math.log(chars / max(1, chars - link_chars) * linked + ratio * chars + math.e)
    return chars / tags * math.log(chars / linked * tags / links + 1) / base


def content_nodes(dom: Dom, texts: dict[int, int]) -> list[bool]:
    """Which nodes belong to the content; ``texts``: characters directly in each node.

    Formatting elements are part of their block: only blocks and links are nodes of the density tree. A block's own
    text counts as one more child. A chosen subtree inside an article is taken as the whole article; others are
    joined with what lies between them, short of the body.
    """
    n = len(dom.tags)
    block, linked = list(range(n)), [False] * n
    for i in range(1, n):
        p = dom.parents[i]
        block[i] = block[p] if dom.tags[i] in INLINE or dom.tags[i] == "br" else i
        linked[i] = dom.tags[i] == "a" or linked[p]
    own, own_links, anchors = [0] * n, [0] * n, [0] * n
    for i, size in texts.items():
        own[block[i]] += size
        own_links[block[i]] += size if linked[i] else 0
    for i in range(1, n):
        anchors[block[i]] += dom.tags[i] == "a" and not dom.noise[i]
    chars, link_chars, link_tags, tags = own[:], own_links[:], anchors[:], anchors[:]
    for i in range(n - 1, 0, -1):
        if block[i] == i and not dom.noise[i]:
            p = block[dom.parents[i]]
            for sums in (chars, link_chars, link_tags, tags):
                sums[p] += sums[i]
            tags[p] += 1
    body = next((i for i in range(n) if dom.tags[i] == "body"), 0)
    ratio = link_chars[body] / max(1, chars[body])
    density = [_density(chars[i], tags[i], link_chars[i], link_tags[i], ratio) if block[i] == i and not dom.noise[i] else 0.0 for i in range(n)]
    total = [_density(own[i], anchors[i], own_links[i], anchors[i], ratio) if density[i] else 0.0 for i in range(n)]
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        if density[i]:
            total[block[dom.parents[i]]] += density[i]
    for i in range(n - 1, 0, -1):
        p = block[dom.parents[i]]
        if density[i] and total[best[i]] >= total[best[p]] * (1 + 1e-12):
            best[p] = best[i]
    top = i = best[body]
    threshold = density[top]
    while i > 0 and i != body:
        i = block[dom.parents[i]]
        threshold = min(threshold, density[i])
    article = [0] * n  # the outermost article or main around each node
    for i in range(1, n):
        article[i] = article[dom.parents[i]] or (i if dom.tags[i] in ("article", "main") and not dom.noise[i] else 0)
    chosen = {best[i] for i in range(n) if density[i] >= threshold and density[i] and block[i] == i and i >= body}
    if article[top]:
        chosen = {article[i] for i in chosen if article[i]}
    else:
        paths = [_path(dom, i) for i in chosen]
        common = next((i for i in paths[0] if all(i in p for p in paths)), 0)
        chosen = {common} if common > 0 and common != body else chosen
    content = [False] * n
    for i in range(n):
        content[i] = (i in chosen or (i > 0 and content[dom.parents[i]])) and not dom.noise[i]
    return content


def _path(dom: Dom, node: int) -> list[int]:
    found = []
    while node >= 0:
        found.append(node)
        node = dom.parents[node]
    return found


def main_text(html: str) -> str:
    """The blocks of the content in page order, white space inside each made one blank, joined by one blank."""
    dom = parse(html)
    sizes: dict[int, int] = {}
    for node, text in dom.runs:
        if text is not None and not dom.noise[node]:
            found = len(" ".join(unescape(text).split()))
            if found:
                sizes[node] = sizes.get(node, 0) + found
    if not sizes:
        return ""
    content = content_nodes(dom, sizes)
    parts = [" " if text is None else text for node, text in dom.runs if text is None or content[node]]
    return " ".join(unescape("".join(parts)).split())


RESULTS = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html`` but with ``text`` and ``n_chars`` (code points).

    Null and empty pages, and pages of boilerplate only, have the empty text. Repeated rows are read alike;
    columns of ``pages`` named like a result are replaced.
    """
    def work(texts: pa.Array) -> dict[str, pa.Array]:
        found = [main_text(h) if h else "" for h in texts.to_pylist()]
        return {"text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())}

    return map_texts(pages, RESULTS, lambda: work, html, drop_text=True, limit=8 << 20)
