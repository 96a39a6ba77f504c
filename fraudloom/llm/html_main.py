"""Main text of web pages by tree scoring.

Each paragraph passes points for its length and commas to its ancestors (all to the nearest container, half to the
next, less further up), discounted by link density; the best container and those of its siblings that score close
to it are kept. Navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
cut from the tree first, by element, role, or a class or id whose name says so as a whole (``cookie-notice``, but not
``social-security``); a paragraph or cell is cut only if all its class names and its id say so.

Each page is handled on its own, in place; no shuffle. Markup is read by one linear pattern and open elements are found by
their kind, so broken or very long pages cost time in proportion to their length. An element that is never closed ends
with its parent; only the content of scripts, styles, text fields and frames is skipped up to their end tag.

Defined results: a null or empty page, or one without text outside the parts cut, has an empty text. A page without
any scored paragraph keeps its article or main element, else its body. Ties between containers go to the deeper,
then the earlier one. Repeated rows and rows without an id are handled each on its own. An empty table gives no rows;
further columns, whatever their names, take no part.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

C = F.col
TOKEN = re.compile(r"""<!--.*?-->|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"<]*+"|'[^'<]*+'|[^<>])*+)>|<[!?][^<>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea iframe".split())
CUT = frozenset("nav header footer aside form menu dialog button fieldset head select noscript template".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
PARAGRAPH = frozenset("p pre li dd dt td th blockquote figcaption h1 h2 h3 h4 h5 h6 summary address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key closes open elements of these kinds, up to the nearest container.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
JUNK_WORDS = frozenset("""ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation
menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices notification
alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments respond replies
disqus related recommended widget toolbar pagination pager skip""".split())
#: Words that say nothing about what a part holds: a name made of these and junk words is junk.
PLAIN_WORDS = frozenset("""area articles bar block bottom box btn button buttons card cards col column container content cover div email
entry fixed form google group head icon icons id inner item items js left link links list main media mobile module outer page panel posts
primary related right row section secondary site slot small sticky stories sub text title to top unit user view wrap wrapper the and
post side global desktop large medium default policy us""".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
SPLIT = re.compile(r"[^a-z0-9]+")
RAW_END = {t: re.compile(rf"</{t}\b[^<>]*>", re.I) for t in RAW}
#: Elements of drawings and formulas that may close themselves.
EMPTY = frozenset("svg path circle rect line use g polygon polyline ellipse stop image math mspace mrow none".split())


def _junk_name(name: str, own_header: bool) -> bool:
    """Whether a class or id names a part that is cut: junk words and plain ones only (figures aside)."""
    words = {w for w in SPLIT.split(name) if w and not w.isdigit()}
    junk = words & JUNK_WORDS
    return bool(junk) and words <= JUNK_WORDS | PLAIN_WORDS and not (own_header and junk == {"header"})


def _junk(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is cut; ``inside``: within an article or main element, whose own header stays."""
    if tag in CUT and not (tag == "header" and inside):
        return True
    if tag in ("html", "body", "article", "main") or not attributes.strip():
        return False
    names = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            names += value.split()
        elif name == "role" and value in JUNK_ROLES:
            return True
    found = [_junk_name(x, inside) for x in names]
    return bool(found) and (all(found) if tag in PARAGRAPH else any(found))


class _Open:
    """The open elements, with the depths of each kind and of the blocks."""

    def __init__(self):
        self.stack, self.tags, self.of, self.bounds = [0], ["html"], {}, []

    def push(self, element: int, tag: str) -> None:
        depth = len(self.stack)
        self.stack.append(element)
        self.tags.append(tag)
        self.of.setdefault(tag, []).append(depth)
        if tag in BLOCK:
            self.bounds.append(depth)

    def cut(self, depth: int) -> None:
        """Close the element at ``depth`` and all in it."""
        while len(self.stack) > depth:
            self.stack.pop()
            tag = self.tags.pop()
            self.of[tag].pop()
            if self.bounds and self.bounds[-1] == len(self.stack):
                self.bounds.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the nearest element of its kind; one of no block does not reach out of the block it is in."""
        at = self.of.get(tag)
        if at and (tag in BLOCK or at[-1] >= (self.bounds[-1] if self.bounds else 0)):
            self.cut(at[-1])

    def before(self, tag: str) -> None:
        """Close what the start tag of a block closes: paragraphs, headings, and its like in lists and tables."""
        ends = CLOSES.get(tag, ())
        while self.bounds:
            depth = self.bounds[-1]
            t = self.tags[depth]
            if t != "p" and t not in HEADING and t not in ends:
                break
            self.cut(depth)
            if t == tag or tag not in CLOSES or t in ends and tag != "tr":  # a row closes its cell and the row before
                break


def _blocks(html: str):
    """Elements as (tag, parent) lists, and blocks of text as [element, pieces, characters in links]."""
    tags, parents, junk, links, inside, block_of = ["html"], [-1], [False], [False], [False], [0]
    open_, blocks, fresh, pos = _Open(), [], True, 0

    def text(raw: str) -> None:
        nonlocal fresh
        top = open_.stack[-1]
        if junk[top] or not raw:
            return
        t = unescape(raw) if "&" in raw else raw
        if fresh:
            if t.isspace():
                return
            blocks.append([block_of[top], [], 0])
            fresh = False
        blocks[-1][1].append(t)
        if links[top]:
            blocks[-1][2] += len(t)

    while m := TOKEN.search(html, pos):
        text(html[pos:m.start()])
        pos = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                fresh = True
            if tag not in VOID and tag != "html" and tag != "body":
                open_.end(tag)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = RAW_END[tag].search(html, pos)
                pos = end.end() if end else len(html)
            continue
        if tag in VOID:
            if tag in BLOCK:
                fresh = True
            elif tag == "br":
                text(" ")
            continue
        if tag in BLOCK:
            fresh = True
            open_.before(tag)
        up = open_.stack[-1]
        tags.append(tag)
        parents.append(up)
        junk.append(junk[up] or _junk(tag, m[3], inside[up]))
        links.append(links[up] or tag == "a")
        inside.append(inside[up] or tag in ("article", "main"))
        block_of.append(len(tags) - 1 if tag in BLOCK else block_of[up])
        if not m[3].rstrip().endswith("/") or tag in BLOCK or tag not in EMPTY:
            open_.push(len(tags) - 1, tag)
    text(html[pos:])
    return tags, parents, blocks


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tags, parents, blocks = _blocks(html)
    n = len(tags)
    points, chars, linked = [0.0] * n, [0] * n, [0] * n
    texts = []
    for i, pieces, in_links in blocks:
        t = " ".join("".join(pieces).split())
        texts.append(t)
        chars[i] += len(t)
        linked[i] += min(in_links, len(t))
        if not t or tags[i] in HEADING:
            continue
        worth = (1 + t.count(",") + min(len(t) / 100, 3)) * (1 - min(in_links, len(t)) / len(t))
        node, level = parents[i] if tags[i] in PARAGRAPH and parents[i] >= 0 else i, 1
        while node >= 0 and level <= 5:
            points[node] += worth / (level if level < 3 else 2 * level)
            node, level = parents[node], level + 1
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parents[i]] + 1
    for i in range(n - 1, 0, -1):
        chars[parents[i]] += chars[i]
        linked[parents[i]] += linked[i]
    score = [0.0] * n
    for i in range(n):
        if points[i]:
            bonus = 25.0 if tags[i] in ("article", "main") else 0.0
            score[i] = (points[i] + bonus) * (1 - linked[i] / max(chars[i], 1))
    best = max(range(n), key=lambda i: (score[i], depth[i], -i))
    if not score[best]:
        best = next((i for i in range(n) if tags[i] in ("article", "main") and chars[i]), 0)
        chosen = {best}
    else:
        least = max(10.0, 0.2 * score[best])
        chosen = {i for i in range(n) if parents[i] == parents[best] >= 0 and score[i] >= least} | {best}
    kept = [False] * n
    for i in range(n):
        kept[i] = i in chosen or (i > 0 and kept[parents[i]])
    return " ".join(t for (i, _, _), t in zip(blocks, texts) if t and kept[i])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    src = pages.select("page_id", "url", "html")

    def apply(batches):
        for b in batches:
            out = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(apply, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
