"""Main text of a web page by composite text density."""

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table caption "
    "tbody tfoot thead tr ul").split())
# an open element of the second kind ends where one of the first begins, unless a container lies between
CLOSES = {
    **{b: ("p",) for b in BLOCK if b not in ("body", "html", "option", "tr", "tbody", "thead", "tfoot", "caption")},
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
HOLDS = {
    "p": frozenset("article aside blockquote body button div dd dt figure footer header li main nav section td th table".split()),
    "li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "option": frozenset(["select"]),
    **{c: frozenset(["table"]) for c in ("tr", "td", "th", "tbody", "thead")},
}
# elements without article text, whatever they hold
NEVER = frozenset((
    "head script style noscript template iframe object embed svg math canvas audio video map form button select "
    "textarea datalist input nav aside footer dialog menu").split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
# words of a class or id that mark what is not the article
MARKS = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promoted promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "comment comments disqus reply replies respond sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer foot copyright share sharing social related recommended newsletter subscribe subscription "
    "signup login search widget toolbar skip").split())
PAGE_HEAD = frozenset("header head masthead topbar".split())
CONTENT = frozenset("article content main post entry story body text".split())
LAYOUT = frozenset("has with no without".split())
# words beside a mark that leave it a name for a part of a page, and no heading
PARTS = frozenset((
    "area article articles bar block box btn button buttons container content form group icon icons inner item items label large "
    "link links list main media mobile module outer page panel post posts row section site slot small stories story "
    "tools top bottom left right middle unit wrap wrapper x").split())
# their ids are anchors, made from headings
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p span a article".split())
# inside an article the ids of these alone name a part
BOXES = frozenset("div ul ol dl table".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)", re.S)
TAG_PART = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _known(parts):
    """Whether a name says nothing but what part of a page it is: a mark, and words for parts beside it."""
    return not MARKS.isdisjoint(parts) and all(p in MARKS or p in PARTS or p.isdigit() for p in parts)


def _marked(tag, attributes, inside=False):
    """Whether the element's own name, role, class or id says that it is not the article.

    ``inside`` an article only whole known names count ("share-buttons", not "social-impact"), and ids of boxes only.
    Ids of headings and paragraphs count nowhere, those of sections outside articles if the whole name is known.
    """
    if tag in NEVER:
        return True
    if "=" not in attributes:
        return "hidden" in attributes.lower().split()
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or "hidden" in found:
        return True
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    ids = found.get("id", "").split() if (tag in BOXES if inside else tag not in ANCHORS) else []
    classes = found.get("class", "").split()
    for i, name in enumerate(classes + ids):
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if not LAYOUT.isdisjoint(parts):
            continue
        if _known(parts):
            return True
        if inside or (tag == "section" and i >= len(classes)):
            continue
        if not MARKS.isdisjoint(parts) or (not PAGE_HEAD.isdisjoint(parts) and CONTENT.isdisjoint(parts)):
            return True
    return False


class _Markup:
    """Finds markup from any place on. A start tag ends at the first ``>`` outside quotes; without one it is text.

    Each quote leads to one next ``>`` or quote, so those from which no end is reached are remembered,
    and no place is searched twice.
    """

    def __init__(self, source):
        self.source, self.dead = source, set()
        # from these places on there is no quote or >, and no closing quote of a kind
        self.bare, self.unclosed = len(source), {'"': len(source), "'": len(source)}

    def next(self, at):
        """(start, end, end tag, start tag, attributes) of the first markup from ``at``, or None."""
        while m := MARKUP.search(self.source, at):
            if not m[2]:
                return m.start(), m.end(), m[1], None, ""
            end = self._end(m.end())
            if end:
                return m.start(), end, None, m[2], self.source[m.end(): end - 1]
            at = m.end()
        return None

    def _end(self, at):
        path = []
        while at < self.bare:
            part = TAG_PART.search(self.source, at)
            if part is None:
                self.bare = at
                break
            here, kind = part.start(), part[0]
            if kind == ">":
                return here + 1
            if here in self.dead or here >= self.unclosed[kind]:
                break
            path.append(here)
            close = self.source.find(kind, here + 1)
            if close < 0:
                self.unclosed[kind] = here
                break
            at = close + 1
        self.dead.update(path)
        return None


class Page:
    """Elements in the order they open: parent, tag, mark; and the texts with the element they lie in."""

    def __init__(self, source):
        self.tag, self.parent, self.marked = ["#root"], [-1], [False]
        self.texts = []  # (element, text), text None at the edge of a block
        stack, open_tags, end = [0], {}, 0

        def close(tag):
            while True:
                top = stack.pop()
                open_tags[self.tag[top]] -= 1
                if self.tag[top] in BLOCK:
                    self.texts.append((self.parent[top], None))
                if self.tag[top] == tag:
                    return

        n, markup = len(source), _Markup(source)
        while found := markup.next(end):
            first, last, closing, opening, attributes = found
            if first > end:
                self.texts.append((stack[-1], source[end: first]))
            end = last
            if closing:
                tag = closing.lower()
                if open_tags.get(tag):
                    close(tag)
                elif tag == "br":
                    self.texts.append((stack[-1], " "))
            elif opening:
                tag = opening.lower()
                for old in CLOSES.get(tag, ()):
                    if open_tags.get(old):
                        holds = HOLDS[old]
                        for i in range(len(stack) - 1, 0, -1):
                            if self.tag[stack[i]] == old:
                                close(old)
                                break
                            if self.tag[stack[i]] in holds:
                                break
                if tag in BLOCK:
                    self.texts.append((stack[-1], None))
                elif tag == "br" or tag in ("td", "th"):
                    self.texts.append((stack[-1], " "))
                self.tag.append(tag)
                self.parent.append(stack[-1])
                self.marked.append(_marked(tag, attributes, inside=bool(open_tags.get("article"))))
                if tag in RAW:
                    stop = re.compile("</" + tag + r"(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(source, end)
                    self.texts.append((len(self.tag) - 1, source[end: stop.start()]))
                    end = stop.end()
                elif tag not in VOID and not attributes.endswith("/"):
                    stack.append(len(self.tag) - 1)
                    open_tags[tag] = open_tags.get(tag, 0) + 1
        if end < n:
            self.texts.append((stack[-1], source[end:]))


def _density(chars, tags, link_chars, link_tags, body_ratio):
    """Characters per tag, adjusted by how much of them is links."""
    if not chars:
        return 0.0
    tags, link_chars, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_ratio * chars + math.e)
    return chars / tags * math.log(chars / link_chars * tags / link_tags) / math.log(base)


def main_text(source):
    """The text of the article: one line per block; empty if there is none.

    Marked elements (menus, headers, footers, asides, notices, adverts, forms, comments, scripts) go, unless
    they hold an article. The density of an element is its characters per tag, adjusted by the
    share of links in it and in the page; its density sum adds up its children's densities. The element of
    the largest sum is content, and so is the best element within every one as dense as the
    thinnest element on the way from it up to the body. Content inside an <article> takes the whole
    article, and a heading right before it counts.
    """
    page = Page(source)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    holds_article = [t in ("article", "main") for t in tag]
    for i in range(n - 1, 0, -1):
        holds_article[parent[i]] |= holds_article[i]
    gone, linked, in_article = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up = parent[i]
        own = page.marked[i] and not holds_article[i] and tag[i] not in ("html", "body")
        if tag[i] == "header" and not in_article[up] and not holds_article[i]:
            own = True
        gone[i] = gone[up] or own
        linked[i] = linked[up] or tag[i] == "a"
        in_article[i] = in_article[up] or tag[i] in ("article", "main")

    chars, link_chars, tags, link_tags, loose = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    texts = []
    for i, text in page.texts:
        if gone[i]:
            continue
        if text is not None:
            text = html.unescape(text)
            size = len("".join(text.split()))
            chars[i] += size
            loose[i] += size
            if linked[i]:
                link_chars[i] += size
        texts.append((i, text))
    for i in range(n - 1, 0, -1):
        up = parent[i]
        if not gone[i]:
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (tag[i] == "a")
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
    if not chars[0]:
        return ""
    ratio = link_chars[0] / chars[0]
    density = [0.0 if gone[i] else _density(chars[i], tags[i], link_chars[i], link_tags[i], ratio) for i in range(n)]
    total = [float(x) for x in loose]
    for i in range(1, n):
        if not gone[i]:
            total[parent[i]] += density[i]
    # the best element below each, the first of equals
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        if not gone[i] and total[best[i]] >= total[best[parent[i]]]:
            best[parent[i]] = best[i]

    top = best[0]
    least, at = density[top], top
    while at > 0 and tag[at] != "body":
        at = parent[at]
        least = min(least, density[at])
    content = [False] * n
    for i in range(n):
        if not gone[i] and chars[i] and density[i] >= least:
            content[best[i]] = True
    outermost = [None] * n
    for i in range(1, n):
        outermost[i] = outermost[parent[i]] or (i if tag[i] == "article" else None)
    for i in range(n):
        if content[i] and outermost[i]:
            content[outermost[i]] = True
    # the title of what follows: a top heading beside the content or beside what holds it
    path, at = set(), top
    while at >= 0:
        path.add(at)
        at = parent[at]
    for i in range(1, n):
        if tag[i] == "h1" and parent[i] in path and i < top and not gone[i]:
            content[i] = True
    shown, inside = [False] * n, [False] * n
    for i in range(n):
        inside[i] = tag[i] == "article" or (i > 0 and inside[parent[i]])
        menu = tag[i] in ("ul", "ol", "dl", "div", "section", "table") and chars[i] and link_chars[i] > 0.7 * chars[i]
        shown[i] = not gone[i] and not (menu and not inside[i]) and (content[i] or (i > 0 and shown[parent[i]]))
    blocks, block = [], []
    for i, text in [*texts, (0, None)]:
        if text is None:
            line = " ".join("".join(block).split())
            if line:
                blocks.append(line)
            block = []
        elif shown[i]:
            block.append(text)
    return "\n".join(blocks)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x) if x else "" for x in (s.as_py() for s in batch.column("html"))]
        yield pa.RecordBatch.from_arrays([
            batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
            pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, url, text, n_chars) per page, ``main_text`` of the whole html.

    Character references are decoded, white space inside a block is one space, blocks are
    joined by line ends. Null or empty html gives an empty text; null ids and urls and
    repeated rows pass through. An empty table gives no row; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(_extract, schema)
