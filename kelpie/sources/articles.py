"""The main part of a page by scores of its elements, and its markdown without what is noise.

A page is read by one task as a flat list of elements in their order, each with the numbers of its subtree, which are summed from the last
element to the first. Markdown is made in the same order, so that no depth of nesting needs recursion; elements nested more than
512 deep belong to the one at that depth. Cases: an end tag closes what was left open within its element, one without a start is
passed over, null pages give an empty text and no elements; text in scripts, styles and heads is never counted or shown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kelpie.functions import parsing as ps

#: Elements without content of their own, without end tags, that stand as blocks, and that may be the main part.
IGNORED = {"head", "meta", "script", "style", "noscript", "template", "svg", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"article", "aside", "body", "div", "footer", "header", "main", "section"}
CANDIDATES = {"article", "main", "section", "div"}
#: Marks (id, class and role) of content and of noise, and what is always noise by element, class or id.
CONTENT_MARK = re.compile(r"article|post|story|entry|content|body|main", re.I)
NOISE_MARK = re.compile(r"comment|footer|related|share|social|promo|advert|newsletter|subscribe|outbrain|taboola|sidebar|toolbar|cookie|banner|modal|popup|nav|menu", re.I)
NOISE_MAY_BE = {"aside", "div", "section", "ul", "ol"}
NOISE_ELEMENTS = {"aside", "footer", "form", "nav"}
NOISE_CLASSES = {
    "entry-header", "author-bio", "ambox", "catlinks", "comments", "comments-area", "contributors", "cdc-page-title", "cdc-page-title-bar",
    "entry-footer", "feedback", "hatnote", "infobox", "jp-relatedposts", "metadata", "mw-editsection", "navbox", "newsletter-form",
    "page-content-sources", "post-navigation", "reflist", "related", "related-posts", "sharedaddy", "sharing", "shortdescription", "toc",
}
NOISE_IDS = {"jp-relatedposts", "siteSub"}
#: The least text of a main part, the most of a noisy one, and what each thing adds to a score.
LEAST, MOST_NOISE, DEEPEST = 280, 700, 512
PARAGRAPH, HEADING, IMAGE, ARTICLE, MAIN, MARKED, NOISE, LINKS = 420, 160, 80, 800, 500, 450, 900, 1.6

_CLOSED_BY = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, **dict.fromkeys(("p", "div", "ul", "ol", "table", "section", "article", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "hr"), {"p"})}
_BOUNDS = {"ul", "ol", "table", "div", "section", "article", "main", "body", "blockquote", "td", "th", "li", "figure"}


def inline(text: str) -> str:
    """White space collapsed, none before punctuation or within brackets."""
    text = re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\s+", " ", text))
    return re.sub(r"\s+\)", ")", re.sub(r"\(\s+", "(", text)).strip()


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def _spaced(left: str, right: str) -> bool:
    a, b = left[-1], right[0]
    return (a.isalnum() or a in "\"'*)]") and (b.isalnum() or b in "[(`\"'*_")


def joined(parts: list[str]) -> str:
    """The parts in a row, with a blank where two words would meet."""
    made: list[str] = []
    for part in parts:
        if part:
            if made and _spaced(made[-1], part):
                made.append(" ")
            made.append(part)
    return "".join(made)


class Element:
    __slots__ = ("attrs", "begin", "children", "chars", "end", "headings", "images", "link_chars", "number", "paragraphs", "parent", "tag")

    def __init__(self, number: int, tag: str, attrs: dict, parent: Element | None, begin: tuple[int, int]):
        self.number, self.tag, self.attrs, self.parent, self.begin, self.end = number, tag, attrs, parent, begin, begin
        self.children: list[Element | str] = []
        self.chars = self.link_chars = self.paragraphs = self.headings = self.images = 0

    @property
    def mark(self) -> str:
        return " ".join(self.attrs.get(k) or "" for k in ("id", "class", "role"))

    def is_candidate(self) -> bool:
        return self.tag in CANDIDATES or self.attrs.get("role") == "main" or self.attrs.get("itemprop") == "articleBody"

    def score(self) -> float | None:
        """How likely the element is the page's main part; none with too little text."""
        if self.chars < LEAST:
            return None
        bonus = ARTICLE * (self.tag == "article") + MAIN * (self.tag == "main") + MARKED * bool(CONTENT_MARK.search(self.mark)) - NOISE * bool(NOISE_MARK.search(self.mark))
        return float(self.chars + PARAGRAPH * self.paragraphs + HEADING * self.headings + IMAGE * self.images + bonus - LINKS * self.link_chars)

    def is_noise(self) -> bool:
        a, classes = self.attrs, set((self.attrs.get("class") or "").split())
        if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ("navigation", "complementary") or a.get("data-action") in ("print", "share", "summary"):
            return True
        if self.tag in NOISE_ELEMENTS or classes & NOISE_CLASSES or a.get("id") in NOISE_IDS:
            return True
        return self.tag in NOISE_MAY_BE and self.chars < MOST_NOISE and bool(NOISE_MARK.search(self.mark))


class Page(HTMLParser):
    """A page's elements in order, after one that stands for the page itself. Places are kept in the text as it stands and in the text with white space collapsed."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements = [Element(0, "", {}, None, (0, 0))]
        self.open = self.elements[:]
        self.raw: list[str] = []
        self.collapsed: list[str] = []
        self.beyond: list[str] = []
        self.at, self.flat, self.blank = 0, 0, True
        self.feed(html)
        self.close()
        self._close_to(0)
        self.text = "".join(self.raw)
        self._sum("".join(self.collapsed))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("body", "html") and any(e.tag == tag for e in self.open):
            return
        if tag in CONTAINERS or tag == "p" or re.fullmatch("h[1-6]", tag):  # a head ends where content begins
            head = next((i for i, e in enumerate(self.open) if e.tag == "head"), None)
            if head is not None:
                self._close_to(head)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in _CLOSED_BY.get(tag, ()):
                self._close_to(i)
                if tag != "tr":
                    break
            elif self.open[i].tag in _BOUNDS:
                break
        if len(self.open) >= DEEPEST and tag not in VOID:
            self.beyond.append(tag)
            return
        element = Element(len(self.elements), tag, dict(attrs), self.open[-1], (self.at, self.flat))
        self.elements.append(element)
        element.parent.children.append(element)
        self.open.append(element)
        if tag in VOID:
            self._close_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.beyond and tag in self.beyond:
            del self.beyond[len(self.beyond) - 1 - self.beyond[::-1].index(tag) :]
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._close_to(i)
                return

    def handle_data(self, data: str) -> None:
        if not data or any(e.tag in IGNORED or e.tag == "title" for e in self.open):
            return
        self.open[-1].children.append(data)
        self.raw.append(data)
        self.at += len(data)
        flat = re.sub(r"\s+", " ", data)
        if self.blank and flat.startswith(" "):
            flat = flat[1:]
        if flat:
            self.collapsed.append(flat)
            self.flat += len(flat)
            self.blank = flat.endswith(" ")

    def _close_to(self, size: int) -> None:
        while len(self.open) > size:
            self.open.pop().end = (self.at, self.flat)

    def _sum(self, flat: str) -> None:
        """The numbers of each subtree, from the last element to the first: children come after their parents."""
        for e in reversed(self.elements):
            begin, end = e.begin[1], e.end[1]
            begin += begin < end and flat[begin] == " "
            end -= begin < end and flat[end - 1] == " "
            e.chars = end - begin
            if e.tag == "a":
                e.link_chars = e.chars
            if up := e.parent:
                up.link_chars += e.link_chars
                up.paragraphs += e.paragraphs + (e.tag == "p")
                up.headings += e.headings + (e.tag in ("h1", "h2", "h3"))
                up.images += e.images + (e.tag in ("img", "figure"))

    def text_of(self, e: Element) -> str:
        return self.text[e.begin[0] : e.end[0]]

    def scored(self) -> list[tuple[Element, float]]:
        return [(e, score) for e in self.elements if e.is_candidate() and (score := e.score()) is not None]

    def within(self, e: Element) -> list[Element]:
        """The element and those in it, in order: their numbers follow its own."""
        last = e.number + 1
        inside = {e.number}
        while last < len(self.elements) and self.elements[last].parent and self.elements[last].parent.number in inside:
            inside.add(last)
            last += 1
        return self.elements[e.number : last]

    def render(self, root: Element, base: str) -> str:
        """Markdown of an element without the noise in it, with addresses made whole from the base."""
        made: dict[int, str] = {}
        for e in reversed(self.within(root)):
            made[e.number] = "" if e.tag in IGNORED or (e is not root and e.is_noise()) else self._rendered(e, made, base)
        return tidy(made[root.number])

    def _rendered(self, e: Element, made: dict[int, str], base: str) -> str:
        shown = [made[c.number] if isinstance(c, Element) else (re.sub(r"\s+", " ", c) if c.strip() else "") for c in e.children]
        tag = e.tag
        if tag == "br":
            return "\n"
        if tag == "hr":
            return "\n---\n\n"
        if re.fullmatch("h[1-6]", tag):
            name = inline(self.text_of(e))
            return f"{'#' * int(tag[1])} {name}\n\n" if name else ""
        if tag == "pre":
            code = self.text_of(e).rstrip("\n")
            return f"```\n{code}\n```\n\n" if code else ""
        if tag == "img":
            source = whole_address(e.attrs.get("src"), base)
            return f"![{e.attrs.get('alt') or ''}]({source})" if source else ""
        if tag in ("ul", "ol"):
            return self._list(e, made)
        if tag == "table":
            return self._table(e, made)
        if tag == "figure":
            body = tidy(joined([s for s, c in zip(shown, e.children, strict=True) if not (isinstance(c, Element) and c.tag == "figcaption")]))
            caption = next((inline(self.text_of(c)) for c in self.within(e) if c.tag == "figcaption"), "")
            return tidy("\n\n".join(filter(None, [body, caption and f"*{caption}*"]))) + "\n\n"
        if tag != "figcaption" and tag not in ("code", "strong", "b", "em", "i", "a") and re.search("caption|credit", e.attrs.get("class") or "", re.I):
            caption = inline(self.text_of(e))
            return f"\n\n*{caption}*\n\n" if caption else ""
        content = joined(shown)
        if tag in CONTAINERS or tag == "blockquote":
            content = tidy(content)
            if tag == "blockquote":
                content = "\n".join(f"> {x}" if x else ">" for x in content.split("\n")) if content else ""
            return f"{content}\n\n" if content else ""
        if tag == "p":
            return f"{inline(content)}\n\n" if inline(content) else ""
        if tag in ("strong", "b", "em", "i", "code"):
            content, mark = inline(self.text_of(e) if tag == "code" else content), {"strong": "**", "b": "**", "code": "`"}.get(tag, "*")
            return f"{mark}{content}{mark}" if content else ""
        if tag == "a":
            to = whole_address(e.attrs.get("href"), base)
            return f"[{inline(content) or to}]({to})" if to else inline(content)
        return content

    @staticmethod
    def _list(e: Element, made: dict[int, str]) -> str:
        lines, items = [], [c for c in e.children if isinstance(c, Element) and c.tag == "li"]
        for n, item in enumerate(items, 1):
            said, below = [], []
            for c in item.children:
                if isinstance(c, Element) and c.tag in ("ul", "ol"):
                    below += [f"  {x}" if x else x for x in made[c.number].rstrip("\n").split("\n")]
                else:
                    said.append(made[c.number] if isinstance(c, Element) else re.sub(r"\s+", " ", c) if c.strip() else "")
            lines += [f"{n}. {inline(joined(said))}" if e.tag == "ol" else f"- {inline(joined(said))}", *filter(None, below)]
        return "\n".join(lines) + "\n\n" if lines else ""

    def _table(self, e: Element, made: dict[int, str]) -> str:
        rows = [[inline(joined([made[x.number] if isinstance(x, Element) else x if x.strip() else "" for x in c.children])) for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in self.within(e) if r.tag == "tr"]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        head, *body = (f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows)
        return "\n".join([head, f"| {' | '.join(['---'] * width)} |", *body]) + "\n\n"

    def first(self, within: Element | None, *tests) -> str:
        """The text of the first element within that meets a test; empty if none does."""
        found = (e for e in (self.within(within) if within else ()) if any(t(e) for t in tests))
        return inline(self.text_of(e)) if (e := next(found, None)) else ""


def whole_address(address: str | None, base: str) -> str:
    """An address seen from the base; anchors, data, mail and the like stay as they are, and so do those that can't be read."""
    if not address or not base or re.match(r"#|(?:data|mailto|tel|javascript):", address, re.I):
        return address or ""
    try:
        return urljoin(base, address)
    except ValueError:
        return address


def _has(*classes: str, **attrs: str):
    return lambda e: bool(set(classes) & set((e.attrs.get("class") or "").split())) or any((e.attrs.get(k) or "") == v for k, v in attrs.items())


def article_of(html: str | None, url: str, title: str, author: str, published: str) -> str:
    """Title, byline and main part of a page as markdown; all of its main element, article or body if no part scores."""
    if not html:
        return ""
    page = Page(html)
    named = lambda tag: next((e for e in page.elements if e.tag == tag), None)
    scored = page.scored()
    if scored:
        best = max(scored, key=lambda s: (s[1], -s[0].number))[0]
        body = page.render(best, url)
        if len(body) >= LEAST:
            around = best
            while around and around.tag != "article":
                around = around.parent
            around = around or named("article") or named("main") or named("body")
            title = page.first(around, _has("entry-title", itemprop="headline"), lambda e: e.tag == "h1") or title
            author = page.first(around, _has("posted-by", "byline", rel="author", itemprop="author")) or author
            published = page.first(around, lambda e: e.tag == "time" and "datetime" in e.attrs, _has(itemprop="datePublished")) or published
            body = body.removeprefix(f"# {title}\n\n")
            if published:
                body = body.removeprefix(f"{published}\n\n").removesuffix(f"\n\n{published}")
            byline = ", ".join(filter(None, (author, published)))
            return tidy("\n\n".join(filter(None, (title and f"# {title}", byline and f"*{byline}*", body.strip()))))
    root = named("main") or named("article") or named("body") or page.elements[0]
    return page.render(root, url)


def content_scores(pages: DataFrame, id_col: str, html: Column) -> DataFrame:
    """id, node (the element's place among all, from 1), tag, chars, link_chars, paragraphs, headings, images and score of each element that may
    be a page's main part and has text enough."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["id", "node", "tag", "chars", "link_chars", "paragraphs", "headings", "images", "score"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, text in zip(batch["id"], batch["html"], strict=True):
                found = Page(text).scored() if isinstance(text, str) else []
                rows += [(id_, e.number, e.tag, e.chars, e.link_chars, e.paragraphs, e.headings, e.images, score) for e, score in found]
            yield pd.DataFrame(rows, columns=names)

    schema = f"id {kind}, node long, tag string, chars long, link_chars long, paragraphs long, headings long, images long, score double"
    return pages.select(F.col(id_col).alias("id"), html.alias("html")).mapInPandas(read, schema)


def article(html: Column, url: Column) -> Column:
    """The page's article as markdown; what the page doesn't show is taken from its metadata, as is its own address. Pages go to Python some
    hundred at a time, so that a worker's memory doesn't grow with the rows it is given."""

    def convert(page: str | None, address: str | None, meta: Row | None) -> str:
        own, title, author, published = (meta[c] if meta is not None else None for c in ("url", "title", "author", "published"))
        return article_of(page, own or address or "", title or "", author or "", published or "")

    return F.udf(convert, "string", useArrow=False)(html, url, ps.page_metadata(html))
