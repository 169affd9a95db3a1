"""Raw pages to markdown: headings, paragraphs, list items and links of the page's main part."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is never content, what stands apart, what has no end tag, and what can stand in a head.
_SKIPPED = {"script", "style", "nav", "footer", "aside", "noscript", "template", "svg", "form"}
_BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "br", "body", "header", "figure", "dl", "dt", "dd"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_IN_HEAD = {"base", "link", "meta", "title", "script", "style", "noscript", "template", "head", "html"}


class _Markdown(HTMLParser):
    """Open elements are a stack; an end tag also closes what was left open within its element, a skip among it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[str] = []
        self.links: list[tuple[int, int, str | None]] = []

    def _skips(self) -> bool:
        return any(t in _SKIPPED or t in ("head", "title") for t in self.open)

    def _close_to(self, size: int) -> None:
        while self.links and self.links[-1][0] >= size:
            _, at, href = self.links.pop()
            label = " ".join("".join(self.parts[at:]).split())
            self.parts[at:] = [f"[{label}]({href})" if href and label else label]
        del self.open[size:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if "head" in self.open and tag not in _IN_HEAD:  # a head ends where the body's content begins
            self._close_to(self.open.index("head"))
        if tag == "body":  # what the head left open ends too
            self._close_to(0)
        if tag in ("li", "tr", "td", "th", "p") and tag in self.open:  # the same element after another ends it
            last = len(self.open) - 1 - self.open[::-1].index(tag)
            if not {"ul", "ol", "table"} & set(self.open[last:]) and not any(t in _SKIPPED for t in self.open[last:]):
                self._close_to(last)
        if tag not in _VOID:
            self.open.append(tag)
        if self._skips():
            return
        if re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag in ("td", "th"):
            self.parts.append(" | ")
        elif tag == "tr":
            self.parts.append("\n")
        elif tag == "pre":
            self.parts.append("\n\n```\n")
        elif tag in _BLOCKS:
            self.parts.append("\n\n")
        elif tag == "a":
            self.links.append((len(self.open) - 1, len(self.parts), dict(attrs).get("href")))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        skipped = self._skips()
        self._close_to(len(self.open) - 1 - self.open[::-1].index(tag))
        if skipped or self._skips():
            return
        if tag == "pre":
            self.parts.append("\n```\n\n")
        elif tag not in ("tr", "td", "th") and (tag in _BLOCKS or re.fullmatch("h[1-6]", tag)):
            self.parts.append("\n\n")

    def handle_data(self, data: str) -> None:
        if data.strip() and "head" in self.open and not {"title", *_SKIPPED} & set(self.open):
            self._close_to(self.open.index("head"))
        if not self._skips():
            self.parts.append(data if "pre" in self.open else re.sub(r"\s+", " ", data))

    def close(self) -> None:
        super().close()
        self._close_to(0)


def to_markdown(html: str | None) -> str:
    """Markdown of a page; of its article or main element if it has one."""
    if not html:
        return ""
    main = re.search(r"(?is)<(article|main)\b.*</\1\s*>", html)
    parser = _Markdown()
    parser.feed(main.group(0) if main else html)
    parser.close()
    lines, fenced = [], False
    for line in "".join(parser.parts).split("\n"):
        mark = line.strip() == "```"
        lines.append(line.rstrip() if fenced and not mark else re.sub(r" +", " ", line).strip())
        fenced ^= mark
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def markdown(html: Column) -> Column:
    """Markdown of pages. They go to Python some hundred at a time: a worker's memory then doesn't grow with the rows it is given."""
    return F.udf(to_markdown, "string", useArrow=False)(html)


def title(html: Column) -> Column:
    """The title by priority: og:title, title element, first heading."""
    og = F.regexp_extract(html, r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)", 1)
    plain = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    heading = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    found = F.coalesce(*(F.nullif(F.trim(F.regexp_replace(x, r"(?s)<[^>]*>|\s+", " ")), F.lit("")) for x in (og, plain, heading)))
    return found
