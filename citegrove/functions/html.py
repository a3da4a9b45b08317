"""Exact HTML to text for pages whose nesting patterns can't follow."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and classes whose content isn't read.
SKIP_TAGS = {"script", "style", "nav", "header", "footer", "button"}
SKIP_CLASSES = {
    "ltx_bibliography", "ltx_page_navbar", "ltx_page_footer", "ltx_dates", "ltx_authors", "ltx_role_affiliationtext", "ltx_TOC", "ltx_page_header",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "li", "tr", "table", "ul", "ol", "figure", "figcaption", "blockquote", "br"}


class _Reader(HTMLParser):
    """Collects the text outside skipped elements; a stack of open elements tells when a skipped one ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.out: list[str] = []

    @property
    def skipping(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(attrs)
        skip = self.skipping or tag in SKIP_TAGS or bool(SKIP_CLASSES & set((a.get("class") or "").split()))
        if tag == "math" and not skip:
            self.out.append(f" {a.get('alttext') or ''} ")
            skip = True
        if not skip:
            if re.fullmatch("h[1-6]", tag):
                self.out.append("\n\n## ")
            elif tag in BLOCKS:
                self.out.append("\n")
        if tag not in VOID:
            self.open.append((tag, skip))

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.open]:
            return
        was = self.skipping
        while self.open and self.open.pop()[0] != tag:
            pass
        if not was and tag in ("td", "th"):
            self.out.append(" | ")
        elif not was and (tag in BLOCKS or re.fullmatch("h[1-6]", tag)):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.out.append(data)


def html_to_text(page: str | None) -> str | None:
    """The readable text of a page, of its article element if it has one; null for null."""
    if page is None:
        return None
    article = re.search(r"(?is)<article\b.*</article\s*>", page)
    r = _Reader()
    r.feed(article[0] if article else page)
    r.close()
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(r.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_text_exact(html: Column) -> Column:
    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(html_to_text, na_action="ignore")

    return convert(html)
