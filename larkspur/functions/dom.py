"""HTML tree facts that regular expressions cannot read: spec pairs and visible product fields.

One small tolerant parser on the standard library, applied to one page at a time.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Start tags that end an open paragraph, and elements that shield a paragraph outside them.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
P_SCOPE = {"button", "td", "th", "caption", "table", "html", "object", "template", "marquee", "applet"}
PRICE = re.compile(r"\d[\d\s.,:-]{0,24}\s*(?:kr|sek|eur|usd)\b|\d[\d\s.,:-]{0,24}", re.IGNORECASE)

PAIR = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
DOM_FIELDS = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("price_raw", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("images", T.ArrayType(T.StringType())), T.StructField("pairs", T.ArrayType(PAIR)),
])


def _clean(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


class _Facts(HTMLParser):
    """Collects texts of open elements; a closing tag turns them into facts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict, list[str]]] = []
        self.meta: dict[str, str] = {}
        self.pairs: list[tuple[str, str]] = []
        self.images: list[str] = []
        self.h1 = self.price = self.brand = self.described = self.paragraph = ""
        self.term = ""
        self.cells: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: (v or "") for k, v in attrs}
        if tag in ENDS_P and self._paragraph_open():
            self.handle_endtag("p")
        if tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            self.meta.setdefault(name, _clean(a.get("content")))
        if tag == "img" and a.get("src"):
            self.images.append(a["src"].strip())
        for key in ("content", "data-price", "data-price-amount"):
            if a.get(key) and (a.get("itemprop") == "price" or key != "content"):
                self._take_price(a[key])
        if tag not in VOID:
            self.stack.append((tag, a, []))

    def handle_data(self, data: str) -> None:
        if any(tag in ("script", "style") for tag, _, _ in self.stack[-1:]):
            return
        for _, _, parts in self.stack:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        while self.stack and any(t == tag for t, _, _ in self.stack):
            open_tag, attrs, parts = self.stack.pop()
            self._close(open_tag, attrs, _clean(" ".join(parts)))
            if open_tag == tag:
                break

    def _paragraph_open(self) -> bool:
        inner = next((t for t, _, _ in reversed(self.stack) if t == "p" or t in P_SCOPE), None)
        return inner == "p"

    def _take_price(self, text: str) -> None:
        m = PRICE.search(text)
        if m and not self.price:
            self.price = m.group(0).strip()

    def _pair(self, key: str, value: str) -> None:
        if key and value and (key, value) not in self.pairs:
            self.pairs.append((key, value))

    def _close(self, tag: str, attrs: dict, text: str) -> None:
        marks = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('data-testid', '')}".lower()
        if tag == "h1" and not self.h1:
            self.h1 = text
        elif tag == "dt":
            self.term = text
        elif tag == "dd":
            self._pair(self.term, text)
            self.term = ""
        elif tag in ("td", "th"):
            self.cells.append(text)
        elif tag == "tr":
            if len(self.cells) >= 2:
                self._pair(self.cells[0], self.cells[1])
            self.cells = []
        elif tag == "li" and ":" in text:
            key, _, value = text.partition(":")
            self._pair(key.strip(), value.strip())
        elif tag == "p" and not self.paragraph and len(text) >= 40:
            self.paragraph = text
        if "price" in marks or "pricing" in marks or attrs.get("itemprop") == "price":
            self._take_price(text)
        if not self.brand and (attrs.get("itemprop") == "brand" or "product-brand" in marks or "brand-name" in marks):
            self.brand = text
        if not self.described and (attrs.get("itemprop") == "description" or "product-description" in marks
                                   or "description" in marks.split()):
            self.described = text


def page_facts(html: str) -> dict:
    f = _Facts()
    f.feed(html)
    f.close()
    m = f.meta
    return {
        "title": m.get("og:title") or f.h1 or None,
        "description": m.get("og:description") or m.get("description") or f.described or f.paragraph or None,
        "price_raw": m.get("product:price:amount") or f.price or None,
        "brand": m.get("product:brand") or m.get("og:brand") or f.brand or None,
        "images": f.images, "pairs": [{"key": k, "value": v} for k, v in f.pairs],
    }


@F.udf(DOM_FIELDS, useArrow=False)
def dom_fields(html):
    """Row by row: pages are large, so a worker holds the few of a pickled batch and not the thousands of an Arrow batch."""
    return page_facts(html) if isinstance(html, str) else {"title": None, "description": None, "price_raw": None, "brand": None, "images": [], "pairs": []}
