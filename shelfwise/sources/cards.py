"""Search tiles and offer cards of landed pages, as table functions that SQL calls laterally.

``register(spark)`` makes ``search_tiles(html)`` and ``offer_cards(html)`` known to a session:

    SELECT p.page_id, t.* FROM pages p, LATERAL search_tiles(p.html) t

A page is read by a tolerant parser into a tree of its own; nothing is kept from one page to the next.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote_plus, urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Where the pages stand, and the patterns of prices, offers, and links.
SEARCH_SITE, OFFER_SITE = "https://www.wholefoodsmarket.com", "https://www.target.com"
_MONEY = re.compile(r"(\$[\d.,]+(?:/\w+)?)")
_OFFER_MONEY = re.compile(r"\$\d+(?:\.\d{1,2})?(?:\s*-\s*\$\d+(?:\.\d{1,2})?)?")
_SAYS_VALUE = re.compile(r"\d+\s*%|bogo|\$\d+|\d+/\$\d+|save when|buy \d+")
_ID_IN_LINK = re.compile(r"(?i)-([A-Z0-9]{10})(?:\?|$)")


class Node:
    """An element: its tag, attributes, and what is inside, elements and texts in order."""

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.inside = tag, attrs, []
        self.classes = attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting.extend(x for x in reversed(node.inside) if isinstance(x, Node))

    def every(self, tag: str, *classes: str) -> list[Node]:
        """Elements inside of a tag that have, for each of ``classes``, a class that holds it."""
        return [n for n in self.walk() if n is not self and n.tag == tag and all(any(c in own for own in n.classes) for c in classes)]

    def first(self, tag: str, *classes: str) -> Node | None:
        return next(iter(self.every(tag, *classes)), None)

    def text(self) -> str:
        """Texts inside, in order, with one blank between them."""
        out: list[str] = []
        waiting: list = [self]
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                waiting.extend(reversed(x.inside))
        return " ".join(" ".join(out).split())

    def own_text(self) -> str | None:
        """The text of an element that holds nothing but one text."""
        return self.inside[0] if len(self.inside) == 1 and isinstance(self.inside[0], str) else None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].inside.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        if data.strip():
            inside = self.open[-1].inside
            if inside and isinstance(inside[-1], str):
                inside[-1] += data
            else:
                inside.append(data)


def tree(html: str | None) -> Node:
    """The elements of a page; broken markup is read as far as it goes."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _said(node: Node | None) -> str | None:
    return (node.text() or None) if node else None


def _tile(link: Node) -> tuple | None:
    top = next((n for n in link.inside if isinstance(n, Node) and n.tag == "div" and {"flex", "flex-col", "gap-2"} <= set(n.classes)), None)
    name = _said(top.first("span", "bds--heading-5")) if top else None
    if not name:
        return None
    href = link.attrs["href"]
    found = _ID_IN_LINK.search(href)
    asin = link.attrs.get("data-csa-c-content-id") or (found[1].upper() if found else None)
    image = top.first("img")
    discount = next((n for n in link.every("span") if (t := n.own_text()) and ("off" in t.lower() or "deal" in t.lower())), None)
    prime = next((n for n in link.every("p") if "Join Prime to buy this item at" in (n.own_text() or "")), None)
    money = _MONEY.search(prime.text()) if prime else None
    rows = link.every("div", "flex", "flex-wrap", "gap-2")
    current = _said(rows[-1].first("span", "bds--heading-5")) if rows else None  # rows before the last are of other sizes
    basis = _said(rows[-1].first("span", "line-through")) if rows else None
    unit = current if current and "/" in current else None
    return asin, name, _said(top.first("span", "bds--body-2")), _said(link.first("span", "bds--body-6")), image.attrs.get("src") if image else None, urljoin(SEARCH_SITE, href), current, basis, money[1] if money else None, _said(discount), unit


TILE = "pos int, asin string, name string, brand string, variation string, image string, url string, current_price string, basis_price string, prime_price string, discount string, unit_price string"


@udtf(returnType=TILE)
class SearchTiles:
    """The product tiles of a search page that have a name and stand in a ``div``."""

    def eval(self, html: str):
        links = [n for p in tree(html).walk() if p.tag == "div" for n in p.inside if isinstance(n, Node) and n.tag == "a"]
        wanted = (n for n in links if n.attrs.get("data-csa-c-type") == "productTile" and "/grocery/product/" in n.attrs.get("href", ""))
        for pos, row in enumerate(x for x in map(_tile, wanted) if x):
            yield pos, *row


def offer_value(text: str | None) -> tuple[str | None, str | None]:
    """Price and discount that the words of an offer say."""
    clean = " ".join((text or "").split())
    price = _OFFER_MONEY.search(clean)
    low = clean.lower()
    return price[0].replace(" - ", " to ") if price else None, clean if clean and ("%" in clean or low.startswith("buy") or "bogo" in low) else None


def offer_id(name: str, value: str | None, expires: str | None) -> str:
    return "target:" + hashlib.sha1(f"{name}|{value or ''}|{expires or ''}".encode()).hexdigest()[:16]


def _offer_url(href: str | None, name: str) -> str:
    href = (href or "").strip()
    if re.match("https?://", href):
        return re.sub("^http:", "https:", href)
    return OFFER_SITE + href if href.startswith("/") else f"{OFFER_SITE}/s?searchTerm={quote_plus(name)}"


def _card(card: Node) -> tuple | None:
    labels = (re.sub(r"^Show items for\s+", "", n.attrs["aria-label"]).strip() for n in card.every("button") if n.attrs.get("aria-label", "").startswith("Show items for "))
    title = next((n for n in card.walk() if n.attrs.get("data-test") == "offer-title"), None)
    name = next(labels, None) or _said(title)
    value = next((_said(n) for n in card.every("div", "OfferCardValue")), None)
    price, discount = offer_value(value)
    if not name or not (price or discount):
        return None
    expires, image = _said(card.first("p")), card.first("img")
    href = next((n.attrs["href"] for n in card.every("a") if "/p/" in n.attrs.get("href", "") or "/pl/" in n.attrs.get("href", "")), None)
    return offer_id(name, value, expires), name, image.attrs.get("src") if image else None, _offer_url(href, name), price, discount, expires, value


def _story(link: Node) -> tuple | None:
    text = link.text()
    if not text:
        return None
    parts = [p.strip(" *") for p in re.split(r"\s+\|\s+", text) if p.strip(" *")] or [text]
    values = [p for p in parts if _SAYS_VALUE.search(p.lower())]
    names = [p for p in parts if not _SAYS_VALUE.search(p.lower())]
    value, name = (values[0] if values else None), (names[-1] if names else parts[-1])
    price, discount = offer_value(value or text)
    return offer_id(name, value or text, None), name, None, _offer_url(link.attrs.get("href"), name), price, discount or value or text, None, value or text


CARD = "pos int, id string, name string, image string, url string, current_price string, discount string, expires string, value_text string"


@udtf(returnType=CARD)
class OfferCards:
    """Offers of a page: cards (``data-test`` of ``offer-card``) and deal links (of ``multistory``), the first of an id, by name."""

    def eval(self, html: str):
        found: dict[str, tuple] = {}
        for node in tree(html).walk():
            kind = node.attrs.get("data-test", "")
            row = _card(node) if kind.startswith("offer-card") else _story(node) if node.tag == "a" and kind.startswith("multistory") else None
            if row:
                found.setdefault(row[0], row)
        for pos, row in enumerate(sorted(found.values(), key=lambda r: (" ".join(re.sub("[^a-z0-9]+", " ", r[1].lower()).split()), r[0]))):
            yield pos, *row


def dealt_out(pages: DataFrame, rows: int = 20_000) -> DataFrame:
    """``pages`` in parts of about ``rows``, and as many as the cluster has cores: reading a page is much work for few bytes, so the
    splits of a small file would leave most cores idle."""
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // rows))
    return pages.repartition(parts)


def register(spark: SparkSession) -> None:
    spark.udtf.register("search_tiles", SearchTiles)
    spark.udtf.register("offer_cards", OfferCards)
