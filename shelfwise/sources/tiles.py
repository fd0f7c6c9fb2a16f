"""Product tiles of landed pages: one reader for any markup, told by a specification what a tile and its fields are.

HTML has no grammar that SQL could follow, so pages go through a tolerant parser in Arrow batches; a page is a row, and
nothing is kept from one to the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PRICE = re.compile(r"\$\s?[0-9][0-9.,]*(?:/[a-z]+)?")
_PERCENT = re.compile(r"[0-9]+\s?% off", re.IGNORECASE)


@dataclass(frozen=True)
class Tiles:
    """What a tile is: a link whose target fits ``link`` (its first group is the id), with the fields that are found in it.

    ``name_attributes`` are looked at in turn, then the image's text, then the tile's own text. A brand is the first text
    in an element that has all of ``brand_classes`` and does not fit ``no_brand``.
    """

    link: str = r"(?i)/grocery/product/([A-Z0-9]{10})"
    name_attributes: tuple[str, ...] = ("data-csa-c-content-id", "aria-label")
    brand_classes: tuple[str, ...] = ("brand",)
    no_brand: str = r"(?i)^(valid|exp\.?|sale bug)$"
    base: str = "https://www.wholefoodsmarket.com"


def _tidy(text: str | None) -> str | None:
    return re.sub(r"\s+\*$", "", " ".join((text or "").split())).strip() or None


class _Reader(HTMLParser):
    def __init__(self, spec: Tiles) -> None:
        super().__init__(convert_charrefs=True)
        self.spec, self.found, self.open = spec, [], []
        self.tile: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag == "a" and (hit := re.search(self.spec.link, given.get("href") or "")):
            self.close_tile()
            named = next((n for a in self.spec.name_attributes if (n := _tidy(given.get(a)))), None)
            self.tile = {"id": hit[1].upper(), "url": urljoin(self.spec.base, given["href"] or ""), "name": named, "image": None, "alt": None, "brand": None, "texts": [], "depth": len(self.open)}
        if self.tile is not None and tag == "img" and self.tile["image"] is None:
            self.tile["image"], self.tile["alt"] = given.get("src"), _tidy(given.get("alt"))
        if tag not in _VOID:
            self.open.append((tag, frozenset((given.get("class") or "").split())))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open and self.open.pop()[0] != tag:
                pass
        if self.tile is not None and len(self.open) <= self.tile["depth"]:
            self.close_tile()

    def handle_data(self, data: str) -> None:
        text = _tidy(data)
        if self.tile is None or text is None:
            return
        self.tile["texts"].append(text)
        if self.tile["brand"] is None and self.open and set(self.spec.brand_classes) <= self.open[-1][1] and not re.search(self.spec.no_brand, text):
            self.tile["brand"] = text

    def close_tile(self) -> None:
        t, self.tile = self.tile, None
        if t is not None:
            whole = " ".join(t["texts"])
            prices = _PRICE.findall(whole)
            name = t["name"] or t["alt"] or next((x for x in t["texts"] if x != t["brand"] and not _PRICE.search(x) and not _PERCENT.search(x)), None)
            if name:
                percent = _PERCENT.search(whole)
                self.found.append((t["id"], name, t["brand"], t["image"], t["url"], prices, percent[0] if percent else None))


def read(html: str | None, spec: Tiles) -> list[tuple]:
    """Tiles of one page in order; broken markup is read as far as it goes."""
    reader = _Reader(spec)
    reader.feed(html or "")
    reader.close()
    reader.close_tile()
    return reader.found


def product_tiles(pages: DataFrame, key: str = "page_id", html: str = "html", spec: Tiles = Tiles()) -> DataFrame:  # noqa: B008
    """``key, pos, asin, name, brand, image, url, prices, discount`` of every tile that has an id and a name.

    Null and empty pages have none. Tiles of one id are all here; ``first_tiles`` keeps the first of a page.
    """
    names = ("pos", "asin", "name", "brand", "image", "url", "prices", "discount")
    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, n, *t) for i, x in enumerate(b.column(1).to_pylist()) for n, t in enumerate(read(x, spec))]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in range(9)]
            own = b.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=[key, *names])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, pos int, asin string, name string, brand string, image string, url string, prices array<string>, discount string")


def first_tiles(tiles: DataFrame, key: str = "page_id") -> DataFrame:
    """The first tile of each id of a page."""
    return tiles.withColumn("rn_", F.row_number().over(Window.partitionBy(key, "asin").orderBy("pos"))).filter("rn_ = 1").drop("rn_")
