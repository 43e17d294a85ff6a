"""Link and listing-field extraction from page source held in a column.

Links and single fields are built-in expressions. Listing pages are read into element trees (`elements.py`), because
their lists nest; what is read is cleaned by built-in expressions again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthlake import vocab
from hearthlake.functions.arrays import let
from hearthlake.functions.numbers import strip_space
from hearthlake.functions.text import clean_address, clean_label_value, label_key
from hearthlake.operators.filters import sitemap_shard
from hearthlake.sources.elements import Element, parse


#: Named character references as one JSON constant, which Spark folds into a literal map.
ENTITIES = json.dumps({name.removesuffix(";"): text for name, text in html5.items() if name.endswith(";")})
#: The references that nearly all pages use, looked up before the long map.
COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
#: What numbers 128 to 159 stand for in HTML.
WINDOWS = [bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)]
REPLACEMENT = "\ufffd"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unescape(text: Column) -> Column:
    """Named, decimal and hexadecimal character references to characters."""
    names = F.from_json(F.lit(ENTITIES), "map<string,string>")

    windows = F.array(*[F.lit(c) for c in WINDOWS])

    def decode(code: Column) -> Column:
        bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return (
            F.when(bad, REPLACEMENT).when(code.between(0x80, 0x9F), F.try_element_at(windows, (code - 0x7F).cast("int")))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    def number(body: Column) -> Column:
        short = F.regexp_replace(body, "^#[xX]?0*", "")  # more than seven digits are no character
        value = let(short, lambda x: F.when(F.length(x) > 7, F.lit(None).cast("bigint")).when(
            body.rlike("^#[xX]"), F.conv(x, 16, 10).try_cast("bigint")
        ).otherwise(F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))))
        return let(value, decode)

    def named(body: Column) -> Column:
        common = F.when(body == "amp", "&")
        for name, char in COMMON.items():
            common = common.when(body == name, char)
        return common.otherwise(F.try_element_at(names, body))

    def expand(piece: Column) -> Column:
        body = F.substring_index(piece, ";", 1)
        char = let(body, lambda b: F.when(b.rlike("^#([0-9]+|[xX][0-9a-fA-F]+)$"), number(b)).otherwise(named(b)))
        rest = piece.substr(F.length(body) + 2, F.length(piece))
        whole = let(char, lambda c: F.when(c.isNotNull(), F.concat(c, rest)).otherwise(F.concat(F.lit("&"), piece)))
        return F.when(F.contains(piece, F.lit(";")), whole).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    decoded = F.concat(
        pieces[0],
        F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), expand), ""),
    )
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def visible_source(html: Column | str) -> Column:
    """Source without comments, scripts and styles."""
    return F.regexp_replace(_col(html), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")


def inner_text(fragment: Column, separator: str = "") -> Column:
    """Text of a fragment. A separator goes between the trimmed, non-empty text runs."""
    if separator:
        runs = F.transform(F.split(fragment, r"<[^>]+>"), lambda t: strip_space(unescape(t)))
        return F.array_join(F.filter(runs, lambda t: t != ""), separator)
    runs = F.transform(F.split(fragment, r"<[^>]+>"), lambda t: strip_space(unescape(t)))
    return F.array_join(runs, "")


def first_element(html: Column, tag: str, attribute: str = "") -> Column:
    """Inner source of the first `tag` whose attributes match `attribute`; NULL when there is none.

    Meant for elements that do not nest in themselves; see `whole_element` for the others.
    """
    pattern = rf"(?is)<{tag}\b(?=[^>]*{attribute})[^>]*>(.*?)</{tag}\s*>" if attribute else rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def whole_element(html: Column, tag: str, attribute: str = "") -> Column:
    """Inner source up to the element's own end tag, elements of the same tag inside included.

    Start and end tags are counted from the start tag on; an element without an end reaches to the
    end of the page. NULL when there is no such element.
    """
    start = rf"(?is)<{tag}\b(?=[^>]*{attribute})[^>]*>(.*)$"
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part.rlike(rf"^(?i)</{tag}\b"), -1).when(part.rlike(rf"^(?i)<{tag}\b"), 1).otherwise(0)
        over = (acc["depth"] < 0) | (depth < 0)
        return F.struct(F.when(over, -1).otherwise(depth).alias("depth"), (acc["size"] + F.when(over, 0).otherwise(F.length(part))).alias("size"))

    def inner(rest: Column) -> Column:
        parts = F.split(rest, rf"(?i)(?=</?{tag}\b)")
        return F.substring(rest, F.lit(1), F.aggregate(parts, zero, step, lambda acc: acc["size"]))

    return F.when(html.rlike(start), let(F.regexp_extract(html, start, 1), inner))


def class_has(word: str) -> str:
    return rf"""class\s*=\s*["'][^"']*{word}"""


def label_is(word: str) -> str:
    return rf"""aria-label\s*=\s*["']{word}["']"""


# --- sitemaps and links ------------------------------------------------------------------------

def sitemap_links(df: DataFrame, text: str) -> DataFrame:
    """All <loc> entries of sitemap documents, one per row."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"<loc>(.*?)</loc>"), 1)).alias("url"))


def sitemap_shards(index: DataFrame, text: str, deals: list[str] | None = None) -> DataFrame:
    return sitemap_links(index, text).where(sitemap_shard("url", deals))


def page_links(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Distinct (key, href) of the anchors on each page."""
    hrefs = F.regexp_extract_all(visible_source(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1)
    return df.select(key, F.explode(F.array_distinct(hrefs)).alias("href"))


# --- listing pages -----------------------------------------------------------------------------

#: What a listing page holds, as it is written there; cleaning is left to column expressions.
PARTS = """title string, price string, address string, cells array<struct<label: string, value: string>>,
  sections array<struct<name: string, items: array<string>>>, description string, image string,
  pairs array<struct<label: string, value: string>>"""


def _text(element: Element | None, separator: str = "") -> str | None:
    return element.text(separator) if element else None


def _price(page: Element) -> Element | None:
    """The price's span, preferably one inside <b>."""
    spans = list(page.all("span", lambda e: e.class_has("clamp")))
    return next((e for e in spans if e.inside("b")), spans[0] if spans else None)


def _sections(page: Element) -> list[dict]:
    """Headings and items of the spans directly inside the optional-items container.

    Items are all <li> below a <ul> of the section, those of nested lists too; a section without any has no entry.
    """
    box = page.first("div", lambda e: e.class_has("optionalItemsContainer"))
    out = []
    for span in box.children if box else []:
        if not isinstance(span, Element) or span.tag != "span":
            continue
        heading = span.first("b")
        items = [li.text() for li in span.all("li", lambda e: e.inside("ul", span))]  # noqa: B023
        if heading and items:
            out.append({"name": heading.text(), "items": items})
    return out


def _image(page: Element) -> str | None:
    """Source of the marked picture's image, or else of the first picture's."""
    marked = page.first("picture", lambda e: e.attrs.get("id") == "ssrImage")
    for picture in (marked, page.first("picture")):
        found = picture.first("img") if picture else None
        if found:
            return found.attrs.get("src", "")
    return None


def parts_of(source: str | None) -> dict:
    """The PARTS of one page; a null page has none of them."""
    if source is None:
        return {}
    page = parse(source)
    main = page.first("ul", lambda e: e.class_has("listContent"))
    cells = [
        {"label": p.attrs["aria-label"], "value": p.text()}
        for li in (main.all("li", lambda e: e.attrs.get("role") == "listitem") if main else [])
        if (p := li.first("p", lambda e: "aria-label" in e.attrs))
    ]
    pairs = [
        {"label": label.text(), "value": value.text()}
        for li in (main.children if main else []) if isinstance(li, Element) and li.tag == "li"
        if (label := li.first("small")) and (value := li.first("b"))
    ]
    described = page.first("p", lambda e: e.attrs.get("aria-label") == "descrição") or page.first(
        "div", lambda e: "description" in e.attrs.get("class", "").lower()
    )
    return {
        "title": _text(page.first("h1")), "price": _text(_price(page)), "address": _text(page.first("address")), "cells": cells,
        "sections": _sections(page), "description": _text(described, "\n"), "image": _image(page), "pairs": pairs,
    }


def page_parts(df: DataFrame, html: str = "html", out: str = "parts") -> DataFrame:
    """`df` with the struct `out` of the PARTS of each whole page in place of its source.

    Pages are read into element trees, one at a time, in an Arrow stage; a page depends on itself alone.
    """
    added = T.StructType([T.StructField(out, T.StructType.fromDDL(PARTS))])
    kept = [f for f in df.schema.fields if f.name not in (html, out)]
    schema = T.StructType([*kept, *added.fields])
    kind = to_arrow_schema(added).field(0).type
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([parts_of(s) for s in batch.column(len(kept)).to_pylist()], kind)
            passed = [c.cast(f.type) for c, f in zip(batch.columns[: len(kept)], arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*passed, found], schema=arrow)

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(html)).mapInArrow(run, schema)


def listing_title(source: Column) -> Column:
    return inner_text(first_element(source, "h1"))


def _last_wins(entries: Column) -> Column:
    """Map from entries; a later entry of the same key replaces an earlier one."""
    empty = F.create_map().cast("map<string,string>")

    def mapped(x: Column) -> Column:
        keys = F.reverse(F.array_distinct(F.reverse(F.transform(x, lambda e: e["key"]))))
        return let(keys, lambda names: F.map_from_arrays(
            names, F.transform(names, lambda k: F.element_at(F.filter(x, lambda e: e["key"] == k), -1)["value"])
        ))

    return F.coalesce(let(entries, lambda x: F.when(x.isNotNull(), mapped(x))), empty)


def listing_attributes(cells: Column) -> Column:
    """MAP of the labelled cells of the main list; a repeated label keeps its last value."""
    labelled = F.filter(cells, lambda c: c["label"] != "")
    return _last_wins(F.transform(labelled, lambda c: F.named_struct(
        F.lit("key"), label_key(c["label"]), F.lit("value"), clean_label_value(c["value"], F.lower(c["label"])),
    )))


def listing_sections(sections: Column, key_prefix: str = "comodidades_") -> Column:
    """MAP section -> comma list of its items."""
    return _last_wins(F.transform(sections, lambda s: F.named_struct(
        F.lit("key"), F.concat(F.lit(key_prefix), F.translate(F.lower(s["name"]), " á", "_a")),
        F.lit("value"), F.array_join(s["items"], ", "),
    )))


def description(source: Column) -> Column:
    """Description block of a page without comments and scripts as lines, or the not-found sentinel."""
    block = F.coalesce(
        first_element(source, "p", label_is("descrição")),
        whole_element(source, "div", class_has("description")),
    )
    return F.coalesce(inner_text(block, "\n"), F.lit(vocab.NO_DESCRIPTION))


def listing_fields(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One raw listing per page: fixed fields plus a MAP of everything the page labels."""
    parts = page_parts(df.select(F.col(url).alias(vocab.URL), F.col(html).alias("html"))).select(vocab.URL, "parts.*")
    read = parts.select(
        "*", listing_attributes(F.col("cells")).alias("_cells"), listing_sections(F.col("sections")).alias("_sections")
    )
    only_sections = F.map_filter("_sections", lambda k, _: ~F.map_contains_key("_cells", k))
    return read.select(
        vocab.URL,
        F.col("title").alias(vocab.TITLE),
        strip_space(F.replace("price", F.lit("R$"), F.lit(""))).alias(vocab.PRICE),
        clean_address(F.coalesce("address", F.lit(""))).alias(vocab.ADDRESS),
        F.map_concat("_cells", only_sections).alias("attrs"),
        F.coalesce("description", F.lit(vocab.NO_DESCRIPTION)).alias(vocab.DESCRIPTION),
    )


def legacy_fields(df: DataFrame, html: str = "html") -> DataFrame:
    """Older page layout: image, label/value pairs of the main list's own items, and section lists."""
    kept = [c for c in df.columns if c != html]
    pairs = F.transform("parts.pairs", lambda p: F.named_struct(F.lit("key"), p["label"], F.lit("value"), p["value"]))
    return page_parts(df, html).select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce("parts.image", F.lit("Imagem não encontrada")).alias("imagem"),
        F.col("parts.title").alias("titulo"),
        _last_wins(pairs).alias("caracteristicas"),
        listing_sections(F.col("parts.sections"), "").alias("secoes"),
    )
