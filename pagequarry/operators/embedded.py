"""Product data embedded in pages: JSON-LD, microdata, meta tags.

Each source is an expression over the html that gives an array of candidates of one type, so that a plan reads each page once
and takes all sources from it; the operators of the same names give them as rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.text import decode_entities, let

#: What a tag holds up to its end. A ``<`` counts only in a quoted value of bounded length, and nothing is tried twice, so that time
#: grows with the page whatever is left open.
TAG = r"""(?>[^<>"']++|"[^"<]*+"|'[^'<]*+'|"[^"]{0,2048}"|'[^']{0,2048}'|["'](?=[^<>"']*>)){0,100}>"""
SCRIPT_END = r"(?i)</script"
BLOCK = r"""(?is)<script\b[^<>]*?\btype\s*=\s*["']?application/ld\+json\b[^<>]*>(.*)$"""
META = rf"(?is)<meta\s{TAG}"
ITEM = rf"(?is)<[a-z][^\s<>]*+\s{TAG}[^<]*+"
OFFER = "struct<price: string, currency: string, availability: string, condition: string>"
CANDIDATE = f"struct<source: string, source_rank: int, pos: int, sku: string, gtin: string, name: string, brand: string, description: string, image_urls: array<string>, price: string, currency: string, availability: string, condition: string, offers: array<{OFFER}>>"
RANKS = {"jsonld": 1, "microdata": 2, "meta": 3, "fallback": 4}
TEXTS = ["sku", "gtin", "name", "brand", "description", "price", "currency", "availability", "condition"]


def _candidate(source: str, pos: Column, offers: Column | None = None, images: Column | None = None, **fields: Column) -> Column:
    """One candidate; without a list of offers, its price, currency, availability and condition are the one offer."""
    texts = {name: fields.get(name, F.lit(None)).cast("string") for name in TEXTS}
    one = F.struct(*[texts[n].alias(n) for n in ("price", "currency", "availability", "condition")])
    offers = F.filter(F.array(one), lambda o: F.coalesce(o["price"], o["currency"], o["availability"], o["condition"]).isNotNull()) if offers is None else offers
    images = F.array().cast("array<string>") if images is None else images
    held = {"source": F.lit(source), "source_rank": F.lit(RANKS[source]), "pos": pos, **texts, "image_urls": images, "offers": offers}
    order = [f.split(":")[0].strip() for f in ("source", "source_rank", "pos", "sku", "gtin", "name", "brand", "description", "image_urls", "price", "currency", "availability", "condition", "offers")]
    return F.struct(*[held[n].alias(n) for n in order]).cast(CANDIDATE)


def _rows(pages: DataFrame, found: Column) -> DataFrame:
    return pages.select("page_id", F.explode(found).alias("c")).select("page_id", "c.*")


def jsonld_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, pos, block``: one row per JSON-LD script, in page order."""
    return pages.select("page_id", F.posexplode(blocks_of(F.col("html"))).alias("pos", "block"))


def blocks_of(html: Column) -> Column:
    """Of each stretch up to a closed script, what follows the first opening of JSON-LD."""
    closed = let(F.split(html, SCRIPT_END), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))
    found = F.transform(F.filter(closed, lambda p: F.contains(F.lower(p), F.lit("ld+json"))), lambda p: let(F.regexp_extract(p, BLOCK, 1), lambda b: F.when((b != "") | p.rlike(BLOCK), b)))
    return F.filter(found, lambda b: b.isNotNull())


#: Under these a node holds further nodes.
INSIDE = ["@graph", "itemListElement", "item", "mainEntity", "hasVariant"]


def _listed(node: Column, path: str) -> Column:
    """What stands under a path, as an array: of one, of several, of none."""
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), F.filter(F.array(F.try_variant_get(node, path, "variant")), lambda v: v.isNotNull()))


def _nodes_of(block: Column) -> Column:
    """The nodes of a block, then those inside them, level by level; as many levels as the block may have by the keys in it."""
    levels = F.regexp_count(block, F.lit('"(?:' + "|".join(INSIDE[1:]) + r')"\s*:'))
    none = F.array().cast("array<variant>")

    def deeper(state: Column, _: Column) -> Column:
        inside = F.flatten(F.transform(state["last"], lambda v: F.concat(*[_listed(v, f'$["{k}"]') for k in INSIDE[1:]])))
        return let(inside, lambda v: F.struct(F.concat(state["all"], v).alias("all"), v.alias("last")))

    def all_of(v: Column) -> Column:
        top = F.coalesce(F.try_variant_get(v, '$["@graph"]', "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        start = let(top, lambda t: F.struct(t.alias("all"), t.alias("last")))
        return F.when(levels == 0, top).otherwise(F.aggregate(F.sequence(F.lit(1), levels), start, deeper)["all"])

    return F.coalesce(let(F.try_parse_json(block), lambda v: F.when(v.isNotNull(), all_of(v))), none)


def _is_product(node: Column) -> Column:
    """By its type or one of its types, short or as an address."""
    types = F.coalesce(F.try_variant_get(node, '$["@type"]', "array<string>"), F.array(F.try_variant_get(node, '$["@type"]', "string")))
    return F.coalesce(F.exists(types, lambda t: t.rlike(r"^(?:https?://schema\.org/|schema:)?Product$")), F.lit(False))


def jsonld_nodes(blocks: DataFrame) -> DataFrame:
    """``page_id, pos, node_pos, node``: the product nodes of each block, still as VARIANT.

    A block may hold an object, an array or a graph, and a node one type or several. What isn't JSON gives no rows."""
    return blocks.select("page_id", "pos", F.posexplode(_nodes_of(F.col("block"))).alias("node_pos", "node")).filter(_is_product(F.col("node")))


def _scalar(value: Column, otherwise: Callable[[Column], Column] | None = None) -> Column:
    """Text of a value; of an object or an array, which only a text that begins like one can be, what ``otherwise`` makes of it, or null."""
    nested = F.schema_of_variant(value).rlike("^(?:OBJECT|ARRAY)")
    other = F.lit(None).cast("string") if otherwise is None else otherwise(value)
    return let(F.try_variant_get(value, "$", "string"), lambda t: F.when((t.startswith("[") | t.startswith("{")) & nested, other).otherwise(t))


def _texts(values: list[Column], *inner: str) -> Column:
    """The text of each value; of an array that of its first, of an object that of the first of ``inner`` it has. One expression for all."""

    def inside(value: Column) -> Column:
        first = F.coalesce(F.try_variant_get(value, "$[0]", "variant"), value)
        return let(first, lambda v: F.coalesce(_scalar(v), *[_scalar(F.try_variant_get(v, f'$["{k}"]', "variant")) for k in inner]))

    return F.transform(F.array(*values), lambda v: decode_entities(_scalar(v, inside)))


def _keys(node: Column, *names: str) -> Column:
    """The values under these keys of an object, in one step."""
    return F.try_variant_get(node, "$", "struct<" + ", ".join(f"`{n}`: variant" for n in names) + ">")


def machine_price(text: Column) -> Column:
    """A price written for machines, where a point is decimal in every language: what people would read as thousands is written out."""
    return F.when(text.rlike(r"^\s*\d+(?:\.\d{3}|(?:\.\d+)?[eE][+-]?\d+)\s*$"), F.coalesce(F.trim(text).try_cast("decimal(18,2)").cast("string"), text)).otherwise(text)


def _offers_of(node: Column) -> Column:
    """Of a range of prices (AggregateOffer) the lowest counts."""

    def one(o: Column, stated: Column) -> Column:
        values = [o["price"], stated["price"], o["lowPrice"], stated["minPrice"], o["priceCurrency"], stated["priceCurrency"], o["availability"], o["itemCondition"]]
        held = lambda t: F.struct(machine_price(F.coalesce(t[0], t[1], t[2], t[3])).alias("price"), F.coalesce(t[4], t[5]).alias("currency"), t[6].alias("availability"), t[7].alias("condition"))
        return let(_texts(values, "name", "@value", "@id"), held)

    def read(o: Column) -> Column:
        spec = F.coalesce(F.try_variant_get(o["priceSpecification"], "$[0]", "variant"), o["priceSpecification"])
        return let(_keys(spec, "price", "minPrice", "priceCurrency"), lambda s: one(o, s))

    return F.transform(_listed(node, "$.offers"), lambda v: let(_keys(v, "price", "lowPrice", "priceCurrency", "availability", "itemCondition", "priceSpecification"), read))


def offers(nodes: DataFrame) -> DataFrame:
    """``page_id, pos, node_pos, offer_pos, price, currency, availability, condition``: a row per offer, object or array; one of nulls for a node without any."""
    given = let(_offers_of(F.col("node")), lambda o: F.when(F.size(o) > 0, o).otherwise(F.array(F.lit(None).cast(OFFER))))
    return nodes.select("page_id", "pos", "node_pos", F.posexplode(given).alias("offer_pos", "offer")).select("page_id", "pos", "node_pos", "offer_pos", "offer.*")


def jsonld_candidates(html: Column) -> Column:
    """Of all blocks; of several offers the first gives price, currency, availability and condition. Each block is parsed once."""
    names = ("sku", "gtin13", "gtin14", "gtin12", "gtin8", "gtin", "name", "brand", "description")

    def one(pos: Column, offers: Column, images: Column, t: Column) -> Column:
        first = F.get(offers, F.lit(0))
        return _candidate("jsonld", pos, offers, images, sku=t[0], gtin=F.coalesce(*[t[i] for i in range(1, 6)]), name=t[6], brand=t[7], description=t[8], **{n: first[n] for n in ("price", "currency", "availability", "condition")})

    def read(node: Column, pos: Column) -> Column:
        address = lambda i: F.coalesce(_scalar(i), *[_scalar(F.try_variant_get(i, k, "variant")) for k in ("$.url", "$.contentUrl")])
        images = F.filter(F.transform(_listed(node, "$.image"), address), lambda i: i.isNotNull())
        keys = lambda k: let(_texts([k[n] for n in names], "name", "@value"), lambda t: let(_offers_of(node), lambda offers: one(pos, offers, images, t)))
        return let(_keys(node, *names), keys)

    nodes = F.filter(F.flatten(F.transform(blocks_of(html), _nodes_of)), _is_product)
    return F.transform(nodes, read)


def jsonld_products(pages: DataFrame) -> DataFrame:
    """Candidates of JSON-LD."""
    return _rows(pages, jsonld_candidates(F.col("html")))


def _scopes(html: Column) -> Column:
    """Of a page without the letters none, without a search for the word at every place."""
    return F.when(F.contains(F.lower(html), F.lit("itemscope")), F.regexp_count(html, F.lit(r"(?i)\bitemscope\b"))).otherwise(F.lit(0))


def _attribute(tag: Column, *names: str) -> Column:
    """The quoted value of an attribute of a tag, of several names the first; null if it has none or an empty one. A tag without the letters of a name is not searched for it."""
    name = names[0] if len(names) == 1 else f"(?:{'|'.join(names)})"
    value = lambda quote: F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*{quote}([^{quote}]*){quote}", 1), F.lit(""))
    held = reduce(or_, [F.contains(F.lower(tag), F.lit(n)) for n in names])
    return F.when(held, F.coalesce(value('"'), value("'")))


def _properties(html: Column) -> Column:
    """``k, given, shown, address`` of each tag with an itemprop: its name, its content (of links the target), the text that follows, an
    image's place. All tags are taken once."""

    def one(tag: Column) -> Column:
        text = F.nullif(F.trim(F.regexp_extract(tag, r"(?s)>([^<>]*)$", 1)), F.lit(""))
        target = F.when(tag.rlike(r"(?i)^<link\b"), _attribute(tag, "href"))
        name = F.regexp_extract(tag, r"""(?is)\bitemprop\s*=\s*["']?([^"'>\s]+)""", 1)
        values = F.array(F.coalesce(_attribute(tag, "content"), target), text, F.coalesce(_attribute(tag, "src"), _attribute(tag, "href")))
        return let(F.transform(values, decode_entities), lambda v: F.struct(name.alias("k"), v[0].alias("given"), v[1].alias("shown"), v[2].alias("address")))

    tags = F.filter(F.regexp_extract_all(html, F.lit(ITEM), F.lit(0)), lambda t: t.rlike(r"(?i)\sitemprop\b"))
    return F.transform(tags, one)


def microdata_candidates(html: Column) -> Column:
    """Of flat microdata, pages with one ``itemscope`` that is a product."""
    fields = {"sku": "sku", "name": "name", "brand": "brand", "description": "description", "price": "price", "currency": "priceCurrency", "availability": "availability", "condition": "itemCondition"}
    flat = F.filter(F.array(html), lambda h: (_scopes(h) == 1) & h.rlike(r"(?i)schema\.org/Product\b"))

    def one(properties: Column) -> Column:
        first = lambda name, of: F.get(F.filter(F.transform(F.filter(properties, lambda p: p["k"] == name), of), lambda v: v.isNotNull()), F.lit(0))
        either = lambda p: F.coalesce(p["given"], p["shown"])
        texts = {n: first(f, either) for n, f in fields.items()} | {"price": first("price", lambda p: F.coalesce(machine_price(p["given"]), p["shown"]))}
        images = F.filter(F.transform(F.filter(properties, lambda p: p["k"] == "image"), lambda p: F.coalesce(p["given"], p["address"], p["shown"])), lambda v: v.isNotNull())
        return _candidate("microdata", F.lit(0), images=images, gtin=F.coalesce(first("gtin13", either), first("gtin", either)), **texts)

    return F.transform(F.transform(flat, _properties), one)


def microdata_products(pages: DataFrame) -> DataFrame:
    """Candidates of flat microdata."""
    return _rows(pages, microdata_candidates(F.col("html")))


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Items(HTMLParser):
    """Collects product scopes with the properties of the scopes inside them, each under its path. Every tag costs the same, however deep
    it stands."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.counts: dict[str, int] = {}
        self.scopes: list[tuple[int, str]] = []  # place of its tag, path
        self.reading: list[tuple[int, str]] = []
        self.products: list[dict[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        got = dict(attrs)
        path = self.scopes[-1][1] if self.scopes else None
        prop, scope = got.get("itemprop"), "itemscope" in got
        own = None
        if scope and path is None:
            if (got.get("itemtype") or "").rstrip("/").endswith("schema.org/Product"):
                self.products.append({})
                own = ""
        elif path is not None and prop:
            own = f"{path}.{prop}".lstrip(".")
            if not scope:
                value = got.get("content") or got.get("href") if tag in ("meta", "link", "a") or "content" in got else None
                value = got.get("src") if value is None and tag == "img" else value
                if value is not None:
                    given = re.fullmatch(r"\s*\d+\.\d{3}\s*", value) and prop in ("price", "lowPrice")
                    self.products[-1].setdefault(own, [str(Decimal(value.strip()).quantize(Decimal("0.01"), ROUND_HALF_UP)) if given else value])
                elif tag not in VOID:
                    self.reading.append((len(self.open), own))
        elif scope:
            own = "?"  # a scope of its own kind inside a product; what it holds is not the product's
        if tag not in VOID:
            if scope and own is not None:
                self.scopes.append((len(self.open), own))
            self.open.append(tag)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if not self.counts.get(tag):
            return
        while True:
            last = self.open.pop()
            self.counts[last] -= 1
            if last == tag:
                break
        for held in (self.scopes, self.reading):
            while held and held[-1][0] >= len(self.open):
                held.pop()

    def handle_data(self, data):
        if self.reading and self.products:
            self.products[-1].setdefault(self.reading[-1][1], []).append(data)


PATHS = {
    "sku": ["sku"],
    "gtin": ["gtin13", "gtin"],
    "name": ["name"],
    "brand": ["brand.name", "brand"],
    "description": ["description"],
    "price": ["offers.price", "offers.priceSpecification.price", "offers.lowPrice", "price"],
    "currency": ["offers.priceCurrency", "priceCurrency"],
    "availability": ["offers.availability", "availability"],
    "condition": ["offers.itemCondition", "itemCondition"],
    "image": ["image"],
}


def _items_of(text: str | None) -> list[dict[str, str | None]]:
    if text is None:
        return []
    parser = _Items()
    parser.feed(text)
    found = [{k: "".join(v).strip() for k, v in p.items()} for p in parser.products]
    return [{name: next((p[k] for k in keys if p.get(k)), None) for name, keys in PATHS.items()} for p in found]


_ITEM_FIELDS = [T.StructField(name, T.StringType()) for name in PATHS]


@F.pandas_udf(T.ArrayType(T.StructType(_ITEM_FIELDS)))
def _nested_items(html: pd.Series) -> pd.Series:
    return html.map(_items_of)


@F.udtf(returnType=T.StructType([T.StructField("pos", T.IntegerType()), *_ITEM_FIELDS]), useArrow=False)
class NestedProducts:
    """Table function: ``pos, sku, gtin, name, ...``, a row per product scope of an html; none for a null. In SQL, once registered with
    ``spark.udtf.register``: ``SELECT p.page_id, t.* FROM pages p, LATERAL nested_products(p.html) t``.

    Rows travel pickled, many calls at a time: with Arrow every call, so every page, would send a record batch of its own."""

    def eval(self, html: str):
        for pos, item in enumerate(_items_of(html)):
            yield (pos, *item.values())


def nested_candidates(html: Column) -> Column:
    """Of pages with two or more ``itemscope``, where nesting decides what belongs to a product. The one source in
    Python, as regular expressions can't follow nesting; other pages send it a null."""
    found = _nested_items(F.when(_scopes(html) > 1, html))
    images = lambda item: F.filter(F.array(item["image"]), lambda i: i.isNotNull())
    return F.transform(found, lambda item, pos: _candidate("microdata", pos, images=images(item), **{n: item[n] for n in TEXTS}))


def microdata_nested(pages: DataFrame) -> DataFrame:
    """Candidates of nested microdata."""
    return _rows(pages, nested_candidates(F.col("html")))


def nested_rows(pages: DataFrame) -> DataFrame:
    """``page_id, pos`` and the texts of every product in nested microdata, by a lateral join with the table function: rows leave Python one by
    one, so a page with very many products needs no array of them. Without a product a page gives no row."""
    asked = pages.select("page_id", F.when(_scopes(F.col("html")) > 1, F.col("html")).alias("_html")).filter("_html IS NOT NULL")
    return asked.lateralJoin(NestedProducts(F.col("_html").outer())).drop("_html")


def meta_candidates(html: Column) -> Column:
    """Of ``og:`` and ``product:`` meta tags; of a repeated property the first counts. A page needs a price or
    any ``product:`` property with a value; plain ``og:`` pages give none."""
    tags = F.transform(
        F.regexp_extract_all(html, F.lit(META), F.lit(0)),
        lambda t: F.struct(F.lower(F.coalesce(_attribute(t, "property", "name"), F.lit(""))).alias("k"), F.coalesce(_attribute(t, "content"), F.lit("")).alias("v")),
    )

    names = {
        "sku": ["product:retailer_item_id"], "gtin": ["product:gtin", "product:ean"], "name": ["og:title"], "brand": ["product:brand", "og:brand"], "description": ["og:description"], "price": ["product:price:amount", "og:price:amount"],
        "currency": ["product:price:currency", "og:price:currency"], "availability": ["product:availability", "og:availability"], "condition": ["product:condition"], "image": ["og:image"],
    }

    def one(tags: Column) -> Column:
        value = lambda name: F.nullif(F.get(F.filter(tags, lambda t: t["k"] == name), F.lit(0))["v"], F.lit(""))
        values = F.transform(F.array(*[F.coalesce(*map(value, keys)) for keys in names.values()]), decode_entities)

        def held(v: Column) -> Column:
            texts = {n: v[i] for i, n in enumerate(names)}
            images = F.filter(F.array(texts.pop("image")), lambda i: i.isNotNull())
            return _candidate("meta", F.lit(0), images=images, **texts | {"price": machine_price(texts["price"])})

        return let(values, held)

    stated = lambda tags: F.exists(tags, lambda t: (t["k"].startswith("product:") | (t["k"] == "og:price:amount")) & (t["v"] != ""))
    return F.transform(F.filter(F.array(tags), stated), one)


def meta_products(pages: DataFrame) -> DataFrame:
    """Candidates of meta tags."""
    return _rows(pages, meta_candidates(F.col("html")))


def fallback_candidates(title: Column, h1: Column) -> Column:
    """Of title and heading, to fill a name that no other source gives."""
    return F.array(_candidate("fallback", F.lit(0), name=F.coalesce(h1, title)))
