"""Product fields of stored pages as rule tables over page tokens and typed islands (PX2-PX11, SL3).

A page is scanned once into tokens (``tokens.page_tokens``), its JSON island is parsed
once into a typed struct; every field rule is a filter over these, so nothing here reads
HTML again. A layout is a table of fields; the first rule of a field with a non-empty
result wins. Lists of attributes are concatenated in the order of their stages and merged
by the attribute operators (last value wins, then first value wins). A page can lack fields,
hold nulls, numbers for text or broken JSON without failing: what a rule doesn't find is
empty, and a site layout without its island falls back to its page rules or the generic ones.
Nothing is cut off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import memo_column
from ..operators.attributes import first_wins, last_wins
from .tokens import island_product, page_tokens

_KV = "array<struct<key:string,value:string>>"
_ENTRY = "struct<name:string,value:string>"

# What is read of each island; brands are variants, as only a text counts as one.
WALMART_T = f"""struct<props:struct<pageProps:struct<initialData:struct<data:struct<
  product:struct<name:string,brand:variant,brandName:variant,shortDescription:string,longDescription:string,
    specifications:array<struct<specifications:array<{_ENTRY}>>>,
    specificationSection:struct<specifications:array<struct<specifications:array<{_ENTRY}>>>>,
    imageInfo:struct<allImages:array<struct<url:string>>>,priceInfo:struct<currentPrice:struct<priceString:string>>>,
  idml:struct<specifications:array<{_ENTRY}>,shortDescription:string,longDescription:string>>>>>>"""
TARGET_T = """struct<item:struct<product_description:struct<title:string,downspout_description:string,
  bullet_descriptions:array<string>,soft_bullets:struct<bullets:array<string>>>,primary_brand:struct<name:string>,
  enrichment:struct<images:struct<primary_image_url:string,alternate_image_urls:array<string>>>>>"""
MYNTRA_T = """struct<pdpData:struct<name:string,brand:struct<name:string>,mrp:string,price:struct<discounted:string>,
  articleAttributes:map<string,string>,sizes:array<struct<label:string,available:boolean>>,
  productDetails:array<struct<title:string,description:string>>,colours:array<struct<image:string>>,
  media:struct<images:array<struct<imageURL:string>>,albums:array<struct<images:array<struct<imageURL:string>>>>>>>"""


# ---------------------------------------------------------------------------
# text helpers
# ---------------------------------------------------------------------------

def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, group), F.lit(""))


def all_found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def untagged(c: Column, sep: str = "") -> Column:
    """The text of an HTML fragment inside a JSON value."""
    return trimmed(F.regexp_replace(c, "<[^<>]*+>", sep))


def first_text(*options: Column) -> Column:
    """The first non-empty option, else the empty text."""
    return F.coalesce(*[F.when(o != "", o) for o in options], F.lit(""))


def no_pairs() -> Column:
    return F.array().cast(_KV)


def no_texts() -> Column:
    return F.array().cast("array<string>")


def pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def colon_pair(text: Column) -> Column:
    """``key: value``, null without a colon."""
    at = F.instr(text, ":")
    return F.when(at > 0, pair(trimmed(F.substring(text, F.lit(1), at - 1)), trimmed(F.substring(text, at + 1, F.length(text)))))


def whole_pairs(entries: Column, longest_key: int | None = None) -> Column:
    """Entries with a key and a value."""
    def ok(e):
        both = (F.coalesce(e["key"], F.lit("")) != "") & (F.coalesce(e["value"], F.lit("")) != "")
        return both & (F.length(e["key"]) < longest_key) if longest_key else both
    return F.filter(F.coalesce(entries, no_pairs()), ok)


def texts_of(array: Column) -> Column:
    return F.filter(F.coalesce(array, no_texts()), lambda x: F.coalesce(x, F.lit("")) != "")


def any_in(text: Column, parts: list[str]) -> Column:
    return text.rlike("|".join(f"\\Q{p}\\E" for p in parts))


# ---------------------------------------------------------------------------
# rules over the tokens of a page
# ---------------------------------------------------------------------------

def tags() -> Column:
    return F.col("__page.tags")


def texts() -> Column:
    return F.col("__page.texts")


def marked(t: Column, *selectors: str) -> Column:
    return t["marks"].bitwiseAND(F.lit(sum(rules.page_mark(s) for s in selectors))) != 0


def inside(t: Column, *selectors: str) -> Column:
    return t["within"].bitwiseAND(F.lit(sum(rules.page_mark(s) for s in selectors))) != 0


def text_of(t: Column, sep: str = "") -> Column:
    """The texts of an element."""
    return F.array_join(F.slice(texts(), t["t0"] + 1, t["t1"] - t["t0"]), sep)


def fits(t: Column, selector: str) -> Column:
    kind, _, name = selector.partition(":")
    if kind == "tag":
        return t["tag"] == name
    return marked(t, selector) & (t["tag"] == "meta") if kind == "meta" else marked(t, selector)


def by_rule(selector: str, sep: str = "") -> Column:
    """The content attribute or the text of the first element of a selector."""
    t = F.get(F.filter(tags(), lambda t: fits(t, selector)), F.lit(0))
    return first_text(t["attrs"]["content"], text_of(t, sep))


def _scalar(field: str, sep: str = "", clean=lambda c: c) -> Column:
    return first_text(*[clean(by_rule(s, sep)) for s in rules.GENERIC_FIELDS[field]])


def neighbours(cells: Column, first, second) -> Column:
    """Pairs of cells in a row that ``first`` accepts and ``second`` continues: the texts of both."""
    following = F.zip_with(cells, F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    before = F.concat(F.array(F.lit(None)), cells)
    rows = F.zip_with(before, following, lambda p, x: F.struct(p.alias("p"), x["a"].alias("a"), x["b"].alias("b")))
    hit = F.filter(rows, lambda x: x["b"].isNotNull() & first(x["p"], x["a"]) & second(x["a"], x["b"]))
    return F.transform(hit, lambda x: F.struct(x["a"].alias("a"), text_of(x["a"]).alias("key"), text_of(x["b"]).alias("value")))


def table_rows() -> Column:
    """First two cells of every table row (PX8): the first cell, its text, the text of the next."""
    cells = F.filter(tags(), lambda t: t["tag"].isin("td", "th") & (t["up"] >= 0))
    return neighbours(cells, lambda p, a: p.isNull() | (p["up"] != a["up"]), lambda a, b: a["up"] == b["up"])


def table_pairs() -> Column:
    return whole_pairs(F.transform(table_rows(), lambda r: pair(r["key"], r["value"])), rules.SPEC_KEY_CHARS)


def detail_pairs() -> Column:
    """Rows of the product detail tables, without colons around the key (PX8)."""
    rows = F.filter(table_rows(), lambda r: inside(r["a"], *rules.DETAIL_TABLES))
    return whole_pairs(F.transform(rows, lambda r: pair(F.btrim(r["key"], F.lit(":")), r["value"])))


def definition_pairs() -> Column:
    """Term and definition neighbours (PX8)."""
    terms = F.filter(tags(), lambda t: t["tag"].isin("dt", "dd"))
    found_ = neighbours(terms, lambda p, a: a["tag"] == "dt", lambda a, b: b["tag"] == "dd")
    return whole_pairs(F.transform(found_, lambda r: pair(r["key"], r["value"])))


def hinted_pairs() -> Column:
    """Blocks whose class hints at an attribute and that hold two texts (PX8)."""
    blocks = F.filter(tags(), lambda t: marked(t, "~hint") & (t["t1"] - t["t0"]).between(1, 2))
    parts = F.filter(F.transform(blocks, lambda t: F.split(text_of(t, "|"), r"\|")), lambda p: F.size(p) == 2)
    return whole_pairs(F.transform(parts, lambda p: pair(trimmed(p[0]), trimmed(p[1]))), rules.SPEC_KEY_CHARS)


def colon_pairs() -> Column:
    """List items, rows and blocks without a table or list in them, of the form ``key: value`` (PX8).

    Lengths are known before any text is joined, so an outer block costs nothing.
    """
    longest = rules.COLON_KEY_CHARS[1] + rules.COLON_VALUE_CHARS + 64
    blocks = F.filter(tags(), lambda t: t["tag"].isin("li", "tr", "div") & (t["lists"] == 0) & t["chars"].between(3, longest))
    entries = F.filter(F.transform(blocks, lambda t: colon_pair(text_of(t, " "))), lambda e: e.isNotNull())

    def ok(e):
        k = F.lower(e["key"])
        junk = reduce(Column.__or__, [k.startswith(x) for x in rules.SPEC_JUNK_PREFIXES])
        return F.length(e["key"]).between(*rules.COLON_KEY_CHARS) & F.length(e["value"]).between(1, rules.COLON_VALUE_CHARS) & ~junk
    return whole_pairs(F.transform(F.filter(entries, ok), lambda e: pair(trimmed(F.replace(e["key"], F.lit("\u200e"), F.lit(""))), e["value"])))


def images() -> Column:
    return F.filter(tags(), lambda t: t["tag"] == "img")


def source_of(t: Column) -> Column:
    return first_text(t["attrs"]["src"], t["attrs"]["data-src"])


def sources_with(part: str) -> Column:
    """Sources of the images whose address holds ``part``."""
    return F.filter(F.transform(images(), source_of), lambda u: F.contains(u, F.lit(part)))


def largest_of(listed: Column) -> Column:
    """SL3: the address of the greatest area in a JSON object of address -> [width, height], the first among equals."""
    sizes = F.map_entries(F.from_json(listed, "map<string,array<double>>"))
    areas = F.transform(sizes, lambda e: F.get(e["value"], F.lit(0)) * F.get(e["value"], F.lit(1)))
    return F.get(sizes, (F.array_position(areas, F.array_max(areas)) - 1).cast("int"))["key"]


def _is_address(u: Column) -> Column:
    return F.startswith(u, F.lit("http"))


def main_images() -> Column:
    """Images of the main image rules by rank: the largest listed one, then the first usable source attribute (PX10, SL3)."""
    def sources(t):
        usable = [F.when(_is_address(u) & ~any_in(F.lower(u), rules.IMAGE_JUNK), u) for u in [t["attrs"][a] for a in rules.IMAGE_SOURCES]]
        listed = largest_of(t["attrs"]["data-a-dynamic-image"])
        return F.array(F.when(_is_address(listed), listed), F.coalesce(*usable))

    def of(selector):
        if selector.endswith(" img"):
            return F.filter(tags(), lambda t: (t["tag"] == "img") & inside(t, selector))
        return F.filter(tags(), lambda t: marked(t, selector) & (t["tag"] == "img") if selector.startswith("img") else marked(t, selector))
    return F.flatten(F.concat(*[F.transform(of(s), sources) for s in rules.MAIN_IMAGES]))


def generic_images() -> Column:
    """Main images, the og:image, product images at full size; any other large image only if there are none (PX10)."""
    og = F.transform(F.filter(tags(), lambda t: fits(t, "meta:og:image")), lambda t: t["attrs"]["content"])
    og = F.filter(og, lambda u: _is_address(u) & ~any_in(F.lower(u), rules.IMAGE_JUNK))
    addresses = F.filter(F.transform(images(), source_of), _is_address)
    product = F.filter(addresses, lambda u: any_in(u, rules.PRODUCT_IMAGE_PARTS) & ~any_in(F.lower(u), rules.PRODUCT_IMAGE_JUNK))
    full = F.transform(product, lambda u: F.regexp_replace(u, r"\._[A-Za-z0-9_,-]+\.(jpg|jpeg|png|gif)$", ".$1"))
    named = F.array_distinct(texts_of(F.concat(main_images(), og, full)))

    def wide(t):
        return F.coalesce(t["attrs"]["width"].try_cast("int") > rules.LEAST_IMAGE_WIDTH, F.lit(True))
    rest = F.filter(F.transform(F.filter(images(), wide), source_of), _is_address)
    return F.when(F.size(named) > 0, named).otherwise(F.array_distinct(rest))


def bullet_texts() -> Column:
    """The texts of the first bullet list that has items, blank ones left out (PX9)."""
    def items(place, item):
        return F.filter(tags(), lambda t: inside(t, place) & ((t["tag"] == item) if item == "li" else marked(t, item)))
    lists = [items(place, item) for place, item in rules.GENERIC_BULLETS]
    first = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    return texts_of(F.transform(first, lambda t: text_of(t)))


# ---------------------------------------------------------------------------
# layouts
# ---------------------------------------------------------------------------

def record(source: str, title: Column, brand: Column, description: Column, bullets: Column, specs: Column, images: Column,
           price: Column, crumbs: Column | None = None) -> dict[str, Column]:
    """The fields of a raw record, nulls replaced by empty values."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return {"title": text(title), "brand": text(brand), "description": text(description), "bullet_points": texts_of(bullets),
            "spec_table": F.coalesce(specs, no_pairs()), "image_urls": texts_of(images), "price_raw": text(price),
            "breadcrumb": no_texts() if crumbs is None else crumbs, "source": F.lit(source)}


def _either(*options: Column) -> Column:
    return first_text(*[F.coalesce(trimmed(o), F.lit("")) for o in options])


def _plain_text(v: Column) -> Column:
    """A variant that is a JSON text, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def walmart_readable(data: Column) -> Column:
    """The island has a data block, and its brand is a text or missing (else the generic rules read the page, PX2)."""
    def text(v):
        return v.isNull() | F.schema_of_variant(v).isin("STRING", "VOID")
    p = data["product"]
    return data.isNotNull() & (p.isNotNull() | data["idml"].isNotNull()) & text(p["brand"]) & text(p["brandName"])


def walmart(data: Column) -> dict[str, Column]:
    """PX2: the first section's last value wins, the other two only add."""
    product, idml = data["product"], data["idml"]

    def named(entries):
        return whole_pairs(F.transform(entries, lambda s: pair(trimmed(s["name"]), trimmed(s["value"]))))

    def sections(of):
        return named(F.flatten(F.filter(F.transform(of, lambda x: x["specifications"]), lambda x: x.isNotNull())))
    specs = F.concat(last_wins(named(idml["specifications"])), sections(product["specifications"]),
                     sections(product["specificationSection"]["specifications"]))
    short = _either(idml["shortDescription"], product["shortDescription"])
    items = texts_of(F.transform(all_found(short, r"(?is)<li\b[^<>]*+>(.*?)(?=<li\b|</li\s*+>|</[uo]l\s*+>|\z)"), lambda x: untagged(x)))
    paragraphs = texts_of(F.transform(all_found(short, r"(?is)<p\b[^<>]*+>(.*?)(?=<p\b|</p\s*+>|\z)"), lambda x: untagged(x)))
    return record("next_data", product["name"], _either(_plain_text(product["brand"]), _plain_text(product["brandName"])),
                  _either(idml["longDescription"], product["longDescription"]), F.when(F.size(items) > 0, items).otherwise(paragraphs),
                  first_wins(specs), F.transform(product["imageInfo"]["allImages"], lambda x: x["url"]),
                  product["priceInfo"]["currentPrice"]["priceString"])


def target(item: Column) -> dict[str, Column]:
    """PX3."""
    about, shown = item["product_description"], item["enrichment"]["images"]
    specs = F.transform(about["bullet_descriptions"], lambda s: colon_pair(trimmed(F.regexp_replace(s, "<[^<>]++>", ""))))
    named = texts_of(F.concat(F.array(shown["primary_image_url"]), F.coalesce(shown["alternate_image_urls"], no_texts())))
    pictures = F.array_distinct(F.when(F.size(named) > 0, named).otherwise(sources_with("target")))
    return record("target_next_data", about["title"], item["primary_brand"]["name"], about["downspout_description"],
                  about["soft_bullets"]["bullets"], last_wins(F.filter(F.coalesce(specs, no_pairs()), lambda e: e.isNotNull())), pictures, F.lit(""))


def blob_pairs(text: Column) -> Column:
    """PX4: ``KeyValueKeyValue`` text cut before every known key, the first listed one at a place."""
    keys = "|".join(rules.BLOB_SPEC_KEYS)
    cut = F.split(F.regexp_replace(text, f"({keys})", "\x01$1\x02"), "\x01")

    def one(part):
        at = F.instr(part, "\x02")
        return pair(F.when(at > 0, F.substring(part, F.lit(1), at - 1)), trimmed(F.substring(part, at + 1, F.length(part))))
    return first_wins(F.filter(whole_pairs(F.transform(cut, one)),
                               lambda e: (F.lower(e["key"]) != "general") & (F.length(e["value"]) < rules.BLOB_VALUE_CHARS)))


def rupees(parts: Column) -> Column:
    """The first rupee amount in some texts, without its commas."""
    amounts = F.filter(F.transform(parts, lambda x: F.regexp_extract(x, r"₹\s*+([\d,]+)", 1)), lambda x: x != "")
    return F.concat(F.lit("₹"), F.replace(F.get(amounts, F.lit(0)), F.lit(","), F.lit("")))


def grid_pairs() -> Column:
    """PX4: the pairs of the first long grid that has any; else of every grid of two cells."""
    grids = F.filter(tags(), lambda t: marked(t, rules.GRID))
    long_ones = F.transform(F.filter(grids, lambda t: t["chars"] > rules.BLOB_CHARS), lambda t: blob_pairs(text_of(t)))
    blob = F.get(F.filter(long_ones, lambda p: F.size(p) > 0), F.lit(0))
    cell = F.filter(F.transform(tags(), lambda t, i: t.withField("at", i)), lambda t: (t["tag"] == "div") & (t["chars"] > 0) &
                    (t["up_marks"].bitwiseAND(F.lit(rules.page_mark(rules.GRID))) != 0))
    cells = F.array_sort(F.transform(cell, lambda t: F.struct(t["up"].alias("up"), t["at"].alias("at"), t["t0"].alias("t0"), t["t1"].alias("t1"))))
    third = F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0)))
    after = F.concat(F.transform(third, lambda t: t["up"]), F.array(F.lit(-1), F.lit(-1)))  # the grid of the cell after the next
    two = neighbours(F.zip_with(cells, after, lambda t, u: t.withField("then", u)), lambda p, a: p.isNull() | (p["up"] != a["up"]),
                     lambda a, b: (a["up"] == b["up"]) & (a["then"] != a["up"]))
    return F.coalesce(blob, first_wins(whole_pairs(F.transform(two, lambda r: pair(r["key"], r["value"])), rules.GRID_KEY_CHARS + 1)))


def flipkart() -> dict[str, Column]:
    title = first_text(by_rule("tag:h1"), F.regexp_extract("__named", r'"name"\s*+:\s*+"([^"]++)"', 1))
    brand = first_text(by_rule("meta:og:brand"), by_rule("itemprop=brand"), found(title, r"^\s*(\S+)"))
    pictures = F.transform(sources_with("rukminim"), lambda u: F.substring_index(
        F.regexp_replace(u, r"/(?:image|fk-p-thumbnail)/\d+/\d+/", "/image/832/832/"), "?", 1))
    return record("flipkart_parser", title, brand, F.lit(""), no_texts(), grid_pairs(), F.array_distinct(pictures), rupees(texts()))


def _high_res(u: Column) -> Column:
    return F.regexp_replace(u, r"h_\d+,w_\d+,c_fill,g_auto/", "")


def care_lines(text: Column, breaks: str = r"<br\s*+/?>") -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), breaks), lambda x: untagged(x))


def myntra(page: Column) -> dict[str, Column]:
    """PX5: the page object."""
    brand = F.coalesce(page["brand"]["name"], F.lit(""))
    own = F.filter(whole_pairs(F.transform(F.map_entries(page["articleAttributes"]), lambda e: pair(e["key"], e["value"]))), lambda e: e["value"] != "NA")
    sizes = F.filter(page["sizes"], lambda s: F.coalesce(s["available"], F.lit(False)) & (F.coalesce(s["label"], F.lit("")) != ""))
    details = F.filter(page["productDetails"], lambda d: F.upper(d["title"]).rlike("MATERIAL|CARE"))
    lines = F.flatten(F.transform(details, lambda d: care_lines(d["description"])))
    care = F.filter(F.transform(lines, colon_pair), lambda e: e.isNotNull() & F.length(e["key"]).between(*rules.CARE_KEY_CHARS))
    price = _either(F.nullif(page["price"]["discounted"], F.lit("0")), page["mrp"])
    albums = F.flatten(F.filter(F.transform(page["media"]["albums"], lambda x: x["images"]), lambda x: x.isNotNull()))
    named = F.concat(texts_of(F.transform(page["colours"], lambda x: x["image"])), texts_of(F.transform(albums, lambda x: x["imageURL"])))
    loose = texts_of(F.transform(page["media"]["images"], lambda x: x["imageURL"]))
    pictures = F.array_distinct(F.transform(F.when(F.size(named) > 0, named).otherwise(loose), _high_res))
    about = F.element_at(F.filter(details, lambda d: d["description"].isNotNull()), -1)["description"]
    return record("myntra_json_parser", trimmed(F.concat_ws(" ", brand, page["name"])), brand,
                  F.when(F.size(details) > 0, untagged(about, " ")),
                  F.transform(sizes, lambda s: F.concat(F.lit("Available Size: "), s["label"])),
                  first_wins(F.concat(own, F.coalesce(care, no_pairs()))), pictures,
                  F.when(price != "", F.concat(F.lit("₹"), price)))


def myntra_dom() -> dict[str, Column]:
    """PX6: a Myntra page without its page object: marked elements, and the detail sections inside its scripts."""
    rule = rules.MYNTRA_DOM
    brand, name = by_rule(rule["brand"]), by_rule(rule["name"])
    price = F.get(F.filter(tags(), lambda t: marked(t, *rule["price"])), F.lit(0))
    section = (r'"title"\s*+:\s*+"([^"]++)"(?:[^"{}]++|"(?!title"\s*+:|description"\s*+:)[^"]*+")*+"description"\s*+:\s*+"((?:[^"\\]++|\\.)*+)"')

    def sections(script):
        t = script
        for code, char in (("003C", "<"), ("003E", ">"), ("002F", "/")):
            t = F.replace(t, F.lit(f"\\u{code}"), F.lit(char))
        both = F.zip_with(all_found(t, section, 1), all_found(t, section, 2), lambda a, b: F.struct(F.upper(trimmed(a)).alias("title"), b.alias("text")))
        care = F.filter(both, lambda x: x["title"].rlike("MATERIAL|CARE"))
        fit = F.filter(both, lambda x: ~x["title"].rlike("MATERIAL|CARE") & x["title"].rlike("SIZE|FIT"))
        entries = F.transform(F.flatten(F.transform(care, lambda x: care_lines(x["text"]))), colon_pair)
        return F.struct(F.element_at(F.concat(F.array(F.lit("")), F.transform(care, lambda x: F.regexp_replace(untagged(x["text"], " "), r"\s+", " "))), -1)
                        .alias("about"), whole_pairs(F.filter(entries, lambda e: e.isNotNull() & F.length(e["key"]).between(*rules.CARE_KEY_CHARS))).alias("specs"),
                        texts_of(F.flatten(F.transform(fit, lambda x: care_lines(x["text"], r"<br\s*+/?>|<li>")))).alias("bullets"))
    read = F.transform(F.filter(F.col("__page.scripts"), lambda s: F.upper(s).rlike("MATERIAL|CARE")), sections)
    specs = F.coalesce(F.get(F.filter(F.transform(read, lambda s: s["specs"]), lambda p: F.size(p) > 0), F.lit(0)), no_pairs())
    rows = F.filter(tags(), lambda t: marked(t, rule["rows"][0]) | (inside(t, rule["rows"][1]) & (t["tag"] == "li")))

    def row_pair(t):
        own = t["t1"] - t["t0"]
        return F.when(own > 1, pair(F.get(texts(), t["t0"]), F.array_join(F.slice(texts(), t["t0"] + 2, own - 1), " | "))).otherwise(colon_pair(text_of(t)))
    listed = whole_pairs(F.filter(F.transform(rows, row_pair), lambda e: e.isNotNull()), rules.ROW_KEY_CHARS + 1)
    pictures = F.concat(F.array(by_rule("meta:og:image")), sources_with(rule["images"]))
    about = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.filter(F.transform(read, lambda s: s["about"]), lambda x: x != "")), -1), F.lit(""))
    return record("myntra_dom_parser", trimmed(F.concat_ws(" ", brand, name)), brand, about, F.flatten(F.transform(read, lambda s: s["bullets"])),
                  first_wins(F.when(F.size(specs) > 0, specs).otherwise(listed)), F.array_distinct(F.transform(texts_of(pictures), _high_res)),
                  rupees(F.array(text_of(price))))


def generic() -> dict[str, Column]:
    """PX7-PX11: the page without its boilerplate."""
    noise = lambda c: trimmed(F.replace(c, F.lit(rules.TITLE_NOISE), F.lit("")))
    overwrite = last_wins(F.concat(table_pairs(), definition_pairs()))
    specs = first_wins(F.concat(overwrite, hinted_pairs(), detail_pairs(), colon_pairs()))
    crumbs = F.filter(tags(), lambda t: (t["tag"] == "a") & inside(t, *rules.GENERIC_CRUMBS))
    return record("html_rules", _scalar("title", clean=noise), _scalar("brand"), _scalar("description", " "), bullet_texts(), specs,
                  generic_images(), _scalar("price"), texts_of(F.transform(crumbs, lambda t: text_of(t))))


# ---------------------------------------------------------------------------
# html -> record
# ---------------------------------------------------------------------------

def _after(text: Column, pattern: str) -> Column:
    """What follows the first match of a pattern, null without one."""
    return F.get(F.split(text, pattern, 2), F.lit(1))


@memo_column
def _islands() -> dict[str, Column]:
    """Columns over html and parser: the island texts, and from them what is read of each, parsed once."""
    h, site = F.coalesce(F.col("html"), F.lit("")), F.col("parser")
    next_data = F.substring_index(_after(h, r"(?i)<script\b(?=[^<>]*?__NEXT_DATA__)[^<>]*+>"), "</script", 1)
    page_object = F.substring_index(_after(h, r"window\.__myx\s*+=\s*+(?=\{)"), "</script", 1)
    return {"__island": F.when(site.isin("walmart", "target"), next_data), "__myx": F.when(site == "myntra", page_object)}


@memo_column
def _parsed() -> dict[str, Column]:
    site = F.col("parser")
    ghost = F.coalesce(F.get_json_object(F.when(site == "target", F.col("__island")), "$.props.pageProps.statusCode") == "404", F.lit(False))
    data = F.from_json(F.when(site == "walmart", F.col("__island")), WALMART_T)["props"]["pageProps"]["initialData"]["data"]
    product = island_product(F.when((site == "target") & ~ghost, F.col("__island")))
    return {"__walmart": data, "__target": F.from_json(product, TARGET_T)["item"],
            "__myntra": F.from_json(F.col("__myx"), MYNTRA_T)["pdpData"]}


@memo_column
def _layout() -> Column:
    h, site = F.coalesce(F.col("html"), F.lit("")), F.col("parser")
    dom = [s[1:] for s in (rules.MYNTRA_DOM["brand"], rules.MYNTRA_DOM["name"], *rules.MYNTRA_DOM["rows"])]
    return (F.when((site == "walmart") & walmart_readable(F.col("__walmart")), "walmart")
            .when((site == "target") & F.col("__target").isNotNull(), "target").when(site == "flipkart", "flipkart")
            .when((site == "myntra") & F.col("__myntra").isNotNull(), "myntra")
            .when((site == "myntra") & any_in(h, dom), "myntra_dom").otherwise("generic"))


@memo_column
def _raw() -> Column:
    layouts = {"walmart": walmart(F.col("__walmart")), "target": target(F.col("__target")), "flipkart": flipkart(),
               "myntra": myntra(F.col("__myntra")), "myntra_dom": myntra_dom()}
    rest = generic()

    def field(name: str) -> Column:
        """One field over all layouts; a query that reads few fields evaluates only their rules."""
        out = reduce(lambda w, x: w.when(F.col("__layout") == x, layouts[x][name]), layouts, F)
        return out.otherwise(rest[name]).alias(name)
    return F.struct(*[field(n) for n in rest])


def with_raw(pages: DataFrame) -> DataFrame:
    """Add ``raw``: the record of ``html`` by the layout of ``parser``, or by the generic rules where that has nothing to read."""
    d = pages.withColumns(_islands()).withColumns(_parsed()).withColumn("__layout", _layout())
    named = F.when(F.col("__layout") == "flipkart", F.concat(F.lit('"name'), _after(F.col("html"), r'"name(?="\s*+:\s*+"[^"])')))
    d = d.withColumn("__page", page_tokens("html", F.col("__layout") == "generic", F.col("__layout") == "myntra_dom"))
    d = d.withColumn("__named", named).withColumn("raw", _raw())
    return d.drop("__island", "__myx", "__walmart", "__target", "__myntra", "__layout", "__page", "__named")
