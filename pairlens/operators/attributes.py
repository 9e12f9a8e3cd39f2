"""Attribute-list operators (AT1-AT5), all in-row on ordered arrays.

An attribute list is ``array<struct<key string, value string>>`` in page order.
Working in-row keeps the record whole and avoids an explode + regroup shuffle; merges
sort a record's entries by key, so long lists cost no more than their sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean_price, norm_key, norm_value, price_usd, py_strip
from ..functions.text import col, let, memo_column

KV_TYPE = T.ArrayType(T.StructType([T.StructField("key", T.StringType()),
                                    T.StructField("value", T.StringType())]))

ATTR_TYPE = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("s", T.StringType()),
    T.StructField("n", T.DoubleType()),
]))

BULLET_SEPARATORS = [":", "—", "-", "|"]


def _kv(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _first_and_last(entries) -> Column:
    """Per key, in first-seen order: its place, and its first and last value.

    Entries are sorted once by (key, place); a key's first and last entries are then those
    whose neighbour has another key. So a record costs n log n, however many attributes it has.
    """
    def ends(s):
        first = F.filter(s, lambda x, j: (j == 0) | ~F.get(s, j - 1)["key"].eqNullSafe(x["key"]))
        last = F.filter(s, lambda x, j: (j == F.size(s) - 1) | ~F.get(s, j + 1)["key"].eqNullSafe(x["key"]))
        return F.zip_with(first, last, lambda f, t: F.struct(f["i"].alias("i"), f["key"].alias("key"), f["value"].alias("first"),
                                                             t["value"].alias("last")))
    placed = F.transform(col(entries), lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))
    return F.sort_array(let(F.sort_array(placed), ends))


def last_wins(entries) -> Column:
    """Unique keys in first-seen order, each with its LAST value (AT1)."""
    return F.transform(_first_and_last(entries), lambda x: _kv(x["key"], x["last"]))


def first_wins(entries) -> Column:
    """Unique keys in first-seen order, each with its FIRST value (AT2)."""
    return F.transform(_first_and_last(entries), lambda x: _kv(x["key"], x["first"]))


def spec_attributes(spec_table) -> Column:
    """Spec table -> normalised keys, empty keys/values dropped, last value wins,
    value stripped (extraction step 1)."""
    normalized = F.transform(col(spec_table), lambda e: _kv(norm_key(e["key"]), e["value"]))
    kept = F.filter(normalized, lambda e: (e["key"] != "") & e["value"].isNotNull() & (e["value"] != ""))
    return F.transform(last_wins(kept), lambda e: _kv(e["key"], py_strip(e["value"])))


def bullet_pair(bullet: Column) -> Column:
    """First separator (``:`` ``—`` ``-`` ``|``) giving key < 60 and value < 200
    chars ends the search; the key is then normalised (AT3). NULL if none."""
    def split_at(sep):
        pos = F.instr(bullet, sep)
        k = py_strip(F.substring(bullet, 1, pos - 1))
        v = py_strip(F.substring(bullet, pos + F.length(sep), 1 << 30))
        ok = (pos > 0) & (k != "") & (v != "") & (F.length(k) < 60) & (F.length(v) < 200)
        return F.struct(k.alias("k"), v.alias("v"), ok.alias("ok"))

    cands = F.transform(F.array(*[F.lit(s) for s in BULLET_SEPARATORS]), split_at)
    return F.get(F.filter(cands, lambda c: c["ok"]), 0)


def bullet_attributes(bullets) -> Column:
    """Bullet points -> first-wins attribute list (AT3 + AT2)."""
    pairs = F.transform(col(bullets), bullet_pair)
    found = F.filter(pairs, lambda p: p.isNotNull())
    keyed = F.transform(found, lambda p: _kv(norm_key(p["k"]), p["v"]))
    return first_wins(F.filter(keyed, lambda e: e["key"] != ""))


def merged_attributes(spec_table, bullets) -> Column:
    """Spec attributes, then bullet attributes for keys not yet present (SO4)."""
    spec = spec_attributes(spec_table)
    bul = bullet_attributes(F.coalesce(col(bullets), F.array().cast("array<string>")))
    return first_wins(F.concat(spec, bul))


def normalize_attributes(attrs) -> Column:
    """Attach the normalised tagged value to each (key, raw) entry."""
    def one(e):
        return let(norm_value(e["key"], e["value"]), lambda v: F.struct(
            e["key"].alias("key"), e["value"].alias("raw"), v["kind"].alias("kind"), v["s"].alias("s"), v["n"].alias("n")))
    return F.transform(col(attrs), one)


def attr_lookup(attrs: Column, key: str) -> Column:
    return F.get(F.filter(attrs, lambda a: a["key"] == key), 0)


def _truthy_text(a: Column) -> Column:
    """Text of a normalised value when Python would treat it as truthy."""
    truthy = (F.when(a["kind"] == "str", a["s"] != "")
              .otherwise(F.coalesce(a["n"] != 0, F.lit(False))))
    return F.when(a.isNotNull() & truthy, a["s"])


@memo_column
def _record_columns():
    """Attribute list and price expressions over a ``raw`` struct column."""
    r = F.col("raw")
    attrs = normalize_attributes(merged_attributes(r["spec_table"], r["bullet_points"]))
    price = clean_price(F.coalesce(r["price_raw"], F.lit("")))
    return attrs, price


def extract_features(raw: DataFrame, with_hashes: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw records -> feature records (AT4).

    Input columns: ``pair_id, link_key, url, raw`` (struct with title, brand,
    spec_table, bullet_points, image_urls, price_raw, breadcrumb) and optionally
    ``image_hashes``. Output follows ``schemas.FEATURES``; ``keep`` columns pass through.
    """
    r = F.col("raw")
    attrs, price = _record_columns()
    # one-row generators: the optimizer would copy the record and its attributes into every use below
    out = raw.select(*[F.explode(F.array("raw")).alias("raw") if c == "raw" else F.col(c) for c in raw.columns])
    out = out.select("*", F.explode(F.array(attrs)).alias("attrs"))
    a = F.col("attrs")
    brand = F.coalesce(F.when(F.coalesce(r["brand"], F.lit("")) != "", r["brand"]),
                       _truthy_text(attr_lookup(a, "brand")),
                       _truthy_text(attr_lookup(a, "brand_name")), F.lit(""))
    hashes = (F.col("image_hashes") if with_hashes
              else F.array().cast("array<struct<url:string,phash:string,dhash:string>>"))
    return out.select(
        *keep, "pair_id", "link_key", F.coalesce(F.col("url"), F.lit("")).alias("url"),
        py_strip(F.coalesce(r["title"], F.lit(""))).alias("title"),
        py_strip(F.lower(brand)).alias("brand"),
        price.alias("price"),
        price_usd(price).alias("price_usd"),
        F.coalesce(r["breadcrumb"], F.array().cast("array<string>")).alias("breadcrumb"),
        F.coalesce(r["image_urls"], F.array().cast("array<string>")).alias("image_urls"),
        hashes.alias("image_hashes"),
        F.get(hashes, 0)["phash"].alias("primary_phash"),
        F.get(hashes, 0)["dhash"].alias("primary_dhash"),
        a.alias("attrs"),
        F.size(a).alias("feature_count"),
        F.current_timestamp().alias("extracted_at"),
    )
