"""Stored product pages -> raw product records (PX1-PX13, PF3-PF6, J6).

Routing, blocked-page predicates, field rules (``site_rules``) and reject rules are
evaluated in the tasks that scan the pages: one Arrow pass turns HTML into tokens, all
rules are native expressions over these; no shuffle, and a malformed page is a reject, never a failed job.
``parse_pages`` leaves the record open to pruning (a query of titles runs the title rules only);
``extract_records`` computes it whole, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.text import contains_any
from .site_rules import with_raw

SPEC_T = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
RAW_T = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("bullet_points", T.ArrayType(T.StringType())),
    T.StructField("spec_table", SPEC_T),
    T.StructField("image_urls", T.ArrayType(T.StringType())),
    T.StructField("price_raw", T.StringType()),
    T.StructField("breadcrumb", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
])

def route(url) -> Column:
    """Parser choice by URL (PX1)."""
    u = F.col(url) if isinstance(url, str) else url
    out = None
    for marker, name in rules.SITE_ROUTES:
        out = (F.when if out is None else out.when)(F.instr(u, marker) > 0, F.lit(name))
    return out.otherwise(F.lit("generic"))


def amazon_blocked(html) -> Column:
    """PF3: empty page or one of the robot-check phrases."""
    h = F.col(html) if isinstance(html, str) else html
    return F.coalesce(h, F.lit("")).eqNullSafe("") | contains_any(F.lower(h), rules.AMAZON_BLOCK_PHRASES)


def press_hold_blocked(html) -> Column:
    """PF4: empty page or one of the press-and-hold wall phrases."""
    h = F.col(html) if isinstance(html, str) else html
    return F.coalesce(h, F.lit("")).eqNullSafe("") | contains_any(F.lower(h), rules.PRESS_HOLD_BLOCK_PHRASES)


def reject_reason(url: Column, parser: Column, amazon_block: Column, press_hold: Column, raw: Column) -> Column:
    """PF5 (+ PF3/PF4 for stored pages): why a parsed page is not a usable record."""
    title = F.lower(F.coalesce(raw["title"], F.lit("")))
    empty = ((F.coalesce(raw["title"], F.lit("")) == "") & (F.size(raw["spec_table"]) == 0)
             & (F.size(raw["image_urls"]) == 0) & (F.coalesce(raw["price_raw"], F.lit("")) == ""))
    is_amazon = F.instr(url, "amazon.") > 0
    return (F.when(parser.isin("walmart", "target") & press_hold, F.lit("blocked_press_hold"))
            .when(is_amazon & amazon_block, F.lit("blocked_robot_check"))
            .when((parser == "walmart") & ((title == "") | contains_any(title, rules.WALMART_TITLE_INVALID)),
                  F.lit("title_invalid"))
            .when((parser == "target") & (F.size(raw["spec_table"]) == 0), F.lit("missing_specs"))
            .when(is_amazon & ((title == "") | contains_any(title, rules.AMAZON_TITLE_INVALID)), F.lit("title_invalid"))
            .when(empty, F.lit("empty_record")))


def parse_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, parser, raw)`` (PX2-PX11), all in the
    scan's own tasks; ``keep`` columns pass through unchanged."""
    routed = pages.select("page_id", "url", route("url").alias("parser"),
                          amazon_blocked("html").alias("amazon_blocked"),
                          press_hold_blocked("html").alias("press_hold_blocked"), *keep, "html")
    return with_raw(routed).drop("html")


def extract_records(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed records with envelope: status ``ok``/``failed`` and error (PX13).

    Output: page_id, url, parser, status, error, raw, scraped_at (+ ``keep``).
    """
    # a one-row generator: without it the optimizer copies the rules of a field into every use of it below
    parsed = parse_pages(pages, keep)
    parsed = parsed.select(*[F.explode(F.array("raw")).alias("raw") if c == "raw" else F.col(c) for c in parsed.columns])
    reason = reject_reason(F.col("url"), F.col("parser"), F.col("amazon_blocked"),
                           F.col("press_hold_blocked"), F.col("raw"))
    return parsed.select(
        "page_id", "url", "parser", *keep,
        F.when(reason.isNull(), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        reason.alias("error"), "raw", F.current_timestamp().alias("scraped_at"))


def parse_quality_observed(records: DataFrame, name: str = "parse_quality"):
    """AG8 as metrics: counters collected by ``observe`` while the records are
    written, no extra pass. Returns ``(observed_df, observation)``; read
    ``observation.get`` after an action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    r = F.col("raw")
    out = records.observe(
        obs, F.count(F.lit(1)).alias("records"),
        F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("ok"),
        F.sum(F.size(r["spec_table"])).alias("specs"), F.sum(F.size(r["bullet_points"])).alias("bullets"),
        F.sum(F.size(r["image_urls"])).alias("images"))
    return out, obs


def latest_page_per_url(pages: DataFrame) -> DataFrame:
    """One stored snapshot per URL (the highest page_id): the URL cache (J6, AG6).
    The newest id is found on two columns, combined on the map side; only the chosen pages are then read on."""
    best = pages.groupBy("url").agg(F.max("page_id").alias("page_id"))
    return pages.join(best, ["url", "page_id"], "left_semi").select("page_id", "url", "html")


def host(url) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(u, "^[a-zA-Z]+://([^/?#:]+)", 1)
