"""Verdict rules (CL1-CL9): one nested CASE over the diff row.

``CASE`` evaluates lazily, so the cheap title checks decide most pairs before
the brand and key-type tests run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import classify_key, clean_brand, py_split
from ..functions.text import col, contains_any, let, memo_column
from .attributes import _truthy_text


def _first_word(t: Column) -> Column:
    return F.coalesce(F.get(py_split(t), 0), F.lit(""))


def _brand_from_diff(fd: Column) -> Column:
    """First diff entry whose key is brand / brand_name (CL2)."""
    return F.get(F.filter(fd, lambda e: e["key"].isin("brand", "brand_name")), 0)


def _one_brand_rule(known: Column, t_other: Column, w_known: Column, w_other: Column) -> Column:
    """One side's brand known: NO_MATCH unless it occurs in the other title or
    the first title words agree (or the known side starts with an audience word)."""
    cb = clean_brand(known)
    return ((cb != "") & (F.instr(t_other, cb) == 0) & (w_known != "") & (w_other != "")
            & (w_known != w_other) & ~w_known.isin(rules.AUDIENCE_WORDS))


def verdict(title1, title2, brand1, brand2, title_sim, compared, feature_diff) -> Column:
    """Classify one diff row (CL8)."""
    t1 = F.lower(F.coalesce(col(title1), F.lit("")))
    t2 = F.lower(F.coalesce(col(title2), F.lit("")))
    fd = col(feature_diff)
    sim = col(title_sim)
    entry = _brand_from_diff(fd)
    b1_raw = F.coalesce(col(brand1), F.lit(""))
    b2_raw = F.coalesce(col(brand2), F.lit(""))
    need_fill = (b1_raw == "") | (b2_raw == "")
    b1 = F.when(b1_raw != "", b1_raw).when(need_fill, _truthy_text(entry["link_1_value"]))
    b2 = F.when(b2_raw != "", b2_raw).when(need_fill, _truthy_text(entry["link_2_value"]))

    bound = F.struct(b1.alias("b1"), b2.alias("b2"), _first_word(t1).alias("w1"), _first_word(t2).alias("w2"))

    def rules_body(b):
        has1 = b["b1"].isNotNull() & (b["b1"] != "")
        has2 = b["b2"].isNotNull() & (b["b2"] != "")
        both_conflict = let(
            F.struct(clean_brand(b["b1"]).alias("c1"), clean_brand(b["b2"]).alias("c2")),
            lambda c: ((c["c1"] != "") & (c["c2"] != "") & (c["c1"] != c["c2"])
                       & (F.instr(c["c2"], c["c1"]) == 0) & (F.instr(c["c1"], c["c2"]) == 0)))
        brand_conflict = (F.when(has1 & has2, both_conflict)
                          .when(has1, _one_brand_rule(b["b1"], t2, b["w1"], b["w2"]))
                          .when(has2, _one_brand_rule(b["b2"], t1, b["w2"], b["w1"]))
                          .otherwise(F.lit(False)))
        mism = F.transform(
            F.filter(fd, lambda e: e["link_1_key"].isNotNull() & e["link_2_key"].isNotNull() & ~e["match"]),
            lambda e: classify_key(e["key"]))

        def by_types(types):
            return (
                F.when((F.size(types) == 0) & (col(compared) == 0) & (sim < rules.TITLE_EXACT_WITHOUT_ATTRS),
                       F.lit(rules.NO_MATCH))
                .when(F.size(types) == 0, F.lit(rules.EXACT_MATCH))
                .when((F.size(types) == 1) & (types[0] == "size"), F.lit(rules.SIZE_DIFF))
                .when((F.size(types) == 1) & (types[0] == "color"), F.lit(rules.COLOR_DIFF))
                .otherwise(F.lit(rules.NO_MATCH)))

        return (
            F.when(brand_conflict, F.lit(rules.NO_MATCH))
            .when(sim < rules.TITLE_MIN_SIMILARITY, F.lit(rules.NO_MATCH))
            .otherwise(let(F.array_distinct(mism), by_types))
        )

    invalid = ((t1 == "") | (t2 == "") | contains_any(t1, rules.TITLE_INVALID_TERMS)
               | contains_any(t2, rules.TITLE_INVALID_TERMS))
    return F.when(invalid, F.lit(rules.NO_MATCH)).otherwise(let(bound, rules_body))


@memo_column
def _diff_verdict():
    return verdict("title_link_1", "title_link_2", "brand_link_1", "brand_link_2",
                   "title_similarity_pct", "total_features_compared", "feature_diff")


def classify(diffs: DataFrame) -> DataFrame:
    """Diff records -> diff records plus ``our_result`` (CL8)."""
    return diffs.withColumn("our_result", _diff_verdict())


def build_results(classified: DataFrame, pairs_meta: DataFrame | None = None) -> DataFrame:
    """Result rows: diff scalars, verdict, label and meta, kept/mismatched
    feature lists (CL9). ``pairs_meta`` has ``pair_id`` and a ``meta`` struct."""
    df = classified
    if pairs_meta is not None:
        df = df.join(pairs_meta.select("pair_id", "meta"), "pair_id", "left")
        meta = F.col("meta")
        label = F.coalesce(meta["original_match_type"], F.lit(""))
        ptype = F.coalesce(meta["product_type"], F.lit(""))
        dept = F.coalesce(meta["department"], F.lit(""))
    else:
        label = ptype = dept = F.lit("")
    fd = F.col("feature_diff")
    return df.select(
        "pair_id", "link_1_url", "link_2_url", "brand_link_1", "brand_link_2",
        label.alias("original_csv_label"), "our_result", "title_link_1", "title_link_2",
        "title_similarity_pct", "image_similarity_pct", "total_features_compared",
        "total_matched", "total_mismatched",
        F.transform(F.filter(fd, lambda e: ~e["match"]), lambda e: F.struct(
            e["key"].alias("key"), e["link_1_value"].alias("link_1"), e["link_2_value"].alias("link_2")))
        .alias("mismatched_features"),
        F.transform(F.filter(fd, lambda e: e["match"]), lambda e: F.struct(
            e["key"].alias("key"), e["link_1_value"].alias("value"))).alias("matched_features"),
        ptype.alias("product_type"), dept.alias("department"),
        F.current_timestamp().alias("classified_at"),
    )
