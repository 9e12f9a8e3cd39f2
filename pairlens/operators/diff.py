"""Value comparison rules (VM1-VM10) and the per-pair diff record (DF1, DF2).

The diff is one ``select`` over a row holding both sides' feature structs; the
only shuffle on the matching path is the join that brings the two sides together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import hamming_pct, py_float, py_strip, title_similarity, token_set_ratio
from ..functions.text import col, contains_any, let, memo_column
from .align import align_keys


def _num_close(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) <= tol


def _both_any(s1: Column, s2: Column, words: list[str]) -> Column:
    return contains_any(s1, words) & contains_any(s2, words)


def _either_contains(s1: Column, s2: Column) -> Column:
    return (F.instr(s2, s1) > 0) | (F.instr(s1, s2) > 0)


def text_match(k: Column, s1: Column, s2: Column) -> Column:
    """Domain rules for two lower-cased, stripped texts (VM3-VM10).

    Cheap equality, keyword and substring tests come first; ``OR`` and ``CASE``
    are lazy, so the token-set ratio (one occurrence, key-dependent threshold) is
    computed only when nothing cheaper decided.
    """
    sub = _either_contains(s1, s2)
    materials = F.exists(F.array(*[F.lit(w) for w in rules.MATERIAL_WORDS]),
                         lambda w: (F.instr(s1, w) > 0) & (F.instr(s2, w) > 0))
    cheap = (
        F.when(k == "brand", sub)
        .when(k == "material", materials | sub)
        .when(k == "neck_style",
              _both_any(s1, s2, ["crew", "round"]) | _both_any(s1, s2, ["v"])
              | _both_any(s1, s2, ["hood"]) | _both_any(s1, s2, ["polo", "collar"]) | sub)
        .when(k == "sleeve_length",
              _both_any(s1, s2, ["short"]) | _both_any(s1, s2, ["long"])
              | _both_any(s1, s2, ["sleeveless"]) | _both_any(s1, s2, ["basic", "short"]) | sub)
        .when(k == "care_instructions",
              _both_any(s1, s2, ["machine"]) | _both_any(s1, s2, ["hand"])
              | _both_any(s1, s2, ["dry clean"]) | sub)
        .when(k == "fit",
              _both_any(s1, s2, ["slim"]) | _both_any(s1, s2, ["relaxed", "loose"])
              | _both_any(s1, s2, ["regular", "classic", "standard"]) | sub)
        .otherwise(F.lit(False))
    )
    threshold = (F.when(k == "care_instructions", F.lit(75.0))
                 .when(k.isin("brand", "material", "neck_style", "sleeve_length", "fit"), F.lit(80.0))
                 .otherwise(F.lit(85.0)))
    return (
        F.when((s1 == "") | (s2 == ""), s1 == s2)
        .when(s1 == s2, F.lit(True))
        .when(cheap, F.lit(True))
        .otherwise(token_set_ratio(s1, s2) >= threshold)
    )


def values_match(k, v1, v2, tol: float = rules.NUMERIC_REL_TOLERANCE) -> Column:
    """Compare two tagged values under key ``k`` (VM1-VM10)."""
    k, v1, v2 = col(k), col(v1), col(v2)
    num1 = F.when(v1["kind"] != "str", v1["n"]).otherwise(py_float(v1["s"]))
    num2 = F.when(v2["kind"] != "str", v2["n"]).otherwise(py_float(v2["s"]))
    s1 = F.lower(py_strip(v1["s"]))
    s2 = F.lower(py_strip(v2["s"]))
    return (
        F.when(v1["kind"] != v2["kind"],
               F.coalesce(F.when(num1.isNotNull() & num2.isNotNull(), _num_close(num1, num2, tol)),
                          F.lit(False)))
        .when(v1["kind"] != "str", F.coalesce(_num_close(v1["n"], v2["n"], tol), F.lit(False)))
        .otherwise(let(F.struct(s1.alias("a"), s2.alias("b")), lambda s: text_match(k, s["a"], s["b"])))
    )


def _value(a: Column) -> Column:
    return F.struct(a["kind"].alias("kind"), a["s"].alias("s"), a["n"].alias("n"))


NULL_VALUE = "struct<kind:string,s:string,n:double>"


def feature_diff(attrs1, attrs2, threshold: float = rules.KEY_ALIGN_THRESHOLD) -> Column:
    """Ordered diff entries: aligned, then left-only, then right-only (DF1)."""
    attrs1, attrs2 = col(attrs1), col(attrs2)
    keys1 = F.transform(attrs1, lambda a: a["key"])
    keys2 = F.transform(attrs2, lambda a: a["key"])
    bound = F.struct(attrs1.alias("a1"), attrs2.alias("a2"), align_keys(keys1, keys2, threshold).alias("al"))

    def body(b):
        a1, a2, al = b["a1"], b["a2"], b["al"]
        null_v = F.lit(None).cast(NULL_VALUE)
        null_s = F.lit(None).cast("string")

        def entry(key, k1, k2, v1, v2, match):
            return F.struct(key.alias("key"), k1.alias("link_1_key"), k2.alias("link_2_key"),
                            v1.alias("link_1_value"), v2.alias("link_2_value"), match.alias("match"))

        aligned = F.transform(al, lambda p: entry(
            a1[p["i"]]["key"], a1[p["i"]]["key"], a2[p["j"]]["key"],
            _value(a1[p["i"]]), _value(a2[p["j"]]),
            values_match(a1[p["i"]]["key"], _value(a1[p["i"]]), _value(a2[p["j"]]))))
        left_only = F.transform(
            F.filter(a1, lambda a, i: ~F.exists(al, lambda p: p["i"] == i)),
            lambda a: entry(a["key"], a["key"], null_s, _value(a), null_v, F.lit(False)))
        right_only = F.transform(
            F.filter(a2, lambda a, j: ~F.exists(al, lambda p: p["j"] == j)),
            lambda a: entry(a["key"], null_s, a["key"], null_v, _value(a), F.lit(False)))
        return F.concat(aligned, left_only, right_only)

    return let(bound, body)


@memo_column
def _pair_diff_columns(threshold: float):
    """The diff expressions over columns ``f1``/``f2`` (built once per application)."""
    fd = feature_diff(F.col("f1.attrs"), F.col("f2.attrs"), threshold)
    title = title_similarity(F.col("f1.title"), F.col("f2.title"))
    image = hamming_pct(F.col("f1.primary_phash"), F.col("f2.primary_phash"))
    return fd, title, image


def compute_diff(pairs: DataFrame, threshold: float = rules.KEY_ALIGN_THRESHOLD) -> DataFrame:
    """Pairs with ``f1``/``f2`` feature structs -> diff records (DF1).

    Input columns: ``pair_id, f1, f2`` (features structs: url, title, brand,
    attrs, primary_phash). Output follows ``schemas.DIFFS``.
    """
    fd = F.col("feature_diff")
    aligned = F.filter(fd, lambda e: e["link_1_key"].isNotNull() & e["link_2_key"].isNotNull())
    fd_expr, title_expr, image_expr = _pair_diff_columns(threshold)
    return (pairs
            .withColumn("feature_diff", fd_expr)
            .select(
                "pair_id",
                F.coalesce(F.col("f1.url"), F.lit("")).alias("link_1_url"),
                F.coalesce(F.col("f2.url"), F.lit("")).alias("link_2_url"),
                py_strip(F.coalesce(F.col("f1.brand"), F.lit(""))).alias("brand_link_1"),
                py_strip(F.coalesce(F.col("f2.brand"), F.lit(""))).alias("brand_link_2"),
                F.coalesce(F.col("f1.title"), F.lit("")).alias("title_link_1"),
                F.coalesce(F.col("f2.title"), F.lit("")).alias("title_link_2"),
                title_expr.alias("title_similarity_pct"),
                image_expr.alias("image_similarity_pct"),
                F.size(aligned).alias("total_features_compared"),
                F.size(F.filter(fd, lambda e: e["match"])).alias("total_matched"),
                F.size(F.filter(fd, lambda e: ~e["match"])).alias("total_mismatched"),
                F.transform(F.filter(fd, lambda e: e["match"]), lambda e: e["key"]).alias("matched_keys"),
                F.transform(F.filter(fd, lambda e: ~e["match"]), lambda e: e["key"]).alias("mismatched_keys"),
                fd,
            ))
