"""Similarity: golden values, properties, and native LCS = plain DP (cross-form)."""

import random

from conftest import rows
from pairlens import functions as PF


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def test_indel_golden(spark):
    cases = [("color", "colour", 90.9091), ("fit", "fit_type", 54.5455), ("weight", "height", 83.3333),
             ("v-neck", "crew neck", 53.3333), ("colour_name", "color_name", 95.2381), ("sleeve_type", "sleeve_style", 86.9565)]
    df = spark.createDataFrame(cases, "a string, b string, want double")
    for want, got in rows(df.select("want", PF.indel_ratio("a", "b"))):
        assert round(got, 4) == want


def test_token_set_golden(spark):
    cases = [("red widget", "blue widget", 76.1905), ("red bolt", "blue widget", 42.1053), ("a b", "a b c", 100.0),
             ("", "x", 0.0), ("x y", "y x", 100.0)]
    df = spark.createDataFrame(cases, "a string, b string, want double")
    for want, got in rows(df.select("want", PF.token_set_ratio("a", "b"))):
        assert round(got, 4) == want


def test_lcs_cross_form_and_properties(spark):
    rnd = random.Random(7)
    data = []
    for _ in range(300):
        a = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 140)))
        b = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 140)))
        data.append((a, b, lcs_dp(a, b)))
    df = spark.createDataFrame(data, "a string, b string, want int")
    out = df.select("want", PF.lcs_len("a", "b").alias("ab"), PF.lcs_len("b", "a").alias("ba"),
                    PF.indel_ratio("a", "b").alias("r"), PF.indel_ratio("a", "a").alias("self")).collect()
    for r in out:
        assert r.ab == r.want and r.ba == r.want
        assert 0.0 <= r.r <= 100.0 and r.self == 100.0


def test_lcs_at_the_word_limit_and_beyond_the_basic_plane(spark):
    rnd = random.Random(11)
    data = [("😀a\U0001d54fb", "a😀b\U0001d54f", 2), ("01\x0010", "1\x0001", 3), ("a", "b", 0), ("aaaa", "aa", 2)]
    for m in (1, 2, 61, 62, 63, 64):
        for n in (m, m + 1, 130):
            a, b = ("".join(rnd.choice("01a😀\\") for _ in range(k)) for k in (m, n))
            data.append((a, b, lcs_dp(a, b)))
    df = spark.createDataFrame(data, "a string, b string, want int")
    for r in df.select("a", "b", "want", PF.lcs_len("a", "b").alias("ab"), PF.lcs_len("b", "a").alias("ba")).collect():
        assert (r.ab, r.ba) == (r.want, r.want), (r.a, r.b)
