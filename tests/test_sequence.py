"""Skew-safe next-in-group equals the plain window, including across block
boundaries, empty blocks and a hot group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.operators.sequence import with_next_in_group


def test_next_in_group_matches_plain_lead(spark):
    rows = [("hot", k, f"v{k}") for k in range(0, 300, 3)]          # one hot group, many blocks
    rows += [("cold", k, f"c{k}") for k in (5, 6, 40, 41, 200)]      # gaps: empty blocks in between
    rows += [("single", 7, "s")]
    df = spark.createDataFrame(rows, "g string, k long, v string")
    got = with_next_in_group(df, ["g"], "k", ["k", "v"], block_size=7)
    w = Window.partitionBy("g").orderBy("k")
    want = df.select("g", "k", "v", F.lead("k").over(w).alias("next_k"), F.lead("v").over(w).alias("next_v"))
    a = sorted(tuple(r) for r in got.select("g", "k", "v", "next_k", "next_v").collect())
    b = sorted(tuple(r) for r in want.collect())
    assert a == b and len(a) == len(rows)
