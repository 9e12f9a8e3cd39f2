"""Property checks: similarity symmetry and bounds, one-to-one
alignment, and diff entry accounting. Each generated example is a batch of
rows checked in one Spark job."""

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens import functions as PF
from pairlens.operators.diff import feature_diff

WORDS = st.text(alphabet="abcé -_", min_size=0, max_size=24)
KEYS = st.lists(st.text(alphabet="abcdefgh_", min_size=2, max_size=12), min_size=0, max_size=6, unique=True)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(WORDS, WORDS), min_size=40, max_size=40))
def test_similarity_properties(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(
        PF.token_set_ratio("a", "b").alias("ab"), PF.token_set_ratio("b", "a").alias("ba"),
        PF.token_set_ratio("a", "a").alias("aa"), F.size(PF.py_split("a")).alias("na"),
        PF.indel_ratio("a", "b").alias("iab"), PF.indel_ratio("b", "a").alias("iba")).collect()
    for r in rows:
        assert r.ab == r.ba and 0.0 <= r.ab <= 100.0
        assert r.iab == r.iba and 0.0 <= r.iab <= 100.0
        assert r.aa == (100.0 if r.na > 0 else 0.0)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(KEYS, KEYS), min_size=20, max_size=20))
def test_diff_accounting(spark, key_lists):
    def attrs(keys):
        return [(k, "v", "str", "v", None) for k in keys]
    t = "array<struct<key:string,raw:string,kind:string,s:string,n:double>>"
    df = spark.createDataFrame([(attrs(a), attrs(b)) for a, b in key_lists], f"a1 {t}, a2 {t}")
    out = df.select(F.size("a1").alias("n1"), F.size("a2").alias("n2"),
                    feature_diff("a1", "a2").alias("fd")).collect()
    for r in out:
        aligned = [e for e in r.fd if e.link_1_key is not None and e.link_2_key is not None]
        left = [e for e in r.fd if e.link_2_key is None]
        right = [e for e in r.fd if e.link_1_key is None]
        assert len(aligned) + len(left) + len(right) == len(r.fd)
        assert len(r.fd) == r.n1 + r.n2 - len(aligned)
        assert len({e.link_2_key for e in aligned}) == len(aligned)  # one-to-one
        assert not any(e.match for e in left + right)
        assert all(e.match for e in aligned)  # equal values "v" on both sides
