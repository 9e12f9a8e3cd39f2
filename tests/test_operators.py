"""Operators: attribute merges, greedy alignment, diff and verdict rules."""

from pyspark.sql import functions as F

from pairlens import rules
from pairlens.operators.align import align_keys
from pairlens.operators.attributes import bullet_attributes, last_wins, merged_attributes
from pairlens.operators.diff import values_match
from pairlens.operators.verdict import verdict


def test_last_wins_keeps_first_position(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)], "e array<struct<key:string,value:string>>")
    got = df.select(last_wins("e").alias("x")).first().x
    assert [(r.key, r.value) for r in got] == [("a", "3"), ("b", "2")]


def test_bullets_and_merge(spark):
    df = spark.createDataFrame([(["Fit: Slim", "UPC: 5 - Color: red", "Material — cotton", "Fit: Loose"],
                                 [("Color", "Blue"), ("fit", "")])],
                               "b array<string>, s array<struct<key:string,value:string>>")
    bul = df.select(bullet_attributes("b").alias("x")).first().x
    assert [(r.key, r.value) for r in bul] == [("fit", "Slim"), ("material", "cotton")]
    merged = df.select(merged_attributes("s", "b").alias("x")).first().x
    assert [(r.key, r.value) for r in merged] == [("color", "Blue"), ("fit", "Slim"), ("material", "cotton")]


def test_align_greedy_one_to_one(spark):
    df = spark.createDataFrame([(["color", "colour_name", "weight", "fit"], ["color_name", "height", "colour", "fit_type"])],
                               "k1 array<string>, k2 array<string>")
    got = df.select(align_keys("k1", "k2").alias("x")).first().x
    pairs = [(r.i, r.j) for r in got]
    assert pairs == [(0, 2), (1, 0), (2, 1)]  # fit/fit_type = 54.5 stays unaligned
    assert len({j for _, j in pairs}) == len(pairs)


def _v(kind, s, n=None):
    return F.struct(F.lit(kind).alias("kind"), F.lit(s).alias("s"), F.lit(n).cast("double").alias("n"))


def test_values_match_golden(spark):
    cases = [
        ("weight", _v("float", "100.0", 100.0), _v("float", "100.9", 100.9), True),
        ("weight", _v("float", "100.0", 100.0), _v("float", "101.1", 101.1), False),
        ("other", _v("bool", "true", 1.0), _v("str", "1"), True),
        ("other", _v("str", "abc"), _v("int", "3", 3.0), False),
        ("material", _v("str", "100% cotton"), _v("str", "cotton blend"), True),
        ("neck_style", _v("str", "v-neck"), _v("str", "crew neck"), False),
        ("neck_style", _v("str", "v-neck"), _v("str", "sleeveless"), True),
        ("sleeve_length", _v("str", "short sleeve"), _v("str", "basic"), True),
        ("fit", _v("str", "classic fit"), _v("str", "regular"), True),
    ]
    df = spark.range(1)
    got = df.select(*[values_match(F.lit(k), a, b).alias(f"c{i}") for i, (k, a, b, _) in enumerate(cases)]).first()
    assert list(got) == [w for *_, w in cases]


def test_verdict_golden(spark):
    def entry(key, both, match):
        return (key, key, key if both else None, ("str", "x", None), ("str", "y", None) if both else None, match)
    v = "struct<kind:string,s:string,n:double>"
    t = f"struct<key:string,link_1_key:string,link_2_key:string,link_1_value:{v},link_2_value:{v},match:boolean>"
    rows_ = [
        ("Robot or Human?", "shirt", "a", "a", 90.0, 1, [], rules.NO_MATCH),
        ("nike shirt", "nike shirt", "nike", "nike", 50.0, 0, [], rules.NO_MATCH),
        ("nike shirt", "nike shirt", "nike", "nike", 90.0, 0, [], rules.EXACT_MATCH),
        ("nike shirt", "nike tee", "nike", "nike", 60.0, 1, [entry("size", True, False)], rules.SIZE_DIFF),
        ("nike shirt", "nike tee", "nike", "nike", 60.0, 1, [entry("color", True, False)], rules.COLOR_DIFF),
        ("nike shirt", "nike tee", "nike", "nike", 60.0, 2,
         [entry("size", True, False), entry("color", True, False)], rules.NO_MATCH),
        ("nike shirt", "nike tee", "nike", "nike", 60.0, 1,
         [entry("fit", True, True), entry("extra", False, False)], rules.EXACT_MATCH),
        ("nike shirt", "adidas tee", "nike", "adidas", 90.0, 1, [], rules.NO_MATCH),
    ]
    df = spark.createDataFrame(rows_, f"t1 string, t2 string, b1 string, b2 string, sim double, n int, fd array<{t}>, want string")
    got = df.select("want", verdict("t1", "t2", "b1", "b2", "sim", "n", "fd").alias("v")).collect()
    assert [r.v for r in got] == [r.want for r in got]


def test_attribute_merges_in_linear_time(spark):
    import random
    import time
    from pyspark.sql import functions as F
    from pairlens.operators.attributes import first_wins, last_wins
    rng = random.Random(4)
    lists = [[(rng.choice(["a", "b", "c", "", None, "é"]), rng.choice(["1", "2", None])) for _ in range(n)] for n in (0, 1, 2, 5, 30)]
    lists.append([(f"k{rng.randint(0, 7000)}", str(i)) for i in range(10000)])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, e array<struct<key:string,value:string>>")
    start = time.time()
    got = {r.i: r for r in df.select("i", last_wins("e").alias("l"), first_wins("e").alias("f"), F.size("e")).collect()}
    assert time.time() - start < 30
    for i, entries in enumerate(lists):
        last, first = {}, {}
        for k, v in entries:
            last[k] = v
            first.setdefault(k, v)
        assert [tuple(x) for x in got[i].l] == list(last.items()) and [tuple(x) for x in got[i].f] == list(first.items())
