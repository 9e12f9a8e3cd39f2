"""Golden vectors for the scalar operators (FIXTURES.md §4)."""


from conftest import rows
from pairlens import functions as PF

KEYS = [("Fit Type", "fit"), ("Color/Colour", "color"), ("Special Size", "gender"), ("Neck Type", "neck_style"),
        ("Fabric Weight", "fabric_weight"), ("Fabric Care", "care_instructions"), ("Pack", "pack_count"),
        ("Pack of", "pack_of"), ("Size", "size"), ("UPC", ""), ("XL", ""), ("Price", ""), ("Volume", ""),
        ("Estate", ""), ("2 in 1", ""), ("  Colour_Name ", "color"), ("Sleeve Type", "sleeve_length")]


def test_norm_key(spark):
    df = spark.createDataFrame(KEYS, "k string, want string")
    got = rows(df.select("want", PF.norm_key("k")))
    assert all(a == b for a, b in got), got


VALUES = [
    ("weight", "2 lbs", ("float", "907.184")), ("weight", "2 lb 3 oz", ("float", "652.0385")),
    ("weight", "lightweight", ("str", "lightweight")), ("length", "30 in", ("float", "76.2")),
    ("item_dimensions", "10 x 8 x 2 in", ("float", "2748.28")), ("capacity", "2 L", ("float", "2000.0")),
    ("capacity", "16 fl oz", ("float", "473.176")), ("capacity", "1 gallon", ("float", "3785.41")),
    ("size", "X-Large", ("int", "5")), ("size", "32W x 30L", ("str", "32w x 30l")),
    ("color", "Navy", ("str", "navy blue")), ("color", "Blue - Out of Stock", ("str", "blue")),
    ("washable", "Yes", ("bool", "true")), ("stretch", "60%", ("float", "60.0")),
    ("pack_count", "3-Pack", ("str", "3-pack")), ("material", "Cotton (3 left)", ("str", "cotton")),
    ("material", "  ", ("str", "")),
]


def test_norm_value(spark):
    df = spark.createDataFrame([(k, v) for k, v, _ in VALUES], "k string, v string")
    got = [(r.kind, r.s) for r in df.select(PF.norm_value("k", "v").alias("x")).select("x.*").collect()]
    assert got == [w for _, _, w in VALUES]


PRICES = [("", "N/A"), ("₹1,670", "$20.00"), ("$12.99$12.99", "$12.99"), ("Rs. 835", "$10.00"),
          ("$1,299.00", "$1299.00"), ("1212", "$12.00"), ("5 dollars", "$0.06"), ("Free", "Free"),
          ("INR abc", "$abc"), ("12 12", "$12.00")]


def test_clean_price(spark):
    df = spark.createDataFrame(PRICES, "p string, want string")
    got = rows(df.select("want", PF.clean_price("p")))
    assert all(a == b for a, b in got), got


def test_clean_brand_and_key_types(spark):
    df = spark.createDataFrame([("Levi's Inc.", "levis"), ("Nike Premium Co", "nike"), ("Basics", "")], "b string, want string")
    assert all(a == b for a, b in rows(df.select("want", PF.clean_brand("b"))))
    kt = spark.createDataFrame([("neck_style", "size"), ("color", "color"), ("benefits", "size"), ("material", "other")],
                               "k string, want string")
    assert all(a == b for a, b in rows(kt.select("want", PF.classify_key("k"))))


def test_image_similarity(spark):
    df = spark.createDataFrame([("0000000000000000", "0000000000000000", 100.0), ("0000000000000000", "0000000000000001", 98.44),
                                ("ffffffffffffffff", "03ffffffffffffff", 90.62), (None, "00", -1.0), ("zz", "00", -1.0)],
                               "a string, b string, want double")
    assert all(a == b for a, b in rows(df.select("want", PF.hamming_pct("a", "b"))))


def test_pack_count_parity_and_fix(spark):
    df = spark.createDataFrame([("pack_count", "3-Pack"), ("pack_count", "single")], "k string, v string")
    parity = [r.x.kind for r in df.select(PF.norm_value("k", "v").alias("x")).collect()]
    fixed = [(r.x.kind, r.x.s) for r in df.select(PF.norm_value("k", "v", fix_pack_count=True).alias("x")).collect()]
    assert parity == ["str", "str"] and fixed == [("int", "3"), ("int", "1")]


def test_parse_quality_metrics(spark):
    from pairlens.sources.pages import extract_records, parse_quality_observed
    pages = spark.createDataFrame([(1, "https://a.example/x", "<title>T</title><table><tr><td>Color</td><td>Red</td></tr></table>"),
                                   (2, "https://www.amazon.com/dp/1", "<title>Robot Check</title>")],
                                  "page_id long, url string, html string")
    out, obs = parse_quality_observed(extract_records(pages))
    out.write.format("noop").mode("overwrite").save()
    m = obs.get
    assert m["records"] == 2 and m["ok"] == 1 and m["specs"] == 1
