"""Page rules on synthetic layouts (PX2-PX5, PX7-PX11): values, omitted tags, nulls, no limits."""

import json

import pytest

SITES = {"generic": "https://shop.example/x", "walmart": "https://www.walmart.com/ip/1", "target": "https://www.target.com/p/x",
         "flipkart": "https://www.flipkart.com/x", "myntra": "https://www.myntra.com/x"}


class _Recorded(Exception):
    """Ends the recording pass of a test once its pages are known."""


def _pages_of(check):
    """The pages that a test asks for."""
    found = []

    def record(*pages):
        found.extend(pages)
        raise _Recorded
    try:
        check(record)
    except _Recorded:
        pass
    return found


@pytest.fixture(scope="module")
def parse(spark):
    """Records of pages; the pages of all tests are parsed in one job."""
    from pairlens.sources.pages import extract_records
    pages = list(dict.fromkeys(x for check in PARSE_TESTS for x in _pages_of(check)))
    df = spark.createDataFrame([(i, SITES[s], h) for i, (s, h) in enumerate(pages)], "page_id long, url string, html string")
    records = {}
    for r in extract_records(df).collect():
        raw = r.raw.asDict(recursive=True)
        records[pages[r.page_id]] = raw | {"specs": [(e["key"], e["value"]) for e in raw["spec_table"]], "status": r.status,
                                           "error": r.error}

    def answer(*asked):
        out = [records[x] for x in asked]
        return out if len(out) > 1 else out[0]
    return answer


def island(data):
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'


def test_generic_page(parse):
    r = parse(("generic", "<html><head><title> Tee &amp; Co </title><meta property='og:brand' content='Acme'></head><body>"
               "<nav><li>Size: nav</li></nav><table><tr><th>Color</th><td>Blue</td></tr></table><dl><dt>Fit</dt><dd>Slim</dd></dl>"
               "<li>Care: Machine wash</li><li>Note: ignore</li>"
               "<div id='feature-bullets'><ul><li>Soft</li><li></li></ul></div>"
               "<span class='price'>$9.99</span><img src='http://x/a.jpg' width='300'></body></html>"))
    assert r["title"] == "Tee & Co" and r["brand"] == "Acme" and r["price_raw"] == "$9.99"
    assert r["specs"] == [("Color", "Blue"), ("Fit", "Slim"), ("Care", "Machine wash")]
    assert r["bullet_points"] == ["Soft"] and r["image_urls"] == ["http://x/a.jpg"]


def test_omitted_end_tags_and_unclosed_boilerplate(parse):
    a, b, c, d = parse(("generic", "<title>t</title><table><tr><td>Color<td>Red<tr><td>Size<td>M</table>"),
                       ("generic", "<title>t</title><dl><dt>Color<dd>Red<dt>Size<dd>M</dl>"),
                       ("generic", "<title>t</title><ul><li>Fit: Slim<li>Color: Red</ul>"),
                       ("generic", "<nav><h1>Name</h1><p>" + "<p>" * 3000))
    assert a["specs"] == b["specs"] == [("Color", "Red"), ("Size", "M")] and c["specs"] == [("Fit", "Slim"), ("Color", "Red")]
    assert d["title"] == "Name"


def test_nothing_is_cut_off(parse):
    html = ("<title>t</title><meta property='og:description' content='" + "d" * 5000 + "'><div id='feature-bullets'><ul>"
            + "".join(f"<li>b{i}</li>" for i in range(40)) + "</ul></div>" + "".join(f"<img src='http://x/i{i}.jpg'>" for i in range(12)))
    r = parse(("generic", html))
    assert len(r["description"]) == 5000 and len(r["bullet_points"]) == 40 and len(r["image_urls"]) == 12


def test_walmart_island(parse):
    block = {"idml": {"specifications": [{"name": "Color", "value": "Red"}, {"name": "Color", "value": "Blue"}, {"name": "N", "value": 5}],
                      "shortDescription": "<ul><li>Fit: Slim</li></ul>"},
             "product": {"name": "Tee", "brand": "Acme", "specifications": [{"specifications": [{"name": "Color", "value": "X"},
                         {"name": "Size", "value": "M"}]}], "imageInfo": {"allImages": [{"url": f"u{i}"} for i in range(8)]},
                         "specificationSection": {"specifications": [{"specifications": [{"name": "Size", "value": "Z"},
                                                                                       {"name": "Fit", "value": "S"}]}]},
                         "priceInfo": {"currentPrice": {"priceString": "$5.00"}}}}
    data = {"props": {"pageProps": {"initialData": {"data": block}}}}
    r = parse(("walmart", island(data)))
    assert r["source"] == "next_data" and r["title"] == "Tee" and r["brand"] == "Acme"
    assert r["specs"] == [("Color", "Blue"), ("N", "5"), ("Size", "M"), ("Fit", "S")]
    assert r["bullet_points"] == ["Fit: Slim"] and r["price_raw"] == "$5.00" and len(r["image_urls"]) == 8


def test_target_island_and_ghost(parse):
    item = {"product": {"item": {"product_description": {"title": "Tee", "bullet_descriptions": ["<b>Fit:</b> Slim"]},
                                 "primary_brand": {"name": "Acme"},
                                 "enrichment": {"images": {"primary_image_url": "p", "alternate_image_urls": ["p", "q"]}}}}}
    data = {"props": {"dehydratedState": {"queries": [{"product": {"other": 1}}, {"state": {"data": [{"x": item}]}}]}}}
    r, ghost = parse(("target", island(data)), ("target", island({"props": {"pageProps": {"statusCode": 404}}})))
    assert r["source"] == "target_next_data" and r["specs"] == [("Fit", "Slim")] and r["image_urls"] == ["p", "q"]
    assert ghost["source"] == "html_rules" and ghost["error"] == "missing_specs"


def test_flipkart_blob_and_header(parse):
    blob = "BrandJOCKEYTypeRound NeckSleeveHalf SleeveFitRegularFabric CareMachine washColorBlackGeneralxx" * 2
    r = parse(("flipkart", f"<header><h1>Jockey Tee</h1></header><span>₹1,299</span><div class='a grid-formation'>{blob}</div>"))
    specs = dict(r["specs"])
    assert specs["Brand"] == "JOCKEY" and specs["Type"] == "Round Neck"
    assert "Fabric" not in specs and specs["Care"] == "Machine wash"  # "Fabric Care" never matches whole
    assert r["title"] == "Jockey Tee" and r["price_raw"] == "₹1299" and r["brand"] == "Jockey"


def test_myntra_island(parse):
    myx = {"pdpData": {"brand": {"name": "HRX"}, "name": "Tee", "mrp": 999,
                       "articleAttributes": {"Fit": "Slim", "Neck": "NA", "Weight": 5}, "sizes": [{"label": "M", "available": True}],
                       "productDetails": [{"title": "Material & Care", "description": "Cotton<br>Wash: Cold"}]}}
    r = parse(("myntra", f"<script>window.__myx = {json.dumps(myx)};</script>"))
    assert r["title"] == "HRX Tee" and r["price_raw"] == "₹999" and r["bullet_points"] == ["Available Size: M"]
    assert r["specs"] == [("Fit", "Slim"), ("Weight", "5"), ("Wash", "Cold")] and r["description"] == "Cotton Wash: Cold"


def test_myntra_images_of_all_albums(parse):
    def page(**more):
        return ("myntra", f"<script>window.__myx = {json.dumps({'pdpData': {'name': 'Tee', 'articleAttributes': {'Fit': 'Slim'}, **more}})};</script>")
    shots = lambda *names: [{"imageURL": f"http://x/h_1,w_2,c_fill,g_auto/{n}.jpg"} for n in names]
    full, loose, none = parse(
        page(colours=[{"image": "http://x/red.jpg"}, {"image": None}], media={"images": shots("loose"), "albums": [
            {"images": shots("a", "b")}, {"images": None}, {"name": "empty"}, None, {"images": shots("c", "a")}, {"images": [{"imageURL": ""}, *shots("d")]}]}),
        page(media={"images": shots("loose"), "albums": [{"images": []}]}), page(media=None))
    assert full["image_urls"] == [f"http://x/{n}.jpg" for n in ("red", "a", "b", "c", "d")]
    assert loose["image_urls"] == ["http://x/loose.jpg"] and none["image_urls"] == []


def test_bad_pages_never_fail_the_job(parse):
    pages = [("myntra", 'window.__myx = {"pdpData": {"brand": null, "price": null, "sizes": null, "articleAttributes": {"a": 1, "b": null}}};'),
             ("myntra", "window.__myx = {broken"), ("walmart", island({"props": None})), ("walmart", '<script id="__NEXT_DATA__">{{</script>'),
             ("target", island({"props": {"dehydratedState": None}})), ("target", island([1, 2])), ("flipkart", "<"), ("generic", ""),
             ("generic", None), ("walmart", island({"props": {"pageProps": {"initialData": {"data": {"idml": None, "product": 3}}}}}))]
    out = parse(*pages)
    assert len(out) == len(pages) and out[0]["specs"] == [("a", "1")]
    assert all(r["status"] in ("ok", "failed") and (r["status"] == "ok") == (r["error"] is None) for r in out)


def test_hinted_blocks_detail_tables_and_colon_text(parse):
    r = parse(("generic", "<title>t</title><div class='product-Spec-row'><b>Weight</b><i>2 kg</i></div><li class='attributes'>Depth|3 cm</li>"
               "<div class='details'>one<i>two</i><b>three</b></div>"
               "<div id='productDetails_techSpec_section_1'><table><tr><th>Maker:</th><td>Acme</td></tr></table></div>"
               "<div>Origin: Peru</div><div>Box: <ul><li>Inner: yes</li></ul></div><div>Volume: 3</div><div>" + "x" * 50 + ": long key</div>"
               "<table><tr><td>One cell: a</td></tr></table>"))
    assert r["specs"] == [("Maker:", "Acme"), ("Weight", "2 kg"), ("Depth", "3 cm"), ("Maker", "Acme"), ("Origin", "Peru"), ("Inner", "yes"), ("One cell", "a")]


def test_lists_reach_over_inner_end_tags(parse):
    r = parse(("generic", "<title>t</title><div id='feature-bullets'><div>head</div><ul><li><div>one</div> more</li><li><div></div></li></ul>"
               "<div><ul><li>two</li></ul></div></div><li>outside</li><div class='x breadcrumb'><div><a>Home</a></div><a>Tees</a></div><a>no</a>"))
    assert r["bullet_points"] == ["onemore", "two"] and r["breadcrumb"] == ["Home", "Tees"]


def test_images_by_rank_size_and_source(parse):
    main, plain, none = parse(
        ("generic", "<title>t</title><img src='http://x/logo.png'><img class='a-dynamic-image' data-a-dynamic-image='{&quot;http://x/s.jpg&quot;:[10,10],"
         "&quot;http://x/l.jpg&quot;:[300,200],&quot;http://x/m.jpg&quot;:[200,300]}' data-old-hires='' src='http://x/thumb.jpg'>"
         "<div class='main-image'><span><img data-src='http://x/lazy.jpg'></span></div><div class='product-image'><img src='http://x/p.jpg'></div>"
         "<meta property='og:image' content='http://x/og.jpg'><img src='http://m.media-amazon.com/images/I/9._AC_SR38,50_.jpg'>"
         "<img src='http://m.media-amazon.com/images/I/sprite.jpg'>"),
        ("generic", "<title>t</title><img src='http://x/a.jpg' width='50'><img data-src='http://x/b.jpg' width='100%'><img src='/c.jpg'><img src='http://x/d.jpg' width=101>"),
        ("generic", "<title>t</title><img><img class='a-dynamic-image' data-a-dynamic-image='{broken'>"))
    assert main["image_urls"] == ["http://x/l.jpg", "http://x/thumb.jpg", "http://x/p.jpg", "http://x/lazy.jpg", "http://x/og.jpg",
                                  "http://m.media-amazon.com/images/I/9.jpg"]
    assert plain["image_urls"] == ["http://x/b.jpg", "http://x/d.jpg"] and none["image_urls"] == []


def test_flipkart_later_grids_and_two_cell_grids(parse):
    blob = "BrandJOCKEYTypeRound NeckSleeveHalf SleeveFitRegularFabric CareMachine washColorBlackGeneralxx" * 2
    cells = "".join(f"<div class='grid-formation x'>{''.join(f'<div>{c}</div>' for c in g)}</div>" for g in (["Fit", "Slim"], ["a", "b", "c"], ["Wash", "<b>Cold</b> only"], ["", "Hue", "Red"], ["one"]))
    later, two = parse(("flipkart", f"<h1>Tee</h1><div class='grid-formation'>{'no known key here ' * 9}</div><div class='grid-formation'>{blob}</div>" + cells),
                       ("flipkart", "<h1>Tee</h1>" + cells + "<img data-src='https://rukminim1.flixcart.com/image/1/2/x.jpg?q=1'>"))
    assert dict(later["specs"])["Brand"] == "JOCKEY" and ("Fit", "Slim") not in later["specs"]
    assert two["specs"] == [("Fit", "Slim"), ("Wash", "Coldonly"), ("Hue", "Red")]
    assert two["image_urls"] == ["https://rukminim1.flixcart.com/image/832/832/x.jpg"]


def test_myntra_without_its_page_object(parse):
    scripts = ('<script>x = [{"title":"Size & Fit","id":3,"description":"Model wears M<br>Relaxed"},'
               '{"title":"Material & Care","note":"title","description":"Cotton\\u003Cbr\\u003EWash: Cold<br/>Iron: No"}]</script>')
    dom = ("<div class='pdp-title'> HRX </div><h1 class='pdp-name'>Tee</h1><span class='pdp-price'><b>₹ 1,299</b></span>"
           "<div class='index-rowContainer'><div>Neck</div><div>Round</div></div><div class='pdp-product-description-content'><li>Hem: Straight</li></div>"
           "<meta property='og:image' content='http://x/h_1,w_2,c_fill,g_auto/a.jpg'><img src='http://assets.myntassets.com/b.jpg'><img src='http://x/c.jpg'>")
    both, rows, nothing = parse(("myntra", scripts + dom), ("myntra", dom + "<script>window.__myx = {broken</script>"), ("myntra", "<title>Shop</title><li>Fit: Slim</li>"))
    assert both["source"] == "myntra_dom_parser" and both["title"] == "HRX Tee" and both["brand"] == "HRX" and both["price_raw"] == "₹1299"
    assert both["specs"] == [("Wash", "Cold"), ("Iron", "No")] and both["description"] == "Cotton Wash: Cold Iron: No"
    assert both["bullet_points"] == ["Model wears M", "Relaxed"] and both["image_urls"] == ["http://x/a.jpg", "http://assets.myntassets.com/b.jpg"]
    assert rows["specs"] == [("Neck", "Round"), ("Hem", "Straight")] and rows["bullet_points"] == []
    assert nothing["source"] == "html_rules" and nothing["title"] == "Shop" and nothing["specs"] == [("Fit", "Slim")]


def test_islands_are_read_as_they_are_typed(parse):
    def walmart(product, idml=None, tail=""):
        return ("walmart", "<script>var a = 1;</script>" + island({"props": {"pageProps": {"initialData": {"data": {"product": product, "idml": idml}}}}}) + tail)
    item = lambda t: {"product": {"item": {"product_description": {"title": t, "bullet_descriptions": ["Fit: Slim"]}}}}
    queries = lambda *q: ("target", island({"product": item("outside")["product"], "props": {"dehydratedState": {"queries": list(q)}}}))
    named, null, number, own, deep, outside, empty = parse(
        walmart({"name": "Tee", "brand": {"name": "q"}}, tail="<h1>Page</h1>"), walmart({"name": None, "brand": None, "brandName": " Acme "}),
        walmart({"name": 7, "specifications": None, "imageInfo": {"allImages": [None, {"url": None}, {"url": "u"}]}}, {"specifications": [{"name": "N", "value": None}, None]}),
        queries({"a": item("inner"), **item("own")}), queries([{"product": {"x": item("deep")}}], item("late")), queries({"x": 1}), queries({"product": {"item": None}}))
    assert named["source"] == "html_rules" and named["title"] == "Page" and named["brand"] == ""
    assert null["source"] == "next_data" and null["title"] == "" and null["brand"] == "Acme"
    assert number["title"] == "7" and number["specs"] == [] and number["image_urls"] == ["u"]
    assert own["title"] == "own" and deep["title"] == "deep" and outside["source"] == "html_rules" and empty["title"] == ""


def test_a_scan_is_linear_on_hostile_pages():
    import time
    from pairlens import rules
    from pairlens.sources.tokens import Scan
    shapes = ["<svg ", "<div ", '<a "<a" ', "<!--", "<!", "<li>x", "<table><tr><td>", "<", "<a '", "<b></i>", "<script>", "<p a=b ", "&amp;<", "<div class=spec id=x>"]
    for shape in shapes:
        took = []
        for size in (100_000, 800_000):
            html, start = shape * (size // len(shape)), time.perf_counter()
            Scan(html, frozenset(rules.BOILERPLATE), True)
            took.append(time.perf_counter() - start)
        assert took[1] < 40 * max(took[0], 0.01), shape
    page = Scan("<nav><li>gone</li></nav><ul><li>a<li>b</ul><nav>kept", frozenset(rules.BOILERPLATE))
    assert page.texts == ["a", "b", "kept"] and [t[0] for t in page.tags] == ["li", "li"]


PARSE_TESTS = [test_generic_page, test_omitted_end_tags_and_unclosed_boilerplate, test_nothing_is_cut_off, test_walmart_island,
               test_target_island_and_ghost, test_flipkart_blob_and_header, test_myntra_island, test_myntra_images_of_all_albums,
               test_bad_pages_never_fail_the_job, test_hinted_blocks_detail_tables_and_colon_text, test_lists_reach_over_inner_end_tags,
               test_images_by_rank_size_and_source, test_flipkart_later_grids_and_two_cell_grids, test_myntra_without_its_page_object,
               test_islands_are_read_as_they_are_typed]


def test_page_records_view(spark):
    from pairlens.sources.pages import extract_records
    from pairlens.sql import create_page_records_view
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.createOrReplaceTempView("pages_sql_test")
    create_page_records_view(spark, "pages_sql_test", "records_sql_test")
    got = {r.page_id: (r.parser, r.title) for r in spark.sql("SELECT * FROM records_sql_test").collect()}
    want = {r.page_id: (r.parser, r.raw.title) for r in extract_records(pages).collect()}
    assert got == want and len(got) == pages.count()


def test_sql_scalar_functions_equal_dataframe_versions(spark):
    from pyspark.sql import functions as F
    from pairlens import functions as PF
    from pairlens.plans.catalog import BRAND_TEMPLATES, KEY_TEMPLATES, PRICE_TEMPLATES, _probe
    from pairlens.sql import register_sql
    assert "norm_key" in register_sql(spark)
    sf = "/root/testdata/sf0.001"
    for templates, name, fn, sql in [(KEY_TEMPLATES, "x", PF.norm_key, "norm_key(x)"),
                                     (BRAND_TEMPLATES, "x", PF.clean_brand, "clean_brand(x)"),
                                     (PRICE_TEMPLATES, "x", PF.clean_price, "clean_price(x)")]:
        df = _probe(spark, sf, templates, name)
        bad = df.select(fn(F.col("x")).alias("a"), F.expr(sql).alias("b")).where("NOT (a <=> b)").count()
        assert bad == 0, sql
    r = spark.sql("SELECT hamming_pct('ffffffffffffffff', '03ffffffffffffff') AS h, classify_key('neck_style') AS k, "
                  "result_label('NO_MATCH') AS l").first()
    assert (r.h, r.k, r.l) == (90.62, "size", "No Match")


def test_sql_norm_value_equals_dataframe_version(spark):
    from pyspark.sql import functions as F
    from pairlens import functions as PF
    from pairlens.plans.catalog import VALUE_TEMPLATES
    from pairlens.sql import register_sql
    register_sql(spark)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    probes = F.array(*[F.struct(F.lit(k).alias("k"), t().alias("v")) for k, t, _ in VALUE_TEMPLATES])
    df = part.select(F.inline(probes))
    bad = df.select(PF.norm_value("k", "v").alias("a"), F.expr("norm_value(k, v)").alias("b")).where("NOT (a <=> b)").count()
    assert bad == 0


def test_sql_similarity_equals_dataframe_version(spark):
    import random
    from pyspark.sql import functions as F
    from pairlens import functions as PF
    from pairlens.sql import register_sql
    register_sql(spark)
    rnd = random.Random(3)
    words = ["red", "blue", "tee", "cotton", "slim", "fit", "é", "a"]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))),
             " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))) for _ in range(150)]
    rows += [("x" * 70 + "ab", "ab" + "x" * 65)]  # more than one 62-bit word
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select(PF.lcs_len("a", "b").alias("l1"), F.expr("lcs_len(a, b)").alias("l2"),
                    PF.indel_ratio("a", "b").alias("i1"), F.expr("indel_ratio(a, b)").alias("i2"),
                    PF.token_set_ratio("a", "b").alias("t1"), F.expr("token_set_ratio(a, b)").alias("t2")).collect()
    for r in out:
        assert r.l1 == r.l2 and r.i1 == r.i2 and r.t1 == r.t2, r
