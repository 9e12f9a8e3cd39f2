"""Pair CSV loading, the end-to-end job on stored pages, compare, idempotent sinks."""

import json


import pytest
from pyspark.sql import functions as F

from pairlens.operators.relational import union_by_precedence
from pairlens.plans import jobs
from pairlens.plans.jobs import STEPS, compare, run, run_job
from pairlens.plans.step_tables import StepTable
from pairlens.sources.files import load_pairs, read_jsonl, write_results
from pairlens.sources.pages import RAW_T

CSV = ('﻿Month,Item_Id,Comp_Url,Match_Type,Super_Department,Department,Product_Type\n'
       'Sep-25,"""90817263545""",https://shop.example.com/a,Similar Match,Clothing,Mens Clothing,Mens Shirts\n'
       'Oct-25,"""42""",https://shop.example.com/b,Variant Match,Clothing,Mens Clothing,Mens Pants')


def _page(title, specs, bullets=()):
    rows = "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in specs)
    lis = "".join(f"<li>{b}</li>" for b in bullets)
    return (f"<html><head><title>{title}</title></head><body><nav><li>Menu: x</li></nav>"
            f"<table>{rows}</table><div id='feature-bullets'><ul>{lis}</ul></div></body></html>")


def test_load_pairs(spark, tmp_path):
    p = tmp_path / "pairs.csv"
    p.write_text(CSV, encoding="utf-8")
    rows = load_pairs(spark, str(p)).orderBy("pair_id").collect()
    assert rows[0].pair_id == "row_0001" and rows[0].link_1_url == "https://www.walmart.com/ip/90817263545"
    assert rows[0].meta.item_id == "90817263545" and rows[1].meta.original_match_type == "Variant Match"
    assert load_pairs(spark, str(p), limit=1).count() == 1


def test_end_to_end_and_rerun(spark, tmp_path):
    p = tmp_path / "pairs.csv"
    p.write_text(CSV, encoding="utf-8")
    pairs = load_pairs(spark, str(p))
    pages = spark.createDataFrame([
        (1, "https://www.walmart.com/ip/90817263545", _page("Hanes Men's Tee Blue", [("Color", "Blue"), ("Size", "M")], ["Fit: Slim"])),
        (2, "https://shop.example.com/a", _page("Hanes Men's Tee Red", [("Colour", "Red"), ("Size", "Medium")], ["Fit: Slim"])),
        (3, "https://www.walmart.com/ip/42", _page("Robot or human?", [])),
    ], "page_id long, url string, html string")
    out = run(pairs, pages)
    res = {r.pair_id: r for r in out["results"].collect()}
    assert res["row_0001"].our_result == "CASE_C_COLOR_DIFF"
    assert "row_0002" not in res  # second link not stored -> no features -> skipped
    raw = {(r.pair_id, r.link_key): r for r in out["raw_records"].collect()}
    assert out["parse_quality"].get["records"] == 4 and out["parse_quality"].get["ok"] == 2
    assert raw[("row_0002", "link_1")].error == "blocked_press_hold"
    assert raw[("row_0002", "link_2")].error == "page_not_stored"
    dest = str(tmp_path / "results")
    write_results(out["results"], dest)
    write_results(out["results"], dest)
    assert spark.read.parquet(dest).count() == 1
    summ = [(r.our_result, r.n) for r in out["summary"].collect()]
    assert ("CASE_C_COLOR_DIFF", 1) in summ and len(summ) == 4


def test_compare_and_jsonl(spark, tmp_path):
    mk = lambda t, specs: spark.createDataFrame(
        [("web", "u", "ok", {"title": t, "brand": "Acme", "description": "", "bullet_points": [],
                             "spec_table": [{"key": k, "value": v} for k, v in specs], "image_urls": [],
                             "price_raw": "$5", "breadcrumb": [], "source": "x"})],
        T_RAW)
    out = compare(mk("Acme Tee", [("Size", "S")]), mk("Acme Tee", [("Size", "L")])).first()
    assert out.verdict == "CASE_B_SIZE_DIFF" and out.comparison.total_features_compared == 1
    f = tmp_path / "x.jsonl"
    f.write_text(json.dumps({"pair_id": "a"}) + "\n\nnot json\n" + json.dumps({"pair_id": "b"}) + "\n")
    from pyspark.sql import types as T
    sch = T.StructType([T.StructField("pair_id", T.StringType())])
    assert sorted(r.pair_id for r in read_jsonl(spark, str(f), sch).collect() if r.pair_id) == ["a", "b"]
    assert read_jsonl(spark, str(tmp_path / "missing.jsonl"), sch).count() == 0


from pyspark.sql import types as _T  # noqa: E402

T_RAW = _T.StructType([_T.StructField("pair_id", _T.StringType()), _T.StructField("url", _T.StringType()),
                       _T.StructField("status", _T.StringType()), _T.StructField("raw", RAW_T)])


def test_file_order_across_splits(spark, tmp_path):
    lines = [CSV.splitlines()[0]] + [f'Sep-25,"""{1000 + i}""",https://shop.example.com/{i},Variant Match,C,D,P{i}' for i in range(60)]
    p = tmp_path / "many.csv"
    p.write_text("\n".join(lines), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        df = load_pairs(spark, str(p))
        got = sorted((r.pair_id, r.meta.item_id) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(f"row_{i + 1:04d}", str(1000 + i)) for i in range(60)]


def _job_input(spark, n=12):
    """n pairs; some links share a URL, some are not stored, some are walls."""
    pairs, pages = [], []
    for i in range(n):
        one, two = f"https://www.walmart.com/ip/{i}", "https://shop.example.com/shared" if i % 4 == 3 else f"https://shop.example.com/{i}"
        pairs.append((f"row_{i + 1:04d}", one, two, ("", str(i), "Similar Match", "", "D", "P")))
        pages.append((2 * i, one, _page("Robot or human?" if i % 6 == 5 else f"Hanes Tee {i % 4}", [("Color", "Blue"), ("Size", "SML"[i % 3])])))
        if i % 5 != 4:
            pages.append((2 * i + 1, two, _page(f"Hanes Tee {i % 4}", [("Colour", "Blue"), ("Size", "SML"[i % 2])], ["Fit: Slim"])))
    meta = "struct<month:string,item_id:string,original_match_type:string,super_department:string,department:string,product_type:string>"
    return (spark.createDataFrame(pairs, f"pair_id string, link_1_url string, link_2_url string, meta {meta}"),
            spark.createDataFrame(pages, "page_id long, url string, html string"))


def _rows(df, *drop):
    return sorted(map(str, df.drop("scraped_at", "extracted_at", "classified_at", *drop).collect()))


def test_job_killed_anywhere_and_rerun_equals_one_run(spark, tmp_path, monkeypatch):
    pairs, pages = _job_input(spark)
    whole = run_job(pairs, pages, str(tmp_path / "one"))
    assert whole["parse_quality"]["records"] == 24 and sum(r.n for r in whole["summary"].collect()) == whole["results"].count() > 0
    tables = ["raw_records", "features", "diffs", "results"]
    for at in (0, 2):  # the write succeeds, the marker is never made
        root, publish, calls = str(tmp_path / f"killed{at}"), StepTable.publish, []

        def dying(self, rows):
            if len(calls) == at:
                rows.write.parquet(f"{self.path}/parts/{'0' * 6}-{'f' * 32}")
                raise KeyboardInterrupt
            calls.append(1)
            publish(self, rows)
        monkeypatch.setattr(StepTable, "publish", dying)
        with pytest.raises(KeyboardInterrupt):
            run_job(pairs, pages, root)
        monkeypatch.setattr(StepTable, "publish", publish)
        assert not StepTable(spark, root, tables[at]).parts()
        out = run_job(pairs, pages, root)
        assert all(_rows(out[t]) == _rows(whole[t]) for t in tables)
        assert StepTable(spark, root, tables[at]).sweep() == [f"{'0' * 6}-{'f' * 32}"]
        assert all(_rows(StepTable(spark, root, t).read()) == _rows(whole[t]) for t in tables)


def test_job_by_steps_and_limits_adds_only_what_is_new(spark, tmp_path):
    pairs, pages = _job_input(spark)
    whole, root = run_job(pairs, pages, str(tmp_path / "one")), str(tmp_path / "steps")
    assert "results" not in run_job(pairs, pages, root, step="classify")  # nothing to read yet
    with pytest.raises(ValueError):
        run_job(pairs, pages, root, step="everything")
    first = run_job(pairs, pages, root, limit=5)
    assert first["raw_records"].count() == 10
    for s in STEPS:
        out = run_job(pairs, pages, root, step=s)
    assert all(_rows(out[t]) == _rows(whole[t]) for t in ("raw_records", "features", "diffs", "results"))
    sizes = [StepTable(spark, root, t).read().count() for t in ("raw_records", "features", "diffs", "results")]
    again = run_job(pairs, pages, root)
    assert again["parse_quality"]["records"] == 0
    assert sizes == [StepTable(spark, root, t).read().count() for t in ("raw_records", "features", "diffs", "results")]
    assert run_job(pairs, pages, root, limit=2)["raw_records"].count() == 4  # only the pairs in scope


def test_url_cache_is_used_and_link_2_wins(spark, tmp_path):
    root, url = str(tmp_path / "job"), "https://shop.example.com/shared"
    meta = "struct<month:string,item_id:string,original_match_type:string,super_department:string,department:string,product_type:string>"
    schema = f"pair_id string, link_1_url string, link_2_url string, meta {meta}"
    none = ("", "", "", "", "", "")
    page = lambda t: spark.createDataFrame([(1, url, _page(t, []))], "page_id long, url string, html string")
    run_job(spark.createDataFrame([("a", "https://x.example/1", url, none)], schema), page("Second side"), root, step="scrape")
    rows = StepTable(spark, root, "raw_records").read().where("link_key = 'link_2'")
    other = rows.withColumn("pair_id", F.lit("z")).withColumn("link_key", F.lit("link_1")).withColumn("raw", F.col("raw").withField("title", F.lit("First side")))
    StepTable(spark, root, "raw_records").publish(other)  # later and with a greater id, but of the side that loses
    out = run_job(spark.createDataFrame([("b", url, "https://x.example/2", none)], schema), page("Page of today"), root, step="scrape")
    got = {(r.link_key, r.status): r.raw and r.raw.title for r in out["raw_records"].collect()}
    assert got == {("link_1", "ok"): "Second side", ("link_2", "failed"): None}


def test_union_by_precedence(spark):
    one = spark.createDataFrame([("u", 9, "one"), ("v", 1, "old"), ("v", 2, "new"), (None, 3, "no key")], "url string, seq long, raw string")
    two = spark.createDataFrame([("u", 1, "two"), ("w", None, "no order"), ("x", 5, "x")], "url string, seq long, raw string")
    got = union_by_precedence([one, two], ["url"], ["seq"])
    assert sorted((r.url, r.raw) for r in got.collect()) == [("u", "two"), ("v", "new"), ("x", "x")]
    assert "SortMergeJoin" in (plan := got._jdf.queryExecution().toString()) or "HashJoin" in plan
    assert jobs.STEPS == ("scrape", "extract", "match", "classify")
