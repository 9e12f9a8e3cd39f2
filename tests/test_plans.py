"""Plan shape checks: what must stay shuffle-free or partially aggregated."""

from pyspark.sql import functions as F

from pairlens.operators.diff import compute_diff
from pairlens.operators.relational import last_by_key
from pairlens.operators.verdict import classify


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_diff_and_verdict_add_no_shuffle(spark):
    attrs = "array<struct<key:string,raw:string,kind:string,s:string,n:double>>"
    feat = f"struct<url:string,title:string,brand:string,attrs:{attrs},primary_phash:string>"
    df = spark.createDataFrame([("p1", ("u1", "red tee", "acme", [("color", "Red", "str", "red", None)], None),
                                 ("u2", "blue tee", "acme", [("color", "Blue", "str", "blue", None)], None))],
                               f"pair_id string, f1 {feat}, f2 {feat}")
    out = classify(compute_diff(df))
    assert "Exchange" not in _plan(out)
    assert out.first().our_result == "CASE_C_COLOR_DIFF"


def test_last_wins_is_partial_aggregate(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), (F.col("id") * 2).alias("v"))
    plan = _plan(last_by_key(df, ["k"], ["t"]))
    assert "partial_max_by" in plan and plan.count("Exchange") == 1
    got = sorted(tuple(r) for r in last_by_key(df, ["k"], ["t"]).collect())
    assert got == [(0, 999, 1998), (1, 997, 1994), (2, 998, 1996)]


def test_stream_rerun_adds_nothing(spark, tmp_path):
    from pairlens.streaming.jobs import dedup_stream, stream_table
    src = tmp_path / "events"
    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:10:00"), (2, "b", "2024-01-01 00:05:00")],
                          "user_id long, event_type string, ts string") \
        .withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):  # second run: checkpoint says everything is done
        q = (dedup_stream(stream_table(spark, str(src)), ["user_id", "event_type"], "ts").writeStream
             .format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_stream_dedup_covers_a_table_that_grows(spark, tmp_path):
    from pathlib import Path
    from pairlens.plans.catalog import stream_dedup
    from pairlens.session import ensure_checkpoint_dir
    folder, table = str(tmp_path), str(tmp_path / "events.parquet")

    def rows(ids):
        return spark.createDataFrame([(i, "ab"[i % 2]) for i in ids], "user_id long, event_type string").coalesce(1)

    def copies():
        base = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "streams"
        return set(base.glob("events-files-*"))

    def keys():
        return sorted(tuple(r) for r in stream_dedup(spark, folder).collect())
    want = lambda n: [(i, "ab"[i % 2]) for i in range(n)]
    before = copies()
    rows([0, 1, 1, 2]).write.parquet(table)
    assert keys() == want(3) and keys() == want(3) and len(copies() - before) == 1
    rows([2, 3, 4, 4]).write.mode("append").parquet(table)
    assert keys() == want(5) and keys() == want(5) and len(copies() - before) == 2
    rows(range(9)).write.mode("overwrite").parquet(table)
    assert keys() == want(9)
    for path in copies() - before:  # copies that broke off
        (path / "_SUCCESS").unlink()
        for part in sorted(path.glob("part-*"))[1:]:
            part.unlink()
    assert keys() == want(9)


def test_parse_pass_keeps_columns_without_shuffle(spark):
    from pairlens.sources.pages import extract_records
    pages = spark.createDataFrame([(1, "https://a.example/x", "<title>T</title>", "a.example")],
                                  "page_id long, url string, html string, host string")
    out = extract_records(pages, keep=("host",))
    assert "Exchange" not in _plan(out)
    r = out.first()
    assert (r.host, r.status, r.raw.title) == ("a.example", "ok", "T")


def test_value_probes_of_one_small_file_run_in_many_tasks(spark, tmp_path, monkeypatch):
    from pairlens.plans import catalog, fixtures
    spark.createDataFrame([(i, f"red tee {i}", "Acme", "COTTON", i % 50, 9.5) for i in range(400)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .coalesce(1).write.parquet(str(tmp_path / "part.parquet"))

    def tasks_and_most():
        out = catalog.QUERIES["norm_value"](spark, str(tmp_path))
        assert out.count() == 400 * len(catalog.VALUE_TEMPLATES)
        per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("t")).count().collect()]
        return len(per_task), max(per_task)

    assert tasks_and_most()[0] >= 8  # as many as a shuffle has
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 20)
    tasks, most = tasks_and_most()
    assert tasks == 20 and most <= 40 * len(catalog.VALUE_TEMPLATES)  # and more as the table grows


def test_one_number_for_all_plain_units(spark):
    from pairlens.functions import norm_value
    cases = [("weight", "2.5 lbs", 1133.98), ("weight", "1.2.3 kg", None), ("weight", "kg", None), ("weight", "7", None),
             ("capacity", "2 fl oz", 59.147), ("capacity", "2 fl. oz", 59.147), ("capacity", ".5 fl. oz", 14.7867),
             ("volume", "2. l", 2000.0), ("capacity", "1.5.2 fl. oz", None), ("height", "3 feet", 91.44), ("height", "5%", 5.0)]
    df = spark.createDataFrame([c[:2] for c in cases], "k string, v string")
    for bind in (True, False):
        assert [r.x.n for r in df.select(norm_value("k", "v", bind=bind).alias("x")).collect()] == [c[2] for c in cases]


def test_stream_batches_stay_and_files_follow_the_table(spark, tmp_path, monkeypatch):
    from pathlib import Path
    from pairlens.plans import catalog
    spark.createDataFrame([(i, f"2024-01-{1 + i % 28:02d}") for i in range(100)], "o_orderkey long, o_orderdate string") \
        .coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i % 120, i, "2024-02-02") for i in range(1000)], "l_orderkey long, l_linenumber int, l_shipdate string") \
        .coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(catalog, "STREAM_FILE_ROWS", 100)
    assert catalog._in_files(spark, str(tmp_path), "orders", 2)[1] == 1
    path, files = catalog._in_files(spark, str(tmp_path), "lineitem", 3)
    held = [spark.read.parquet(str(f)).count() for f in Path(path.removeprefix("file:")).glob("*.parquet")]
    assert files == 4 and len(held) == 12 and max(held) <= 100
    got = sorted(tuple(r) for r in catalog.QUERIES["stream_pair_join"](spark, str(tmp_path)).collect())
    assert got == sorted((i % 120, i, f"2024-01-{1 + i % 120 % 28:02d}", "2024-02-02") for i in range(1000) if i % 120 < 100)


def test_key_alignment_of_one_small_file_runs_in_many_tasks(spark, tmp_path):
    from pairlens.plans import catalog
    spark.createDataFrame([(i, f"red tee {i}", "Acme", "COTTON", i % 50, 9.5) for i in range(400)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = catalog.QUERIES["key_alignment"](spark, str(tmp_path))
    assert out.count() == 400 and out.select(F.spark_partition_id()).distinct().count() >= 8


def test_matching_work_is_bound_once(spark):
    from pairlens.functions import token_set_ratio
    from pairlens.operators.attributes import normalize_attributes
    assert normalize_attributes("attrs")._jc.toString().count("(items?|left|remaining)") == 1
    assert token_set_ratio("a", "b")._jc.toString().count("array_except") == 2
