"""Streams over several batches and runs: delta join without state, replaced batches, late sides."""

from pyspark.sql import functions as F

from pairlens.streaming.jobs import _run_dir, delta_pair_join, stream_table


def _append(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_delta_join_over_batches_runs_and_late_sides(spark, tmp_path):
    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    l_schema, r_schema = "k long, a string", "j long, b string"
    _append(spark, left, [(1, "x"), (2, "y"), (None, "n")], l_schema)
    _append(spark, left, [(1, "again"), (7, "late right")], l_schema)
    _append(spark, right, [(1, "p"), (None, "n")], r_schema)

    def run():
        out = delta_pair_join(stream_table(spark, left, 1), stream_table(spark, right, 1), "k", "j", "delta", str(tmp_path))
        return sorted(map(tuple, out.collect()))
    want = [(1, "again", 1, "p"), (1, "x", 1, "p")]
    assert run() == want and run() == want  # a second run without new files adds nothing
    _append(spark, right, [(7, "q"), (2, "r"), (2, "s")], r_schema)  # far later than its left side
    _append(spark, left, [(2, "z")], l_schema)
    want = sorted([*want, (7, "late right", 7, "q"), *((2, a, 2, b) for a in "yz" for b in "rs")])
    assert run() == want
    base = _run_dir(spark, "delta", str(tmp_path))
    assert sorted(map(tuple, spark.read.parquet(f"{base}/left").drop("batch").collect()), key=str) == sorted(
        [(1, "x"), (2, "y"), (None, "n"), (1, "again"), (7, "late right"), (2, "z")], key=str)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{base}/ckpt/state")
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)  # no state store
    # a batch run again replaces its own part: drop the last commit and run once more
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName()) for s in fs.listStatus(jvm.Path(f"{base}/ckpt/commits")) if s.getPath().getName().isdigit())
    fs.delete(jvm.Path(f"{base}/ckpt/commits/{last}"), False)
    assert run() == want
    assert spark.read.parquet(f"{base}/out").agg(F.max("batch")).first()[0] == last
