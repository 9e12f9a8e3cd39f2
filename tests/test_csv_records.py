"""CSV records across line ends and split boundaries, against Python's reader."""

import csv
import io
import random

from pyspark.sql import types as T

from pairlens.sources.csv_records import read_csv_records
from pairlens.sources.files import load_pairs

ABC = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


def _want(texts):
    return [tuple(x or None for x in r) for t in texts for r in list(csv.reader(io.StringIO(t)))[1:] if r]


def _got(spark, path):
    rows = sorted(read_csv_records(spark, path, ABC).collect(), key=lambda r: r["_n"])
    assert [r["_n"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r.a, r.b, r.c) for r in rows]


def test_records_over_many_splits(spark, tmp_path):
    rng = random.Random(3)
    cell = lambda: "".join(rng.choice(['x', 'yz', ' ', '\n', '\n\n', '"', ',', 'é']) for _ in range(rng.randint(1, 9))).strip() or "w"
    texts = []
    for name in ("1.csv", "2.csv"):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow("abc")
        w.writerows([str(i), cell(), cell()] for i in range(150))
        w.writerow(["long", "\n".join(f"line {i}" for i in range(400)), "end"])  # covers whole splits
        w.writerows([str(i), cell(), cell()] for i in range(50))
        texts.append(out.getvalue())
        (tmp_path / name).write_text(out.getvalue(), encoding="utf-8")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "700")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert _got(spark, str(tmp_path)) == _want(texts)
    finally:
        spark.conf.set(key, before)


def test_record_edges(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes('﻿a,b,c\r\n1,"two\r\nlines",3\r\n\r\n,,""\r\n"say ""hi""",x\r\nlast,"open\nto the end'.encode())
    assert _got(spark, str(p)) == [("1", "two\nlines", "3"), (None, None, None), ('say "hi"', "x", None), ("last", "open\nto the end", None)]
    for text in ("", "a,b,c\n"):
        p.write_text(text)
        assert _got(spark, str(p)) == []


def test_pairs_with_quoted_line_ends(spark, tmp_path):
    p = tmp_path / "pairs.csv"
    p.write_text('Month,Item_Id,Comp_Url,Match_Type,Super_Department,Department,Product_Type\n'
                 'Jan,11,https://a.example/1,"Variant\nMatch",S,D,P\nFeb,12,https://a.example/2,M,S,D,P\n')
    rows = load_pairs(spark, str(p), multi_line=True).orderBy("pair_id").collect()
    assert [(r.pair_id, r.meta.original_match_type) for r in rows] == [("row_0001", "Variant\nMatch"), ("row_0002", "M")]
