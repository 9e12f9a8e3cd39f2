"""File sources and sinks (IO1-IO3, IO6, PF1, PF2, SL1).

Schemas are explicit (never inferred); sinks overwrite their own output or
skip finished keys, so a rerun adds no rows (deviation D8: all sinks idempotent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv_records import read_csv_records

PAIR_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                                ["Month", "Item_Id", "Comp_Url", "Match_Type", "Super_Department", "Department",
                                 "Product_Type"]])


def file_order_index(df: DataFrame, name: str = "_n") -> DataFrame:
    """Dense 1-based row number in input order, without sending the rows
    through one task (H6). ``monotonically_increasing_id`` holds the partition
    index in its high bits and the row's position in the split in its low bits;
    one small aggregate gives each split's row count, a window over those
    counts (one row per split) gives each split's offset, and that table —
    bounded by the number of splits — is broadcast back."""
    from pyspark.sql import Window
    d = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_first", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    return (d.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
            .drop("_pid", "_mid", "_cnt", "_first", "_off"))


def load_pairs(spark: SparkSession, csv_path: str, limit: int | None = None, multi_line: bool = False) -> DataFrame:
    """Pair CSV -> ``pairs(pair_id, link_1_url, link_2_url, meta)`` (IO1, PF1, SL1).

    ``pair_id`` is ``row_%04d`` of the 1-based file order. ``multi_line`` admits line ends
    inside quotes, by the record boundary index of ``csv_records``; the file is read in splits either way.
    ``limit`` None or 0 means no limit.
    """
    if multi_line:
        ordered = read_csv_records(spark, csv_path, PAIR_CSV_SCHEMA)
    else:
        ordered = file_order_index(spark.read.schema(PAIR_CSV_SCHEMA).option("header", True).option("escape", '"')
                                   .option("encoding", "UTF-8").csv(csv_path))
    if limit:
        ordered = ordered.where(F.col("_n") <= limit)
    item = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("Item_Id"), F.lit("")), "(?U)^\\s+|\\s+$", ""),
                            '^"+|"+$', "")
    meta = F.struct(
        F.coalesce(F.col("Month"), F.lit("")).alias("month"), item.alias("item_id"),
        F.coalesce(F.col("Match_Type"), F.lit("")).alias("original_match_type"),
        F.coalesce(F.col("Super_Department"), F.lit("")).alias("super_department"),
        F.coalesce(F.col("Department"), F.lit("")).alias("department"),
        F.coalesce(F.col("Product_Type"), F.lit("")).alias("product_type"))
    return ordered.select(
        F.format_string("row_%04d", F.col("_n")).alias("pair_id"),
        F.concat(F.lit("https://www.walmart.com/ip/"), item).alias("link_1_url"),
        F.regexp_replace(F.coalesce(F.col("Comp_Url"), F.lit("")), "(?U)^\\s+|\\s+$", "").alias("link_2_url"),
        meta.alias("meta"))


def link_rows(pairs: DataFrame) -> DataFrame:
    """Unpivot each pair into its two link rows (PF2)."""
    return pairs.select("pair_id", F.inline(F.array(
        F.struct(F.lit("link_1").alias("link_key"), F.col("link_1_url").alias("url")),
        F.struct(F.lit("link_2").alias("link_key"), F.col("link_2_url").alias("url")))))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSONL scan: blank and malformed lines dropped; a missing path is empty (IO2)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSONL sink with nulls written (IO3); a rerun replaces its rows."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result sink partitioned by verdict; overwrite makes reruns idempotent (IO6)."""
    results.write.mode("overwrite").partitionBy("our_result").parquet(path)
