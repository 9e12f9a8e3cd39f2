"""Catalog fixtures derived from the driver tables.

``part`` stands in for a product catalog: title = ``p_name``, brand = ``p_brand``,
spec table = Color (first name word), Size (S/M/L from ``p_size % 3``) and
Material (``p_type``), price text = ``$`` + ``p_retailprice``. Each part is paired
with the next part (by key) of the same brand and type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attributes import extract_features
from ..operators.sequence import with_next_in_group

PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_TASK = 20_000


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of few bytes and much work a row, dealt evenly over tasks.

    Spark cuts a scan by bytes, so a hundred thousand rows of a small file would be one task. The number of tasks is
    that of a shuffle, or more where each would get over ``ROWS_PER_TASK`` rows.
    """
    rows = read_table(spark, sf_dir, name).select(*columns)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))
    return rows.repartition(tasks)


def part_raw_records(part: DataFrame) -> DataFrame:
    """One raw product record per part (the scrape output shape)."""
    words = F.split(F.col("p_name"), " ")
    size = F.element_at(F.array(F.lit("S"), F.lit("M"), F.lit("L")), (F.col("p_size") % 3 + 1).cast("int"))
    spec = F.array(
        F.struct(F.lit("Color").alias("key"), F.get(words, 0).alias("value")),
        F.struct(F.lit("Size").alias("key"), size.alias("value")),
        F.struct(F.lit("Material").alias("key"), F.col("p_type").alias("value")),
    )
    raw = F.struct(
        F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.lit("").alias("description"),
        F.array().cast("array<string>").alias("bullet_points"), spec.alias("spec_table"),
        F.array().cast("array<string>").alias("image_urls"),
        F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("price_raw"),
        F.array().cast("array<string>").alias("breadcrumb"), F.lit("part").alias("source"),
    )
    return part.select(
        "p_partkey", "p_brand", "p_type",
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("pair_id"),
        F.lit("item").alias("link_key"),
        F.concat(F.lit("part://"), F.col("p_partkey").cast("string")).alias("url"),
        F.lit("ok").alias("status"), raw.alias("raw"))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs ``(pair_id, f1, f2)`` of consecutive parts within brand and type.

    Features are extracted once per part (each part is in up to two pairs), then
    the next part's feature struct is carried by the skew-safe window.
    """
    part = read_table(spark, sf_dir, "part").select(*PART_COLUMNS)
    raw = part_raw_records(part)

    def features(d: DataFrame) -> DataFrame:
        feats = extract_features(d, keep=("p_partkey", "p_brand", "p_type", "_blk")).drop("pair_id", "link_key")
        cols = [c for c in feats.columns if c not in ("p_partkey", "p_brand", "p_type", "_blk")]
        return feats.select("p_partkey", "p_brand", "p_type", "_blk", F.struct(*cols).alias("feat"))

    paired = with_next_in_group(raw, ["p_brand", "p_type"], "p_partkey", ["p_partkey", "feat"], per_row=features)
    return paired.where(F.col("next_p_partkey").isNotNull()).select(
        F.format_string("p%d-p%d", F.col("p_partkey"), F.col("next_p_partkey")).alias("pair_id"),
        F.col("feat").alias("f1"), F.col("next_feat").alias("f2"))
