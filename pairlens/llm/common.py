"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, ship_package

# The white space that separates words, and a word.
SPACE_CHARS = " \t\n\x0b\x0c\r"
# In Java patterns \\s is [ \\t\\n\\x0B\\f\\r], that is [\\x20\\x09-\\x0D], and the quickest form.
SPACE_RE = r"\s+"
WORD_RE = r"\S+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (any file system it knows)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    This cuts the lineage with a table that every executor can reread, so a lost
    executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame, rounds: int = 1) -> None:
    """Delete tables that ``stored`` wrote, once nothing will read them again, and the shuffle files of ended jobs.

    Spark removes shuffle files when the driver collects the plans that they belong to, which it may
    otherwise not do for hours; Python lets go of its handles a moment after their last use. The files of the
    very last job need up to three ``rounds``: one collection frees what holds the next.
    """
    import gc
    import time

    from pyspark import SparkContext
    gc.collect()
    time.sleep(0.5)
    sc = SparkContext._active_spark_context
    for t in tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    sc._jvm.System.gc()
    for _ in range(rounds - 1):
        time.sleep(0.3)
        sc._jvm.System.gc()


def bound(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    The optimizer inlines a projected expression wherever it is used, also inside
    lambdas that run once per array element; it does not inline across a generator.
    """
    for name, col in cols.items():
        df = df.select("*", F.explode(F.array(col)).alias(name))
    return df


def word_array(text: Column) -> Column:
    """The words of a text (null or without words: an empty array)."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE))


def n_words(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def unit_random(*cols: Column) -> Column:
    """A repeatable number in (0, 1) from a 64-bit hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def pieces(batches: Iterable[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in batches of about ``size`` bytes (a row at least), nothing copied.

    Spark hands over up to 10,000 rows or 64 MB at once where a session sets no less; what a task makes of
    them in Python then takes a few times that, in every worker, and is kept by its allocator after the task.
    """
    for b in batches:
        step = max(1, b.num_rows * size // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def empty_to(df: DataFrame, name: str, kind: T.DataType | str) -> DataFrame:
    """Cast one column (tables may arrive with another integer width)."""
    return df.withColumn(name, F.col(name).cast(kind))
