"""CSV records of a splittable scan, line ends inside quotes included (IO1).

Spark reads a CSV file whole in one task once records may span lines. Here the file
stays a scan of lines, cut into splits, and the record boundaries come from an index:

1. a line's quotes are counted; a line starts a record if the quotes before it in its
   file are even in number. Within a split that is a running sum, and splits are
   chained by one row per split (its quotes, records and last record start);
2. a line that is a record by itself, as nearly all are, stays where it is. Only
   lines of records that span lines are grouped, by file and start;
3. the same chain numbers the records in file order.

Defined results: blank lines between records are skipped; a byte order mark and the
carriage return before a line end go, inside quotes as well as at a record's end; every
file has its own header, files count in the order of their paths; a quote that is never
closed takes the rest of its file as one record, as any CSV reader does; an empty file
or folder gives no records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_records(spark: SparkSession, path: str, schema: T.StructType, index: str = "_n") -> DataFrame:
    """The records below the header, in columns by position, numbered from 1 in file order."""
    d = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    d = d.withColumn("odd", (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2)

    # Within a split, before it is known whether the split begins inside quotes: both readings, a and b.
    in_split = Window.partitionBy("file", "split").orderBy("at")
    before = F.coalesce(F.sum("odd").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    d = d.withColumn("before", before)

    def reading(parity: int) -> dict:
        start = F.col("before") == parity
        so_far = in_split.rowsBetween(Window.unboundedPreceding, 0)
        return {f"n{parity}": F.count(F.when(start & (F.col("line") != ""), 1)).over(so_far),
                f"from{parity}": F.last(F.when(start, F.col("at")), ignorenulls=True).over(so_far)}

    d = d.withColumns({**reading(0), **reading(1)})

    # one row per split: chained by its parity, its records and its last record start
    splits = d.groupBy("file", "split").agg(
        F.sum("odd").alias("odd"), *[F.max(c).alias(c) for c in ("n0", "n1", "from0", "from1")])
    chain = Window.partitionBy("file").orderBy("split")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    splits = splits.select("file", "split", "inside", F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1")).alias("n"),
                           F.when(F.col("inside") == 0, F.col("from0")).otherwise(F.col("from1")).alias("from"))
    splits = splits.withColumns({
        "in_file": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "carried": F.last("from", ignorenulls=True).over(earlier),
        "total": F.sum("n").over(Window.partitionBy("file"))})
    order = Window.orderBy("file", "split")
    splits = splits.where("total > 0").withColumns({
        "in_all": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "headers": F.dense_rank().over(Window.orderBy("file"))})

    chained = splits.select("file", "split", "inside", "in_file", "in_all", "headers", "carried")
    d = d.join(F.broadcast(chained), ["file", "split"])  # one row per split of the scan
    even = F.col("inside") == 0
    number = F.when(even, F.col("n0")).otherwise(F.col("n1"))
    starts = F.col("before") == F.col("inside")
    d = d.select(
        "file", "split", "at", "line", starts.alias("starts"), (starts & (F.col("odd") == 0)).alias("whole"),
        F.coalesce(F.when(even, F.col("from0")).otherwise(F.col("from1")), "carried").alias("from"),
        (F.col("in_file") + number).alias("no"), (F.col("in_all") + number - F.col("headers")).alias(index))

    alone = d.where("whole AND line <> ''").select("no", index, "line")
    part = F.struct("split", "at", "line")
    spanning = d.where("NOT whole").groupBy("file", "from").agg(
        F.min(F.when(F.col("starts"), F.col("no"))).alias("no"), F.min(F.when(F.col("starts"), F.col(index))).alias(index),
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["line"]), "\n").alias("line"))
    records = alone.unionByName(spanning.select("no", index, "line")).where("no > 1")  # the first is the header
    cells = F.from_csv("line", schema.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"'})
    return records.select(cells.alias("r"), index).select("r.*", index)
