"""Incremental variants (ST1-ST4) as Structured Streaming queries.

Each runs with ``trigger(availableNow=True)``: everything present is processed,
the checkpoint records progress (the resume index of the batch jobs), and a
rerun picks up only new files. Output and checkpoints live in the cluster's
checkpoint folder; results are read back as a DataFrame.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _run_dir(spark: SparkSession, name: str, source: str) -> str:
    """The job's own folder: a rerun finds its checkpoint and its table there."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{zlib.crc32(source.encode()):08x}"


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stored table as a file stream (schema from the files, never inferred per
    batch). A single-file table streams its folder filtered to that file name."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fs.getFileStatus(jpath).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", jpath.getName()).parquet(jpath.getParent().toString())


def run_available_now(df: DataFrame, name: str, source: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over what ``source`` holds by now; return its whole table.

    The folder follows from ``name`` and ``source``, so a rerun resumes at the
    checkpoint and adds only what is new.
    """
    spark = df.sparkSession
    run = _run_dir(spark, name, source)
    if mode == "append":
        q = (df.writeStream.format("parquet").option("path", f"{run}/out")
             .option("checkpointLocation", f"{run}/ckpt").outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{run}/out")

    # complete-mode aggregates: each micro-batch replaces the table (idempotent)
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out")

    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", f"{run}/ckpt")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out")


def dedup_available_now(events: DataFrame, keys: list[str], name: str, source: str) -> DataFrame:
    """ST2: keep the first row of every key, over all runs.

    Each micro-batch is anti-joined with the keys that earlier ones have stored
    (J3), so nothing expires and no state grows in memory. A batch that is run
    again overwrites its own part and doesn't see it.
    """
    spark = events.sparkSession
    run = _run_dir(spark, name, source)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(keys)
        if batch_id:
            done = spark.read.schema(f"{batch.select(*keys)._jdf.schema().toDDL()}, batch BIGINT").parquet(f"{run}/out")
            done = done.where(F.col("batch") < batch_id).select(*[F.col(k).alias(f"_done_{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in keys]
            on = same[0]
            for c in same[1:]:
                on = on & c
            new = new.join(done, on, "left_anti")
        new.write.mode("overwrite").parquet(f"{run}/out/batch={batch_id}")

    q = (events.writeStream.foreachBatch(write).option("checkpointLocation", f"{run}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out").drop("batch")


def delta_pair_join(left: DataFrame, right: DataFrame, lkey: str, rkey: str, name: str, source: str) -> DataFrame:
    """ST3: two streams joined on their keys, over all runs, without a state store.

    Both sides arrive as one stream. Each batch stores its new rows of both sides, then joins the
    new left rows with the whole right table and the older left rows with the new right ones: every
    pair comes out in the batch of its later side, exactly once, and nothing ever expires. A batch that is run
    again overwrites its own parts of all three tables and reads only older parts and its own, so it gives the same rows.
    Column names of the two sides must differ; rows with a null key are stored but join with nothing.
    """
    spark = left.sparkSession
    run = _run_dir(spark, name, source)
    schemas = {"left": left.schema, "right": right.schema}
    sides = [left.select(F.struct(*left.columns).alias("left"), F.lit(None).cast(right.schema).alias("right")),
             right.select(F.lit(None).cast(left.schema).alias("left"), F.struct(*right.columns).alias("right"))]

    def stored(side: str, upto: int) -> DataFrame:
        """A side's rows of the batches up to this one, with their batch."""
        return spark.read.schema(f"{spark.createDataFrame([], schemas[side])._jdf.schema().toDDL()}, batch BIGINT").parquet(f"{run}/{side}").where(F.col("batch") <= upto)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for side in schemas:
                batch.where(F.col(side).isNotNull()).select(f"{side}.*").write.mode("overwrite").parquet(f"{run}/{side}/batch={batch_id}")
        finally:
            batch.unpersist()
        new = F.col("batch") == batch_id
        lefts, rights = stored("left", batch_id), stored("right", batch_id)
        on = F.col(lkey) == F.col(rkey)
        pairs = lefts.where(new).drop("batch").join(rights.drop("batch"), on)
        pairs = pairs.unionByName(lefts.where(~new).drop("batch").join(rights.where(new).drop("batch"), on))
        pairs.write.mode("overwrite").parquet(f"{run}/out/batch={batch_id}")

    q = (sides[0].unionByName(sides[1]).writeStream.foreachBatch(write).option("checkpointLocation", f"{run}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out").drop("batch")


def event_time(df: DataFrame, time_col: str, name: str) -> DataFrame:
    """Watermarks need TIMESTAMP; stored times may be TIMESTAMP_NTZ (read as UTC)."""
    return df.withColumn(name, F.col(time_col).cast("timestamp"))


def dedup_stream(events: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeated keys within the watermark delay only (bounded state; ``dedup_available_now`` keeps all keys)."""
    ev = event_time(events, time_col, "_event_time")
    return ev.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(keys).drop("_event_time")


def pair_join_stream(left: DataFrame, right: DataFrame, lkey: str, rkey: str, ltime: str, rtime: str,
                     bound: str | None = None, delay: str = "30 days") -> DataFrame:
    """ST3: stream-stream inner join in one plan: a pair is emitted once both sides have arrived.

    By default nothing expires, so both sides stay in the state store (``delta_pair_join`` keeps none). With a ``bound`` (documented loss: pairs farther
    apart in time are never emitted) watermarks let join state go (H14).
    """
    if bound is None:
        return left.join(right, F.col(lkey) == F.col(rkey), "inner")
    lw = event_time(left, ltime, "_lt").withWatermark("_lt", delay)
    rw = event_time(right, rtime, "_rt").withWatermark("_rt", delay)
    cond = ((F.col(lkey) == F.col(rkey)) & (F.col("_rt") >= F.col("_lt"))
            & (F.col("_rt") <= F.col("_lt") + F.expr(f"INTERVAL {bound}")))
    return lw.join(rw, cond, "inner").drop("_lt", "_rt")


def running_counts(results: DataFrame, key: str = "our_result") -> DataFrame:
    """ST4: running count per verdict (complete mode)."""
    return results.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
