"""Skew-safe "next row in group" (the pairing step of the catalog fixture).

``lead(x) over (partition by g order by o)`` sends a whole group to one task;
a group holding a third of the rows would then be a third of the job in one
task. Here the order key is cut into blocks of ``block_size`` consecutive values:

1. rows are hash-partitioned on ``(g, block)`` — one shuffle; a block holds at
   most ``block_size`` distinct order values, so every window partition is
   bounded and a hot group spreads over many tasks. Optional per-row work
   (``per_row``) runs right after this shuffle, in parallel, once per row;
2. ``lead`` inside ``(g, block)`` reuses that partitioning (no second shuffle);
3. the result is checkpointed to the cluster's checkpoint folder: lineage is
   cut (an executor loss does not redo the extraction) and the two consumers
   below read it once each;
4. the last row of each block takes the first row of the next non-empty block
   of its group: one row per block, ``lead`` over blocks within the group
   (``rows / block_size`` rows per group), joined back on ``(g, block)``.

The result equals the plain window for unique order keys.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def with_next_in_group(df: DataFrame, group_cols: list[str], order_col: str, carry: list[str],
                       block_size: int = 1 << 16, prefix: str = "next_",
                       per_row: Callable[[DataFrame], DataFrame] | None = None,
                       checkpoint: bool = True) -> DataFrame:
    """Add ``prefix + c`` for every ``c`` in ``carry`` from the next row of the
    group in ``order_col`` order (NULL for the group's last row)."""
    blk = "_blk"
    d = df.withColumn(blk, F.floor(F.col(order_col) / F.lit(block_size)))
    # explicit count: the per-row matching work is CPU-bound, so partitions are
    # sized by rows (shuffle.partitions), not merged by bytes as AQE would do
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(n_parts, *[F.col(c) for c in group_cols], F.col(blk))
    if per_row is not None:
        d = per_row(d)
    w_in = Window.partitionBy(*group_cols, blk).orderBy(order_col)
    for c in carry:
        d = d.withColumn(prefix + c, F.lead(c).over(w_in))
    d = (d.withColumn("_is_last", F.lead(F.lit(1)).over(w_in).isNull())
         .withColumn("_is_first", F.lag(F.lit(1)).over(w_in).isNull()))
    if checkpoint:
        ensure_checkpoint_dir(d.sparkSession)
        d = d.checkpoint(eager=True)

    firsts = d.where("_is_first").select(*group_cols, blk, F.struct(*[F.col(c) for c in carry]).alias("_first"))
    w_blk = Window.partitionBy(*group_cols).orderBy(blk)
    bridge = firsts.select(*group_cols, blk, F.lead("_first").over(w_blk).alias("_next_first"))

    lasts = d.where("_is_last").join(bridge, [*group_cols, blk], "left")
    for c in carry:
        lasts = lasts.withColumn(prefix + c, F.col("_next_first")[c])
    lasts = lasts.drop("_next_first")
    inner = d.where(~F.col("_is_last"))
    return inner.unionByName(lasts).drop(blk, "_is_last", "_is_first")
