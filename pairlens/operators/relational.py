"""Relational helpers of the jobs (J2-J4, J6, AG6, AG7, SO1).

All are plain joins and aggregates; Spark picks broadcast or sort-merge from
runtime sizes (AQE), and the last-wins dedup is an aggregate with map-side
partial aggregation, so a hot key never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """One row per key: the row with the greatest ``order_cols`` (AG6).

    ``max_by`` over a struct is a partial aggregate, unlike ``row_number`` over
    a window, which would put a hot key's rows in one task.
    """
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order_cols]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def first_by_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order_cols]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def winner_by_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The rows with the greatest ``order_cols`` of each key (SO1: put the rank of the source first).

    Only keys and order columns are aggregated, partially on the map side; the rows are
    then picked by a join on them, so a wide payload is never sorted or buffered. Rows equal in
    keys and order columns are all kept: make the order columns unique for one row per key.
    NULL keys are left out, as are rows with a NULL order column (they never win).
    """
    best = df.groupBy(*keys).agg(F.max(F.struct(*order_cols)).alias("_best")).select(*keys, "_best.*")
    return df.join(best, [*keys, *order_cols], "left_semi")


def union_by_precedence(sources: list[DataFrame], keys: list[str], order_cols: list[str]) -> DataFrame:
    """Union of sources of one schema where the later source wins a key, and ``order_cols`` decide within it (SO1)."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    return winner_by_key(every, keys, ["_rank", *order_cols]).drop("_rank")


def done_keys(done: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct finished keys; rows with a NULL key part are ignored (AG7)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return done.where(cond).select(*keys).distinct()


def skip_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not finished yet: left-anti join on the (composite) key."""
    return work.join(done_keys(done, keys), keys, "left_anti")


def in_scope(df: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in scope: left-semi join."""
    return df.join(scope.select(*keys), keys, "left_semi")


def attach_meta(df: DataFrame, meta: DataFrame, keys: list[str], defaults: dict[str, str]) -> DataFrame:
    """Left join of meta columns, blank defaults for missing rows."""
    out = df.join(meta.select(*keys, *defaults), keys, "left")
    for c, d in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(d)))
    return out
