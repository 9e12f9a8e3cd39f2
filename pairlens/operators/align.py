"""Greedy one-to-one fuzzy key alignment (AL1 / J5 / SL4), in-row.

Left keys are taken in order; each takes the best-scoring right key not yet
used (first one on ties), kept only when the score reaches the threshold; a
rejected best stays free. A join + rank would give the per-key optimum instead,
which is not the same thing (H3), so this is an ``aggregate`` over the left keys
with the used set in the accumulator.

Scores are computed once per (left, right) key pair. A pair whose length bound
``200 * min(len) / (len1 + len2)`` is already below the threshold can never be
chosen, so its LCS is skipped (exact pruning).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from ..functions import indel_ratio
from ..functions.text import col, let


def key_score(k1: Column, k2: Column, threshold: float) -> Column:
    """Indel ratio, or -1 when it provably cannot reach ``threshold``.

    Bounds (both exact upper bounds of the LCS): the shorter length, and the
    number of characters of each key that occur anywhere in the other.
    """
    l1, l2 = F.length(k1), F.length(k2)
    bound = F.lit(200.0) * F.least(l1, l2) / (l1 + l2)

    def shared(a, b):  # translate with nothing to put in deletes the characters that the other key has
        return F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))

    common = F.least(shared(k1, k2), shared(k2, k1))
    return (F.when(k1 == k2, F.lit(100.0))
            .when(bound < threshold, F.lit(-1.0))
            .when(F.lit(200.0) * common / (l1 + l2) < threshold, F.lit(-1.0))
            .otherwise(indel_ratio(k1, k2)))


def align_keys(keys1, keys2, threshold: float = rules.KEY_ALIGN_THRESHOLD) -> Column:
    """``array<struct<i int, j int>>`` of aligned 0-based positions, in left order."""
    keys1, keys2 = col(keys1), col(keys2)
    scores = F.transform(keys1, lambda k1: F.transform(keys2, lambda k2: key_score(k1, k2, threshold)))
    pair_t = "array<struct<i:int,j:int>>"
    init = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(pair_t).alias("pairs"))

    def body(sc):
        def take(st, row_i):
            row, i = row_i["row"], row_i["i"]
            cands = F.transform(row, lambda s, j: F.struct(
                F.when(F.array_contains(st["used"], j), F.lit(-1.0)).otherwise(s).alias("s"),
                (-j).alias("nj")))
            return let(F.array_max(cands), lambda best: F.when(
                best.isNotNull() & (best["s"] >= threshold) & (best["s"] > 0),
                F.struct(F.array_append(st["used"], -best["nj"]).alias("used"),
                         F.array_append(st["pairs"], F.struct(i.alias("i"), (-best["nj"]).alias("j"))).alias("pairs")),
            ).otherwise(st))

        rows = F.transform(sc, lambda r, i: F.struct(r.alias("row"), i.alias("i")))
        return F.aggregate(rows, init, take)["pairs"]

    return let(scores, body)
