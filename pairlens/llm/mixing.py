"""Mixing sources to target weights by pivotal dependent rounding (native DataFrame functions only).

Sources, by code point and nulls last, take the weights in turn and share
``rate`` times all words; a source gets at most ``limit`` times its own words, and
the excess goes to the others by weight. A document of a source is then wanted
target / words times: the whole part is certain, the fraction is a copy
probability. Pivotal rounding pairs two fractions, moves mass (words) at random
until one is 0 or 1, and goes on with the other. The words of a source stay what
they were, but for its last document, which is drawn.

The pairing is a reduction tree. Documents fall into strata of source and size,
strata into hashed blocks of about ``block`` documents; each block is folded by
itself and leaves one unresolved document, which goes up to the next level. So a
source with a third of all rows is only many blocks, and each level is smaller
than the one before by the block size.

Random numbers are hashes of the documents and the seed: reruns agree. Documents
alike in id and size in one block are interchangeable.

Defined results: a null or empty text has size 0 and takes 0 words; a null source
is a source of its own, the last; a source without words gets target 0; repeated
rows are units of their own; an empty table gives an empty mix. Extra columns are
carried; the names of the added columns are replaced where they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import n_words, stored, unit_random

WEIGHTS = (5, 2, 1)
RATE = 1.5
LIMIT = 2.0
BLOCK = 64
SEED = 20240601


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, rate: float = RATE, limit: float = LIMIT) -> DataFrame:
    """Per source: number, words, target words. ``sizes`` has columns source and size.

    Everything after the first aggregate works on one row per source. A source is
    at its limit if, with the sources of a lower limit per weight at theirs, the
    rest still gives it that much; the first source below its limit sets the level.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("source_no", F.row_number().over(order))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") - 1) % len(weights))
    s = s.withColumns({"w": w, "most": F.lit(float(limit)) * F.col("source_size")})
    by_limit = Window.orderBy(F.col("most") / F.col("w"), "source_no")
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("mass", F.lit(float(rate)) * F.sum("source_size").over(whole))
    s = s.withColumn("share", (F.col("mass") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("full", F.col("most") <= F.col("share") * F.col("w"))
    s = s.withColumn("level", F.max(F.when(~F.col("full"), F.col("share"))).over(whole))
    s = s.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("level") * F.col("w")))
    return s.select("source", "source_no", "source_size", "target")


def _fold(items: Column) -> Column:
    """Pivotal rounding along an array of struct(size, key, p): array of struct(i, bit, p).

    Two fractions a and b of documents of s and t words exchange words, so that
    a * s + b * t stays: up, a grows until it is 1 or b is 0; down, a falls until it
    is 0 or b is 1. The odds of up and down keep both expectations. Every entry gets
    a bit but one, which keeps its remaining probability ``p``.
    """
    none = F.array().cast("array<struct<i:int,bit:int,p:double>>")
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("p"), F.lit(0).cast("bigint").alias("key"),
                     F.lit(1.0).alias("s"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a, b, s, t = acc["p"], x["p"], acc["s"], x["s"]
        most_up, most_down = b * t / s, (1 - b) * t / s
        up, down = F.least(1 - a, most_up), F.least(a, most_down)
        u = unit_random(F.lit(SEED), acc["key"], x["key"], x["i"])
        first, still = acc["i"] < 0, up + down <= 0
        rise = u * (up + down) < down
        a_ends = first | still | F.when(rise, 1 - a <= most_up).otherwise(a <= most_down)  # otherwise b ends
        b_now = F.when(first | still, b).otherwise(F.when(rise, b - up * s / t).otherwise(b + down * s / t))
        a_now = F.when(rise, a + up).otherwise(a - down)
        bit = F.when(still, F.round(a).cast("int")).when(a_ends == rise, 1).otherwise(0)
        settled = F.struct(F.when(a_ends, acc["i"]).otherwise(x["i"]).alias("i"), bit.cast("int").alias("bit"),
                           F.lit(None).cast("double").alias("p"))
        out = F.when(first, acc["out"]).otherwise(F.concat(acc["out"], F.array(settled)))
        rest = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(a_ends, b_now).otherwise(a_now)))
        return F.struct(F.when(a_ends, x["i"]).otherwise(acc["i"]).alias("i"), rest.alias("p"),
                        F.when(a_ends, x["key"]).otherwise(acc["key"]).alias("key"),
                        F.when(a_ends, x["s"]).otherwise(acc["s"]).alias("s"), out.alias("out"))

    def finish(acc: Column) -> Column:
        left = F.struct(acc["i"].alias("i"), F.lit(None).cast("int").alias("bit"), acc["p"].alias("p"))
        return F.sort_array(F.concat(acc["out"], F.array(left)))

    indexed = F.transform(items, lambda x, i: F.struct(
        i.alias("i"), x["key"].alias("key"), x["p"].alias("p"), F.greatest(x["size"], F.lit(1)).cast("double").alias("s")))
    return F.aggregate(indexed, start, step, finish)


def _level(items: DataFrame, by: list[str]) -> DataFrame:
    """Fold every block; one row per item with its ``bit``, or its ``p`` if it goes up."""
    blocks = items.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("size", "key", "p", "row"))).alias("xs"))
    done = F.explode(F.arrays_zip(F.col("xs").alias("x"), _fold(F.col("xs")).alias("r"))).alias("z")
    stratum = [c for c in ("source_no", "stratum") if c in by]
    d = blocks.select(*stratum, done)
    if "stratum" not in by:
        d = d.withColumn("stratum", F.lit(0).cast("bigint"))
    return d.select("source_no", "stratum", F.col("z.x.size").alias("size"), F.col("z.x.key").alias("key"),
                    F.col("z.x.row").alias("row"), F.col("z.r.bit").alias("bit"), F.col("z.r.p").alias("p"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, rate: float = RATE, limit: float = LIMIT,
        block: int = BLOCK, size: str | None = None) -> DataFrame:
    """The documents with size, source_size, target and ``copies`` (how often the mix takes each).

    ``size`` names a bigint column that already holds the sizes; otherwise they are
    counted from ``text``. Each row is moved once, into its block.
    """
    d = docs.withColumn("size", F.col(size) if size else n_words(F.col("text")))
    d = d.drop("source_size", "target", "copies")
    cols = d.columns
    stratum = F.floor(4 * F.log2(F.col("size") + 1)).cast("bigint")
    counts = stored(d.groupBy("source", stratum.alias("stratum")).agg(F.count("*").alias("n"), F.sum("size").alias("size")),
                    "mix-strata")
    plan = counts.select("source", "stratum", F.ceil(F.col("n") / block).alias("blocks")).join(
        targets(counts, weights, rate, limit).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = stored(plan.withColumnsRenamed({"source": "__s", "stratum": "__stratum"}), "mix-plan")  # one row per stratum
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    x = d.withColumn("__row", row).withColumn("__st", stratum)
    x = x.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__st") == F.col("__stratum")))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("size"), F.col("source"))
    x = x.select("source_no", F.col("__stratum").alias("stratum"), "size", key.alias("key"), "blocks",
                 (wanted - F.floor(wanted)).alias("p"),
                 F.struct(F.col("__row").alias("doc"), "source_size", "target", F.floor(wanted).cast("bigint").alias("whole"))
                 .alias("row"))
    most = plan.agg(F.max("blocks")).first()[0] or 0
    settled, level = [], 0
    by = ["source_no", "stratum", "blk"]
    while True:
        if "blk" in by:
            spread = F.pmod(F.xxhash64(F.lit(level), F.col("key"), F.col("size")), F.col("blocks"))
            x = x.withColumn("blk", spread)
        done = stored(_level(x, by), f"mix-level{level}")
        settled.append(done.where("bit IS NOT NULL").select("row", "bit"))
        x, level = done.where("bit IS NULL").drop("bit"), level + 1
        if by == ["source_no"]:
            # one document per source is left: a draw with what it still has
            u = unit_random(F.lit(SEED), F.col("key"), F.lit(level))
            settled.append(x.select("row", F.when(u < F.col("p"), 1).otherwise(0).alias("bit")))
            break
        most = -(-most // block)
        if "blk" in by and most > 1:
            size = plan.select(F.col("source_no").alias("n"), F.col("__stratum").alias("t"),
                               F.ceil(F.col("blocks") / float(block) ** level).alias("blocks"))
            x = x.join(size, (F.col("source_no") == F.col("n")) & (F.col("stratum") == F.col("t"))).drop("n", "t")
        else:
            by = ["source_no", "stratum"] if "blk" in by else ["source_no"]
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select(*[F.col(f"row.doc.`{c}`").alias(c) for c in cols], F.col("row.source_size").alias("source_size"),
                      F.col("row.target").alias("target"), (F.col("row.whole") + F.col("bit")).alias("copies"))


def replicated(mixed: DataFrame, cols: list[str]) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    return (mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
            .select(*cols))


def op7_mixing(docs: DataFrame) -> DataFrame:
    """Contract rows: sizes, targets and the words taken of every document."""
    slim = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    return mix(slim, size="size").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                            "source")
