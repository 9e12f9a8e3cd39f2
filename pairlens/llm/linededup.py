"""Repeated passages by winnowing over line hashes (native DataFrame functions only).

A text is a sequence of content lines (lines with a word). From every line a
gram runs forward over whole lines until it holds ``noise_words`` words. A window
is the gram starts whose grams lie within ``guarantee_words`` words of its first
line; the least gram hash of each window is a fingerprint. So no match under
``noise_words`` words is ever reported, and of every repeated run of whole lines
with ``guarantee_words`` words or more, some fingerprint is.

A fingerprint is extended both ways, line by line, as far as any earlier occurrence
(by doc_id, nulls last, then position) agrees, and the lines that agree go. To
that end the occurrences of a fingerprint are grouped by their context: by the hash
of the gram with its next 0, 1, 2 ... lines, and of the gram with its last 1, 2 ...
lines. Whatever isn't the first of its group has occurred before. So each extension
meets the earlier place that goes farthest with it, and a passage that a third of
all documents share costs some rows per occurrence, not one per pair.

Contexts end where a line begins more than ``guarantee_words - noise_words`` words
before the gram, or ``guarantee_words - 1`` or more behind its end, and nothing is
lost by that. Take any line of a repeated run. If ``guarantee_words`` words
of the run begin with it, its window has a fingerprint within the run that begins at
most ``guarantee_words - noise_words`` words later, whose backward context reaches
the line. Else fewer words are left, and the line is reached forward by the
fingerprint of the last window within the run, whatever the length of its lines. A
run under ``guarantee_words`` words is shorter than both reaches.

Defined results: a null text stays null and an empty one empty; lines without a
word are never counted, matched or deleted; rows alike in doc_id and text are one
document and get the same decision; ties of hash go to the earlier line; an empty
table gives an empty result. The lines of one document pass through one task, sorted
and windowed there with spilling; no array holds more lines than a context. Extra
columns are carried; the names of the added columns are replaced where they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD_RE, bound

NOISE_WORDS = 25
GUARANTEE_WORDS = 50


def _content_lines(docs: DataFrame) -> DataFrame:
    """One row per content line of each distinct document, dealt by document."""
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda x, i: F.struct(i.alias("pos"), F.md5(x).alias("m"), F.regexp_count(x, F.lit(WORD_RE)).alias("n")))
    slim = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h"),
                       F.filter(lines, lambda x: x["n"] > 0).alias("lines"))
    one = slim.groupBy("__id", "__h").agg(F.first("lines").alias("lines"))
    return (one.select("__id", "__h", F.posexplode("lines").alias("idx", "l"))
            .select("__id", "__h", "idx", "l.pos", "l.m", F.col("l.n").cast("bigint").alias("n")))


def _measured_lines(docs: DataFrame) -> DataFrame:
    """Content lines with the words before them (``cum``) and in their document (``total``)."""
    doc = Window.partitionBy("__id", "__h")
    before = F.sum("n").over(doc.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return _content_lines(docs).withColumns({"cum": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(doc)})


def fingerprints(docs: DataFrame, noise_words: int = NOISE_WORDS, guarantee_words: int = GUARANTEE_WORDS) -> DataFrame:
    """The selected grams: document, line index, gram hash, first and last raw line number, lines before and after."""
    doc = Window.partitionBy("__id", "__h")
    by_word = doc.orderBy("cum")
    ahead = by_word.rangeBetween(0, noise_words - 1)
    span = guarantee_words - noise_words
    line = F.struct(F.unhex("m").alias("m"), "pos")
    d = _measured_lines(docs).withColumns({
        "gram": F.unhex(F.md5(F.concat_ws(",", F.collect_list("m").over(ahead)))),
        "last": F.max("pos").over(ahead),
        "before": F.collect_list(line).over(by_word.rangeBetween(-span, -1)),
        "end": F.col("cum") + F.col("n"),
        "next": F.lead(line).over(by_word),
    })
    # a line begins where the one before it ends: the lines that begin soon after this one's end
    d = d.withColumn("after", F.collect_list("next").over(doc.orderBy("end").rangeBetween(0, guarantee_words - 2)))
    least = F.min(F.struct("gram", "idx")).over(by_word.rangeBetween(0, span))
    d = d.withColumns({
        "after": F.last("after").over(ahead),  # behind the gram's last line
        "pick": F.when(F.col("cum") + guarantee_words <= F.col("total"), least["idx"]),
    })
    # a line that any window picked is picked by one that begins at most ``span`` words before it
    picks = F.collect_list("pick").over(by_word.rangeBetween(-span, 0))
    d = d.withColumn("selected", F.array_contains(picks, F.col("idx")))
    return d.where("selected").select("__id", "__h", "idx", "gram", "pos", "last", "before", "after")


def contexts(fp: DataFrame) -> DataFrame:
    """Each fingerprint with its next 0, 1 ... and its last 1 ... lines: document, index, key, raw lines ``a`` to ``b``."""
    def key(side: str, lines: Column) -> Column:
        return F.unhex(F.md5(F.concat(F.lit(side).cast("binary"), F.col("gram"), F.array_join(
            F.transform(lines, lambda x: F.hex(x["m"])), "").cast("binary")))).alias("key")
    forward = F.transform(F.sequence(F.lit(0), F.size("after")), lambda r: F.struct(
        key("R", F.slice("after", F.lit(1), r)), F.col("pos").alias("a"),
        F.when(r == 0, F.col("last")).otherwise(F.get("after", r - 1)["pos"]).alias("b")))
    behind = F.transform("before", lambda x, i: F.struct(
        key("L", F.slice("before", i + 1, F.size("before"))), x["pos"].alias("a"), F.col("last").alias("b")))
    return fp.select("__id", "__h", "idx", F.explode(F.concat(forward, behind)).alias("c")).select("__id", "__h", "idx", "c.*")


def repeated_runs(docs: DataFrame, noise_words: int = NOISE_WORDS, guarantee_words: int = GUARANTEE_WORDS) -> DataFrame:
    """Extended matches: document, first and last raw line number of the later run, where it occurred first."""
    c = contexts(fingerprints(docs, noise_words, guarantee_words))
    first = c.groupBy("key").agg(
        F.min(F.struct(F.col("__id").isNull().alias("last"), F.col("__id").alias("id"), F.col("__h").alias("h"),
                       F.col("idx"))).alias("f"), F.count("*").alias("times")).where("times > 1").drop("times")
    same = F.col("__id").eqNullSafe(F.col("f.id")) & (F.col("__h") == F.col("f.h")) & (F.col("idx") == F.col("f.idx"))
    return c.join(first, "key").where(~same).select("__id", "__h", "a", "b", F.col("f.id").alias("first_id"),
                                                    F.col("f.idx").alias("first_line"))


def _merged(parts: DataFrame) -> DataFrame:
    """The lines from ``a`` to ``b``, parts that overlap made disjoint."""
    before = Window.partitionBy("__id", "__h").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    d = parts.withColumn("a", F.greatest("a", F.max("b").over(before) + 1)).where(F.col("a") <= F.col("b"))
    return d.groupBy("__id", "__h").agg(F.flatten(F.collect_list(F.sequence("a", "b"))).alias("__gone"))


def dedup_lines(docs: DataFrame, noise_words: int = NOISE_WORDS, guarantee_words: int = GUARANTEE_WORDS) -> DataFrame:
    """The documents with later repeated runs deleted from ``text``; ``removed_lines`` counts them."""
    gone = _merged(repeated_runs(docs, noise_words, guarantee_words).select("__id", "__h", "a", "b"))
    d = docs.drop("removed_lines", "__h", "__id").withColumn("__h", F.xxhash64("text"))
    d = d.join(gone, d["doc_id"].eqNullSafe(gone["__id"]) & (d["__h"] == gone["__h"]), "left").drop("__id", "__h")
    none = F.col("__gone").isNull()
    d = bound(d, __l=F.when(none, F.array().cast("array<string>")).otherwise(F.split("text", "\n")))
    d = d.withColumn("__gone", F.filter("__gone", lambda i: F.get(F.col("__l"), i).rlike(WORD_RE)))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__l") - 1), "__gone")
    text = F.array_join(F.transform(keep, lambda i: F.get(F.col("__l"), i)), "\n")
    return d.withColumns({
        "text": F.when(none, F.col("text")).otherwise(text),
        "removed_lines": F.when(none, F.lit(0)).otherwise(F.size("__gone")).cast("bigint"),
    }).select(*[c for c in docs.columns if c != "removed_lines"], "removed_lines")


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    """Per document: lines removed, and length and digest of what is kept."""
    d = dedup_lines(docs)
    return d.select("doc_id", "removed_lines", F.length("text").cast("bigint").alias("kept_chars"),
                    F.sha2("text", 256).alias("text_sha256"))
