"""Benchmark decontamination: a broadcast hash set of test n-grams against every token window.

Texts are lower-cased (A-Z) and cut into words. The windows of an item are its
``WINDOW`` consecutive words, or all of them where it has fewer. Distinct windows
are numbered and stored once, their items beside them. Every window of the
documents is hashed where the document is scanned and looked up in the broadcast
set; a hit counts only if the window's words equal the item's. Only hits, and one
marker per document, leave that task, joined into one row per document and task
before they are shuffled.

The broadcast set is bounded by ``BROADCAST_BYTES``: a larger benchmark is cut by
hash into as many parts as that takes, and the documents are scanned once a part.
How many parts there are is counted from the stored windows first. A part is bounded
because windows are distinct; one window in very many items is one row of it.

``scan`` gives one verdict a row; ``remove_documents`` and ``remove_spans`` apply it.

Defined results: a null or empty text has no words, hits nothing and is kept as it is;
an item without words has no window; an item without an id counts as the empty id;
items that repeat an id are one item with the windows of all; overlapping hits are one
span; rows of equal id and text have equal verdicts and each stays a row; an empty
table of items hits nothing, an empty table of documents gives an empty result. Extra
columns of any name are carried by the two removers. One document's hits and item ids
are gathered in one row, so they are bounded by its words and by the items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, stored

# What lies between two words of a lower-cased text, and a word of any text.
GAP_RE = r"[\x00-/:-`{-\x7F]+"
WORD_OR_GAP_RE = r"[^\x00-/:-@\[-`{-\x7F]+|[\x00-/:-@\[-`{-\x7F]+"
GAP_FIRST_RE = r"^[\x00-/:-@\[-`{-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW = 10
BROADCAST_BYTES = 64 << 20
_SPAN = "array<struct<`from`:int,`until`:int>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP_RE), "")


def item_windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(g, h, gram): the distinct windows with a number and a hash; (g, item): the items of each."""
    i = bound(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text")), w=words_of(F.col("text")))
    i = i.where(F.size("w") > 0).select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at"))
    pairs = stored(i.select("item", F.slice("w", F.col("at"), size).alias("gram")).distinct(), "item-windows")
    grams = pairs.select("gram").distinct().select(F.monotonically_increasing_id().alias("g"), F.xxhash64("gram").alias("h"), "gram")
    grams = stored(grams, "windows")
    return grams, stored(pairs.join(grams, "gram").select("g", "item"), "window-items")


def _row_key() -> list[Column]:
    """What tells texts apart: the id, and 128 bits of hash and the length of the text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id").alias("__id"), F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"), F.length(t).alias("n")).alias("__key")]


def _hits(docs: DataFrame, part: DataFrame, lengths: list[int]) -> DataFrame:
    """A row per window that is in ``part`` (broadcast), and one per document (g null): __id, __key, n_words, at, size, g."""
    d = bound(docs.select(*_row_key(), words_of(F.col("text")).alias("__words")), w=F.col("__words")).drop("__words")
    d = d.select("__id", "__key", "w", F.explode(F.sequence(F.lit(1), F.size("w") + 1)).alias("at"))  # one place past the end
    end = F.col("at") > F.size("w")
    if len(lengths) == 1:
        d = d.withColumn("size", F.lit(lengths[0]))
    else:
        d = d.withColumn("size", F.explode(F.when(end, F.array(F.lit(0))).otherwise(F.array(*[F.lit(n) for n in lengths]))))
    gram = F.slice("w", F.col("at"), F.col("size"))
    marker = part.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("g"), F.lit(0).cast("bigint").alias("h"),
                                               F.array().cast("array<string>").alias("gram"))
    d = d.withColumn("window", F.when(end, F.lit(0)).otherwise(F.xxhash64(gram)))
    table = F.broadcast(part.unionByName(marker))
    same = F.when(end, F.col("g").isNull()).otherwise(F.col("g").isNotNull() & (F.col("gram") == gram))
    return (d.join(table, (F.col("window") == F.col("h")) & same)
            .select("__id", "__key", F.size("w").cast("bigint").alias("n_words"), "at", F.size("gram").alias("size"), "g"))


def _spans(hits: Column) -> Column:
    """Sorted (at, size) hits merged into spans of word places [from, until)."""
    start = F.struct(F.array().cast(_SPAN).alias("done"), F.lit(0).alias("from"), F.lit(0).alias("until"))

    def step(s, x):
        until = x["at"] + x["size"]
        apart = x["at"] > s["until"]
        closed = F.when(apart & (s["until"] > 0), F.concat(s["done"], F.array(F.struct(s["from"].alias("from"), s["until"].alias("until")))))
        return F.struct(closed.otherwise(s["done"]).alias("done"), F.when(apart, x["at"]).otherwise(s["from"]).alias("from"),
                        F.when(apart, until).otherwise(F.greatest(s["until"], until)).alias("until"))

    def last(s):
        return F.when(s["until"] > 0, F.concat(s["done"], F.array(F.struct(s["from"].alias("from"), s["until"].alias("until"))))).otherwise(s["done"])
    return F.aggregate(hits, start, step, last)


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: __id, __key, n_words, n_hit, spans (word places from 1, end exclusive), items (sorted)."""
    grams, owners = item_windows(items, size)
    measured = grams.agg(F.sum(F.octet_length(F.array_join("gram", " ")) + 64 + 16 * F.size("gram")), F.sort_array(F.collect_set(F.size("gram")))).first()
    n_parts, lengths = max(1, -(-(measured[0] or 0) // broadcast_bytes)), measured[1] or [size]
    parts = [grams.where(F.pmod("h", F.lit(n_parts)) == p) if n_parts > 1 else grams for p in range(n_parts)]
    found = reduce(DataFrame.unionByName, [_hits(docs, p, lengths) for p in parts])
    key = ["__id", "__key"]
    d = found.groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.floor(F.sum(F.when(F.col("g").isNull(), 1)) / n_parts).cast("int").alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("g").isNotNull(), F.struct("at", "size")))).alias("hits"), F.collect_set("g").alias("grams"))
    d = stored(d, "document-hits")
    owned = d.select(*key, F.explode("grams").alias("g")).join(owners, "g").groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    clean = d.where(F.size("grams") == 0).withColumn("items", F.array().cast("array<string>"))
    hit = d.where(F.size("grams") > 0).alias("d").join(
        owned.select(F.col("__id").alias("i"), F.col("__key").alias("k"), "items"), F.col("__id").eqNullSafe(F.col("i")) & (F.col("__key") == F.col("k")))
    d = clean.unionByName(hit.drop("i", "k"))
    d = bound(d, spans=_spans(F.col("hits")))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["until"] - s["from"])
    return d.select(*key, "n_words", n_hit.alias("n_hit"), "spans", "items", "copies")


def _judged(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``docs`` in one column ``__row``, with the spans of each (null if it has none)."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("__text"), *_row_key())
    v = verdicts.where(F.size("spans") > 0).select(F.col("__id").alias("i"), F.col("__key").alias("k"), "spans")
    return d.join(v, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__key") == F.col("k")), "left")


def remove_documents(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents that hold no window of an item."""
    return _judged(docs, verdicts).where(F.col("spans").isNull()).select("__row.*")


def remove_spans(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents without the words of their hits and what lies between those; the rest of the text is as it was."""
    d = bound(_judged(docs, verdicts), tokens=F.when(F.col("spans").isNotNull(), F.regexp_extract_all("__text", F.lit(WORD_OR_GAP_RE), F.lit(0))))
    first = F.when(F.get("tokens", F.lit(0)).rlike(GAP_FIRST_RE), 1).otherwise(0)
    d = bound(d, shift=first)
    # word w (from 1) is token 2w - 1 + shift (from 1); a kept part lies between the last word of a span and the first of the next
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: 2 * (s["until"] - 1) - 1 + F.col("shift")))
    starts = F.concat(F.transform("spans", lambda s: 2 * s["from"] - 1 + F.col("shift")), F.array(F.size("tokens") + 1))
    kept = F.zip_with(ends, starts, lambda e, s: F.array_join(F.slice("tokens", e + 1, F.greatest(s - e - 1, F.lit(0))), ""))
    text = F.when(F.col("spans").isNull(), F.col("__text")).otherwise(F.array_join(kept, ""))
    return d.select(text.alias("__new"), "__row").select(*[F.col("__new").alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c)
                                                            for c in docs.columns])


def op12_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contract rows."""
    d = scan(docs, items)
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return d.select(F.col("__id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
