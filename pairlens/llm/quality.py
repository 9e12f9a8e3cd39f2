"""Quality rules as a bitmask ledger (native DataFrame functions only).

Every rule is evaluated once per document. The ledger stores the measurements
and one integer whose bit r says that rule r failed. Policies are versioned sets
of rules; a verdict is one bitwise AND, and an ablation (how many documents
would come back if a rule were dropped) is a count over the few distinct bit
patterns, so neither reads a text again.

Defined results: a null or empty text has no words, zero in every measurement,
and fails ``few_words``. Repeated rows are judged alike, each by itself. An empty
table gives an empty ledger. Extra columns are carried through; columns whose
names clash with the ledger's own are replaced by the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, bound, word_array

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A named rule; ``fails`` is a SQL condition over the measurements."""
    bit: int
    name: str
    fails: str


# The bit of a rule never changes, so stored ledgers stay readable.
RULES = [
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "4 * n_symbols > n_words AND n_symbols > 2 * n_lines"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
]

# Versioned policies: the rules each one applies. The base policy is the contract's.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "duplicate_lines", "short_words", "long_words"],
    "v2": ["few_words", "repeated_words", "many_symbols", "duplicate_lines", "short_words", "long_words"],
}
PRODUCTION = "v2"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every whole text, all inside its own row.

    ``n_repeat_words``: the hashes of the 3-word windows are sorted with their
    positions; equal neighbours are repeated windows, and the words they cover
    are the gaps between their start positions, three at most each.
    """
    d = docs.drop(*MEASURES)
    d = bound(d, __w=word_array(F.col(text)))
    d = d.withColumns({
        "n_words": F.size("__w").cast("bigint"),
        "word_chars": F.length(F.array_join("__w", "")).cast("bigint"),
        "n_symbols": F.coalesce(F.regexp_count(F.col(text), F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("bigint"),
    })
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(WORD_RE))
    d = bound(d, __lines=lines)
    d = d.withColumns({
        "n_lines": F.size("__lines").cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
    }).drop("__lines")
    w, n = F.col("__w"), F.size("__w")
    grams = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
                        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    d = bound(d, __g=grams).drop("__w")
    d = bound(d, __s=F.sort_array("__g"))
    twice = F.zip_with("__s", F.slice("__s", 2, F.greatest(F.size("__s"), F.lit(1))), lambda a, b: F.when(a == b, a))
    # most texts repeat no window; the positions are sorted only where one is
    d = d.withColumn("__g", F.when(F.size(F.array_compact(twice)) > 0, F.col("__g")).otherwise(
        F.array().cast("array<bigint>"))).drop("__s")
    d = bound(d, __s=F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).drop("__g")
    s = F.col("__s")
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    repeated = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
    d = bound(d, __p=F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("__s")
    p = F.col("__p")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", covered.cast("bigint")).drop("__p")


def mask(names: list[str]) -> int:
    """The bits of the named rules."""
    bits = {r.name: r.bit for r in RULES}
    return reduce(lambda a, x: a | 1 << bits[x], names, 0)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their measurements and ``fail_bits`` (bigint)."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in RULES]
    return measure(docs, text).withColumn("fail_bits", reduce(Column.bitwiseOR, bits))


def failed(policy: str, bits: str = "fail_bits") -> Column:
    """Whether a ledger row fails a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint")) != 0


def ablations(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents failing it, failing nothing else, and kept without it.

    The ledger is first counted by bit pattern (at most 2^rules rows, combined on
    the map side); the rest works on those counts.
    """
    m = mask(POLICIES[policy])
    counts = (book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("bigint")).alias("bits"))
              .agg(F.count("*").alias("n")))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit"))
                                for r in RULES if r.name in POLICIES[policy]])).alias("r")
    return (counts.select("bits", "n", rules)
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
                 F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0))
                 .alias("n_kept_without")))


def op4_quality_rules(docs: DataFrame) -> DataFrame:
    """Contract rows: measurements, the base verdict and the production verdict."""
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed("base").alias("base_failed"), (~failed(PRODUCTION)).alias("kept"), "fail_bits")
