"""Fill-in-middle: texts are cut at two unit boundaries and their parts put in another order.

A text is a sequence of units (a run of ASCII letters, or any other single
character). One full match of ``(unit)*`` by the regex library, which keeps every
repetition of a group, gives all unit ends at once: their number is n, and the two
cuts are entries of that list. The match is atomic, so it keeps no places to go
back to. Only the text and the two random numbers go to Python, only n and the two
offsets come back; the parts are cut and put together by Spark.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` <S>suffix<P>prefix<M>middle,
``plain`` the text itself. The random numbers come from the sha256 of a seed and the
row's id, so reruns and other partitions give the same output. A marker can't arise
at a seam, since its first character occurs nowhere else in it (checked when the
markers are made), so output and form give the text back (``restored``).

Memory: one task holds one Arrow batch and the unit ends of one text at a time, about
120 bytes per unit of that text.

Defined results: a null or empty text, and one that holds a marker, is plain, with
null part lengths; a null id counts as empty; rows of equal id and text have equal
outputs; every row of the table is one row of the result; an empty table gives an
empty result. Columns n, form, prefix_chars, middle_chars and output replace columns
of these names; all others are carried as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound

# Fixed value: a unit.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
SEED = 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or not all(marks) or any(m[0] in other[1:] for m in marks for other in marks) \
                or any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("markers must differ, none may begin another, and their first characters occur nowhere else in one")


MARKERS = Markers()


@lru_cache(maxsize=1)
def _units():
    import regex
    return regex.compile(f"(?>({UNIT})*)")


def unit_ends(text: str) -> list[int]:
    """The end offset of every unit of a text, from one match."""
    return _units().fullmatch(text).ends(1)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")]))
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Number of units, and the code point offsets of the two cuts in order."""
    out: list[list[int]] = [[], [], []]
    for t, a, b in zip(text, h1, h2):
        ends = unit_ends(t.as_py())
        n = len(ends)
        a, b = a.as_py() % (n + 1), b.as_py() % (n + 1)
        for col, at in zip(out[1:], (min(a, b), max(a, b))):
            col.append(ends[at - 1] if at else 0)
        out[0].append(n)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in out], ["n", "first", "second"])


def random_words(row_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 for a row, from the hex sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, row_id: str = "doc_id", text: str = "text", seed: int = SEED,
                   plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, markers: Markers = MARKERS) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output."""
    m = markers
    named = {"n", "form", "prefix_chars", "middle_chars", "output"}
    carried = [c for c in docs.columns if c not in named]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("__row"),
                    F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"), *[h.alias(f"__h{i}") for i, h in
                                                                             enumerate(random_words(F.col(f"`{row_id}`"), seed), 1)])
    d = d.withColumn("__cut", _cuts("__t", "__h1", "__h2"))
    held = F.contains("__t", F.lit(m.prefix)) | F.contains("__t", F.lit(m.suffix)) | F.contains("__t", F.lit(m.middle))
    form = (F.when((F.col("__t") == "") | held | (F.col("__h3") % 100 >= 100 - plain_percent), "plain")
            .when(F.col("__h4") % 100 < spm_percent, "spm").otherwise("psm"))
    d = bound(d, __form=form)
    t, a, b, cut = F.col("__t"), F.col("__cut.first"), F.col("__cut.second"), F.col("__form") != "plain"
    prefix, middle = F.substring(t, F.lit(1), a.cast("int")), F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))
    suffix = F.substring(t, (b + 1).cast("int"), F.length(t))
    p, s, mid = [F.concat(F.lit(x), y) for x, y in ((m.prefix, prefix), (m.suffix, suffix), (m.middle, middle))]
    output = F.when(F.col("__form") == "psm", F.concat(p, s, mid)).when(F.col("__form") == "spm", F.concat(s, p, mid)).otherwise(t)
    return d.select("__row.*", F.col("__cut.n").alias("n"), F.col("__form").alias("form"), F.when(cut, a).alias("prefix_chars"),
                    F.when(cut, b - a).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, markers: Markers = MARKERS) -> Column:
    """The text that an output of a form was made from."""
    def after(whole, mark):
        return F.substring(whole, F.instr(whole, mark) + len(mark), F.length(whole))

    def text(first, second):
        """Parts of an output whose first marker is ``first``: the part before ``second``, between it and the middle, the middle."""
        body = after(output, first)
        rest = after(body, second)
        return F.substring_index(body, second, 1), F.substring_index(rest, markers.middle, 1), after(rest, markers.middle)
    prefix, suffix, middle = text(markers.prefix, markers.suffix)
    suffix2, prefix2, middle2 = text(markers.suffix, markers.prefix)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2))
            .otherwise(output))


def op11_fim(docs: DataFrame) -> DataFrame:
    """Contract rows: digests of the output and of the text read back from it."""
    d = bound(fill_in_middle(docs.select("doc_id", "text")).drop("text"), __out=F.col("output"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("__out", 256).alias("output_sha256"),
                    F.sha2(restored(F.col("__out"), F.col("form")), 256).alias("restored_sha256"))
