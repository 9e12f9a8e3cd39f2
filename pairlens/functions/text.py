"""Small text helpers shared by the expression builders.

They bridge the places where Spark and Python text semantics differ (H7, H8, H5):
Spark ``trim`` only removes spaces, ``split`` keeps empty ends, and ``cast`` accepts
forms Python's ``float`` refuses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character Python's str.isspace() accepts (derived, not listed by hand).
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def py_strip(c) -> Column:
    """``str.strip()``: remove leading and trailing whitespace, exactly the
    characters Python treats as whitespace (native ``btrim``, no regex)."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def strip_chars(c, chars: str) -> Column:
    """``str.strip(chars)`` for a set of literal ASCII characters."""
    import re
    cls = "[" + re.escape(chars) + "]"
    return F.regexp_replace(col(c), f"^{cls}+|{cls}+$", "")


def py_split(c) -> Column:
    """``str.split()``: whitespace tokens without empty strings."""
    return F.array_remove(F.split(py_strip(c), "(?U)\\s+"), "")


def collapse_ws(c) -> Column:
    """``" ".join(s.split())``."""
    return F.array_join(py_split(c), " ")


def contains_any_re(c, terms: list[str]) -> Column:
    """Substring test for short texts as ONE regex alternation of quoted literals
    (one node instead of an OR chain; lambdas evaluate node by node)."""
    pattern = "|".join("\\Q" + t + "\\E" for t in terms)
    return col(c).rlike(pattern)


def contains_any(c, terms: list[str]) -> Column:
    """True when ``c`` contains one of the literal terms (substring test)."""
    c = col(c)
    out = None
    for t in terms:
        e = F.instr(c, t) > 0
        out = e if out is None else (out | e)
    return out if out is not None else F.lit(False)


# Python float() syntax for plain decimals and exponents (underscores and
# non-ASCII digits are documented differences).
_FLOAT_RE = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$|^(?i)[+-]?(inf|infinity|nan)$"


def py_float(c) -> Column:
    """``float(s)`` or NULL where Python would raise."""
    s = py_strip(c)
    return F.when(s.rlike(_FLOAT_RE), s.try_cast("double"))


def digits_dots_number(c) -> Column:
    """``float(re.sub(r"[^\\d.]", "", s))`` or NULL (the unit parser's number)."""
    s = F.regexp_replace(col(c), "[^0-9.]", "")
    return F.when(s.rlike("^([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), s.try_cast("double"))


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it in ``fn`` (inside lambdas Catalyst does not
    share common subexpressions, so this keeps costly parts single)."""
    return F.transform(F.array(value), fn).getItem(0)


def memo_column(build):
    """Memoise a Column factory per Spark application.

    The matching expressions have thousands of nodes and each node is a py4j
    call to build; Columns are unresolved expression trees and can be reused by
    any DataFrame of the same application, so each one is built once.
    """
    import functools

    cache: dict = {}

    @functools.wraps(build)
    def get(*args):
        from pyspark import SparkContext
        sc = SparkContext._active_spark_context
        key = (sc.applicationId if sc is not None else None, args)
        if key not in cache:
            cache[key] = build(*args)
        return cache[key]
    return get


def exact_round(x: Column, places: int) -> Column:
    """Round a non-negative double by its exact binary value, ties to even.

    ``bround`` rounds the shortest decimal form, which differs where that form looks
    like a tie. Here ``x`` is split into two halves whose products with ``2 * 10^places``
    are exact, so the comparison with the midpoint is exact too.
    """
    p = float(10 ** places)
    k = F.floor(x * p).cast("double")
    big = x * 134217729.0
    hi = big - (big - x)
    over = (hi * (2 * p) - (2 * k + 1)) + (x - hi) * (2 * p)
    up = (over > 0) | ((over == 0) & (k % 2 == 1))
    return F.when(x < 1e11, (k + F.when(up, 1.0).otherwise(0.0)) / p).otherwise(F.bround(x, places))
