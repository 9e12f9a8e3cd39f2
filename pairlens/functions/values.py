"""Value normalisation (S7-S15) as Catalyst expressions.

A normalised value is the tagged struct ``struct<kind, s, n>``:
  kind  'int' | 'float' | 'bool' | 'str'
  s     text form (JSON literal text for numbers and booleans, the text for 'str')
  n     numeric form (1.0/0.0 for booleans), NULL for 'str'
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from .keys import PACK_WORD_RE
from .text import col, contains_any, digits_dots_number, exact_round, let, py_float, py_strip

VALUE_TYPE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("s", T.StringType()),
    T.StructField("n", T.DoubleType()),
])


def make_value(kind: str, s: Column, n: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), s.cast("string").alias("s"),
                    (n if n is not None else F.lit(None)).cast("double").alias("n"))


def str_value(s: Column) -> Column:
    return make_value("str", s)


def float_value(x: Column) -> Column:
    return make_value("float", x.cast("string"), x)


def int_value(digits: Column) -> Column:
    """Integer from a digit string: text without leading zeros, number as double."""
    txt = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return make_value("int", txt, digits.try_cast("double"))


def bool_value(b: bool) -> Column:
    return make_value("bool", F.lit("true" if b else "false"), F.lit(1.0 if b else 0.0))


def _map(d: dict) -> Column:
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def unit_convert(val: Column, table: dict[str, float], also_remove: str | None = None, bind: bool = True) -> Column:
    """Convert ``val`` with the first unit (longest name first) whose removal
    leaves a number; ``round(num * factor, 4)``. NULL when no unit applies.

    Removing a name without digits and dots leaves the number's characters as they are,
    so all such units share one number and only the factor is chosen by name.
    """
    def convert(v: Column) -> Column:
        tries = []  # (number, [(unit, factor)]), in order
        for unit, factor in rules.units_longest_first(table):
            if not re.search("[0-9.]", unit + (also_remove or "")):
                if not tries or tries[-1][0] is not None:
                    tries.append((None, []))
                tries[-1][1].append((unit, factor))
            else:
                rest = F.replace(v, F.lit(unit), F.lit(""))
                if also_remove:
                    rest = F.replace(rest, F.lit(also_remove), F.lit(""))
                tries.append((digits_dots_number(rest), [(unit, factor)]))
        shared = digits_dots_number(v)

        def scaled(number, units):
            factor = F.coalesce(*[F.when(F.instr(v, u) > 0, F.lit(float(f))) for u, f in units])
            return factor * (shared if number is None else number)  # the number is read only where a unit occurs

        return F.coalesce(*[scaled(*t) for t in tries])

    low = F.lower(py_strip(val))
    if not bind:
        return exact_round(convert(low), 4)
    return let(let(low, convert), lambda x: exact_round(x, 4))


def normalize_size(v: Column) -> Column:
    clean = F.lower(py_strip(v))
    ordinal = F.try_element_at(_map(rules.SIZE_ORDINAL), clean)
    return F.when(ordinal.isNotNull(), int_value(ordinal.cast("string"))).otherwise(str_value(clean))


def normalize_color(v: Column) -> Column:
    clean = F.lower(py_strip(v))
    return str_value(F.coalesce(F.try_element_at(_map(rules.COLOR_ALIASES), clean), clean))


def normalize_pack_count(v: Column) -> Column:
    clean = F.lower(py_strip(v))
    digits = F.regexp_extract(clean, "([0-9]+)", 1)
    word = F.try_element_at(_map(rules.PACK_WORDS), clean)
    return (F.when(digits != "", int_value(digits))
            .when(word.isNotNull(), int_value(word.cast("string")))
            .otherwise(str_value(clean)))


def strip_noise(raw: Column) -> Column:
    """Stock badges, ``was $..`` tails and ``(n left)`` tails removed."""
    v = py_strip(raw)
    v = py_strip(F.regexp_replace(
        v, "(?iU)\\s*[-–]?\\s*(out of stock|in stock|unavailable|sold out)\\b.*", ""))
    v = py_strip(F.regexp_replace(v, "(?iU)\\s+was\\s+[\\$₹£€]\\S+.*$", ""))
    v = py_strip(F.regexp_replace(v, "(?iU)\\s*\\(?\\s*\\d+\\s*(items?|left|remaining)\\s*\\)?$", ""))
    return v


def norm_value(key, raw, fix_pack_count: bool = False, bind: bool = True) -> Column:
    """Normalise one attribute value by its (normalised) key.

    ``fix_pack_count``: in parity mode (default) a ``pack_count`` value stays
    text, because the whole-word guard never matches that key (D5); set True to
    apply the pack-count rule (S13) to it.
    """
    if not bind:  # lambda-free form (renders as a SQL function body)
        return _norm_value_bound(col(key), col(raw), strip_noise(col(raw)), fix_pack_count, bind=False)
    bound = F.struct(col(key).alias("k"), col(raw).alias("raw"), strip_noise(col(raw)).alias("v"))
    return let(bound, lambda b: _norm_value_bound(b["k"], b["raw"], b["v"], fix_pack_count))


def _norm_value_bound(key: Column, raw: Column, v: Column, fix_pack_count: bool = False,
                      bind: bool = True) -> Column:
    is_weight = F.instr(key, "weight") > 0
    is_volume = contains_any(key, ["volume", "capacity"])
    is_length = contains_any(key, ["length", "width", "height", "dimension"])
    number = F.coalesce(
        F.when(is_weight, unit_convert(v, rules.WEIGHT_TO_G, bind=bind)),
        F.when(is_volume, unit_convert(v, rules.VOLUME_TO_ML, also_remove="fl", bind=bind)),
        F.when(is_length, unit_convert(v, rules.LENGTH_TO_CM, bind=bind)),
        F.when(v.endswith("%"), py_float(F.regexp_replace(v, "%$", ""))))

    def number_or_text(n: Column) -> Column:
        return (F.when(n.isNotNull(), float_value(n))
                .when(F.lower(v).isin(rules.BOOL_TRUE), bool_value(True))
                .when(F.lower(v).isin(rules.BOOL_FALSE), bool_value(False))
                .otherwise(str_value(F.lower(py_strip(v)))))

    return (
        F.when(raw.isNull(), F.lit(None).cast(VALUE_TYPE))
        .when(v == "", str_value(py_strip(raw)))
        .when(contains_any(key, ["color", "colour", "shade", "tone"]), normalize_color(v))
        .when(key.isin("size", "clothing_size", "product_size"), normalize_size(v))
        .when(key.rlike(PACK_WORD_RE) | (F.lit(fix_pack_count) & (key == "pack_count")), normalize_pack_count(v))
        .otherwise(let(number, number_or_text) if bind else number_or_text(number))
    )


def value_json(v: Column) -> Column:
    """JSON literal text of a tagged value (strings quoted and escaped)."""
    return (F.when(v.isNull(), F.lit("null"))
            .when(v.kind == "str", F.regexp_replace(F.to_json(F.array(v.s)), "^\\[|\\]$", ""))
            .otherwise(v.s))
