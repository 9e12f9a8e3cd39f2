"""Attribute-key normalisation (S1-S6) as one Catalyst expression.

``norm_key(c)`` returns the canonical key, or '' when the key is to be dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import col, contains_any_re as contains_any, let, py_strip, strip_chars

# Whole-word pack/piece/count/quantity; ``_`` is a word character (same in Java).
PACK_WORD_RE = "\\b(pack|piece|count|quantity)s?\\b"


def _alias_map(aliases: dict[str, str]) -> Column:
    kv = []
    for k, v in aliases.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def slug_key(c) -> Column:
    """lower, strip, non ``[a-z0-9]`` runs -> ``_``, trim ``_``."""
    k = F.lower(py_strip(col(c)))
    k = F.regexp_replace(k, "[^a-z0-9]+", "_")
    return strip_chars(k, "_")


def norm_key(c, aliases: dict[str, str] | None = None, bind: bool = True) -> Column:
    """Canonical attribute key or '' (dropped).

    ``bind=False`` inlines the shared parts instead of binding them in a lambda
    (same result; used to render the rule as a SQL function)."""
    aliases = rules.KEY_ALIASES if aliases is None else aliases
    k = slug_key(c)
    canon = F.coalesce(F.try_element_at(_alias_map(aliases), k), k)
    body = (_norm_key_bound(k, canon, aliases) if not bind else
            let(F.struct(k.alias("k"), canon.alias("canon")), lambda b: _norm_key_bound(b["k"], b["canon"], aliases)))
    return F.when(col(c).isNull(), F.lit(None).cast("string")).otherwise(body)


def _norm_key_bound(k: Column, canonical: Column, aliases: dict[str, str]) -> Column:
    canon_names = list(dict.fromkeys(aliases.values()))
    dropped = (
        contains_any(k, rules.KEY_BLACKLIST_SUBSTRINGS)
        | k.isin(rules.KEY_BLACKLIST_EXACT)
        | (F.length(k) <= 1)
        | k.rlike("\\binr\\b|\\busd\\b")
        | k.rlike("^[0-9]")
        | contains_any(k, rules.KEY_JUNK_TERMS)
    )
    material_like = contains_any(canonical, ["material", "fabric", "composition"])
    material_excl = contains_any(canonical, ["weight", "percentage", "stretch"])
    return (
        F.when(dropped, F.lit(""))
        .when(canonical.isin(canon_names), canonical)
        .when(contains_any(canonical, ["sentiment", "description", "class", "group"]), canonical)
        .when(contains_any(canonical, ["neck", "neckline", "collar"]), F.lit("neck_style"))
        .when(contains_any(canonical, ["sleeve"]), F.lit("sleeve_length"))
        .when(contains_any(canonical, ["care", "wash", "clean"]), F.lit("care_instructions"))
        .when(contains_any(canonical, ["color", "colour"]), F.lit("color"))
        .when(canonical.rlike(PACK_WORD_RE), F.lit("pack_count"))
        .when(material_like & ~material_excl, F.lit("material"))
        .otherwise(canonical)
    )
