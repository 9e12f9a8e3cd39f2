"""Price cleaning (S16) and brand cleaning / key typing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import col, collapse_ws, contains_any, exact_round, let, py_strip


def money(x: Column) -> Column:
    """``f"${x:.2f}"``: rounded by the exact binary value (H4)."""
    return F.when(x.isNotNull(), F.concat(F.lit("$"), F.format_string("%.2f", exact_round(x, 2))))


def clean_price(c, inr_rate: float = rules.INR_PER_USD, bind: bool = True) -> Column:
    """Normalise a scraped price text to ``$d.dd``, ``N/A`` or cleaned text.

    ``bind=False`` inlines the stages instead of binding them in lambdas."""
    p0 = col(c)
    spaced = F.regexp_replace(py_strip(F.replace(p0, F.lit("\u00a0"), F.lit(" "))), "(?U)\\s+", " ")
    body = (_price_from_text(_undouble(spaced), inr_rate, False) if not bind else
            let(spaced, lambda p: let(_undouble(p), lambda q: _price_from_text(q, inr_rate, True))))
    return F.when(p0.isNull() | (p0 == ""), F.lit("N/A")).otherwise(body)


def _undouble(p: Column) -> Column:
    """Text whose space-free form is two equal halves collapses to one half."""
    nospace = F.regexp_replace(p, "(?U)\\s+", "")
    n = F.length(nospace)
    half_len = (n / 2).cast("int")
    half = F.substring(nospace, 1, half_len)
    second = F.substring(nospace, half_len + 1, 1 << 30)
    return F.when((n % 2 == 0) & (half == second), half).otherwise(p)


def _price_from_text(p: Column, inr_rate: float, bind: bool) -> Column:
    is_inr = p.rlike("(?i)(inr|rs\\.?|₹)")
    num_txt = F.replace(F.regexp_extract(p, "([0-9,]+\\.[0-9]+|[0-9,]+)", 1), F.lit(","), F.lit(""))
    num = F.when(num_txt != "", num_txt.try_cast("double"))
    fallback = F.regexp_replace(p, "(?i)\\b(inr|rs\\.?)\\s*", "\\$")
    fallback = py_strip(F.regexp_replace(fallback, "(?i)\\busd\\s*", "\\$"))
    usd = F.when(is_inr, num / F.lit(inr_rate)).otherwise(num)
    shown = money(usd) if not bind else let(usd, money)
    return F.coalesce(shown, fallback)


def price_usd(price_text: Column) -> Column:
    """Decimal column next to the text form, NULL unless ``$d.dd``."""
    return F.when(price_text.rlike("^\\$[0-9]+\\.[0-9]{2}$"),
                  F.substring(price_text, 2, 1 << 30).try_cast("decimal(12,2)"))


def clean_brand(c) -> Column:
    """lower, strip, punctuation out, company words out, spaces collapsed."""
    b = F.lower(py_strip(col(c)))
    b = F.regexp_replace(b, "(?U)[^\\w\\s]", "")
    b = F.regexp_replace(b, "(?U)" + rules.BRAND_COMPANY_WORDS_REGEX, "")
    return collapse_ws(b)


def classify_key(c) -> Column:
    """'size' (checked first), 'color' or 'other' by keyword substring."""
    k = F.lower(col(c))
    return (F.when(contains_any(k, rules.SIZE_KEYWORDS), F.lit("size"))
            .when(contains_any(k, rules.COLOR_KEYWORDS), F.lit("color"))
            .otherwise(F.lit("other")))


def result_label(c) -> Column:
    """Verdict -> human label; unknown verdicts pass through."""
    kv = []
    for k, v in rules.RESULT_LABELS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*kv), col(c)), col(c))
