"""Column-expression builders (all JVM-side, no Python per row)."""

from .keys import norm_key, slug_key
from .price import classify_key, clean_brand, clean_price, price_usd, result_label
from .similarity import (hamming_distance, hamming_pct, hex_to_long, indel_ratio, lcs_len,
                         title_similarity, token_set_ratio)
from .text import collapse_ws, let, py_float, py_split, py_strip
from .values import VALUE_TYPE, norm_value, strip_noise, value_json

__all__ = [
    "norm_key", "slug_key", "classify_key", "clean_brand", "clean_price", "price_usd",
    "result_label", "hamming_distance", "hamming_pct", "hex_to_long", "indel_ratio",
    "lcs_len", "title_similarity", "token_set_ratio", "collapse_ws", "let", "py_float",
    "py_split", "py_strip", "VALUE_TYPE", "norm_value", "strip_noise", "value_json",
]
