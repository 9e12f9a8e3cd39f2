"""String and hash similarity as native Catalyst expressions (SIM1-SIM4).

* ``lcs_len``        longest common subsequence, bit-parallel (Hyyrö) over 62-bit
                     words held in an ``array<bigint>``: no length limit, no UDF,
                     usable inside other higher-order functions (the key aligner).
* ``indel_ratio``    ``100 * (1 - indel_distance / (len1 + len2))`` — the normalised
                     indel similarity, not Levenshtein (H1).
* ``token_set_ratio`` whitespace-token set ratio (see SURVEY 2.15), case-sensitive.
* ``hamming_pct``    ``(1 - popcount(h1 ^ h2) / 64) * 100`` for 16-hex-digit hashes.

Words are 62 bits wide so that ``V + (V & M) + carry`` never leaves the positive
``bigint`` range (ANSI mode raises on overflow, H2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, py_split

WORD_BITS = 62


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _shl(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _shr(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def _band(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def _bor(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def _lcs_pattern_text(p: Column, t: Column, chars_p: Column, chars_t: Column) -> Column:
    """LCS length; ``p`` is the bit-vector side (the shorter string); ``chars_*``
    are the bound character arrays (bound once: inside lambdas nothing is shared)."""
    m = F.length(p)
    n_words = F.floor((m + F.lit(WORD_BITS - 1)) / F.lit(WORD_BITS)).cast("int")
    words = F.sequence(F.lit(0), n_words - 1)

    def width(k):
        return F.least(F.lit(WORD_BITS), m - k * WORD_BITS)

    def full(k):
        return _shl(_one(), width(k)) - 1

    def mask(ch, k):
        lo = k * WORD_BITS
        return F.aggregate(
            F.sequence(lo, lo + width(k) - 1), _zero(),
            lambda acc, i: _bor(acc, F.when(chars_p[i] == ch, _shl(_one(), i - lo))
                                .otherwise(_zero())))

    # All match masks in ONE pass over the pattern: masks[d][k] is the bit set of
    # distinct pattern character d in word k. Each position updates one entry
    # with native slice/concat, so the pass costs one lambda call per position.
    zero_words = F.array_repeat(_zero(), n_words)

    def set_bit(acc, dp, ch, i):
        d = F.array_position(dp, ch).cast("int")                 # 1-based
        k = F.floor(i / F.lit(WORD_BITS)).cast("int")            # 0-based word
        row = F.element_at(acc, d)
        new_row = F.concat(F.slice(row, 1, k), F.array(_bor(F.element_at(row, k + 1), _shl(_one(), i - k * WORD_BITS))),
                           F.slice(row, k + 2, n_words))
        return F.concat(F.slice(acc, 1, d - 1), F.array(new_row), F.slice(acc, d + 1, F.size(acc)))

    def build_masks(dp):
        return F.aggregate(F.transform(chars_p, lambda c, i: F.struct(c.alias("c"), i.alias("i"))),
                           F.array_repeat(zero_words, F.size(dp)),
                           lambda acc, x: set_bit(acc, dp, x["c"], x["i"]))
    v0 = F.transform(words, lambda k: full(k))
    empty = F.array().cast("array<bigint>")

    def step(v, ms):
        def word(st, k):
            vk, mk = v[k], ms[k]
            total = vk + _band(vk, mk) + st["c"]
            return F.struct(
                _shr(total, width(k)).alias("c"),
                F.array_append(st["out"], _bor(_band(total, full(k)), _band(vk, F.bitwise_not(mk)))).alias("out"),
            )
        return F.aggregate(words, F.struct(_zero().alias("c"), empty.alias("out")), word)["out"]

    def run(md):
        def mask_of(ch):
            pos = F.array_position(md["d"], ch).cast("int")
            return F.when(pos > 0, F.element_at(md["m"], pos)).otherwise(zero_words)
        return F.aggregate(chars_t, v0, lambda v, ch: step(v, mask_of(ch)))

    v_end = let(F.array_distinct(chars_p), lambda dp: let(
        F.struct(dp.alias("d"), build_masks(dp).alias("m")), run))
    ones = F.aggregate(v_end, F.lit(0), lambda acc, x: acc + F.bit_count(x))
    return F.when((m == 0) | (F.length(t) == 0), F.lit(0)).otherwise(m - ones)


def _lcs_one_word(p: Column, chars_t: Column) -> Column:
    """LCS length where the pattern fits in one word. The match mask of a character is the reversed pattern
    with that character as 1 and all others as 0, read as a binary number: native, no table of masks."""
    m = F.length(p)
    bound = F.struct(F.reverse(p).alias("r"), F.rpad(F.lit("1"), m + 1, F.lit("0")).alias("digits"),
                     (_shl(_one(), m) - 1).alias("full"), chars_t.alias("t"))

    def run(c):
        def step(v, ch):
            binary = F.call_function("translate", c["r"], F.concat(ch, c["r"]), c["digits"])  # the first of equal characters counts
            return let(_band(v, F.conv(binary, 2, 10).cast("bigint")), lambda u: _band(_bor(v + u, v - u), c["full"]))
        return F.bit_count(F.aggregate(c["t"], c["full"], step))

    return m - let(bound, run)


def lcs_len(a, b) -> Column:
    """Length of the longest common subsequence of two strings (code points)."""
    a, b = col(a), col(b)
    shorter_first = F.length(a) <= F.length(b)
    pair = F.struct(F.when(shorter_first, a).otherwise(b).alias("p"),
                    F.when(shorter_first, b).otherwise(a).alias("t"))
    return let(pair, lambda s: let(
        F.struct(s["p"].alias("p"), s["t"].alias("t"), F.split(s["p"], "").alias("cp"), F.split(s["t"], "").alias("ct")),
        lambda b: F.when((F.length(b["p"]) > 0) & (F.length(b["p"]) <= WORD_BITS), _lcs_one_word(b["p"], b["ct"]))
        .otherwise(_lcs_pattern_text(b["p"], b["t"], b["cp"], b["ct"]))))


def indel_ratio(a, b) -> Column:
    """Normalised indel similarity 0-100 (``fuzz.ratio``)."""
    a, b = col(a), col(b)
    total = F.length(a) + F.length(b)
    dist = total - 2 * lcs_len(a, b)
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when(a == b, F.lit(100.0))
            .otherwise((F.lit(1.0) - dist / total) * 100.0))


def _token_set_from_sets(ta: Column, tb: Column) -> Column:
    bound = F.struct(F.length(F.array_join(F.array_intersect(ta, tb), " ")).alias("sect"),
                     F.array_join(F.sort_array(F.array_except(ta, tb)), " ").alias("sa"),
                     F.array_join(F.sort_array(F.array_except(tb, ta)), " ").alias("sb"))

    def score(s):  # tokens are never empty, so an empty join is an empty set
        sect, la, lb = s["sect"], F.length(s["sa"]), F.length(s["sb"])
        g = F.when(sect > 0, F.lit(1)).otherwise(F.lit(0))
        sab = sect + g + la
        sba = sect + g + lb
        dist = la + lb - 2 * lcs_len(s["sa"], s["sb"])
        base = F.lit(100.0) - F.lit(100.0) * dist / (sab + sba)
        r_ab = F.lit(100.0) - F.lit(100.0) * (g + la) / (sect + sab)
        r_ba = F.lit(100.0) - F.lit(100.0) * (g + lb) / (sect + sba)
        return (F.when((sect > 0) & ((la == 0) | (lb == 0)), F.lit(100.0))
                .when(sect == 0, base)
                .otherwise(F.greatest(base, r_ab, r_ba)))

    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).otherwise(let(bound, score))


def token_set_ratio(a, b) -> Column:
    """Token-set ratio 0-100 of two texts (whitespace tokens, case kept)."""
    a, b = col(a), col(b)
    sets = F.struct(F.array_distinct(py_split(a)).alias("a"), F.array_distinct(py_split(b)).alias("b"))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(
        let(sets, lambda s: _token_set_from_sets(s["a"], s["b"])))


def title_similarity(t1, t2) -> Column:
    """Token-set ratio rounded to 2 decimals, -1.0 when a title is empty (SIM3)."""
    t1, t2 = col(t1), col(t2)
    ok = t1.isNotNull() & t2.isNotNull() & (t1 != "") & (t2 != "")
    return F.when(ok, F.bround(token_set_ratio(t1, t2), 2)).otherwise(F.lit(-1.0))


HEX64 = "^[0-9a-fA-F]{16}$"


def hex_to_long(h) -> Column:
    """16 hex digits -> signed bigint (two's complement; the unsigned form would overflow)."""
    return F.conv(col(h), 16, -10).cast("bigint")


def hamming_distance(x, y) -> Column:
    return F.bit_count(col(x).bitwiseXOR(col(y)))


def hamming_pct(h1, h2) -> Column:
    """Image similarity from two 64-bit hex hashes, 2 decimals; -1.0 if unknown."""
    h1, h2 = col(h1), col(h2)
    ok = h1.rlike(HEX64) & h2.rlike(HEX64)
    d = hamming_distance(hex_to_long(h1), hex_to_long(h2))
    pct = F.bround((F.lit(1.0) - d / F.lit(64.0)) * 100.0, 2)
    return F.when(h1.isNull() | h2.isNull(), F.lit(-1.0)).when(ok, pct).otherwise(F.lit(-1.0))
