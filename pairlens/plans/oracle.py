"""DuckDB SQL text for the correctness oracle.

The oracle recomputes each registered query in plain SQL over the same parquet
tables. Helpers here return SQL expression text; the LCS uses the same
bit-parallel recurrence as the Spark side but on one HUGEINT word (strings up to
126 characters on the shorter side, which holds for every oracle fixture).
"""

from __future__ import annotations

from .. import rules


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def tokens(x: str) -> str:
    """Distinct whitespace tokens."""
    return f"list_distinct(list_filter(string_split_regex({strip(x)}, '\\s+'), lambda tk: tk <> ''))"


def lcs(a: str, b: str) -> str:
    """LCS length of two SQL string expressions (use column names: text repeats)."""
    p = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)"
    t = f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    full = f"((1::HUGEINT << length({p})::INTEGER) - 1)"
    mask = (f"list_reduce(list_transform(range(length({p})), lambda li: CASE WHEN {p}[li + 1] = lch "
            f"THEN (1::HUGEINT << li::INTEGER) ELSE 0::HUGEINT END), lambda lx, ly: lx | ly, 0::HUGEINT)")
    v = (f"list_reduce(list_transform(string_split({t}, ''), lambda lch: {mask}), "
         f"lambda lv, lm: ((lv + (lv & lm)) | (lv & ~lm)) & {full}, {full})")
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({p}) - bit_count({v}) END)"


def indel_ratio(a: str, b: str) -> str:
    tot = f"(length({a}) + length({b}))"
    return (f"(CASE WHEN {a} = {b} THEN 100.0 ELSE "
            f"(1.0 - ({tot} - 2 * {lcs(a, b)})::DOUBLE / {tot}) * 100.0 END)")


def token_set_cte(src: str, key_cols: list[str], a: str, b: str, out: str) -> str:
    """CTE chain computing the token-set ratio of columns ``a``/``b`` of ``src``
    into column ``out``; returns the SELECT text (keys + out)."""
    keys = ", ".join(key_cols)
    return f"""
      SELECT {keys}, CASE
          WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0
          WHEN len(ti) > 0 AND (len(dab) = 0 OR len(dba) = 0) THEN 100.0
          WHEN sect = 0 THEN 100.0 - 100.0 * (length(sa) + length(sb) - 2 * {lcs('sa', 'sb')}) / (length(sa) + length(sb))
          ELSE greatest(
              100.0 - 100.0 * (length(sa) + length(sb) - 2 * {lcs('sa', 'sb')})
                      / (2 * sect + 2 + length(sa) + length(sb)),
              100.0 - 100.0 * (1 + length(sa)) / (2 * sect + 1 + length(sa)),
              100.0 - 100.0 * (1 + length(sb)) / (2 * sect + 1 + length(sb)))
        END AS {out}
      FROM (
        SELECT *, array_to_string(dab, ' ') AS sa, array_to_string(dba, ' ') AS sb,
               CASE WHEN len(ti) = 0 THEN 0 ELSE list_sum(list_transform(ti, lambda tk: length(tk))) + len(ti) - 1 END AS sect
        FROM (
          SELECT *, list_intersect(ta, tb) AS ti,
                 list_sort(list_filter(ta, lambda tk: NOT list_contains(tb, tk))) AS dab,
                 list_sort(list_filter(tb, lambda tk: NOT list_contains(ta, tk))) AS dba
          FROM (SELECT {keys}, {tokens(a)} AS ta, {tokens(b)} AS tb FROM {src})))"""


def clean_brand(x: str) -> str:
    b = f"lower({strip(x)})"
    b = f"regexp_replace({b}, '[^\\w\\s]', '', 'g')"
    b = f"regexp_replace({b}, {q(rules.BRAND_COMPANY_WORDS_REGEX)}, '', 'g')"
    return f"array_to_string(list_filter(string_split_regex({strip(b)}, '\\s+'), lambda tk: tk <> ''), ' ')"


def contains_any(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def map_case(x: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE {default} END)"


def pct_text(n: str, total: str) -> str:
    return f"(CASE WHEN {total} = 0 THEN '0%' ELSE printf('%.1f', {n}::DOUBLE / {total} * 100.0) || '%' END)"


# --- normalisation rules in SQL (staged: each stage is a subquery column) ---

def norm_key_select(src: str, keep: str, x: str, out: str = "norm_key") -> str:
    """SELECT keep, <normalised key of x> AS out FROM src."""
    canon_names = list(dict.fromkeys(rules.KEY_ALIASES.values()))
    exact = ", ".join(q(t) for t in rules.KEY_BLACKLIST_EXACT)
    names = ", ".join(q(t) for t in canon_names)
    alias = map_case("_k", rules.KEY_ALIASES, "_k")
    dropped = (f"({contains_any('_k', rules.KEY_BLACKLIST_SUBSTRINGS)} OR _k IN ({exact}) OR length(_k) <= 1 "
               f"OR regexp_matches(_k, '\\binr\\b|\\busd\\b') OR regexp_matches(_k, '^[0-9]') "
               f"OR {contains_any('_k', rules.KEY_JUNK_TERMS)})")
    return f"""SELECT {keep}, CASE WHEN _k IS NULL THEN NULL
        WHEN {dropped} THEN ''
        WHEN _c IN ({names}) THEN _c
        WHEN {contains_any('_c', ['sentiment', 'description', 'class', 'group'])} THEN _c
        WHEN {contains_any('_c', ['neck', 'neckline', 'collar'])} THEN 'neck_style'
        WHEN contains(_c, 'sleeve') THEN 'sleeve_length'
        WHEN {contains_any('_c', ['care', 'wash', 'clean'])} THEN 'care_instructions'
        WHEN {contains_any('_c', ['color', 'colour'])} THEN 'color'
        WHEN regexp_matches(_c, '\\b(pack|piece|count|quantity)s?\\b') THEN 'pack_count'
        WHEN {contains_any('_c', ['material', 'fabric', 'composition'])}
             AND NOT {contains_any('_c', ['weight', 'percentage', 'stretch'])} THEN 'material'
        ELSE _c END AS {out}
      FROM (SELECT *, {alias} AS _c FROM (
        SELECT *, regexp_replace(regexp_replace(lower({strip(x)}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS _k
        FROM {src}))"""


def clean_price_select(src: str, keep: str, x: str, out: str = "price") -> str:
    num_ok = "_num <> '' AND TRY_CAST(_num AS DOUBLE) IS NOT NULL"
    return f"""SELECT {keep}, CASE WHEN {x} IS NULL OR {x} = '' THEN 'N/A'
        WHEN {num_ok} AND regexp_matches(_p, '(?i)(inr|rs\\.?|₹)')
          THEN '$' || printf('%.2f', _num::DOUBLE / {rules.INR_PER_USD})
        WHEN {num_ok} THEN '$' || printf('%.2f', _num::DOUBLE)
        ELSE {strip("regexp_replace(regexp_replace(_p, '(?i)\\b(inr|rs\\.?)\\s*', '$', 'g'), '(?i)\\busd\\s*', '$', 'g')")}
      END AS {out}
      FROM (SELECT *, replace(regexp_extract(_p, '([0-9,]+\\.[0-9]+|[0-9,]+)', 1), ',', '') AS _num FROM (
        SELECT *, CASE WHEN length(_ns) % 2 = 0 AND substr(_ns, 1, length(_ns) // 2) = substr(_ns, length(_ns) // 2 + 1)
                       THEN substr(_ns, 1, length(_ns) // 2) ELSE _sp END AS _p
        FROM (SELECT *, regexp_replace(_sp, '\\s+', '', 'g') AS _ns FROM (
          SELECT *, regexp_replace({strip(f"replace({x}, chr(160), ' ')")}, '\\s+', ' ', 'g') AS _sp FROM {src}))))"""


def _num_guard(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({x}, '([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN {x}::DOUBLE END)"


def unit_case(v: str, table: dict[str, float], also_remove: str | None = None) -> str:
    parts = []
    for unit, factor in rules.units_longest_first(table):
        rest = f"replace({v}, {q(unit)}, '')"
        if also_remove:
            rest = f"replace({rest}, {q(also_remove)}, '')"
        num = _num_guard(f"regexp_replace({rest}, '[^0-9.]', '', 'g')")
        parts.append(f"CASE WHEN contains({v}, {q(unit)}) THEN round_even({num} * {factor}, 4) END")
    return "coalesce(" + ", ".join(parts) + ")"


def norm_value_select(src: str, keep: str, key: str, raw: str) -> str:
    """SELECT keep, kind, s, n of the normalised value (tagged form)."""
    noise1 = "regexp_replace(_v0, '(?i)\\s*[-–]?\\s*(out of stock|in stock|unavailable|sold out)\\b.*', '', 'g')"
    noise2 = "regexp_replace(_v1, '(?i)\\s+was\\s+[\\$₹£€]\\S+.*$', '', 'g')"
    noise3 = "regexp_replace(_v2, '(?i)\\s*\\(?\\s*\\d+\\s*(items?|left|remaining)\\s*\\)?$', '', 'g')"
    size_map = map_case("lower(_v)", {k: str(v) for k, v in rules.SIZE_ORDINAL.items()}, "NULL")
    pack_map = map_case("lower(_v)", {k: str(v) for k, v in rules.PACK_WORDS.items()}, "NULL")
    color = map_case("lower(_v)", rules.COLOR_ALIASES, "lower(_v)")
    pct = f"(CASE WHEN ends_with(_v, '%') THEN TRY_CAST({strip('left(_v, length(_v) - 1)')} AS DOUBLE) END)"
    t = ", ".join(q(x) for x in rules.BOOL_TRUE)
    f_ = ", ".join(q(x) for x in rules.BOOL_FALSE)
    kind_s_n = f"""CASE
        WHEN _v = '' THEN {{'kind': 'str', 's': {strip(raw)}, 'n': NULL::DOUBLE}}
        WHEN {contains_any(key, ['color', 'colour', 'shade', 'tone'])} THEN {{'kind': 'str', 's': {color}, 'n': NULL::DOUBLE}}
        WHEN {key} IN ('size', 'clothing_size', 'product_size') THEN
          CASE WHEN {size_map} IS NOT NULL THEN {{'kind': 'int', 's': {size_map}, 'n': {size_map}::DOUBLE}}
               ELSE {{'kind': 'str', 's': lower(_v), 'n': NULL::DOUBLE}} END
        WHEN regexp_matches({key}, '\\b(pack|piece|count|quantity)s?\\b') THEN
          CASE WHEN regexp_extract(lower(_v), '([0-9]+)', 1) <> '' THEN
                 {{'kind': 'int', 's': regexp_extract(lower(_v), '([0-9]+)', 1)::HUGEINT::VARCHAR,
                   'n': regexp_extract(lower(_v), '([0-9]+)', 1)::DOUBLE}}
               WHEN {pack_map} IS NOT NULL THEN {{'kind': 'int', 's': {pack_map}, 'n': {pack_map}::DOUBLE}}
               ELSE {{'kind': 'str', 's': lower(_v), 'n': NULL::DOUBLE}} END
        WHEN contains({key}, 'weight') AND _w IS NOT NULL THEN {{'kind': 'float', 's': _w::VARCHAR, 'n': _w}}
        WHEN {contains_any(key, ['volume', 'capacity'])} AND _vol IS NOT NULL THEN {{'kind': 'float', 's': _vol::VARCHAR, 'n': _vol}}
        WHEN {contains_any(key, ['length', 'width', 'height', 'dimension'])} AND _len IS NOT NULL
          THEN {{'kind': 'float', 's': _len::VARCHAR, 'n': _len}}
        WHEN {pct} IS NOT NULL THEN {{'kind': 'float', 's': {pct}::VARCHAR, 'n': {pct}}}
        WHEN lower(_v) IN ({t}) THEN {{'kind': 'bool', 's': 'true', 'n': 1.0}}
        WHEN lower(_v) IN ({f_}) THEN {{'kind': 'bool', 's': 'false', 'n': 0.0}}
        ELSE {{'kind': 'str', 's': lower(_v), 'n': NULL::DOUBLE}} END"""
    return f"""SELECT {keep}, _r.kind AS kind, _r.s AS s, _r.n AS n FROM (
      SELECT *, {kind_s_n} AS _r FROM (
        SELECT *, {unit_case('lower(_v)', rules.WEIGHT_TO_G)} AS _w,
               {unit_case('lower(_v)', rules.VOLUME_TO_ML, 'fl')} AS _vol,
               {unit_case('lower(_v)', rules.LENGTH_TO_CM)} AS _len
        FROM (SELECT *, {strip(noise3)} AS _v FROM (SELECT *, {strip(noise2)} AS _v2 FROM (
              SELECT *, {strip(noise1)} AS _v1 FROM (SELECT *, {strip(raw)} AS _v0 FROM {src}))))))"""


def greedy_align(k1: str, k2: str, threshold: float = rules.KEY_ALIGN_THRESHOLD) -> str:
    """Greedy one-to-one alignment of two key lists as a list of 'k1>k2' texts."""
    score = f"CASE WHEN list_contains(st.used, j) THEN -1.0 ELSE {indel_ratio('kx', 'ky')} END"
    # bind the two keys of the (i, j) cell to names usable by the LCS text
    cell = f"list_transform([{{'kx': {k1}[i + 1], 'ky': {k2}[j + 1]}}], lambda cc: {score.replace('kx', 'cc.kx').replace('ky', 'cc.ky')})[1]"
    scores = f"list_transform(range(len({k2})), lambda j: {cell})"
    step = (f"list_transform([{scores}], lambda sc: CASE WHEN len(sc) > 0 AND list_max(sc) >= {threshold} THEN "
            f"{{'used': list_append(st.used, list_position(sc, list_max(sc)) - 1), "
            f"'pairs': list_append(st.pairs, {k1}[i + 1] || '>' || {k2}[list_position(sc, list_max(sc))])}} "
            f"ELSE st END)[1]")
    return (f"list_reduce(range(len({k1})), lambda st, i: {step}, "
            f"{{'used': []::BIGINT[], 'pairs': []::VARCHAR[]}}).pairs")
