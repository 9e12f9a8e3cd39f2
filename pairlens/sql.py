"""SQL entry points.

``register_sql(spark)`` registers the scalar rules ``norm_key``, ``norm_value``, ``clean_brand``,
``clean_price``, ``classify_key``, ``result_label`` and ``hamming_pct``, and the similarity
functions, as SQL functions. ``create_page_records_view(spark, pages, view)`` makes the page
step a view, so SQL users can write

    SELECT title, brand FROM records WHERE status = 'ok'
"""

from __future__ import annotations

from pyspark.sql import SparkSession

def create_page_records_view(spark: SparkSession, pages: str, view: str) -> None:
    """Register ``view``: the product records of the stored-page table ``pages`` (page_id, url, html)."""
    from .sources.pages import extract_records
    r = extract_records(spark.table(pages))
    r.select("page_id", "url", "parser", "status", "error", "raw.*").createOrReplaceTempView(view)


def _sql_text(spark: SparkSession, expr, schema: str) -> str:
    """SQL text of a lambda-free Column expression over the given parameters."""
    df = spark.createDataFrame([], schema).select(expr.alias("out"))
    return df._jdf.queryExecution().analyzed().projectList().apply(0).child().sql()


def _scalar_functions():
    """name -> (Column builder over named parameters, parameter schema, return type)."""
    from pyspark.sql import functions as F

    from . import functions as PF
    return {
        "norm_key": (lambda: PF.norm_key(F.col("k"), bind=False), "k string", "STRING"),
        "norm_value": (lambda: PF.norm_value(F.col("k"), F.col("v"), bind=False), "k string, v string",
                       "STRUCT<kind: STRING, s: STRING, n: DOUBLE>"),
        "clean_brand": (lambda: PF.clean_brand(F.col("b")), "b string", "STRING"),
        "clean_price": (lambda: PF.clean_price(F.col("p"), bind=False), "p string", "STRING"),
        "classify_key": (lambda: PF.classify_key(F.col("k")), "k string", "STRING"),
        "result_label": (lambda: PF.result_label(F.col("r")), "r string", "STRING"),
        "hamming_pct": (lambda: PF.hamming_pct(F.col("a"), F.col("b")), "a string, b string", "DOUBLE"),
    }


# The similarity functions loop over characters with lambdas, which Spark does
# not render back to SQL, so their SQL bodies are written here in Spark SQL
# (same bit-parallel recurrence as functions.similarity; tests compare both).
_WORD = 62
def _lcs_sql(a: str, b: str) -> str:
    """LCS length of two SQL string expressions (bit-parallel over 62-bit words)."""
    w = _WORD
    return f"""aggregate(array(named_struct('p', IF(length({a}) <= length({b}), {a}, {b}),
                                 't', IF(length({a}) <= length({b}), {b}, {a}))), 0,
  (lz, ls) -> IF(length(ls.p) = 0 OR length(ls.t) = 0, 0,
    length(ls.p) - aggregate(
      aggregate(
        transform(split(ls.t, ''), lch -> transform(sequence(0, CAST(ceil(length(ls.p) / {w}.0) AS INT) - 1),
          lk -> aggregate(sequence(lk * {w}, lk * {w} + least({w}, length(ls.p) - lk * {w}) - 1), 0L,
                 (lacc, li) -> lacc | IF(element_at(split(ls.p, ''), li + 1) = lch, shiftleft(1L, li - lk * {w}), 0L)))),
        transform(sequence(0, CAST(ceil(length(ls.p) / {w}.0) AS INT) - 1),
          lk -> shiftleft(1L, least({w}, length(ls.p) - lk * {w})) - 1),
        (lv, lms) -> aggregate(sequence(0, CAST(ceil(length(ls.p) / {w}.0) AS INT) - 1),
          named_struct('c', 0L, 'out', CAST(array() AS ARRAY<BIGINT>)),
          (lst, lk) -> named_struct(
            'c', shiftright(lv[lk] + (lv[lk] & lms[lk]) + lst.c, least({w}, length(ls.p) - lk * {w})),
            'out', array_append(lst.out,
                     ((lv[lk] + (lv[lk] & lms[lk]) + lst.c) & (shiftleft(1L, least({w}, length(ls.p) - lk * {w})) - 1))
                     | (lv[lk] & ~lms[lk])))).out),
      0, (lacc, lx) -> lacc + bit_count(lx))))"""


_LCS_SQL = _lcs_sql("a", "b")
_INDEL_SQL = """CASE WHEN a IS NULL OR b IS NULL THEN CAST(NULL AS DOUBLE) WHEN a = b THEN 100.0D
  ELSE (1.0D - (length(a) + length(b) - 2 * """ + _LCS_SQL + """) / (length(a) + length(b))) * 100.0D END"""


def _token_set_sql(ws: str) -> str:
    toks = "array_distinct(array_remove(split(btrim({x}, {ws}), '(?U)\\\\s+'), ''))"
    ta, tb = toks.format(x="a", ws=ws), toks.format(x="b", ws=ws)
    lcs = _lcs_sql("d.sa", "d.sb")
    return f"""CASE WHEN a IS NULL OR b IS NULL THEN 0.0D ELSE
aggregate(array(named_struct('ta', {ta}, 'tb', {tb})), 0.0D, (tz, ts) ->
  aggregate(array(named_struct(
      'n', array_intersect(ts.ta, ts.tb),
      'sa', array_join(array_sort(array_except(ts.ta, ts.tb)), ' '),
      'sb', array_join(array_sort(array_except(ts.tb, ts.ta)), ' '),
      'ea', size(array_except(ts.ta, ts.tb)) = 0, 'eb', size(array_except(ts.tb, ts.ta)) = 0)), 0.0D, (tz2, d) ->
    CASE WHEN size(ts.ta) = 0 OR size(ts.tb) = 0 THEN 0.0D
         WHEN size(d.n) > 0 AND (d.ea OR d.eb) THEN 100.0D
         WHEN size(d.n) = 0 THEN
           100.0D - 100.0D * (length(d.sa) + length(d.sb) - 2 * {lcs}) / (length(d.sa) + length(d.sb))
         ELSE greatest(
           100.0D - 100.0D * (length(d.sa) + length(d.sb) - 2 * {lcs})
                    / (2 * length(array_join(d.n, ' ')) + 2 + length(d.sa) + length(d.sb)),
           100.0D - 100.0D * (1 + length(d.sa)) / (2 * length(array_join(d.n, ' ')) + 1 + length(d.sa)),
           100.0D - 100.0D * (1 + length(d.sb)) / (2 * length(array_join(d.n, ' ')) + 1 + length(d.sb)))
    END))
END"""


def register_sql(spark: SparkSession) -> list[str]:
    """Register the SQL surface; returns the function names.

    Scalar rules without higher-order functions become SQL functions whose
    body is the same Catalyst expression the DataFrame API builds (rendered by
    Spark, so the two cannot drift). The similarity functions loop over
    characters with lambdas, which Spark cannot render back to SQL text; they
    stay DataFrame functions."""
    names = []
    for name, (build, schema, ret) in _scalar_functions().items():
        params = ", ".join(f"{p.split()[0]} {p.split()[1].upper()}" for p in schema.split(", "))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} "
                  f"RETURN {_sql_text(spark, build(), schema)}")
        names.append(name)
    from .functions.text import PY_WHITESPACE
    ws = "'" + PY_WHITESPACE.replace("\\", "\\\\").replace("'", "\\'") + "'"
    for name, body, ret in [("lcs_len", _LCS_SQL, "INT"), ("indel_ratio", _INDEL_SQL, "DOUBLE"),
                            ("token_set_ratio", _token_set_sql(ws), "DOUBLE")]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a STRING, b STRING) RETURNS {ret} RETURN {body}")
        names.append(name)
    return names
