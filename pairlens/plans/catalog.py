"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

Every query reads whole tables (or data Spark derives from them); nothing is
sampled or capped. Column names are aliased identically on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators.diff import compute_diff
from ..operators.evaluate import verdict_summary
from ..operators.verdict import classify
from . import oracle as O
from .fixtures import PART_COLUMNS, part_pairs, spread_table

# ---------------------------------------------------------------------------
# part catalog: pairs -> diff -> verdict
# ---------------------------------------------------------------------------


def part_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(compute_diff(part_pairs(spark, sf_dir)))


def flagship_verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AT1, DF1, CL8, AG1: verdict counts over all consecutive part pairs."""
    return verdict_summary(part_results(spark, sf_dir))


def verdict_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL1-CL9: one verdict row per pair with its counters."""
    return part_results(spark, sf_dir).select(
        "pair_id", "title_similarity_pct", "total_features_compared", "total_matched",
        "total_mismatched", F.array_join("mismatched_keys", ",").alias("mismatched_keys"), "our_result")


def title_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM2, SIM3, SO3: title token-set similarity of every part pair."""
    return part_results(spark, sf_dir).select("pair_id", "title_link_1", "title_link_2", "title_similarity_pct")


_COLOR_SQL = O.map_case("lower(split_part(p_name, ' ', 1))", rules.COLOR_ALIASES, "lower(split_part(p_name, ' ', 1))")
_SIZE_SQL = "CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END"


def _material_ok(a: str, b: str, tsr: str) -> str:
    words = " OR ".join(f"(contains({a}, {O.q(w)}) AND contains({b}, {O.q(w)}))" for w in rules.MATERIAL_WORDS)
    return f"({a} = {b} OR {words} OR contains({a}, {b}) OR contains({b}, {a}) OR {tsr} >= 80)"


PART_VERDICT_SQL = f"""
WITH f AS (
  SELECT p_partkey, p_name, p_brand, p_type, {_COLOR_SQL} AS color, {_SIZE_SQL} AS size_ord,
         lower(p_type) AS material
  FROM part),
pr AS (
  SELECT p_partkey AS k1, p_name AS t1, p_brand AS b1, color AS c1, size_ord AS s1, material AS m1,
         lead(p_partkey) OVER w AS k2, lead(p_name) OVER w AS t2, lead(p_brand) OVER w AS b2,
         lead(color) OVER w AS c2, lead(size_ord) OVER w AS s2, lead(material) OVER w AS m2
  FROM f WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)),
pairs AS (SELECT printf('p%d-p%d', k1, k2) AS pair_id, * FROM pr WHERE k2 IS NOT NULL),
tts AS ({O.token_set_cte('pairs', ['pair_id'], 't1', 't2', 'tsr')}),
cts AS ({O.token_set_cte('pairs', ['pair_id'], 'c1', 'c2', 'ctsr')}),
mts AS ({O.token_set_cte('pairs', ['pair_id'], 'm1', 'm2', 'mtsr')}),
d AS (
  SELECT pairs.*, round_even(tts.tsr, 2) AS title_sim,
         (c1 = c2 OR cts.ctsr >= 85) AS color_ok,
         (abs(s1 - s2) / greatest(abs(s1), abs(s2), 1e-9) <= 0.01) AS size_ok,
         {_material_ok('m1', 'm2', 'mts.mtsr')} AS material_ok,
         {O.clean_brand('b1')} AS cb1, {O.clean_brand('b2')} AS cb2
  FROM pairs JOIN tts USING (pair_id) JOIN cts USING (pair_id) JOIN mts USING (pair_id)),
v AS (
  SELECT *,
    CASE
      WHEN lower(t1) = '' OR lower(t2) = '' OR {O.contains_any('lower(t1)', rules.TITLE_INVALID_TERMS)}
           OR {O.contains_any('lower(t2)', rules.TITLE_INVALID_TERMS)} THEN 'NO_MATCH'
      WHEN cb1 <> '' AND cb2 <> '' AND cb1 <> cb2 AND NOT contains(cb2, cb1) AND NOT contains(cb1, cb2) THEN 'NO_MATCH'
      WHEN title_sim < 40 THEN 'NO_MATCH'
      WHEN color_ok AND size_ok AND material_ok THEN 'CASE_A_EXACT_MATCH'
      WHEN color_ok AND material_ok THEN 'CASE_B_SIZE_DIFF'
      WHEN size_ok AND material_ok THEN 'CASE_C_COLOR_DIFF'
      ELSE 'NO_MATCH'
    END AS our_result,
    (color_ok::INT + size_ok::INT + material_ok::INT) AS total_matched,
    array_to_string(list_filter(['color', 'size', 'material'],
        lambda kk, ii: NOT [color_ok, size_ok, material_ok][ii]), ',') AS mismatched_keys
  FROM d)
"""


def _verdict_summary_sql(src_cte: str) -> str:
    dim = ", ".join(f"({i + 1}, {O.q(v)}, {O.q(rules.RESULT_LABELS[v])})" for i, v in enumerate(rules.VERDICTS))
    return f"""{src_cte},
cnt AS (SELECT our_result, count(*) AS n FROM v GROUP BY our_result),
dim(verdict_rank, our_result, label) AS (VALUES {dim}),
j AS (SELECT dim.verdict_rank, dim.our_result, dim.label, coalesce(cnt.n, 0)::BIGINT AS n
      FROM dim LEFT JOIN cnt USING (our_result))
SELECT verdict_rank, our_result, label, n, {O.pct_text('n', 'sum(n) OVER ()')} AS pct FROM j ORDER BY verdict_rank
"""


SQL = {
    "flagship_verdict_summary": _verdict_summary_sql(PART_VERDICT_SQL),
    "verdict_per_pair": PART_VERDICT_SQL + """
SELECT pair_id, title_sim AS title_similarity_pct, 3 AS total_features_compared, total_matched,
       3 - total_matched AS total_mismatched, mismatched_keys, our_result FROM v""",
    "title_token_set": PART_VERDICT_SQL + """
SELECT pair_id, t1 AS title_link_1, t2 AS title_link_2, title_sim AS title_similarity_pct FROM v""",
}

QUERIES = {
    "flagship_verdict_summary": flagship_verdict_summary,
    "verdict_per_pair": verdict_per_pair,
    "title_token_set": title_token_set,
}


# ---------------------------------------------------------------------------
# evaluation against labels (AG2, AG3, PF8) — label derived from the titles
# ---------------------------------------------------------------------------


def _derived_label(t1, t2):
    """Ground truth from the two titles: same name -> 'Not Sure' (skipped), same
    colour word -> 'Size Different', same noun -> 'Color Different', else
    'Incorrect Match' (a non-exact label)."""
    w1, w2 = F.split(t1, " "), F.split(t2, " ")
    return (F.when(t1 == t2, F.lit("Not Sure"))
            .when(F.get(w1, 0) == F.get(w2, 0), F.lit("Size Different"))
            .when(F.get(w1, 1) == F.get(w2, 1), F.lit("Color Different"))
            .otherwise(F.lit("Incorrect Match")))


def accuracy_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evaluate import accuracy
    res = part_results(spark, sf_dir).withColumn(
        "original_csv_label", _derived_label(F.col("title_link_1"), F.col("title_link_2")))
    return accuracy(res)


_LABEL_SQL = """CASE WHEN t1 = t2 THEN 'Not Sure'
  WHEN split_part(t1, ' ', 1) = split_part(t2, ' ', 1) THEN 'Size Different'
  WHEN split_part(t1, ' ', 2) = split_part(t2, ' ', 2) THEN 'Color Different'
  ELSE 'Incorrect Match' END"""

SQL["accuracy_vs_label"] = PART_VERDICT_SQL + f""",
ev AS (
  SELECT {_LABEL_SQL} AS gt,
         CASE our_result WHEN 'CASE_A_EXACT_MATCH' THEN 'Exact Match' WHEN 'CASE_B_SIZE_DIFF' THEN 'Size Different'
              WHEN 'CASE_C_COLOR_DIFF' THEN 'Color Different' WHEN 'NO_MATCH' THEN 'No Match' ELSE 'Unknown' END AS pred
  FROM v),
ok AS (
  SELECT (pred = gt OR (pred IN ('Size Different', 'Color Different', 'No Match')
                        AND gt IN ('Variant Line Match', 'Incorrect Match'))) AS correct
  FROM ev WHERE trim(gt) <> '' AND lower(gt) <> 'not sure')
SELECT count(*) AS total, coalesce(sum(correct::BIGINT), 0) AS correct,
       CASE WHEN count(*) > 0 THEN printf('%.1f', sum(correct::BIGINT)::DOUBLE / count(*) * 100.0) END AS accuracy_pct
FROM ok"""
QUERIES["accuracy_vs_label"] = accuracy_vs_label


# ---------------------------------------------------------------------------
# relational steps of the jobs (J2, J3, J4, AG6, AG7)
# ---------------------------------------------------------------------------


def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: last order per customer by (date, key) — partial aggregate, skew-safe."""
    from ..operators.relational import last_by_key
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return last_by_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


SQL["dedupe_last"] = """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1"""
QUERIES["dedupe_last"] = dedupe_last


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + AG7: orders still to process = orders minus those whose line items
    are all done (composite done key (order, line) from finished lines)."""
    from ..operators.relational import skip_done
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    done = (spark.read.parquet(f"{sf_dir}/lineitem.parquet")
            .where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("o_orderkey")))
    return skip_done(orders, done, ["o_orderkey"])


SQL["resume_anti"] = """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey IS NOT NULL)"""
QUERIES["resume_anti"] = resume_anti


def scope_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in scope = those with a label row (left-semi join)."""
    from ..operators.relational import in_scope
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return in_scope(docs, labels, ["doc_id"])


SQL["scope_semi"] = """
SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""
QUERIES["scope_semi"] = scope_semi


def meta_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows with customer meta, blank when the customer is missing."""
    from ..operators.relational import attach_meta
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_custkey", "o_custkey")
    return attach_meta(orders, cust, ["o_custkey"], {"c_name": "", "c_mktsegment": ""})


SQL["meta_left"] = """
SELECT o_orderkey, o_custkey, coalesce(c_name, '') AS c_name, coalesce(c_mktsegment, '') AS c_mktsegment
FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
QUERIES["meta_left"] = meta_left


# ---------------------------------------------------------------------------
# attribute merges over an event stream table (AT1, AT2)
# ---------------------------------------------------------------------------


def _attr_merge(spark: SparkSession, sf_dir: str, last: bool) -> DataFrame:
    from pyspark.sql import Window
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value", "ts", "event_id")
    order = F.struct("ts", "event_id")
    pick = F.max_by("value", order) if last else F.min_by("value", order)
    g = ev.groupBy("user_id", F.col("event_type").alias("attr_key")).agg(
        pick.alias("attr_value"), F.min(order).alias("_first"))
    # one row per (user, key): the window is bounded by the number of keys
    w = Window.partitionBy("user_id").orderBy("_first")
    return g.select("user_id", "attr_key", "attr_value", F.row_number().over(w).alias("attr_pos"))


def attr_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AT1: per user, keys in first-seen order, each with its last value."""
    return _attr_merge(spark, sf_dir, last=True)


def attr_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AT2: per user, keys in first-seen order, each with its first value."""
    return _attr_merge(spark, sf_dir, last=False)


def _attr_sql(last: bool) -> str:
    d = "DESC" if last else "ASC"
    return f"""
WITH r AS (
  SELECT user_id, event_type AS attr_key, value,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {d}, event_id {d}) AS rn,
         min(ts) OVER (PARTITION BY user_id, event_type) AS f_ts
  FROM events),
g AS (SELECT user_id, attr_key, value AS attr_value,
             (SELECT min(e.event_id) FROM events e WHERE e.user_id = r.user_id AND e.event_type = r.attr_key
                AND e.ts = r.f_ts) AS f_id, f_ts
      FROM r WHERE rn = 1)
SELECT user_id, attr_key, attr_value,
       row_number() OVER (PARTITION BY user_id ORDER BY f_ts, f_id)::INTEGER AS attr_pos
FROM g"""


SQL["attr_last_wins"] = _attr_sql(True)
SQL["attr_first_wins"] = _attr_sql(False)
QUERIES["attr_last_wins"] = attr_last_wins
QUERIES["attr_first_wins"] = attr_first_wins


def record_attr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AT1, AT2, SO4 inside records: an order's lines as its attribute list (key: its flags, value: part), merged both ways."""
    from ..operators.attributes import first_wins, last_wins
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey")
    entry = F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("key"), F.col("l_partkey").cast("string").alias("value"))
    records = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("attrs"))

    def shown(merged):
        return F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return records.select("l_orderkey", F.size("attrs").alias("n_entries"), shown(last_wins("attrs")).alias("last_wins"),
                          shown(first_wins("attrs")).alias("first_wins"))


SQL["record_attr_merge"] = """
WITH e AS (
  SELECT l_orderkey, l_returnflag || l_linestatus AS k, l_partkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag || l_linestatus) AS p FROM lineitem),
r AS (SELECT l_orderkey, k, min(p) AS p1, arg_min(l_partkey, p) AS f, arg_max(l_partkey, p) AS t, count(*) AS n FROM e GROUP BY l_orderkey, k)
SELECT l_orderkey, sum(n)::INTEGER AS n_entries, string_agg(k || '=' || t::VARCHAR, ';' ORDER BY p1) AS last_wins,
       string_agg(k || '=' || f::VARCHAR, ';' ORDER BY p1) AS first_wins
FROM r GROUP BY l_orderkey"""
QUERIES["record_attr_merge"] = record_attr_merge


# ---------------------------------------------------------------------------
# image-hash similarity (SIM4) over 64-bit sign codes of the embeddings
# ---------------------------------------------------------------------------


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM4: sign bits of each embedding as a 64-bit hash; each vector compared
    with the next id (equi-join on id + 1)."""
    from ..operators.images import sign_code_hex
    from ..functions import hamming_distance, hamming_pct, hex_to_long
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", sign_code_hex(F.col("embedding")).alias("h"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_vec_id"),
                   F.col("h").alias("h2"))
    j = e.join(nxt, "vec_id")
    return j.select("vec_id", "next_vec_id", F.col("h").alias("hash_1"), F.col("h2").alias("hash_2"),
                    hamming_distance(hex_to_long("h"), hex_to_long("h2")).alias("distance"),
                    hamming_pct("h", "h2").alias("image_similarity_pct"))


_CODE_SQL = ("list_reduce(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 "
             "THEN (1::UBIGINT << i::INTEGER) ELSE 0::UBIGINT END), lambda a, b: a | b, 0::UBIGINT)")
SQL["hamming_pairs"] = f"""
WITH c AS (SELECT vec_id, {_CODE_SQL} AS code FROM embeddings)
SELECT a.vec_id, b.vec_id AS next_vec_id, printf('%016x', a.code) AS hash_1, printf('%016x', b.code) AS hash_2,
       bit_count(xor(a.code, b.code))::INTEGER AS distance,
       round_even((1 - bit_count(xor(a.code, b.code)) / 64.0) * 100, 2)::DOUBLE AS image_similarity_pct
FROM c a JOIN c b ON b.vec_id = a.vec_id + 1"""
QUERIES["hamming_pairs"] = hamming_pairs


# ---------------------------------------------------------------------------
# scalar normalisers over inputs derived from part
# ---------------------------------------------------------------------------
# Each part row yields a fixed set of probe texts built from its own fields, so
# the work grows with the table. Templates: (Spark column builder, SQL text).

def _w(i):
    return F.get(F.split(F.col("p_name"), " "), i)


def _s(c):
    return F.col(c).cast("string")


KEY_TEMPLATES = [
    (lambda: F.concat(F.col("p_type"), F.lit(" Type")), "p_type || ' Type'"),
    (lambda: F.concat(_w(0), F.lit(" Colour")), "split_part(p_name, ' ', 1) || ' Colour'"),
    (lambda: F.concat(F.lit("Fabric "), _w(1)), "'Fabric ' || split_part(p_name, ' ', 2)"),
    (lambda: F.concat(F.lit("Pack of "), _s("p_size")), "'Pack of ' || p_size::VARCHAR"),
    (lambda: F.concat(_w(1), F.lit(" Sleeve Style")), "split_part(p_name, ' ', 2) || ' Sleeve Style'"),
    (lambda: F.concat(F.upper(_w(0)), F.lit(" "), _w(1)), "upper(split_part(p_name, ' ', 1)) || ' ' || split_part(p_name, ' ', 2)"),
    (lambda: F.concat(F.lit("Item "), _w(1), F.lit(" Weight")), "'Item ' || split_part(p_name, ' ', 2) || ' Weight'"),
    (lambda: F.concat(_w(0), F.lit(" Neck")), "split_part(p_name, ' ', 1) || ' Neck'"),
    (lambda: F.concat(_s("p_size"), F.lit(" Pieces")), "p_size::VARCHAR || ' Pieces'"),
    (lambda: F.concat(F.col("p_type"), F.lit(" Care & Wash")), "p_type || ' Care & Wash'"),
    (lambda: F.concat(F.lit("  "), F.col("p_type"), F.lit(" Pack ")), "'  ' || p_type || ' Pack '"),
    (lambda: F.concat(_w(0), F.lit("/"), _w(1), F.lit(" Price")), "split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2) || ' Price'"),
    (lambda: F.concat(F.lit("Number of "), _w(1), F.lit("s")), "'Number of ' || split_part(p_name, ' ', 2) || 's'"),
    (lambda: F.concat(F.lit("Fabric "), F.col("p_type"), F.lit(" Stretch")), "'Fabric ' || p_type || ' Stretch'"),
]

BRAND_TEMPLATES = [
    (lambda: F.col("p_brand"), "p_brand"),
    (lambda: F.concat(F.col("p_brand"), F.lit(" Inc.")), "p_brand || ' Inc.'"),
    (lambda: F.concat(F.lit("Premium "), F.col("p_brand"), F.lit(" Co")), "'Premium ' || p_brand || ' Co'"),
    (lambda: F.concat(F.upper(_w(0)), F.lit("'s Basics LLC")), "upper(split_part(p_name, ' ', 1)) || '''s Basics LLC'"),
    (lambda: F.concat(F.lit(" "), _w(1), F.lit("-"), _w(0), F.lit(" Company ")), "' ' || split_part(p_name, ' ', 2) || '-' || split_part(p_name, ' ', 1) || ' Company '"),
]

PRICE_TEMPLATES = [
    (lambda: F.concat(F.lit("$"), _s("p_retailprice")), "'$' || p_retailprice::VARCHAR"),
    (lambda: F.concat(F.lit("₹"), F.format_number(F.round(F.col("p_retailprice") * 83.5), 0)),
     "'₹' || format('{:,}', round(p_retailprice * 83.5)::BIGINT)"),
    (lambda: F.concat(F.lit("$"), _s("p_retailprice"), F.lit("$"), _s("p_retailprice")),
     "'$' || p_retailprice::VARCHAR || '$' || p_retailprice::VARCHAR"),
    (lambda: F.concat(F.lit("Rs. "), F.col("p_retailprice").cast("bigint").cast("string")),
     "'Rs. ' || trunc(p_retailprice)::BIGINT::VARCHAR"),
    (lambda: F.concat(_s("p_retailprice"), F.lit(" USD")), "p_retailprice::VARCHAR || ' USD'"),
    (lambda: F.concat(_s("p_size"), F.lit(" dollars")), "p_size::VARCHAR || ' dollars'"),
    (lambda: F.concat(F.lit("  $"), _s("p_size"), F.lit(" ")), "chr(160) || ' $' || p_size::VARCHAR || ' '"),
    (lambda: F.when(F.col("p_size") > 25, F.lit("Free")).otherwise(F.lit("")),
     "CASE WHEN p_size > 25 THEN 'Free' ELSE '' END"),
    (lambda: F.concat(F.lit("INR "), _w(0)), "'INR ' || split_part(p_name, ' ', 1)"),
]

VALUE_TEMPLATES = [
    ("weight", lambda: F.concat(_s("p_size"), F.lit(" lb")), "p_size::VARCHAR || ' lb'"),
    ("weight", lambda: F.concat(_s("p_size"), F.lit(" lb 3 oz")), "p_size::VARCHAR || ' lb 3 oz'"),
    ("weight", lambda: F.concat(F.lit("lightweight "), _w(1)), "'lightweight ' || split_part(p_name, ' ', 2)"),
    ("capacity", lambda: F.concat(_s("p_size"), F.lit(" fl oz")), "p_size::VARCHAR || ' fl oz'"),
    ("length", lambda: F.concat(_s("p_size"), F.lit(" in")), "p_size::VARCHAR || ' in'"),
    ("item_dimensions", lambda: F.concat(F.lit("10 x "), _s("p_size"), F.lit(" x 2 in")), "'10 x ' || p_size::VARCHAR || ' x 2 in'"),
    ("size", lambda: F.element_at(F.array(*[F.lit(x) for x in ["S", "M", "L", "XL", "X-Large", "32W x 30L"]]),
                                  (F.col("p_size") % 6 + 1).cast("int")),
     "['S', 'M', 'L', 'XL', 'X-Large', '32W x 30L'][p_size % 6 + 1]"),
    ("color", lambda: F.concat(F.initcap(_w(0)), F.lit(" - Out of Stock")), "upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' - Out of Stock'"),
    ("color", lambda: F.concat(_w(0), F.lit(" was $"), _s("p_retailprice")), "split_part(p_name, ' ', 1) || ' was $' || p_retailprice::VARCHAR"),
    ("stretch", lambda: F.concat(_s("p_size"), F.lit("%")), "p_size::VARCHAR || '%'"),
    ("washable", lambda: F.when(F.col("p_size") % 2 == 0, F.lit("Yes")).otherwise(F.lit("no")),
     "CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'no' END"),
    ("pack_count", lambda: F.concat(_s("p_size"), F.lit("-Pack")), "p_size::VARCHAR || '-Pack'"),
    ("pack", lambda: F.concat(F.lit("Pack of "), _s("p_size")), "'Pack of ' || p_size::VARCHAR"),
    ("material", lambda: F.concat(F.col("p_type"), F.lit(" ("), _s("p_size"), F.lit(" left)")),
     "p_type || ' (' || p_size::VARCHAR || ' left)'"),
]


def _probe(spark, sf_dir, templates, name):
    part = spread_table(spark, sf_dir, "part", *PART_COLUMNS)
    probes = F.array(*[F.struct(F.lit(i + 1).alias("tpl"), t[0]().alias("txt")) for i, t in enumerate(templates)])
    return part.select("p_partkey", F.inline(probes)).withColumnRenamed("txt", name)


def _probe_sql(templates, name):
    rows = ", ".join(f"{{'tpl': {i + 1}, 'txt': {t[1]}}}" for i, t in enumerate(templates))
    return (f"(SELECT p_partkey, _u.tpl::INTEGER AS tpl, _u.txt AS {name} "
            f"FROM (SELECT p_partkey, unnest([{rows}]) AS _u FROM part))")


def q_norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute-key normalisation of key texts built from each part."""
    from ..functions import norm_key
    return _probe(spark, sf_dir, KEY_TEMPLATES, "key_raw").select(
        "p_partkey", "tpl", "key_raw", norm_key("key_raw").alias("norm_key"))


def q_clean_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand cleaning of brand texts built from each part."""
    from ..functions import clean_brand
    return _probe(spark, sf_dir, BRAND_TEMPLATES, "brand_raw").select(
        "p_partkey", "tpl", "brand_raw", clean_brand("brand_raw").alias("brand_clean"))


def q_clean_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price cleaning of price texts built from each part's price."""
    from ..functions import clean_price
    return _probe(spark, sf_dir, PRICE_TEMPLATES, "price_raw").select(
        "p_partkey", "tpl", "price_raw", clean_price("price_raw").alias("price"))


def q_norm_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value normalisation by key of value texts built from each part."""
    from ..functions import norm_value
    part = spread_table(spark, sf_dir, "part", *PART_COLUMNS)
    probes = F.array(*[F.struct(F.lit(i + 1).alias("tpl"), F.lit(k).alias("attr_key"), t().alias("raw"))
                       for i, (k, t, _) in enumerate(VALUE_TEMPLATES)])
    p = part.select("p_partkey", F.inline(probes)).withColumn("_v", norm_value("attr_key", "raw"))
    return p.select("p_partkey", "tpl", "attr_key", "raw", F.col("_v.kind").alias("kind"),
                    F.col("_v.s").alias("s"), F.col("_v.n").alias("n"))


def _value_probe_sql():
    rows = ", ".join(f"{{'tpl': {i + 1}, 'k': {O.q(k)}, 'txt': {sql}}}" for i, (k, _, sql) in enumerate(VALUE_TEMPLATES))
    return (f"(SELECT p_partkey, _u.tpl::INTEGER AS tpl, _u.k AS attr_key, _u.txt AS raw "
            f"FROM (SELECT p_partkey, unnest([{rows}]) AS _u FROM part))")


SQL["norm_key"] = O.norm_key_select(_probe_sql(KEY_TEMPLATES, "key_raw"), "p_partkey, tpl, key_raw", "key_raw")
SQL["clean_brand"] = (f"SELECT p_partkey, tpl, brand_raw, {O.clean_brand('brand_raw')} AS brand_clean "
                      f"FROM {_probe_sql(BRAND_TEMPLATES, 'brand_raw')}")
SQL["clean_price"] = O.clean_price_select(_probe_sql(PRICE_TEMPLATES, "price_raw"), "p_partkey, tpl, price_raw", "price_raw")
SQL["norm_value"] = O.norm_value_select(_value_probe_sql(), "p_partkey, tpl, attr_key, raw", "attr_key", "raw")
QUERIES["norm_key"] = q_norm_key
QUERIES["clean_brand"] = q_clean_brand
QUERIES["clean_price"] = q_clean_price
QUERIES["norm_value"] = q_norm_value


# ---------------------------------------------------------------------------
# key alignment (SIM1, AL1, SL4) and value rules (VM1-VM10)
# ---------------------------------------------------------------------------

LEFT_KEYS = [
    (lambda: F.concat(_w(0), F.lit("_color")), "split_part(p_name, ' ', 1) || '_color'"),
    (lambda: F.lit("size_type"), "'size_type'"),
    (lambda: F.concat(_w(1), F.lit("_name")), "split_part(p_name, ' ', 2) || '_name'"),
    (lambda: F.concat(F.lower(F.col("p_type")), F.lit("_fabric")), "lower(p_type) || '_fabric'"),
    (lambda: F.lit("weight"), "'weight'"),
    (lambda: F.lit("colour"), "'colour'"),
]
RIGHT_KEYS = [
    (lambda: F.concat(_w(1), F.lit("_colour")), "split_part(p_name, ' ', 2) || '_colour'"),
    (lambda: F.lit("sizes"), "'sizes'"),
    (lambda: F.lit("color_name"), "'color_name'"),
    (lambda: F.concat(_w(0), F.lit("_name")), "split_part(p_name, ' ', 1) || '_name'"),
    (lambda: F.lower(F.col("p_type")), "lower(p_type)"),
    (lambda: F.lit("height"), "'height'"),
]


def key_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AL1: greedy fuzzy alignment of two key lists built from each part."""
    from ..operators.align import align_keys
    part = spread_table(spark, sf_dir, "part", *PART_COLUMNS)
    k1 = F.array(*[t[0]() for t in LEFT_KEYS])
    k2 = F.array(*[t[0]() for t in RIGHT_KEYS])
    p = part.select("p_partkey", k1.alias("k1"), k2.alias("k2"))
    al = align_keys("k1", "k2")
    return p.select("p_partkey", F.array_join(F.transform(
        al, lambda x: F.concat(F.col("k1")[x["i"]], F.lit(">"), F.col("k2")[x["j"]])), "|").alias("aligned"))


SQL["key_alignment"] = f"""
SELECT p_partkey, array_to_string({O.greedy_align('k1', 'k2')}, '|') AS aligned FROM (
  SELECT p_partkey, [{', '.join(t[1] for t in LEFT_KEYS)}] AS k1, [{', '.join(t[1] for t in RIGHT_KEYS)}] AS k2
  FROM part)"""
QUERIES["key_alignment"] = key_alignment


# value-rule probes per part pair: (key, kind1, text1, kind2, text2) from both sides
def _side(c, i):
    return F.get(F.split(F.col(c), " "), i)


VALUE_RULE_TEMPLATES = [
    ("brand", "str", lambda: F.col("b1"), "str", lambda: F.col("b2"), "b1", "b2"),
    ("material", "str", lambda: F.concat(F.lit("100% cotton "), F.lower("m1")), "str",
     lambda: F.concat(F.lower("m2"), F.lit(" blend")), "'100% cotton ' || lower(m1)", "lower(m2) || ' blend'"),
    ("neck_style", "str", lambda: F.concat(_side("t1", 0), F.lit(" neck")), "str",
     lambda: F.concat(_side("t2", 0), F.lit(" crew")), "split_part(t1, ' ', 1) || ' neck'", "split_part(t2, ' ', 1) || ' crew'"),
    ("sleeve_length", "str", lambda: F.concat(_side("t1", 1), F.lit(" sleeve")), "str",
     lambda: F.concat(F.lit("basic "), _side("t2", 1)), "split_part(t1, ' ', 2) || ' sleeve'", "'basic ' || split_part(t2, ' ', 2)"),
    ("care_instructions", "str", lambda: F.concat(F.lit("wash "), _side("t1", 0)), "str",
     lambda: F.concat(F.lit("wash "), _side("t2", 0), F.lit(" cold")), "'wash ' || split_part(t1, ' ', 1)",
     "'wash ' || split_part(t2, ' ', 1) || ' cold'"),
    ("fit", "str", lambda: F.concat(_side("t1", 0), F.lit(" fit")), "str", lambda: F.concat(F.lit("regular "), _side("t2", 1)),
     "split_part(t1, ' ', 1) || ' fit'", "'regular ' || split_part(t2, ' ', 2)"),
    ("color", "str", lambda: _side("t1", 0), "str", lambda: _side("t2", 0), "split_part(t1, ' ', 1)", "split_part(t2, ' ', 1)"),
    ("style", "str", lambda: F.col("t1"), "str", lambda: F.col("t2"), "t1", "t2"),
    ("weight", "float", lambda: F.col("z1").cast("string"), "float", lambda: F.col("z2").cast("string"), "z1::VARCHAR", "z2::VARCHAR"),
    ("count", "int", lambda: F.col("z1").cast("string"), "str", lambda: F.concat(F.lit(" "), F.col("z2").cast("string")),
     "z1::VARCHAR", "' ' || z2::VARCHAR"),
    ("washable", "bool", lambda: F.lit("true"), "str", lambda: F.col("z2").cast("string"), "'true'", "z2::VARCHAR"),
]


def _pair_sides(spark, sf_dir):
    """(pair_id, t1, t2, b1, b2, m1, m2, z1, z2) of consecutive parts per brand/type
    (skew-safe next-in-group, as in the catalog fixture)."""
    from ..operators.sequence import with_next_in_group
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", "p_name", "p_brand", "p_type", (F.col("p_size") % 4).alias("z"))
    nxt = with_next_in_group(part, ["p_brand", "p_type"], "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "z"])
    return nxt.where(F.col("next_p_partkey").isNotNull()).select(
        F.col("p_partkey").alias("k1"), F.col("p_name").alias("t1"), F.col("p_brand").alias("b1"),
        F.col("p_type").alias("m1"), F.col("z").alias("z1"),
        F.col("next_p_partkey").alias("k2"), F.col("next_p_name").alias("t2"), F.col("next_p_brand").alias("b2"),
        F.col("next_p_type").alias("m2"), F.col("next_z").alias("z2"),
        F.format_string("p%d-p%d", F.col("p_partkey"), F.col("next_p_partkey")).alias("pair_id"))


def value_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VM1-VM10: domain value rules on value pairs built from each part pair."""
    from ..operators.diff import values_match
    from ..functions.values import make_value
    sides = _pair_sides(spark, sf_dir)
    probes = F.array(*[F.struct(
        F.lit(i + 1).alias("tpl"), F.lit(k).alias("attr_key"),
        make_value(kd1, v1(), F.when(F.lit(kd1) == "str", F.lit(None)).otherwise(v1().try_cast("double"))).alias("v1"),
        make_value(kd2, v2(), F.when(F.lit(kd2) == "str", F.lit(None)).otherwise(v2().try_cast("double"))).alias("v2"))
        for i, (k, kd1, v1, kd2, v2, _, _) in enumerate(VALUE_RULE_TEMPLATES)])
    p = sides.select("pair_id", F.inline(probes))
    return p.select("pair_id", "tpl", "attr_key", F.col("v1.s").alias("value_1"), F.col("v2.s").alias("value_2"),
                    values_match("attr_key", "v1", "v2").alias("match"))


def _value_rules_sql():
    rows = ", ".join(
        f"{{'tpl': {i + 1}, 'k': {O.q(k)}, 'kd1': {O.q(kd1)}, 's1': {s1}, 'kd2': {O.q(kd2)}, 's2': {s2}}}"
        for i, (k, kd1, _, kd2, _, s1, s2) in enumerate(VALUE_RULE_TEMPLATES))
    words = " OR ".join(f"(contains(a, {O.q(w)}) AND contains(b, {O.q(w)}))" for w in rules.MATERIAL_WORDS)

    def both(ws):
        return f"({O.contains_any('a', ws)} AND {O.contains_any('b', ws)})"
    sub = "(contains(b, a) OR contains(a, b))"
    cheap = f"""CASE k
        WHEN 'brand' THEN {sub}
        WHEN 'material' THEN ({words} OR {sub})
        WHEN 'neck_style' THEN ({both(['crew', 'round'])} OR {both(['v'])} OR {both(['hood'])} OR {both(['polo', 'collar'])} OR {sub})
        WHEN 'sleeve_length' THEN ({both(['short'])} OR {both(['long'])} OR {both(['sleeveless'])} OR {both(['basic', 'short'])} OR {sub})
        WHEN 'care_instructions' THEN ({both(['machine'])} OR {both(['hand'])} OR {both(['dry clean'])} OR {sub})
        WHEN 'fit' THEN ({both(['slim'])} OR {both(['relaxed', 'loose'])} OR {both(['regular', 'classic', 'standard'])} OR {sub})
        ELSE false END"""
    th = "CASE WHEN k = 'care_instructions' THEN 75 WHEN k IN ('brand', 'material', 'neck_style', 'sleeve_length', 'fit') THEN 80 ELSE 85 END"
    num = "(CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN trim({0})::DOUBLE END)"
    n1, n2 = num.format("s1"), num.format("s2")
    close = "(abs({0} - {1}) / greatest(abs({0}), abs({1}), 1e-9) <= 0.01)"
    return f"""
WITH f AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_size % 4 AS z FROM part),
pr AS (
  SELECT p_partkey AS k1, p_name AS t1, p_brand AS b1, p_type AS m1, z AS z1,
         lead(p_partkey) OVER w AS k2, lead(p_name) OVER w AS t2, lead(p_brand) OVER w AS b2,
         lead(p_type) OVER w AS m2, lead(z) OVER w AS z2
  FROM f WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)),
rows AS (
  SELECT printf('p%d-p%d', k1, k2) AS pair_id, unnest([{rows}]) AS u FROM pr WHERE k2 IS NOT NULL),
r AS (
  SELECT pair_id, u.tpl::INTEGER AS tpl, u.k AS k, u.kd1 AS kd1, u.s1 AS s1, u.kd2 AS kd2, u.s2 AS s2,
         lower({O.strip('u.s1')}) AS a, lower({O.strip('u.s2')}) AS b FROM rows),
t AS ({O.token_set_cte('r', ['pair_id', 'tpl'], 'a', 'b', 'tsr')})
SELECT pair_id, tpl, k AS attr_key, s1 AS value_1, s2 AS value_2,
  CASE
    WHEN kd1 <> kd2 THEN coalesce(CASE WHEN {n1} IS NOT NULL AND {n2} IS NOT NULL THEN {close.format(n1, n2)} END, false)
    WHEN kd1 <> 'str' THEN coalesce({close.format(n1, n2)}, false)
    WHEN a = '' OR b = '' THEN a = b
    WHEN a = b THEN true
    WHEN {cheap} THEN true
    ELSE tsr >= {th}
  END AS match
FROM r JOIN t USING (pair_id, tpl)"""


SQL["value_match_rules"] = _value_rules_sql()
QUERIES["value_match_rules"] = value_match_rules


# ---------------------------------------------------------------------------
# stored pages (PX1-PX13, PF3-PF6, AG8)
# ---------------------------------------------------------------------------


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX1, PX7, PX12: parser route and title of every stored page."""
    from ..sources.pages import parse_pages
    r = parse_pages(_pages(spark, sf_dir))
    return r.select("page_id", "url", "parser", F.col("raw.title").alias("title"))


SQL["page_titles"] = """
SELECT page_id, url, CASE WHEN contains(url, 'walmart.com') THEN 'walmart' WHEN contains(url, 'target.com') THEN 'target'
         WHEN contains(url, 'flipkart.com') THEN 'flipkart' WHEN contains(url, 'myntra.com') THEN 'myntra'
         ELSE 'generic' END AS parser,
       regexp_replace(regexp_replace(replace(replace(replace(replace(replace(
         regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1),
         '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g'),
         'Product summary presents key product informationKeyboard shortcutshift\\+alt\\+opt\\+D', '', 'g') AS title
FROM pages"""
QUERIES["page_titles"] = page_titles


def page_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF3, PF4: blocked-page predicates on every stored page (native, no parse)."""
    from ..sources.pages import amazon_blocked, press_hold_blocked, route
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", route("url").alias("parser"), amazon_blocked("html").alias("amazon_blocked"),
                    press_hold_blocked("html").alias("press_hold_blocked"))


SQL["page_blocking"] = f"""
SELECT page_id, CASE WHEN contains(url, 'walmart.com') THEN 'walmart' WHEN contains(url, 'target.com') THEN 'target'
         WHEN contains(url, 'flipkart.com') THEN 'flipkart' WHEN contains(url, 'myntra.com') THEN 'myntra'
         ELSE 'generic' END AS parser,
       (coalesce(html, '') = '' OR {O.contains_any('lower(html)', rules.AMAZON_BLOCK_PHRASES)}) AS amazon_blocked,
       (coalesce(html, '') = '' OR {O.contains_any('lower(html)', rules.PRESS_HOLD_BLOCK_PHRASES)}) AS press_hold_blocked
FROM pages"""
QUERIES["page_blocking"] = page_blocking


def page_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX13, PF5, PF6: record envelope (status, reject reason) per page."""
    from ..sources.pages import extract_records
    return extract_records(_pages(spark, sf_dir)).select("page_id", "parser", "status", "error")


def page_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX8-PX12: parse-quality counters per page (specs, bullets, images, text)."""
    from ..sources.pages import extract_records
    r = extract_records(_pages(spark, sf_dir))
    return r.select("page_id", F.size("raw.spec_table").alias("n_specs"), F.size("raw.bullet_points").alias("n_bullets"),
                    F.size("raw.image_urls").alias("n_images"), F.length("raw.description").alias("description_chars"),
                    F.col("raw.source").alias("source"))


def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8: parse-quality summary per host (partial aggregates)."""
    from ..sources.pages import extract_records, host
    r = extract_records(_pages(spark, sf_dir))
    return r.groupBy(host("url").alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("ok"),
        F.avg(F.size("raw.spec_table")).alias("avg_specs"), F.avg(F.size("raw.bullet_points")).alias("avg_bullets"),
        F.avg(F.size("raw.image_urls")).alias("avg_images"), F.avg(F.length("raw.title")).alias("avg_title_chars"))


QUERIES["page_reject_reasons"] = page_reject_reasons
QUERIES["page_bullets"] = page_bullets
QUERIES["source_quality"] = source_quality


# ---------------------------------------------------------------------------
# streaming (ST1-ST4), run to completion with availableNow
# ---------------------------------------------------------------------------


STREAM_FILE_ROWS, STREAM_FILE_BYTES = 500_000, 32 << 20


def _in_files(spark: SparkSession, sf_dir: str, table: str, batches: int) -> tuple[str, int]:
    """A table copied to the shared folder as several files, so that a stream reads it in batches: folder, files a batch.

    The number of batches is fixed; each has as many files as keep one, which is one task's, to ``STREAM_FILE_ROWS``
    rows and ``STREAM_FILE_BYTES`` of the stored table.
    There is one copy per version of the table (names, lengths and times of its files), so a rerun over an unchanged
    table resumes its stream and one over a changed table reads all of it. A copy without its success mark is never
    used; the next run writes another.
    """
    import hashlib
    import uuid

    from ..session import ensure_checkpoint_dir
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
    source = f"{sf_dir}/{table}.parquet"
    found, state, length = hadoop.Path(source).getFileSystem(conf).listFiles(hadoop.Path(source), True), [], 0
    while found.hasNext():
        f = found.next()
        length += f.getLen()
        state.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    rows = spark.read.parquet(source).count()
    a_batch = max(1, -(-rows // (batches * STREAM_FILE_ROWS)), -(-length // (batches * STREAM_FILE_BYTES)))
    version = hashlib.sha256("\n".join([str(batches * a_batch), *sorted(state)]).encode()).hexdigest()[:16]
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{table}-files-{version}"
    marks = hadoop.Path(base).getFileSystem(conf).globStatus(hadoop.Path(f"{base}-*/_SUCCESS"))
    whole = sorted(str(m.getPath().getParent()) for m in marks or [])
    if whole:
        return whole[0], a_batch
    path = str(hadoop.Path(base).getFileSystem(conf).makeQualified(hadoop.Path(f"{base}-{uuid.uuid4().hex[:8]}")))
    spark.read.parquet(source).repartition(batches * a_batch).write.parquet(path)
    return path, a_batch


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: events arriving in four batches, each key of (user, type) kept once over all of them."""
    from ..streaming.jobs import dedup_available_now, stream_table
    path, files = _in_files(spark, sf_dir, "events", 4)
    out = dedup_available_now(stream_table(spark, path, files_per_batch=files), ["user_id", "event_type"], "stream_dedup", path)
    return out.select("user_id", "event_type")


SQL["stream_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"
QUERIES["stream_dedup"] = stream_dedup


def stream_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: orders and line items as two streams of several batches, a pair given out once both sides have arrived,
    however late; no state is kept beside the two stored tables."""
    from ..streaming.jobs import delta_pair_join, stream_table
    (o_path, o_files), (l_path, l_files) = _in_files(spark, sf_dir, "orders", 2), _in_files(spark, sf_dir, "lineitem", 3)
    o = stream_table(spark, o_path, files_per_batch=o_files).select("o_orderkey", "o_orderdate")
    li = stream_table(spark, l_path, files_per_batch=l_files).select("l_orderkey", "l_linenumber", "l_shipdate")
    j = delta_pair_join(o, li, "o_orderkey", "l_orderkey", "stream_pair_join", f"{o_path} {l_path}")
    return j.select("o_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


SQL["stream_pair_join"] = """
SELECT o_orderkey, l_linenumber, o_orderdate, l_shipdate
FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
QUERIES["stream_pair_join"] = stream_pair_join


def stream_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: classified pairs written as a table, read back as a stream, running
    count per verdict in complete mode."""
    from ..session import ensure_checkpoint_dir
    from ..streaming.jobs import run_available_now, running_counts, stream_table
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex[:8]}"
    part_results(spark, sf_dir).select("pair_id", "our_result").write.parquet(path)
    return run_available_now(running_counts(stream_table(spark, path)), "stream_verdict_counts", path, mode="complete")


SQL["stream_verdict_counts"] = PART_VERDICT_SQL + "SELECT our_result, count(*) AS n FROM v GROUP BY our_result"
QUERIES["stream_verdict_counts"] = stream_verdict_counts


def stream_page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: stored pages read as a stream, parsed incrementally (the checkpoint
    is the resume index), records appended."""
    from ..sources.pages import extract_records
    from ..streaming.jobs import run_available_now, stream_table
    path, files = _in_files(spark, sf_dir, "pages", 2)
    pages = stream_table(spark, path, files_per_batch=files).select("page_id", "url", "html")
    out = run_available_now(extract_records(pages), "stream_page_extract", path)
    return out.select("page_id", "parser", "status")


SQL["stream_page_extract"] = """
SELECT page_id, 'generic' AS parser, 'ok' AS status FROM pages
WHERE NOT (contains(url, 'walmart.com') OR contains(url, 'target.com') OR contains(url, 'flipkart.com')
           OR contains(url, 'myntra.com') OR contains(url, 'amazon.'))
  AND regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) <> ''"""
QUERIES["stream_page_extract"] = stream_page_extract


# ---------------------------------------------------------------------------
# result rows and the flat report (CL9, IO7, S19, S23)
# ---------------------------------------------------------------------------


def report_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO7: flat report rows with human verdict labels and JSON feature text."""
    from ..operators.evaluate import report_flat as flat
    from ..operators.verdict import build_results
    return flat(build_results(part_results(spark, sf_dir)))




SQL["report_flat"] = PART_VERDICT_SQL + """
SELECT pair_id, 'part://' || k1::VARCHAR AS link_1_url, 'part://' || k2::VARCHAR AS link_2_url,
  CASE our_result WHEN 'CASE_A_EXACT_MATCH' THEN 'Exact Match' WHEN 'CASE_B_SIZE_DIFF' THEN 'Size Different'
       WHEN 'CASE_C_COLOR_DIFF' THEN 'Color Different' WHEN 'NO_MATCH' THEN 'No Match' ELSE our_result END
    AS predicted_match_type,
  '' AS original_match_type, t1 AS title_link_1, t2 AS title_link_2, title_sim AS title_similarity_pct,
  (-1.0)::DOUBLE AS image_similarity_pct, 3 AS features_compared, total_matched AS matched, 3 - total_matched AS mismatched,
  '{' || array_to_string(list_filter([
      '"color": {"link_1": ' || to_json(c1)::VARCHAR || ', "link_2": ' || to_json(c2)::VARCHAR || '}',
      '"size": {"link_1": ' || s1::VARCHAR || ', "link_2": ' || s2::VARCHAR || '}',
      '"material": {"link_1": ' || to_json(m1)::VARCHAR || ', "link_2": ' || to_json(m2)::VARCHAR || '}'],
      lambda x, i: NOT [color_ok, size_ok, material_ok][i]), ', ') || '}' AS mismatched_features_json,
  '{' || array_to_string(list_filter([
      '"color": ' || to_json(c1)::VARCHAR, '"size": ' || s1::VARCHAR, '"material": ' || to_json(m1)::VARCHAR],
      lambda x, i: [color_ok, size_ok, material_ok][i]), ', ') || '}' AS matched_features_json,
  '' AS product_type
FROM v"""
QUERIES["report_flat"] = report_flat


# ---------------------------------------------------------------------------
# site layouts derived from the stored pages (PX2-PX5): each page's title and id
# are embedded in four site layouts, which the parse pass must read back
# ---------------------------------------------------------------------------

_RAW_TITLE = "regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"
FLIPKART_BLOB = [("Brand", "A"), ("Type", "T"), ("Color", "C"), ("Fit", "F"), ("Pattern", "P"), ("Occasion", "O"),
                 ("Sales Package", "SP"), ("Style Code", "SC"), ("Ideal For", "IF"), ("Net Quantity", "NQ"),
                 ("Suitable For", "SF")]


def _site_layouts(pages: DataFrame) -> DataFrame:
    """(page_id, layout, url, html) — four synthetic site pages per stored page."""
    pid = F.col("page_id").cast("string")
    name = F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1)

    def spec(k, v):
        return F.struct(F.lit(k).alias("name"), v.alias("value"))

    walmart = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(
        F.struct(name.alias("name"), F.concat(F.lit("Acme"), pid).alias("brand"),
                 F.array(F.struct(F.array(spec("Color", F.concat(F.lit("C"), pid)), spec("Size", F.concat(F.lit("S"), pid)),
                                          spec("Material", F.lit("X"))).alias("specifications"))).alias("specifications"),
                 F.struct(F.array(F.struct(F.concat(F.lit("https://img.example/"), pid, F.lit("/1.jpg")).alias("url")),
                                  F.struct(F.concat(F.lit("https://img.example/"), pid, F.lit("/2.jpg")).alias("url")))
                          .alias("allImages")).alias("imageInfo"),
                 F.struct(F.struct(F.concat(F.lit("$"), pid, F.lit(".99")).alias("priceString")).alias("currentPrice"))
                 .alias("priceInfo")).alias("product"),
        F.struct(F.array(spec("Material", F.concat(F.lit("M"), pid))).alias("specifications"),
                 F.concat(F.lit("<ul><li>Fit: F"), pid, F.lit("</li><li>Care: R"), pid, F.lit("</li></ul>"))
                 .alias("shortDescription")).alias("idml")).alias("data")).alias("initialData")).alias("pageProps"))
        .alias("props")))
    item = F.struct(F.struct(
        F.struct(name.alias("title"),
                 F.array(F.concat(F.lit("<b>Color:</b> C"), pid), F.concat(F.lit("Size: S"), pid)).alias("bullet_descriptions"),
                 F.struct(F.array(F.concat(F.lit("B1 "), pid)).alias("bullets")).alias("soft_bullets")).alias("product_description"),
        F.struct(F.concat(F.lit("Acme"), pid).alias("name")).alias("primary_brand"),
        F.struct(F.struct(F.concat(F.lit("https://t.example/"), pid, F.lit(".jpg")).alias("primary_image_url"),
                          F.array(F.concat(F.lit("https://t.example/"), pid, F.lit(".jpg")),
                                  F.concat(F.lit("https://t.example/"), pid, F.lit("b.jpg"))).alias("alternate_image_urls"))
                 .alias("images")).alias("enrichment")).alias("item")).alias("product")
    target = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.struct(F.struct(item).alias("data")).alias("state")))
                                                  .alias("queries")).alias("dehydratedState")).alias("props")))
    blob = F.concat(*[x for k, v in FLIPKART_BLOB for x in (F.lit(k), F.lit(v), pid)])
    flipkart = F.concat(F.lit("<html><body><h1>"), name, F.lit("</h1><span>₹1,"), pid, F.lit("</span><div class=\"grid-formation\">"),
                        blob, F.lit("</div><img src=\"https://rukminim2.flixcart.com/image/128/128/x"), pid,
                        F.lit(".jpg?q=70\"></body></html>"))
    myx = F.to_json(F.struct(F.struct(
        F.struct(F.concat(F.lit("Acme"), pid).alias("name")).alias("brand"), name.alias("name"),
        (F.col("page_id") + 100).alias("mrp"),
        F.struct(F.concat(F.lit("F"), pid).alias("Fit"), F.lit("NA").alias("Neck"), F.concat(F.lit("P"), pid).alias("Pattern"))
        .alias("articleAttributes"),
        F.array(F.struct(F.lit("M").alias("label"), F.lit(True).alias("available")),
                F.struct(F.lit("L").alias("label"), F.lit(False).alias("available"))).alias("sizes"),
        F.array(F.struct(F.lit("Material & Care").alias("title"),
                         F.concat(F.lit("Cotton<br>Wash: W"), pid).alias("description"))).alias("productDetails"))
        .alias("pdpData")))
    layouts = F.array(
        F.struct(F.lit("walmart").alias("layout"), F.lit("https://www.walmart.com/ip/").alias("u"),
                 F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), walmart, F.lit("</script></html>")).alias("h")),
        F.struct(F.lit("target").alias("layout"), F.lit("https://www.target.com/p/").alias("u"),
                 F.concat(F.lit('<html><script id="__NEXT_DATA__">'), target, F.lit("</script></html>")).alias("h")),
        F.struct(F.lit("flipkart").alias("layout"), F.lit("https://www.flipkart.com/p/").alias("u"), flipkart.alias("h")),
        F.struct(F.lit("myntra").alias("layout"), F.lit("https://www.myntra.com/p/").alias("u"),
                 F.concat(F.lit("<html><script>window.__myx = "), myx, F.lit(";</script></html>")).alias("h")))
    return pages.select("page_id", F.inline(layouts)).select(
        "page_id", "layout", F.concat("u", F.col("page_id").cast("string")).alias("url"), F.col("h").alias("html"))


def page_site_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX2-PX5, PX12: site layouts built from each stored page, parsed back."""
    from ..sources.pages import parse_pages
    lay = _site_layouts(_pages(spark, sf_dir))
    parsed = parse_pages(lay.select("page_id", "url", "html").withColumn(
        "page_id", F.col("page_id") * 10 + F.when(F.col("url").contains("walmart"), 1)
        .when(F.col("url").contains("target"), 2).when(F.col("url").contains("flipkart"), 3).otherwise(4)))
    r = F.col("raw")
    return parsed.select(
        (F.col("page_id") / 10).cast("long").alias("page_id"), F.col("parser").alias("layout"),
        r["title"].alias("title"), r["brand"].alias("brand"),
        F.array_join(F.transform(r["spec_table"], lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("specs"),
        F.array_join(r["bullet_points"], "|").alias("bullets"), r["price_raw"].alias("price_raw"),
        F.array_join(r["image_urls"], "|").alias("images"), r["source"].alias("source"))


_DEC = ("regexp_replace(replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), "
        "'&gt;', '>'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g')")
SQL["page_site_layouts"] = f"""
WITH p AS (SELECT page_id, page_id::VARCHAR AS i, {_RAW_TITLE} AS t FROM pages)
SELECT page_id, 'walmart' AS layout, t AS title, 'Acme' || i AS brand,
       'Material=M' || i || ';Color=C' || i || ';Size=S' || i AS specs, 'Fit: F' || i || '|Care: R' || i AS bullets,
       '$' || i || '.99' AS price_raw, 'https://img.example/' || i || '/1.jpg|https://img.example/' || i || '/2.jpg' AS images,
       'next_data' AS source FROM p
UNION ALL
SELECT page_id, 'target', t, 'Acme' || i, 'Color=C' || i || ';Size=S' || i, 'B1 ' || i, '',
       'https://t.example/' || i || '.jpg|https://t.example/' || i || 'b.jpg', 'target_next_data' FROM p
UNION ALL
SELECT page_id, 'flipkart', {_DEC.format('t')}, regexp_extract({_DEC.format('t')}, '^\\s*(\\S+)', 1),
       {' || '.join(f"'{';' if n else ''}{k}={v}' || i" for n, (k, v) in enumerate(FLIPKART_BLOB))},
       '', '₹1' || i, 'https://rukminim2.flixcart.com/image/832/832/x' || i || '.jpg', 'flipkart_parser' FROM p
UNION ALL
SELECT page_id, 'myntra', regexp_replace('Acme' || i || ' ' || t, '^\\s+|\\s+$', '', 'g'), 'Acme' || i,
       'Fit=F' || i || ';Pattern=P' || i || ';Wash=W' || i, 'Available Size: M', '₹' || (page_id + 100)::VARCHAR, '',
       'myntra_json_parser' FROM p"""
QUERIES["page_site_layouts"] = page_site_layouts


# ---------------------------------------------------------------------------
# end to end on stored pages (CL11 shape): parse -> features -> pair -> diff
# -> verdict; each page paired with the next page (by id) of the same host
# ---------------------------------------------------------------------------


def page_pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX*, AT4, DF1, CL8 over real stored pages (J1 via the skew-safe pairing)."""
    from ..operators.attributes import extract_features
    from ..operators.sequence import with_next_in_group
    from ..sources.pages import extract_records, host

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")

    def features(d: DataFrame) -> DataFrame:
        recs = extract_records(d.select("page_id", "url", "html", "host", "_blk"), keep=("host", "_blk"))
        ok = recs.where(F.col("status") == "ok")
        ok = ok.withColumn("pair_id", F.lit("")).withColumn("link_key", F.lit(""))
        f = extract_features(ok, keep=("page_id", "host", "_blk")).drop("pair_id", "link_key")
        cols = [c for c in f.columns if c not in ("page_id", "host", "_blk")]
        return f.select("page_id", "host", "_blk", F.struct(*cols).alias("feat"))

    keyed = pages.withColumn("host", host("url"))
    paired = with_next_in_group(keyed, ["host"], "page_id", ["page_id", "feat"], per_row=features)
    pairs = paired.where(F.col("next_page_id").isNotNull()).select(
        F.format_string("g%d-g%d", F.col("page_id"), F.col("next_page_id")).alias("pair_id"),
        F.col("feat").alias("f1"), F.col("next_feat").alias("f2"))
    return classify(compute_diff(pairs)).select(
        "pair_id", "title_similarity_pct", "total_features_compared", "our_result")


SQL["page_pair_verdicts"] = f"""
WITH p AS (
  SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host,
         {_DEC.format(_RAW_TITLE)} AS title
  FROM pages),
pr AS (
  SELECT page_id AS k1, title AS t1, lead(page_id) OVER w AS k2, lead(title) OVER w AS t2
  FROM p WINDOW w AS (PARTITION BY host ORDER BY page_id)),
pairs AS (SELECT printf('g%d-g%d', k1, k2) AS pair_id, * FROM pr WHERE k2 IS NOT NULL),
tts AS ({O.token_set_cte('pairs', ['pair_id'], 't1', 't2', 'tsr')}),
d AS (SELECT pairs.*, CASE WHEN t1 <> '' AND t2 <> '' THEN round_even(tts.tsr, 2) ELSE -1.0 END AS sim
      FROM pairs JOIN tts USING (pair_id))
SELECT pair_id, sim::DOUBLE AS title_similarity_pct, 0 AS total_features_compared,
  CASE
    WHEN lower(t1) = '' OR lower(t2) = '' OR {O.contains_any('lower(t1)', rules.TITLE_INVALID_TERMS)}
         OR {O.contains_any('lower(t2)', rules.TITLE_INVALID_TERMS)} THEN 'NO_MATCH'
    WHEN sim < 40 THEN 'NO_MATCH'
    WHEN sim < 85 THEN 'NO_MATCH'
    ELSE 'CASE_A_EXACT_MATCH'
  END AS our_result
FROM d"""
QUERIES["page_pair_verdicts"] = page_pair_verdicts


# ---------------------------------------------------------------------------
# the resumable job (CL11, AT5, DF2, CL10, J1, J6, PF2) over offers made from the stored pages
# ---------------------------------------------------------------------------


def _offer_pages(pages: DataFrame) -> DataFrame:
    """Two offers per stored page, with its title: a Walmart page with an island, and a shop page in plain HTML."""
    pid, title = F.col("page_id").cast("string"), F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1)
    size = F.element_at(F.array(F.lit("S"), F.lit("M"), F.lit("L")), (F.col("page_id") % 3 + 1).cast("int"))
    other = F.element_at(F.array(F.lit("S"), F.lit("M"), F.lit("L")), (F.col("page_id") % 2 + 1).cast("int"))

    def spec(k, v):
        return F.struct(F.lit(k).alias("name"), v.alias("value"))
    product = F.struct(title.alias("name"), F.lit("Acme").alias("brand"), F.array(F.struct(F.array(
        spec("Color", F.lit("Blue")), spec("Size", size), spec("Material", F.lit("Cotton"))).alias("specifications"))).alias("specifications"))
    data = F.struct(F.struct(F.struct(F.struct(F.struct(product.alias("product")).alias("data")).alias("initialData")).alias("pageProps")).alias("props"))
    colour = F.when(F.col("page_id") % 4 == 3, "Red").otherwise("Blue")
    walmart = F.concat(F.lit('<html><script id="__NEXT_DATA__">'), F.to_json(data), F.lit("</script></html>"))
    shop = F.concat(F.lit("<html><head><title>"), title, F.lit("</title><meta property='og:brand' content='Acme'></head><body><table><tr><th>Colour</th><td>"), colour,
                    F.lit("</td></tr><tr><th>Size</th><td>"), other, F.lit("</td></tr></table><div id='feature-bullets'><ul><li>Material: Cotton</li><li>Nice</li></ul></div></body></html>"))
    return pages.select(F.inline(F.array(
        F.struct((F.col("page_id") * 2).alias("page_id"), F.concat(F.lit("https://www.walmart.com/ip/"), pid).alias("url"), walmart.alias("html")),
        F.struct((F.col("page_id") * 2 + 1).alias("page_id"), F.concat(F.lit("https://shop.example/"), pid).alias("url"), shop.alias("html")))))


def job_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL11: both offers of every stored page compared by the job: scraped in one run, the rest in a second, which
    reads the first one's table and scrapes nothing; every fifth pair's second page isn't stored, so it has no verdict."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from .jobs import run_job
    pages = _pages(spark, sf_dir)
    pid = F.col("page_id").cast("string")
    meta = F.struct(*[F.lit("").alias(c) for c in ("month", "item_id")], F.when(F.col("page_id") % 2 == 0, "Exact Match").otherwise("Not Sure")
                    .alias("original_match_type"), *[F.lit("").alias(c) for c in ("super_department", "department", "product_type")])
    host = F.when(F.col("page_id") % 5 == 4, "https://gone.example/").otherwise("https://shop.example/")
    pairs = pages.select(F.concat(F.lit("offer-"), pid).alias("pair_id"), F.concat(F.lit("https://www.walmart.com/ip/"), pid).alias("link_1_url"),
                         F.concat(host, pid).alias("link_2_url"), meta.alias("meta"))
    offers, root = _offer_pages(pages), f"{ensure_checkpoint_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    run_job(pairs, offers, root, step="scrape")
    out = run_job(pairs, offers, root)
    return out["results"].select("pair_id", "our_result", "title_similarity_pct", "total_features_compared", "total_matched", "total_mismatched",
                                 "original_csv_label", F.array_join(F.transform("mismatched_features", lambda e: e["key"]), ",").alias("mismatched_keys"))


SQL["job_resume"] = f"""
WITH p AS (
  SELECT page_id, {_RAW_TITLE} AS t1, {_DEC.format(_RAW_TITLE)} AS t2, page_id % 4 <> 3 AS color_ok, page_id % 3 = page_id % 2 AS size_ok
  FROM pages WHERE page_id % 5 <> 4),
s AS (SELECT page_id, regexp_replace(t1, '^\\s+|\\s+$', '', 'g') AS t1, t2, color_ok, size_ok FROM p),
tts AS ({O.token_set_cte('s', ['page_id'], 't1', 't2', 'tsr')}),
v AS (SELECT s.*, CASE WHEN t1 <> '' AND t2 <> '' THEN round_even(tts.tsr, 2) ELSE -1.0 END AS sim FROM s JOIN tts USING (page_id))
SELECT 'offer-' || page_id::VARCHAR AS pair_id, CASE
         WHEN t1 = '' OR t2 = '' OR {O.contains_any('lower(t1)', rules.TITLE_INVALID_TERMS)} OR {O.contains_any('lower(t2)', rules.TITLE_INVALID_TERMS)} THEN 'NO_MATCH'
         WHEN sim < 40 THEN 'NO_MATCH' WHEN color_ok AND size_ok THEN 'CASE_A_EXACT_MATCH' WHEN color_ok THEN 'CASE_B_SIZE_DIFF'
         WHEN size_ok THEN 'CASE_C_COLOR_DIFF' ELSE 'NO_MATCH' END AS our_result,
       sim::DOUBLE AS title_similarity_pct, 3 AS total_features_compared, 1 + color_ok::INT + size_ok::INT AS total_matched,
       2 - color_ok::INT - size_ok::INT AS total_mismatched, CASE WHEN page_id % 2 = 0 THEN 'Exact Match' ELSE 'Not Sure' END AS original_csv_label,
       concat_ws(',', CASE WHEN NOT color_ok THEN 'color' END, CASE WHEN NOT size_ok THEN 'size' END) AS mismatched_keys
FROM v"""
QUERIES["job_resume"] = job_resume
