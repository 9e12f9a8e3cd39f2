"""Summary and evaluation (AG1-AG3, PF8, SL7).

All of these are one partial-then-final aggregate over the result rows: the
verdict domain has four values, so what crosses the shuffle is four counters per
map task, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import py_strip, result_label


def verdict_dimension(spark: SparkSession) -> DataFrame:
    """The four verdicts with their summary rank and human label."""
    rows = [(v, i + 1, rules.RESULT_LABELS[v]) for i, v in enumerate(rules.VERDICTS)]
    return spark.createDataFrame(rows, "our_result string, verdict_rank int, label string")


def _pct_text(n, total):
    """``f"{n/total*100:.1f}%"``, ``0%`` when there is nothing to count."""
    return F.when(total == 0, F.lit("0%")).otherwise(
        F.concat(F.format_string("%.1f", F.bround(n / total * 100.0, 1)), F.lit("%")))


def verdict_summary(results: DataFrame) -> DataFrame:
    """Count per verdict, all four shown even at 0, in fixed order (AG1).

    The counts are one partial aggregate; the four verdict rows are then folded
    into one bounded array to get the total, and unfolded again with shares."""
    spark = results.sparkSession
    # at most one row per verdict value: a proven bound, so the counts are the
    # broadcast side (the dimension must be the preserved side of the join)
    counts = F.broadcast(results.groupBy("our_result").agg(F.count(F.lit(1)).alias("n")))
    joined = verdict_dimension(spark).join(counts, "our_result", "left").select(
        F.struct("verdict_rank", "our_result", "label",
                 F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")).alias("v"))
    folded = joined.agg(F.collect_list("v").alias("vs"))  # at most four entries
    total = F.aggregate(F.col("vs"), F.lit(0).cast("long"), lambda acc, v: acc + v["n"])
    rows = F.transform(F.col("vs"), lambda v: F.struct(
        v["verdict_rank"].alias("verdict_rank"), v["our_result"].alias("our_result"), v["label"].alias("label"),
        v["n"].alias("n"), _pct_text(v["n"], total).alias("pct")))
    return folded.select(F.inline(rows)).orderBy("verdict_rank")


def label_correct(pred_label, truth, non_exact_labels=None):
    """A prediction counts as correct when its label equals the truth, or it is a
    non-exact verdict and the truth is one of the non-exact labels (AG2)."""
    non_exact_labels = rules.NON_EXACT_EQUIVALENT_LABELS if non_exact_labels is None else non_exact_labels
    non_exact_preds = [rules.RESULT_LABELS[v] for v in (rules.SIZE_DIFF, rules.COLOR_DIFF, rules.NO_MATCH)]
    return ((pred_label == truth)
            | (pred_label.isin(non_exact_preds) & truth.isin(non_exact_labels)))


def evaluation_rows(results: DataFrame, non_exact_labels=None) -> DataFrame:
    """Per-pair predicted label, ground truth and correct flag (AG3, PF8)."""
    truth = py_strip(F.coalesce(F.col("original_csv_label"), F.lit("")))
    pred = F.coalesce(F.try_element_at(
        F.create_map(*[x for v in rules.VERDICTS for x in (F.lit(v), F.lit(rules.RESULT_LABELS[v]))]),
        F.col("our_result")), F.lit("Unknown"))
    return (results
            .where((truth != "") & (F.lower(truth) != "not sure"))
            .select("pair_id", pred.alias("predicted"), truth.alias("ground_truth"),
                    label_correct(pred, truth, non_exact_labels).alias("correct")))


def accuracy(results: DataFrame, non_exact_labels=None) -> DataFrame:
    """Total evaluated, correct, accuracy percent with 1 decimal (AG2)."""
    ev = evaluation_rows(results, non_exact_labels)
    agg = ev.agg(F.count(F.lit(1)).alias("total"),
                 F.sum(F.col("correct").cast("long")).alias("correct"))
    return agg.select("total", F.coalesce(F.col("correct"), F.lit(0)).alias("correct"),
                      F.when(F.col("total") > 0, F.format_string(
                          "%.1f", F.bround(F.col("correct") / F.col("total") * 100.0, 1)))
                      .alias("accuracy_pct"))


def report_flat(results: DataFrame) -> DataFrame:
    """Flat report rows: human labels, nested lists as JSON text (IO7, S19, S23)."""
    from ..functions import value_json

    def obj(arr, fn):
        entries = F.transform(arr, fn)
        return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))

    def jkey(k):
        return F.regexp_replace(F.to_json(F.array(k)), "^\\[|\\]$", "")

    mism = obj(F.col("mismatched_features"), lambda e: F.concat(
        jkey(e["key"]), F.lit(': {"link_1": '), value_json(e["link_1"]),
        F.lit(', "link_2": '), value_json(e["link_2"]), F.lit("}")))
    match = obj(F.col("matched_features"), lambda e: F.concat(jkey(e["key"]), F.lit(": "), value_json(e["value"])))
    return results.select(
        F.col("pair_id").alias("pair_id"),
        F.col("link_1_url"), F.col("link_2_url"),
        result_label(F.col("our_result")).alias("predicted_match_type"),
        F.col("original_csv_label").alias("original_match_type"),
        F.col("title_link_1"), F.col("title_link_2"),
        F.col("title_similarity_pct"), F.col("image_similarity_pct"),
        F.col("total_features_compared").alias("features_compared"),
        F.col("total_matched").alias("matched"), F.col("total_mismatched").alias("mismatched"),
        mism.alias("mismatched_features_json"), match.alias("matched_features_json"),
        F.col("product_type"),
    )
