"""End-to-end jobs (CL10, CL11, CL12, AT5, DF2).

``run_job`` is the resumable job: four steps, each writing its table under a root
(``step_tables``) and reading the tables of the steps before it, never their plans.
A step anti-joins what it could do with what it has published (J3, AG7), so a job
that was killed anywhere continues where it stopped, a longer pair list or more
stored pages add only what is new, and one more run over the same input adds nothing.
``run`` chains the same steps lazily, as DataFrames, without any table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attributes import extract_features
from ..operators.diff import compute_diff
from ..operators.evaluate import accuracy, verdict_summary
from ..operators.relational import in_scope, skip_done, winner_by_key
from ..operators.verdict import build_results, classify
from ..sources.files import link_rows, load_pairs
from ..sources.pages import extract_records, latest_page_per_url, parse_quality_observed
from .step_tables import StepTable, increment_number

STEPS = ("scrape", "extract", "match", "classify")


def scrape_records(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Link rows of all pairs joined to their parsed page (J6, PX13)."""
    return scrape_links(link_rows(pairs), pages)


def scrape_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Link rows joined to their parsed page. Only linked pages are parsed, each URL once."""
    linked = pages.join(links.select("url").distinct(), "url", "left_semi")
    records = extract_records(latest_page_per_url(linked)).drop("page_id")
    joined = links.join(records, "url", "left")
    return joined.select(
        "pair_id", "link_key", "url",
        F.coalesce(F.col("status"), F.lit("failed")).alias("status"),
        F.when(F.col("status").isNull(), F.lit("page_not_stored")).otherwise(F.col("error")).alias("error"),
        "raw", "scraped_at")


def extract(raw_records: DataFrame, pairs: DataFrame, done: DataFrame | None = None,
            images: DataFrame | None = None) -> DataFrame:
    """AT5: in-scope, not yet done, status ok -> feature records; with stored
    ``images`` (``sources.images.read_images``), the hashes of its images (IMG1)."""
    r = in_scope(raw_records, pairs, ["pair_id"]).where(F.col("status") == "ok")
    if done is not None:
        r = skip_done(r, done, ["pair_id", "link_key"])
    if images is None:
        return extract_features(r)
    from ..operators.images import attach_image_hashes, image_hashes
    return extract_features(attach_image_hashes(r, image_hashes(images)), with_hashes=True)


def match(features: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """DF2: both sides of each pair joined on pair_id (one shuffle), then diffed;
    pairs lacking a side are skipped."""
    cols = [c for c in features.columns if c not in ("pair_id", "link_key")]
    side = lambda k: features.where(F.col("link_key") == k).select("pair_id", F.struct(*cols).alias(f"f{k[-1]}"))
    pairs = side("link_1").join(side("link_2"), "pair_id", "inner")
    if done is not None:
        pairs = skip_done(pairs, done, ["pair_id"])
    return compute_diff(pairs)


def run(pairs: DataFrame, pages: DataFrame, images: DataFrame | None = None) -> dict:
    """CL11: the whole chain as DataFrames (write any of them to keep a step).

    ``parse_quality`` is an ``Observation`` (AG8 counters) filled when the
    raw records are first computed by an action."""
    raw, quality = parse_quality_observed(scrape_records(pairs, pages))
    feats = extract(raw, pairs, images=images)
    diffs = match(feats)
    results = build_results(classify(diffs), pairs)
    return {"raw_records": raw, "features": feats, "diffs": diffs, "results": results,
            "summary": verdict_summary(results), "accuracy": accuracy(results), "parse_quality": quality}


def url_cache(published: DataFrame) -> DataFrame:
    """(url, raw): one usable record per URL among the published ones; link_2 wins over
    link_1, a later increment over an earlier one, then the greater pair_id (J6, SO1)."""
    ok = published.where((F.col("status") == "ok") & F.col("raw").isNotNull() & (F.coalesce(F.col("url"), F.lit("")) != ""))
    ok = ok.select("url", "raw", "pair_id", "link_key", increment_number().alias("increment"))
    return winner_by_key(ok, ["url"], ["link_key", "increment", "pair_id"]).select("url", "raw")


def scrape_step(pairs: DataFrame, pages: DataFrame, published: DataFrame | None) -> DataFrame:
    """Records of the links that have none yet: from the URL cache, else from the stored pages."""
    links = link_rows(pairs)
    if published is None:
        return scrape_links(links, pages)
    links = skip_done(links, published, ["pair_id", "link_key"])
    cache = in_scope(url_cache(published), links.distinct(), ["url"])
    new = scrape_links(links.join(cache.select("url"), "url", "left_anti").select(*links.columns), pages)
    hits = links.join(cache, "url").select("pair_id", "link_key", "url", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"),
                                           "raw", F.current_timestamp().alias("scraped_at"))
    return new.unionByName(hits)


def run_job(pairs: DataFrame | str, pages: DataFrame, root: str, step: str = "all", limit: int | None = None,
            images: DataFrame | None = None) -> dict:
    """CL11: run one step, or all, over a pair list and stored pages; return the job's tables.

    ``pairs`` is a pair table or the path of a pair CSV; ``limit`` takes its first pairs
    (in file order, or by pair_id). A step whose input no run has published is skipped.
    A link counts as done whatever its status was, as a failed page is a result too; rows of pairs
    outside the list stay in the tables but are not returned. ``parse_quality`` holds the AG8 counters of this run's
    new records, ``summary`` and ``accuracy`` are over all results in scope.
    """
    if step != "all" and step not in STEPS:
        raise ValueError(f"step must be all or one of {', '.join(STEPS)}")
    spark = pages.sparkSession
    if isinstance(pairs, str):
        pairs = load_pairs(spark, pairs, limit)
    elif limit:
        pairs = pairs.orderBy("pair_id").limit(limit)
    raw, features, diffs, results = tables = [StepTable(spark, root, t) for t in ("raw_records", "features", "diffs", "results")]
    quality: dict = {}
    for s in STEPS if step == "all" else (step,):
        if s == "scrape":
            new, counters = parse_quality_observed(scrape_step(pairs, pages, raw.read()))
            raw.publish(new)
            quality = counters.get
        elif s == "extract" and raw.parts():
            features.publish(extract(raw.read(), pairs, features.read(), images))
        elif s == "match" and features.parts():
            todo, done = in_scope(features.read(), pairs, ["pair_id"]), diffs.read()
            diffs.publish(match(todo if done is None else skip_done(todo, done, ["pair_id"])))
        elif s == "classify" and diffs.parts():
            todo, done = in_scope(diffs.read(), pairs, ["pair_id"]), results.read()
            results.publish(build_results(classify(todo if done is None else skip_done(todo, done, ["pair_id"])), pairs))
    out = {t.path.rsplit("/", 1)[1]: in_scope(t.read(), pairs, ["pair_id"]) for t in tables if t.parts()} | {"parse_quality": quality}
    if "results" in out:
        out |= {"summary": verdict_summary(out["results"]), "accuracy": accuracy(out["results"])}
    return out


def compare(left_raw: DataFrame, right_raw: DataFrame) -> DataFrame:
    """CL12 + IO8: ad-hoc comparison of two raw product records (same path as
    the batch); returns verdict, both products and the comparison block."""
    l_f = extract_features(left_raw.withColumn("link_key", F.lit("link_1")))
    r_f = extract_features(right_raw.withColumn("link_key", F.lit("link_2")))
    both = l_f.unionByName(r_f)
    diffs = classify(match(both))
    f = both.select("pair_id", "link_key", F.struct(
        "title", "brand", F.get(F.col("image_urls"), 0).alias("image"), "price", "attrs").alias("product"))
    p1 = f.where("link_key = 'link_1'").select("pair_id", F.col("product").alias("product_1"))
    p2 = f.where("link_key = 'link_2'").select("pair_id", F.col("product").alias("product_2"))
    return diffs.join(p1, "pair_id").join(p2, "pair_id").select(
        "pair_id", F.col("our_result").alias("verdict"), "product_1", "product_2",
        F.struct("title_similarity_pct", "image_similarity_pct", "total_features_compared", "feature_diff",
                 "matched_keys", "mismatched_keys").alias("comparison"))
