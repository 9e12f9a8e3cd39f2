"""The corpus job: documents through five training-data operators, one stored table per stage.

Each stage works on all that the one before kept, and returns the columns of
``documents`` (the last adds the tokens). Columns beside doc_id, text, source and
n_chars are carried as they are, whatever their names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import bpe, hyperminhash, linededup, mixing, quality
from pairlens.llm.common import WORD_RE, n_words, read_table, stored
from pairlens.session import apply_job_conf

_ROW = "__doc"


def _job_settings(stage):
    """The stage under the settings every job assumes, also where it is run by itself: with Spark's own
    10,000 rows a batch, each Python worker holds tens of MB of texts and tokens at a time."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(apply_job_conf(spark), docs, sf_dir)
    return run_stage


def _packed(docs: DataFrame) -> Column:
    """The whole row as one column, so that no operator's column can clash with one of it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW)


@_job_settings
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy of the rule ledger."""
    book = quality.ledger(docs.select("text", _packed(docs)))
    return book.where(~quality.failed(quality.PRODUCTION)).select(f"{_ROW}.*")


@_job_settings
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated passages; one of which no word is left goes."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("__")).alias(_ROW)
    d = linededup.dedup_lines(docs.select("doc_id", "text", rest))
    d = d.where((F.col("removed_lines") == 0) | F.coalesce(F.col("text").rlike(WORD_RE), F.lit(False)))
    chars = F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col(f"{_ROW}.n_chars")) if "n_chars" in docs.columns else None
    return d.select(*[F.col(c) if c in ("doc_id", "text") else chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                      else F.col(f"{_ROW}.`{c}`").alias(c) for c in docs.columns])


@_job_settings
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return hyperminhash.one_of_each(docs, k=5, percent=80)


@_job_settings
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _packed(docs))
    return mixing.replicated(mixing.mix(d, size="size"), [f"{_ROW}.*"])


@_job_settings
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``ids`` (packed tokens), ``n_tokens``, and whether the ids decode to the text."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    d = docs.drop("ids", "n_tokens", "decodes")
    coded = bpe.decode(bpe.encode(d, path, public_tokenizers.PATTERN), path, out="__bytes")
    return coded.select(*[F.col(f"`{c}`") for c in d.columns], "ids", F.floor(F.length("ids") / 4).cast("bigint").alias("n_tokens"),
                        (F.col("__bytes") == F.coalesce("text", F.lit("")).cast("binary")).alias("decodes"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]

# BPE encoding and the random mix have no SQL form; tests/llm holds the job against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each but the last is written and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
