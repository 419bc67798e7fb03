"""Corpus pipeline over documents: each stage is written as Parquet and reread.

Null or empty texts, and texts without a letter, go in the first stage. Null ids rank
below all others. Repeated rows are equal texts: one stays. Where rows tie on id and text,
exactly one stays. A null source is a source of its own. Other columns travel with
their rows, whatever their names, up to the last stage. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, exact_dedup, language_id, mixing, ngram_join
from scriptorium.llm.common import gathered, release, table, work_dir, written


#: The work folders of the stage that ran last in this thread of control.
_last: ContextVar[tuple[str, ...]] = ContextVar("last", default=())


def _stage(operator):
    """When a stage begins, the one before it has been written and reread: its work folders go."""

    @functools.wraps(operator)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _last.get())
        with gathered() as made:
            out = operator(spark, docs, sf_dir)
        _last.set(tuple(made))
        return out

    return run_stage


@_stage
def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, which are of no language; lang becomes the recognised one."""
    found = language_id.identified(docs).filter(F.col("lang_pred") != "und")
    return found.select("row.*", "lang_pred").withColumn("lang", F.col("lang_pred")).drop("lang_pred")


@_stage
def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each set of equal texts."""
    return exact_dedup.deduplicated(docs)


@_stage
def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of texts linked by five-word shingles at 0.8 or more."""
    return ngram_join.one_of_each(docs)


@_stage
def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source up to its target; a document taken k times gives k rows."""
    return mixing.mixed(docs, mixing.quality_of(table(spark, sf_dir, "labels")))


@_stage
def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, with the digests of a round trip."""
    out = byte_bpe.encoded(docs, *byte_bpe.public_vocabulary(), with_ids=True)
    return out.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language ID", stage_language),
    ("exact dedup", stage_exact_dedup),
    ("n-gram Jaccard join", stage_near_dedup),
    ("mixing sources", stage_mixing),
    ("byte-level BPE", stage_encode),
]

#: SQL cannot express the language, mixing and encoding stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}", folder)
    release(spark, _last.get())
    _last.set(())
    return docs
