"""A corpus pipeline of five stages: quality, near duplicates, decontamination, secrets, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waystone.llm.common import discard, materialize
from waystone.llm.decontaminate import drop_contaminated
from waystone.llm.mixing import mix_sources
from waystone.llm.ngram_join import keep_one_of_each
from waystone.llm.quality import keep_quality, train_quality
from waystone.llm.secrets import redact_secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learnt from labels on these documents, scores at least 0.3.

    Null and empty texts are scored as the empty text; repeated rows each on its own; without labels all stay; an
    empty table stays empty. Columns pass through untouched.
    """
    return keep_quality(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by 5-word shingles at a Jaccard similarity of 0.8, that of least doc_id.

    Null, empty and unmatched texts stay, as do rows of null doc_id; rows of the least doc_id itself all stay, so of
    repeated rows all or none. An empty table stays empty.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of ten words of the benchmark, or the whole of a shorter item.

    Null and empty texts stay. Rows of one doc_id go together if any of them has such a passage, those of null doc_id
    too. An empty table stays empty; without benchmark items all stay.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by [SECRET], n_chars following.

    Null texts stay null; repeated rows are redacted each on its own; an empty table stays empty.
    """
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row per copy of a document that the weighted fair queue takes, with copy_no.

    It holds no more words than the documents, whatever ids repeat or are null; null source is a source. Texts without
    a word (null ones too) are not taken; rows of equal id and text are interchangeable; an empty table gives no rows.
    """
    return mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources", mixing),
]

#: Models and fuzzy joins are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows written as Parquet and read again for the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
