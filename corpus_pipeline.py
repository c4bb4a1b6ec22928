"""A corpus pipeline of five stages, each calling one of the operators for training data.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's ``docs``. All stages but the last return the columns of ``docs``.

Defined cases, of each stage: null text is scored, compared and encoded as the empty text, and stays null until then; rows
without an id, or with one id and different texts, are documents of their own, and rows equal in id and text are one from
near-dedup on; a document without a page has no site; without labels the classifier keeps all; a table without rows gives
none; very long texts are handled whole; columns beyond those used pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, contextual_pii, mixing, simhash_pivot, site_quality
from plumbline.llm.common import stored
from plumbline.llm.queries import byte_vocabulary, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return site_quality.keep_good(docs, site_quality.bad_labels(table(spark, sf_dir, "labels")), site_quality.page_sites(table(spark, sf_dir, "pages")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that texts of 5-word Jaccard similarity 0.8 or more form."""
    return simhash_pivot.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return contextual_pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the number of these."""
    return bpe.encode_documents(docs, byte_vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("source mix", source_mix),
    ("BPE", tokens),
]

#: SQL can't express the classifier, SimHash or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
