"""From documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept. A stage's result is written as
Parquet and read again as the next one's documents, so that a lost executor costs at
most one stage's work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.llm import mixing, neardup, packing, pii, quality
from perdura.llm.common import checkpoint_folder, removed, stored, table
from perdura.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among docs.

    Null and empty texts are scored as texts without a word. Repeated rows are judged alike,
    as are rows of one score. Labels that are null, repeated or of unknown documents do no harm.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).filter("predicted = 1").select(*COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that of the smallest doc_id.

    Documents without a word or an id stay. Of repeated rows with the smallest doc_id all stay.
    """
    gone = neardup.near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the text; n_chars follows the text. A null text stays null; repeated rows are masked alike."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled inside their shards.

    A null source is one of its own; documents without a word go with their block; repeated rows go together.
    """
    plan = mixing.make_plan(stored(mixing.compact(docs)))
    return mixing.mixed_rows(mixing.mix_sources(docs.select(*COLUMNS), plan=plan), COLUMNS, plan).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens; a null or empty text is the end id alone, repeated rows are packed each for itself."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_duplicates", neardup_stage),
    ("personal_data", pii_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, the signatures and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents table; without documents, no rows. Columns beyond COLUMNS are ignored.

    What a stage wrote is removed as soon as the next one has written; the last one's files stay, as the result reads them.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
