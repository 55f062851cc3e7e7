"""A corpus from raw documents to packed sequences: quality rules, near duplicates,
secrets, source mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.

Defined results, for all stages: no rows give no rows; extra columns pass through, whatever
their names; whole texts are read, however long. A null or empty text fails the quality
rules; after them, it would be a document of its own, without secrets, in no mix (it has
no words), and packed as its end id. A null id or source is a value like others, but
rows with a null id are nobody's copies. Repeated rows are judged each for itself by the
rules and the scan, one of them stays as a near duplicate, and the document at a source's
threshold is taken whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, ngram_join, packing, quality, secrets
from millrace.llm.common import new_path, read_table
from millrace.llm.queries import vocabulary

#: Units that a packing worker remembers: executors still hold the workers and heaps of the stages before.
UNITS = 250_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return ngram_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked in their texts."""
    return secrets.mask(docs, secrets.train(secrets.labelled_findings(spark)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of up to 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), max_units=UNITS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: Expectation-maximisation, forests and byte-pair encoding are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
