"""The corpus pipeline: documents that fail the quality rules go, one document of each
near-duplicate group stays, personal data is replaced, sources are mixed to target
weights, and what is left is encoded in sampled segmentations.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
its result is written as Parquet and read again, so a lost executor costs no more than
the stage at hand. All but the last return the columns of documents.

Cases: null, empty and wordless texts fail the quality rules and go there; a null language or
source is a group of its own, a null source one that is mixed like any other; a null doc_id is
kept, and repeated rows are one document where near duplicates go; texts of any length are
read whole; an empty table gives an empty result; further columns of documents pass through
all stages but the last, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import documents, written
from millrace.llm.mixing import mix_documents
from millrace.llm.near_dedup import one_of_each
from millrace.llm.piece_sampling import encode
from millrace.llm.pii import redact
from millrace.llm.quality_rules import filter_documents

MODEL = "piece_bpe_32k.model"
#: Documents of an Arrow batch, and bytes of text that piece sampling works on together. The
#: stages share executors whose heaps are full by then, so Python and Arrow get small parts.
BATCH_ROWS, BLOCK = 1_000, 256 << 10
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """A setting of the session, read when a stage runs; ``run`` puts it back."""
    spark.conf.set(_BATCH, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, a likeness of 0.8 or more."""
    _small_batches(spark)
    return one_of_each(docs, size=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every row."""
    _small_batches(spark)
    return encode(docs, public_tokenizers.path(MODEL), k=2, block=BLOCK)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("pieces", pieces)]

#: SQL has neither the signatures' buckets nor the sampled segmentations; tests hold
#: every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(_BATCH, before)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL}
