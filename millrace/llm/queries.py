"""The thin queries of the operators: name -> callable, name -> SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import oracles
from millrace.llm.common import documents
from millrace.llm.language_id import learn as learn_languages
from millrace.llm.language_id import predict
from millrace.llm.mixing import mix
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.piece_sampling import encode
from millrace.llm.pii import digest, personal_data
from millrace.llm.quality_classifier import learn, scores
from millrace.llm.quality_rules import quality
from millrace.llm.spelling_variants import variants
from millrace.llm.spot_signatures import digest as spot_digest
from millrace.llm.substring_dedup import digest as repeats_digest
from millrace.llm.token_alignment import alignment
from millrace.llm.token_counts import token_counts
from millrace.llm.token_files import digest as token_digest


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(documents(spark, sf_dir)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document, best perturbed value first."""
    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), k=2)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scores(docs, learn(docs, documents(spark, sf_dir, "labels")))


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_digest(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, learn_languages(docs))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_pii, op3_quality_rules, op4_minhash_near_dedup, op5_token_counts, op6_piece_sampling, op7_token_files, op8_quality_classifier, op9_spot_signatures, op10_language_id, op11_spelling_variants, op12_token_alignment, op13_substring_dedup)}

ORACLE: dict[str, str] = {"op1_mixing": oracles.MIXING, "op11_spelling_variants": oracles.SPELLING, "op13_substring_dedup": oracles.REPEATS}
