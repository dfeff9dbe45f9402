"""Registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP11_SQL, mine_collocations
from .common import documents
from .conversation_trie import conversation_trie, op12_sql
from .decontamination import leaks
from .jaccard_join import jaccard_classes
from .language_model import op10_lm_scores as lm_scores
from .licenses import license_scan, op5_sql
from .mixing import OP3_SQL, op3_mixing
from .quality_rules import quality_rules
from .sharding import documents_sharded, op13_sql
from .substring_dedup import substring_dedup
from .token_counts import op9_token_counts
from .token_files import op7_token_files
from .toxicity import op1_toxicity as toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, from noisy-or sentence scores."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-word windows of smaller ids' documents."""
    return substring_dedup(documents(spark, sf_dir), texts=False)


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pareto order mix of all documents to source weights 1, 2, 3, ..."""
    return op3_mixing(documents(spark, sf_dir))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are 80 % alike."""
    return jaccard_classes(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence rules found in all documents."""
    return license_scan(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules over all documents."""
    return quality_rules(documents(spark, sf_dir)).drop("clean_text")


def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to plane-shuffled files and read back."""
    return op7_token_files(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items, whole or nearly."""
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents by source, language and tokenizer version."""
    return op9_token_counts(documents(spark, sf_dir))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of all documents under an attention model and unigrams."""
    return lm_scores(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of every language of all documents."""
    return mine_collocations(documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, a row per node."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards cut from a Hilbert curve over their metadata."""
    return documents_sharded(documents(spark, sf_dir))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pareto_mix": op3_pareto_mix,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_license_scan": op5_license_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_bit_planes": op7_bit_planes,
    "op8_decontamination": op8_decontamination,
    "op9_token_rollup": op9_token_rollup,
    "op10_lm_scores": op10_lm_scores,
    "op11_collocations": op11_collocations,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_hilbert_shards": op13_hilbert_shards,
}

ORACLE_SQL: dict[str, str] = {
    "op3_pareto_mix": OP3_SQL,
    "op5_license_scan": op5_sql(),
    "op11_collocations": OP11_SQL,
    "op12_conversation_trie": op12_sql(),
    "op13_hilbert_shards": op13_sql(),
}
