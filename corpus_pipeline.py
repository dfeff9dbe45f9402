"""A training-data pipeline over ``documents``: each stage reads what the one
before it wrote as Parquet and works on all of it.

Quality rules drop rejected documents and failing lines; of near copies one
document stays; documents that leak benchmark items go; sources are mixed to
their target weights; the mix is written as token files, whose rows (doc_id,
start, n_tokens, ids_crc32), read back from them, are the result.

Edge cases: every stage takes NULLs, empty texts, repeated rows and empty tables
as its operator says; extra columns of ``documents`` travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm.common import discard, documents, materialize
from fleetlens.llm.decontamination import drop_leaking
from fleetlens.llm.jaccard_join import keep_first_of_each
from fleetlens.llm.mixing import mix_documents
from fleetlens.llm.quality_rules import keep_documents
from fleetlens.llm.token_files import op7_token_files


#: Written verdicts of quality(), which nothing reads once its result is written.
_verdicts: list[DataFrame] = []


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = keep_documents(docs)
    _verdicts.append(kept._llm_reads)
    return kept


def _discard_verdicts(spark: SparkSession, docs: DataFrame) -> None:
    """Delete the verdicts that ``docs`` doesn't read itself, as the written and
    reread result of quality() doesn't."""
    read = docs.inputFiles()
    for df in [v for v in _verdicts if not any(v._llm_path.rsplit("/", 1)[-1] in f for f in read)]:
        if df.sparkSession is spark:
            discard(df)
        _verdicts[:] = [v for v in _verdicts if v is not df]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _discard_verdicts(spark, docs)
    return keep_first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_token_files(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("pareto_mix", mixing),
    ("bit_planes", token_output),
]

#: Tokenizer, shingle and alignment stages have no SQL form; the tests compare
#: every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
