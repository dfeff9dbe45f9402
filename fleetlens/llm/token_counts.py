"""Token-count rollups maintained by signed deltas.

A change batch holds inserts, deletes and revised counts of documents. It is
reduced to signed totals per (source, lang, tokenizer) and committed as one
small Parquet folder named after the batch; the rollup is the sum over
committed batches, so totals follow without touching earlier documents.

A batch counts once: its folder is written elsewhere and renamed into place, a
folder already there means the batch was committed before and the call does
nothing.

Edge cases: NULL source or language is a group of its own; NULL or empty texts
count no tokens; groups whose documents are all gone stay with zero totals
unless ``drop_empty``; repeated rows count each; an empty batch commits nothing
but its name; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_path, ship_code
from .tokenize import encoder

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced by one count column per tokenizer version
    (name -> vocabulary file)."""
    ship_code(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col]
    names = list(tokenizers)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col] + [f"`{n}` long" for n in names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(tokenizers[n]) for n in names]
        for b in batches:
            texts = [t or "" for t in b[text_col].to_pylist()]
            counts = [pa.array([n for x in e.encode_slices(texts) for n in x[3].tolist()], pa.int64()) for e in encoders]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *counts], [*keep, *names])

    return docs.select(*keep, text_col).mapInArrow(count, schema)


def inserts(counted: DataFrame, version: str) -> DataFrame:
    return counted.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).alias("n_docs"), F.col(version).alias("n_tokens"))


def deletes(counted: DataFrame, version: str) -> DataFrame:
    return counted.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(-1).alias("n_docs"), (-F.col(version)).alias("n_tokens"))


def revisions(counted: DataFrame, old: str, new: str) -> DataFrame:
    """Documents counted anew with another version: they leave one group and
    enter another."""
    return deletes(counted, old).unionByName(inserts(counted, new))


class TokenRollup:
    """A rollup kept in ``path``, a folder on a store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        where = self._spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self._spark._jsc.sc().hadoopConfiguration())

    def _path(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def committed(self, batch: str) -> bool:
        return self._fs().exists(self._path(f"batch={batch}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes (source, lang, tokenizer, n_docs,
        n_tokens); False if a batch of that name was committed before.

        Sums are taken per task before they are shuffled, so a source with a
        third of all rows costs one row per task."""
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError("a batch name has letters, digits, _ and - only")
        if self.committed(batch):
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        staged = shared_path(self._spark, f"staged-{batch}")
        delta.write.parquet(staged)
        fs = self._fs()
        fs.mkdirs(self._path(""))
        return fs.rename(self._spark._jvm.org.apache.hadoop.fs.Path(staged), self._path(f"batch={batch}"))

    def totals(self, drop_empty: bool = False) -> DataFrame:
        """Current totals per (source, lang, tokenizer)."""
        deltas = self._spark.read.schema(DELTA).option("basePath", self.path).parquet(f"{self.path}/batch=*")
        out = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0)) if drop_empty else out


def op9_token_counts(docs: DataFrame) -> DataFrame:
    """All documents through three batches: every document is inserted under the
    first vocabulary, the texts that are not English are counted anew with the
    multilingual one, later copies of a text are deleted; each batch is
    committed twice and counts once."""
    import public_tokenizers

    spark = docs.sparkSession
    vocabularies = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_multi_50k": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    narrow = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    counted = materialize(count_tokens(narrow, vocabularies), "counts")
    first, multi = vocabularies
    foreign = counted.filter(~F.col("lang").eqNullSafe("en"))
    # first copy of each text: a minimum per digest, taken per task first
    firsts = counted.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    copies = counted.join(firsts.select("digest", "first_id"), "digest").filter("doc_id > first_id")
    rollup = TokenRollup(spark, shared_path(spark, "rollup"))
    english = F.col("lang").eqNullSafe("en")
    batches = {
        "001-load": inserts(counted, first),
        "002-multilingual": revisions(foreign, first, multi),
        "003-copies": deletes(copies.filter(english), first).unionByName(deletes(copies.filter(~english), multi)),
    }
    for name, changes in batches.items():
        rollup.commit(name, changes)
        rollup.commit(name, changes)
    return rollup.totals(drop_empty=True)
