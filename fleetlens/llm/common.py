"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import ensure_checkpoint_dir

#: One run of the characters that separate words (ASCII white space).
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: One word.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def words_of(text: Column) -> Column:
    """Array of the words of a text column (NULL text: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words of a text column (NULL text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_chars_in(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars`` (a regex class body)."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def n_word_chars(text: Column) -> Column:
    """Number of characters (code points) in words."""
    return F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder named by ``spark.checkpoint.dir``;
    what is written there is deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    jvm, jsc = spark._jvm, spark._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.sc().hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: later steps re-read the files when an executor is lost,
    and the plan below runs once however often the result is used."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialised frames that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._llm_path)
        where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(where, True)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application
    (``addPyFile``), so the caller need not install it on every machine."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (NULL id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def crc_mod_py(doc_id, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % mod


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit value."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Memo(dict):
    """A mapping that computes missing values; emptied between batches once it
    has grown past ``limit`` entries, so a worker's memory stays bounded."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        value = self[key] = self._make(key)
        return value

    def trim(self) -> None:
        if len(self) > self._limit:
            self.clear()
