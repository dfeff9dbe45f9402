"""Token ids in binary files of shuffled planes.

Documents are dealt by ranges of doc_id and sorted within; each task encodes
its documents and writes one shard file. Ids are collected into blocks of a
fixed size; a block is transposed into byte planes (all lowest bytes, then all
second bytes, ...) or bit planes, and each plane is compressed with zstandard,
which then sees long runs of similar bytes.

Shard file (numbers little-endian):

* ``BPLANES1``
* the compressed planes, block after block, lowest plane first
* a zstd-compressed document table: doc_id int64, a flag byte (0: NULL id) and
  number of ids uint64, one array after the other
* a zstd-compressed chunk index: for each plane offset, stored bytes and number
  of ids of its block, uint64
* footer: offsets and stored bytes of both tables, number of documents, of ids
  and of blocks, block size, planes per id, bits per plane: 10 x uint64, then
  ``BPLANES1``

A task writes its file under a name of its own and reports it in a row; the rows
of the tasks that succeeded, written through Spark, are the manifest. Files of
failed or repeated attempts are in no manifest and so are never read. Files go
through ``pyarrow.fs`` by URI, so the shared folder may be a mounted or an
object store.

Edge cases: NULL text has no ids (only the end id); NULL ids sort first; rows
with equal ids stay next to each other, ordered by their text's hash; an empty
table gives no shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_path, ship_code, shuffle_partitions
from .tokenize import encoder

MAGIC = b"BPLANES1"
BLOCK = 1 << 16
MANIFEST = "shard long, path string, first_doc long, n_docs long, n_ids long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of uint32 ids: 4 of bytes (``bits`` = 8) or 32 of bits (1)."""
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [as_bytes[:, k].tobytes() for k in range(4)]
    return [np.packbits((as_bytes[:, k] >> j) & 1, bitorder="little").tobytes() for k in range(4) for j in range(8)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for p, plane in enumerate(planes):
        if bits == 8:
            out[:, p] = np.frombuffer(plane, np.uint8)
        else:
            out[:, p // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << (p % 8)
    return out.view("<u4").ravel()


class ShardWriter:
    def __init__(self, out, block: int = BLOCK, bits: int = 8, level: int = 3):
        self._out, self._block, self._bits = out, block, bits
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._pending: list[np.ndarray] = []
        self._n_pending = self.n_ids = self.n_blocks = 0
        self._index: list[tuple[int, int, int]] = []
        self._docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._at = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self._at
        self._out.write(data)
        self._at += len(data)
        return at, len(data)

    def add(self, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order, with all their ids one after the other."""
        self._docs.append((doc_ids.astype("<i8"), known.astype(np.uint8), lengths.astype("<u8")))
        self._pending.append(ids)
        self._n_pending += len(ids)
        self.n_ids += len(ids)
        if self._n_pending >= self._block:
            every = np.concatenate(self._pending)
            whole = len(every) // self._block * self._block
            for k in range(0, whole, self._block):
                self._write_block(every[k : k + self._block])
            self._pending, self._n_pending = [every[whole:]], len(every) - whole

    def _write_block(self, ids: np.ndarray) -> None:
        for plane in to_planes(ids, self._bits):
            self._index.append((*self._put(self._zstd.compress(plane)), len(ids)))
        self.n_blocks += 1

    def close(self) -> int:
        """Write what is pending and the tables; returns the file's size."""
        if self._n_pending:
            self._write_block(np.concatenate(self._pending))
        table = b"".join(np.concatenate(x).tobytes() for x in zip(*self._docs, strict=True)) if self._docs else b""
        n_docs = sum(len(x[0]) for x in self._docs)
        docs = self._put(self._zstd.compress(table))
        index = self._put(self._zstd.compress(np.array(self._index, "<u8").tobytes()))
        footer = [*docs, *index, n_docs, self.n_ids, self.n_blocks, self._block, 32 // self._bits, self._bits]
        self._put(np.array(footer, "<u8").tobytes() + MAGIC)
        self._out.close()
        return self._at


class ShardReader:
    """Random access to a shard by block through its chunk index."""

    def __init__(self, source):
        self._source, self._zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        tail = self._read(size - 88, 88)
        if tail[-8:] != MAGIC:
            raise ValueError("not a shard file, or cut short")
        d_at, d_n, i_at, i_n, self.n_docs, self.n_ids, self.n_blocks, self.block, self._planes, self._bits = np.frombuffer(tail[:80], "<u8").tolist()
        table = self._zstd.decompress(self._read(d_at, d_n)) if self.n_docs else b""
        n = self.n_docs
        self.doc_ids = np.frombuffer(table, "<i8", n)
        self.known = np.frombuffer(table, np.uint8, n, 8 * n)
        self.lengths = np.frombuffer(table, "<u8", n, 9 * n).astype(np.int64)
        self.index = np.frombuffer(self._zstd.decompress(self._read(i_at, i_n)) if self.n_blocks else b"", "<u8").reshape(-1, 3)

    def _read(self, at: int, n: int) -> bytes:
        self._source.seek(at)
        return self._source.read(n)

    def read_block(self, k: int) -> np.ndarray:
        chunks = self.index[k * self._planes : (k + 1) * self._planes].tolist()
        data = self._read(chunks[0][0], chunks[-1][0] + chunks[-1][1] - chunks[0][0])
        planes = [self._zstd.decompress(data[at - chunks[0][0] : at - chunks[0][0] + n]) for at, n, _ in chunks]
        return from_planes(planes, chunks[0][2], self._bits)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order, holding a document and a block at a time."""
        block, at, k = np.empty(0, np.uint32), 0, 0
        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.lengths.tolist(), strict=True):
            parts, need = [], n
            while need:
                if at == len(block):
                    block, at, k = self.read_block(k), 0, k + 1
                part = block[at : at + need]
                parts.append(part)
                at, need = at + len(part), need - len(part)
            yield (doc_id if known else None), (parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else block[:0])


def _open(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where, name


def _uri(path: str) -> str:
    """Hadoop writes file:/x, URIs are file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, block: int = BLOCK, bits: int = 8) -> DataFrame:
    """Write shards of ``docs`` (doc_id, text) to ``folder``, in ascending doc_id
    order; returns the manifest: a row per shard, with ``start``, the number of
    ids in all shards before it."""
    spark = docs.sparkSession
    ship_code(spark)
    folder = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer)
        writer, first, n_docs = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                where, name = _open(folder)
                where.create_dir(name, recursive=True)
                name = f"{name}/{uuid.uuid4().hex}.bpl"
                writer = ShardWriter(where.open_output_stream(name), block, bits)
                shard = b["shard"][0].as_py()
            known = b["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            doc_ids = b["doc_id"].fill_null(0).to_numpy()
            for i, j, ids, lengths in pieces.encode_slices([t or "" for t in b["text"].to_pylist()]):
                ids = np.insert(ids, np.cumsum(lengths), np.uint32(end_id))
                writer.add(doc_ids[i:j], known[i:j], lengths + 1, ids)
            first, n_docs = b["doc_id"][0].as_py() if first is None else first, n_docs + b.num_rows
        if writer is not None:
            n_bytes = writer.close()
            row = {"shard": [shard], "path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "first_doc": [first], "n_docs": [n_docs], "n_ids": [writer.n_ids], "n_bytes": [n_bytes]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows of one id are cut by text, equal rows (in any order the same) by chance
    ordered = ordered.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.rand(7))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text")).withColumn("shard", F.spark_partition_id().cast("long"))
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "manifest")
    # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b["path"].to_pylist(), b["start"].to_pylist(), strict=True):
                where, name = _open(path)
                with where.open_input_file(name) as source:
                    shard = ShardReader(source)
                    crcs = [zlib.crc32(ids) for _, ids in shard.documents()]
                    starts = start + np.cumsum(shard.lengths) - shard.lengths
                    ids = pa.array(shard.doc_ids, mask=shard.known == 0)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    ship_code(manifest.sparkSession)
    # a task per shard or so: the shards differ little in size
    spread = manifest.select("path", "start").repartition(shuffle_partitions(manifest.sparkSession))
    return spread.mapInArrow(read, DOCUMENTS)


def op7_token_files(docs: DataFrame, end_id: int = 2) -> DataFrame:
    """Write every document's ids with the public byte-level BPE and read back."""
    import public_tokenizers

    folder = shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id))
