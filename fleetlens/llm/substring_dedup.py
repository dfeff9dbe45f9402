"""Removal of repeated passages: FM-indexes over shards of related passages.

A window of 50 consecutive words of a document is removed if the same words also
start in a document with a smaller id. All documents against all is quadratic,
so passages that can share a window are brought together first:

* In each window one 5-word group, the one with the least hash, is its anchor;
  equal windows have equal anchors. Consecutive windows with the same anchor
  form a passage. Anchors go to buckets as packed arrays; those of one document
  only are done with.
* Passages with an anchor that several documents have are put into shards by
  anchor; equal passages become one with the least id of their documents. An
  anchor of very many documents is split further: its passages are cut into runs
  of a few windows, dealt out by a hash of the words all those windows share.
* A shard's passages go into FM-indexes of bounded size, one anchor's together.
  Backward search gives the least id over the documents each window occurs in;
  where that is smaller than the document's own, the window is removed.

Words are compared by 64-bit hashes inside a shard.

Edge cases: NULL and short texts lose nothing; rows with equal ids are neither
smaller nor larger, so they do not remove each other's words but each lose to
smaller ids; rows with a NULL id have no order and take no part; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, materialize, mix64, ship_code, shuffle_partitions
from .fm_index import FMIndex
from .hashing import range_hashes, slices, window_hashes, word_hashes
from .jaccard_join import bucket_values

WINDOW = 50
GROUP = 5
#: An anchor of more documents than this is split into runs of so many windows.
HOT_DOCUMENTS = 1000
RUN = 8
#: Words of one FM-index, at most (a single anchor may have more).
INDEX_WORDS = 400_000
FLUSH = 1_000_000
#: Bytes of text worked on at a time.
SLICE = 1_500_000
_TEXT = U64(0x9E3779B97F4A7C55)
FLUSH_PASSAGES = 50_000


def anchors(hashes: np.ndarray, firsts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages of texts given by their word hashes: (text, anchor's hash, first
    window, last window, anchor), windows and anchors by their first word."""
    span = window - GROUP + 1
    starts = np.concatenate([np.arange(i, j - window + 1) for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)] or [np.empty(0, np.int64)])
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, np.empty(0, U64), none, none, none
    group = window_hashes(hashes, GROUP)
    # sliding minimum with the leftmost place, doubling the width
    value, place, width = group, np.arange(len(group)), 1
    while width < span:
        by = min(width, span - width)
        later_v, later_p = value[by:], place[by:]
        value, place = value[: len(later_v)], place[: len(later_v)]
        pick = later_v < value
        value, place = np.where(pick, later_v, value), np.where(pick, later_p, place)
        width += by
    text = np.searchsorted(firsts, starts, "right") - 1
    at = place[starts]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(head[1:], len(starts)) - 1
    return text[head], group[at[head]], starts[head], starts[last], at[head]


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _send_anchors(values: list[int], window: int):
    buckets = np.array(values, np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush():
            anchor, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            to = (anchor >> U64(32)).astype(np.int64) % len(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(len(buckets) + 1))
            rows = [(int(buckets[k]), anchor[order[i:j]].tobytes(), doc[order[i:j]].tobytes()) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "anchors", "docs"])

        for b in batches:
            texts, ids = _bytes_of(b["text"]), b["doc_id"].to_numpy()
            for i, j in slices(texts, SLICE):
                hashes, firsts, _, _ = word_hashes(texts[i:j])
                text, anchor, _, _, _ = anchors(hashes, firsts, window)
                if len(text):
                    held.append((anchor, ids[i:j][text]))
                    n += len(text)
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return send


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its anchors that other documents have too; the lowest bit of
    an anchor says whether very many have it."""
    anchor, doc = [], []
    for b in batches:
        anchor += [np.frombuffer(x, U64) for x in b["anchors"].to_pylist()]
        doc += [np.frombuffer(x, np.int64) for x in b["docs"].to_pylist()]
    if not anchor:
        return
    anchor, doc = np.concatenate(anchor), np.concatenate(doc)
    order = np.argsort(anchor)
    a = anchor[order]
    multi = np.concatenate([[False], a[1:] == a[:-1]]) | np.concatenate([a[1:] == a[:-1], [False]])
    anchor, doc = a[multi], doc[order][multi]
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    if not len(anchor):
        return
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    anchor, doc = anchor[new], doc[new]
    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.repeat(np.diff(np.append(head, len(anchor))), np.diff(np.append(head, len(anchor))))
    shared = n > 1
    anchor, doc, hot = anchor[shared], doc[shared], n[shared] > HOT_DOCUMENTS
    anchor = (anchor & ~U64(1)) | hot.astype(U64)
    order = np.argsort(doc, kind="stable")
    doc, anchor = doc[order], anchor[order]
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    ends = np.append(head[1:], len(doc))
    for k in range(0, len(head), 5000):
        part = list(zip(head[k : k + 5000].tolist(), ends[k : k + 5000].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(doc[head[k : k + 5000]]), pa.array([anchor[i:j].tobytes() for i, j in part], pa.binary())], ["doc_id", "anchors"])


def _passages(window: int):
    """Rows of two kinds: a passage (shard, passage, words, least and greatest
    id), once per task and flush; and where a document holds it (doc_id, row_key,
    first window's first word, passage)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}

        def flush():
            rows = [(s, p, w, lo, hi) for p, (s, w, lo, hi) in known.items()]
            known.clear()
            s, p, w, lo, hi = zip(*rows, strict=True)
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(p, pa.int64()), pa.array(w, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), none, none], names)

        names = ["shard", "passage", "words", "least", "greatest", "row_key", "at"]
        for b in batches:
            texts, doc_ids, row_keys = _bytes_of(b["text"]), b["doc_id"].to_numpy(), b["row_key"].to_numpy()
            wanted = [np.concatenate([np.frombuffer(x, U64) for x in some]) for some in b["anchors"].to_pylist()]
            for i, j in slices(texts, SLICE):
                part = texts[i:j]
                data = b"\n".join([*part, b""])
                hashes, firsts, starts, ends = word_hashes(part)
                text, anchor, low, high, at = anchors(hashes, firsts, window)
                # keep passages whose anchor the document shares
                sent = [wanted[i + t] for t in range(len(part))]
                sent_of = np.repeat(np.arange(len(part)), [len(w) for w in sent])
                sent = np.concatenate(sent)
                there = mix64((sent & ~U64(1)) + sent_of.astype(U64) * _TEXT)
                order = np.argsort(there)
                there, very = there[order], (sent & U64(1) == 1)[order]
                mine = anchor & ~U64(1)
                wants = mix64(mine + text.astype(U64) * _TEXT)
                k = np.minimum(np.searchsorted(there, wants), max(len(there) - 1, 0))
                keep = there[k] == wants if len(there) else np.zeros(len(wants), bool)
                text, mine, low, high, at, hot = text[keep], mine[keep], low[keep], high[keep], at[keep], very[k[keep]]
                # an anchor of very many documents: runs of RUN windows, counted by
                # their distance to the anchor so that equal windows are in equal
                # runs; all windows of a run share the words of its core
                near, far = (at - high) // RUN, (at - low) // RUN
                n_runs = np.where(hot, far - near + 1, 1)
                of = np.repeat(np.arange(len(text)), n_runs)
                run = near[of] + np.arange(len(of)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
                first = np.where(hot[of], np.maximum(low[of], at[of] - run * RUN - RUN + 1), low[of])
                last = np.where(hot[of], np.minimum(high[of], at[of] - run * RUN), high[of])
                core_at = np.where(hot[of], at[of] - run * RUN, first)
                text, mine, hot = text[of], mine[of], hot[of]
                passage = range_hashes(hashes, first, last + window) + mine
                core = range_hashes(hashes, core_at, core_at + window - RUN + 1)
                shard = np.where(hot, core + mine, mine)
                passage, shard = (mix64(passage) >> U64(1)).astype(np.int64), (mix64(shard) >> U64(1)).astype(np.int64)
                doc = doc_ids[i:j][text]
                for p, sh, x, y, d in zip(passage.tolist(), shard.tolist(), starts[first].tolist(), ends[last + window - 1].tolist(), doc.tolist(), strict=True):
                    seen = known.get(p)
                    if seen is None:
                        known[p] = [sh, data[x:y], d, d]
                    elif d < seen[2]:
                        seen[2] = d
                    elif d > seen[3]:
                        seen[3] = d
                if len(passage):
                    none = pa.nulls(len(passage), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, pa.array(passage), pa.nulls(len(passage), pa.binary()), pa.array(doc), none, pa.array(row_keys[i:j][text]), pa.array(first - firsts[text])], names)
                if len(known) >= FLUSH_PASSAGES:
                    yield flush()
        if known:
            yield flush()

    return cut


def _search(window: int):
    """Per passage the least id of each of its windows, where that can matter."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for b in batches:
            for s, p, w, lo, hi in zip(b["shard"].to_pylist(), b["passage"].to_pylist(), b["words"].to_pylist(), b["least"].to_pylist(), b["greatest"].to_pylist(), strict=True):
                seen = known.get(p)
                if seen is None:
                    known[p] = [s, w, lo, hi, p]
                else:
                    seen[2], seen[3] = min(seen[2], lo), max(seen[3], hi)
        todo = sorted(known.values(), key=lambda x: (x[0], x[4]))
        known = {}
        i = 0
        while i < len(todo):
            j, size = i, 0
            while j < len(todo) and (size < INDEX_WORDS or todo[j][0] == todo[j - 1][0]):
                size += todo[j][1].count(b" ") + todo[j][1].count(b"\n") + 1
                j += 1
            some = todo[i:j]
            i = j
            hashes, firsts, _, _ = word_hashes([x[1] for x in some])
            _, symbols = np.unique(hashes, return_inverse=True)
            least = np.array([x[2] for x in some], np.int64)
            greatest = np.array([x[3] for x in some], np.int64)
            found = FMIndex(symbols, firsts, least, window).least_owners()
            n = np.diff(firsts) - window + 1
            head = np.cumsum(n) - n
            use = np.minimum.reduceat(found, head) < greatest
            mins = [found[a : a + c].tolist() for a, c in zip(head[use].tolist(), n[use].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[4] for x, u in zip(some, use.tolist(), strict=True) if u], pa.int64()), pa.array(mins, pa.list_(pa.int64()))], ["passage", "mins"])

    return search


def _clean(window: int, texts: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = start = 0
            rows = []
            for i in range(b.num_rows):
                words = (b["text"][i].as_py() or "").encode().split()
                size += sum(map(len, words))
                starts = b["starts"][i].as_py()
                n_lost, kept = 0, words
                if starts:
                    s = np.unique(np.array(starts, np.int64))
                    gone = np.zeros(len(words) + 1, np.int64)
                    gone[s] += 1
                    np.subtract.at(gone, s + window, 1)
                    lost = np.cumsum(gone)[:-1] > 0
                    n_lost, kept = int(lost.sum()), [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
                joined = b" ".join(kept)
                rows.append((len(words), n_lost, hashlib.sha256(joined).hexdigest(), *([joined.decode()] if texts else [])))
                if size >= SLICE or i == b.num_rows - 1:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([b["doc_id"][start : i + 1], *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]], names)
                    rows, size, start = [], 0, i + 1

    return clean


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row_key, start): first words of the windows to remove; row_key
    tells rows with equal ids apart by their text."""
    if window < GROUP + RUN:
        raise ValueError(f"windows have {GROUP + RUN} words or more")
    spark = docs.sparkSession
    ship_code(spark)
    n = shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    sent = docs.mapInArrow(_send_anchors(bucket_values(spark, n), window), "bucket long, anchors binary, docs binary")
    shared = sent.repartition(n, "bucket").mapInArrow(_shared_anchors, "doc_id long, anchors binary")
    shared = materialize(shared.groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors")), "anchors")
    chosen = docs.join(shared, "doc_id").select("doc_id", F.xxhash64("text").alias("row_key"), "text", "anchors")
    cut = materialize(chosen.mapInArrow(_passages(window), "shard long, passage long, words binary, least long, greatest long, row_key long, at long"), "passages")
    shards = cut.filter("shard IS NOT NULL").select("shard", "passage", "words", "least", "greatest")
    found = shards.repartition(n, "shard").mapInArrow(_search(window), "passage long, mins array<long>")
    held = cut.filter("shard IS NULL").select(F.col("least").alias("doc_id"), "row_key", "at", "passage").distinct()
    starts = held.join(found, "passage").select("doc_id", "row_key", "at", F.posexplode("mins").alias("k", "least"))
    return starts.filter("least < doc_id").select("doc_id", "row_key", (F.col("at") + F.col("k")).alias("start"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 and, with
    ``texts``, kept_text."""
    starts = repeated_windows(docs, window).groupBy("doc_id", "row_key").agg(F.collect_list("start").alias("starts"))
    starts = materialize(starts.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "starts"), "starts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = rows.join(starts, (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("k")), "left").select("doc_id", "text", "starts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return joined.mapInArrow(_clean(window, texts), schema)
