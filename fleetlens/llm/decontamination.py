"""Benchmark decontamination by the q-gram lemma.

Texts are normalised (A-Z lower-cased, runs of other ASCII than letters and
digits to one space). Every start of a benchmark item (each ``step``-th, 1 by
default) has a window of ``window`` characters; a document leaks an item if one of
its windows occurs in it with at most ``edits`` edit operations.

If it does, at least window + 1 - q * (edits + 1) of the window's q-grams are
found unchanged, and on diagonals (place in the text minus place in the window)
no more than ``edits`` apart. So the q-grams shared with an item are put in
overlapping bands of diagonals, in order of their place; the windows that hold
enough of a band are verified by an alignment confined to its diagonals. Windows of
an item share its q-grams. The bound is a lemma: no leak is lost.

The q-grams of the benchmark are a small table; it is sent to the tasks in blocks
of at most ``block_grams``, each block against all documents, whatever its size.
Documents are read whole, are never shuffled, and no pair of all is formed. What a
task finds is worked on in runs of about ``hits`` entries, which overlap by the
longest match, so that a passage in many items and documents takes bounded memory.

Edge cases: NULL and empty texts leak nothing; items with fewer than
``min_length`` normalised characters occur by chance, so only a document that is
such an item as a whole leaks it; items without a letter or digit are left out;
items with a NULL id are searched too and reported with NULL; equal items are
reported each; rows with equal ids are reported each; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, materialize, ship_code
from .hashing import slices, window_hashes

LEAKS = "doc_id long, item_id long, n_windows long, min_edits long, first_at long"
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Characters of a window that are aligned first, from its end.
LOOK = 24


@dataclass(frozen=True)
class LeakConfig:
    q: int = 10
    window: int = 64
    edits: int = 4
    step: int = 1
    band: int = 8
    min_length: int = 24
    block_grams: int = 2_000_000
    hits: int = 1_000_000


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(_CLEAN).split())


@dataclass
class Index:
    """Items of a block, one text after the other, and their q-grams."""

    ids: list[int | None]  # id of each item
    text: np.ndarray  # bytes of all items
    begin: np.ndarray  # where each item begins, and the end
    size: np.ndarray  # length of each item's windows
    edits: np.ndarray  # edits allowed in them
    bound: np.ndarray  # q-grams that must be shared
    grams: np.ndarray  # sorted distinct q-gram hashes
    first: np.ndarray  # per gram: first entry below
    entry_item: np.ndarray
    entry_place: np.ndarray
    maybe: np.ndarray  # filter by a hash's top bits
    short: dict[bytes, list[int | None]]  # ids of the items under min_length, by their text


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    return window_hashes(data.astype(U64) + U64(1), q)


def build_index(items: list[tuple[int | None, bytes]], cfg: LeakConfig) -> Index:
    short: dict[bytes, list[int | None]] = {}
    for i, text in items:
        if 0 < len(text) < cfg.min_length:
            short.setdefault(text, []).append(i)
    items = [(i, text) for i, text in items if len(text) >= cfg.min_length]
    edits = []
    for _, text in items:
        n = min(cfg.window, len(text))
        allowed = cfg.edits * n // cfg.window
        while n + 1 - cfg.q * (allowed + 1) < 1:
            allowed -= 1
        edits.append(allowed)
    texts = [np.frombuffer(text, np.uint8) for _, text in items]
    hashes = [gram_hashes(t, cfg.q) for t in texts]
    every = np.concatenate(hashes) if hashes else np.empty(0, U64)
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    n = np.array([len(h) for h in hashes], np.int64)
    item = np.repeat(np.arange(len(items)), n)[order]
    place = (np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n))[order]
    maybe = np.zeros(1 << 20, bool)
    maybe[grams >> U64(44)] = True
    e = np.array(edits, np.int64)
    length = np.array([len(t) for t in texts], np.int64)
    size = np.minimum(length, cfg.window)
    text = np.concatenate(texts) if texts else np.empty(0, np.uint8)
    return Index([i for i, _ in items], text, np.concatenate([[0], np.cumsum(length)]), size, e, size + 1 - cfg.q * (e + 1), grams, np.append(first, len(every)), item, place, maybe, short)


def known_grams(data: np.ndarray, index: Index, cfg: LeakConfig, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(place in the text, number) of the q-grams that occur in an item."""
    at, gram = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(0, max(len(data) - cfg.q + 1, 0), chunk):
        h = gram_hashes(data[start : start + chunk + cfg.q - 1], cfg.q)
        some = np.flatnonzero(index.maybe[h >> U64(44)])
        g = np.searchsorted(index.grams, h[some])
        g[g == len(index.grams)] = 0
        hit = index.grams[g] == h[some]
        at.append(some[hit] + start)
        gram.append(g[hit])
    return np.concatenate(at), np.concatenate(gram)


def hit_runs(at: np.ndarray, gram: np.ndarray, index: Index, cfg: LeakConfig) -> Iterator[tuple[int, int]]:
    """Runs of known q-grams with about ``hits`` entries (or a stretch of text of
    twice the longest match); a run begins so far before the end of the one before
    it that the q-grams of every match lie whole in one of them."""
    reach = cfg.window + cfg.band + 2 * cfg.edits
    total = np.concatenate([[0], np.cumsum(index.first[gram + 1] - index.first[gram])])
    i = j = 0
    while j < len(at):
        j = max(int(np.searchsorted(total, total[i] + cfg.hits, "right")) - 1, int(np.searchsorted(at, at[i] + 2 * reach)))
        yield i, j
        if j < len(at):
            i = int(np.searchsorted(at, at[j] - reach))


def candidate_bands(at: np.ndarray, gram: np.ndarray, index: Index, cfg: LeakConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start of the window, band number) of the windows that reach the
    bound in a band of diagonals; band k has the diagonals from k * band, band +
    edits of them."""
    none = np.empty(0, np.int64)
    n = index.first[gram + 1] - index.first[gram]
    entry = np.arange(n.sum()) + np.repeat(index.first[gram] - (np.cumsum(n) - n), n)
    item, place = index.entry_item[entry], index.entry_place[entry]
    band, inside = np.divmod(np.repeat(at, n) - place, cfg.band)
    also = np.flatnonzero(inside < cfg.edits)
    item, place, band = np.concatenate([item, item[also]]), np.concatenate([place, place[also]]), np.concatenate([band, band[also] - 1])
    if not len(band):
        return none, none, none
    low = int(band.min())
    width = int(band.max()) - low + 1
    key = item * width + (band - low)
    # only groups with enough q-grams in all are put in order
    _, number, total = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(total[number] >= index.bound[item])
    some = some[np.lexsort((place[some], key[some]))]
    key, place, item = key[some], place[some], item[some]
    # a window reaches the bound if it holds some q-gram and the (bound - 1) next
    # ones: the starts that do are a range, and the ranges of a group rise
    last = np.arange(len(key)) + index.bound[item] - 1
    ok = np.flatnonzero(last < len(key))
    ok = ok[(key[last[ok]] == key[ok]) & (place[last[ok]] - place[ok] <= index.size[item[ok]] - cfg.q)]
    if not len(ok):
        return none, none, none
    key, item, final = key[ok], item[ok], np.diff(index.begin)[item[ok]] - index.size[item[ok]]
    start = np.maximum(place[last[ok]] - (index.size[item] - cfg.q), 0)
    stop = np.minimum(place[ok], final) + 1
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    start[same] = np.maximum(start[same], stop[same - 1])
    n = np.maximum(stop - start, 0)
    start = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
    key, item, final = np.repeat(key, n), np.repeat(item, n), np.repeat(final, n)
    use = (start % cfg.step == 0) | (start == final)
    return item[use], start[use], key[use] % width + low


def align(data: np.ndarray, index: Index, item: np.ndarray, start: np.ndarray, band: np.ndarray, cfg: LeakConfig) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each window within its band, and where that match ends; a
    window with more edits than allowed may get a large number instead.

    All candidates of one window length advance together, character by character,
    holding only the diagonals of the band and its margins. First their last
    ``LOOK`` characters are aligned from the end: a window whose end costs too much
    (as where a passage stops being the same) need not be aligned whole."""
    best, end = np.full(len(item), 1 << 30), np.zeros(len(item), np.int64)
    size, begin, edits = index.size[item], index.begin[item] + start, index.edits[item]
    width = cfg.band + 3 * cfg.edits
    shift = cfg.window + 2 * width
    padded = np.concatenate([np.zeros(shift, np.uint8), data, np.zeros(shift, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)
    step = np.arange(width, dtype=np.int16)[:, None]
    for n in np.unique(size).tolist():
        for part in np.array_split(which := np.flatnonzero(size == n), len(which) // 20_000 + 1):
            patterns = index.text[begin[part] + np.arange(n)[:, None]]
            low = band[part] * cfg.band + start[part] - cfg.edits
            for ahead in (False, True):
                cost = np.zeros((width, len(part)), np.int16)
                for k in range(n if ahead else min(n, LOOK)):
                    i = k if ahead else n - 1 - k
                    new = cost + (rows[low + (i + shift)].T != patterns[i])
                    if ahead:
                        np.minimum(new[:-1], cost[1:] + 1, out=new[:-1])
                        cost = np.minimum.accumulate(new - step, axis=0) + step
                    else:
                        np.minimum(new[1:], cost[:-1] + 1, out=new[1:])
                        cost = np.minimum.accumulate((new + step)[::-1], axis=0)[::-1] - step
                    if k % 8 == 7:
                        keep = np.flatnonzero(cost.min(axis=0) <= edits[part])
                        if len(keep) < len(part):
                            part, low, patterns, cost = part[keep], low[keep], patterns[:, keep], cost[:, keep]
            if len(part):
                k = cost.argmin(axis=0)
                best[part] = cost[k, np.arange(len(part))]
                end[part] = low + k + n
    return best, end


def find_leaks(texts: list[bytes], index: Index, cfg: LeakConfig) -> list[tuple[int, int | None, int, int, int]]:
    """(text number, item, windows found, least edits, end of the first match)."""
    out = [(t, i, 1, 0, len(text)) for t, text in enumerate(texts) for i in index.short.get(text, ())]
    if not len(index.grams):
        return out
    gap = b"\x00" * (cfg.edits + 1)  # a match cannot reach over it
    data = np.frombuffer(gap.join([*texts, b""]), np.uint8)
    starts = np.cumsum([0, *[len(t) + len(gap) for t in texts]])
    at, gram = known_grams(data, index, cfg)
    found: dict[tuple[int, int], list] = {}
    for i, j in hit_runs(at, gram, index, cfg):
        item, start, band = candidate_bands(at[i:j], gram[i:j], index, cfg)
        if not len(item):
            continue
        best, end = align(data, index, item, start, band, cfg)
        ok = best <= index.edits[item]
        item, window, best, end = item[ok], start[ok], best[ok], end[ok]
        text = np.searchsorted(starts, end - 1, "right") - 1
        for t, k, w, b, e in zip(text.tolist(), item.tolist(), window.tolist(), best.tolist(), (end - starts[text]).tolist(), strict=True):
            f = found.setdefault((t, k), [set(), b, e])
            f[0].add(w)
            f[1], f[2] = min(f[1], b), min(f[2], e)
    return out + [(t, index.ids[k], len(ws), b, e) for (t, k), (ws, b, e) in sorted(found.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """A row for each document and item it leaks: doc_id, item_id, n_windows,
    min_edits, first_at (end of the first match, in normalised characters)."""
    spark = docs.sparkSession
    ship_code(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # blocks of items whose lengths add up to at most block_grams each
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = int(total) // cfg.block_grams + 1

    def scan(items: list[tuple[int | None, bytes]]) -> DataFrame:
        index = spark.sparkContext.broadcast(build_index(items, cfg))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [normalise(t) for t in b["text"].to_pylist()]
                for i, j in slices(texts):
                    found = find_leaks(texts[i:j], index.value, cfg)
                    if found:
                        t, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array([i + k for k in t])), *[pa.array(x, pa.int64()) for x in rest]], ["doc_id", "item_id", "n_windows", "min_edits", "first_at"])

        return docs.mapInArrow(run, LEAKS)

    parts = []
    for k in range(n_blocks):
        block = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        items = [(r["item_id"], t) for r in block if (t := normalise(r["text"]))]
        if items:
            parts.append(scan(sorted(items, key=lambda r: (r[0] is None, r[0] or 0, r[1]))))
    return reduce(DataFrame.unionByName, parts) if parts else docs.limit(0).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("item_id", "n_windows", "min_edits", "first_at")])


def drop_leaking(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """Pipeline form: documents that leak any item go (rows with a NULL id are
    told apart by their text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = leaks(docs.select(F.xxhash64(key).alias("doc_id"), "text"), benchmark, cfg)
    bad = materialize(found.select(F.col("doc_id").alias("__leak_key")).distinct(), "leaks")
    return docs.join(bad, F.xxhash64(key) == bad["__leak_key"], "left_anti")
