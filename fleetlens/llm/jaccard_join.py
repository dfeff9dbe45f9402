"""Near duplicates by word shingles: an exact Jaccard join with partitioned sets.

Sets of distinct 5-word shingles link when |A n B| >= 0.8 |A u B|, so two linked
sets differ in at most (|A| + |B|) / 9 shingles. Sizes fall into bands so that
linked sets are in the same or in neighbouring bands; each band cuts the
universe of shingles into segments by hash, more than linked sets can differ
in. By the pigeonhole principle a linked pair agrees on some segment among any
(difference bound + 1) of them, or nearly agrees on one counted twice.

* The larger set chooses (allocates) which of its segments to look up: those
  expected to be rarest, i.e. with most shingles, one by one until the bound is
  covered. In the bands of small sets a segment may also be looked up with its
  one-deletion neighbourhood, which counts for two; empty segments, which many
  sets share, come last.
* Keys of all segments go to buckets as packed arrays; a bucket task sorts its
  keys and reports classes that meet under a key.
* Candidates are verified exactly, on the whole sets. First every class against
  the few others it meets most often. Then, in rounds, what met under a key and
  is still in different components: small groups pair by pair, the members of
  larger ones against one pivot P, that of them which met most others under all
  keys, as the unedited original of near copies does.
  The differences to the pivot settle the rest: with A = x - P and R = P - x,
  two sets that do not both link with P can only link if they share an element
  of A, or, where one is shorter than P, enough elements of R
  (``_difference_keys`` has the bounds). Classes that share such elements form
  the groups of the next round. So a family of near copies costs rows in its
  members, not in their pairs. What ROUNDS rounds leave goes to blocks of a
  bounded size, by the first pivot of each class, compared block by block. Pairs inside a component cannot change
  the result and are not tested; no link between components is lost.

Documents with equal sets form one class from the start; a task sends each
class once. Shingles are compared by 64-bit hashes.

Edge cases: NULL, empty and blank texts have no shingles and are linked with
nothing; rows with equal ids each get a row; NULL ids join classes but name a
component only if it has no other id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, discard, materialize, mix64, ship_code, shuffle_partitions
from .hashing import slices, window_hashes, word_hashes

WORDS = 5
#: Bands whose sets have at most this many shingles index one-deletion neighbourhoods.
NEIGHBOURHOOD_SIZE = 40
#: Classes each class is verified against in the first round.
FIRST_PARTNERS = 3
#: Rounds of comparing with pivots; groups up to SMALL_GROUP are compared pair by pair.
ROUNDS, SMALL_GROUP = 2, 8
#: Classes and shingles of a block, for what the rounds leave.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 200_000
#: Classes of a group in one row.
CHUNK = 4096
#: Keys a task gathers before it sends them.
FLUSH_KEYS = 800_000
#: Rows a task of a step without sets has about, and tasks of such a step at least.
ROWS_A_TASK, LEAST_TASKS = 2000, 12

_SEGMENT, _BAND, _SPACE = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F)
NO_ID = -(2**63)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each (lower-cased) text."""
    hashes, firsts, _, _ = word_hashes(texts)
    windows = window_hashes(hashes, WORDS)
    out = []
    for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if j - i >= WORDS:
            out.append(np.unique(windows[i : j - WORDS + 1]))
        elif j > i:
            out.append(window_hashes(hashes[i:j], j - i) ^ U64(j - i))
        else:
            out.append(np.empty(0, U64))
    return out


def set_class(s: np.ndarray) -> int:
    """A 62-bit fingerprint of a whole set (0 for the empty set)."""
    if not len(s):
        return 0
    total = np.add.reduce(mix64(s), keepdims=True)
    parity = np.bitwise_xor.reduce(mix64(s + _SPACE), keepdims=True)
    return int(mix64((total ^ parity * _BAND) + U64(len(s)))[0] >> U64(2)) or 1


def size_bands(largest: int) -> np.ndarray:
    """Lowest sizes of the bands up to ``largest``: linked sizes (4/5 at least)
    are at most one band apart."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(lows[-1] * 5 // 4 + 1)
    return np.array(lows, np.int64)


def band_keys(tokens: np.ndarray, lengths: np.ndarray, band: np.ndarray, lows: np.ndarray, need: np.ndarray, index: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the sets in ``tokens`` (one after the other) for one band each:
    (key, set number, flags), flag 1: found by look-ups, flag 2: looks up.
    ``need`` is how many segments a set must look up."""
    high = lows[band + 1] - 1
    differ = (high + high * 5 // 4) // 9
    n_segments = (differ + 1) * 23 // 20 + 1
    first = np.cumsum(n_segments) - n_segments
    owner = np.repeat(np.arange(len(lengths)), lengths)
    salted = mix64(tokens ^ (band.astype(U64) * _BAND)[owner])
    segment = first[owner] + (((salted >> U64(32)) * n_segments.astype(U64)[owner]) >> U64(32)).astype(np.int64)
    total = int(n_segments.sum())
    count = np.bincount(segment, minlength=total)
    value = np.zeros(total, U64)
    weight = mix64(salted)
    np.add.at(value, segment, weight)
    of_set = np.repeat(np.arange(len(lengths)), n_segments)
    tag = (np.arange(total) - first[of_set]).astype(U64) * _SEGMENT + band.astype(U64)[of_set] * _BAND
    # allocation: most shingles first, empty segments last
    order = np.lexsort((-count, of_set))
    rank = np.empty(total, np.int64)
    rank[order] = np.arange(total) - first[of_set[order]]
    filled = np.bincount(of_set[count > 0], minlength=len(lengths))
    small = high <= NEIGHBOURHOOD_SIZE
    doubles = np.bincount(of_set[count > 1], minlength=len(lengths))
    raised = np.where(small, np.minimum(np.maximum(need - filled, 0), doubles), 0)
    plain = need - raised
    looks = rank < plain[of_set]
    flags = np.where(looks, 2, 0) + (1 if index else 0)
    out = [(mix64(value + tag), of_set, flags)]
    if index and small.any():
        # sets with one shingle more than a looked-up segment
        t = np.flatnonzero(small[owner])
        out.append((mix64(value[segment[t]] - weight[t] + tag[segment[t]] + _SPACE), owner[t], np.ones(len(t), np.int64)))
    if raised.any():
        up = (rank < raised[of_set]) & (count > 1)
        u = np.flatnonzero(up)
        out.append((mix64(value[u] + tag[u] + _SPACE), of_set[u], np.full(len(u), 2)))
        t = np.flatnonzero(up[segment])
        out.append((mix64(value[segment[t]] - weight[t] + tag[segment[t]]), owner[t], np.full(len(t), 2)))
    key, who, flag = (np.concatenate(x) for x in zip(*out, strict=True))
    used = flag > 0
    return key[used], who[used], flag[used]


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of non-empty sets for their own band and the band below."""
    lengths = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    lows = size_bands(int(lengths.max()))
    band = np.searchsorted(lows, lengths, "right") - 1
    own = band_keys(tokens, lengths, band, lows, 2 * lengths // 9 + 1, True)
    low = lows[band]
    below = np.flatnonzero((band > 0) & (4 * lengths <= 5 * (low - 1)))
    if not len(below):
        return own
    part = tokens[np.repeat(np.isin(np.arange(len(sets)), below), lengths)]
    need = (lengths + low - 1)[below] // 9 + 1
    key, who, flag = band_keys(part, lengths[below], band[below] - 1, lows, need, False)
    return tuple(np.concatenate(x) for x in zip(own, (key, below[who], flag), strict=True))


def _lower(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode().lower() for t in texts.to_pylist()]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = _lower(b["text"])
        for i, j in slices(texts):
            sets = shingle_sets(texts[i:j])
            yield pa.RecordBatch.from_arrays([b["doc_id"][i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_class(s) for s in sets], pa.int64())], ["doc_id", "n_shingles", "class"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, want = _lower(b["text"]), b["class"].to_pylist()
        for i, j in slices(texts):
            found = [(c, s) for s, c in zip(shingle_sets(texts[i:j]), want[i:j], strict=True) if set_class(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["class", "shingles"])


_bucket_values: dict[int, list[int]] = {}


def bucket_values(spark: SparkSession, n: int) -> list[int]:
    """A value for each of ``n`` partitions that Spark's hash sends there."""
    if n in _bucket_values:
        return _bucket_values[n]
    got = spark.range(40 * n + 400).selectExpr(f"pmod(hash(id), {n}) AS p", "id").groupBy("p").agg(F.min("id").alias("id")).collect()
    _bucket_values[n] = [r["id"] for r in sorted(got, key=lambda r: r["p"])]
    return _bucket_values[n]


def _packet(held: list[tuple[np.ndarray, np.ndarray]], buckets: np.ndarray) -> pa.RecordBatch:
    """Gathered keys and their tags, one row per bucket; empties ``held``."""
    key, tag = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    to = (key >> U64(32)).astype(np.int64) % len(buckets)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(len(buckets) + 1))
    rows = [(int(buckets[k]), key[order[i:j]].tobytes(), tag[order[i:j]].tobytes()) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "keys", "tags"])


def _send(values: list[int]):
    buckets = np.array(values, np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        for b in batches:
            texts = _lower(b["text"])
            for i, j in slices(texts):
                new = []
                for s in shingle_sets(texts[i:j]):
                    c = set_class(s)
                    if c and c not in seen:
                        seen.add(c)
                        new.append((c, s))
                if not new:
                    continue
                key, who, flag = set_keys([s for _, s in new])
                held.append((key, np.array([c for c, _ in new], U64)[who] << U64(2) | flag.astype(U64)))
                n += len(key)
                if n >= FLUSH_KEYS:
                    yield _packet(held, buckets)
                    n = 0
        if held:
            yield _packet(held, buckets)

    return send


MET_COLUMNS = ["bucket", "a", "b", "n_keys", "n_two", "g", "members"]
MET = "bucket long, a binary, b binary, n_keys binary, n_two binary, g long, members binary"


def _meet(values: list[int]):
    """Classes that meet under a key: pairs of each group's centre with the others
    (a, b, number of keys, of these with no third class), packed into a row for each
    bucket of b, and groups of three or more (g, a fingerprint of the group, and its
    classes in chunks)."""
    buckets = np.array(values, np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tags = [], []
        for b in batches:
            keys += [np.frombuffer(x, U64) for x in b["keys"].to_pylist()]
            tags += [np.frombuffer(x, U64) for x in b["tags"].to_pylist()]
        if not keys:
            return
        key, tag = np.concatenate(keys), np.concatenate(tags)
        keys = tags = None
        order = np.argsort(key)
        key = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        multi = same[1:] | same[:-1]
        key, tag = key[multi], tag[order][multi]
        order = np.lexsort((tag, key))
        key, tag = key[order], tag[order]
        if not len(key):
            return
        # one entry for each key and class, with all its flags
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tag[1:] >> U64(2) != tag[:-1] >> U64(2))]))
        flag = np.bitwise_or.reduceat(tag & U64(3), start)
        key, who = key[start], (tag[start] >> U64(2)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([head, [len(key)]]))
        looked = np.bitwise_or.reduceat(flag, head) & U64(2) > 0
        of = np.repeat(np.arange(len(head)), size)
        use = (looked & (size > 1))[of]
        # a group's centre: the class that met most others in this bucket, as the
        # unedited original of near copies does
        _, number = np.unique(who, return_inverse=True)
        met = np.bincount(number, weights=(size[of] - 1) * use)[number]
        centre = np.lexsort((-who, met, of))[head + size - 1]
        other = use & (np.arange(len(key)) != centre[of])
        a, b = who[centre[of[other]]], who[other]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
        n = np.diff(np.concatenate([first, [len(a)]]))
        two = np.add.reduceat((size[of[other]][order] == 2).astype(np.int64), first) if len(first) else n
        a, b = a[first], b[first]
        # each class goes with itself and with how often it met others: a family may have
        # one key in a bucket, so only the sum over all buckets tells its original
        alone, at = np.unique(who[use], return_index=True)
        a, b = np.concatenate([a, alone]), np.concatenate([b, alone])
        n, two = np.concatenate([n, met[use][at].astype(np.int64)]), np.concatenate([two, np.zeros(len(alone), np.int64)])
        to = mix64(b.view(U64)) % U64(len(buckets))
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(len(buckets) + 1))
        packed = [(int(buckets[k]), order[i:j]) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        none = pa.nulls(len(packed), pa.int64())
        columns = [pa.array([x[o].tobytes() for _, o in packed], pa.binary()) for x in (a, b, n, two)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed], pa.int64()), *columns, none, pa.nulls(len(packed), pa.binary())], MET_COLUMNS)
        groups: set[int] = set()
        held: list[tuple[int, bytes]] = []

        def rows() -> pa.RecordBatch:
            none = [pa.nulls(len(held), pa.int64()), *[pa.nulls(len(held), pa.binary())] * 4]
            out = pa.RecordBatch.from_arrays([*none, pa.array([g for g, _ in held], pa.int64()), pa.array([m for _, m in held], pa.binary())], MET_COLUMNS)
            held.clear()
            return out

        for i in np.flatnonzero(looked & (size > 2)).tolist():
            classes = who[head[i] : head[i] + size[i]]
            g = set_class(classes.view(U64))
            if g not in groups:
                groups.add(g)
                held += [(g, classes[k : k + CHUNK].tobytes()) for k in range(0, len(classes), CHUNK)]
                if len(held) >= 1000:
                    yield rows()
        if held:
            yield rows()

    return meet


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs (a, b) of this bucket those that a later step asks for: with the
    classes that met b most often (``rank``: their place; ``hub``: the very first, of
    equal ones the greatest), those that met under a key with no third class, and each
    class with itself (no rank; ``met``: how often it met others under all keys). So a
    class costs a few rows, whatever it met."""
    held = [[], [], [], []]
    for batch in batches:
        for x, name in zip(held, ("a", "b", "n_keys", "n_two"), strict=True):
            x += [np.frombuffer(m, np.int64) for m in batch[name].to_pylist()]
    if not held[0]:
        return
    a, b, n, two = (np.concatenate(x) for x in held)
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    n, two, a, b = np.add.reduceat(n[order], first), np.add.reduceat(two[order], first), a[first], b[first]
    other = a != b
    order = np.lexsort((a, -n, ~other, b))
    a, b, n, two, other = (x[order] for x in (a, b, n, two, other))
    head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    size = np.diff(np.concatenate([head, [len(b)]]))
    rank = np.arange(len(b)) - np.repeat(head, size) + 1
    best = other & (n == np.repeat(n[head], size))
    hub = best & np.concatenate([~(best[1:] & (b[1:] == b[:-1])), [True]])
    keep = ~other | (rank <= FIRST_PARTNERS) | hub | (two > 0)
    rank, met = pa.array(rank, mask=~other), pa.array(n, mask=other)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(two), rank, pa.array(hub), met], ["a", "b", "n_two", "rank", "hub", "met"]).filter(pa.array(keep))


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                low, high = sorted((len(x), len(y)))
                ok = 100 * low >= percent * high
                if ok:
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok = 100 * common >= percent * (low + high - common)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of a few columns without sets, in tasks of about ROWS_A_TASK rows: small
    steps don't write a file for each shuffle partition."""
    return df.coalesce(min(shuffle_partitions(df.sparkSession), max(LEAST_TASKS, rows // ROWS_A_TASK)))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return both.coalesce(shuffle_partitions(sets.sparkSession)).mapInArrow(_verify(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(class, label): the smallest class reachable over ``edges`` (a, b).

    Each round hangs every class below the smallest label next to it and then
    halves the way to it; rounds grow with the logarithm of the longest way."""
    rows = 2 * edges.count()
    both = materialize(gathered(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), rows), "edges")
    labels = materialize(gathered(both.groupBy(F.col("a").alias("class")).agg(F.least(F.col("class"), F.min("b")).alias("label")), rows), "labels")
    while True:
        near = both.join(labels.select(F.col("class").alias("b"), "label"), "b").groupBy(F.col("a").alias("class")).agg(F.min("label").alias("near"))
        step = labels.join(near, "class").select("class", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("class").alias("label"), F.col("label").alias("over"))
        new = materialize(gathered(step.join(jump, "label", "left").select("class", "old", F.least("label", "over").alias("label")), rows), "labels")
        changed = new.filter("label <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels.select("class", "label")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g, m in zip(batch["g"].to_pylist(), batch["members"].to_pylist(), strict=True):
            x = np.frombuffer(m, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), g)), pa.array(x)], ["g", "class"])


def _small_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m in batch["members"].to_pylist():
            x = np.frombuffer(m, np.int64)
            i, j = np.triu_indices(len(x), 1)
            yield pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(x[j])], ["a", "b"])


def _in_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, pivot, sizes of both, shingles they share)"""
    for batch in batches:
        rows = []
        for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = np.concatenate([x, y])
            both.sort()
            rows.append((len(x), len(y), int(np.count_nonzero(both[1:] == both[:-1]))))
        n, m, common = (pa.array(v, pa.int64()) for v in (zip(*rows, strict=True) if rows else ((), (), ())))
        yield pa.RecordBatch.from_arrays([batch["class"], batch["pivot"], n, m, common], ["class", "pivot", "n", "m", "common"])


def _difference_keys(values: list[int], percent: int):
    """Keys under which classes x, y of one pivot P meet if they link and do not
    both link with P. A = x - P, a = |A|, R = P - x, r = |R|, k = r - a (how much
    shorter x is than P); sets link if their difference d and sizes s fulfil
    (100 + percent) d <= (100 - percent) s. The excess of x over that against P is
    E = (100 + percent)(a + r) - (100 - percent)(|x| + |P|), positive if x does not
    link with P; let x be such a one.

    If x and y share nothing of A, they differ in a_x + a_y + |R_x ^ R_y|, at least
    a_x + r_x - k_y shingles; a link then needs E_x <= 2 percent k_y. Such y are
    shorter than P, and the two share at least E_x / (2 percent) and
    (2 percent a_y + 200 r_y) / (2 (100 + percent)) shingles of R. So all of A are
    keys, and of R (in the order of a hash) the first r - o + 1, o being that
    least number: the first shared one is among them on both sides. They are sent
    only where the pivot has classes short enough (``k_most``, ``e_least``)."""
    buckets = np.array(values, np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for c, p, k_most, e_least, x, y in zip(*(batch[f].to_pylist() for f in ("class", "pivot", "k_most", "e_least", "set_a", "set_b")), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                added, removed = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                a, r = len(added), len(removed)
                excess = (100 + percent) * (a + r) - (100 - percent) * (len(x) + len(y))
                salt = mix64(np.array([p], np.int64).view(U64))
                tag = np.int64(c).astype(U64) << U64(2)
                held.append((mix64(added ^ salt), np.full(a, tag | U64(3 if excess > 0 else 1))))
                looks = shown = 0
                if 0 < excess <= 2 * percent * k_most:
                    looks = r + 1 + (-excess // (2 * percent))
                if r > a and e_least is not None and 2 * percent * (r - a) >= e_least:
                    shown = r + 1 + (-(2 * percent * a + 200 * r) // (2 * (100 + percent)))
                if max(looks, shown) > 0:
                    key = np.sort(mix64(removed + _SPACE))[: max(looks, shown)]
                    place = np.arange(len(key))
                    flags = np.where(place < looks, 2, 0) + np.where(place < shown, 1, 0)
                    held.append((mix64(key ^ salt ^ _SPACE), tag | flags.astype(U64)))
                size += a + max(looks, shown, 0)
                if size >= FLUSH_KEYS:
                    yield _packet(held, buckets)
                    size = 0
        if size:
            yield _packet(held, buckets)

    return send


def _link_blocks(percent: int):
    """Links between classes of different components of two blocks: enough of
    them to join what is linked, each tested on the whole sets."""

    def link(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        classes, labels = table["class"].to_numpy(), table["label"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U64) for x in table["shingles"]]
        n = np.array([len(x) for x in sets])
        tokens, dense = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(n) - n
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if (side == 1).any() else 0))
        there = dense[np.repeat(first[right] - (np.cumsum(n[right]) - n[right]), n[right]) + np.arange(n[right].sum())]
        starts = np.cumsum(n[right]) - n[right]
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        out = []
        mark = np.zeros(len(tokens), bool)
        for i in left.tolist():
            if (labels[right] == labels[i]).all():
                continue
            own = dense[first[i] : first[i] + n[i]]
            mark[own] = True
            common = np.add.reduceat(mark[there], starts, dtype=np.int64)
            mark[own] = False
            linked = (100 * common >= percent * (n[i] + n[right] - common)) & (labels[right] != labels[i])
            for j in right[linked].tolist():
                x, y = root(int(labels[i])), root(int(labels[j]))
                if x != y:
                    joined[x] = y
                    out.append((int(classes[i]), int(classes[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return link


def centre_pairs(met: DataFrame) -> DataFrame:
    packed = met.filter("bucket IS NOT NULL").select("bucket", "a", "b", "n_keys", "n_two")
    packed = packed.repartition(shuffle_partitions(met.sparkSession), "bucket")
    return packed.mapInArrow(_partners, "a long, b long, n_two long, rank long, hub boolean, met long")


def with_sets(compared: DataFrame, sets: DataFrame) -> DataFrame:
    """(class, pivot, ...) with the sets of both."""
    own = sets.select("class", F.col("shingles").alias("set_a"))
    other = sets.select(F.col("class").alias("pivot"), F.col("shingles").alias("set_b"))
    # a pivot of many classes is dealt to many tasks; packets go out by task
    return compared.join(own, "class").join(other, "pivot").coalesce(shuffle_partitions(sets.sparkSession))


def pivots_of(groups: DataFrame) -> DataFrame:
    """(class, pivot) of each class in ``groups``."""
    members = groups.select(F.col("pivot").alias("g"), "members").mapInArrow(_members, "g long, class long")
    return members.distinct().select("class", F.col("g").alias("pivot"))


def families(compared: DataFrame, mixed: DataFrame) -> DataFrame:
    """(class, hub): of the pivots of a class the one that met most others."""
    often = mixed.groupBy("pivot").agg(F.max("met").alias("met"))
    hubs = compared.join(often, "pivot").groupBy("class").agg(F.max(F.struct("met", "pivot")).alias("hub"))
    return hubs.select("class", F.col("hub.pivot").alias("hub"))


def settle(met: DataFrame, pairs: DataFrame, sets: DataFrame, links: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Labels of the components once every link between classes that met is in
    them (``met`` and ``pairs`` as ``_meet`` found them; both are discarded)."""
    spark = sets.sparkSession
    n = shuffle_partitions(spark)
    buckets = bucket_values(spark, n)
    classes = materialize(sets.select("class", (F.octet_length("shingles") / 8).cast("long").alias("n")), "sizes")
    n_classes = classes.count()
    hubs = None
    for k in range(ROUNDS + 1):
        if not pairs.limit(1).count():
            break
        often = pairs.filter("met IS NOT NULL").select(F.col("b").alias("class"), "met")
        info = classes.join(often, "class").join(labels, "class", "left")
        info = materialize(gathered(info.select("class", "n", "met", F.coalesce("label", "class").alias("label")), n_classes), "partners")
        groups = met.filter("g IS NOT NULL").select("g", "members").distinct()
        two = pairs.filter("n_two > 0").select("a", "b")
        found = groups.mapInArrow(_members, "g long, class long").join(info, "class").groupBy("g")
        found = found.agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("met", "class")).alias("top"))
        mixed = found.filter("lo <> hi").select("g", "size", F.col("top.class").alias("pivot"), F.col("top.met").alias("met"))
        mixed = materialize(gathered(mixed, n_classes), "mixed")
        mixed_groups = groups.join(mixed, "g")
        if k == ROUNDS:
            if hubs is None:
                hubs = families(pivots_of(mixed_groups), mixed)
            return components(links.union(materialize(block_links(mixed_groups, two, info, hubs, sets, percent), "links")))

        # small groups pair by pair
        near = mixed_groups.filter(F.col("size") <= SMALL_GROUP).select("members").mapInArrow(_small_pairs, "a long, b long").union(two).distinct()
        side = info.select("class", "label", "n")
        near = near.join(side.toDF("a", "la", "na"), "a").join(side.toDF("b", "lb", "nb"), "b")
        near = materialize(gathered(near.filter("la <> lb AND 5 * na >= 4 * nb AND 5 * nb >= 4 * na").select("a", "b"), n_classes), "near")
        new = materialize(verified(near, sets, percent), "links")
        discard(near)
        # larger ones against their pivots
        large = mixed_groups.filter(F.col("size") > SMALL_GROUP)
        last = not mixed.filter(F.col("size") > SMALL_GROUP).limit(1).count()
        if not last:
            compared = materialize(gathered(pivots_of(large), n_classes), "compared")
            if hubs is None:
                hubs = materialize(gathered(families(compared, mixed), n_classes), "hubs")
            common = common_rows = materialize(with_sets(compared, sets).mapInArrow(_in_common, "class long, pivot long, n long, m long, common long"), "common")
            discard(compared)
            excess = (100 + percent) * (F.col("n") + F.col("m") - 2 * F.col("common")) - (100 - percent) * (F.col("n") + F.col("m"))
            common = common.withColumn("excess", excess)
            new = new.union(common.filter("excess <= 0 AND class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")))
        if new.limit(1).count():
            before, links = links, materialize(gathered(links.union(new).distinct(), n_classes), "links")
            discard(before)
            labels = components(links)
        if last:
            break

        # what may still link within a pivot's classes
        state = common.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        open_pivots = state.groupBy("pivot").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.col("m") - F.col("n")).alias("k_most"), F.min(F.when(F.col("excess") > 0, F.col("excess"))).alias("e_least")
        )
        left = common.join(open_pivots.filter("lo <> hi"), "pivot").select("class", "pivot", "k_most", "e_least")
        left = with_sets(left, sets).mapInArrow(_difference_keys(buckets, percent), "bucket long, keys binary, tags binary")
        discard(met, pairs, info, mixed)
        met = materialize(left.repartition(n, "bucket").mapInArrow(_meet(buckets), MET), "met")
        discard(common_rows)
        pairs = materialize(centre_pairs(met), "pairs")
    return labels


def block_links(groups: DataFrame, two: DataFrame, info: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components among the members of ``groups`` and the pairs
    ``two``: the members, by family (``hubs``), in blocks of a bounded number of
    shingles, two at a time."""
    members = groups.select("g", "members").mapInArrow(_members, "g long, class long")
    members = members.union(two.select(F.xxhash64("a", "b").alias("g"), F.explode(F.array("a", "b")).alias("class")))
    there = info.join(members.select("class").distinct(), "class").join(hubs, "class", "left").withColumn("hub", F.coalesce("hub", "class"))
    parts = there.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    there = there.join(parts, "hub").select("class", "label", F.xxhash64("hub", F.pmod(F.xxhash64("class"), "parts")).alias("block"))
    there = materialize(gathered(there, info.count()), "blocks")
    meets = materialize(members.join(there, "class").groupBy("g", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "meets")
    other = meets.select("g", F.col("block").alias("q"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    both = meets.withColumnRenamed("block", "p").join(other, "g").filter("p <= q AND (lo <> hi OR qlo <> qhi OR lo <> qlo)").select("p", "q").distinct()
    sides = both.select("p", "q", F.explode(F.when(F.col("p") == F.col("q"), F.array("p")).otherwise(F.array("p", "q"))).alias("block"))
    blocks = sides.join(there, "block").join(sets.select("class", "shingles"), "class")
    blocks = blocks.select("p", "q", F.when(F.col("block") == F.col("p"), 0).otherwise(1).alias("side"), "class", "label", "shingles")
    return blocks.groupBy("p", "q").applyInArrow(_link_blocks(percent), "a long, b long")


def jaccard_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id. ``percent`` is 80 or
    more (the bounds above are those of 80)."""
    if percent < 80:
        raise ValueError("the segment counts hold for a similarity of 80 % or more")
    spark = docs.sparkSession
    ship_code(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = materialize(docs.mapInArrow(_classes, "doc_id long, n_shingles long, class long"), "classes")
    n = shuffle_partitions(spark)
    buckets = bucket_values(spark, n)
    sent = docs.mapInArrow(_send(buckets), "bucket long, keys binary, tags binary")
    met = materialize(sent.repartition(n, "bucket").mapInArrow(_meet(buckets), MET), "met")
    pairs = materialize(centre_pairs(met), "pairs")

    # the sets of the classes that met any other
    wanted = pairs.select(F.col("b").alias("class")).distinct()
    firsts = own.groupBy("class").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("k")).join(wanted, "class")
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "text").join(firsts, "k")
    sets = materialize(texts.select("text", "class").mapInArrow(_sets, "class long, shingles binary").dropDuplicates(["class"]), "sets")

    # first round: the few classes met most often
    links = materialize(verified(pairs.filter(F.col("rank") <= FIRST_PARTNERS), sets, percent), "links")
    labels = components(links)

    # then whatever met and is still in different components
    labels = settle(met, pairs, sets, links, labels, percent)

    # the smallest id of each component
    named = own.groupBy("class").agg(F.min("doc_id").alias("least")).join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.filter("class <> 0").join(least, "label").select("class", "component")
    out = own.join(named, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_first_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Pipeline form: of each component one row stays, that with the smallest doc_id
    (NULL last). Rows are told apart by id and text, as ids may repeat; of rows equal in
    both one stays, and documents without words are linked with nothing."""
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    found = jaccard_classes(docs.select(row.alias("doc_id"), "text"), percent)
    groups = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).distinct()
    ids = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    stay = ids.join(groups, "row").groupBy("group").agg(first.alias("f")).select(F.col("f.row").alias("__stay"))
    once = docs.dropDuplicates(["doc_id", "text"])
    return once.join(stay, F.xxhash64(once["doc_id"].isNull(), once["doc_id"], once["text"]) == F.col("__stay"), "left_semi")
