"""Prefix trie of conversations by union-find over sorted neighbours.

A conversation is the sequence of its turns; each turn stands as a 16-byte digest
of role and text, so a conversation's key is its digests in a row, keys sort as
sequences do, and neighbours in that order share their longest common prefix (LCP).
Equal conversations are one sequence with a count.

Sorted sequences are dealt to partitions by range and taken in slices of bounded
size. Each slice builds its forest: an edge between neighbours has their LCP as
depth, and edges are joined deepest first by union-find; every merge of components
makes (or widens) the branching node at that depth, and the unary nodes between it and
the components below are written out on the way. All nodes but those on the paths of
the slice's first and last sequence are then complete. These two paths are what is
left of a slice for its neighbours: paths of all slices are merged by node, their
counts added up by Spark, and the sums over subtrees carried up once, deepest first. That
step sees at most 2 * (longest conversation) rows a slice, no conversation or text.

Edge cases: rows without conv_id belong to no conversation and are left out; NULL
role and text are empty; turns of one conversation with equal numbers are ordered by
role, then digest, and each counts; an empty table gives an empty result (no root).
A conversation's digests and lengths (24 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.joins import join_dimension

from .common import materialize, ship_code, shuffle_partitions

#: Turns that one slice's forest holds, and ids of equal conversations in one row.
SLICE_TURNS = 100_000
CHUNK_IDS = 30_000
#: ``rebuilt_conversations``: conversations of one family share a first part of up to
#: ``SHARED - 1`` turns.
FAMILY, SHARED = 5, 9

_NO_ENDS = hashlib.sha256(b"").hexdigest()
_ROOT = bytes(16)


def _digest(role: Column, text: Column) -> Column:
    """Hex digest of a turn; the role's length keeps role and text apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation its turns in order as (digest, n_bytes),
    narrowed before the shuffle: no text is moved."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", role.alias("role"), _digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))  # by turn (NULL first), role, digest
    return narrow.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["n_bytes"].alias("n_bytes"))).alias("turns"))


def rebuilt_conversations(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % ``family``
    (h: crc32 of c's decimal digits, modulo ``shared``) and goes on with its own turns
    after its first h. A missing first conversation gives no turns."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % shared).cast("int")
    heads = turns.filter(c % family == 0).select(c.alias("base"), F.slice("turns", 1, shared - 1).alias("head"))
    none = F.array().cast(turns.schema["turns"].dataType)
    own = turns.select(c, (c - c % family).alias("base"), h.alias("h"), "turns").join(heads, "base", "left")
    first = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.select("conv_id", F.concat(first, rest).alias("turns"))


def _equal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, conv_id) to one row per ``CHUNK_IDS`` equal keys: their
    count, least id and ids as text."""
    names = ["key", "n_bytes", "n", "least", "ids"]

    def out(key, n_bytes, ids):
        return pa.record_batch([pa.array([key], pa.binary()), pa.array([n_bytes], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names)

    key, n_bytes, ids = None, None, []
    done: list[pa.RecordBatch] = []
    for batch in batches:
        for k, c, b in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("n_bytes"), strict=True):
            if ids and (k != key or len(ids) >= CHUNK_IDS):
                done.append(out(key, n_bytes, ids))
                ids = []
            if not ids:
                key, n_bytes = k, b.as_py()
            ids.append(c)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
    if ids:
        yield out(key, n_bytes, ids)


def _shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    low, high = 0, min(len(a), len(b)) // 16
    while low < high:
        mid = (low + high + 1) // 2
        if a[16 * low : 16 * mid] == b[16 * low : 16 * mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """The trie of a slice of sorted distinct sequences (key, n_bytes, n, least, ends)."""

    def __init__(self, sequences: list[tuple]):
        self.sequences = sequences
        self.depth, self.of, self.n, self.least, self.children, self.leaves, self.saved, self.ends, self.parent = ([] for _ in range(9))
        self._same: list[int] = []  # a node merged away points to the node it is part of
        tops = [self._leaf(i) for i in range(len(sequences))]
        group = list(range(len(sequences)))

        def find(links: list[int], i: int) -> int:
            while links[i] != i:
                links[i] = links[links[i]]
                i = links[i]
            return i

        edges = [_shared_turns(a[0], b[0]) for a, b in zip(sequences, sequences[1:], strict=False)]
        for i in sorted(range(len(edges)), key=lambda i: -edges[i]):
            a, b = find(group, i), find(group, i + 1)
            tops[a] = self._merge(self._climb(tops[a], edges[i]), tops[b], edges[i])
            group[b] = a
        self.root = self._climb(tops[find(group, 0)], 0)
        self.parent = [find(self._same, p) if p >= 0 else -1 for p in self.parent]
        self.first, self.last = find(self._same, 0), find(self._same, len(sequences) - 1)

    def _node(self, depth, of, n, least, children, leaves, saved, ends=None) -> int:
        for store, x in ((self.depth, depth), (self.of, of), (self.n, n), (self.least, least), (self.children, children), (self.leaves, leaves), (self.saved, saved), (self.ends, ends), (self.parent, -1), (self._same, len(self._same))):
            store.append(x)
        return len(self.depth) - 1

    def width(self, node: int) -> int:
        """Bytes of the node's last text."""
        d = self.depth[node]
        return self.sequences[self.of[node]][1][d - 1] if d else 0

    def _leaf(self, i: int) -> int:
        key, n_bytes, n, least, ends = self.sequences[i]
        return self._node(len(n_bytes), i, n, least, 0, 1, (n - 1) * n_bytes[-1] if n_bytes else 0, ends)

    def _climb(self, node: int, depth: int) -> int:
        """The only child's chain of parents up to ``depth``."""
        while self.depth[node] > depth:
            up = self._node(self.depth[node] - 1, self.of[node], self.n[node], self.least[node], 1, self.leaves[node], self.saved[node])
            self.saved[up] += (self.n[up] - 1) * self.width(up)
            self.parent[node] = up
            node = up
        return node

    def _merge(self, a: int, b: int, depth: int) -> int:
        """Join the component topped by ``b`` to node ``a`` at ``depth``."""
        was = self.n[a] - 1
        if self.depth[b] > depth:
            b = self._climb(b, depth + 1)
            self.parent[b] = a
            children, saved = 1, self.saved[b]
        else:  # both have a node here
            self._same[b] = a
            children, saved = self.children[b], self.saved[b] - (self.n[b] - 1) * self.width(b)
            self.ends[a] = self.ends[a] or self.ends[b]
        self.leaves[a] = (self.leaves[a] if self.children[a] else 0) + self.leaves[b]
        self.children[a] += children
        self.n[a] += self.n[b]
        self.least[a] = min(self.least[a], self.least[b])
        self.saved[a] += saved + (self.n[a] - 1 - was) * self.width(a)
        return a

    def rows(self) -> Iterator[dict]:
        """Complete nodes, and the open ones of the two outer paths with what they
        have outside those paths."""
        path: dict[int, tuple[bytes, bytes | None]] = {}
        for end in (self.first, self.last):
            chain, node = [], end
            while node >= 0:
                chain.append(node)
                node = self.parent[node]
            key, at, up = self.sequences[self.of[end]][0], _ROOT, None
            for d, node in enumerate(reversed(chain)):
                if d:
                    at, up = hashlib.md5(at + key[16 * (d - 1) : 16 * d]).digest(), at
                path[node] = at, up
        inside = {x: [0, 0, 0] for x in path}
        for x in range(len(self.depth)):
            if self._same[x] != x or x in path:
                continue
            up = self.parent[x]
            if up in path:
                for k, v in enumerate((1, self.leaves[x], self.saved[x])):
                    inside[up][k] += v
            yield {"open": False, "id": None, "up": path[up][0] if up in path else None, "depth": self.depth[x], "n_convs": self.n[x], "conv_id": self.least[x], "n_children": self.children[x], "n_leaves": self.leaves[x], "saved": self.saved[x], "width": 0, "ends": self.ends[x], "up_conv": None if up in path else self.least[up]}
        for x, (at, up) in path.items():
            children, leaves, saved = inside[x]
            yield {"open": True, "id": at, "up": up, "depth": self.depth[x], "n_convs": self.n[x], "conv_id": self.least[x], "n_children": children, "n_leaves": leaves, "saved": saved, "width": self.width(x), "ends": self.ends[x], "up_conv": None}


_NODE = "open boolean, id binary, up binary, depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved long, width long, ends string, up_conv long"
_NODE_ARROW = pa.schema([("open", pa.bool_()), ("id", pa.binary()), ("up", pa.binary()), *[(c, pa.int64()) for c in ("depth", "n_convs", "conv_id", "n_children", "n_leaves", "saved", "width")], ("ends", pa.string()), ("up_conv", pa.int64())])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted chunks of equal conversations to one sequence each, its ids hashed as
    they come."""
    key = n_bytes = least = sha = None
    n = 0
    for batch in batches:
        cols = [batch.column(c) for c in ("key", "n_bytes", "n", "least", "ids")]
        for i in range(batch.num_rows):
            k = cols[0][i].as_py()
            if k != key:
                if n:
                    yield key, n_bytes, n, least, sha.hexdigest()
                key, n_bytes, n, least, sha = k, cols[1][i].as_py(), 0, cols[3][i].as_py(), hashlib.sha256()
            sha.update((("," if n else "") + cols[4][i].as_py()).encode())
            n += cols[2][i].as_py()
    if n:
        yield key, n_bytes, n, least, sha.hexdigest()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(part: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = list(Forest(part).rows())
        for i in range(0, len(found), 20_000):
            yield pa.RecordBatch.from_pylist(found[i : i + 20_000], schema=_NODE_ARROW)

    part, turns = [], 0
    for s in _sequences(batches):
        part.append(s)
        turns += len(s[1]) + 1
        if turns >= SLICE_TURNS:
            yield from out(part)
            part, turns = [], 0
    if part:
        yield from out(part)


def _carry_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged open nodes, deepest first: sums of their subtrees. Only nodes whose
    children have been seen are held."""
    below: dict[bytes, list[int]] = {}
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            children, leaves, saved = below.pop(r["id"], (0, 0, 0))
            r["n_children"] += children
            r["n_leaves"] = r["n_leaves"] + leaves if r["n_children"] else 1
            r["saved"] += saved + (r["n_convs"] - 1) * r["width"]
            if r["up"] is not None:
                up = below.setdefault(r["up"], [0, 0, 0])
                for k, v in enumerate((1, r["n_leaves"], r["saved"])):
                    up[k] += v
        yield pa.RecordBatch.from_pylist(rows, schema=_NODE_ARROW)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences`` (conv_id, turns of (digest, n_bytes)), a row
    each: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes of repeated turns in the subtree) and ends_sha256."""
    spark = sequences.sparkSession
    ship_code(spark)
    n = shuffle_partitions(spark)
    rows = materialize(sequences.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.n_bytes").alias("n_bytes")), "sequences")
    # conv_id in the range: a conversation with very many copies is spread too
    runs = rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = materialize(runs.mapInArrow(_equal_runs, "key binary, n_bytes array<long>, n long, least long, ids string"), "runs")
    sorted_runs = runs.repartitionByRange(n, "key").sortWithinPartitions("key", "least")
    found = materialize(sorted_runs.mapInArrow(_forests, _NODE), "forests")
    merged = found.filter("open").groupBy("id").agg(F.lit(True).alias("open"), F.any_value("up").alias("up"), F.any_value("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.any_value("width").alias("width"), F.max("ends").alias("ends"), F.lit(None).cast("long").alias("up_conv"))
    merged = merged.select(*_NODE_ARROW.names).repartition(1).sortWithinPartitions(F.desc("depth"))
    merged = materialize(merged.mapInArrow(_carry_up, _NODE), "outer")
    nodes = found.filter(~F.col("open")).unionByName(merged)
    parents = merged.select(F.col("id").alias("up"), F.col("conv_id").alias("outer_conv"))
    nodes = join_dimension(nodes, parents, "up", "left", salt_by=F.xxhash64("conv_id", "depth"))
    return nodes.select(
        "conv_id",
        "depth",
        F.coalesce("up_conv", "outer_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt to share first turns within families."""
    turns = materialize(conversation_turns(conversations), "turns")
    return prefix_trie(rebuilt_conversations(turns))


def _crc32_table() -> list[int]:
    """The byte table of CRC-32 (reflected polynomial)."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def op12_sql() -> str:
    """DuckDB SQL for ``conversation_trie``: every prefix of every rebuilt
    conversation spelt out, grouped, and joined with its own prefixes."""
    return rf"""
WITH own AS (
  SELECT conv_id, list(to_json([coalesce(role, ''), coalesce(text, '')])::VARCHAR ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sized AS (
  SELECT conv_id, turns,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                         lambda s, b: xor(s >> 8, ({_crc32_table()}::BIGINT[])[(xor(s, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM own),
rebuilt AS (
  SELECT s.conv_id, coalesce(o.turns, [])[1:h] || s.turns[h + 1:] AS seq
  FROM sized s LEFT JOIN own o ON o.conv_id = s.conv_id - s.conv_id % 5),
prefixes AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt),
members AS (SELECT conv_id, depth, md5(array_to_string(seq[1:depth], chr(10))) AS node, md5(array_to_string(seq[1:greatest(depth - 1, 0)], chr(10))) AS up,
                   CASE WHEN depth > 0 THEN octet_length(encode(seq[depth]->>1)) ELSE 0 END AS width, depth = len(seq) AS ends FROM prefixes),
nodes AS (
  SELECT depth, node, up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(width) AS width,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY depth, node, up),
children AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT nodes.*, coalesce(c.n, 0) AS n_children FROM nodes LEFT JOIN children c USING (depth, node)),
paths AS (
  SELECT DISTINCT a.depth AS top_depth, a.node AS top, b.depth, b.node
  FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT top_depth AS depth, top AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * width)::BIGINT AS saved_tokens
  FROM paths JOIN whole w ON w.depth = paths.depth AND w.node = paths.node GROUP BY ALL)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM whole w JOIN sums s ON s.depth = w.depth AND s.node = w.node LEFT JOIN whole p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.node = w.up
"""
