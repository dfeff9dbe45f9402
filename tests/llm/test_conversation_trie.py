"""op12: the trie against every prefix spelt out, and its forests slice by slice."""

from __future__ import annotations

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import conversation_trie as T

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, id string, depth long, open boolean, turns string"


def rebuilt(rows):
    """conv_id -> rebuilt turns, of rows (conv_id, turn, role, text) without ties."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(conversations):
    """Rows of all nodes; a conversation is a list of (role, text)."""
    members = collections.defaultdict(list)
    for c, seq in sorted(conversations.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(conversations[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    out = T.conversation_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_all_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert nodes(df) == brute(rebuilt([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


def test_hot_conversations_and_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(c, t, "user", "hello" if t == 0 else f"x{rng.integers(3)}") for c in range(300) for t in range(int(rng.integers(1, 7)))]
    rows += [(c, t, "user", x) for c in range(1000, 1400) for t, x in enumerate(("hello", "same", "ends"))]  # copies
    rows += [(2000, t, None, f"é{t}" * 50) for t in range(150)]  # very long
    rows += [(2001, None, "user", "first"), (2001, 3, None, None), (2001, 1, "user", ""), (2003, 0, "", ""), (-7, 0, "a", "b"), (-5, 0, "a", "c"), (None, 0, "user", "nobody"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "i", 9, None, "t") for r in rows], SCHEMA).repartition(5)
    want = rows[:-2]
    # c - c % 5 as SQL has it: the remainder takes the sign of c
    conv = rebuilt([r for r in want if r[0] >= 0])
    for c, turns in ((-7, [("a", "b")]), (-5, [("a", "c")])):
        h = zlib.crc32(str(c).encode()) % 9
        conv[c] = [("a", "c")][:h] + turns[h:]
    assert nodes(df) == brute(conv)
    assert nodes(df.limit(0)) == [] and nodes(df.filter("conv_id is null")) == []


def test_ties_and_repeated_turns(spark):
    rows = [(5, 1, "user", "b"), (5, 1, "user", "b"), (5, 1, "assistant", "z"), (5, 1, "user", "a")]
    got = T.conversation_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    md5 = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    assert [t["digest"] for t in got[0]["turns"]] == [md5("assistant", "z"), *sorted(md5("user", x) for x in "abb")]


def sequences(seed, letters, longest, n):
    rng = np.random.default_rng(seed)
    return {c: [("u", "abcdefg"[x]) for x in rng.integers(0, letters, int(rng.integers(0, longest)))] for c in range(n)}


@pytest.mark.parametrize("seed", range(12))
def test_forests_merge_across_any_cuts(seed):
    """Forests of any slices, merged on their outer paths, give the whole trie."""
    rng = np.random.default_rng(seed)
    conv = sequences(seed, int(rng.integers(1, 5)), int(rng.integers(1, 9)), int(rng.integers(1, 60)))
    turn = lambda t: hashlib.md5(repr(t).encode()).digest()
    groups = collections.defaultdict(list)
    for c, seq in conv.items():
        groups[b"".join(map(turn, seq)), tuple(len(t[1]) for t in seq)].append(c)
    rows = [(key, list(width), len(ids), ids[0], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for (key, width), ids in sorted(groups.items())]
    cuts = sorted({0, len(rows), *rng.integers(0, len(rows) + 1, int(rng.integers(0, 6))).tolist()})
    found = [r for a, b in zip(cuts, cuts[1:]) for r in T.Forest(rows[a:b]).rows()]
    outer: dict = {}
    for r in (r for r in found if r["open"]):
        o = outer.setdefault(r["id"], {**r, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved": 0, "ends": None})
        for k in ("n_convs", "n_children", "n_leaves", "saved"):
            o[k] += r[k]
        o["conv_id"], o["ends"] = min(o["conv_id"], r["conv_id"]), o["ends"] or r["ends"]
    batch = pa.RecordBatch.from_pylist(sorted(outer.values(), key=lambda r: -r["depth"]), schema=T._NODE_ARROW)
    merged = [r for b in T._carry_up(iter([batch])) for r in b.to_pylist()]
    least = {r["id"]: r["conv_id"] for r in merged}
    got = [(r["conv_id"], r["depth"], r["up_conv"] if r["up_conv"] is not None else least.get(r["up"]), r["n_convs"], r["n_children"], r["n_leaves"], r["saved"], r["ends"] or hashlib.sha256(b"").hexdigest()) for r in [*merged, *(r for r in found if not r["open"])]]
    assert sorted(got, key=str) == brute(conv)


def test_shared_turns():
    a, b = b"x" * 48, b"x" * 40 + b"y" * 24
    assert (T._shared_turns(a, b), T._shared_turns(a, a[:16]), T._shared_turns(b"", a), T._shared_turns(a, a)) == (2, 1, 0, 3)
