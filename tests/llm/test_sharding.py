"""op13: the curve, the two laws, pruning and edges."""

from __future__ import annotations

import collections
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import sharding as S
from fleetlens.llm.common import documents

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, h long, shard string, size string, before long, _row string"


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2), (1, 3)])
def test_the_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
    got = df.withColumn("h", S.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(len(cells)))
    for a, b in zip(got, got[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def check(rows, law, n_shards=16):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(0 <= s < n_shards for s in by)
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    measure = [sum(1 if law == "rows" else r["size"] for r in by.get(s, [])) for s in range(n_shards)]
    return max(measure) - min(measure)


def test_all_documents(spark):
    docs = documents(spark, SF)
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    for law in ("rows", "bytes"):
        got = S.documents_sharded(docs, law=law)
        assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        rows = got.collect()
        assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {(d, len(t) + 1, zlib.crc32(t), law, None) for d, t in texts.items()}
        largest = 1 if law == "rows" else 2 * max(len(t) + 1 for t in texts.values())
        assert len(rows) == len(texts) and check(rows, law) <= largest
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, S.documents_sharded(docs.repartition(7), law=law).collect()), key=str)


def test_edges(spark):
    hot = [(7, "copy", "en", "hot")] * 400  # equal in every column
    rows = [*hot, (None, None, None, None), (1, "", "en", "a"), (2, "é" * 200_000, "fr", "b"), (-(2**63), "x", None, "c"), (2**63 - 1, "x", "en", None), *[(i, f"t{i}", f"l{i % 3}", f"s{i}") for i in range(50)]]
    df = spark.createDataFrame([(*r, 1, "s", "z", 5, "r") for r in rows], SCHEMA).repartition(4)
    got = S.documents_sharded(df).collect()
    assert len(got) == len(rows) and check(got, "rows") <= 1
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows}
    assert check(S.documents_sharded(df, law="bytes").collect(), "bytes") <= 800_002
    assert S.documents_sharded(df.limit(0)).count() == 0 and S.documents_sharded(df.limit(0), law="bytes").count() == 0
    few = S.documents_sharded(df.limit(3)).collect()
    assert len(few) == 3 and all(r["slot"] == 0 for r in few)
    with pytest.raises(ValueError, match="law"):
        S.documents_sharded(df, law="key")


def test_a_hot_source_keeps_one_code(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i:04d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    codes = S.codes_of(df, ("source", "doc_id"), 3000)
    got = df.select("source", codes[0].alias("c"), codes[1].alias("d")).collect()
    assert {r["c"] for r in got if r["source"] == "hot"} == {0} and 20 <= len({r["c"] for r in got}) <= 32
    assert collections.Counter(r["d"] for r in got).most_common()[0][1] <= 95


def test_written_shards_read_back_and_prune(spark, scratch):
    docs = documents(spark, SF)
    manifest = S.write_shards(docs, f"{scratch}/out")
    assert manifest.agg(F.sum("rows")).first()[0] == docs.count()
    back = S.read_shards(spark, f"{scratch}/out")
    assert back.columns == docs.columns and back.exceptAll(docs).count() == docs.exceptAll(back).count() == 0
    ranges = {"lang": ("de", "de"), "doc_id": (0, 60)}
    got, want = S.read_shards(spark, f"{scratch}/out", **ranges), docs.filter("lang = 'de' and doc_id between 0 and 60")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    touched = manifest.filter("min_lang <= 'de' and max_lang >= 'de' and min_doc_id <= 60 and max_doc_id >= 0").count()
    assert 0 < touched <= 8
