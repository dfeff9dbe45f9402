"""NULLs, empty and very long texts, repeated rows, empty tables and columns with
names that the operators use themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from fleetlens.llm import decontamination, jaccard_join, language_model, licenses, mixing, quality_rules, substring_dedup, token_counts, token_files, toxicity
from fleetlens.llm.common import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, class long, _text string, _row string, kept boolean, key string, _key long, words long"
LONG = " ".join(f"word{i * 7919 % 1000003}" for i in range(150_000)) + "."
PROSE = " ".join(f"tale{i % 211} goes{i % 17} on." for i in range(60))


def extra(row):
    return (*row, 1, 2, "x", "y", None, "k", 3, 4)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PROSE, "en", "a", None), (2, PROSE, "en", "a", 5), (2, PROSE, "en", "a", 5), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "fr", None, 4), (6, LONG, "en", "b", None), (None, PROSE, "en", "a", 1), (7, "one two", None, "b", 7), (8, "éè \U0001f600 z", "fr", "c", 9)]
    return spark.createDataFrame([extra(r) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality(docs, empty):
    got = [(r["doc_id"], r["n_words"], r["base_failed"]) for r in quality_rules.quality_rules(docs).collect()]
    assert len(got) == 10 and (3, 0, True) in got and (6, 150_000, False) in got
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {1, 2, None, 6}
    assert quality_rules.keep_documents(empty).count() == 0


def test_jaccard(docs, empty):
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (None, 1), (7, 7), (8, 8)], key=str)
    kept = jaccard_join.keep_first_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8]
    assert jaccard_join.jaccard_classes(empty).count() == 0


def test_near_copies_are_told_apart_by_row_not_by_id(spark):
    """Ids may repeat or be missing: one row of each group stays, whatever its id."""
    a = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (5, " ".join([*a, "x"])), (5, " ".join(f"b{i}" for i in range(40))), (None, " ".join([*a, "y"])), (None, "")]
    df = spark.createDataFrame([(i, t, {"k": str(n)}) for n, (i, t) in enumerate(rows)], "doc_id long, text string, tags map<string,string>").repartition(3)
    left = jaccard_join.keep_first_of_each(df)
    assert left.columns == df.columns and {(r["doc_id"], r["text"]) for r in left.collect()} == {rows[0], rows[2], rows[4]}


def test_mixing_takes_map_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "s", {"k": "v"}), (2, "d e", "t", None), (2, "d e", "t", {})], "doc_id long, text string, source string, tags map<string,string>")
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and {r["doc_id"] for r in mixed.collect()} <= {1, 2}


def _family(kind, n=400):
    """Edited copies of one text: ``near`` are all linked through the original, ``far``
    mostly not, ``cut`` lose words or ends of it, so that links miss the original, and
    ``nested`` are copies of copies."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows, made = [(0, " ".join(base))], [base]
    for i in range(1, n):
        w = list(made[int(rng.integers(0, min(len(made), 12)))] if kind == "nested" else base)
        if kind == "cut":
            start, end = int(rng.integers(0, 25)), int(rng.integers(95, 121))
            w = [x for x in w[start:end] if rng.random() > 0.02]
        for k in rng.integers(0, len(w), int(rng.integers(*{"near": (1, 5), "far": (3, 14), "cut": (0, 3), "nested": (2, 6)}[kind]))):
            w[k] = f"x{int(rng.integers(0, 3)) if kind != 'near' else i}_{k}"
        made.append(w)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rounds", [jaccard_join.ROUNDS, 0])
@pytest.mark.parametrize("kind", ["near", "far", "cut", "nested"])
def test_near_copies_in_one_large_group(spark, monkeypatch, kind, rounds):
    """Families of near copies, linked to the original or not, by rounds or by blocks."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 64)
    rows = _family(kind)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_classes(df).collect()} == {(i, find(i)) for i in sets}


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(PROSE.split()[20:50])), (2, None), (3, ""), (None, PROSE), (4, "tiny")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (1, None), (2, None), (None, None)}
    left = decontamination.drop_leaking(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6, 7, 8]
    clash = docs.withColumn("__leak_key", F.lit(1).cast("long"))
    assert decontamination.drop_leaking(clash, items).columns == clash.columns and decontamination.drop_leaking(clash, items).count() == 6
    assert decontamination.leaks(empty, items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).count() == 0


def test_leaks_in_blocks(spark, docs):
    items = spark.createDataFrame([(k, " ".join(PROSE.split()[k : k + 30])) for k in range(20)], "item_id long, text string")
    small = decontamination.LeakConfig(block_grams=600)
    assert set(map(tuple, decontamination.leaks(docs, items, small).collect())) == set(map(tuple, decontamination.leaks(docs, items).collect()))


def test_short_items_are_leaked_by_equal_texts_only(spark):
    items = spark.createDataFrame([(1, "Two plus two?"), (2, "two PLUS two"), (3, "?!"), (None, "a")], "item_id long, text string")
    df = spark.createDataFrame([(1, "two plus  two"), (2, "what is two plus two now"), (3, "A."), (4, "?!"), (5, None)], "doc_id long, text string")
    got = {tuple(r) for r in decontamination.leaks(df, items).collect()}
    assert got == {(1, 1, 1, 0, 12), (1, 2, 1, 0, 12), (3, None, 1, 0, 1)}


def test_passage_in_many_items_and_documents():
    """A common prompt is worked on in bounded runs; they find what one run finds."""
    rng = np.random.default_rng(5)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    prompt = letters(64)
    items = [(i, prompt + letters(60)) for i in range(40)] + [(200, b"ab" * 40), (201, letters(20))]
    texts = [letters(int(rng.integers(0, 300))) + prompt + (items[k % 40][1][64 : 64 + k] if k % 2 else b"") + letters(50) for k in range(30)]
    texts += [b"", b"ab" * 300, items[-1][1], b"x" + items[-1][1], b"", prompt[:40] + letters(40)]
    whole = decontamination.LeakConfig(hits=1 << 40)
    index = decontamination.build_index(items, whole)
    want = decontamination.find_leaks(texts, index, whole)
    assert len(want) >= 30 * 40
    for hits in (1, 5_000, 20_000):
        cfg = decontamination.LeakConfig(hits=hits)
        assert decontamination.find_leaks(texts, index, cfg) == want
        at, gram = decontamination.known_grams(np.frombuffer(b"\0".join(texts), np.uint8), index, cfg)
        n = index.first[gram + 1] - index.first[gram]
        runs = list(decontamination.hit_runs(at, gram, index, cfg))
        assert len(runs) > 1 and runs[0][0] == 0 and runs[-1][1] == len(at)
        assert all(n[i:j].sum() <= max(hits, 160 * n.max()) for i, j in runs)


def test_token_files_of_one_id(spark):
    """Rows without an id, and equal rows, are spread over the shards."""
    rows = [(None, "same text here")] * 600 + [(None, f"text {i}") for i in range(300)] + [(4, "x"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_token_files(df, shared_path(spark, "one-id"), path, 2)
    n_docs = [r["n_docs"] for r in manifest.collect()]
    assert sum(n_docs) == 902 and max(n_docs) < 350
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 900 + [1, 4]
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got][:-1]]).tolist()
    same = max({r["ids_crc32"] for r in got}, key=[r["ids_crc32"] for r in got].count)
    assert [r["ids_crc32"] for r in got].count(same) == 600


def test_mixing(docs, empty):
    got = mixing.op3_mixing(docs).collect()
    assert len(got) == 10 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    total = sum(len(r["text"].split()) for r in mixed.collect())
    assert total == sum(r["taken"] for r in got)
    assert mixing.op3_mixing(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_token_files(docs, empty):
    got = token_files.op7_token_files(docs).collect()
    assert len(got) == 10 and sorted(r["n_tokens"] for r in got)[:2] == [1, 1]
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert token_files.op7_token_files(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits, tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 700, 5000, 0, 64)]
    where = fs.LocalFileSystem()
    writer = token_files.ShardWriter(where.open_output_stream(str(tmp_path / "x")), block=512, bits=bits)
    for k, p in enumerate(parts):
        writer.add(np.array([k]), np.array([k != 4]), np.array([len(p)]), p)
    writer.close()
    with where.open_input_file(str(tmp_path / "x")) as source:
        shard = token_files.ShardReader(source)
        got = list(shard.documents())
        assert shard.read_block(3).tolist() == np.concatenate(parts)[1536:2048].tolist()
    assert [i for i, _ in got] == [0, 1, 2, 3, None, 5] and all((a == b).all() for (_, a), b in zip(got, parts))
    with pytest.raises(ValueError):
        (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-9])
        token_files.ShardReader(where.open_input_file(str(tmp_path / "y")))


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None), (7, 0), (99, 1)], "doc_id long, toxic int")
    got = toxicity.op1_toxicity(docs, labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got) and all(r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert all(r["score"] == 0 for r in toxicity.op1_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.op1_toxicity(empty, labels).count() == 0


def test_substring_dedup(docs, empty):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect()), key=str)
    n = len(PROSE.split())
    assert got == sorted([(1, n, 0), (2, n, n), (2, n, n), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 150_000, 0), (None, n, 0), (7, 2, 0), (8, 3, 0)], key=str)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_split_anchors_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shared = [f"s{i}" for i in range(90)]
    rows = []
    for i in range(60):
        own = [f"d{i}_{k}" for k in range(80)]
        cut, at = int(rng.integers(55, 91)), int(rng.integers(0, 80))
        rows.append((i, " ".join(own[:at] + shared[:cut] + own[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = sorted(map(tuple, substring_dedup.substring_dedup(df).collect()))
    seen, want = {}, {}
    for i, t in rows:
        w, gone = t.split(), set()
        windows = [tuple(w[s : s + 50]) for s in range(len(w) - 49)]
        for s, x in enumerate(windows):
            if seen.get(x, i) < i:
                gone.update(range(s, s + 50))
        for x in windows:
            seen.setdefault(x, i)
        want[i] = len(gone)
    assert {r[0]: r[2] for r in plain} == want
    real = substring_dedup._shared_anchors
    source = substring_dedup.HOT_DOCUMENTS
    assert source > 2 and real is not None
    # the split path: every shared anchor counts as one of very many documents
    def all_hot(batches):
        import pyarrow as pa

        for b in real(batches):
            marked = [(np.frombuffer(x, np.uint64) | np.uint64(1)).tobytes() for x in b["anchors"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(marked, pa.binary())], ["doc_id", "anchors"])

    monkeypatch.setattr(substring_dedup, "_shared_anchors", all_hot)
    assert sorted(map(tuple, substring_dedup.substring_dedup(df).collect())) == plain


def test_token_counts(spark, docs, empty, tmp_path):
    got = token_counts.op9_token_counts(docs).collect()
    assert sum(r["n_docs"] for r in got) > 0
    assert token_counts.op9_token_counts(empty).count() == 0
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    change = lambda *rows: spark.createDataFrame(list(rows), token_counts.DELTA)
    assert rollup.commit("b1", change(("s", "en", "v1", 1, 10), ("s", "en", "v1", 1, 5), (None, None, "v1", 1, 2)))
    assert not rollup.commit("b1", change(("s", "en", "v1", 1, 10)))
    assert rollup.commit("b2", change(("s", "en", "v1", -1, -10), ("s", "en", "v2", 1, 8), (None, None, "v1", -1, -2)))
    assert {tuple(r) for r in rollup.totals(drop_empty=True).collect()} == {("s", "en", "v1", 1, 5), ("s", "en", "v2", 1, 8)}
    with pytest.raises(ValueError):
        rollup.commit("../x", change())


def test_licenses(docs, empty):
    assert licenses.license_scan(docs).count() == 0 and licenses.license_scan(empty).count() == 0


def test_language_model(docs, empty):
    got = language_model.op10_lm_scores(docs).collect()
    assert len(got) == 10 and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    none = language_model.lm_scores(docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in none)
    assert language_model.op10_lm_scores(empty).count() == 0


def test_pipeline_stages_keep_their_contract(spark):
    sf = "/root/testdata/sf0.001"
    from fleetlens.llm.common import documents, materialize

    docs = documents(spark, sf)
    source = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = materialize(stage(spark, docs, sf), "test")
        after = [r["doc_id"] for r in docs.collect()]
        assert docs.columns == documents(spark, sf).columns and set(after) <= before <= source, name
        assert name == "pareto_mix" or len(after) == len(set(after))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_empty_pipeline(spark, tmp_path):
    from fleetlens.llm.common import documents

    documents(spark, "/root/testdata/sf0.001").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_family_of_near_copies_costs_rows_by_its_members(spark):
    """Rows of what meets: one for each bucket and group, and a few for each class,
    not one for each class and key (300 keys of 40 classes here)."""
    import pyarrow as pa

    J = jaccard_join
    rng = np.random.default_rng(3)
    classes = np.arange(1, 41, dtype=np.int64) * 1001
    entries = [(k, c) for k in range(300) for c in rng.permutation(classes)[: 2 if k == 0 else 38].tolist()]
    keys = np.array([k * 7919 for k, _ in entries], np.uint64)
    tags = np.array([c << 2 | 3 for _, c in entries], np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([keys.tobytes()], pa.binary()), pa.array([tags.tobytes()], pa.binary())], ["bucket", "keys", "tags"])
    met = [r for out in J._meet([5, 6, 7])(iter([batch])) for r in out.to_pylist()]
    assert len([r for r in met if r["bucket"] is not None]) <= 3
    met_df = spark.createDataFrame([tuple(r[c] for c in J.MET_COLUMNS) for r in met], J.MET)
    pairs = J.centre_pairs(met_df).collect()
    assert len(pairs) <= 6 * len(classes)
    assert {r["b"] for r in pairs} == set(classes.tolist())
    assert [tuple(sorted((r["a"], r["b"]))) for r in pairs if r["n_two"]] == [tuple(sorted(c for k, c in entries if k == 0))]

    # the partners are those that met a class most often
    count = {}
    for r in met:
        if r["bucket"] is not None:
            for a, b, n in zip(*(np.frombuffer(r[c], np.int64).tolist() for c in ("a", "b", "n_keys")), strict=True):
                if a != b:
                    count[b, a] = count.get((b, a), 0) + n
    for c in {b for b, _ in count}:
        best = sorted((-n, a) for (b, a), n in count.items() if b == c)
        assert [r["a"] for r in sorted((r for r in pairs if r["b"] == c and (r["rank"] or 9) <= J.FIRST_PARTNERS), key=lambda r: r["rank"])] == [a for _, a in best[: J.FIRST_PARTNERS]]
        assert [r["a"] for r in pairs if r["b"] == c and r["hub"]] == [max(a for n, a in best if n == best[0][0])]


def test_the_original_of_a_family_is_found_over_all_buckets(spark):
    """A variant that is in two groups of a bucket meets more there than the original,
    which meets most in all buckets together."""
    import pyarrow as pa

    J = jaccard_join
    original, variants = 5_000_001, [1001 * k for k in range(1, 31)]
    rows, expected = [], {}
    for bucket in range(30):
        groups = [[original, *(v for i, v in enumerate(variants) if i != bucket)], [variants[(bucket + 1) % 30], variants[(bucket + 2) % 30], variants[(bucket + 3) % 30]]]
        keys = np.concatenate([np.full(len(g), 10 * bucket + k, np.uint64) for k, g in enumerate(groups)])
        tags = np.array([c << 2 | 3 for g in groups for c in g], np.uint64)
        batch = pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([keys.tobytes()], pa.binary()), pa.array([tags.tobytes()], pa.binary())], ["bucket", "keys", "tags"])
        rows += [r for out in J._meet([5, 6, 7])(iter([batch])) for r in out.to_pylist()]
        for g in groups:
            for c in g:
                expected[c] = expected.get(c, 0) + len(g) - 1
    pairs = J.centre_pairs(spark.createDataFrame([tuple(r[c] for c in J.MET_COLUMNS) for r in rows], J.MET)).collect()
    assert {r["b"]: r["met"] for r in pairs if r["met"] is not None} == expected
    assert all(r["a"] == r["b"] for r in pairs if r["met"] is not None)


def test_small_steps_write_few_files(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60) if i % 6], "a long, b long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        labels = jaccard_join.components(edges)
        assert len(labels.inputFiles()) <= jaccard_join.LEAST_TASKS
        assert {r["class"]: r["label"] for r in labels.collect()} == {i: max((i - 1) // 6 * 6 + 1, 1) for i in range(1, 61)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
